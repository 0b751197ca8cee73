"""Source divergence audit over run-length columns of term counts.

Method. Terms are counted per (lang, source); each lang keeps the terms that enough of its documents hold. The vocabulary of
a lang is reordered by the terms' counts over all its sources, so that terms with equal counts stand together: terms with the
same counts in every source are one row with a length, and the rows are range-partitioned and sorted by their counts. Each
source is then a column of that order, run-length encoded a slice at a time: most of a column are long runs of 0 and of small
counts. For a pair of sources the run boundaries of both columns are intersected, f is computed once per piece and multiplied
by its length, and the slices' sums are added. All arithmetic is on integers.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Workspace
from .textblocks import LOWER, blocks

DOCUMENTS = 3  # of a lang that hold a kept term
TOP = 200  # ranks of the terms
SCALE = 9  # decimal places of a probability
FLUSH = 1 << 23  # bytes of text over which a task counts terms before it sends them
SALTS = 16  # parts that a source's terms are ranked in first
# Bytes of a term: letters and everything beyond ASCII.
LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def probability(count, total) -> np.ndarray:
    """1 + floor(10^SCALE * (count + 1) / total), by long division in steps that fit a long (total below 2^53)."""
    left, out = np.asarray(count, np.int64) + 1, 0
    whole, left = left // total, left % total
    out = whole
    for _ in range(SCALE // 3):
        left = left * 1000
        out, left = out * 1000 + left // total, left % total
    return out + 1


def probability_of(count: Column, total: Column) -> Column:
    """The same as a column."""
    left = (count + 1).cast("long")
    out, left = F.call_function("div", left, total), left % total
    for _ in range(SCALE // 3):
        left = left * 1000
        out, left = out * 1000 + F.call_function("div", left, total), left % total
    return out + 1


def _counts(batches):
    """(lang, source, term, n, docs) over about FLUSH bytes of text at a time."""
    held, size = [], 0
    for batch in batches:
        for block in blocks(batch.column(0)):
            low = LOWER[block.data]
            full = LETTER[low]
            edge = np.zeros(len(low) + 1, bool)
            edge[block.offsets] = True
            begin, end = full.copy(), full.copy()
            begin[1:] &= ~full[:-1] | edge[1:-1]
            end[:-1] &= ~full[1:] | edge[1:-1]
            starts = np.flatnonzero(begin)
            sizes = np.flatnonzero(end) + 1 - starts
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(low[full]))])
            coded = terms.dictionary_encode()
            per = np.diff(np.searchsorted(starts, block.offsets))
            # One number per (document, term), so that a term's documents are counted too.
            key = np.repeat(np.arange(block.docs), per) * max(len(coded.dictionary), 1) + coded.indices.to_numpy()
            key, n = np.unique(key, return_counts=True)
            doc, term = np.divmod(key, max(len(coded.dictionary), 1))
            rows = pa.table({"lang": batch.column(1).slice(block.first, block.docs).take(pa.array(doc)), "source": batch.column(2).slice(block.first, block.docs).take(pa.array(doc)),
                             "term": coded.dictionary.take(pa.array(term)), "n": pa.array(n)})
            held.append(rows.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ([], "count_all")]))
            size += len(block.data)
            if size >= FLUSH:
                yield from _summed(held)
                held, size = [], 0
    if held:
        yield from _summed(held)


def _summed(held):
    out = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n_sum", "sum"), ("count_all", "sum")])
    term = out["term"].combine_chunks()
    out = pa.table({"lang": out["lang"], "source": out["source"], "term": pc.cast(term, pa.large_string()).cast(pa.string()), "n": out["n_sum_sum"], "docs": out["count_all_sum"]})
    yield from out.combine_chunks().to_batches()


def runs_of(counts: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, counts) of the runs of a column; row k of the column spans edges[k]:edges[k + 1]."""
    last = np.append(np.flatnonzero(counts[1:] != counts[:-1]), len(counts) - 1)
    return edges[last + 1], counts[last]


def intersect(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, values of a, values of b) of the pieces between all run ends of two columns."""
    ends = np.union1d(a[0], b[0])
    return np.diff(np.concatenate([[0], ends])), a[1][np.searchsorted(a[0], ends)], b[1][np.searchsorted(b[0], ends)]


def _pairs(sent):
    """Sums of f * length of a task's slices: (lang, a, b, value). Rows (lang, length, sources, counts) come sorted."""

    def run(batches):
        totals = sent.value  # lang -> (numbers of its sources, their totals)
        sums: dict = defaultdict(int)
        for batch in batches:
            lang = batch.column(0)
            cuts = np.flatnonzero(pc.not_equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False)) + 1 if len(lang) else []
            for at, to in zip([0, *cuts], [*cuts, len(lang)], strict=True):
                if at == to:
                    continue
                name = lang[at].as_py()
                edges = np.concatenate([[0], np.cumsum(batch.column(1)[at:to].to_numpy())])
                given, counts = batch.column(2).slice(at, to - at), batch.column(3).slice(at, to - at)
                row = np.repeat(np.arange(to - at), pc.list_value_length(given).to_numpy(zero_copy_only=False))
                source, count = given.flatten().to_numpy(), counts.flatten().to_numpy()
                columns = {}
                for s, total in totals[name]:
                    dense = np.zeros(to - at, np.int64)
                    mine = source == s
                    dense[row[mine]] = count[mine]
                    ends, values = runs_of(dense, edges)
                    columns[s] = ends, probability(values, total)
                for a, one in columns.items():
                    for b, other in columns.items():
                        if a < b:
                            length, p, q = intersect(one, other)
                            square = (p - q) ** 2
                            sums[name, a, b] += int((square // q * length).sum())
                            sums[name, b, a] += int((square // p * length).sum())
        if sums:
            keys = list(sums)
            yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["lang", "a", "b", "value"])

    return run


def divergence(docs: DataFrame, least: int = DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each (lang, source) stands from the lang's other sources (part
    ``pair``, item the other source) and which kept terms it has more often than its lang (part ``term``, first ``top``).

    With p = 1 + floor(10^9 (count + 1) / (N + V)) of every kept term, f = floor((p - q)^2 / q). A pair's value is the sum of f
    over all kept terms.

    Defined results: null text, lang and source are ''; a source without terms, or a lang that keeps none, still has its
    pairs (value 0 without kept terms) and no terms; equal values rank by item; rows that repeat count each; other columns
    are ignored; an empty table gives an empty result. Counts are exact below 2^53 / 1000 occurrences of a source; sums of f
    stay below 2^63 while a lang keeps fewer than 10^9 terms.

    One row per (lang, source) is sent to the tasks; the result has a row for each pair of them.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "divergence")
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    rows = docs.select(text, lang, source)
    raw = rows.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    counts = space.store(raw.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    groups = space.store(rows.select("lang", "source").groupBy("lang", "source").count().select("lang", "source"), "groups")
    # A source's number within its lang; sources of a lang are as many as the result has items for each of them.
    groups = groups.withColumn("s", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long"))
    found = counts.join(groups, ["lang", "source"])
    # One row per kept term, its sources and counts side by side.
    of = F.array_sort(F.collect_list(F.struct("s", "n")))
    terms = found.groupBy("lang", "term").agg(of.alias("of"), F.sum("n").alias("all"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least).drop("docs")
    terms = space.store(terms, "terms")
    space.drop("counts")
    kept = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("all"))
    per = terms.select("lang", F.explode("of").alias("x")).groupBy("lang", "x.s").agg(F.sum("x.n").alias("n"))
    stats = groups.join(kept, "lang", "left").join(per, ["lang", "s"], "left")
    v, n = F.coalesce("v", F.lit(0)), F.coalesce("n", F.lit(0))
    stats = space.store(stats.select("lang", "s", "source", (n + v).alias("total"), (F.coalesce("all", F.lit(0)) + v).alias("lang_total")), "stats")

    # Terms with the same counts everywhere are one row; sorted by their counts, equal counts of a source lie together.
    alike = terms.groupBy("lang", "of").agg(F.count("*").alias("length"))
    alike = alike.repartitionByRange("lang", "of").sortWithinPartitions("lang", "of").select("lang", "length", "of.s", "of.n")
    totals = defaultdict(list)
    for x in stats.select("lang", "s", "total").toLocalIterator():
        totals[x["lang"]].append((x["s"], x["total"]))
    sums = alike.mapInArrow(_pairs(spark.sparkContext.broadcast(dict(totals))), "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    other = stats.select("lang", F.col("s").alias("b"), F.col("source").alias("item"))
    pairs = stats.select("lang", F.col("s").alias("a"), "source").join(other, "lang").filter("a <> b").join(sums, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    each = terms.select("lang", "term", "all", F.explode("of").alias("x")).select("lang", "term", "all", "x.s", "x.n").join(stats, ["lang", "s"])
    p, q = probability_of(F.col("n"), F.col("total")), probability_of(F.col("all"), F.col("lang_total"))
    each = each.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    each = each.select("lang", "source", F.lit("term").alias("part"), "item", F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))
    order = F.desc("value"), F.col("item")
    salted = each.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(*order))).filter(F.col("rank") <= top).drop("rank", "salt")
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).filter(F.col("rank") <= top)
    return pairs.unionByName(best)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
size AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
pairs AS (SELECT DISTINCT lang, source FROM docs),
seen AS (SELECT lang, source, term, count(*) AS c FROM words GROUP BY ALL),
total AS (SELECT lang, source, sum(c) AS n FROM seen SEMI JOIN kept USING (lang, term) GROUP BY lang, source),
prob AS (SELECT p.lang, p.source, k.term, coalesce(s.c, 0) AS c, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(s.c, 0) + 1)) // (coalesce(t.n, 0) + z.v) AS p,
    1 + (CAST(1000000000 AS HUGEINT) * (k.c + 1)) // (z.n + z.v) AS q
  FROM pairs p JOIN kept k USING (lang) JOIN size z USING (lang) LEFT JOIN seen s ON s.lang = p.lang AND s.source = p.source AND s.term = k.term
  LEFT JOIN total t ON t.lang = p.lang AND t.source = p.source),
far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM prob a JOIN prob b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM pairs a JOIN pairs b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
every AS (SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM prob WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
