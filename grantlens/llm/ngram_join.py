"""N-gram Jaccard join: blocked sparse product of the document by n-gram incidence, pruned by size-derived bounds.

Method. A document's row of the incidence matrix holds its distinct word n-grams (64-bit hashes). Rows with the same
set collapse to one node (its smallest doc_id). The product of the matrix with its transpose is never built whole:

1. Blocks of columns are ordered frequent-last. A node needs only its first ``n - ceil(t n) + 1`` columns of that order
   (any pair over the threshold meets there), which is the block that is multiplied.
2. In each of ``ROUNDS`` rounds the entries of a column and size class (narrower than the size bound, half-shifted from
   round to round) stand in an order that is random for every column, and each is paired with the one before it if
   their components differ. So a group of n near copies costs a few n pairs, not n * n / 2; the links found merge it.
3. What is left are column entries of nodes of different components. All their pairs are multiplied whose sizes and
   places allow a link if this is their first common column (``min(|x| - i, |y| - j)`` reaches the overlap needed; a
   linked pair's first common column passes). Pairs inside a component cannot change it.
4. Before verification a pair's overlap over the whole block is accumulated; with ``m`` common columns in the block at
   most ``m + max(ceil(t |x|), ceil(t |y|)) - 1`` columns can be common, and pairs below the bound go. The rest is
   verified on the whole rows.

The frequent columns (at most ``FREQUENT``, found by counts over all documents) only set the order; a shingle missing
among them costs time, never a link. Everything is a join, window or aggregation on Spark; numpy works inside tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Workspace, connected_components
from .textblocks import U, blocks, longs, mix, trimmed

FREQUENT = 1 << 18  # columns known as frequent: 2 MB when sent to the tasks, whatever the input
ROUNDS = 3
SEEN = 2  # occurrences of a column within COUNT_ROWS n-grams that make its count worth sending
COUNT_ROWS = 1 << 22
BUCKETS = 1 << 20  # of the bitmap of nodes whose rows are needed for verification (128 KB)
_MUL = [U(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2127599BF4325C37, 0x9FB21C651E98DF25)]


def shingle_sets(column: pa.Array, words: int):
    """(row, sorted distinct n-gram hashes) of each document; fewer words than ``words`` make one n-gram of all of them."""
    for block in blocks(column):
        h, bounds, _ = block.words()
        n = len(h)
        if n >= words:
            s = np.zeros(n - words + 1, U)
            for j in range(words):
                s += h[j : n - words + 1 + j] * _MUL[j % 8] * U(2 * (j // 8) + 1)
            s = mix(s)
        for d in range(block.docs):
            a, b = int(bounds[d]), int(bounds[d + 1])
            if b - a >= words:
                yield block.first + d, np.unique(s[a : b - words + 1])
            elif b > a:
                short = np.array([b - a], U) * U(0xC2B2AE3D27D4EB4F)
                for j in range(b - a):
                    short += h[a + j : a + j + 1] * _MUL[j % 8]
                yield block.first + d, mix(short)
            else:
                yield block.first + d, np.zeros(0, U)


def _member(sorted_set: np.ndarray, bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are in the set; ``bits`` marks the top 20 bits that occur."""
    hit = bits[(values >> U(44)).astype(np.int64)]
    at = np.flatnonzero(hit)
    if len(at):
        k = np.minimum(np.searchsorted(sorted_set, values[at]), len(sorted_set) - 1)
        hit[at] = sorted_set[k] == values[at]
    return hit


def _marks(sorted_set: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, bool)
    bits[(sorted_set >> U(44)).astype(np.int64)] = True
    return bits


def _digests(words: int):
    def run(batches):
        seen: set = set()
        held, total = [], 0

        def frequent():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= SEEN
            k = int(keep.sum())
            nulls = pa.nulls(k, pa.int64())
            return pa.record_batch([nulls, pa.array(counts[keep].astype(np.int64)), longs(values[keep]), nulls], names=["doc_id", "n", "h1", "h2"])

        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for i, s in shingle_sets(batch.column(1), words):
                n = len(s)
                if not n:
                    continue
                one = mix(s * U(0x9E6C63D0876A9A47)).sum(dtype=U)
                two = mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U)
                out[:, i] = n, one.view(np.int64), two.view(np.int64)
                if out[1, i] not in seen:
                    seen.add(out[1, i])
                    held.append(s)
                    total += n
                if total >= COUNT_ROWS:
                    yield frequent()
                    held, total, seen = [], 0, set()
            yield pa.record_batch([batch.column(0), *(pa.array(x) for x in out)], names=["doc_id", "n", "h1", "h2"])
        if held:
            yield frequent()

    return run


def _prefixes(words: int, percent: int, frequent):
    def run(batches):
        often = frequent.value
        bits = _marks(often)
        for batch in batches:
            sizes, parts, lengths = [], [], [0]
            for _, s in shingle_sets(batch.column(1), words):
                n = len(s)
                p = n - -(-percent * n // 100) + 1 if n else 0
                if p and len(often):
                    late = _member(often, bits, s)
                    first = s[~late][:p]
                    s = first if len(first) == p else np.concatenate([first, s[late][: p - len(first)]])
                sizes.append(n)
                parts.append(s[:p])
                lengths.append(lengths[-1] + p)
            values = longs(np.concatenate(parts)) if parts else pa.array([], pa.int64())
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), values)], names=["node", "n", "prefix"])

    return run


def _rows(words: int, wanted):
    """(node, row) of the documents whose bucket is marked in ``wanted``."""

    def run(batches):
        bits = np.unpackbits(np.frombuffer(wanted.value, np.uint8)).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(bits[batch.column(2).to_numpy()]))
            if batch.num_rows:
                sets = [s.tobytes() for _, s in shingle_sets(batch.column(1), words)]
                yield pa.record_batch([batch.column(0), pa.array(sets, pa.large_binary()).cast(pa.binary())], names=["node", "row"])

    return run


def _linked(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return run


class JaccardJoin:
    """Links documents whose n-gram sets have 100 * intersection >= percent * union; see the module.

    ``classes`` returns one row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links) and
    copies (rows of the same set). Defined results: null or empty texts have 0 shingles and stay alone; a null doc_id
    keeps its row, links nothing and has a null component; rows that repeat a doc_id are one node; other columns are
    ignored; an empty table gives an empty result.
    """

    def __init__(self, words: int = 5, percent: int = 80):
        self.words, self.percent = words, percent

    def classes(self, docs: DataFrame) -> DataFrame:
        spark = docs.sparkSession
        space = Workspace(spark, "jaccard")
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        first = space.store(docs.mapInArrow(trimmed(_digests(self.words)), "doc_id long, n long, h1 long, h2 long"), "digests")
        # Rows of counts carry h1 = n-gram and no h2; documents always have h2.
        rows = first.filter("h2 is not null")
        often = first.filter("h2 is null").groupBy("h1").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "h1").limit(FREQUENT).toPandas()["h1"].to_numpy(np.int64)
        frequent = spark.sparkContext.broadcast(np.sort(often.view(U)))
        reps = space.store(rows.filter("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "reps")
        links = self._links(space, docs.filter("doc_id is not null"), reps, frequent)
        comp = connected_components(space, links, "all").withColumnRenamed("component", "c")
        space.keep("digests", "reps", "all-")
        of = reps.join(comp, "node", "left").select("h1", "h2", "n", F.coalesce("c", "node").alias("c"), "copies")
        # Rows that repeat a doc_id with other sets may name a larger node: the class is that of the smallest.
        out = rows.join(of, ["h1", "h2", "n"], "left")
        alone = F.col("doc_id").isNull() | (F.col("n") == 0)
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), F.lit(None)).when(alone, F.col("doc_id")).otherwise(F.col("c")).alias("component_id"), F.when(alone, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("copies"))

    def _links(self, space: Workspace, docs: DataFrame, reps: DataFrame, frequent) -> DataFrame:
        width = math.log(100 / self.percent)
        nodes = reps.select("node").distinct()
        prefix = docs.mapInArrow(trimmed(_prefixes(self.words, self.percent, frequent)), "node long, n long, prefix array<long>").filter("n > 0")
        prefix = prefix.join(nodes, "node", "left_semi")
        entries = prefix.select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("i", "column"))
        per = Window.partitionBy("column").orderBy("n", "node")
        # Streaming window functions: no column is held whole in memory.
        near = entries.withColumns({"before": F.lag("node").over(per), "after": F.lead("node").over(per)}).filter("before is not null or after is not null")
        near = space.store(near.select("column", "node", "n", "i", F.floor(F.log("n") / width).cast("int").alias("k0"), F.floor(F.log("n") / width + 0.5).cast("int").alias("k1")), "entries")
        space.release()
        held = space.store(near.groupBy("node", "n").agg(F.collect_list("column").alias("held")), "held")
        links, comp = None, None
        for r in range(ROUNDS):
            named = near if comp is None else near.join(comp, "node", "left")
            named = named.withColumn("c", F.col("node") if comp is None else F.coalesce("component", "node"))
            order = Window.partitionBy("column", f"k{r % 2}").orderBy(F.xxhash64("node", "column", F.lit(r)), "node")
            pairs = named.withColumn("y", F.lag(F.struct("node", "n", "i", "c")).over(order)).filter("y.c <> c")
            pairs = pairs.select(F.col("node").alias("x"), "n", "i", F.col("y.node").alias("y"), F.col("y.n").alias("m"), F.col("y.i").alias("j"))
            pairs = pairs.filter(self._possible(F.least("i", "j"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
            found = self._verified(space, docs, held, pairs, f"round-{r}")
            links = found if links is None else links.union(found)
            comp = space.store(connected_components(space, links, f"cc-{r}"), f"comp-{r}")
            space.drop(f"round-{r}-rows")
            space.release()
        named = near.join(comp, "node", "left").select("column", "node", "n", "i", F.coalesce("component", "node").alias("c"))
        sizes = named.groupBy("column", "c").agg(F.count("*").alias("s"))
        main = sizes.groupBy("column").agg(F.max(F.struct("s", "c"))["c"].alias("main"), F.count("*").alias("k")).filter("k > 1").drop("k")
        mixed = space.store(named.join(main, "column"), "mixed")
        # A pair of two nodes outside the column's main component is met from both sides; one side is enough.
        rest = mixed.filter("c <> main").select("column", F.col("node").alias("x"), "n", "i", F.col("c").alias("cx"))
        every = mixed.select("column", F.col("node").alias("y"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("c").alias("cy"), (F.col("c") == F.col("main")).alias("in_main"))
        bound = F.expr("cx <> cy and (in_main or x < y)") & (F.least("n", "m") * 100 >= self.percent * F.greatest("n", "m"))
        two = rest.join(every, "column").filter(bound & self._possible(F.lit(0)))
        two = two.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        return links.union(self._verified(space, docs, held, two, "rest"))

    def _possible(self, before):
        """Can the overlap needed be reached if at most ``before`` columns in front of entries i of x and j of y are common?"""
        most = before + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
        return most * (100 + self.percent) >= self.percent * (F.col("n") + F.col("m"))

    def _verified(self, space: Workspace, docs: DataFrame, held: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        spark = docs.sparkSession
        x, y = (held.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("held").alias(f"h{k}")) for k in ("a", "b"))
        most = F.size(F.array_intersect("ha", "hb")) + F.ceil(self.percent * F.greatest("na", "nb") / 100) - 1
        pairs = pairs.join(x, "a").join(y, "b").filter(most * (100 + self.percent) >= self.percent * (F.col("na") + F.col("nb")))
        pairs = space.store(pairs.select("a", "b").distinct(), f"{name}-pairs")
        bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
        both = pairs.select(bucket("a").alias("k")).union(pairs.select(bucket("b"))).distinct()
        marked = both.toPandas()["k"].to_numpy(np.int64)  # at most BUCKETS numbers
        bits = np.zeros(BUCKETS, bool)
        bits[marked] = True
        wanted = spark.sparkContext.broadcast(np.packbits(bits).tobytes())
        rows = docs.select(F.col("doc_id"), "text", bucket("doc_id").alias("k")).mapInArrow(trimmed(_rows(self.words, wanted)), "node long, row binary")
        need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        rows = space.store(rows.join(need, "node", "left_semi"), f"{name}-rows")
        x, y = rows.select(F.col("node").alias("a"), F.col("row").alias("x")), rows.select(F.col("node").alias("b"), F.col("row").alias("y"))
        out = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(trimmed(_linked(self.percent)), "a long, b long")
        return space.store(out.distinct(), f"{name}-links")


def near_duplicate_classes(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    return JaccardJoin(words, percent).classes(docs)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return JaccardJoin(words=4, percent=85).classes(docs).select("doc_id", "n_shingles", "component_id")
