"""Line dedup over levelled sorted runs of line hashes.

Method. Lines become 128-bit hashes of their keys (white space stripped at both ends, A-Z lower-cased). ``LineRuns``
holds what was seen: runs of (hash, owner) sorted by hash, the owner being the smallest doc_id that has the line. A new
batch (documents with larger ids than all before) is merge-joined with the runs: a key that a run has keeps its owner,
the rest (the anti-join) becomes a new run of level 0. ``FANOUT`` runs of a level are compacted to one run of the next,
so n batches cost O(n log n) and a probe meets O(log n) runs. Runs are Parquet in the shared folder.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .shared import Workspace
from .textblocks import BASE, LOWER, SECOND, blocks, longs, ranges_hash, trimmed

FANOUT = 3
BATCHES = 4
LEAST = 10  # code points of a key that counts


def _keys(batches):
    for batch in batches:
        parts = []
        for block in blocks(batch.column(1)):
            _, _, first, last, bounds = block.lines()
            rows = np.repeat(np.arange(block.docs), np.diff(bounds)) + block.first
            long = np.flatnonzero(block.code_points(first, last) >= LEAST)
            low = LOWER[block.data]
            f, t = first[long], last[long]
            parts.append((rows[long], ranges_hash(low, f, t), ranges_hash(low, f, t, SECOND)))
        if parts:
            at, h1, h2 = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.record_batch([batch.column(0).take(pa.array(at)), longs(h1), longs(h2)], names=["doc_id", "h1", "h2"])


def _without(digest: bool):
    """(doc_id, text or its SHA-256, n_lines, n_dropped) of (doc_id, text, hashes of the lines to drop)."""

    def run(batches):
        for batch in batches:
            drops = batch.column(2)
            for block in blocks(batch.column(1)):
                out = [None] * block.docs
                starts, ends, first, last, bounds = block.lines()
                low = LOWER[block.data]
                counts = np.stack([np.diff(bounds), np.zeros(block.docs, np.int64)])
                whole = memoryview(np.ascontiguousarray(block.data))
                for d in range(block.docs):
                    gone = drops[block.first + d]
                    text = whole[block.offsets[d] : block.offsets[d + 1]]
                    if gone.is_valid and len(gone.values):
                        a, b = bounds[d], bounds[d + 1]
                        part, f, t = low[starts[a] : ends[b - 1]], first[a:b] - starts[a], last[a:b] - starts[a]
                        h1, h2 = (ranges_hash(part, f, t, key).view(np.int64).tolist() for key in (BASE, SECOND))
                        dropped = set(zip(*(gone.values.field(k).to_pylist() for k in (0, 1)), strict=True))
                        stay = np.array([x not in dropped for x in zip(h1, h2, strict=True)]) | (f == t)
                        counts[1, d] = b - a - stay.sum()
                        text = b"\n".join(whole[starts[k] : ends[k]] for k in np.flatnonzero(stay) + a)
                    out[d] = hashlib.sha256(text).hexdigest() if digest else bytes(text).decode()
                ids, rest = (batch.column(k).slice(block.first, block.docs) for k in (0, 3))
                yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.string()), pa.array(counts[0]), pa.array(counts[1]), rest], names=["doc_id", "kept", "n_lines", "n_dropped", "rest"])

    return run


class LineRuns:
    """The levelled runs. ``add`` takes the lines (doc_id, h1, h2) of the next documents by id and returns those to drop."""

    def __init__(self, space: Workspace, fanout: int = FANOUT):
        self.space, self.fanout, self.levels, self.made = space, fanout, [], 0

    def _write(self, df: DataFrame, level: int) -> None:
        name = f"run-{self.made}-level-{level}"
        self.made += 1
        kept = self.space.store(df.select("h1", "h2", "owner").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2"), name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, kept))
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(self._union([x for _, x in old]), level + 1)
            for gone, _ in old:
                self.space.drop(gone)

    @staticmethod
    def _union(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for x in runs[1:]:
            out = out.union(x)
        return out

    def add(self, lines: DataFrame) -> DataFrame:
        batch = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("own"), F.max("doc_id").alias("last"))
        runs = [x for level in self.levels for _, x in level]
        if runs:
            batch = batch.join(self._union(runs), ["h1", "h2"], "left")
        else:
            batch = batch.withColumn("owner", F.lit(None).cast("long"))
        n = self.made
        merged = self.space.store(batch, f"merged-{n}")
        self._write(merged.filter("owner is null").select("h1", "h2", F.col("own").alias("owner")), 0)
        repeated = merged.select("h1", "h2", F.coalesce("owner", "own").alias("owner"), "last").filter("last > owner").drop("last")
        out = self.space.store(lines.join(repeated, ["h1", "h2"]).filter("doc_id > owner").select("doc_id", "h1", "h2").distinct(), f"drops-{n}")
        self.space.drop(f"merged-{n}")
        return out


def dedup_lines(docs: DataFrame, batches: int = BATCHES, digest: bool = False, rest: tuple[str, ...] = ()) -> DataFrame:
    """Documents without the lines that a smaller doc_id has: doc_id, kept (text, or its SHA-256 with ``digest``),
    n_lines, n_dropped and ``rest``, a struct of the columns named there. The work goes in ``batches`` ranges of doc_id,
    as new documents would arrive.

    Defined results: a null or empty text has one empty line; keys under ten code points never drop; a line repeated
    within its smallest document stays; rows that repeat a doc_id count as one document; a row without doc_id keeps all
    its lines and owns none; other columns are ignored; an empty table gives an empty result.
    """
    space = Workspace(docs.sparkSession, "lines")
    carried = F.struct(*[docs[c] for c in rest]) if rest else F.lit(None).cast("boolean")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), carried.alias("rest"))
    lines = space.store(docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(trimmed(_keys), "doc_id long, h1 long, h2 long"), "lines")
    cuts = lines.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)])).head()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    runs = LineRuns(space)
    drops = []
    for low, high in zip(edges, edges[1:], strict=False):
        part = lines
        if low is not None:
            part = part.filter(F.col("doc_id") > low)
        if high is not None:
            part = part.filter(F.col("doc_id") <= high)
        drops.append(runs.add(part))
    space.keep("drops")
    gone = LineRuns._union(drops).groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("gone"))
    rows = docs.join(gone, "doc_id", "left").select("doc_id", "text", "gone", "rest")
    schema = StructType([StructField("doc_id", LongType()), StructField("kept", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType()), rows.schema["rest"]])
    return rows.mapInArrow(trimmed(_without(digest)), schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs, digest=True).select("doc_id", "n_lines", "n_dropped", F.col("kept").alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, p, l, lower_az AS k FROM (
    SELECT doc_id, p, l, translate(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents))
), owners AS (
  SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id > owner) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (owner IS NULL OR doc_id <= owner), '')) AS kept_sha256
FROM lines LEFT JOIN owners USING (k) GROUP BY doc_id
"""
