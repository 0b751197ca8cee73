"""Approximate nearest neighbours by a permutation index.

Method. ``PIVOTS`` vectors of the corpus (those with the smallest hash of their id: the only sample, and fixed in size)
order space: a vector is represented by its ``PREFIX`` nearest pivots in order. The index stores every vector with that
permutation. A task posts the vectors of a block in the inverted files of their pivots, (vector, place); a query walks the
files of its own pivots and so accumulates the footrule distance of permutations to every vector of the block (pivots that
one side lacks count as placed last). The closest ``RERANK`` share of each block is reranked by the exact Euclidean
distance in double precision, and the best of all blocks are merged.

Equal vectors are one entry that names its k + 1 smallest ids, more of which no answer can hold; so a vector that a third
of all rows repeat costs nothing. Queries go in slabs of about ``SLAB`` rows against all blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Workspace

PIVOTS = 64
PREFIX = 32
RERANK = 0.35
LEAST = 256  # vectors of a block that are reranked at least
SLAB = 4096


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def permutations(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest ``prefix`` pivots of each vector, nearest first, ties to the smaller pivot."""
    d = (pivots**2).sum(1)[None] - 2 * vectors @ pivots.T
    return np.argsort(d, axis=1, kind="stable")[:, :prefix].astype(np.int16)


def footrule(orders: np.ndarray, queries: np.ndarray, pivots: int) -> np.ndarray:
    """Footrule distance of each query's permutation to each vector's, up to a constant per query, over inverted files."""
    n, m = orders.shape
    flat = orders.ravel()
    by = np.argsort(flat, kind="stable")
    where = np.searchsorted(flat[by], np.arange(pivots + 1))
    vector, place = by // m, (by % m).astype(np.int32)
    out = np.zeros((len(queries), n), np.int32)
    for q, order in enumerate(queries):
        acc = out[q]
        for at, p in enumerate(order):
            lo, hi = where[p], where[p + 1]
            r = place[lo:hi]
            acc[vector[lo:hi]] += np.abs(r - at) - (m - r) - (m - at)
    return out


def _search(pivots, prefix, slab, k, rerank):
    def run(batches):
        ids, queries = slab.value
        points = pivots.value
        width = points.shape[1]
        asked = permutations(queries, points, prefix)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, mine = _matrix(batch.column(1), width), batch.column(2)
            orders = mine.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
            holders = batch.column(0)  # array of the ids of equal vectors
            starts = holders.offsets.to_numpy()
            names = holders.values.to_numpy(zero_copy_only=False)
            take = min(len(vectors), max(LEAST, math.ceil(rerank * len(vectors))))
            rows = []
            for a in range(0, len(ids), 64):
                rank = footrule(orders, asked[a : a + 64], len(points))
                for q in range(len(rank)):
                    near = np.argpartition(rank[q], take - 1)[:take]
                    gap = vectors[near] - queries[a + q]
                    dist = np.sqrt((gap * gap).sum(axis=1))
                    if len(near) > k:  # k + 1 entries hold k other rows, as an entry names at least one
                        edge = np.partition(dist, k)[k]
                        near, dist = near[dist <= edge], dist[dist <= edge]
                    found = [(d, int(v)) for d, e in zip(dist.tolist(), near.tolist(), strict=True) for v in names[starts[e] : starts[e + 1]] if v != ids[a + q]]
                    rows += [(int(ids[a + q]), v, d) for d, v in sorted(found)[:k]]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def _index(pivots, prefix):
    def run(batches):
        points = pivots.value
        for batch in batches:
            if batch.num_rows:
                orders = permutations(_matrix(batch.column(1), points.shape[1]), points, prefix)
                offsets = pa.array(np.arange(len(orders) + 1) * orders.shape[1], pa.int32())
                yield pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(orders.ravel()))], names=["ids", "vector", "pivots"])

    return run


class PermutationIndex:
    """Index over (vec_id, embedding); ``search`` returns query_id, rank, vec_id, score.

    Defined results: vectors that are null, zero, of another length than most, or that hold a null or non-finite
    component take no part, nor do rows without vec_id; of rows that repeat a vec_id the least vector counts; ties go to
    the smaller vec_id; with fewer rows than k + 1 all others are found; other columns are ignored; an empty table gives
    an empty result.
    """

    def __init__(self, spark: SparkSession, pivots: int = PIVOTS, prefix: int = PREFIX, rerank: float = RERANK):
        self.spark, self.n_pivots, self.prefix, self.rerank = spark, pivots, prefix, rerank
        self.space = Workspace(spark, "ann")

    def clean(self, vectors: DataFrame) -> DataFrame:
        v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).filter(
            "vec_id is not null and size(vector) > 0 and forall(vector, x -> x is not null and abs(x) < double('Infinity')) and exists(vector, x -> x <> 0)")
        width = v.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").head()
        self.width = width[0] if width else 0
        return self.space.store(v.filter(F.size("vector") == self.width).groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")

    def build(self, vectors: DataFrame, k: int) -> PermutationIndex:
        self.k, self.vectors = k, self.clean(vectors)
        same = Window.partitionBy("vector").orderBy("vec_id")
        few = self.vectors.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k + 1)
        entries = self.space.store(few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ids", "vector"), "entries")
        points = entries.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(self.n_pivots).select("vector").toPandas()["vector"]
        self.pivots = self.spark.sparkContext.broadcast(np.array([list(p) for p in points], np.float64).reshape(len(points), self.width))
        self.entries = self.space.store(entries.mapInArrow(_index(self.pivots, min(self.prefix, len(points))), "ids array<long>, vector array<double>, pivots array<short>"), "index")
        return self

    def search(self, queries: DataFrame) -> DataFrame:
        """``queries``: (query_id, vector) of the index's width; a query's own vec_id is no candidate."""
        n = queries.count()
        found = self.spark.createDataFrame([], "query_id long, vec_id long, score double")
        slabs = max(1, math.ceil(n / SLAB))
        for s in range(slabs if n else 0):
            rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(slabs)) == s).orderBy("query_id").toPandas()
            if len(rows):
                slab = self.spark.sparkContext.broadcast((rows["query_id"].to_numpy(np.int64), np.array([list(v) for v in rows["vector"]], np.float64)))
                part = self.entries.mapInArrow(_search(self.pivots, min(self.prefix, len(self.pivots.value)), slab, self.k, self.rerank), "query_id long, vec_id long, score double")
                found = found.union(part)
        best = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= self.k).select("query_id", "rank", "vec_id", "score")


def op10_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = PermutationIndex(spark).build(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 10)
    return index.search(index.vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector"))
