"""Helpers shared by the operators: the shared folder, stored tables, split of learning rows, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only a local master without either gets a temporary folder of its own; a cluster without one is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="grantlens-llm-"))
    return sc.getCheckpointDir().rstrip("/")


class Workspace:
    """Tables of one operator call, written as Parquet in the shared folder.

    A written table cuts lineage and survives the loss of executors. The folder goes when the application ends
    (Hadoop's delete-on-exit), single tables earlier through ``drop``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
        self.names: list[str] = []
        path, fs = self._fs(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _fs(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def store(self, df: DataFrame, name: str) -> DataFrame:
        where = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(where)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, name: str) -> None:
        path, fs = self._fs(f"{self.root}/{name}")
        fs.delete(path, True)
        self.names.remove(name)

    def keep(self, *starts: str) -> None:
        """Drop all tables but those whose name starts so."""
        for name in [n for n in self.names if not n.startswith(starts)]:
            self.drop(name)
        self.release()

    def release(self) -> None:
        """Spark deletes the shuffle files of finished steps when the driver's garbage goes; ask for that now, so that
        they do not pile up on the executors' disks over a long operator."""
        gc.collect()
        self.spark._jvm.System.gc()


def held_out(doc_id, folds: int):
    """crc32 of the id as text mod ``folds`` is 0; a null id counts as held out, so nothing is learned from it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(True))


def connected_components(space: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b long); component is the smallest node reachable.

    Rounds of hooking to the smallest neighbour with one pointer jump, on a contracted graph: joins and aggregations
    only, every round stored. The first round orders nodes by id (stars of a small pivot collapse at once), later
    ones by a hash that changes per round, so that chains shrink by a constant factor however ids lie.
    """
    e = space.store(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-e0")
    label = e.select(F.col("a").alias("node")).union(e.select("b")).distinct().select("node", F.col("node").alias("at"))
    r = 0
    while not e.isEmpty():
        key = (lambda c: F.struct(F.col(c).alias("k"), F.col(c).alias("v"))) if r == 0 else (lambda c, r=r: F.struct(F.xxhash64(F.col(c), F.lit(r)).alias("k"), F.col(c).alias("v")))
        both = e.select("a", "b").union(e.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("u")).agg(F.min(key("b")).alias("m"))
        hook = space.store(hook.select("u", F.least(key("u"), F.col("m"))["v"].alias("p")), f"{name}-h{r}")
        up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        jump = space.store(hook.join(up, "p").select("u", F.col("pp").alias("to")), f"{name}-j{r}")
        label = label.join(jump.withColumnRenamed("u", "at"), "at", "left").select("node", F.coalesce("to", "at").alias("at"))
        label = space.store(label, f"{name}-l{r + 1}")
        ja, jb = jump.select(F.col("u").alias("a"), F.col("to").alias("x")), jump.select(F.col("u").alias("b"), F.col("to").alias("y"))
        nxt = e.join(ja, "a").join(jb, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        nxt = space.store(nxt, f"{name}-e{r + 1}")
        for old in (f"{name}-e{r}", f"{name}-h{r}", f"{name}-j{r}", *([f"{name}-l{r}"] if r else [])):
            space.drop(old)
        e, r = nxt, r + 1
    least = label.groupBy("at").agg(F.min("node").alias("component"))
    return label.join(least, "at").select("node", "component")
