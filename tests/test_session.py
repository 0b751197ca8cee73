"""Checkpoint-directory policy and parameter binding."""

import pytest

from grantlens.operators import checks
from grantlens.session import ensure_checkpoint_dir


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" else default


class _SC:
    def __init__(self, master, configured=None):
        self.master, self._conf, self.dir = master, _Conf(configured), None

    def getCheckpointDir(self):
        return self.dir

    def getConf(self):
        return self._conf

    def setCheckpointDir(self, d):
        self.dir = d


class _Spark:
    def __init__(self, sc):
        self.sparkContext = sc


def test_cluster_without_shared_checkpoint_dir_is_refused():
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Spark(_SC("spark://cluster:7077")))


def test_configured_checkpoint_dir_is_used():
    sc = _SC("yarn", configured="hdfs:///shared/ckpt")
    assert ensure_checkpoint_dir(_Spark(sc)) == "hdfs:///shared/ckpt"


def test_local_mode_gets_a_scratch_dir():
    sc = _SC("local[2]")
    assert ensure_checkpoint_dir(_Spark(sc)).startswith("/")


def test_named_parameters_are_bound(spark):
    spark.range(10).createOrReplaceTempView("t_named")
    df = checks.run_sql(spark, "SELECT count(*) AS n FROM t_named WHERE id BETWEEN :lo AND :hi", {"lo": 2, "hi": 4})
    assert df.collect()[0].n == 3
