"""The join that deals few long texts to a task gives the rows of the plain join."""

import random

from pyspark.sql import functions as F

from conftest import SF_SMALL
from grantlens.operators import product
from grantlens.sources.catalog import GovernanceCatalog
from test_expand import rows


def tables(spark):
    rng = random.Random(7)
    keys = ["everyone", "a", "b", "c", None]
    left = [(rng.choice(keys[:1] * 8 + keys), i, rng.choice(["", None, "x < y" * 9])) for i in range(300)]
    right = [(rng.choice(keys + ["alone"]), rng.choice((None, 1, 2)), i % 90) for i in range(180)]
    return spark.createDataFrame(left + left[:20], "k string, who int, path string"), spark.createDataFrame(right + right[:9], "k string, m int, r int")


def test_equals_the_plain_join(spark, monkeypatch):
    left, right = tables(spark)
    want = rows(left.join(right, "k"))
    for texts, many, few in ((1024, 32768, 200_000), (10, 7, 200_000), (10, 7, 0)):
        for name, value in (("FEW_TEXTS", texts), ("MANY", many), ("FEW", few)):
            monkeypatch.setattr(product, name, value)
        got = product.text_join(left, right, "k", "path")
        assert got.columns == ["k", "who", "path", "m", "r"] and rows(got) == want and want
    assert not rows(product.text_join(left.limit(0), right, "k", "path"))


def test_a_task_has_few_texts(spark, monkeypatch):
    monkeypatch.setattr(product, "TEXT", 10_000)
    monkeypatch.setattr(product, "FEW_TEXTS", 20)
    left = spark.createDataFrame([("everyone", f"{i:0100}") for i in range(4000)], "k string, path string")
    right = spark.createDataFrame([("everyone", i) for i in range(5)], "k string, r int")
    got = product.text_join(left, right, "k", "path")
    tasks = got.groupBy(F.spark_partition_id()).agg(F.countDistinct("path").alias("n")).collect()
    assert got.count() == 20_000 and max(r["n"] for r in tasks) <= 400


def test_entries_of_the_catalog_come_chain_by_chain(spark, monkeypatch):
    monkeypatch.setattr(product, "TEXT", 500)
    monkeypatch.setattr(product, "FEW_TEXTS", 8)
    c = GovernanceCatalog(spark, SF_SMALL)
    got = c.permission_entries
    tasks = got.groupBy(F.spark_partition_id()).agg(F.countDistinct("SourceTrusteePath").alias("n")).collect()
    assert max(r["n"] for r in tasks) < 0.3 * c.sid_chains.count() and "trustee_names" not in c.__dict__
