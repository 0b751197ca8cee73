"""The product of two tables within a key, in cells (operators/product.py), and the trustee batch that uses it."""

from collections import Counter

from minicat import ACL, PRINCIPALS, TRAVERSAL
from pyspark.sql import functions as F

from grantlens.operators import filesystem as fs
from grantlens.operators import product
from grantlens.sources.catalog import GovernanceCatalog


def _small(monkeypatch):
    monkeypatch.setattr(product, "GROUP", 16)
    monkeypatch.setattr(product, "CHUNK", 32)
    monkeypatch.setattr(product, "RUN", 8)


def test_cells_give_the_plain_join(spark, monkeypatch):
    _small(monkeypatch)
    left = spark.createDataFrame([(h, None if i == 3 else f"t{i}", i) for h in (1, 2) for i in range(50)]
                                 + [(None, "t", 99), (7, "alone", 98)], "h int, who string, n long")
    right = spark.createDataFrame([(1, f"p{i}") for i in range(75)] + [(1, "same")] * 40 + [(1, None)] * 3 + [(2, "one"), (None, "p"), (8, "q")],
                                  "h int, path string")
    got = product.cell_product(left, right, ["h"], ["who", "n"]).select("h", "who", "n", "path")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, left.join(right, "h").select("h", "who", "n", "path").collect()))
    assert got.count() == 50 * 118 + 50


def test_cells_of_nothing(spark):
    left = spark.createDataFrame([(1, "a")], "h int, who string")
    right = spark.createDataFrame([(2, "p")], "h int, path string")
    assert product.cell_product(left, right, ["h"], ["who"]).count() == 0


def _one_host(spark, trustees=60, folders=100):
    sids = [(f"S-{i}", f"CORP\\u{i}", "user", f"CN=u{i}", "corp") for i in range(trustees)]
    paths = [(1, 0, i, "H1", "data", f"\\\\H1\\data\\f{i}", 1, 3) for i in range(folders)]
    return GovernanceCatalog(
        spark, None, traversal=spark.createDataFrame(paths, TRAVERSAL), principals=spark.createDataFrame(sids, PRINCIPALS),
        direct_members=spark.createDataFrame([("S-g", "S-0")], "GroupSid string, MemberSid string"),
        acl=spark.createDataFrame([(1, 0, 0, s[0], 1 + n % 2, 0) for n, s in enumerate(sids)], ACL),
        local_trustees=spark.createDataFrame([], "SID string, NTDomain string, NTName string"))


def test_trustees_of_one_host_go_to_many_tasks_and_stay_in_runs(spark, monkeypatch):
    _small(monkeypatch)
    cat = _one_host(spark)
    req = cat.principals.select(F.col("NTAccount").alias("Trustee"))
    rows = fs.trustee_access_batch(cat, req, levels_down=1).withColumn("_task", F.spark_partition_id()).collect()
    assert len(rows) == len({(r.Trustee, r.NetworkPath) for r in rows}) == 60 * 100
    assert {(r.Trustee, r.AllowRightsDescription) for r in rows} == {(f"CORP\\u{i}", "RW"[i % 2]) for i in range(60)}
    assert len({r._task for r in rows}) > 1
    changes = sum(a.Trustee != b.Trustee for a, b in zip(rows, rows[1:]))
    assert changes < len(rows) / 4


def test_batch_of_unknown_trustees_is_empty(spark):
    req = spark.createDataFrame([("CORP\\nobody",)], "Trustee string")
    assert fs.trustee_access_batch(_one_host(spark, 2, 2), req, levels_down=1).count() == 0
