
import pytest
from pyspark.sql import functions as F

from grantlens.operators import checks, filesystem as fs
from minicat import FOLDER, SHARE, TRAVERSAL, mini_catalog


def test_f3_host_wide_rights_vs_per_resource(spark):
    cat = mini_catalog(spark)
    wide = {r.NetworkPath: r.AllowRightsDescription for r in fs.trustee_access(cat, "CORP\\staff", 1).collect()}
    per = {r.NetworkPath: r.AllowRightsDescription
           for r in fs.trustee_access(cat, "CORP\\staff", 1, per_resource=True).collect()}
    assert set(wide.values()) == {"RWLA"}                      # behaviour 3: host/gate-wide OR
    assert per == {FOLDER: "L", "\\\\H1\\data2\\g": "A"}       # option: the folder's own entries


def test_f3_level_is_equality_and_folders_only(spark):
    cat = mini_catalog(spark)
    assert fs.trustee_access(cat, "CORP\\staff", 0).count() == 0   # behaviour 4: level 0 rows are shares (type 2)
    assert fs.trustee_access(cat, "CORP\\staff", 2).count() == 0


def test_f1_ignores_gate(spark):
    trav = spark.createDataFrame([(1, 0, 1, "H1", "data", SHARE, 0, 2), (1, 9, 1, "H1", "data", SHARE, 0, 2)],
                                 TRAVERSAL)
    matches = spark.createDataFrame([(1, 1, 1, "Email", 3)],
                                    "DocumentID long, HostID int, ParentResourceID long, CriteriaName string, MatchCount long")
    got = fs.sensitive_data(matches, trav).collect()
    assert [(r.HostName, r.ShareName, r.CriteriaName, r.TotalMatches) for r in got] == [("H1", "data", "Email", 6)]


def test_f6_share_root_only_and_path_normalised(spark):
    cat = mini_catalog(spark)
    assert fs.unused_access(cat, FOLDER, 10).count() == 0              # behaviour 7
    a = fs.resource_access(cat, "//H1/data/").collect()                 # behaviour 9
    b = fs.resource_access(cat, SHARE).collect()
    assert sorted(a) == sorted(b) and a


def test_sql_runs_queries_only(spark):
    spark.range(3).createOrReplaceTempView("t_parity")
    assert checks.run_sql(spark, "SELECT count(*) AS n FROM t_parity WHERE id >= ?", [1]).collect()[0].n == 2
    with pytest.raises(ValueError):
        checks.run_sql(spark, "DROP VIEW t_parity")
    assert spark.catalog.tableExists("t_parity")
    for text in ("INSERT INTO t_parity SELECT 1", "INSERT OVERWRITE t_parity SELECT 1", "WITH x AS (SELECT 1) INSERT INTO t_parity SELECT * FROM x",
                 "FROM t_parity INSERT INTO a SELECT id INSERT INTO b SELECT id",
                 "INSERT OVERWRITE DIRECTORY '/tmp/never' USING parquet SELECT 1", "SET x = 1", "CREATE TABLE z AS SELECT 1"):
        with pytest.raises(ValueError):
            checks.run_sql(spark, text)
    with pytest.raises(ValueError):
        checks.run_sql(object(), "SELECT 1")  # the parser cannot be asked


def test_composite_foreign_key(spark):
    child = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, None)], "x int, y string")
    parent = spark.createDataFrame([(1, "a"), (2, "b")], "p int, q string")
    r = checks.foreign_key_check(child, "c", ["x", "y"], parent, "p", ["p", "q"]).head()
    assert (r.child_column, r.child_rows, r.orphan_rows, r.orphan_keys, r.is_valid) == ("x,y", 3, 2, 1, False)


def test_schema_tool_name_check(spark):
    with pytest.raises(ValueError):
        checks.column_profile(spark.range(1), "bad-name;drop")
    prof = checks.column_profile(spark.range(5).withColumn("s", F.lit(None).cast("string")), "t_1").collect()
    assert [(r.column_name, r.null_count, r.distinct_count) for r in prof] == [("id", 0, 5), ("s", 5, 0)]
