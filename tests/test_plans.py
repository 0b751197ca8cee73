"""Plan checks: pushdown reaches the scan, no cartesian products, semi joins kept."""

from grantlens.operators import directory, filesystem as fs
from grantlens.plans import registry as R
from grantlens.sources.catalog import GovernanceCatalog
from conftest import SF_SMALL


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_prefix_like_pushed_to_parquet(spark):
    cat = GovernanceCatalog.for_dir(spark, SF_SMALL)
    df = directory.ad_users(cat.users, sam_account_name_filter="Customer#00000001%")
    p = plan(df)
    assert "StringStartsWith(c_name,Customer#00000001)" in p, p


def test_backslash_like_is_plain_like(spark):
    cat = GovernanceCatalog.for_dir(spark, SF_SMALL)
    df = directory.ad_users(cat.users, nt_account_filter="DOM1\\Customer#%")
    assert df.count() == cat.users.filter("IsDeleted = 0 AND startswith(NTAccount, 'DOM1' || chr(92) || 'Customer#')").count() > 0


def test_trustee_access_has_no_cartesian_product(spark):
    cat = GovernanceCatalog.for_dir(spark, SF_SMALL)
    p = plan(fs.trustee_access(cat, R.TRUSTEE, levels_down=1))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_access_questions_restrict_the_acl_before_the_expansion(spark):
    cat = GovernanceCatalog.for_dir(spark, SF_SMALL)
    for df in (fs.unused_access(cat, R.SHARE_PATH, R.DAYS, as_of=R.AS_OF), fs.resource_access(cat, R.SHARE_PATH)):
        p = df._jdf.queryExecution().optimizedPlan().toString()
        # The semi join on the asked resources stands below the aggregation that precedes the expansion.
        assert "LeftSemi" in p[p.index("bit_or(AllowRights"):]
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_open_shares_join_counts_not_resources(spark):
    cat = GovernanceCatalog.for_dir(spark, SF_SMALL)
    p = fs.open_shares(cat.traversal, cat.fs_exceptions)._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1) AS _n" in p and "_gates" in p


def test_column_pruning_on_wide_view(spark):
    cat = GovernanceCatalog.for_dir(spark, SF_SMALL)
    p = plan(cat.users.select("NTAccount"))
    assert "Join" not in p and "ReadSchema: struct<c_name:string,c_nationkey:int>" in p
