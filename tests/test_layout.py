"""Persisted layout: same answers as the derived views, and partition pruning on HostID."""

import tempfile

from grantlens.operators import filesystem as fs
from grantlens.plans import registry as R
from grantlens.sources.catalog import GovernanceCatalog
from grantlens.sources.layout import persist_catalog
from conftest import SF_SMALL


def test_persisted_catalog_answers_and_prunes(spark):
    derived = GovernanceCatalog.for_dir(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="grantlens-layout-")
    persist_catalog(derived, root)
    stored = GovernanceCatalog.from_persisted(spark, root, SF_SMALL)
    assert stored.acl.columns == derived.acl.columns and stored.acl.schema == derived.acl.schema
    for q in (lambda c: fs.resource_access(c, R.SHARE_PATH),
              lambda c: fs.unused_access(c, R.SHARE_PATH, R.DAYS, as_of=R.AS_OF),
              lambda c: fs.trustee_access(c, "DOM10\\Customer#000000026", 1)):
        a, b = q(derived), q(stored)
        assert sorted(a.collect()) == sorted(b.collect())
    df = fs.resource_access(stored, R.SHARE_PATH)
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    acl_scans = [line for line in plan.split("\n") if "/acl" in line and "FileScan" in line]
    assert acl_scans and all("PartitionFilters: [isnotnull(HostID" in s and "(HostID" in s for s in acl_scans), acl_scans
