"""GovernanceCatalog: the governance views of one data directory, built lazily.

Every attribute is a DataFrame plan over the driver's parquet tables. The
directory views every access question starts from (membership edges, ACL) are
written once per catalog as Parquet and reused; a question walks membership
from the trustee or path it asks about. Only the questions about the whole
directory build its closure. Everything else is planned lazily per query.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlens.operators import access
from grantlens.operators.closure import group_edges, membership_closure, walk_down, walk_up
from grantlens.operators.content import content_matches
from grantlens.operators.reach import GroupLabels
from grantlens.operators.sets import PrincipalSets
from grantlens.operators.skew import hot_plan, share_for
from grantlens.operators.tree import PathTree
from grantlens.sources import governance as gov
from grantlens.sources.raw import read_table
from grantlens.session import ensure_checkpoint_dir

_CATALOGS: dict[tuple[str, str], tuple[str, "GovernanceCatalog"]] = {}


def snapshot_id(spark: SparkSession, sf_dir: str) -> str:
    """Name, size and modification time of every table file: changes when a new scan lands."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files, out = fs.listFiles(path, True), []
    while files.hasNext():
        f = files.next()
        out.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return "\n".join(sorted(out))


class GovernanceCatalog:
    def __init__(self, spark: SparkSession, sf_dir: str | None = None, **frames: DataFrame):
        self.spark = spark
        self.sf_dir = sf_dir
        # Pre-built frames (e.g. hand-made edge rows in tests) override derivations.
        for name, df in frames.items():
            self.__dict__[name] = df

    @classmethod
    def for_dir(cls, spark: SparkSession, sf_dir: str) -> "GovernanceCatalog":
        """The catalog of a directory, shared by the application's questions. A directory whose files have
        changed gets a new one, so an answer never mixes two snapshots."""
        key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
        now = snapshot_id(spark, sf_dir)
        if key not in _CATALOGS or _CATALOGS[key][0] != now:
            _CATALOGS[key] = (now, cls(spark, sf_dir))
        return _CATALOGS[key][1]

    @classmethod
    def forget(cls, spark: SparkSession, sf_dir: str) -> None:
        """The next question about the directory starts from a new catalog."""
        _CATALOGS.pop((spark.sparkContext.applicationId, sf_dir.rstrip("/")), None)

    def build_shared(self) -> None:
        """Write the views that every access question starts from: the membership edges and the ACL."""
        for name in ("direct_members", "named_edges", "nested_members", "acl"):
            getattr(self, name)

    @classmethod
    def from_persisted(cls, spark: SparkSession, root: str, sf_dir: str | None = None) -> "GovernanceCatalog":
        """A catalog over views written by :func:`grantlens.sources.layout.persist_catalog`.

        Host-partitioned views let single-path questions prune to one host's
        files. Views that were not persisted are derived from ``sf_dir``.
        """
        from grantlens.sources.layout import load_views
        return cls(spark, sf_dir, **load_views(spark, root))

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def materialize(self, df: DataFrame, name: str) -> DataFrame:
        """Write a shared view once, as Parquet in the folder of ``spark.checkpoint.dir``, and read it back.

        These are the tables a scanner would have filled: membership edges,
        the ACL, trustee -> principal names. Questions read the columns and
        row groups they need; lineage ends at the files, so executor loss
        re-reads them. The files go when the application ends.
        """
        where = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/view-{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(where)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        return self.spark.read.schema(df.schema).parquet(where)

    # -- file system --------------------------------------------------------
    @cached_property
    def traversal(self) -> DataFrame:
        return gov.traversal(self.raw("part"), self.raw("nation"))

    @cached_property
    def path_tree(self) -> PathTree:
        """Interval labels of all shares, for questions about many of them."""
        return PathTree(self.traversal, self.traversal.filter("NestedLevel = 0"), self.materialize)

    @cached_property
    def acl(self) -> DataFrame:
        # Written once: every access question starts from it, and deriving it
        # repeats a lineitem scan and an orders join per question.
        # In order of the resource, so one resource's entries lie in few row groups.
        acl = gov.acl(self.raw("lineitem"), self.raw("orders"), self.raw("nation"))
        order = ["HostID", "GateID", "ResourceID"]
        return self.materialize(acl.repartitionByRange(*order).sortWithinPartitions(*order), "acl")

    @cached_property
    def fs_exceptions(self) -> DataFrame:
        return gov.fs_exceptions(self.raw("lineitem"), self.raw("nation"))

    @cached_property
    def daily_activity(self) -> DataFrame:
        return gov.daily_activity(self.raw("events"), self.users, self.raw("nation"), self.raw("part"))

    @cached_property
    def content_matches(self) -> DataFrame:
        return content_matches(self.raw("documents"), gov.resource_count(self.raw("part")))

    @cached_property
    def job_stats(self) -> DataFrame:
        return gov.job_stats(self.raw("orders"))

    @cached_property
    def shadow_access(self) -> DataFrame:
        return gov.shadow_access(self.acl)

    # -- directory ----------------------------------------------------------
    @cached_property
    def users(self) -> DataFrame:
        return gov.users(self.raw("customer"), self.raw("orders"))

    @cached_property
    def direct_members(self) -> DataFrame:
        return self.materialize(gov.direct_members(self.raw("lineitem"), self.raw("orders"), self.raw("supplier")), "members")

    @cached_property
    def named_edges(self) -> DataFrame:
        """(GroupSid, MemberSid, GroupName): the direct memberships with the group's name (its SID if it has none)."""
        names = self.principals.select(F.col("ObjectSid").alias("GroupSid"), "NTAccount")
        names = names.groupBy("GroupSid").agg(F.min("NTAccount").alias("NTAccount"))
        named = self.direct_members.join(names, "GroupSid", "left")
        return self.materialize(named.select("GroupSid", "MemberSid", F.coalesce("NTAccount", "GroupSid").alias("GroupName")), "edges")

    @cached_property
    def nested_members(self) -> DataFrame:
        """The memberships of groups in groups."""
        return self.materialize(group_edges(self.direct_members), "nested")

    @cached_property
    def groups(self) -> DataFrame:
        return gov.groups(self.raw("supplier"), self.direct_members)

    @cached_property
    def computers(self) -> DataFrame:
        return gov.computers(self.raw("part"))

    @cached_property
    def principals(self) -> DataFrame:
        # Lazy on purpose: only name/SID columns are used, so Catalyst prunes
        # the logon-span and member-count joins and this is two dimension scans.
        return gov.principals(self.users, self.groups)

    @cached_property
    def local_trustees(self) -> DataFrame:
        return gov.local_trustees(self.raw("supplier"))

    @cached_property
    def closure(self) -> DataFrame:
        share = share_for(int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return membership_closure(self.direct_members, min_share=share)

    @cached_property
    def group_labels(self) -> GroupLabels:
        """Numbers and intervals of the groups, for yes-or-no questions about membership."""
        return GroupLabels(self.direct_members, self.nested_members)

    @cached_property
    def ad_permissions(self) -> DataFrame:
        return gov.ad_permissions(self.raw("lineitem"), self.raw("supplier"))

    @cached_property
    def ad_exceptions(self) -> DataFrame:
        return gov.ad_exceptions(self.raw("supplier"), self.groups)

    @cached_property
    def ca_rights(self) -> DataFrame:
        return gov.ca_rights(self.raw("supplier"))

    @cached_property
    def certificate_vulnerabilities(self) -> DataFrame:
        return gov.certificate_vulnerabilities(self.raw("supplier"))

    @cached_property
    def security_assessment(self) -> DataFrame:
        return gov.security_assessment(self.raw("part"))

    @cached_property
    def dc_summary(self) -> DataFrame:
        return gov.dc_summary(self.raw("nation"), self.raw("region"))

    # -- access (derived from ACL x closure) ---------------------------------
    @cached_property
    def sids(self) -> DataFrame:
        """Every SID that can appear as a trustee: principals and local accounts."""
        loc = self.local_trustees.selectExpr("SID AS ObjectSid")
        return self.principals.select("ObjectSid").union(loc).distinct()

    @cached_property
    def sid_holders(self) -> DataFrame:
        return access.holders(self.closure, self.sids)

    @cached_property
    def trustee_names(self) -> DataFrame:
        return self.materialize(access.trustee_names(self.closure, self.principals), "names")

    def chains_of(self, sids: DataFrame) -> DataFrame:
        """(HolderSid, Sid, Depth, Path) of some SIDs (column sid): themselves and the groups holding them."""
        names = self.principals.select(F.col("ObjectSid").alias("sid"), "NTAccount")
        seeds = sids.join(names, "sid", "left").select(F.col("sid").alias("Sid"), F.coalesce("NTAccount", "sid").alias("Path"))
        return walk_up(self.named_edges, seeds)

    @cached_property
    def sid_chains(self) -> DataFrame:
        """The chains of every SID."""
        return self.materialize(self.chains_of(self.sids.select(F.col("ObjectSid").alias("sid"))), "chains")

    @cached_property
    def hot_holders(self) -> dict:
        """Salt plan for joins of trustee SIDs (membership side) with the ACL.

        Hot SIDs are found on both sides: a group reaching a third of all
        principals, or a trustee on a third of all ACL entries. Per SID the
        larger side is split, the smaller replicated (see skew.hot_plan).
        """
        share = share_for(int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return hot_plan(self.trustee_names, self.acl.select("TrusteeSid"), "TrusteeSid", min_share=share)

    @cached_property
    def effective_access(self) -> DataFrame:
        return access.effective_access_everywhere(self.acl, self.trustee_names, self.hot_holders)

    @cached_property
    def principal_sets(self) -> PrincipalSets:
        """The principals behind every trustee, as bitmaps."""
        return PrincipalSets(self.trustee_names, self.materialize)

    def effective_access_for(self, acl_subset: DataFrame) -> DataFrame:
        """Effective access on some ACL entries: membership is walked down from their trustees only."""
        holders = acl_subset.select(F.col("TrusteeSid").alias("HolderSid")).distinct()
        members = walk_down(self.direct_members, self.nested_members, holders)
        names = self.principals.select(F.col("ObjectSid").alias("MemberSid"), F.col("NTAccount").alias("TrusteeNTStyleName"))
        reached = members.join(names, "MemberSid").select(F.col("HolderSid").alias("TrusteeSid"), "TrusteeNTStyleName")
        return access.effective_access(acl_subset, reached, {})

    @cached_property
    def trustee_share_access(self) -> DataFrame:
        return access.trustee_share_access(self.acl, self.sid_holders, self.hot_holders)

    @cached_property
    def permission_entries(self) -> DataFrame:
        return access.permission_entries(self.acl, self.sid_chains, self.traversal)
