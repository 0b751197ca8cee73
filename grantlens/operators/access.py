"""G-3, G-4, G-5: who holds which rights, built from ACL x membership.

Plan shape for every operator here:

1. pre-aggregate the ACL to one row per (resource, trustee) with ``bit_or``
   (map-side partial aggregation collapses duplicate entries before the
   shuffle);
2. expand trustees to the principals that hold them (self plus every
   transitive member from the closure) with a salted join, so a group that
   holds a third of all members does not land in one task;
3. aggregate again per (resource, principal).

When the caller asks about one path or one trustee, the ACL is restricted
to that resource or those SIDs *before* step 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.functions.rights import effective_allow, mask_text, rights_letters
from grantlens.operators.expand import expanded
from grantlens.operators.product import text_join
from grantlens.operators.skew import skew_join

RESOURCE_KEYS = ["HostID", "GateID", "ResourceID"]


def holders(closure: DataFrame, sids: DataFrame) -> DataFrame:
    """(HolderSid, MemberSid): each SID holds itself; a group holds its transitive members."""
    nested = closure.filter("GroupSid <> MemberSid").select(F.col("GroupSid").alias("HolderSid"), "MemberSid")
    self_pairs = sids.select(F.col("ObjectSid").alias("HolderSid"), F.col("ObjectSid").alias("MemberSid"))
    return nested.unionByName(self_pairs)


def trustee_names(closure: DataFrame, principals: DataFrame) -> DataFrame:
    """(TrusteeSid, TrusteeNTStyleName): the principals reached through each trustee SID."""
    names = principals.select(F.col("ObjectSid").alias("MemberSid"), F.col("NTAccount").alias("TrusteeNTStyleName"))
    return holders(closure, principals).join(names, "MemberSid") \
        .select(F.col("HolderSid").alias("TrusteeSid"), "TrusteeNTStyleName")


def aggregate_acl(acl: DataFrame, keys: list[str]) -> DataFrame:
    return acl.groupBy(*keys).agg(F.bit_or("AllowRights").alias("AllowRights"),
                                  F.bit_or("DenyRights").alias("DenyRights"))


def _decoded(allow: Column, deny: Column) -> list[Column]:
    eff = effective_allow(allow, deny)
    return [eff.alias("AllowRights"), deny.alias("DenyRights"),
            rights_letters(eff).alias("AllowRightsDescription"), rights_letters(deny).alias("DenyRightsDescription")]


def effective_access(acl: DataFrame, names: DataFrame, plan: dict) -> DataFrame:
    """G-5: (HostID, GateID, ResourceID, TrusteeNTStyleName, AllowRights, DenyRights, descriptions).

    ``names`` is :func:`trustee_names`; ``plan`` splits its hot TrusteeSids (skew.hot_plan).
    Allow is the OR of all reaching allows minus the OR of all denies.
    """
    # Pre-aggregate with map-side combine, then the salted expansion.
    per_trustee = aggregate_acl(acl, RESOURCE_KEYS + ["TrusteeSid"])
    reached = skew_join(names, per_trustee, "TrusteeSid", plan)
    eav = reached.groupBy(*RESOURCE_KEYS, "TrusteeNTStyleName").agg(
        F.bit_or("AllowRights").alias("_a"), F.bit_or("DenyRights").alias("_d"))
    return eav.select(*RESOURCE_KEYS, "TrusteeNTStyleName", *_decoded(F.col("_a"), F.col("_d")))


def effective_access_everywhere(acl: DataFrame, names: DataFrame, plan: dict) -> DataFrame:
    """:func:`effective_access` for the whole ACL: the expanded rows are OR-ed where they are made, not shuffled (see expand.py)."""
    eav = expanded(acl, names, RESOURCE_KEYS, plan)
    return eav.select(*RESOURCE_KEYS, "TrusteeNTStyleName", *_decoded(F.col("_a"), F.col("_d")))


def trustee_share_access(acl: DataFrame, sid_holders: DataFrame, plan: dict) -> DataFrame:
    """G-3: host/gate-wide rights per SID (HostID, GateID, Sid, HOST, AllowRights, DenyRights).

    ``sid_holders`` is (HolderSid, MemberSid) from :func:`holders`: the entries
    of the SID itself and of every group holding it count; masks are OR-ed.
    """
    per_trustee = aggregate_acl(acl, ["HostID", "GateID", "TrusteeSid"]) \
        .withColumnRenamed("TrusteeSid", "HolderSid")
    held = skew_join(sid_holders, per_trustee, "HolderSid", plan)
    out = held.groupBy("HostID", "GateID", F.col("MemberSid").alias("Sid")).agg(
        F.bit_or("AllowRights").alias("AllowRights"), F.bit_or("DenyRights").alias("DenyRights"))
    return out.select("HostID", "GateID", "Sid", F.col("HostID").alias("HOST"), "AllowRights", "DenyRights")


def trustee_sids_batch(principals: DataFrame, local_trustees: DataFrame, requests: DataFrame,
                       ignore_case: bool = False) -> DataFrame:
    """(Trustee, sid) for a DataFrame of trustee names (column ``Trustee``): directory and host-local SIDs."""
    fold = F.lower if ignore_case else (lambda c: c)
    d = principals.select(fold(F.col("NTAccount")).alias("_name"), F.col("ObjectSid").alias("sid"))
    loc = local_trustees.select(fold(F.concat(F.col("NTDomain"), F.lit("\\"), F.col("NTName"))).alias("_name"),
                                F.col("SID").alias("sid"))
    asked = requests.select("Trustee").distinct().withColumn("_name", fold(F.col("Trustee")))
    return asked.join(d.union(loc), "_name").select("Trustee", "sid").distinct()


def permission_entries(acl: DataFrame, sid_chains: DataFrame, traversal: DataFrame) -> DataFrame:
    """G-4: one row per ACL entry that reaches a SID, with where it comes from.

    Columns: HostID, GateID, ResourceID, Sid, SourceTrusteePath (the chain of
    names from the SID to the entry's trustee, see closure.walk_up),
    ResourcePath, PermissionSourceType (Direct / Group), the allow and deny
    letters and their masks as text. Paths are joined to the entries before the
    expansion over membership (``sid_chains``: HolderSid, Sid, Path); entries
    travel with their masks, the texts are written after it. A task gets few
    chains, so that a file can hold each one's text once.
    """
    paths = traversal.select(*RESOURCE_KEYS, F.col("NetworkPath").alias("ResourcePath"))
    entries = acl.withColumnRenamed("TrusteeSid", "HolderSid").join(paths, RESOURCE_KEYS).select(
        *RESOURCE_KEYS, "HolderSid", "ResourcePath", "AllowRights", "DenyRights")
    reach = text_join(sid_chains.select("HolderSid", "Sid", "Path"), entries, "HolderSid", "Path")
    return reach.select("*", *permission_texts()).select(*RESOURCE_KEYS, "Sid", *permission_columns())


def permission_texts() -> list[Column]:
    """The letters and mask texts of an ACL entry."""
    return [f(c).alias(f"{kind}{what}Description") for kind, c in (("Allow", "AllowRights"), ("Deny", "DenyRights"))
            for what, f in (("Rights", rights_letters), ("Mask", mask_text))]


def permission_columns() -> list[Column]:
    """The answer's columns from an entry that reached (HolderSid, Sid, Path)."""
    kind = F.when(F.col("HolderSid") == F.col("Sid"), F.lit("Direct")).otherwise(F.lit("Group"))
    return [F.col("Path").alias("SourceTrusteePath"), F.col("ResourcePath"), kind.alias("PermissionSourceType"),
            *(F.col(f"{k}{w}Description") for k in ("Allow", "Deny") for w in ("Rights", "Mask"))]
