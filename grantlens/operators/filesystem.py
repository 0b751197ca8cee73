"""F-1..F-9: file-share questions over the governance views.

Each single-path / single-trustee operator has a batch form taking a
DataFrame of requests, so one job answers many (the request key becomes an
extra column). Single calls are the batch form with one request: paths and
trustees stay DataFrames, and AQE sizes the joins at run time; nothing is
collected while a plan is built. Requests are read the same way in both
forms: paths are normalised (``//server/share/`` is ``\\\\server\\share``) and
malformed trustees or paths match nothing in a batch, where a single call
raises.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.functions.rights import rights_letters
from grantlens.functions.validate import (check_non_negative, check_positive, check_trustee, normalize_unc,
                                          normalized_unc)
from grantlens.operators import access
from grantlens.operators.prefix import prefix_join
from grantlens.operators.product import cell_product
from grantlens.operators.skew import hot_plan, share_for, skew_join
from grantlens.operators.tree import PathTree

RESOURCE_KEYS = access.RESOURCE_KEYS


def _restrict(df: DataFrame, keys_df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of ``df`` whose ``cols`` appear in ``keys_df``."""
    return df.join(keys_df.select(*cols).distinct(), cols, "left_semi")


def _folded(col: Column, ignore_case: bool) -> Column:
    return F.lower(col) if ignore_case else col


# -- F-1 ---------------------------------------------------------------------
def sensitive_data(matches: DataFrame, traversal: DataFrame) -> DataFrame:
    """Discover-SensitiveData: total matches per (HostName, ShareName, CriteriaName).

    Matches are first summed per (host, resource, criterion): the sum is
    associative and the join key is kept, so pre-aggregating before the
    join gives the same totals with far fewer rows to shuffle. GateID is not
    part of the join key (reference behaviour).
    """
    per_resource = matches.groupBy("HostID", F.col("ParentResourceID").alias("ResourceID"), "CriteriaName") \
        .agg(F.sum("MatchCount").alias("_m"))
    named = traversal.select("HostID", "ResourceID", "HostName", "ShareName") \
        .filter(F.col("HostName").isNotNull() & F.col("ShareName").isNotNull())
    joined = per_resource.join(named, ["HostID", "ResourceID"])
    return joined.groupBy("HostName", "ShareName", "CriteriaName") \
        .agg(F.sum("_m").cast("bigint").alias("TotalMatches")) \
        .orderBy(F.desc("TotalMatches"))


# -- F-2 ---------------------------------------------------------------------
def open_shares(traversal: DataFrame, exceptions: DataFrame, within_share: bool = False,
                tree: PathTree | None = None) -> DataFrame:
    """Get-OpenShares: per share path, the distinct flagged resources (ParentType 1).

    Default keeps the reference's host/gate-wide count; ``within_share``
    counts only resources whose path lies strictly below the share.
    Flagged resources are counted once per (host, gate); a share path on one
    host/gate takes that count. Only paths that several host/gates have need
    the distinct over their resources. With ``tree`` (the interval labels of
    the traversal's shares) containment compares numbers instead of paths.
    """
    shares = traversal.filter((F.col("NestedLevel") == 0) & (F.col("ResourceType") == 2)) \
        .select("NetworkPath", "HostID", "GateID").distinct()
    flagged = exceptions.filter(F.col("ParentType") == 1).select(*RESOURCE_KEYS).distinct()
    if within_share and tree is not None:
        j = tree.inside("below", flagged, shares)
        counts = j.groupBy("NetworkPath").agg(F.countDistinct("ResourceID").alias("_n"))
    elif within_share:
        # containment as an equi-join on path cuts (see prefix.py), then drop the share root itself
        paths = traversal.select(*RESOURCE_KEYS, F.col("NetworkPath").alias("_rp"))
        j = prefix_join(flagged.join(paths, RESOURCE_KEYS), "_rp", shares, "NetworkPath", ["HostID", "GateID"],
                        strict=True).filter(F.col("_rp") != F.col("NetworkPath"))
        counts = j.groupBy("NetworkPath").agg(F.countDistinct("ResourceID").alias("_n"))
    else:
        gates = shares.groupBy("NetworkPath").agg(F.count(F.lit(1)).alias("_gates"))
        shares = shares.join(gates, "NetworkPath")
        per_gate = flagged.groupBy("HostID", "GateID").agg(F.count(F.lit(1)).alias("_n"))
        one = shares.filter("_gates = 1").join(per_gate, ["HostID", "GateID"]).select("NetworkPath", "_n")
        several = shares.filter("_gates > 1").join(flagged, ["HostID", "GateID"]) \
            .groupBy("NetworkPath").agg(F.countDistinct("ResourceID").alias("_n"))
        counts = one.unionByName(several)
    return counts.select(F.col("NetworkPath").alias("SharePath"), F.col("_n").alias("ExceptionFolderCountInShare")) \
        .orderBy("SharePath")


# -- F-3 ---------------------------------------------------------------------
def _sid_pairs(cat, sids: DataFrame) -> DataFrame:
    """(HolderSid, sid, Path [, Trustee]): each asked SID with itself and every group holding it.

    The walk starts from the asked SIDs; the rest of the directory is not closed.
    """
    extra = [c for c in sids.columns if c != "sid"]
    walked = cat.chains_of(sids.select("sid").distinct())
    return walked.withColumnRenamed("Sid", "sid").join(sids.select("sid", *extra), "sid") \
        .select("HolderSid", "sid", "Path", *extra)


def _letters(allow: Column, deny: Column) -> list[Column]:
    return [rights_letters(allow).alias("AllowRightsDescription"), rights_letters(deny).alias("DenyRightsDescription")]


def trustee_access_batch(cat, requests: DataFrame, levels_down: int = 0, per_resource: bool = False,
                         salt_holders: bool = True, ignore_case: bool = False) -> DataFrame:
    """Get-TrusteeAccess for a DataFrame of trustee names (column ``Trustee``).

    Rewrites the reference's CROSS JOIN + per-row function as an equi-join
    on (HostID, GateID): rights are OR-ed host/gate-wide over the trustee's
    own entries and those of every group holding it, then attached to each
    folder at the requested level (ResourceType 3). ``per_resource`` joins
    on ResourceID too instead of spreading host/gate-wide rights.
    """
    check_non_negative(levels_down, "levels_down")
    sids = access.trustee_sids_batch(cat.principals, cat.local_trustees, requests, ignore_case)
    pairs = _sid_pairs(cat, sids)
    keys = ["HostID", "GateID"] + (["ResourceID"] if per_resource else [])
    acl = cat.acl.withColumnRenamed("TrusteeSid", "HolderSid")
    if salt_holders:
        # Many trustees: fold each holder's entries to one mask per host/gate (or
        # resource) first, so a group inherited by every trustee multiplies by
        # its host/gates, not its raw entry count; and salt such groups.
        acl = acl.join(pairs.select("HolderSid").distinct(), "HolderSid", "left_semi")  # only reached holders
        acl = access.aggregate_acl(acl, ["HolderSid", *keys])
        share = share_for(int(cat.spark.conf.get("spark.sql.shuffle.partitions")))
        reach = skew_join(pairs, acl, "HolderSid", hot_plan(pairs, acl.select("HolderSid"), "HolderSid", min_share=share))
    else:
        # One trustee: its few pairs (broadcast by AQE) cut the ACL first; only
        # the reached entries are aggregated, never the whole ACL.
        reach = acl.join(pairs, "HolderSid")
    share = reach.groupBy("Trustee", "sid", *keys).agg(F.bit_or("AllowRights").alias("_a"), F.bit_or("DenyRights").alias("_d"))
    share = share.select("Trustee", "sid", *keys, *_letters(F.col("_a"), F.col("_d")))
    folders = cat.traversal.filter((F.col("NestedLevel") == levels_down) & (F.col("ResourceType") == 3)) \
        .select(*keys, "NetworkPath")
    if salt_holders and not per_resource:
        # Many trustees with all folders of their host/gates: a product, in cells.
        answer = cell_product(cat.materialize(share, "shares"), folders, keys, ["Trustee", "sid"])
    else:
        answer = folders.join(share, keys)
    return answer.select("Trustee", F.lit("FileSystem").alias("DataSource"), "NetworkPath",
                         "AllowRightsDescription", "DenyRightsDescription")


def trustee_access(cat, trustee: str, levels_down: int = 0, per_resource: bool = False,
                   ignore_case: bool = False) -> DataFrame:
    """Get-TrusteeAccess for one ``Domain\\Name`` (columns as the reference)."""
    check_trustee(trustee)
    req = cat.spark.createDataFrame([(trustee,)], "Trustee string")
    # One trustee's SID pairs are its groups: small, and AQE's runtime size
    # check broadcasts them.
    return trustee_access_batch(cat, req, levels_down, per_resource, salt_holders=False,
                                ignore_case=ignore_case).drop("Trustee")


# -- lookups -----------------------------------------------------------------
def path_lookup(traversal: DataFrame, path: str, ignore_case: bool = False) -> DataFrame:
    """G-2: traversal rows of one UNC path (HostID, GateID, ResourceID, NestedLevel, ...)."""
    want = normalize_unc(path)
    return traversal.filter(_folded(F.col("NetworkPath"), ignore_case) == _folded(F.lit(want), ignore_case))


def path_lookup_batch(traversal: DataFrame, requests: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Traversal rows for a DataFrame of paths (column ``Path``, read as :func:`normalize_unc` reads one)."""
    asked = requests.select("Path").distinct().withColumn("_p", _folded(normalized_unc("Path"), ignore_case))
    rows = traversal.withColumn("_p", _folded(F.col("NetworkPath"), ignore_case))
    return asked.join(rows, "_p").drop("_p")


# -- F-5 ---------------------------------------------------------------------
def resource_access_batch(cat, lookup: DataFrame) -> DataFrame:
    """Get-ResourceAccess for the looked-up resources (``lookup`` has Path, NetworkPath + keys).

    The ACL is cut to those resources before it is expanded over membership.
    """
    asked = lookup.select("Path", F.col("NetworkPath").alias("FolderFullPath"), *RESOURCE_KEYS)
    reached = cat.effective_access_for(_restrict(cat.acl, lookup, RESOURCE_KEYS))
    return asked.join(reached, RESOURCE_KEYS).filter(F.col("TrusteeNTStyleName").isNotNull()) \
        .select("Path", "FolderFullPath", "TrusteeNTStyleName", "AllowRightsDescription", "DenyRightsDescription")


def resource_access(cat, resource_path: str, ignore_case: bool = False, explain_empty: bool = False) -> DataFrame:
    lookup = path_lookup(cat.traversal, resource_path, ignore_case).withColumn("Path", F.col("NetworkPath"))
    answer = resource_access_batch(cat, lookup).drop("Path")
    if explain_empty:
        return with_reason(cat, answer, resource_path, None, ignore_case)
    return answer.orderBy("TrusteeNTStyleName")


# -- F-4 ---------------------------------------------------------------------
def permission_source_batch(cat, requests: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Get-TrusteePermissionSource for (Trustee, Path) requests.

    The reference joins lookup x trustee SIDs on a constant; here both are
    keyed by the request, so the join is an equi-join on the request id.
    Membership is walked from the asked trustees only; SourceTrusteePath is
    the chain of names from the trustee to the entry's group.
    """
    req = requests.select("Trustee", "Path").distinct()
    lookup = path_lookup_batch(cat.traversal, req, ignore_case) \
        .select("Path", F.col("NetworkPath").alias("ResourcePath"), *RESOURCE_KEYS)
    pairs = _sid_pairs(cat, access.trustee_sids_batch(cat.principals, cat.local_trustees, req, ignore_case))
    entries = _restrict(cat.acl.withColumnRenamed("TrusteeSid", "HolderSid"), lookup, RESOURCE_KEYS) \
        .join(lookup, RESOURCE_KEYS).join(req, "Path") \
        .select("Trustee", "Path", "HolderSid", "ResourcePath", *access.permission_texts())
    asked = pairs.select("Trustee", "HolderSid", F.col("sid").alias("Sid"), F.col("Path").alias("_chain"))
    r = entries.withColumnRenamed("Path", "_asked").join(asked, ["Trustee", "HolderSid"])
    return r.withColumnRenamed("_chain", "Path").select("Trustee", F.col("_asked").alias("AskedPath"), *access.permission_columns()) \
        .withColumnRenamed("AskedPath", "Path")


def permission_source(cat, trustee: str, resource_path: str, ignore_case: bool = False,
                      explain_empty: bool = False) -> DataFrame:
    check_trustee(trustee)
    path = normalize_unc(resource_path)
    req = cat.spark.createDataFrame([(trustee, path)], "Trustee string, Path string")
    answer = permission_source_batch(cat, req, ignore_case).drop("Trustee", "Path")
    return with_reason(cat, answer, path, trustee, ignore_case) if explain_empty else answer


# -- F-6 ---------------------------------------------------------------------
def _as_of_literal(as_of: datetime | str | None) -> Column:
    if as_of is None:
        as_of = datetime.now(timezone.utc).replace(tzinfo=None)
    text = as_of.isoformat(sep=" ") if isinstance(as_of, datetime) else str(as_of)
    return F.lit(text).cast("timestamp_ntz")


def unused_access_batch(cat, shares: DataFrame, days_inactive: int = 90, as_of=None,
                        strict_prefix: bool = False, tree: PathTree | None = None) -> DataFrame:
    """Get-UnusedAccess for target share rows (``shares``: Path + traversal columns).

    ``tree``: interval labels that cover these shares (``cat.path_tree`` has all
    share roots); without it folder paths are cut at the shares' lengths.

    LastActivity: activity on the share's host/gate whose folder path starts
    with the share path (no separator unless ``strict_prefix``; the reference
    lets ``\\\\h\\data`` claim ``\\\\h\\data2``), MAX(ActivityDate) per user.
    Access: effective access on the share root, users only (groups dropped,
    deleted users kept), last activity NULL or strictly before
    ``as_of - days_inactive``.
    """
    check_positive(days_inactive, "days_inactive")
    cutoff = _as_of_literal(as_of) - F.make_dt_interval(F.lit(days_inactive))
    roots = shares.select("Path", *RESOURCE_KEYS, "HostName", "ShareName", F.col("NetworkPath").alias("SharePath"))

    # Which folders lie in which share is settled on the traversal alone, once;
    # activity then meets it on the folder's own key.
    host_keys = ["HostID", "GateID"]
    if tree is None:
        folders = _restrict(cat.traversal.select(*host_keys, F.col("ResourceID").alias("FolderID"),
                                                 F.col("NetworkPath").alias("FolderPath")), roots, host_keys)
        inside = prefix_join(folders, "FolderPath", roots.select("Path", *host_keys, "SharePath"), "SharePath", host_keys,
                             strict=strict_prefix)
    else:
        asked = roots.select("Path", *host_keys, F.col("SharePath").alias("NetworkPath")).distinct()
        inside = tree.inside("strict" if strict_prefix else "prefix", shares=asked).withColumnRenamed("ResourceID", "FolderID")
    inside = inside.select("Path", *host_keys, "FolderID").distinct()
    # Only the last day per (folder, user) matters: fold the daily rows first
    # (partial aggregation, no hot-user rows in the join).
    act = cat.daily_activity.groupBy(*host_keys, "FolderID", "UserNTStyleName") \
        .agg(F.max("ActivityDate").alias("ActivityDate"))
    last = act.join(inside, [*host_keys, "FolderID"]) \
        .groupBy("Path", *host_keys, F.col("UserNTStyleName").alias("TrusteeNTStyleName")) \
        .agg(F.max("ActivityDate").alias("LastActivityDate"))

    reached = cat.effective_access_for(_restrict(cat.acl, roots, RESOURCE_KEYS))
    users = cat.users.select(F.col("NTAccount").alias("TrusteeNTStyleName"))
    res = roots.join(reached, RESOURCE_KEYS) \
        .join(last, ["Path", *host_keys, "TrusteeNTStyleName"], "left") \
        .join(users, "TrusteeNTStyleName", "left_semi") \
        .filter(F.col("LastActivityDate").isNull() | (F.col("LastActivityDate") < cutoff))
    return res.select("Path", "HostName", "ShareName", "TrusteeNTStyleName", "AllowRightsDescription",
                      "DenyRightsDescription", "LastActivityDate")


def share_roots(traversal: DataFrame, path: str | None = None, ignore_case: bool = False) -> DataFrame:
    """Target shares: lookup rows at NestedLevel 0 (all share roots when no path)."""
    t = traversal if path is None else path_lookup(traversal, path, ignore_case)
    return t.filter(F.col("NestedLevel") == 0).withColumn("Path", F.col("NetworkPath"))


def unused_access(cat, resource_path: str, days_inactive: int = 90, as_of=None, strict_prefix: bool = False,
                  ignore_case: bool = False, explain_empty: bool = False) -> DataFrame:
    check_positive(days_inactive, "days_inactive")
    shares = share_roots(cat.traversal, resource_path, ignore_case)
    answer = unused_access_batch(cat, shares, days_inactive, as_of, strict_prefix).drop("Path")
    if explain_empty:
        return with_reason(cat, answer, resource_path, None, ignore_case)
    return answer.orderBy("HostName", "ShareName", "TrusteeNTStyleName")


# -- F-7, F-8 ------------------------------------------------------------------
def running_jobs(job_stats: DataFrame) -> DataFrame:
    """Get-RunningJobs: every column of jobs without an end time, newest first."""
    return job_stats.filter(F.col("EndTime").isNull()).orderBy(F.desc("JobRunTimeKey"))


def shadow_access(shadow: DataFrame) -> DataFrame:
    """Get-ShadowAccess: the shadow-access table as it is."""
    return shadow


# -- F-9 ---------------------------------------------------------------------
def lookup_diagnosis(cat, requests: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Why a path/trustee question came back empty, for (Path, Trustee) requests.

    Counts path matches (lookup) and trustee matches (directory UNION ALL
    local accounts, so duplicates count twice, as in the reference), then
    picks the first reason: path unknown, trustee unknown, nothing found.
    A NULL Trustee means the question had no trustee. ``Path`` and ``Trustee``
    come back as they were asked.
    """
    req = requests.select("Path", "Trustee").distinct()
    # Join the asked paths/names first: only matching rows are counted, not
    # every path of the traversal.
    paths = path_lookup_batch(cat.traversal, req, ignore_case).groupBy("Path") \
        .agg(F.count(F.lit(1)).alias("ResourceMatches"))
    d = cat.principals.select(F.col("NTAccount").alias("_name"))
    loc = cat.local_trustees.select(F.concat(F.col("NTDomain"), F.lit("\\"), F.col("NTName")).alias("_name"))
    known = d.unionAll(loc).withColumn("_t", _folded(F.col("_name"), ignore_case))
    asked = req.select("Trustee").where(F.col("Trustee").isNotNull()).distinct() \
        .withColumn("_t", _folded(F.col("Trustee"), ignore_case))
    names = asked.join(known, "_t").groupBy("Trustee").agg(F.count(F.lit(1)).alias("TrusteeMatches"))
    r = req.join(paths, "Path", "left").join(names, "Trustee", "left")
    rm = F.coalesce(F.col("ResourceMatches"), F.lit(0).cast("bigint"))
    tm = F.when(F.col("Trustee").isNull(), F.lit(None).cast("bigint")) \
          .otherwise(F.coalesce(F.col("TrusteeMatches"), F.lit(0).cast("bigint")))
    reason = F.when(rm == 0, F.lit("path unknown")) \
              .when(F.col("Trustee").isNotNull() & (tm == 0), F.lit("trustee unknown")) \
              .otherwise(F.lit("no access found"))
    return r.select("Path", "Trustee", rm.alias("ResourceMatches"), tm.alias("TrusteeMatches"), reason.alias("Reason"))


def diagnose(cat, resource_path: str, trustee: str | None = None, ignore_case: bool = False) -> DataFrame:
    """F-9 for one question: one row (Path, Trustee, ResourceMatches, TrusteeMatches, Reason)."""
    path = normalize_unc(resource_path)
    if trustee is not None:
        check_trustee(trustee)
    req = cat.spark.createDataFrame([(path, trustee)], "Path string, Trustee string")
    return lookup_diagnosis(cat, req, ignore_case)


def with_reason(cat, answer: DataFrame, resource_path: str, trustee: str | None,
                ignore_case: bool = False) -> DataFrame:
    """The answer of one question with a ``Reason`` column: NULL on its rows, and if it
    has none, one row of NULLs that says why (F-9)."""
    why = diagnose(cat, resource_path, trustee, ignore_case).select(F.lit(1).alias("_one"), "Reason")
    some = answer.limit(1).select(F.lit(1).alias("_one"))
    empty = why.join(some, "_one", "left_anti").select(
        *[F.lit(None).cast(t).alias(c) for c, t in answer.dtypes], "Reason")
    return answer.withColumn("Reason", F.lit(None).cast("string")).unionByName(empty)
