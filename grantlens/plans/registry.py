"""Named queries: Spark plans and the matching DuckDB oracle SQL.

Every query reads the driver's tables in full (through the governance views)
so its work grows with them; parameters only pick the path or trustee asked
about, as the tools do.
"""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlens.operators import checks, directory, filesystem as fs
from grantlens.operators.closure import membership_closure
from grantlens.operators.keys import candidate_keys
from grantlens.operators.maintain import edge_changes, update_closure
from grantlens.plans.oracle import rights_sql as R
from grantlens.plans.oracle import with_views as W
from grantlens.sources import governance as gov
from grantlens.sources.catalog import GovernanceCatalog

# Parameters of the single-entity queries (a user with group access at sf0.01
# and sf0.1, the first share of host NATION_3, a folder below it).
TRUSTEE = "DOM4\\Customer#000000022"
SHARE_PATH = "\\\\NATION_3\\data"
FOLDER_PATH_SLASHED = "//NATION_3/data/dir4/"
FOLDER_PATH = "\\\\NATION_3\\data\\dir4"
AS_OF = datetime(2024, 2, 1)
DAYS = 10
LEVEL = 1


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_text(s: str) -> str:
    """A Python string as a DuckDB expression, backslashes as chr(92)."""
    parts = s.split("\\")
    return " || chr(92) || ".join(_sq(p) for p in parts) if len(parts) > 1 else _sq(s)


def cat(spark: SparkSession, sf_dir: str) -> GovernanceCatalog:
    return GovernanceCatalog.for_dir(spark, sf_dir)


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- F-1 / G-7
@query("sensitive_data", W("g_content_matches", "g_traversal") + """
SELECT t.HostName, t.ShareName, m.CriteriaName, CAST(sum(m.MatchCount) AS BIGINT) AS TotalMatches
FROM g_content_matches m
LEFT JOIN g_traversal t ON t.HostID = m.HostID AND t.ResourceID = m.ParentResourceID
GROUP BY t.HostName, t.ShareName, m.CriteriaName
HAVING t.HostName IS NOT NULL AND t.ShareName IS NOT NULL
ORDER BY TotalMatches DESC""")
def q_sensitive_data(spark, d):
    c = cat(spark, d)
    return fs.sensitive_data(c.content_matches, c.traversal)


@query("content_matches", W("g_content_matches") + "SELECT * FROM g_content_matches")
def q_content_matches(spark, d):
    return cat(spark, d).content_matches


# ---------------------------------------------------------------- F-2
# Share by share: every flagged resource of the share's own servers, without any count per server in between.
_OPEN_SHARES = """
SELECT s.NetworkPath AS SharePath, count(DISTINCT e.ResourceID) AS ExceptionFolderCountInShare
FROM g_traversal s
LEFT JOIN g_fs_exceptions e ON e.ParentType = 1 AND e.HostID = s.HostID AND e.GateID = s.GateID {inside}
WHERE s.ResourceType = 2 AND s.NestedLevel = 0
GROUP BY s.NetworkPath
HAVING count(e.ResourceID) > 0
ORDER BY SharePath"""


@query("open_shares", W("g_traversal", "g_fs_exceptions") + _OPEN_SHARES.format(inside=""))
def q_open_shares(spark, d):
    c = cat(spark, d)
    return fs.open_shares(c.traversal, c.fs_exceptions)


@query("open_shares_within", W("g_traversal", "g_fs_exceptions") + _OPEN_SHARES.format(
    inside="""AND EXISTS (SELECT 1 FROM g_traversal x WHERE x.HostID = e.HostID AND x.GateID = e.GateID
      AND x.ResourceID = e.ResourceID AND starts_with(x.NetworkPath, s.NetworkPath || chr(92)))"""))
def q_open_shares_within(spark, d):
    c = cat(spark, d)
    return fs.open_shares(c.traversal, c.fs_exceptions, within_share=True, tree=c.path_tree)


# ---------------------------------------------------------------- F-3 / G-3
def _trustee_sid_cte(trustee_expr: str) -> str:
    return f"""
ts_sid AS (
  SELECT ObjectSid AS sid FROM g_principals WHERE NTAccount = {trustee_expr}
  UNION
  SELECT SID FROM g_local_trustees WHERE NTDomain || chr(92) || NTName = {trustee_expr}),
ts_pairs AS (
  SELECT GroupSid AS HolderSid, MemberSid AS sid FROM g_closure WHERE MemberSid IN (SELECT sid FROM ts_sid)
  UNION
  SELECT sid, sid FROM ts_sid)"""


_TRUSTEE_ACCESS = W("g_principals", "g_local_trustees", "g_closure", "g_acl", "g_traversal").rstrip() + "," + \
    _trustee_sid_cte(_sql_text(TRUSTEE)) + f""",
share AS (
  SELECT x.HostID, x.GateID, p.sid, bit_or(x.AllowRights) AS a, bit_or(x.DenyRights) AS d
  FROM g_acl x JOIN ts_pairs p ON x.TrusteeSid = p.HolderSid GROUP BY x.HostID, x.GateID, p.sid)
SELECT 'FileSystem' AS DataSource, f.NetworkPath, {R('p.a')} AS AllowRightsDescription,
       {R('p.d')} AS DenyRightsDescription
FROM share p JOIN g_traversal f USING (HostID, GateID)
WHERE f.NestedLevel = {LEVEL} AND f.ResourceType = 3"""


@query("trustee_access", _TRUSTEE_ACCESS)
def q_trustee_access(spark, d):
    return fs.trustee_access(cat(spark, d), TRUSTEE, levels_down=LEVEL)


@query("trustee_access_per_resource", W("g_principals", "g_local_trustees", "g_closure", "g_acl", "g_traversal")
       .rstrip() + "," + _trustee_sid_cte(_sql_text(TRUSTEE)) + f""",
share AS (
  SELECT x.HostID, x.GateID, x.ResourceID, p.sid, bit_or(x.AllowRights) AS a, bit_or(x.DenyRights) AS d
  FROM g_acl x JOIN ts_pairs p ON x.TrusteeSid = p.HolderSid GROUP BY x.HostID, x.GateID, x.ResourceID, p.sid)
SELECT 'FileSystem' AS DataSource, f.NetworkPath, {R('p.a')} AS AllowRightsDescription,
       {R('p.d')} AS DenyRightsDescription
FROM share p JOIN g_traversal f USING (HostID, GateID, ResourceID)
WHERE f.NestedLevel = {LEVEL} AND f.ResourceType = 3""")
def q_trustee_access_per_resource(spark, d):
    return fs.trustee_access(cat(spark, d), TRUSTEE, levels_down=LEVEL, per_resource=True)


@query("trustee_access_local_batch", W("g_principals", "g_local_trustees", "g_closure", "g_acl", "g_traversal")
       .rstrip() + f""",
req AS (SELECT DISTINCT NTDomain || chr(92) || NTName AS Trustee FROM g_local_trustees),
ts_sid AS (
  SELECT DISTINCT Trustee, sid FROM (
    SELECT r.Trustee, p.ObjectSid AS sid FROM req r JOIN g_principals p ON p.NTAccount = r.Trustee
    UNION ALL
    SELECT r.Trustee, l.SID FROM req r JOIN g_local_trustees l ON l.NTDomain || chr(92) || l.NTName = r.Trustee)),
ts_pairs AS (
  SELECT c.GroupSid AS HolderSid, s.sid, s.Trustee FROM g_closure c JOIN ts_sid s ON c.MemberSid = s.sid
  UNION
  SELECT sid, sid, Trustee FROM ts_sid),
share AS (
  SELECT p.Trustee, p.sid, x.HostID, x.GateID, bit_or(x.AllowRights) AS a, bit_or(x.DenyRights) AS d
  FROM g_acl x JOIN ts_pairs p ON x.TrusteeSid = p.HolderSid GROUP BY ALL)
SELECT p.Trustee, 'FileSystem' AS DataSource, f.NetworkPath, {R('p.a')} AS AllowRightsDescription,
       {R('p.d')} AS DenyRightsDescription
FROM share p JOIN g_traversal f USING (HostID, GateID)
WHERE f.NestedLevel = {LEVEL} AND f.ResourceType = 3""")
def q_trustee_access_local_batch(spark, d):
    c = cat(spark, d)
    req = c.local_trustees.select(F.concat("NTDomain", F.lit("\\"), "NTName").alias("Trustee")).distinct()
    return fs.trustee_access_batch(c, req, levels_down=LEVEL)


@query("trustee_share_access", W("g_acl", "g_holders") + """
SELECT x.HostID, x.GateID, h.MemberSid AS Sid, x.HostID AS HOST,
       bit_or(x.AllowRights) AS AllowRights, bit_or(x.DenyRights) AS DenyRights
FROM g_acl x JOIN g_holders h ON x.TrusteeSid = h.HolderSid
GROUP BY x.HostID, x.GateID, h.MemberSid""")
def q_trustee_share_access(spark, d):
    return cat(spark, d).trustee_share_access


# ---------------------------------------------------------------- F-4 / G-4
_MASK = "'0x' || lpad(hex(CAST({m} AS BIGINT) & 4294967295), 8, '0')"


def _perm_columns() -> str:
    return f"""ch.path AS SourceTrusteePath, t.NetworkPath AS ResourcePath,
       CASE WHEN ps.HolderSid = ps.sid THEN 'Direct' ELSE 'Group' END AS PermissionSourceType,
       {R('ps.AllowRights')} AS AllowRightsDescription, {_MASK.format(m='ps.AllowRights')} AS AllowMaskDescription,
       {R('ps.DenyRights')} AS DenyRightsDescription, {_MASK.format(m='ps.DenyRights')} AS DenyMaskDescription"""


@query("permission_source", W("g_principals", "g_local_trustees", "g_closure", "g_acl", "g_traversal", "g_chains").rstrip()
       + "," + _trustee_sid_cte(_sql_text(TRUSTEE)) + f""",
target AS (SELECT HostID, GateID, ResourceID, NetworkPath FROM g_traversal WHERE NetworkPath = {_sql_text(SHARE_PATH)}),
ps AS (SELECT x.HostID, x.GateID, x.ResourceID, p.sid, x.TrusteeSid AS HolderSid, x.AllowRights, x.DenyRights
       FROM g_acl x JOIN ts_pairs p ON x.TrusteeSid = p.HolderSid
       WHERE (x.HostID, x.GateID, x.ResourceID) IN (SELECT HostID, GateID, ResourceID FROM target))
SELECT {_perm_columns()}
FROM ps JOIN g_traversal t USING (HostID, GateID, ResourceID)
JOIN g_chains ch ON ch.HolderSid = ps.HolderSid AND ch.sid = ps.sid""")
def q_permission_source(spark, d):
    return fs.permission_source(cat(spark, d), TRUSTEE, SHARE_PATH)


@query("permission_source_local_batch", W("g_principals", "g_local_trustees", "g_closure", "g_acl", "g_traversal", "g_chains")
       .rstrip() + f""",
req AS (SELECT DISTINCT l.NTDomain || chr(92) || l.NTName AS Trustee, chr(92) || chr(92) || n.n_name || chr(92) || 'data' AS Plain,
               '//' || n.n_name || '/data/' AS Path
        FROM g_local_trustees l JOIN nation n ON l.NTDomain = 'HOST' || CAST(n.n_nationkey AS VARCHAR)),
ts_sid AS (
  SELECT DISTINCT Trustee, sid FROM (
    SELECT r.Trustee, p.ObjectSid AS sid FROM req r JOIN g_principals p ON p.NTAccount = r.Trustee
    UNION ALL
    SELECT r.Trustee, l.SID FROM req r JOIN g_local_trustees l ON l.NTDomain || chr(92) || l.NTName = r.Trustee)),
ts_pairs AS (
  SELECT c.GroupSid AS HolderSid, s.sid, s.Trustee FROM g_closure c JOIN ts_sid s ON c.MemberSid = s.sid
  UNION
  SELECT sid, sid, Trustee FROM ts_sid),
ri AS (SELECT r.Trustee, r.Path, t.HostID, t.GateID, t.ResourceID FROM req r JOIN g_traversal t ON t.NetworkPath = r.Plain),
ps AS (SELECT ri.Trustee, ri.Path, x.HostID, x.GateID, x.ResourceID, p.sid, x.TrusteeSid AS HolderSid,
              x.AllowRights, x.DenyRights
       FROM ri JOIN g_acl x ON x.HostID = ri.HostID AND x.GateID = ri.GateID AND x.ResourceID = ri.ResourceID
       JOIN ts_pairs p ON p.Trustee = ri.Trustee AND p.HolderSid = x.TrusteeSid)
SELECT ps.Trustee, ps.Path, {_perm_columns()}
FROM ps
JOIN g_traversal t ON t.HostID = ps.HostID AND t.GateID = ps.GateID AND t.ResourceID = ps.ResourceID
JOIN g_chains ch ON ch.HolderSid = ps.HolderSid AND ch.sid = ps.sid""")
def q_permission_source_local_batch(spark, d):
    c = cat(spark, d)
    n = c.raw("nation").select(F.concat(F.lit("HOST"), F.col("n_nationkey").cast("string")).alias("NTDomain"),
                               F.concat(F.lit("//"), "n_name", F.lit("/data/")).alias("Path"))
    req = c.local_trustees.join(n, "NTDomain").select(
        F.concat("NTDomain", F.lit("\\"), "NTName").alias("Trustee"), "Path").distinct()
    return fs.permission_source_batch(c, req)


@query("permission_entries", W("g_acl", "g_holders", "g_traversal", "g_chains") + f"""
SELECT ps.HostID, ps.GateID, ps.ResourceID, ps.sid AS Sid, {_perm_columns()}
FROM (SELECT x.HostID, x.GateID, x.ResourceID, h.MemberSid AS sid, x.TrusteeSid AS HolderSid, x.AllowRights,
             x.DenyRights
      FROM g_acl x JOIN g_holders h ON x.TrusteeSid = h.HolderSid) ps
JOIN g_traversal t ON t.HostID = ps.HostID AND t.GateID = ps.GateID AND t.ResourceID = ps.ResourceID
JOIN g_chains ch ON ch.HolderSid = ps.HolderSid AND ch.sid = ps.sid""")
def q_permission_entries(spark, d):
    return cat(spark, d).permission_entries


# ---------------------------------------------------------------- F-5 / G-5
def _resource_access_sql(path: str, condition: str = "asked.NetworkPath = {}") -> str:
    """Left joins from the asked resource, as the question is put; unmatched rows go in WHERE."""
    return W("g_traversal", "g_effective_access") + f"""
SELECT f.NetworkPath AS FolderFullPath, a.TrusteeNTStyleName, a.AllowRightsDescription, a.DenyRightsDescription
FROM g_traversal asked
LEFT JOIN g_effective_access a ON a.HostID = asked.HostID AND a.GateID = asked.GateID AND a.ResourceID = asked.ResourceID
LEFT JOIN g_traversal f ON f.HostID = a.HostID AND f.GateID = a.GateID AND f.ResourceID = a.ResourceID
WHERE {condition.format(_sql_text(path))} AND a.TrusteeNTStyleName IS NOT NULL
ORDER BY a.TrusteeNTStyleName"""


@query("resource_access", _resource_access_sql(SHARE_PATH))
def q_resource_access(spark, d):
    return fs.resource_access(cat(spark, d), SHARE_PATH)


@query("resource_access_folder", _resource_access_sql(FOLDER_PATH))
def q_resource_access_folder(spark, d):
    return fs.resource_access(cat(spark, d), FOLDER_PATH_SLASHED)


@query("resource_access_all_shares", W("g_traversal", "g_effective_access").rstrip() + """,
asked AS (SELECT HostID, GateID, ResourceID, NetworkPath AS Path FROM g_traversal WHERE NestedLevel = 0)
SELECT asked.Path, f.NetworkPath AS FolderFullPath, a.TrusteeNTStyleName, a.AllowRightsDescription,
       a.DenyRightsDescription
FROM asked JOIN g_effective_access a USING (HostID, GateID, ResourceID)
LEFT JOIN g_traversal f USING (HostID, GateID, ResourceID)""")
def q_resource_access_all_shares(spark, d):
    c = cat(spark, d)
    return fs.resource_access_batch(c, fs.share_roots(c.traversal))


@query("effective_access_counts", W("g_effective_access") + """
SELECT HostID, GateID, ResourceID, r.letter AS "Right", count(*) AS Principals
FROM g_effective_access, (VALUES ('R', 1), ('W', 2), ('D', 4), ('L', 32), ('M', 8), ('A', 16)) r(letter, bit)
WHERE (AllowRights & r.bit) <> 0 GROUP BY ALL""")
def q_effective_access_counts(spark, d):
    """How many principals hold each right on each resource, from bitmaps."""
    c = cat(spark, d)
    return c.principal_sets.counts(c.acl)


@query("effective_access", W("g_effective_access") + "SELECT * FROM g_effective_access")
def q_effective_access(spark, d):
    return cat(spark, d).effective_access


# ---------------------------------------------------------------- F-6 / G-6
def _unused_sql(asked: str, strict: bool, batch: bool) -> str:
    """One pass from the access rows: every activity of the user in the share is left-joined, and the groups whose
    latest one is missing or too old stay."""
    below = "starts_with(f.NetworkPath, s.NetworkPath || chr(92))"
    inside = f"({below} OR f.NetworkPath = s.NetworkPath)" if strict else "starts_with(f.NetworkPath, s.NetworkPath)"
    first = "s.NetworkPath AS Path, " if batch else ""
    return W("g_traversal", "g_effective_access", "g_daily_activity", "g_users") + f"""
SELECT {first}s.HostName, s.ShareName, a.TrusteeNTStyleName, a.AllowRightsDescription, a.DenyRightsDescription,
       max(CASE WHEN f.ResourceID IS NOT NULL THEN d.ActivityDate END) AS LastActivityDate
FROM g_effective_access a
JOIN g_traversal s ON s.ResourceID = a.ResourceID AND s.HostID = a.HostID AND s.GateID = a.GateID
LEFT JOIN g_daily_activity d
  ON d.UserNTStyleName = a.TrusteeNTStyleName AND d.HostID = s.HostID AND d.GateID = s.GateID
LEFT JOIN g_traversal f ON f.ResourceID = d.FolderID AND f.HostID = d.HostID AND f.GateID = d.GateID AND {inside}
WHERE s.NestedLevel = 0 AND {asked} AND EXISTS (SELECT 1 FROM g_users u WHERE u.NTAccount = a.TrusteeNTStyleName)
GROUP BY s.NetworkPath, s.ResourceID, s.HostID, s.GateID, s.HostName, s.ShareName, a.TrusteeNTStyleName,
         a.AllowRightsDescription, a.DenyRightsDescription
HAVING LastActivityDate IS NULL OR LastActivityDate < TIMESTAMP '{AS_OF.isoformat(sep=" ")}' - INTERVAL {DAYS} DAY
ORDER BY s.HostName, s.ShareName, a.TrusteeNTStyleName"""


@query("unused_access", _unused_sql(f"s.NetworkPath = {_sql_text(SHARE_PATH)}", strict=False, batch=False))
def q_unused_access(spark, d):
    return fs.unused_access(cat(spark, d), SHARE_PATH, DAYS, as_of=AS_OF)


@query("unused_access_strict", _unused_sql(f"s.NetworkPath = {_sql_text(SHARE_PATH)}", strict=True, batch=False))
def q_unused_access_strict(spark, d):
    return fs.unused_access(cat(spark, d), SHARE_PATH, DAYS, as_of=AS_OF, strict_prefix=True)


@query("unused_access_all_shares", _unused_sql("TRUE", strict=False, batch=True))
def q_unused_access_all_shares(spark, d):
    c = cat(spark, d)
    return fs.unused_access_batch(c, fs.share_roots(c.traversal), DAYS, as_of=AS_OF, tree=c.path_tree)


@query("daily_activity", W("g_daily_activity") + "SELECT * FROM g_daily_activity")
def q_daily_activity(spark, d):
    return cat(spark, d).daily_activity


# ---------------------------------------------------------------- F-7, F-8, F-9
@query("running_jobs", W("g_job_stats") + "SELECT * FROM g_job_stats WHERE EndTime IS NULL ORDER BY JobRunTimeKey DESC")
def q_running_jobs(spark, d):
    return fs.running_jobs(cat(spark, d).job_stats)


@query("shadow_access", W("g_shadow_access") + "SELECT * FROM g_shadow_access")
def q_shadow_access(spark, d):
    return fs.shadow_access(cat(spark, d).shadow_access)


_DIAG_REQUESTS = [(SHARE_PATH, TRUSTEE), ("\\\\NOHOST\\data", TRUSTEE), (SHARE_PATH, "DOM0\\nobody"),
                  (FOLDER_PATH, None), (FOLDER_PATH_SLASHED, TRUSTEE), ("no network path", TRUSTEE)]


def _diag_values() -> str:
    rows = [f"({_sql_text(p)}, {_sql_text(t) if t is not None else 'CAST(NULL AS VARCHAR)'})" for p, t in _DIAG_REQUESTS]
    return ", ".join(rows)


@query("lookup_diagnosis", W("g_traversal", "g_principals", "g_local_trustees") + f"""
SELECT r.Path, r.Trustee, CAST(coalesce(pm.n, 0) AS BIGINT) AS ResourceMatches,
       CASE WHEN r.Trustee IS NULL THEN NULL ELSE CAST(coalesce(tm.n, 0) AS BIGINT) END AS TrusteeMatches,
       CASE WHEN coalesce(pm.n, 0) = 0 THEN 'path unknown'
            WHEN r.Trustee IS NOT NULL AND coalesce(tm.n, 0) = 0 THEN 'trustee unknown'
            ELSE 'no access found' END AS Reason
FROM (SELECT DISTINCT * FROM (VALUES {_diag_values()}) AS v(Path, Trustee)) r
LEFT JOIN (SELECT NetworkPath, count(*) AS n FROM g_traversal GROUP BY NetworkPath) pm
  ON pm.NetworkPath = CASE WHEN starts_with(r.Path, '//') THEN chr(92) || chr(92) || rtrim(replace(substr(r.Path, 3), '/', chr(92)), chr(92)) ELSE r.Path END
LEFT JOIN (SELECT Trustee, count(*) AS n FROM (
             SELECT NTAccount AS Trustee FROM g_principals
             UNION ALL SELECT NTDomain || chr(92) || NTName FROM g_local_trustees) GROUP BY Trustee) tm
  ON tm.Trustee = r.Trustee""")
def q_lookup_diagnosis(spark, d):
    req = spark.createDataFrame(_DIAG_REQUESTS, "Path string, Trustee string")
    return fs.lookup_diagnosis(cat(spark, d), req)


# Empty answers explain themselves; names and paths in another letter case are found on request.
NO_PATH = "\\\\NOHOST\\data"
NO_TRUSTEE = "DOM0\\nobody"


def _explained_sql(columns: list[tuple[str, str]], path: str, trustee: str | None) -> str:
    nulls = ", ".join(f"CAST(NULL AS {t}) AS {c}" for c, t in columns)
    who = "FALSE" if trustee is None else f"""NOT EXISTS (SELECT 1 FROM g_principals WHERE NTAccount = {_sql_text(trustee)})
  AND NOT EXISTS (SELECT 1 FROM g_local_trustees WHERE NTDomain || chr(92) || NTName = {_sql_text(trustee)})"""
    return W("g_traversal", "g_principals", "g_local_trustees") + f"""
SELECT {nulls}, CASE WHEN NOT EXISTS (SELECT 1 FROM g_traversal WHERE NetworkPath = {_sql_text(path)}) THEN 'path unknown'
  WHEN {who} THEN 'trustee unknown' ELSE 'no access found' END AS Reason"""


_SOURCE_COLS = [(c, "VARCHAR") for c in (
    "SourceTrusteePath", "ResourcePath", "PermissionSourceType", "AllowRightsDescription", "AllowMaskDescription",
    "DenyRightsDescription", "DenyMaskDescription")]


@query("permission_source_unknown_trustee", _explained_sql(_SOURCE_COLS, SHARE_PATH, NO_TRUSTEE))
def q_permission_source_unknown_trustee(spark, d):
    return fs.permission_source(cat(spark, d), NO_TRUSTEE, SHARE_PATH, explain_empty=True)


@query("resource_access_unknown_path", _explained_sql([(c, "VARCHAR") for c in (
    "FolderFullPath", "TrusteeNTStyleName", "AllowRightsDescription", "DenyRightsDescription")], NO_PATH, None))
def q_resource_access_unknown_path(spark, d):
    return fs.resource_access(cat(spark, d), NO_PATH, explain_empty=True)


@query("unused_access_unknown_path", _explained_sql([(c, "VARCHAR") for c in (
    "HostName", "ShareName", "TrusteeNTStyleName", "AllowRightsDescription", "DenyRightsDescription")]
    + [("LastActivityDate", "TIMESTAMP")], NO_PATH, None))
def q_unused_access_unknown_path(spark, d):
    return fs.unused_access(cat(spark, d), NO_PATH, DAYS, as_of=AS_OF, explain_empty=True)


@query("trustee_access_ignore_case", _TRUSTEE_ACCESS)
def q_trustee_access_ignore_case(spark, d):
    return fs.trustee_access(cat(spark, d), TRUSTEE.lower(), levels_down=LEVEL, ignore_case=True)


@query("resource_access_ignore_case", _resource_access_sql(SHARE_PATH, "lower(asked.NetworkPath) = lower({})"))
def q_resource_access_ignore_case(spark, d):
    return fs.resource_access(cat(spark, d), SHARE_PATH.upper(), ignore_case=True)


# ---------------------------------------------------------------- G-1, A-1
_SCAN_AFTER = """WITH RECURSIVE g_new AS (
  SELECT 'S-1-5-21-2-' || CAST(l_suppkey AS VARCHAR) AS GroupSid, 'S-1-5-21-1-' || CAST(o_custkey AS VARCHAR) AS MemberSid
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 7 AND l_quantity > 45 AND l_returnflag <> 'A'
  UNION
  SELECT 'S-1-5-21-2-' || CAST(s_suppkey // 3 AS VARCHAR), 'S-1-5-21-2-' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey > 0 AND s_nationkey <> 1),
walk AS (SELECT GroupSid, MemberSid, 1 AS depth FROM g_new UNION SELECT w.GroupSid, n.MemberSid, depth + 1 FROM walk w JOIN g_new n ON n.GroupSid = w.MemberSid WHERE depth < 40)
SELECT GroupSid, MemberSid, CAST(min(depth) AS INTEGER) AS MinNestingLevel FROM walk GROUP BY GroupSid, MemberSid"""


@query("membership_after_scan", _SCAN_AFTER)
def q_membership_after_scan(spark, d):
    """The closure of a first scan (no returned lines, no suppliers of nation 0), brought up to a second (no accepted lines,
    no suppliers of nation 1)."""
    c = cat(spark, d)
    scans = [gov.direct_members(c.raw("lineitem").filter(F.col("l_returnflag") != flag), c.raw("orders"), c.raw("supplier").filter(F.col("s_nationkey") != nation))
             for flag, nation in (("R", 0), ("A", 1))]
    before, after = (c.materialize(x, "scan") for x in scans)
    return update_closure(membership_closure(before), after, *edge_changes(before, after))[0]


@query("membership_reaches", W("g_closure") + """
SELECT GroupSid, MemberSid, EXISTS (SELECT 1 FROM g_closure c WHERE c.GroupSid = r.GroupSid AND c.MemberSid = r.MemberSid) AS Reaches
FROM (SELECT DISTINCT 'S-1-5-21-2-' || CAST(l_suppkey AS VARCHAR) AS GroupSid, 'S-1-5-21-1-' || CAST(o_custkey AS VARCHAR) AS MemberSid
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey) r""")
def q_membership_reaches(spark, d):
    """Is the customer of every order line in the group of the line's supplier?"""
    c = cat(spark, d)
    lines = c.raw("lineitem").join(c.raw("orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    asked = lines.select(F.concat(F.lit("S-1-5-21-2-"), F.col("l_suppkey").cast("string")).alias("GroupSid"),
                         F.concat(F.lit("S-1-5-21-1-"), F.col("o_custkey").cast("string")).alias("MemberSid"))
    return c.group_labels.reaches(asked)


@query("membership_closure", W("g_closure") + "SELECT * FROM g_closure")
def q_membership_closure(spark, d):
    return cat(spark, d).closure


_MEMBERSHIP_VIEW = """
SELECT g.DistinguishedName AS GroupDistinguishedName, g.DomainCanonicalName AS GroupDomainCanonicalName,
       g.NTAccount AS GroupNTAccount, g.ObjectSid AS GroupObjectSid,
       m.DistinguishedName AS MemberDistinguishedName, m.DomainCanonicalName AS MemberDomainCanonicalName,
       m.NTAccount AS MemberNTAccount, m.ObjectSid AS MemberObjectSid, m.ObjectClassName AS MemberObjectClassName,
       c.MinNestingLevel AS NestingLevel
FROM g_closure c JOIN g_principals g ON g.ObjectSid = c.GroupSid JOIN g_principals m ON m.ObjectSid = c.MemberSid"""


@query("effective_membership", W("g_closure", "g_principals") + "SELECT * FROM (" + _MEMBERSHIP_VIEW +
       ") ORDER BY GroupNTAccount, MemberNTAccount")
def q_effective_membership(spark, d):
    c = cat(spark, d)
    return directory.effective_membership(directory.effective_group_members_view(c.closure, c.principals))


@query("effective_membership_filtered", W("g_closure", "g_principals") + "SELECT * FROM (" + _MEMBERSHIP_VIEW +
       ") WHERE GroupNTAccount LIKE 'DOM1%' AND MemberObjectClassName LIKE 'user'"
       " ORDER BY GroupNTAccount, MemberNTAccount")
def q_effective_membership_filtered(spark, d):
    c = cat(spark, d)
    view = directory.effective_group_members_view(c.closure, c.principals)
    return directory.effective_membership(view, group_nt_account_filter="DOM1%", member_object_class_filter="user",
                                          member_dn_filter="")


# ---------------------------------------------------------------- A-2 .. A-7
_EXC = "SELECT Name AS ExceptionName, Description, PrincipalNTAccount, PrincipalObjectClassName AS ObjectClass " \
       "FROM g_ad_exceptions {w} ORDER BY ExceptionName"


@query("ad_exceptions", W("g_ad_exceptions") + _EXC.format(w=""))
def q_ad_exceptions(spark, d):
    return directory.ad_exceptions(cat(spark, d).ad_exceptions)


@query("ad_exceptions_filtered", W("g_ad_exceptions") + _EXC.format(
    w="WHERE Name LIKE 'Stale group 1%' AND PrincipalNTAccount LIKE 'DOM%' || chr(92) || 'Supplier%'"))
def q_ad_exceptions_filtered(spark, d):
    return directory.ad_exceptions(cat(spark, d).ad_exceptions, name_filter="Stale group 1%",
                                   principal_nt_account_filter="DOM%\\Supplier%", description_filter="")


_PERM_COLS = ", ".join(directory.PERMISSION_COLUMNS)


@query("ad_permissions", W("g_ad_permissions") + f"SELECT {_PERM_COLS} FROM g_ad_permissions WHERE isdeleted = 0 "
       "ORDER BY DistinguishedName, AccessEntryPrincipalName")
def q_ad_permissions(spark, d):
    return directory.ad_permissions(cat(spark, d).ad_permissions)


@query("ad_permissions_filtered", W("g_ad_permissions") + f"SELECT {_PERM_COLS} FROM g_ad_permissions "
       "WHERE isdeleted = 0 AND AccessEntryType LIKE 'ALLOW' AND AccessEntryPrincipalName LIKE 'Supplier#00000001%' "
       "AND AccessEntryPermission LIKE '%Read%' AND IsInherited = 1 "
       "ORDER BY DistinguishedName, AccessEntryPrincipalName")
def q_ad_permissions_filtered(spark, d):
    return directory.ad_permissions(cat(spark, d).ad_permissions, access_entry_type_filter="ALLOW",
                                    principal_name_filter="Supplier#00000001%", permission_filter="%Read%",
                                    is_inherited_filter="1")


@query("domain_controllers", W("g_dc_summary") + "SELECT * FROM g_dc_summary")
def q_domain_controllers(spark, d):
    return directory.domain_controllers(cat(spark, d).dc_summary)


@query("certificate_vulnerabilities", W("g_certificate_vulnerabilities") + """
SELECT "Certificate Authority", "Name", "Published", "Template Vulnerabilities", "Authority Vulnerabilities"
FROM g_certificate_vulnerabilities""")
def q_certificate_vulnerabilities(spark, d):
    return directory.certificate_vulnerabilities(cat(spark, d).certificate_vulnerabilities)


@query("ca_rights", W("g_ca_rights") + """
SELECT "Certificate Authority", "CA String", "Domain", "NTAccount", "SID", "Access", "Ace Type", "Direct"
FROM g_ca_rights""")
def q_ca_rights(spark, d):
    return directory.ca_rights(cat(spark, d).ca_rights)


@query("security_assessment", W("g_security_assessment") +
       'SELECT Category, "Check", Finding, Risk FROM g_security_assessment')
def q_security_assessment(spark, d):
    return directory.security_assessment(cat(spark, d).security_assessment)


# ---------------------------------------------------------------- A-8 .. A-10
_USER_COLS = ", ".join(directory.USER_COLUMNS)
_GROUP_COLS = ", ".join(directory.GROUP_COLUMNS)
_COMP_COLS = ", ".join(directory.COMPUTER_COLUMNS)


@query("ad_users", W("g_users") + f"SELECT {_USER_COLS} FROM g_users WHERE IsDeleted = 0 ORDER BY NTAccount")
def q_ad_users(spark, d):
    return directory.ad_users(cat(spark, d).users)


@query("ad_users_filtered", W("g_users") + f"SELECT {_USER_COLS} FROM g_users WHERE IsDeleted = 0 "
       "AND NTAccount LIKE 'DOM1' || chr(92) || 'Customer#%' AND CAST(WhenCreated AS VARCHAR) LIKE '199%' "
       "AND CAST(USN AS VARCHAR) LIKE '1%' AND DomainId = 1 AND ACCOUNTDISABLE = 1 AND NORMAL_ACCOUNT = 0 "
       "ORDER BY NTAccount")
def q_ad_users_filtered(spark, d):
    return directory.ad_users(cat(spark, d).users, nt_account_filter="DOM1\\Customer#%", when_created_filter="199%",
                              usn_filter="1%", domain_id_filter="1", account_disabled_filter="1",
                              normal_account_filter="0")


@query("ad_users_ignore_case", W("g_users") + f"SELECT {_USER_COLS} FROM g_users WHERE IsDeleted = 0 "
       "AND NTAccount ILIKE 'dom1' || chr(92) || 'customer#00000%' AND Department ILIKE 'auto%' ORDER BY NTAccount")
def q_ad_users_ignore_case(spark, d):
    return directory.ad_users(cat(spark, d).users, ignore_case=True, nt_account_filter="dom1\\customer#00000%",
                              department_filter="auto%")


@query("ad_groups", W("g_groups") + f"SELECT {_GROUP_COLS} FROM g_groups ORDER BY NTAccount")
def q_ad_groups(spark, d):
    return directory.ad_groups(cat(spark, d).groups)


@query("ad_groups_filtered", W("g_groups") + f"SELECT {_GROUP_COLS} FROM g_groups "
       "WHERE GroupScope LIKE 'Global' AND GroupType LIKE 'Sec%' AND IsDeleted = 0 AND SamAccountName LIKE 'Supplier%' "
       "ORDER BY NTAccount")
def q_ad_groups_filtered(spark, d):
    return directory.ad_groups(cat(spark, d).groups, group_scope_filter="Global", group_type_filter="Sec%",
                               is_deleted_filter="0", sam_account_name_filter="Supplier%")


@query("ad_groups_member_count", W("g_groups") + f"SELECT {_GROUP_COLS} FROM g_groups "
       "WHERE GroupScope LIKE 'Global' AND IsDeleted = 0 AND DirectMemberCount = 8 ORDER BY NTAccount")
def q_ad_groups_member_count(spark, d):
    return directory.ad_groups(cat(spark, d).groups, group_scope_filter="Global", is_deleted_filter="0",
                               direct_member_count_filter="8")


@query("ad_computers", W("g_computers") + f"SELECT {_COMP_COLS} FROM g_computers WHERE IsDeleted = 0 ORDER BY NTAccount")
def q_ad_computers(spark, d):
    return directory.ad_computers(cat(spark, d).computers)


@query("ad_computers_filtered", W("g_computers") + f"SELECT {_COMP_COLS} FROM g_computers WHERE IsDeleted = 0 "
       "AND OperatingSystem LIKE 'Brand#1%' AND DnsHostName LIKE 'pc%.corp.local' AND WORKSTATION_TRUST_ACCOUNT = 1 "
       "AND DomainId = 3 ORDER BY NTAccount")
def q_ad_computers_filtered(spark, d):
    return directory.ad_computers(cat(spark, d).computers, os_filter="Brand#1%", dns_hostname_filter="pc%.corp.local",
                                  workstation_trust_filter="1", domain_id_filter="3")


# ---------------------------------------------------------------- D-1 .. D-5
# Column names and Spark types of the profiled driver tables.
PROFILED = {
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "bigint")],
}


def _profile_sql() -> str:
    parts = []
    for table, cols in PROFILED.items():
        for i, (c, t) in enumerate(cols, start=1):
            ml = f"CAST(max(length({c})) AS INTEGER)" if t == "string" else "CAST(NULL AS INTEGER)"
            parts.append(f"SELECT '{table}' AS table_name, {i} AS ordinal, '{c}' AS column_name, '{t}' AS data_type, "
                         f"count(*) - count({c}) AS null_count, {ml} AS max_length, "
                         f"count(DISTINCT {c}) AS distinct_count FROM {table}")
    return "\nUNION ALL\n".join(parts)


@query("column_profile", _profile_sql())
def q_column_profile(spark, d):
    c = cat(spark, d)
    return reduce(DataFrame.unionByName, [checks.column_profile(c.raw(t).select(*[n for n, _ in cols]), t)
                                          for t, cols in PROFILED.items()])


PK_CHECKS = [("orders", ["o_orderkey"]), ("lineitem", ["l_orderkey", "l_linenumber"])]


def _pk_sql() -> str:
    parts = []
    for table, keys in PK_CHECKS:
        k = ", ".join(keys)
        nul = " OR ".join(f"{c} IS NULL" for c in keys)
        parts.append(f"""SELECT '{table}' AS table_name, '{",".join(keys)}' AS key_columns,
  CAST(sum(n) AS BIGINT) AS row_count, count(*) FILTER (WHERE NOT nul) AS distinct_keys,
  CAST(coalesce(sum(n) FILTER (WHERE nul), 0) AS BIGINT) AS null_key_rows,
  count(*) FILTER (WHERE NOT nul AND n > 1) AS duplicate_groups,
  (coalesce(sum(n) FILTER (WHERE nul), 0) = 0 AND count(*) FILTER (WHERE NOT nul AND n > 1) = 0) AS is_key
FROM (SELECT {k}, count(*) AS n, ({nul}) AS nul FROM {table} GROUP BY {k})""")
    return "\nUNION ALL\n".join(parts)


@query("primary_key_check", _pk_sql())
def q_primary_key_check(spark, d):
    c = cat(spark, d)
    return reduce(DataFrame.unionByName, [checks.primary_key_check(c.raw(t), t, k) for t, k in PK_CHECKS])


# Column names of the driver tables whose keys are searched.
KEYED = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label", "pages": "page_id url html", "benchmark": "item_id text",
    "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}


def _keys_sql(width: int = 3) -> str:
    """Every combination counted, then those without a smaller key among them."""
    tries = []
    for table, names in KEYED.items():
        cols = names.split()
        for k in range(1, width + 1):
            for c in combinations(cols, k):
                full = " AND ".join(f"count({x}) = count(*)" for x in c)
                tries.append(f"SELECT '{table}' AS t, {list(c)!r} AS c FROM {table} HAVING {full} AND count(DISTINCT ({', '.join(c)})) = count(*)")
    return "WITH k AS (" + "\nUNION ALL ".join(tries) + """)
SELECT t AS table_name, array_to_string(c, ',') AS key_columns, CAST(len(c) AS INTEGER) AS n_columns FROM k
WHERE NOT EXISTS (SELECT 1 FROM k s WHERE s.t = k.t AND len(s.c) < len(k.c) AND list_has_all(k.c, s.c))"""


@query("candidate_keys", _keys_sql())
def q_candidate_keys(spark, d):
    c = cat(spark, d)
    return reduce(DataFrame.unionByName, [candidate_keys(c.raw(t).select(*names.split()), t) for t, names in KEYED.items()])


FK_CHECKS = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"),
             ("events", "user_id", "customer", "c_custkey"), ("documents", "doc_id", "labels", "doc_id"),
             ("lineitem", "l_orderkey,l_partkey", "lineitem", "l_orderkey,l_suppkey")]


def _fk_sql() -> str:
    parts = []
    for ct, cc, pt, pc in FK_CHECKS:
        pairs = list(zip(cc.split(","), pc.split(",")))
        match = " AND ".join(f"p.{y} = c.{x}" for x, y in pairs)
        whole = " AND ".join(f"c.{x} IS NOT NULL" for x, _ in pairs)
        key = "(" + ", ".join(f"c.{x}" for x, _ in pairs) + ")"
        parts.append(f"""SELECT '{ct}' AS child_table, '{cc}' AS child_column, '{pt}' AS parent_table,
  '{pc}' AS parent_column, count(*) AS child_rows, count(*) FILTER (WHERE NOT found) AS orphan_rows,
  count(DISTINCT k) FILTER (WHERE NOT found) AS orphan_keys, count(*) FILTER (WHERE NOT found) = 0 AS is_valid
FROM (SELECT {key} AS k, EXISTS (SELECT 1 FROM {pt} p WHERE {match}) AS found FROM {ct} c WHERE {whole})""")
    return "\nUNION ALL\n".join(parts)


@query("foreign_key_check", _fk_sql())
def q_foreign_key_check(spark, d):
    c = cat(spark, d)
    return reduce(DataFrame.unionByName, [
        checks.foreign_key_check(c.raw(ct), ct, cc.split(","), c.raw(pt), pt, pc.split(","))
        for ct, cc, pt, pc in FK_CHECKS])


SQL_PARAMS_TEXT = ("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, "
                   "CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty "
                   "FROM lineitem WHERE l_returnflag = ? AND l_shipdate < ? "
                   "GROUP BY l_returnflag, l_linestatus")
SQL_PARAMS = ["R", date(1998, 1, 1)]


@query("sql_params", SQL_PARAMS_TEXT.replace("= ?", "= 'R'", 1).replace("< ?", "< DATE '1998-01-01'", 1))
def q_sql_params(spark, d):
    c = cat(spark, d)
    return checks.run_sql(spark, SQL_PARAMS_TEXT, SQL_PARAMS, {"lineitem": c.raw("lineitem")})


def _masked_sql(col: str) -> str:
    x = f"coalesce({col}, '')"
    for pat, rep in [("'[^']*'", "'?'"), ('"[^"]*"', '"?"'), (r"\b\d+\.?\d*\b", "?"),
                     (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "?@?")]:
        x = f"regexp_replace({x}, {_sq(pat)}, {_sq(rep)}, 'g')"
    return x


@query("query_fingerprints", f"""SELECT fingerprint, n,
  CASE WHEN length(fingerprint) > 150 THEN substr(fingerprint, 1, 150) || '...' ELSE fingerprint END AS label
FROM (SELECT {_masked_sql('url')} AS fingerprint, count(*) AS n FROM pages GROUP BY 1)""")
def q_query_fingerprints(spark, d):
    return checks.query_fingerprints(cat(spark, d).raw("pages"), "url")


@query("path_lookup", W("g_traversal") + f"SELECT * FROM g_traversal WHERE NetworkPath = {_sql_text(FOLDER_PATH)}")
def q_path_lookup(spark, d):
    return fs.path_lookup(cat(spark, d).traversal, FOLDER_PATH_SLASHED)
