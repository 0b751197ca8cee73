"""DuckDB oracle SQL: the governance views and every registered query as plain SQL.

Each view is a CTE over the driver's raw tables; a query's text is
``WITH RECURSIVE <needed views> <final select>``. The oracle is independent
of the Spark code (recursive CTE closure instead of the BFS loop, SQL joins
instead of the salted ones) so agreement is evidence, not a tautology.
"""

from __future__ import annotations

BS = "chr(92)"  # one backslash

# name -> (dependencies, body)
VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, deps: list[str], body: str) -> None:
    VIEWS[name] = (deps, body)


def _rights(m: str) -> str:
    letters = [("R", 1), ("W", 2), ("D", 4), ("L", 32), ("M", 8), ("A", 16)]
    return "(" + " || ".join(f"(CASE WHEN ({m} & {b}) <> 0 THEN '{ch}' ELSE '' END)" for ch, b in letters) + ")"


def _flags(uac: str) -> str:
    from grantlens.functions.accounts import ACCOUNT_FLAGS
    return ",\n".join(f"CAST(({uac} & {bit}) <> 0 AS INTEGER) AS {name}" for name, bit in ACCOUNT_FLAGS)


view("g_hosts", [], """
SELECT n_nationkey AS HostID, n_name AS HostName, n_regionkey AS GateID FROM nation""")

view("g_traversal", ["g_hosts"], f"""
SELECT h.HostID, h.GateID, p.p_partkey AS ResourceID, h.HostName,
       CASE WHEN p.p_partkey // 25 % 2 = 0 THEN 'data' ELSE 'data2' END AS ShareName,
       {BS} || {BS} || h.HostName || {BS} || (CASE WHEN p.p_partkey // 25 % 2 = 0 THEN 'data' ELSE 'data2' END)
         || (CASE WHEN p.p_partkey // 25 < 2 THEN '' ELSE {BS} || 'dir' || CAST(p.p_partkey // 25 AS VARCHAR) END)
         AS NetworkPath,
       CAST(CASE WHEN p.p_partkey // 25 < 2 THEN 0 ELSE 1 + p.p_partkey // 25 % 3 END AS INTEGER) AS NestedLevel,
       CAST(CASE WHEN p.p_partkey // 25 < 2 THEN 2 ELSE 3 END AS INTEGER) AS ResourceType
FROM part p JOIN g_hosts h ON h.HostID = CAST(p.p_partkey % 25 AS INTEGER)""")

view("g_users", [], f"""
SELECT c.c_nationkey AS DomainId, 'DOM' || CAST(c.c_nationkey AS VARCHAR) AS DomainName,
       'dom' || CAST(c.c_nationkey AS VARCHAR) || '.corp.local' AS DomainCanonicalName,
       c.c_custkey AS PrincipalId, c.c_name AS SamAccountName,
       'DOM' || CAST(c.c_nationkey AS VARCHAR) || {BS} || c.c_name AS NTAccount,
       c.c_name AS DisplayName, c.c_mktsegment || ' customer' AS Description,
       c.c_custkey + 100000 AS USN,
       CAST(CASE WHEN c.c_custkey % 17 = 0 THEN 1 ELSE 0 END AS INTEGER) AS IsDeleted,
       'S-1-5-21-1-' || CAST(c.c_custkey AS VARCHAR) AS ObjectSid,
       c.c_custkey + 1000000 AS DnId,
       'CN=' || c.c_name || ',OU=Users,DC=dom' || CAST(c.c_nationkey AS VARCHAR) || ',DC=corp,DC=local'
         AS DistinguishedName,
       c.c_name AS Cn, 'E' || CAST(c.c_custkey AS VARCHAR) AS EmployeeId,
       s.f AS WhenCreated, CAST(NULL AS TIMESTAMP) AS WhenChanged,
       lower(replace(c.c_name, '#', '.')) || '@dom' || CAST(c.c_nationkey AS VARCHAR) || '.example.com' AS Mail,
       s.l AS LastLogonTimestamp, CAST(NULL AS TIMESTAMP) AS AccountExpires,
       CAST(NULL AS VARCHAR) AS Title, CAST(NULL AS VARCHAR) AS Company, c.c_mktsegment AS Department,
       CASE WHEN c.c_custkey % 10 = 0 THEN NULL ELSE c.c_custkey - c.c_custkey % 10 END AS ManagerPrincipalId,
       CAST((c.c_custkey * 7919) & 33554431 AS INTEGER) AS UserAccountControl,
       CAST(NULL AS INTEGER) AS msDSUserAccountControlComputed, CAST(NULL AS VARCHAR) AS TelephoneNumber,
       s.f AS PwdLastSetDate, CAST(NULL AS VARCHAR) AS LegacyExchangeDN, CAST(NULL AS VARCHAR) AS HomeMDB,
       CAST(NULL AS VARCHAR) AS MailboxStore, CAST(NULL AS VARCHAR) AS StorageGroup,
       CAST(NULL AS VARCHAR) AS ExchangeServer,
       {_flags("((c.c_custkey * 7919) & 33554431)")}
FROM customer c
LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS f, max(o_orderdate) AS l FROM orders GROUP BY o_custkey) s
  ON c.c_custkey = s.o_custkey""")

view("g_direct_members", [], """
SELECT DISTINCT GroupSid, MemberSid FROM (
  SELECT 'S-1-5-21-2-' || CAST(l.l_suppkey AS VARCHAR) AS GroupSid,
         'S-1-5-21-1-' || CAST(o.o_custkey AS VARCHAR) AS MemberSid
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  WHERE l.l_linenumber = 7 AND l.l_quantity > 45
  UNION ALL
  SELECT 'S-1-5-21-2-' || CAST(s_suppkey // 3 AS VARCHAR), 'S-1-5-21-2-' || CAST(s_suppkey AS VARCHAR)
  FROM supplier WHERE s_suppkey > 0)""")

view("g_groups", ["g_direct_members"], f"""
SELECT s.s_nationkey AS DomainId, 'DOM' || CAST(s.s_nationkey AS VARCHAR) AS DomainName,
       'dom' || CAST(s.s_nationkey AS VARCHAR) || '.corp.local' AS DomainCanonicalName,
       s.s_suppkey AS PrincipalId, s.s_name AS SamAccountName,
       'DOM' || CAST(s.s_nationkey AS VARCHAR) || {BS} || s.s_name AS NTAccount,
       s.s_name AS DisplayName, 'Group of ' || s.s_name AS Description, s.s_suppkey + 200000 AS USN,
       CAST(CASE WHEN s.s_suppkey % 11 = 0 THEN 1 ELSE 0 END AS INTEGER) AS IsDeleted,
       'S-1-5-21-2-' || CAST(s.s_suppkey AS VARCHAR) AS ObjectSid, s.s_suppkey + 2000000 AS DnId,
       'CN=' || s.s_name || ',OU=Groups,DC=dom' || CAST(s.s_nationkey AS VARCHAR) || ',DC=corp,DC=local'
         AS DistinguishedName,
       s.s_name AS Cn, CAST(NULL AS TIMESTAMP) AS WhenCreated, CAST(NULL AS TIMESTAMP) AS WhenChanged,
       CASE WHEN s.s_suppkey % 7 = 0 THEN 'Distribution' ELSE 'Security' END AS GroupType,
       CASE s.s_suppkey % 3 WHEN 0 THEN 'Global' WHEN 1 THEN 'Universal' ELSE 'DomainLocal' END AS GroupScope,
       CAST(NULL AS VARCHAR) AS GroupTarget, CAST(NULL AS VARCHAR) AS Mail,
       s.s_suppkey * 3 AS ManagedByPrincipalId, CAST(coalesce(m.n, 0) AS BIGINT) AS DirectMemberCount
FROM supplier s
LEFT JOIN (SELECT GroupSid, count(*) AS n FROM g_direct_members GROUP BY GroupSid) m
  ON m.GroupSid = 'S-1-5-21-2-' || CAST(s.s_suppkey AS VARCHAR)""")

view("g_computers", [], f"""
SELECT CAST(p_partkey % 25 AS INTEGER) AS DomainId, 'DOM' || CAST(p_partkey % 25 AS VARCHAR) AS DomainName,
       'dom' || CAST(p_partkey % 25 AS VARCHAR) || '.corp.local' AS DomainCanonicalName,
       p_partkey AS PrincipalId, 'PC' || CAST(p_partkey AS VARCHAR) || '$' AS SamAccountName,
       'DOM' || CAST(p_partkey % 25 AS VARCHAR) || {BS} || 'PC' || CAST(p_partkey AS VARCHAR) || '$' AS NTAccount,
       'PC' || CAST(p_partkey AS VARCHAR) AS DisplayName, p_name AS Description, p_partkey + 300000 AS USN,
       CAST(CASE WHEN p_partkey % 19 = 0 THEN 1 ELSE 0 END AS INTEGER) AS IsDeleted,
       'S-1-5-21-3-' || CAST(p_partkey AS VARCHAR) AS ObjectSid,
       'CN=PC' || CAST(p_partkey AS VARCHAR) || ',OU=Computers,DC=dom' || CAST(p_partkey % 25 AS VARCHAR)
         || ',DC=corp,DC=local' AS DistinguishedName,
       'PC' || CAST(p_partkey AS VARCHAR) AS Cn,
       CAST(NULL AS TIMESTAMP) AS WhenCreated, CAST(NULL AS TIMESTAMP) AS WhenChanged,
       'pc' || CAST(p_partkey AS VARCHAR) || '.corp.local' AS DnsHostName,
       p_brand AS OperatingSystem, p_type AS OperatingSystemVersion,
       CAST(NULL AS VARCHAR) AS OperatingSystemServicePack, CAST(NULL AS BIGINT) AS ManagedByPrincipalId,
       p_name AS Location, CAST(NULL AS TIMESTAMP) AS LastLogonTimestamp, CAST(NULL AS TIMESTAMP) AS PwdLastSetDate,
       CAST((p_partkey * 7919) & 33554431 AS INTEGER) AS UserAccountControl,
       {_flags("((p_partkey * 7919) & 33554431)")}
FROM part""")

view("g_principals", ["g_users", "g_groups"], """
SELECT ObjectSid, NTAccount, 'user' AS ObjectClassName, DistinguishedName, DomainCanonicalName FROM g_users
UNION ALL
SELECT ObjectSid, NTAccount, 'group', DistinguishedName, DomainCanonicalName FROM g_groups""")

view("g_local_trustees", [], """
SELECT 'S-1-5-21-2-' || CAST(s_suppkey AS VARCHAR) AS SID, 'HOST' || CAST(s_nationkey AS VARCHAR) AS NTDomain,
       s_name AS NTName
FROM supplier""")

# Every chain of groups over a member that does not come back to a group it has; the member itself ends no chain, so a group
# on a cycle is found as its own member too. Lists run from the member to the holder.
view("g_walk", ["g_direct_members"], """
SELECT MemberSid, GroupSid, [GroupSid] AS chain FROM g_direct_members
UNION ALL
SELECT w.MemberSid, d.GroupSid, list_append(w.chain, d.GroupSid) FROM g_walk w JOIN g_direct_members d ON d.MemberSid = w.GroupSid
WHERE NOT list_contains(w.chain, d.GroupSid)""")

view("g_closure", ["g_walk"], """
SELECT GroupSid, MemberSid, CAST(min(len(chain)) AS INTEGER) AS MinNestingLevel FROM g_walk GROUP BY GroupSid, MemberSid""")

view("g_acl", ["g_hosts"], """
SELECT h.HostID, h.GateID, e.ResourceID, e.TrusteeSid, e.AllowRights, e.DenyRights FROM (
  SELECT CAST(l_partkey % 25 AS INTEGER) AS HostID, l_partkey AS ResourceID,
         'S-1-5-21-2-' || CAST(l_suppkey AS VARCHAR) AS TrusteeSid,
         CAST(1 << CAST(l_orderkey % 6 AS INTEGER) AS INTEGER) AS AllowRights,
         CAST(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END AS INTEGER) AS DenyRights
  FROM lineitem WHERE l_linenumber <= 2
  UNION ALL
  SELECT CAST(l.l_partkey % 25 AS INTEGER), l.l_partkey, 'S-1-5-21-1-' || CAST(o.o_custkey AS VARCHAR),
         CAST(1 << CAST(l.l_orderkey % 6 AS INTEGER) AS INTEGER),
         CAST(CASE WHEN l.l_returnflag = 'R' THEN l.l_linenumber ELSE 0 END AS INTEGER)
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  WHERE l.l_linenumber = 3) e
JOIN g_hosts h ON h.HostID = e.HostID""")

view("g_fs_exceptions", ["g_hosts"], """
SELECT h.HostID, h.GateID, l.l_partkey AS ResourceID,
       CAST(CASE WHEN l.l_linestatus = 'O' THEN 1 ELSE 2 END AS INTEGER) AS ParentType
FROM lineitem l JOIN g_hosts h ON h.HostID = CAST(l.l_partkey % 25 AS INTEGER)
WHERE l.l_linenumber >= 4""")

view("g_daily_activity", ["g_users", "g_hosts"], """
SELECT h.HostID, h.GateID, a.FolderID, a.UserNTStyleName, a.ActivityDate, a.EventCount FROM (
  SELECT CAST(e.event_id % (SELECT max(p_partkey) + 1 FROM part) % 25 AS INTEGER) AS HostID,
         e.event_id % (SELECT max(p_partkey) + 1 FROM part) AS FolderID,
         u.NTAccount AS UserNTStyleName, date_trunc('day', e.ts) AS ActivityDate, count(*) AS EventCount
  FROM events e JOIN g_users u ON e.user_id = u.PrincipalId
  GROUP BY ALL) a
JOIN g_hosts h ON h.HostID = a.HostID""")

EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"
IPV4_RE = r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"
view("g_content_matches", [], f"""
SELECT * FROM (
  SELECT doc_id AS DocumentID, CAST(doc_id % (SELECT max(p_partkey) + 1 FROM part) % 25 AS INTEGER) AS HostID,
         doc_id % (SELECT max(p_partkey) + 1 FROM part) AS ParentResourceID,
         'Email' AS CriteriaName, CAST(len(regexp_extract_all(text, '{EMAIL_RE}')) AS BIGINT) AS MatchCount
  FROM documents
  UNION ALL
  SELECT doc_id, CAST(doc_id % (SELECT max(p_partkey) + 1 FROM part) % 25 AS INTEGER),
         doc_id % (SELECT max(p_partkey) + 1 FROM part), 'IPv4',
         CAST(len(regexp_extract_all(text, '{IPV4_RE}')) AS BIGINT)
  FROM documents) WHERE MatchCount > 0""")

view("g_ad_permissions", [], f"""
SELECT CASE WHEN l.l_returnflag = 'R' THEN 'DENY' ELSE 'ALLOW' END AS AccessEntryType,
       'S-1-5-21-2-' || CAST(l.l_suppkey AS VARCHAR) AS AccessEntryObjectSID,
       s.s_name AS AccessEntryPrincipalName, 'DOM' || CAST(s.s_nationkey AS VARCHAR) AS AccessEntryDomain,
       CASE l.l_linenumber % 3 WHEN 0 THEN 'GenericAll' WHEN 1 THEN 'GenericRead' ELSE 'WriteProperty' END
         AS AccessEntryPermission,
       CASE WHEN l.l_linenumber <= 3 THEN 'This object only' ELSE 'All descendant objects' END AS AccessEntryApplyTo,
       CASE WHEN l.l_linenumber = 2 THEN 'member' ELSE NULL END AS AccessEntryPropertyName,
       l.l_linenumber % 2 AS IsInherited,
       'CN=obj' || CAST(l.l_partkey AS VARCHAR) || ',DC=corp' AS DistinguishedName,
       'S-1-5-21-3-' || CAST(l.l_partkey AS VARCHAR) AS ObjectSid,
       CASE WHEN l.l_partkey % 2 = 0 THEN 'computer' ELSE 'organizationalUnit' END AS ObjectClass,
       'S-1-5-21-2-' || CAST(l.l_suppkey % 10 AS VARCHAR) AS OwnerSid,
       'DOM' || CAST(l.l_partkey % 25 AS VARCHAR) AS Domain,
       'DOM' || CAST(s.s_nationkey AS VARCHAR) AS OwnerDomain,
       CAST(CASE WHEN l.l_linenumber = 7 THEN 1 ELSE 0 END AS INTEGER) AS isdeleted
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey""")

view("g_job_stats", [], """
SELECT o_orderkey AS JobID, 'Scan ' || o_orderpriority AS JobName, o_orderdate AS JobRunTimeKey,
       o_orderdate AS StartTime,
       CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate + INTERVAL 1 DAY END AS EndTime,
       o_orderstatus AS Status
FROM orders""")

view("g_ca_rights", [], f"""
SELECT 'CA' || CAST(s_nationkey AS VARCHAR) AS "Certificate Authority",
       'ca' || CAST(s_nationkey AS VARCHAR) || '.corp.local' || {BS} || 'CA' || CAST(s_nationkey AS VARCHAR)
         AS "CA String",
       'DOM' || CAST(s_nationkey AS VARCHAR) AS "Domain",
       'DOM' || CAST(s_nationkey AS VARCHAR) || {BS} || s_name AS "NTAccount",
       'S-1-5-21-2-' || CAST(s_suppkey AS VARCHAR) AS "SID",
       CASE WHEN s_suppkey % 2 = 1 THEN 'Manage' ELSE 'Enroll' END AS "Access",
       CASE WHEN s_suppkey % 9 = 0 THEN 'Deny' ELSE 'Allow' END AS "Ace Type",
       CASE WHEN s_suppkey % 3 = 0 THEN 'No' ELSE 'Yes' END AS "Direct"
FROM supplier""")

view("g_ad_exceptions", ["g_groups"], """
SELECT 'Stale group ' || CAST(s.s_suppkey AS VARCHAR) AS Name, 'Group ' || s.s_name || ' is stale' AS Description,
       g.NTAccount AS PrincipalNTAccount, 'group' AS PrincipalObjectClassName
FROM supplier s JOIN g_groups g ON g.ObjectSid = 'S-1-5-21-2-' || CAST(s.s_suppkey AS VARCHAR)""")

view("g_certificate_vulnerabilities", [], """
SELECT 'CA' || CAST(s_nationkey AS VARCHAR) AS "Certificate Authority", 'Template' || CAST(s_suppkey AS VARCHAR) AS "Name",
       CASE WHEN s_suppkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS "Published",
       CASE s_suppkey % 4 WHEN 0 THEN 'ESC1' WHEN 1 THEN 'ESC2' WHEN 2 THEN 'ESC3' ELSE NULL END
         AS "Template Vulnerabilities",
       CASE WHEN s_nationkey % 3 = 0 THEN 'ESC6' ELSE 'ESC8' END AS "Authority Vulnerabilities"
FROM supplier""")

view("g_security_assessment", [], """
SELECT p_type AS Category, p_name AS "Check", p_brand AS Finding,
       CASE WHEN p_size < 17 THEN 'Low' WHEN p_size < 34 THEN 'Medium' ELSE 'High' END AS Risk
FROM part""")

view("g_dc_summary", [], """
SELECT 'DC' || CAST(n.n_nationkey AS VARCHAR) AS DomainController, 'DOM' || CAST(n.n_nationkey AS VARCHAR) AS "Domain",
       r.r_name AS Site,
       'dc' || CAST(n.n_nationkey AS VARCHAR) || '.dom' || CAST(n.n_nationkey AS VARCHAR) || '.corp.local' AS DnsHostName
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""")

view("g_shadow_access", ["g_acl"], """
SELECT TrusteeSid, HostID, GateID, ResourceID, AllowRights, DenyRights FROM g_acl
WHERE DenyRights > 0 AND (AllowRights & 16) <> 0""")

view("g_sids", ["g_principals", "g_local_trustees"], """
SELECT ObjectSid FROM g_principals UNION SELECT SID FROM g_local_trustees""")

view("g_holders", ["g_closure", "g_sids"], """
SELECT GroupSid AS HolderSid, MemberSid FROM g_closure WHERE GroupSid <> MemberSid
UNION ALL
SELECT ObjectSid, ObjectSid FROM g_sids""")

# The shortest chain; of equals the one with the smaller SIDs, compared from the holder on.
view("g_chains", ["g_walk", "g_sids", "g_principals"], """
SELECT s.HolderSid, s.MemberSid AS sid, string_agg(coalesce(n.NTAccount, s.x), ' < ' ORDER BY s.i) AS path FROM (
  SELECT HolderSid, MemberSid, unnest(chain) AS x, generate_subscripts(chain, 1) AS i FROM (
    SELECT GroupSid AS HolderSid, MemberSid, list_prepend(MemberSid, arg_min(chain, {'n': len(chain), 'r': list_reverse(chain)})) AS chain
    FROM g_walk WHERE GroupSid <> MemberSid GROUP BY GroupSid, MemberSid
    UNION ALL
    SELECT ObjectSid, ObjectSid, [ObjectSid] FROM g_sids)) s
LEFT JOIN g_principals n ON n.ObjectSid = s.x GROUP BY s.HolderSid, s.MemberSid""")

view("g_trustee_names", ["g_closure", "g_principals"], """
SELECT h.HolderSid AS TrusteeSid, p.NTAccount AS TrusteeNTStyleName FROM (
  SELECT GroupSid AS HolderSid, MemberSid FROM g_closure
  UNION ALL
  SELECT ObjectSid, ObjectSid FROM g_principals) h
JOIN g_principals p ON p.ObjectSid = h.MemberSid""")

view("g_effective_access", ["g_acl", "g_trustee_names"], f"""
SELECT HostID, GateID, ResourceID, TrusteeNTStyleName,
       a & ~d AS AllowRights, d AS DenyRights,
       {_rights("(a & ~d)")} AS AllowRightsDescription, {_rights("d")} AS DenyRightsDescription
FROM (
  SELECT x.HostID, x.GateID, x.ResourceID, n.TrusteeNTStyleName, bit_or(x.AllowRights) AS a, bit_or(x.DenyRights) AS d
  FROM g_acl x JOIN g_trustee_names n ON n.TrusteeSid = x.TrusteeSid
  GROUP BY ALL)""")


def with_views(*names: str) -> str:
    """``WITH RECURSIVE`` clause holding ``names`` and their dependencies, in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            if d != n:
                visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n][1]}\n)" for n in order) + "\n"


def rights_sql(mask: str) -> str:
    return _rights(mask)
