"""Governance views derived from the driver's tables.

The operators consume views a directory/file-share scanner would fill:
traversal tree, ACL entries, principals, membership edges, activity and so on.
Here they are derived from the TPC-H-shaped tables (see FIXTURES.md for the
mapping). Every function is a lazy DataFrame transformation; nothing is
collected, so each view grows with its source tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.functions.accounts import flag_columns

# Fixed values of the fixture model (FIXTURES.md section 2).
USER_SID_PREFIX = "S-1-5-21-1-"
GROUP_SID_PREFIX = "S-1-5-21-2-"
COMPUTER_SID_PREFIX = "S-1-5-21-3-"
HOST_MODULUS = 25
UAC_MULTIPLIER = 7919
UAC_MASK = 0x1FFFFFF
BACKSLASH = "\\"


def _txt(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _null(dtype: str) -> Column:
    return F.lit(None).cast(dtype)


def hosts(nation: DataFrame) -> DataFrame:
    """Host dimension: one file server per nation (HostID, HostName, GateID)."""
    return nation.select(F.col("n_nationkey").alias("HostID"), F.col("n_name").alias("HostName"),
                         F.col("n_regionkey").alias("GateID"))


def _host_of(col: str) -> Column:
    return (F.col(col) % HOST_MODULUS).cast("int")


def traversal(part: DataFrame, nation: DataFrame) -> DataFrame:
    """Share/folder tree: two shares per host (k = 0, 1), folders below them."""
    k = F.floor(F.col("p_partkey") / HOST_MODULUS).cast("long")
    p = part.select(F.col("p_partkey").alias("ResourceID"), _host_of("p_partkey").alias("HostID"), k.alias("_k"))
    t = p.join(hosts(nation), "HostID")
    share = F.when(F.col("_k") % 2 == 0, F.lit("data")).otherwise(F.lit("data2"))
    is_share = F.col("_k") < 2
    tail = F.when(is_share, F.lit("")).otherwise(F.concat(F.lit(BACKSLASH + "dir"), _txt("_k")))
    return t.select(
        "HostID", "GateID", "ResourceID", "HostName",
        share.alias("ShareName"),
        F.concat(F.lit(BACKSLASH * 2), F.col("HostName"), F.lit(BACKSLASH), share, tail).alias("NetworkPath"),
        F.when(is_share, F.lit(0)).otherwise(F.lit(1) + (F.col("_k") % 3).cast("int")).alias("NestedLevel"),
        F.when(is_share, F.lit(2)).otherwise(F.lit(3)).alias("ResourceType"),
    )


def _uac(key: str) -> Column:
    return ((F.col(key) * UAC_MULTIPLIER).bitwiseAND(F.lit(UAC_MASK))).cast("int")


def users(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """User inventory (53 columns): one user per customer; logon span from orders."""
    span = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").alias("_first"), F.max("o_orderdate").alias("_last"))
    c = customer.join(span, "c_custkey", "left")
    dom = F.concat(F.lit("DOM"), _txt("c_nationkey"))
    uac = _uac("c_custkey")
    return c.select(
        F.col("c_nationkey").alias("DomainId"),
        dom.alias("DomainName"),
        F.concat(F.lit("dom"), _txt("c_nationkey"), F.lit(".corp.local")).alias("DomainCanonicalName"),
        F.col("c_custkey").alias("PrincipalId"),
        F.col("c_name").alias("SamAccountName"),
        F.concat(dom, F.lit(BACKSLASH), F.col("c_name")).alias("NTAccount"),
        F.col("c_name").alias("DisplayName"),
        F.concat(F.col("c_mktsegment"), F.lit(" customer")).alias("Description"),
        (F.col("c_custkey") + 100000).alias("USN"),
        F.when(F.col("c_custkey") % 17 == 0, 1).otherwise(0).alias("IsDeleted"),
        F.concat(F.lit(USER_SID_PREFIX), _txt("c_custkey")).alias("ObjectSid"),
        (F.col("c_custkey") + 1000000).alias("DnId"),
        F.concat(F.lit("CN="), F.col("c_name"), F.lit(",OU=Users,DC=dom"), _txt("c_nationkey"),
                 F.lit(",DC=corp,DC=local")).alias("DistinguishedName"),
        F.col("c_name").alias("Cn"),
        F.concat(F.lit("E"), _txt("c_custkey")).alias("EmployeeId"),
        F.col("_first").alias("WhenCreated"),
        _null("timestamp_ntz").alias("WhenChanged"),
        F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@dom"), _txt("c_nationkey"),
                 F.lit(".example.com")).alias("Mail"),
        F.col("_last").alias("LastLogonTimestamp"),
        _null("timestamp_ntz").alias("AccountExpires"),
        _null("string").alias("Title"),
        _null("string").alias("Company"),
        F.col("c_mktsegment").alias("Department"),
        F.when(F.col("c_custkey") % 10 == 0, _null("bigint"))
         .otherwise(F.col("c_custkey") - F.col("c_custkey") % 10).alias("ManagerPrincipalId"),
        uac.alias("UserAccountControl"),
        _null("int").alias("msDSUserAccountControlComputed"),
        _null("string").alias("TelephoneNumber"),
        F.col("_first").alias("PwdLastSetDate"),
        _null("string").alias("LegacyExchangeDN"),
        _null("string").alias("HomeMDB"),
        _null("string").alias("MailboxStore"),
        _null("string").alias("StorageGroup"),
        _null("string").alias("ExchangeServer"),
        *flag_columns(uac),
    )


def direct_members(lineitem: DataFrame, orders: DataFrame, supplier: DataFrame) -> DataFrame:
    """Direct membership edges (GroupSid, MemberSid).

    Users join groups through large line 7 orders; groups nest as a tree
    (group floor(s/3) holds group s), so the root group reaches everyone.
    """
    li = lineitem.filter((F.col("l_linenumber") == 7) & (F.col("l_quantity") > 45)) \
                 .select("l_orderkey", "l_suppkey")
    o = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    user_edges = li.join(o, "l_orderkey").select(
        F.concat(F.lit(GROUP_SID_PREFIX), _txt("l_suppkey")).alias("GroupSid"),
        F.concat(F.lit(USER_SID_PREFIX), _txt("o_custkey")).alias("MemberSid"))
    group_edges = supplier.filter(F.col("s_suppkey") > 0).select(
        F.concat(F.lit(GROUP_SID_PREFIX), _txt(F.floor(F.col("s_suppkey") / 3).cast("long"))).alias("GroupSid"),
        F.concat(F.lit(GROUP_SID_PREFIX), _txt("s_suppkey")).alias("MemberSid"))
    return user_edges.unionByName(group_edges).distinct()


def groups(supplier: DataFrame, members: DataFrame) -> DataFrame:
    """Group inventory (22 columns); DirectMemberCount from the edge table."""
    counts = members.groupBy(F.col("GroupSid").alias("ObjectSid")).agg(F.count(F.lit(1)).alias("_n"))
    sid = F.concat(F.lit(GROUP_SID_PREFIX), _txt("s_suppkey"))
    s = supplier.withColumn("ObjectSid", sid).join(counts, "ObjectSid", "left")
    dom = F.concat(F.lit("DOM"), _txt("s_nationkey"))
    scope = F.when(F.col("s_suppkey") % 3 == 0, "Global").when(F.col("s_suppkey") % 3 == 1, "Universal") \
             .otherwise("DomainLocal")
    return s.select(
        F.col("s_nationkey").alias("DomainId"),
        dom.alias("DomainName"),
        F.concat(F.lit("dom"), _txt("s_nationkey"), F.lit(".corp.local")).alias("DomainCanonicalName"),
        F.col("s_suppkey").alias("PrincipalId"),
        F.col("s_name").alias("SamAccountName"),
        F.concat(dom, F.lit(BACKSLASH), F.col("s_name")).alias("NTAccount"),
        F.col("s_name").alias("DisplayName"),
        F.concat(F.lit("Group of "), F.col("s_name")).alias("Description"),
        (F.col("s_suppkey") + 200000).alias("USN"),
        F.when(F.col("s_suppkey") % 11 == 0, 1).otherwise(0).alias("IsDeleted"),
        F.col("ObjectSid"),
        (F.col("s_suppkey") + 2000000).alias("DnId"),
        F.concat(F.lit("CN="), F.col("s_name"), F.lit(",OU=Groups,DC=dom"), _txt("s_nationkey"),
                 F.lit(",DC=corp,DC=local")).alias("DistinguishedName"),
        F.col("s_name").alias("Cn"),
        _null("timestamp_ntz").alias("WhenCreated"),
        _null("timestamp_ntz").alias("WhenChanged"),
        F.when(F.col("s_suppkey") % 7 == 0, "Distribution").otherwise("Security").alias("GroupType"),
        scope.alias("GroupScope"),
        _null("string").alias("GroupTarget"),
        _null("string").alias("Mail"),
        (F.col("s_suppkey") * 3).alias("ManagedByPrincipalId"),
        F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("DirectMemberCount"),
    )


def computers(part: DataFrame) -> DataFrame:
    """Computer inventory (44 columns): one computer per part."""
    dom = F.concat(F.lit("DOM"), _txt(_host_of("p_partkey")))
    name = F.concat(F.lit("PC"), _txt("p_partkey"))
    uac = _uac("p_partkey")
    return part.select(
        _host_of("p_partkey").alias("DomainId"),
        dom.alias("DomainName"),
        F.concat(F.lit("dom"), _txt(_host_of("p_partkey")), F.lit(".corp.local")).alias("DomainCanonicalName"),
        F.col("p_partkey").alias("PrincipalId"),
        F.concat(name, F.lit("$")).alias("SamAccountName"),
        F.concat(dom, F.lit(BACKSLASH), name, F.lit("$")).alias("NTAccount"),
        name.alias("DisplayName"),
        F.col("p_name").alias("Description"),
        (F.col("p_partkey") + 300000).alias("USN"),
        F.when(F.col("p_partkey") % 19 == 0, 1).otherwise(0).alias("IsDeleted"),
        F.concat(F.lit(COMPUTER_SID_PREFIX), _txt("p_partkey")).alias("ObjectSid"),
        F.concat(F.lit("CN="), name, F.lit(",OU=Computers,DC=dom"), _txt(_host_of("p_partkey")),
                 F.lit(",DC=corp,DC=local")).alias("DistinguishedName"),
        name.alias("Cn"),
        _null("timestamp_ntz").alias("WhenCreated"),
        _null("timestamp_ntz").alias("WhenChanged"),
        F.concat(F.lit("pc"), _txt("p_partkey"), F.lit(".corp.local")).alias("DnsHostName"),
        F.col("p_brand").alias("OperatingSystem"),
        F.col("p_type").alias("OperatingSystemVersion"),
        _null("string").alias("OperatingSystemServicePack"),
        _null("bigint").alias("ManagedByPrincipalId"),
        F.col("p_name").alias("Location"),
        _null("timestamp_ntz").alias("LastLogonTimestamp"),
        _null("timestamp_ntz").alias("PwdLastSetDate"),
        uac.alias("UserAccountControl"),
        *flag_columns(uac),
    )


PRINCIPAL_COLUMNS = ["ObjectSid", "NTAccount", "ObjectClassName", "DistinguishedName", "DomainCanonicalName"]


def principals(users_df: DataFrame, groups_df: DataFrame) -> DataFrame:
    """Name -> SID directory of users and groups (deleted ones included)."""
    u = users_df.select("ObjectSid", "NTAccount", F.lit("user").alias("ObjectClassName"),
                        "DistinguishedName", "DomainCanonicalName")
    g = groups_df.select("ObjectSid", "NTAccount", F.lit("group").alias("ObjectClassName"),
                         "DistinguishedName", "DomainCanonicalName")
    return u.unionByName(g)


def local_trustees(supplier: DataFrame) -> DataFrame:
    """Host-local accounts; they reuse directory group SIDs."""
    return supplier.select(
        F.concat(F.lit(GROUP_SID_PREFIX), _txt("s_suppkey")).alias("SID"),
        F.concat(F.lit("HOST"), _txt("s_nationkey")).alias("NTDomain"),
        F.col("s_name").alias("NTName"))


def acl(lineitem: DataFrame, orders: DataFrame, nation: DataFrame) -> DataFrame:
    """Raw ACL entries (HostID, GateID, ResourceID, TrusteeSid, AllowRights, DenyRights).

    Group entries from line numbers 1-2, direct user entries from line 3
    (lines 4-7 are findings, see fs_exceptions). Allow is one bit of R W D M A L, deny R/W on returns.
    """
    allow = F.expr("shiftleft(1, CAST(l_orderkey % 6 AS INT))")
    deny = F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")).otherwise(F.lit(0))
    base = ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"]
    grp = lineitem.filter(F.col("l_linenumber") <= 2).select(
        *base, F.concat(F.lit(GROUP_SID_PREFIX), _txt("l_suppkey")).alias("TrusteeSid"))
    li3 = lineitem.filter(F.col("l_linenumber") == 3).select(*base)
    usr = li3.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select(
        *base, F.concat(F.lit(USER_SID_PREFIX), _txt("o_custkey")).alias("TrusteeSid"))
    entries = grp.unionByName(usr).select(
        _host_of("l_partkey").alias("HostID"), F.col("l_partkey").alias("ResourceID"), "TrusteeSid",
        allow.alias("AllowRights"), deny.alias("DenyRights"))
    return entries.join(hosts(nation).select("HostID", "GateID"), "HostID").select(
        "HostID", "GateID", "ResourceID", "TrusteeSid", "AllowRights", "DenyRights")


def fs_exceptions(lineitem: DataFrame, nation: DataFrame) -> DataFrame:
    """Flagged file-system resources from line numbers 4-7 (ParentType 1 = open-access finding)."""
    e = lineitem.filter(F.col("l_linenumber") >= 4).select(
        _host_of("l_partkey").alias("HostID"), F.col("l_partkey").alias("ResourceID"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("ParentType"))
    return e.join(hosts(nation).select("HostID", "GateID"), "HostID").select(
        "HostID", "GateID", "ResourceID", "ParentType")


def resource_count(part: DataFrame) -> Column:
    """How many resource ids there are, as a scalar subquery: events and documents reach all of them."""
    return part.agg(F.max("p_partkey") + 1).scalar()


def daily_activity(events: DataFrame, users_df: DataFrame, nation: DataFrame, part: DataFrame) -> DataFrame:
    """Activity per (host, gate, folder, user, day) with the event count.

    Event k happens in folder k modulo the number of resources.

    Events are rolled up per (user id, folder, day) *before* the user join:
    the partial aggregation collapses a chatty user's millions of events to a
    few rows per task, so the join never sees a hot user key.
    """
    folder = F.col("event_id") % resource_count(part)
    rolled = events.select("user_id", folder.alias("FolderID"),
                           F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("ActivityDate")) \
        .groupBy("user_id", "FolderID", "ActivityDate").agg(F.count(F.lit(1)).alias("EventCount"))
    u = users_df.select(F.col("PrincipalId").alias("user_id"), F.col("NTAccount").alias("UserNTStyleName"))
    daily = rolled.join(u, "user_id").withColumn("HostID", (F.col("FolderID") % HOST_MODULUS).cast("int"))
    return daily.join(hosts(nation).select("HostID", "GateID"), "HostID").select(
        "HostID", "GateID", "FolderID", "UserNTStyleName", "ActivityDate", "EventCount")


def _permission() -> Column:
    return F.when(F.col("l_linenumber") % 3 == 0, "GenericAll") \
            .when(F.col("l_linenumber") % 3 == 1, "GenericRead").otherwise("WriteProperty")


def ad_permissions(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """Directory ACL entries: supplier principals on objects named after parts."""
    s = supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
    li = lineitem.select("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag").join(s, "l_suppkey")
    obj_dom = F.concat(F.lit("DOM"), _txt(_host_of("l_partkey")))
    return li.select(
        F.when(F.col("l_returnflag") == "R", "DENY").otherwise("ALLOW").alias("AccessEntryType"),
        F.concat(F.lit(GROUP_SID_PREFIX), _txt("l_suppkey")).alias("AccessEntryObjectSID"),
        F.col("s_name").alias("AccessEntryPrincipalName"),
        F.concat(F.lit("DOM"), _txt("s_nationkey")).alias("AccessEntryDomain"),
        _permission().alias("AccessEntryPermission"),
        F.when(F.col("l_linenumber") <= 3, "This object only").otherwise("All descendant objects")
         .alias("AccessEntryApplyTo"),
        F.when(F.col("l_linenumber") == 2, "member").otherwise(_null("string")).alias("AccessEntryPropertyName"),
        (F.col("l_linenumber") % 2).alias("IsInherited"),
        F.concat(F.lit("CN=obj"), _txt("l_partkey"), F.lit(",DC=corp")).alias("DistinguishedName"),
        F.concat(F.lit(COMPUTER_SID_PREFIX), _txt("l_partkey")).alias("ObjectSid"),
        F.when(F.col("l_partkey") % 2 == 0, "computer").otherwise("organizationalUnit").alias("ObjectClass"),
        F.concat(F.lit(GROUP_SID_PREFIX), _txt(F.col("l_suppkey") % 10)).alias("OwnerSid"),
        obj_dom.alias("Domain"),
        F.concat(F.lit("DOM"), _txt(F.col("s_nationkey"))).alias("OwnerDomain"),
        F.when(F.col("l_linenumber") == 7, 1).otherwise(0).alias("isdeleted"),
    )


def job_stats(orders: DataFrame) -> DataFrame:
    """Scan job runs; open orders are jobs still running (EndTime NULL)."""
    return orders.select(
        F.col("o_orderkey").alias("JobID"),
        F.concat(F.lit("Scan "), F.col("o_orderpriority")).alias("JobName"),
        F.col("o_orderdate").alias("JobRunTimeKey"),
        F.col("o_orderdate").alias("StartTime"),
        F.when(F.col("o_orderstatus") == "O", _null("timestamp_ntz"))
         .otherwise(F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("EndTime"),
        F.col("o_orderstatus").alias("Status"),
    )


def ca_rights(supplier: DataFrame) -> DataFrame:
    n = _txt("s_nationkey")
    return supplier.select(
        F.concat(F.lit("CA"), n).alias("Certificate Authority"),
        F.concat(F.lit("ca"), n, F.lit(".corp.local" + BACKSLASH + "CA"), n).alias("CA String"),
        F.concat(F.lit("DOM"), n).alias("Domain"),
        F.concat(F.lit("DOM"), n, F.lit(BACKSLASH), F.col("s_name")).alias("NTAccount"),
        F.concat(F.lit(GROUP_SID_PREFIX), _txt("s_suppkey")).alias("SID"),
        F.when(F.col("s_suppkey") % 2 == 1, "Manage").otherwise("Enroll").alias("Access"),
        F.when(F.col("s_suppkey") % 9 == 0, "Deny").otherwise("Allow").alias("Ace Type"),
        F.when(F.col("s_suppkey") % 3 == 0, "No").otherwise("Yes").alias("Direct"),
    )


def ad_exceptions(supplier: DataFrame, groups_df: DataFrame) -> DataFrame:
    """Directory findings: one for each group."""
    s = supplier.select(
        F.concat(F.lit(GROUP_SID_PREFIX), _txt("s_suppkey")).alias("ObjectSid"), "s_suppkey", "s_name")
    g = groups_df.select("ObjectSid", "NTAccount")
    return s.join(g, "ObjectSid").select(
        F.concat(F.lit("Stale group "), _txt("s_suppkey")).alias("Name"),
        F.concat(F.lit("Group "), F.col("s_name"), F.lit(" is stale")).alias("Description"),
        F.col("NTAccount").alias("PrincipalNTAccount"),
        F.lit("group").alias("PrincipalObjectClassName"))


def certificate_vulnerabilities(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    return supplier.select(
        F.concat(F.lit("CA"), _txt("s_nationkey")).alias("Certificate Authority"),
        F.concat(F.lit("Template"), _txt(k)).alias("Name"),
        F.when(k % 2 == 0, "Yes").otherwise("No").alias("Published"),
        F.when(k % 4 == 0, "ESC1").when(k % 4 == 1, "ESC2").when(k % 4 == 2, "ESC3")
         .otherwise(_null("string")).alias("Template Vulnerabilities"),
        F.when(F.col("s_nationkey") % 3 == 0, "ESC6").otherwise("ESC8").alias("Authority Vulnerabilities"),
    )


def security_assessment(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_type").alias("Category"), F.col("p_name").alias("Check"), F.col("p_brand").alias("Finding"),
        F.when(F.col("p_size") < 17, "Low").when(F.col("p_size") < 34, "Medium").otherwise("High").alias("Risk"))


def dc_summary(nation: DataFrame, region: DataFrame) -> DataFrame:
    r = region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return nation.join(r, "n_regionkey").select(
        F.concat(F.lit("DC"), _txt("n_nationkey")).alias("DomainController"),
        F.concat(F.lit("DOM"), _txt("n_nationkey")).alias("Domain"),
        F.col("r_name").alias("Site"),
        F.concat(F.lit("dc"), _txt("n_nationkey"), F.lit(".dom"), _txt("n_nationkey"),
                 F.lit(".corp.local")).alias("DnsHostName"))


def shadow_access(acl_df: DataFrame) -> DataFrame:
    """ACL entries that both deny something and grant administrative rights."""
    return acl_df.filter((F.col("DenyRights") > 0) & (F.col("AllowRights").bitwiseAND(F.lit(16)) != 0)).select(
        "TrusteeSid", "HostID", "GateID", "ResourceID", "AllowRights", "DenyRights")
