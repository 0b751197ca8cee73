"""A hand-made governance catalog for edge-row tests (few rows, known answers)."""

from datetime import datetime

from grantlens.sources.catalog import GovernanceCatalog

TRAVERSAL = "HostID int, GateID int, ResourceID long, HostName string, ShareName string, NetworkPath string, " \
            "NestedLevel int, ResourceType int"
ACL = "HostID int, GateID int, ResourceID long, TrusteeSid string, AllowRights int, DenyRights int"
PRINCIPALS = "ObjectSid string, NTAccount string, ObjectClassName string, DistinguishedName string, " \
             "DomainCanonicalName string"
ACTIVITY = "HostID int, GateID int, FolderID long, UserNTStyleName string, ActivityDate timestamp_ntz, " \
           "EventCount long"

B = "\\"
SHARE = B * 2 + "H1" + B + "data"
SHARE2 = B * 2 + "H1" + B + "data2"
FOLDER = SHARE + B + "f"
AS_OF = datetime(2024, 2, 1)


def mini_catalog(spark) -> GovernanceCatalog:
    traversal = spark.createDataFrame([
        (1, 0, 1, "H1", "data", SHARE, 0, 2),
        (1, 0, 2, "H1", "data2", SHARE2, 0, 2),
        (1, 0, 3, "H1", "data", FOLDER, 1, 3),
        (1, 0, 4, "H1", "data2", SHARE2 + B + "g", 1, 3),
        # two hosts with one name: same share path, same resource ids
        (5, 0, 10, "HX", "data", B * 2 + "HX" + B + "data", 0, 2),
        (6, 0, 10, "HX", "data", B * 2 + "HX" + B + "data", 0, 2),
    ], TRAVERSAL)
    principals = spark.createDataFrame([
        ("S-u1", "CORP\\alice", "user", "CN=alice", "corp"),
        ("S-u2", "CORP\\bob", "user", "CN=bob", "corp"),
        ("S-u3", "CORP\\carol", "user", "CN=carol", "corp"),
        ("S-u4", "CORP\\dave", "user", "CN=dave", "corp"),
        ("S-g1", "CORP\\staff", "group", "CN=staff", "corp"),
    ], PRINCIPALS)
    users = principals.filter("ObjectClassName = 'user'").selectExpr(
        "NTAccount", "CASE WHEN NTAccount = 'CORP\\\\carol' THEN 1 ELSE 0 END AS IsDeleted")
    closure = spark.createDataFrame([("S-g1", m, 1) for m in ["S-u1", "S-u2", "S-u3", "S-u4"]],
                                    "GroupSid string, MemberSid string, MinNestingLevel int")
    members = closure.select("GroupSid", "MemberSid")
    acl = spark.createDataFrame([
        (1, 0, 1, "S-g1", 3, 0),      # staff: R W on the share
        (1, 0, 1, "S-u2", 0, 1),      # bob: deny R -> effective W
        (1, 0, 3, "S-g1", 32, 0),     # staff: L on the folder
        (1, 0, 4, "S-g1", 16, 0),
    ], ACL)
    activity = spark.createDataFrame([
        (1, 0, 4, "CORP\\alice", datetime(2024, 1, 30), 1),   # in data2: counts for data (prefix trap)
        (1, 0, 3, "CORP\\bob", datetime(2024, 1, 22), 1),     # exactly as_of - 10 days: still active
        (1, 0, 1, "CORP\\dave", datetime(2024, 1, 5), 2),     # inactive
    ], ACTIVITY)
    local = spark.createDataFrame([("S-g1", "CORP", "staff")], "SID string, NTDomain string, NTName string")
    exceptions = spark.createDataFrame([(5, 0, 7, 1), (6, 0, 7, 1), (1, 0, 3, 1), (1, 0, 4, 2)],
                                       "HostID int, GateID int, ResourceID long, ParentType int")
    return GovernanceCatalog(spark, None, traversal=traversal, principals=principals, users=users,
                             closure=closure, direct_members=members, acl=acl, daily_activity=activity, local_trustees=local,
                             fs_exceptions=exceptions)
