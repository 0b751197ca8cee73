"""Hand-made edge rows with exact expected output (FIXTURES.md section 3)."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from grantlens.functions.fingerprint import fingerprint
from grantlens.functions.like import like
from grantlens.functions.rights import rights_letters
from grantlens.operators import directory, filesystem as fs
from grantlens.operators.closure import membership_closure
from minicat import AS_OF, FOLDER, SHARE, mini_catalog


def closure_rows(spark, edges):
    df = spark.createDataFrame(edges, "GroupSid string, MemberSid string")
    return {(r.GroupSid, r.MemberSid): r.MinNestingLevel for r in membership_closure(df).collect()}


def test_membership_cycle_terminates(spark):
    assert closure_rows(spark, [("A", "B"), ("B", "A")]) == {("A", "B"): 1, ("B", "A"): 1, ("A", "A"): 2,
                                                             ("B", "B"): 2}


def test_two_paths_keep_min_depth(spark):
    got = closure_rows(spark, [("A", "B"), ("B", "C"), ("A", "C")])
    assert got[("A", "C")] == 1 and got[("A", "B")] == 1 and got[("B", "C")] == 1 and len(got) == 3


def test_rights_decoder(spark):
    df = spark.createDataFrame([(63,), (0,), (None,), (2,), (33,)], "m int")
    got = [r[0] for r in df.select(rights_letters("m")).collect()]
    assert got == ["RWDLMA", "", "", "W", "RL"]


def test_deny_over_allow(spark):
    cat = mini_catalog(spark)
    rows = {r.TrusteeNTStyleName: r for r in fs.resource_access(cat, SHARE).collect()}
    assert rows["CORP\\bob"].AllowRightsDescription == "W"
    assert rows["CORP\\bob"].DenyRightsDescription == "R"
    assert rows["CORP\\alice"].AllowRightsDescription == "RW"
    assert rows["CORP\\staff"].AllowRightsDescription == "RW"


def test_open_shares_same_id_two_hosts(spark):
    cat = mini_catalog(spark)
    got = {r.SharePath: r.ExceptionFolderCountInShare for r in fs.open_shares(cat.traversal, cat.fs_exceptions).collect()}
    assert got["\\\\HX\\data"] == 1
    # host-wide count: the flagged folder 3 counts for both shares of H1 (reference behaviour)
    assert got[SHARE] == 1 and got[SHARE + "2"] == 1
    within = {r.SharePath: r.ExceptionFolderCountInShare
              for r in fs.open_shares(cat.traversal, cat.fs_exceptions, within_share=True).collect()}
    assert within == {SHARE: 1}


def _unused(cat, **kw):
    return {r.TrusteeNTStyleName: r.LastActivityDate for r in fs.unused_access(cat, SHARE, 10, as_of=AS_OF, **kw).collect()}


def test_unused_access_edges(spark):
    cat = mini_catalog(spark)
    got = _unused(cat)
    # alice: data2 activity counts for data; bob: boundary instant is active; group dropped;
    # carol (deleted) never active -> NULL; dave inactive.
    assert got == {"CORP\\carol": None, "CORP\\dave": datetime(2024, 1, 5)}


def test_unused_access_strict_prefix(spark):
    cat = mini_catalog(spark)
    got = _unused(cat, strict_prefix=True)
    assert got == {"CORP\\alice": None, "CORP\\carol": None, "CORP\\dave": datetime(2024, 1, 5)}


def test_unused_access_on_folder_is_empty(spark):
    cat = mini_catalog(spark)
    assert fs.unused_access(cat, FOLDER, 10, as_of=AS_OF).count() == 0


def test_local_and_directory_trustee_share_sid(spark):
    cat = mini_catalog(spark)
    rows = fs.trustee_access(cat, "CORP\\staff", levels_down=1).collect()
    # one SID after the UNION: one row per level-1 folder (3 and 4), not two
    assert sorted(r.NetworkPath for r in rows) == sorted([FOLDER, "\\\\H1\\data2\\g"])
    # host/gate-wide OR of all staff entries on H1 (reference behaviour): RW + L + A
    assert {r.AllowRightsDescription for r in rows} == {"RWLA"}


def test_lookup_diagnosis_reasons(spark):
    cat = mini_catalog(spark)
    req = spark.createDataFrame([("\\\\NOPE\\x", "CORP\\alice"), (SHARE, "CORP\\nobody"), (SHARE, "CORP\\alice"),
                                 (SHARE, None)], "Path string, Trustee string")
    got = {(r.Path, r.Trustee): r.Reason for r in fs.lookup_diagnosis(cat, req).collect()}
    assert got[("\\\\NOPE\\x", "CORP\\alice")] == "path unknown"
    assert got[(SHARE, "CORP\\nobody")] == "trustee unknown"
    assert got[(SHARE, "CORP\\alice")] == "no access found"
    assert got[(SHARE, None)] == "no access found"


def test_input_checks():
    from grantlens.functions.validate import normalize_unc
    assert normalize_unc("//H1/data/") == SHARE
    with pytest.raises(ValueError):
        normalize_unc("H1\\data")
    with pytest.raises(ValueError):
        fs.trustee_access(None, "nobackslash")
    with pytest.raises(ValueError):
        fs.unused_access(None, SHARE, 0)


def test_backslash_and_bracket_patterns(spark):
    df = spark.createDataFrame([("CORP\\Admin1",), ("CORP\\Bob",), ("Alice",), ("Bob",), ("Carl",), ("",)], "s string")
    assert [r.s for r in df.filter(like(F.col("s"), "CORP\\Admin%")).collect()] == ["CORP\\Admin1"]
    assert sorted(r.s for r in df.filter(like(F.col("s"), "[AB]%")).collect()) == ["Alice", "Bob"]
    assert sorted(r.s for r in df.filter(like(F.col("s"), "[^AB]%")).collect()) == ["CORP\\Admin1", "CORP\\Bob", "Carl"]
    assert [r.s for r in df.filter(like(F.col("s"), "")).collect()] == [""]
    broken = spark.createDataFrame([("Bob\n",), ("Bob",)], "s string")
    assert [r.s for r in broken.filter(like(F.col("s"), "[AB]ob")).collect()] == ["Bob"]
    assert [r.s for r in df.filter(like(F.col("s"), "corp\\admin%", ignore_case=True)).collect()] == ["CORP\\Admin1"]


def test_empty_filter_semantics(spark):
    users = spark.createDataFrame([(1, "D\\a", "", 0), (2, "D\\b", "x", 0)],
                                  "PrincipalId long, NTAccount string, Description string, IsDeleted int")
    users = users.select(*[F.lit(None).cast("string").alias(c) if c not in users.columns else F.col(c)
                           for c in directory.USER_COLUMNS], "IsDeleted")
    users = users.select(*[c for c in users.columns if c != "IsDeleted"]).withColumn("IsDeleted", F.lit(0))
    # '' is a real pattern for the user tool: only the empty description matches
    assert [r.NTAccount for r in directory.ad_users(users, description_filter="").collect()] == ["D\\a"]
    ex = spark.createDataFrame([("n1", "d", "p", "group")],
                               "Name string, Description string, PrincipalNTAccount string, PrincipalObjectClassName string")
    # ... but ignored by the exceptions tool (truthiness test)
    assert directory.ad_exceptions(ex, description_filter="").count() == 1


def test_flag_and_id_validation(spark):
    users = spark.createDataFrame([(1, 0)], "DomainId int, ACCOUNTDISABLE int")
    with pytest.raises(ValueError):
        directory.ad_users(users, account_disabled_filter="2")
    with pytest.raises(ValueError):
        directory.ad_users(users, domain_id_filter="abc")
    with pytest.raises(TypeError):
        directory.ad_users(users, no_such_filter="x")


def test_fingerprint_log_lines(spark):
    long_text = "select " + ", ".join(f"col{i}" for i in range(40)) + " from t"
    rows = [("select * from t where a = 'x' and n = 5",), ("select * from t where a = 'y' and n = 7",),
            (long_text,), ("mail bob.smith@example.com now",), (None,)]
    df = spark.createDataFrame(rows, "q string")
    got = [r[0] for r in df.select(fingerprint("q")).collect()]
    assert got[0] == got[1] == "select * from t where a = '?' and n = ?"
    assert len(got[2]) == 153 and got[2].endswith("...")
    assert got[3] == "mail ?@? now"
    assert got[4] == ""


def test_fingerprints_group_on_the_whole_text(spark):
    from grantlens.operators.checks import query_fingerprints
    same = "select " + ", ".join(f"c{chr(97 + i % 26)}" for i in range(60))
    df = spark.createDataFrame([(same + " from a",), (same + " from b",), (same + " from b",)], "q string")
    got = query_fingerprints(df, "q").collect()
    assert sorted(r.n for r in got) == [1, 2] and len({r.label for r in got}) == 1


def test_diagnose_single_question(spark):
    cat = mini_catalog(spark)
    r = fs.diagnose(cat, "//H1/data", "CORP\\nobody").collect()
    assert [(x.ResourceMatches, x.TrusteeMatches, x.Reason) for x in r] == [(1, 0, "trustee unknown")]
    r = fs.diagnose(cat, "\\\\H9\\none").collect()
    assert [(x.ResourceMatches, x.TrusteeMatches, x.Reason) for x in r] == [(0, None, "path unknown")]


def test_trustee_sids_union_is_distinct(spark):
    from grantlens.operators.access import trustee_sids_batch
    cat = mini_catalog(spark)
    req = spark.createDataFrame([("CORP\\staff",), ("CORP\\nobody",)], "Trustee string")
    got = trustee_sids_batch(cat.principals, cat.local_trustees, req).collect()
    assert [(r.Trustee, r.sid) for r in got] == [("CORP\\staff", "S-g1")]


def test_other_letter_case_on_request(spark):
    cat = mini_catalog(spark)
    assert fs.trustee_access(cat, "corp\\STAFF", 1).count() == 0
    assert fs.trustee_access(cat, "corp\\STAFF", 1, ignore_case=True).count() == 2
    want = sorted(fs.permission_source(cat, "CORP\\bob", SHARE).collect())
    assert sorted(fs.permission_source(cat, "corp\\BOB", SHARE.lower(), ignore_case=True).collect()) == want and want
    for one in (fs.resource_access, lambda *a, **k: fs.unused_access(*a, 10, as_of=AS_OF, **k)):
        assert sorted(one(cat, SHARE.lower(), ignore_case=True).collect()) == sorted(one(cat, SHARE).collect())
    assert fs.diagnose(cat, SHARE.lower(), "corp\\Alice", ignore_case=True).head().Reason == "no access found"


def test_empty_answers_explain_themselves(spark):
    cat = mini_catalog(spark)
    assert [r.Reason for r in fs.permission_source(cat, "CORP\\nobody", SHARE, explain_empty=True).collect()] == ["trustee unknown"]
    assert [r.Reason for r in fs.resource_access(cat, "//H9/x", explain_empty=True).collect()] == ["path unknown"]
    assert [r.Reason for r in fs.unused_access(cat, FOLDER, 10, as_of=AS_OF, explain_empty=True).collect()] == ["no access found"]
    full = fs.resource_access(cat, SHARE, explain_empty=True).collect()
    assert {r.Reason for r in full} == {None} and len(full) == fs.resource_access(cat, SHARE).count()


def test_batch_reads_paths_as_single_calls_do(spark):
    cat = mini_catalog(spark)
    req = spark.createDataFrame([("CORP\\bob", "//H1/data/"), ("nobackslash", "//H1/data"), ("CORP\\bob", "H1/data")],
                                "Trustee string, Path string")
    got = fs.permission_source_batch(cat, req).collect()
    assert {(r.Trustee, r.Path) for r in got} == {("CORP\\bob", "//H1/data/")}
    assert sorted(tuple(r)[2:] for r in got) == sorted(tuple(r) for r in fs.permission_source(cat, "CORP\\bob", SHARE).collect())
    why = {r.Path: r.Reason for r in fs.lookup_diagnosis(cat, req.filter("Trustee <> 'nobackslash'")).collect()}
    assert why == {"//H1/data/": "no access found", "H1/data": "path unknown"}


def test_unknown_path_or_trustee_gives_empty_results(spark):
    cat = mini_catalog(spark)
    assert fs.resource_access(cat, "\\\\NOPE\\x").count() == 0
    assert fs.unused_access(cat, "\\\\NOPE\\x", 10, as_of=AS_OF).count() == 0
    assert fs.trustee_access(cat, "CORP\\nobody", 1).count() == 0
    assert fs.permission_source(cat, "CORP\\nobody", SHARE).count() == 0


def test_share_path_on_several_hosts_counts_resources_once(spark):
    # one path on two hosts that flag the same id and one more: 2, not 3; a path on one host takes its count
    trav = spark.createDataFrame([(1, 0, 1, "H", "d", "P", 0, 2), (2, 0, 1, "H", "d", "P", 0, 2),
                                  (3, 0, 1, "G", "d", "Q", 0, 2)],
                                 "HostID int, GateID int, ResourceID long, HostName string, ShareName string, "
                                 "NetworkPath string, NestedLevel int, ResourceType int")
    exc = spark.createDataFrame([(1, 0, 7, 1), (2, 0, 7, 1), (2, 0, 8, 1), (3, 0, 9, 1), (3, 0, 9, 1), (3, 0, 5, 2)],
                                "HostID int, GateID int, ResourceID long, ParentType int")
    got = {r.SharePath: r.ExceptionFolderCountInShare for r in fs.open_shares(trav, exc).collect()}
    assert got == {"P": 2, "Q": 1}
