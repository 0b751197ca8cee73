"""Closure depth equals BFS depth; salted joins equal plain joins; batch = singles."""

import random
from collections import deque

from pyspark.sql import functions as F

from grantlens.operators import filesystem as fs
from grantlens.operators.closure import membership_closure
from grantlens.operators.skew import hot_keys, skew_join
from grantlens.plans import registry as R
from grantlens.sources.catalog import GovernanceCatalog
from conftest import SF_MID


def bfs_closure(edges):
    adj = {}
    for g, m in edges:
        adj.setdefault(g, set()).add(m)
    out = {}
    for start in adj:
        seen, q = {}, deque([(start, 0)])
        while q:
            node, d = q.popleft()
            for nxt in adj.get(node, ()):
                if nxt not in seen:
                    seen[nxt] = d + 1
                    q.append((nxt, d + 1))
        for m, d in seen.items():
            out[(start, m)] = d
    return out


def test_closure_matches_bfs_on_random_graphs(spark):
    rng = random.Random(7)
    for trial in range(3):
        n = 30 + 10 * trial
        edges = {(f"g{rng.randrange(n)}", f"g{rng.randrange(n)}") for _ in range(2 * n)}
        edges |= {(f"g{rng.randrange(n)}", f"u{rng.randrange(50)}") for _ in range(n)}
        df = spark.createDataFrame(sorted(edges), "GroupSid string, MemberSid string")
        got = {(r.GroupSid, r.MemberSid): r.MinNestingLevel for r in membership_closure(df).collect()}
        assert got == bfs_closure(edges)


def test_closure_of_a_long_chain_is_complete(spark):
    edges = [(f"g{i}", f"g{i + 1}") for i in range(7)] + [("g7", "u")]
    df = spark.createDataFrame(edges, "GroupSid string, MemberSid string")
    got = {(r.GroupSid, r.MemberSid): r.MinNestingLevel for r in membership_closure(df).collect()}
    assert got == bfs_closure(edges) and got[("g0", "u")] == 8


def test_closure_with_salted_hot_group(spark):
    # one group holds most members: forced hot and salted; same answer as BFS
    edges = [("root", f"u{i}") for i in range(300)] + [("top", "root"), ("root", "sub"), ("sub", "u1")]
    df = spark.createDataFrame(edges, "GroupSid string, MemberSid string")
    got = {(r.GroupSid, r.MemberSid): r.MinNestingLevel
           for r in membership_closure(df, min_share=0.1, min_rows=10).collect()}
    assert got == bfs_closure(edges)


def test_skew_join_equals_plain_join(spark):
    fan = spark.createDataFrame([("hot", i) for i in range(200)] + [("cold", 1), ("cold", 2)], "k string, v int")
    other = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("cold", "c"), ("none", "d")], "k string, w string")
    hot = hot_keys(fan, "k", min_share=0.5, min_rows=10)
    assert hot == ["hot"]
    salted = skew_join(fan, other, "k", {"hot": 8})
    plain = fan.join(other, "k")
    assert sorted(salted.collect()) == sorted(plain.collect())
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()
    left = skew_join(fan.union(spark.createDataFrame([("x", 9)], "k string, v int")), other, "k", {"hot": 8}, how="left")
    assert left.count() == 200 * 2 + 2 + 1


def _cat(spark):
    return GovernanceCatalog.for_dir(spark, SF_MID)


def test_trustee_batch_equals_single_calls(spark):
    cat = _cat(spark)
    names = [R.TRUSTEE, "DOM10\\Customer#000000237", "DOM24\\Customer#000000608"]
    req = spark.createDataFrame([(n,) for n in names], "Trustee string")
    batch = fs.trustee_access_batch(cat, req, levels_down=1).collect()
    singles = []
    for n in names:
        singles += [(n,) + tuple(r) for r in fs.trustee_access(cat, n, levels_down=1).collect()]
    assert sorted(tuple(r) for r in batch) == sorted(singles)
    assert len(singles) > 0


def test_resource_and_unused_batch_equal_single_calls(spark):
    cat = _cat(spark)
    paths = ["\\\\NATION_3\\data", "\\\\NATION_7\\data2", "\\\\NATION_11\\data"]
    lookup = fs.path_lookup_batch(cat.traversal, spark.createDataFrame([(p,) for p in paths], "Path string"))
    assert lookup.count() == 3
    batch = fs.resource_access_batch(cat, lookup).collect()
    singles = []
    for p in paths:
        singles += [(p,) + tuple(r) for r in fs.resource_access(cat, p).collect()]
    assert sorted(tuple(r) for r in batch) == sorted(singles) and singles
    shares = fs.share_roots(cat.traversal).filter(F.col("Path").isin(paths))
    ub = fs.unused_access_batch(cat, shares, R.DAYS, as_of=R.AS_OF).collect()
    us = []
    for p in paths:
        us += [(p,) + tuple(r) for r in fs.unused_access(cat, p, R.DAYS, as_of=R.AS_OF).collect()]
    assert sorted(tuple(r) for r in ub) == sorted(us) and us


def test_prefix_join_equals_brute_force_startswith(spark):
    from grantlens.operators.prefix import prefix_join
    rng = random.Random(3)
    B = "\\"
    shares = [(h, B * 2 + f"h{h}" + B + name) for h in range(3) for name in ("data", "data2", "d", "x_y")]
    rows = []
    for i in range(300):
        h = rng.randrange(3)
        base = rng.choice(["data", "data2", "d", "dat", "x_y", "x_yz", "data2" + B + "a"])
        tail = "".join(rng.choice(["", B + "s", B + "t" + str(i % 7)]) for _ in range(rng.randrange(3)))
        rows.append((i, h, B * 2 + f"h{h}" + B + base + tail))
    rdf = spark.createDataFrame(rows, "id int, HostID int, FolderPath string")
    tdf = spark.createDataFrame(shares, "HostID int, SharePath string")
    for strict in (False, True):
        got = sorted((r.id, r.SharePath) for r in prefix_join(rdf, "FolderPath", tdf, "SharePath", ["HostID"],
                                                              strict=strict).collect())
        want = sorted((i, s) for i, h, p in rows for hh, s in shares
                      if h == hh and (p == s or p.startswith(s + B) if strict else p.startswith(s)))
        assert got == want and want


def test_two_sided_salt_plan_splits_larger_side(spark):
    from grantlens.operators.skew import hot_plan
    # "admins": few members, most ACL rows -> split the ACL side; "everyone": many members, few ACL rows
    members = spark.createDataFrame([("everyone", f"u{i}") for i in range(300)] + [("admins", "u1"), ("admins", "u2")],
                                    "k string, m string")
    acl = spark.createDataFrame([("admins", f"r{i}") for i in range(400)] + [("everyone", "r1"), ("x", "r2")],
                                "k string, r string")
    plan = hot_plan(members, acl, "k", min_share=0.2, min_rows=10)
    # 8 shuffle partitions: 302 // 8 = 37 and 402 // 8 = 50 rows each, so 300 rows need 9 salts and 400 need 8
    assert plan == {"everyone": 9, "admins": -8}
    salted = skew_join(members, acl, "k", plan)
    assert sorted(salted.collect()) == sorted(members.join(acl, "k").collect())


def test_permission_source_batch_equals_single_calls(spark):
    cat = _cat(spark)
    reqs = [(R.TRUSTEE, "\\\\NATION_3\\data"), ("DOM10\\Customer#000000237", "\\\\NATION_3\\data"),
            (R.TRUSTEE, "\\\\NATION_7\\data2")]
    batch = fs.permission_source_batch(cat, spark.createDataFrame(reqs, "Trustee string, Path string")).collect()
    singles = []
    for t, p in reqs:
        singles += [(t, p) + tuple(r) for r in fs.permission_source(cat, t, p).collect()]
    assert sorted(tuple(r) for r in batch) == sorted(singles) and singles
