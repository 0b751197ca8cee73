"""Membership chains and walks from a few SIDs, against plain breadth-first searches; single questions close nothing."""

import random

from conftest import SF_SMALL
from grantlens.operators import filesystem as fs
from grantlens.operators.closure import CHAIN, group_edges, walk_down, walk_up
from grantlens.sources.catalog import GovernanceCatalog
from minicat import SHARE, mini_catalog

EDGES = "GroupSid string, MemberSid string"


def chains(edges, seed):
    """holder -> shortest chain; of equals the smaller one read from the holder back."""
    best, last = {seed: [seed]}, [seed]
    while last:
        found = {}
        for g, m in edges:
            if m in last and g not in best:
                one = [*best[m], g]
                if g not in found or one[::-1] < found[g][::-1]:
                    found[g] = one
        best.update(found)
        last = list(found)
    return best


def graph(rng, groups, users, edges):
    names = [f"g{i:02d}" for i in range(groups)]
    return sorted({(rng.choice(names), rng.choice(names + [f"u{i}" for i in range(users)])) for _ in range(edges)})


def test_chains_on_random_graphs_with_cycles(spark):
    rng = random.Random(11)
    for groups, users, n in ((4, 2, 12), (12, 6, 40), (20, 10, 30)):
        edges = graph(rng, groups, users, n)
        seeds = sorted({m for _, m in edges} | {g for g, _ in edges})[:12] + ["nobody"]
        table = spark.createDataFrame([(g, m, g.upper()) for g, m in edges] + [("x", None, "X"), (None, "u0", None)], EDGES + ", GroupName string")
        got = {(r.Sid, r.HolderSid): (r.Depth, r.Path) for r in walk_up(table, spark.createDataFrame([(s, s.upper()) for s in seeds], "Sid string, Path string")).collect()}
        want = {(s, h): (len(c) - 1, CHAIN.join(x.upper() for x in c)) for s in seeds for h, c in chains(edges, s).items()}
        assert got == want


def test_ties_go_to_the_smaller_sid_before_the_holder(spark):
    edges = [("b", "u"), ("a", "u"), ("top", "b"), ("top", "a"), ("u", "top")]
    table = spark.createDataFrame([(g, m, g) for g, m in edges], EDGES + ", GroupName string")
    rows = walk_up(table, spark.createDataFrame([("u", "user")], "Sid string, Path string")).collect()
    assert {r.HolderSid: r.Path for r in rows} == {"u": "user", "a": "user < a", "b": "user < b", "top": "user < a < top"}


def test_members_of_some_groups(spark):
    rng = random.Random(12)
    for _ in range(2):
        edges = graph(rng, 12, 10, 40)
        table = spark.createDataFrame(edges, EDGES)
        seeds = sorted({g for g, _ in edges})[:3] + ["u1", "nobody"]
        got = sorted(tuple(r) for r in walk_down(table, group_edges(table), spark.createDataFrame([(s,) for s in seeds], "HolderSid string")).collect())
        assert got == sorted((s, m) for s in seeds for m in {s} | {v for v in {m for _, m in edges} if s in chains(edges, v)})


def test_permission_source_shows_the_chain(spark):
    cat = mini_catalog(spark)
    rows = fs.permission_source(cat, "CORP\\bob", SHARE).collect()
    assert sorted((r.SourceTrusteePath, r.PermissionSourceType) for r in rows) == [("CORP\\bob", "Direct"), ("CORP\\bob < CORP\\staff", "Group")]


def test_single_questions_close_nothing(spark):
    cat = GovernanceCatalog(spark, SF_SMALL)
    share = cat.traversal.filter("ResourceType = 2").head().NetworkPath
    trustee = cat.principals.head().NTAccount
    for answer in (fs.trustee_access(cat, trustee), fs.permission_source(cat, trustee, share), fs.resource_access(cat, share), fs.unused_access(cat, share)):
        plan = answer._jdf.queryExecution().optimizedPlan().toString()
        answer.collect()
        assert "view-acl" in answer._jdf.queryExecution().executedPlan().toString()
        assert "AllowRights" not in "\n".join(x for x in plan.splitlines() if "LogicalRDD" in x)
    assert not {"closure", "trustee_names", "hot_holders", "sid_chains"} & set(vars(cat))
