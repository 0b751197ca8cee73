"""Labels answer what the closure answers, on trees, graphs with many parents, and cycles."""

import random

from conftest import SF_SMALL
from grantlens.operators.closure import group_edges, membership_closure
from grantlens.operators.reach import GroupLabels, components
from grantlens.sources.catalog import GovernanceCatalog

EDGES = "GroupSid string, MemberSid string"


def reached(edges):
    out = {}
    for g in {g for g, _ in edges}:
        seen, last = set(), {g}
        while last:
            last = {m for a, m in edges if a in last} - seen
            seen |= last
        out[g] = seen
    return out


def check(spark, edges):
    table = spark.createDataFrame(edges + [(None, "u0"), ("g0", None)], EDGES)
    sids = sorted({x for e in edges for x in e}) + ["nobody"]
    asked = spark.createDataFrame([(a, b) for a in sids for b in sids], EDGES)
    labels = GroupLabels(table, group_edges(table))
    want = reached(edges)
    got = {(r.GroupSid, r.MemberSid): r.Reaches for r in labels.reaches(asked).collect()}
    assert got == {(a, b): b in want.get(a, ()) for a in sids for b in sids}


def test_cycles_many_parents_and_self_members(spark):
    check(spark, [("g0", "g1"), ("g1", "g2"), ("g2", "g0"), ("g2", "g3"), ("g3", "u0"), ("g4", "g3"), ("g4", "g4"), ("g5", "g6"), ("g6", "g5"), ("g5", "g0"), ("g7", "u0"), ("g0", "u1")])


def test_random_graphs(spark):
    rng = random.Random(21)
    for n, e in ((8, 14), (14, 20)):
        names = [f"g{i}" for i in range(n)]
        check(spark, sorted({(rng.choice(names), rng.choice(names + ["u0", "u1", "u2"])) for _ in range(e)}))


def test_components(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "f"), ("g", "a")]
    nodes = spark.createDataFrame([(x,) for x in "abcdefgh"], "node string")
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "parent string, child string"), nodes).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f", "g": "g", "h": "h"}


def test_labels_of_the_directory_are_smaller_than_its_closure(spark):
    cat = GovernanceCatalog(spark, SF_SMALL)
    labels, closure = cat.group_labels, membership_closure(cat.direct_members)
    pairs = closure.select("GroupSid", "MemberSid")
    other = pairs.select("GroupSid").distinct().crossJoin(pairs.select("MemberSid").distinct().limit(40))
    asked = pairs.union(other).distinct()
    assert labels.reaches(asked).filter("Reaches").select("GroupSid", "MemberSid").exceptAll(pairs.join(asked, ["GroupSid", "MemberSid"], "left_semi")).isEmpty()
    assert labels.reaches(asked).filter("Reaches").count() == pairs.count()
    assert labels.labels.count() == cat.direct_members.select("GroupSid").distinct().count() < pairs.count()
