"""The closure kept up to date equals a rebuilt one, and touches the pairs around the changes only."""

import random

from conftest import SF_SMALL
from grantlens.operators.closure import membership_closure
from grantlens.operators.maintain import edge_changes, update_closure
from grantlens.sources.catalog import GovernanceCatalog
from test_properties import bfs_closure

EDGES = "GroupSid string, MemberSid string"


def levels(df):
    rows = [(r.GroupSid, r.MemberSid, r.MinNestingLevel) for r in df.collect()]
    assert len({x[:2] for x in rows}) == len(rows)
    return {(g, m): n for g, m, n in rows}


def check(spark, before, after):
    old, new = (spark.createDataFrame(e, EDGES) for e in (before + [(None, "x")], after + after[:1]))
    was = spark.createDataFrame([(g, m, n) for (g, m), n in bfs_closure(before).items()], EDGES + ", MinNestingLevel int")
    inserted, deleted = edge_changes(old, new)
    assert {tuple(r) for r in inserted.collect()} == set(after) - set(before) and {tuple(r) for r in deleted.collect()} == set(before) - set(after)
    got, changed = update_closure(was, new, inserted, deleted)
    assert levels(got) == bfs_closure(after)
    return changed


def test_random_changes_with_cycles(spark):
    rng = random.Random(31)
    for n, e in ((5, 12), (9, 22), (12, 30)):
        names = [f"g{i}" for i in range(n)]
        pool = sorted({(rng.choice(names), rng.choice(names + ["u0", "u1"])) for _ in range(e)})
        check(spark, [x for x in pool if rng.random() < 0.7] or pool, [x for x in pool if rng.random() < 0.7] or pool)


def test_a_cycle_goes_and_a_longer_way_stays(spark):
    check(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "u"), ("a", "u")], [("a", "b"), ("b", "c"), ("c", "u")])


def test_no_change_looks_at_nothing(spark):
    edges = [("a", "b"), ("b", "u")]
    assert check(spark, edges, edges).count() == 0


def test_work_follows_the_change(spark):
    cat = GovernanceCatalog(spark, SF_SMALL)
    edges = cat.direct_members
    closure = membership_closure(edges)
    gone = edges.filter("MemberSid like 'S-1-5-21-1-%'").orderBy("GroupSid", "MemberSid").limit(1).checkpoint()
    after = edges.join(gone, ["GroupSid", "MemberSid"], "left_anti").unionByName(spark.createDataFrame([(gone.head().GroupSid, "S-new")], EDGES))
    got, changed = update_closure(closure, after, *edge_changes(edges, after))
    assert levels(got) == levels(membership_closure(after))
    depth = closure.agg({"MinNestingLevel": "max"}).head()[0]
    assert 0 < changed.count() <= 2 * (depth + 1) < closure.count()
