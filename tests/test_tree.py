"""Interval labels of the path tree hold what a comparison of the paths holds."""

import random

from conftest import SF_SMALL
from grantlens.operators import filesystem as fs
from grantlens.operators import tree
from grantlens.operators.tree import PathTree
from grantlens.plans import registry as R
from grantlens.sources.catalog import GovernanceCatalog
from minicat import mini_catalog

B = "\\"
NODES = "HostID int, GateID int, ResourceID long, NetworkPath string"
SHARES = "HostID int, GateID int, NetworkPath string"


def store(spark):
    return GovernanceCatalog(spark).materialize


def brute(nodes, shares, holds):
    test = {"strict": lambda p, s: p == s or p.startswith(s + B), "below": lambda p, s: p.startswith(s + B),
            "prefix": lambda p, s: p.startswith(s)}[holds]
    return sorted({(h, g, i, s) for h, g, i, p in nodes for hh, gg, s in shares
                   if None not in (h, g, p, hh, gg, s) and (h, g) == (hh, gg) and test(p, s)})


def check(spark, nodes, shares):
    t = PathTree(spark.createDataFrame(nodes, NODES), spark.createDataFrame(shares, SHARES), store(spark))
    places = sorted(r.Pre for r in t.places.collect())
    assert places == list(range(sum(None not in (h, g, p) for h, g, _, p in nodes)))
    for holds in tree.HOLDS:
        got = [tuple(r) for r in t.inside(holds).collect()]
        assert sorted(set(got)) == brute(nodes, shares, holds)
        if len({n[:3] for n in nodes}) == len(nodes):
            assert len(got) == len(set(got))
    return t


def test_nested_shares_odd_characters_nulls_and_repeats(spark):
    names = ["", "a", "a2", "a b", "a" + B, "a" + B + "b", "a" + B + "b" + B + "c", "a\0", "a\0" + B + "b", "a\1", "a!", "é", "é" + B + "a",
             "\U0010ffff", "\U0010ffff" + B + "x", "a" + B + B + "b", B, B + B + "h" + B + "a"]
    nodes = [(h, 0, 100 * h + i, n) for h in (1, 2) for i, n in enumerate(names)]
    nodes += [(1, 0, 5, "a" + B + "b"), (1, 0, 900, "a"), (None, 0, 901, "a"), (1, None, 902, "a"), (1, 0, 903, None)]
    shares = [(1, 0, n) for n in names] + [(2, 0, "a"), (2, 0, "a"), (2, 0, None), (None, 0, "a"), (3, 0, "a"), (1, 1, "a")]
    check(spark, nodes, shares)


def test_random_trees_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(tree, "CHUNK", 16)
    rng = random.Random(31)
    paths = [B.join(rng.choice(("d", "d1", "data", "data2", "x_y", "x%")) for _ in range(rng.randrange(1, 6))) for _ in range(500)]
    nodes = [(i % 3, 0, i, p if i % 5 else "hot" + B + p) for i, p in enumerate(paths)]
    shares = [(h, 0, p) for h in range(3) for p in ["hot", "d", *rng.sample(paths, 25)]]
    t = check(spark, nodes, shares)
    few = spark.createDataFrame([n[:3] for n in nodes[:40]], "HostID int, GateID int, ResourceID long")
    one = spark.createDataFrame([(0, 0, "hot", "asked")], SHARES + ", Path string")
    got = sorted(tuple(r) for r in t.inside("strict", few, one).collect())
    assert got == [(*n, "asked") for n in brute(nodes[:40], [(0, 0, "hot")], "strict")] and got


def test_empty_tree_and_no_shares(spark):
    check(spark, [], [(1, 0, "a")])
    check(spark, [(1, 0, 1, "a")], [])


def test_questions_on_labels_equal_those_on_cut_paths(spark):
    mini = mini_catalog(spark)
    for c in (mini, GovernanceCatalog.for_dir(spark, SF_SMALL)):
        on_cuts = fs.open_shares(c.traversal, c.fs_exceptions, within_share=True).collect()
        assert on_cuts == fs.open_shares(c.traversal, c.fs_exceptions, within_share=True, tree=c.path_tree).collect() and on_cuts
    c = mini
    for strict in (False, True):
        asked = fs.share_roots(c.traversal)
        want = fs.unused_access_batch(c, asked, 10, as_of=R.AS_OF, strict_prefix=strict).collect()
        got = fs.unused_access_batch(c, asked, 10, as_of=R.AS_OF, strict_prefix=strict, tree=c.path_tree).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and got


def test_containment_meets_on_the_chunk_alone(spark):
    c = GovernanceCatalog.for_dir(spark, SF_SMALL)
    held = c.path_tree.inside("prefix").hint("merge")
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert "_chunk" in plan and "NetworkPath" not in plan.split("Join Inner")[1].split("\n")[0]
    assert "substr" not in plan.lower() and "cartesian" not in plan.lower()
