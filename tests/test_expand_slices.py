"""A slice is expanded some principals after another, and what is copied to every slice are pieces, not rows."""

import random

import pyarrow as pa

from grantlens.operators import access, expand
from grantlens.operators.sets import PrincipalSets
from grantlens.sources.catalog import GovernanceCatalog
from test_expand import ACL, NAMES, rows

KEYS = access.RESOURCE_KEYS
COLUMNS = [*KEYS, "TrusteeNTStyleName", "_a", "_d"]


def slice_of(entries, members, names):
    """The pieces of one slice, as the cogrouped task makes them."""
    entries = pa.table([pa.array(c) for c in zip(*entries)], names=[*KEYS, "_t", *expand.MASKS])
    members = pa.record_batch([pa.array([0] * len(members), pa.int32()), pa.array([t for t, _ in members], pa.int64()),
                               pa.array([m for _, m in members], pa.list_(pa.int32()))], names=["_bucket", "_of", "_members"])
    names = pa.record_batch([pa.array([0] * len(names), pa.int32()), pa.array(range(len(names)), pa.int32()), pa.array(names)], names=["_bucket", "_who", "_name"])
    pieces = [*expand._in_pieces("members")([members]), *expand._in_pieces("names")([names])]
    return expand._met(entries, pa.Table.from_batches(pieces)).to_batches()


def test_rows_of_a_slice_are_made_in_chunks_by_trustee(monkeypatch):
    entries = [(0, 0, r, t, 1 << t, 0) for r in range(40) for t in (0, 1)]
    pieces = slice_of(entries, [(0, list(range(50))), (1, [3, 3, 60])], [f"p{i:02}" for i in range(61)])
    want = {(r, f"p{i:02}", 3 if i == 3 else 1 if i < 50 else 2) for r in range(40) for i in [*range(50), 60]}
    for chunk in (10**6, 200):
        monkeypatch.setattr(expand, "CHUNK", chunk)
        made = list(expand._expand(KEYS, COLUMNS)(pieces))
        got = [r for b in made for r in zip(*(b.column(c).to_pylist() for c in ("ResourceID", "TrusteeNTStyleName", "_a")))]
        assert len(got) == len(want) and set(got) == want
        assert chunk > 200 or len(made) > 5 and max(b.num_rows for b in made) <= chunk + 40 * 2
    monkeypatch.setattr(expand, "CHUNK", 10**6)
    names = [r[1] for b in expand._expand(KEYS, COLUMNS)(pieces) for r in zip(b.column("ResourceID").to_pylist(), b.column("TrusteeNTStyleName").to_pylist())]
    assert names[:50] == names[50:100] == [f"p{i:02}" for i in range(50)]  # a trustee's members, resource by resource


def test_pieces_of_several_slices_in_a_task():
    one = slice_of([(0, 0, 1, 7, 1, 0)], [(7, [0, 1])], ["a", None])
    two = slice_of([(0, None, 2, 9, 2, 1)], [(9, [0])], ["c"])
    got = [tuple(r.values()) for b in expand._expand(KEYS, COLUMNS)([*one, *two]) for r in b.to_pylist()]
    assert sorted(got, key=repr) == [(0, 0, 1, "a", 1, 0), (0, 0, 1, None, 1, 0), (0, None, 2, "c", 2, 1)]


def test_keys_too_long_to_carry_their_place():
    key = expand.np.array([2**61, 5, 2**61, 5, 0])
    for k in (key, key % 97):
        ordered, place = expand._in_order(k)
        assert ordered.tolist() == sorted(k.tolist()) and place.tolist() == sorted(range(5), key=lambda i: (k[i], i))


def test_small_chunks_buckets_and_slices(spark, monkeypatch):
    rng = random.Random(11)
    people = [f"D\\u{i}" for i in range(90)] + [None]
    names = [(f"g{g}", p) for g in range(9) for p in rng.sample(people, 1 + g * 11)] + [("g8", people[0])] * 3
    acl = [(rng.choice((0, 1, None)), 0, rng.choice((None, *range(12))), rng.choice([f"g{g}" for g in range(9)] + ["nobody", None]),
            rng.choice((None, 1, 2, 33)), rng.choice((None, 0, 1))) for _ in range(200)]
    a, n = spark.createDataFrame(acl, ACL), spark.createDataFrame(names, NAMES)
    for name, value in (("PAIRS", 100), ("LEAST", 1), ("ENTRIES", 40), ("CHUNK", 70), ("BATCH", 16)):
        monkeypatch.setattr(expand, name, value)
    assert rows(access.effective_access_everywhere(a, n, {"g8": -2})) == rows(access.effective_access(a, n, {}))


def test_pairs_reach_the_slices_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(expand, "LEAST", 1)
    people = [("everyone", f"D\\u{i}") for i in range(3000)] + [(f"S{i}", f"D\\u{i}") for i in range(3000)]
    n = spark.createDataFrame(people, NAMES).repartition(2)
    a = spark.createDataFrame([(0, 0, r, "everyone", 1, 0) for r in range(64)], ACL)
    plan = expand._meeting(a, n, KEYS, {}, True)._jdf.queryExecution()
    right = plan.optimizedPlan().children().apply(1)
    copied = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, right).count()
    slices = len(expand._meeting(a, n, KEYS, {}, True).filter("kind = 'end'").collect())
    assert slices > 1 and copied < 40 * slices  # 9,000 rows a slice if they went one by one


def test_counts_leave_a_task_as_counts(spark):
    s = PrincipalSets(spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "b")], NAMES), GovernanceCatalog(spark).materialize)
    got = s.counts(spark.createDataFrame([(1, 0, 7, "g", 1, 0), (1, 0, 7, "h", 2, 1), (1, 0, 8, "h", None, 4)], ACL))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "TrusteeNTStyleName" not in plan[:plan.index("CoGroup")]
    assert sorted(tuple(r)[2:] for r in got.collect()) == [(7, "R", 1), (7, "W", 1)]
