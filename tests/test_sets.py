"""Sets of principals hold what the effective access rows hold."""

import random

from pyspark.sql import functions as F

from conftest import SF_SMALL
from grantlens.functions.rights import RIGHTS_LETTERS
from grantlens.operators import access, sets
from grantlens.operators.numbering import numbered
from grantlens.operators.sets import PrincipalSets
from grantlens.sources.catalog import GovernanceCatalog

ACL = "HostID int, GateID int, ResourceID long, TrusteeSid string, AllowRights int, DenyRights int"
NAMES = "TrusteeSid string, TrusteeNTStyleName string"


def unfolded_rows(rows):
    return sorted((r.HostID, r.GateID, r.ResourceID, letter, r.TrusteeNTStyleName)
                  for r in rows for letter, bit in RIGHTS_LETTERS if r.AllowRights & bit)


def check(spark, acl, names):
    materialize = GovernanceCatalog(spark).materialize
    s = PrincipalSets(names, materialize)
    want = unfolded_rows(access.effective_access(acl.dropna(), names.dropna(), {}).collect())
    assert sorted(tuple(r) for r in s.unfolded(s.holders(acl)).collect()) == want
    counts = {}
    for *key, _ in want:
        counts[tuple(key)] = counts.get(tuple(key), 0) + 1
    got = s.counts(acl).collect()
    assert {tuple(r)[:4]: r.Principals for r in got} == counts and len(got) == len(counts)
    return s


def test_small_and_large_trustees_over_several_buckets(spark, monkeypatch):
    rng = random.Random(5)
    people = [f"D\\u{i}" for i in range(400)]
    names = [(f"u{i}", p) for i, p in enumerate(people)]
    for g, n in enumerate((1, 3, 63, 64, 65, 200, 400)):
        names += [(f"g{g}", p) for p in rng.sample(people, n)]
    names += [("g1", people[0])] * 3 + [("twin", people[7]), ("other twin", people[7]), (None, people[1]), ("u9", None)]
    sids = sorted({s for s, _ in names if s}) + ["nobody", None]
    acl = [(i % 2, 0, i % 11, rng.choice(sids), rng.randrange(64), rng.choice((0, 0, 1, 2, 33))) for i in range(300)]
    acl += [(1, 0, 50, "g6", 1, 0), (1, 0, 50, "u3", 0, 1), (1, 0, 51, "g6", 1, 1), (1, 0, 52, "u1", 1 << 20, 0)]
    for bits, small in ((32768, 64), (64, 8)):
        monkeypatch.setattr(sets, "BITS", bits)
        monkeypatch.setattr(sets, "SMALL", small)
        s = check(spark, spark.createDataFrame(acl, ACL), spark.createDataFrame(names, NAMES))
        assert s.large.count() and s.small.count()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], ACL)
    check(spark, empty, spark.createDataFrame([("u1", "a")], NAMES))
    check(spark, spark.createDataFrame([(1, 0, 1, "u1", 1, 0)], ACL), spark.createDataFrame([], NAMES))


def test_sets_of_the_catalog_equal_effective_access(spark):
    c = GovernanceCatalog.for_dir(spark, SF_SMALL)
    s = c.principal_sets
    bits = F.array(*[F.when(F.col("AllowRights").bitwiseAND(F.lit(b)) != 0, F.lit(l)) for l, b in RIGHTS_LETTERS])
    want = c.effective_access.select(*access.RESOURCE_KEYS, F.explode(F.array_compact(bits)).alias("Right"), "TrusteeNTStyleName")
    got = s.unfolded(s.holders(c.acl))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not want.isEmpty()


def test_numbers_are_dense_and_in_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    out = sorted((r.k, r.n) for r in numbered(rows, ["k"], "n", GovernanceCatalog(spark).materialize, "t").collect())
    assert [n for _, n in out] == list(range(1000))


def test_counts_make_no_bitmap(spark):
    s = PrincipalSets(spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "b")], NAMES), GovernanceCatalog(spark).materialize)
    got = s.counts(spark.createDataFrame([(1, 0, 7, "g", 1, 0), (1, 0, 7, "h", 2, 1), (1, 0, 8, "h", None, 4)], ACL))
    assert sorted(tuple(r)[2:] for r in got.collect()) == [(7, "R", 1), (7, "W", 1)]
    assert "bitmap" not in got._jdf.queryExecution().optimizedPlan().toString() and "numbers" not in s.__dict__
