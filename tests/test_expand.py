"""The expansion in place gives the rows of the plain join and aggregate, and shuffles none of them."""

import random

from grantlens.operators import access, expand
from grantlens.sources.catalog import GovernanceCatalog
from conftest import SF_SMALL

ACL = "HostID int, GateID int, ResourceID long, TrusteeSid string, AllowRights int, DenyRights int"
NAMES = "TrusteeSid string, TrusteeNTStyleName string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_expansion_in_place_equals_join_and_aggregate(spark, monkeypatch):
    rng = random.Random(3)
    people = [f"D\\u{i}" for i in range(60)] + [None]
    names = [(f"g{g}", p) for g in range(8) for p in rng.sample(people, 1 + g * 8)] * 2 + [(None, people[0]), ("g1", people[0])]
    sids = [f"g{g}" for g in range(8)] + ["nobody", None]
    acl = [(rng.choice((0, 1, None)), 0, rng.choice((None, 5, 2**60 + 1, 2**60 + 2)), rng.choice(sids), rng.choice((None, 1, 2, 8)), rng.choice((None, 0, 1)))
           for _ in range(120)]
    a, n = spark.createDataFrame(acl, ACL), spark.createDataFrame(names, NAMES)
    for pairs, out in ((200_000, 2_000_000), (20, 50)):
        monkeypatch.setattr(expand, "PAIRS", pairs)
        monkeypatch.setattr(expand, "ROWS", out)
        for plan in ({}, {"g7": 3, "g2": -2}):
            want, got = access.effective_access(a, n, plan), access.effective_access_everywhere(a, n, plan)
            assert got.dtypes == want.dtypes and rows(got) == rows(want) and len(rows(got)) > 50
    empty = spark.createDataFrame([], ACL)
    assert not rows(access.effective_access_everywhere(empty, n, {})) and not rows(access.effective_access_everywhere(a, n.limit(0), {}))


def test_no_exchange_of_expanded_rows(spark):
    plan = GovernanceCatalog.for_dir(spark, SF_SMALL).effective_access._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan.split("\n")[1] + plan.split("\n")[2]
    assert "Aggregate" not in plan[:plan.index("CoGroup")]
