import collections
import math
import random

from pyspark.sql import functions as F

from grantlens.llm.mixing import Mix, hypergeometric, op13_source_mix, splitting_tree, targets
from llm_cases import EDGE, docs, words

MID = "/root/testdata/sf0.01"


def water(sizes):
    """Targets by resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        pool, share = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        aim = {s: 3 * sizes[s] if s in full else pool * weight[s] / share for s in order}
        more = {s for s in order if s not in full and aim[s] > 3 * sizes[s]}
        if not more:
            return aim
        full |= more


def test_targets(spark):
    rng = random.Random(2)
    for _ in range(12):
        sizes = {s: rng.choice([0, 1, 10, 1000, 100_000]) * rng.randint(1, 9) for s in rng.sample(["a", "b", "Z", "é", "", None, "src10", "src9", "日"], rng.randint(1, 9))}
        rows = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = water(sizes)
        assert {r.source: r.source_size for r in rows} == sizes
        assert all(math.isclose(r.target, want[r.source], rel_tol=1e-12) for r in rows)


def test_hypergeometric_draws(spark):
    for pop, good, draws in ((20, 7, 9), (50, 40, 30), (9, 9, 4), (9, 0, 4), (1000, 3, 998), (6, 4, 0)):
        n = 4000
        rows = spark.range(n).select(hypergeometric(*(F.lit(x).cast("long") for x in (pop, good, draws)), (F.col("id") + 0.5) / n).alias("x")).groupBy("x").count().collect()
        got = {r.x: r["count"] / n for r in rows}
        want = {x: math.comb(good, x) * math.comb(pop - good, draws - x) / math.comb(pop, draws) for x in range(max(0, draws + good - pop), min(good, draws) + 1)}
        assert set(got) <= set(want) and all(abs(got.get(x, 0) - p) <= 2 / n for x, p in want.items())


def test_wide_hypergeometric_draws_stay_inside(spark):
    row = spark.range(300).select(hypergeometric(*(F.lit(x).cast("long") for x in (10_000_000, 4_000_000, 5_000_000)), (F.col("id") + 0.5) / 300).alias("x")).agg(F.avg("x"), F.stddev("x")).head()
    assert abs(row[0] - 2_000_000) < 60 and abs(row[1] / math.sqrt(5e6 * 0.4 * 0.6 * 0.5) - 1) < 0.1


def test_tree_keeps_quotas_and_shares(spark):
    quotas = {1: 100, 2: 7, 3: 1, 4: 333}
    for shards in (1, 2, 5, 16, 441):
        rows = splitting_tree(spark.createDataFrame(list(quotas.items()), "source int, k long"), shards).collect()
        by_source, by_shard = collections.Counter(), collections.Counter()
        for r in rows:
            by_source[r.source] += r.k
            by_shard[r.shard] += r.k
        assert by_source == quotas and len(by_shard) == shards and max(by_shard.values()) - min(by_shard.values()) <= 2
        if shards == 16:
            big = [r.k for r in rows if r.source == 4]
            assert 14 <= min(big) and max(big) <= 27 and len(set(big)) > 1


def test_sources_come_near_their_targets(spark):
    got = op13_source_mix(spark, MID).collect()
    texts = {r.doc_id: r for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    size = {i: len(words(r.text)) for i, r in texts.items()}
    per, taken, aims = collections.Counter(), collections.Counter(), {}
    for i, r in texts.items():
        per[r.source] += size[i]
    want = water(per)
    assert len(got) == len(texts)
    for r in got:
        source = texts[r.doc_id].source
        assert r.size == size[r.doc_id] and r.source_size == per[source] and math.isclose(r.target, want[source], rel_tol=1e-12)
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        taken[source] += r.taken
        aims[source] = r.target
    assert all(abs(taken[s] - t) <= 0.02 * t for s, t in aims.items())
    assert sorted(map(tuple, got)) == sorted(map(tuple, op13_source_mix(spark, MID).collect()))


def test_shards_hold_the_draws(spark):
    table = spark.read.parquet(f"{MID}/documents.parquet")
    mix = Mix(table, block=2000, shard=4)
    draws = collections.Counter((r.rest.doc_id, d.shard, d.turn) for r in mix.documents.collect() for d in r.draws)
    rows = mix.shards().collect()
    assert collections.Counter((r.rest.doc_id, r.shard, r.turn) for r in rows) == draws and max(draws.values()) == 1
    by_shard = collections.defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.place)
    assert len(by_shard) > 20 and all(sorted(p) == list(range(1, len(p) + 1)) for p in by_shard.values())


def test_edge_rows(spark):
    table = docs(spark, EDGE)
    got = Mix(table).documents.collect()
    assert sorted((str(r.rest.doc_id), r.size) for r in got) == sorted((str(i), len(words(t))) for i, t in EDGE)
    total = sum(len(words(t)) for _, t in EDGE)
    assert all(r.source_size == total and r.target == total and len(r.draws) == (1 if r.size else 0) and r.rest.rest == "x" for r in got)
    assert Mix(table.limit(0)).documents.count() == 0 and Mix(table.limit(0)).shards().count() == 0
    rows = [(k, "w " * (k % 7), [None, "", "a", "b"][k % 4]) for k in range(400)] + [(None, "no id", "a"), (None, "no id", "a"), (5, None, None), (5, "again", "hot")] + [(1000 + k, "hot words here", "hot") for k in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS mark", "3 AS block", "4 AS target", "5 AS salt", "6 AS name", "7 AS no", "8 AS part")
    got = Mix(table, block=50, shard=3).documents.collect()
    taken, aim = collections.Counter(), {r.rest.source: r.target for r in got}
    for r in got:
        taken[r.rest.source] += r.size * len(r.draws)
    assert len(got) == len(rows) and all(abs(taken[s] - t) <= 3 for s, t in aim.items())
