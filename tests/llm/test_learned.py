"""Language ID, quality, LM scoring: exact parts by brute force, learned parts by held-out accuracy."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grantlens.llm import langid, maxent_lm, quality
from grantlens.llm.textblocks import U, blocks
from llm_cases import EDGE, TWINS, docs, held, words

MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}


# ------------------------------------------------------------ language identification
def brute_kneser_ney(texts, order):
    """P(symbol | history) by the recursive definition, on tuples of symbols."""
    seen = collections.Counter()
    for t in texts:
        padded = [None] * (order - 1) + list(t)
        seen.update(tuple(padded[i : i + order]) for i in range(len(t)))
    levels = {order: seen}
    for k in range(order - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    size = None

    def p(gram, alphabet):
        k = len(gram)
        if k == 0:
            return 1 / alphabet
        c = levels[k]
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.9)
        same = {g: v for g, v in c.items() if g[:-1] == gram[:-1]}
        total = sum(same.values())
        low = p(gram[1:], alphabet)
        return low if not total else max(c[gram] - d, 0) / total * (gram in c) + d * len(same) / total * low

    return p, size


def test_probabilities_are_interpolated_kneser_ney():
    said = {"x": ["abab", "abc", "bcab"], "y": ["ccb", "cab"]}
    table = langid.symbol_table([ord(c) for c in "abc"])
    block = lambda ts: next(iter(langid.blocks(langid.pa.array(ts))))
    counts = {k: np.unique(langid.grams(block(v), table)[0], return_counts=True) for k, v in said.items()}
    model = langid.KneserNey(["x", "y"], table, counts)
    alphabet = int(table.max())  # symbols with their own entry and the shared one
    for text in ("abca", "zzab", "c", "bbbb"):
        codes, _ = langid.grams(block([text]), table)
        got = model.log_p(codes)
        for j, lang in enumerate(("x", "y")):
            p, _ = brute_kneser_ney(said[lang], langid.ORDER)
            padded = [None] * (langid.ORDER - 1) + list(text)
            want = [math.log(p(tuple(padded[i : i + langid.ORDER]), alphabet)) for i in range(len(text))]
            assert np.allclose(got[:, j], want, atol=1e-4)


def test_sorted_hashes_find_all_and_only_members():
    codes = np.unique(np.random.default_rng(0).integers(0, 1 << 60, 5000).astype(U))
    s = langid.SortedHashes(codes)
    rows = s.rows(codes)
    assert (s.hashes[rows] == langid.mix(codes)).all() and (np.diff(s.hashes.astype(object)) > 0).all()
    assert (s.rows(codes + U(1))[~np.isin(codes + U(1), codes)] == -1).all()


def test_held_out_languages(spark, texts):
    got = langid.op1_language_id(spark, MID).collect()
    assert len(got) == len(texts) and all(r.held_out == held(r.doc_id, 5) and 0 <= r.score <= 1 for r in got)
    aside = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == texts[r.doc_id].lang for r in aside]) > 0.97


def test_language_edge_rows(spark):
    rows = [*EDGE, (20, "12 34 !!"), (21, "wort und satz", None), (22, "der die das " * 20, "de"), (23, "the of and " * 20, "en"), (24, "ДЛЯ этого", "ru")]
    table = docs(spark, rows)
    out = langid.LanguageIdentifier(50).fit(table).predict(table, reject=False)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 20))
    assert got[22].lang_pred == "de" and got[24].lang_pred == "ru" and got[None].lang_pred in ("de", "en", "ru")
    assert langid.LanguageIdentifier().fit(table).predict(table.limit(0)).count() == 0
    nothing = langid.LanguageIdentifier().fit(table.limit(0)).predict(table)
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


# ------------------------------------------------------------ quality
def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    m = quality.FactorisationMachine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.FACTORS)))
    batch = [(np.array([3, 7, 7, 90]), np.array([quality.BUCKETS + 5, quality.BUCKETS + 40])), (np.array([], int), np.array([quality.BUCKETS]))]
    raw = m.raw(*m.flat(batch))[0]
    for (w, s), got in zip(batch, raw, strict=True):
        index, x = [*w, *s], [1 / max(len(w), 1)] * len(w) + [1] * len(s)
        pairs = sum(m.v[index[i]] @ m.v[index[j]] * x[i] * x[j] for i in range(len(index)) for j in range(i))
        assert abs(got - (0.3 + sum(m.w[i] * v for i, v in zip(index, x, strict=True)) + pairs)) < 1e-9


def test_held_out_quality(spark):
    got = quality.op8_quality(spark, MID).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    aside = [r for r in got if r.held_out and r.doc_id in labels]
    good, bad = ([r.score for r in aside if labels[r.doc_id] == q] for q in (1, 0))
    assert np.mean([[a > b for b in bad] for a in good]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)


def test_quality_edge_rows(spark):
    table = docs(spark, EDGE)
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (6, None), (None, 1), (7, 1)], "doc_id long, quality int")
    model = quality.QualityClassifier(rounds=2).fit(table, labels)
    out = model.score(table)
    assert out.count() == len(EDGE) and out.columns == [c for c in table.columns if c != "score"] + ["score", "predicted"]
    assert out.filter("score is null or score < 0 or score > 1").count() == 0
    assert model.score(table.limit(0)).count() == 0
    none = quality.QualityClassifier().fit(table, labels.limit(0)).score(table).collect()
    assert len({round(r.score, 6) for r in none}) == 1


# ------------------------------------------------------------ LM scoring
def base_scores(rows, folds=10):
    c = collections.Counter()
    for i, t in rows:
        if i is not None and not held(i, folds):
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    return c, n, {(i, t): sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), None]) for i, t in rows}


def test_base_scores_are_exact_and_the_model_is_better(spark, texts):
    rows = [(i, r.text) for i, r in texts.items()]
    c, n, base = base_scores(rows)
    got = maxent_lm.op4_lm_scoring(spark, MID).collect()
    assert len(got) == len(rows)
    for r in got:
        t = [*words(texts[r.doc_id].text), None]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(w in c for w in t), n, held(r.doc_id, 10))
        assert math.isclose(r.base_score, base[r.doc_id, texts[r.doc_id].text], rel_tol=1e-9)
    aside = [r for r in got if r.held_out]
    assert sum(r.score for r in aside) > sum(r.base_score for r in aside)


def test_words_beyond_the_sent_ones_are_looked_up(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "HEAD", 3)
    rows = [(i, t) for i, t in [(1, "a a a b b c d e"), (2, "a b new words d"), (3, ""), (4, "a c c c c")]]
    c, n, base = base_scores(rows)
    table = docs(spark, rows).select("doc_id", "text")
    model = maxent_lm.MaxEntLm().fit(table.filter(table.doc_id.isin([i for i, _ in rows if not held(i, 10)])))
    got = {r.doc_id: r for r in model.score(table).collect()}
    for i, t in rows:
        assert math.isclose(got[i].base_score, base[i, t], rel_tol=1e-9) and got[i].n_known == sum(w in c for w in [*words(t), None])


def test_softmax_sums_to_one():
    rng = np.random.default_rng(2)
    w = rng.normal(size=(1 << maxent_lm.ROWS_BITS, maxent_lm.CLASSES)).astype(np.float32)
    rows = rng.integers(0, 1 << maxent_lm.ROWS_BITS, (maxent_lm.FEATURES, 50)).astype(np.uint16)
    bias = rng.normal(size=maxent_lm.CLASSES).astype(np.float32)
    total = sum(np.exp(maxent_lm.log_choice(w, bias, rows, np.full(50, k))) for k in range(maxent_lm.CLASSES))
    assert np.allclose(total, 1, atol=1e-5)


def test_one_learning_step():
    rng = np.random.default_rng(4)
    w = rng.normal(size=(6, 5)).astype(np.float32)
    g, seen = np.full(6, 0.5, np.float32), np.zeros(6, np.int64)
    rows, target = rng.integers(0, 6, (2, 9)).astype(np.uint16), rng.integers(0, 5, 9)
    slope = np.zeros((6, 5))
    for j in range(9):
        z = w[rows[0, j]].astype(float) + w[rows[1, j]]
        e = np.exp(z) / np.exp(z).sum()
        e[target[j]] -= 1
        for r in rows[:, j]:
            slope[r] += e
    grown = 0.5 + (slope**2).mean(1)
    want = w - maxent_lm.RATE * slope / np.sqrt(grown)[:, None]
    maxent_lm.learn(w, g, seen, rows, np.zeros(5, np.float32), target)
    assert np.allclose(w, want, atol=1e-5) and np.allclose(g, grown, atol=1e-5) and seen.tolist() == [int((rows == r).sum()) for r in range(6)]


def test_scores_are_the_sum_of_their_factors(spark, texts):
    """Token by token in plain floats: class, group of the class, word of the group."""
    rows = [(i, r.text) for i, r in texts.items()][:60]
    table = docs(spark, rows).select("doc_id", "text", F.lit(1).alias("base"), F.lit(2).alias("known"), F.lit(3).alias("row"), F.lit(4).alias("rare"), F.lit(5).alias("more"), F.lit(6).alias("n_tokens"), F.lit(7).alias("score"))
    model = maxent_lm.MaxEntLm().fit(table)
    m, got = model.sent.value, {r.doc_id: r for r in model.score(table).collect()}
    assert got[rows[0][0]].row == 3 and got[rows[0][0]].base == 1 and got[rows[0][0]].rare == 4
    count = {r.h & (1 << 64) - 1: r.c for r in model.words.collect()}
    rank = dict(zip(m["lead"].tolist(), m["rank"].tolist()))
    part = lambda z, k: z[k] - math.log(sum(math.exp(x) for x in z))
    for i, text in rows[:12]:
        block = next(blocks(pa.array([text])))
        h, kind, bounds = maxent_lm.tokens(block)
        found = maxent_lm.contexts(h, bounds)
        total = 0.0
        for j, x in enumerate(h.tolist()):
            own = int(m["classes"][kind[j]])
            group = rank.get(x, maxent_lm.LEAD + (x >> (64 - maxent_lm.TAIL_BITS)))
            outer = sum(m["weights"][int(f[j]) >> (64 - maxent_lm.ROWS_BITS)].astype(float) for f in found) + m["bias"]
            inner = sum(m["words"][r].astype(float) for r in maxent_lm.word_rows(found, np.full(len(h), own))[:, j]) + m["prior"][own]
            total += (part(outer.tolist(), own) + part(inner.tolist(), group)) / math.log(10) + math.log10(count[x] + 0.1) - m["log_group"][own, group]
        assert math.isclose(got[i].score, total, rel_tol=1e-4), (i, got[i].score, total)


def test_texts_that_a_polynomial_confuses_are_told_apart(spark):
    rows = [(k, t) for k, t in enumerate(TWINS)]
    model = maxent_lm.MaxEntLm().fit(docs(spark, rows[:1]).select("doc_id", "text"))
    got = {r.doc_id: r.n_known for r in model.score(docs(spark, rows).select("doc_id", "text")).collect()}
    assert got == {k: 2 if k == 0 else 1 for k, _ in rows}


def test_context_tells_words_of_a_class_apart(spark):
    # Both words begin alike, so they share their class, and are equally frequent.
    rows = [(i, " ".join(["left stone right steel" if i % 2 else "right steel left stone"] * 50)) for i in range(40)]
    model = maxent_lm.MaxEntLm().fit(docs(spark, rows).select("doc_id", "text"))
    probes = docs(spark, [(1, "left stone"), (2, "left steel"), (3, "right steel"), (4, "right stone")]).select("doc_id", "text")
    got = {r.doc_id: r for r in model.score(probes).collect()}
    assert math.isclose(got[1].base_score, got[2].base_score)
    assert got[1].score > got[2].score + 0.25 and got[3].score > got[4].score + 0.25


def test_word_factor_sums_to_one(spark, texts):
    model = maxent_lm.MaxEntLm().fit(docs(spark, [(i, r.text) for i, r in texts.items()][:200]).select("doc_id", "text"))
    m = model.sent.value
    c = {r.h & (1 << 64) - 1: (m["classes"][r.affix], r.c) for r in model.words.collect()}
    h = np.array(list(c), np.uint64)
    mass = np.zeros_like(m["log_group"])
    np.add.at(mass, (np.array([k for k, _ in c.values()]), maxent_lm.word_groups(h, m["lead"], m["rank"])), [n + 0.1 for _, n in c.values()])
    mass[:, maxent_lm.LEAD :] += 0.1  # a word that was not seen
    some = mass > 0
    assert np.allclose(mass[some], 10 ** m["log_group"][some]) and (10 ** m["log_group"][~some] < 1e-8).all()


def test_lm_edge_rows(spark):
    table = docs(spark, EDGE)
    model = maxent_lm.MaxEntLm().fit(table.filter("doc_id is not null"))
    out = model.score(table)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(EDGE) and got[1].n_tokens == got[2].n_tokens == got[3].n_tokens == 1 and got[7].n_tokens == 40001
    assert model.score(table.limit(0)).count() == 0
    nothing = maxent_lm.MaxEntLm().fit(table.limit(0)).score(table).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in nothing)


def test_a_returned_text_goes_to_the_tasks_once_and_comes_back_in_runs(spark):
    """Rows keep their scores when they come back in several record batches, and a text of another type is still cast."""
    pick = random.Random(21)
    rows = [(k, " ".join(pick.choices(["alpha", "beta", "gamma", "delta"], k=3000))) for k in range(200)] + [(200, None), (201, "")]
    table = docs(spark, rows)
    model = quality.QualityClassifier().fit(table, spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int"))
    plan = lambda d: model.score(d)._jdf.queryExecution().optimizedPlan().toString()
    assert "Project [struct(doc_id" in plan(table.select("doc_id", "text"))
    scored = {r.doc_id: (r.text, r.score) for r in model.score(table.coalesce(1)).collect()}
    assert {k: t for k, (t, _) in scored.items()} == dict(rows)
    apart = {r.doc_id: r.score for r in model.score(table.selectExpr("doc_id", "cast(text as binary) text").coalesce(1)).collect()}
    assert apart == {k: s for k, (_, s) in scored.items()}
    batch = pa.record_batch([pa.array([{"text": t} for _, t in rows])], names=["rest"])
    sent = type("Sent", (), {"value": model.model.state()})
    out = list(quality._score(sent)([batch]))
    assert len(out) > 1 and [s for b in out for s in b.column(1).to_pylist()] == [scored[k][1] for k, _ in rows]
