import collections
import random
import re

import numpy as np

from grantlens.llm.divergence import divergence, intersect, op12_source_divergence, probability, runs_of
from llm_cases import EDGE, LOWER, SF, docs

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least=3, top=200):
    """rows of (text, lang, source)"""
    rows = [tuple(x or "" for x in r) for r in rows]
    held, seen, groups = collections.Counter(), collections.Counter(), {(la, so) for _, la, so in rows}
    for text, lang, source in rows:
        terms = TERM.findall(text.translate(LOWER))
        held.update((lang, t) for t in set(terms))
        seen.update((lang, source, t) for t in terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (la, t), n in held.items() if la == lang and n >= least)
        sources = sorted(s for la, s in groups if la == lang)
        count = {s: [seen[lang, s, t] for t in kept] for s in sources}
        every = [sum(c) for c in zip(*count.values())] if kept else []
        prob = lambda c: [1 + 10**9 * (x + 1) // (sum(c) + len(kept)) for x in c]
        p, q = {s: prob(c) for s, c in count.items()}, prob(every)
        for s in sources:
            far = [(sum((x - y) ** 2 // y for x, y in zip(p[s], p[o])), o) for o in sources if o != s]
            near = [((x - y) ** 2 // y, t) for x, y, t, c in zip(p[s], q, kept, count[s]) if c and x > y]
            for part, found in (("pair", far), ("term", near)):
                ranked = sorted(found, key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def test_runs_and_their_pieces():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 40)
        edges = np.cumsum([0, *(rng.randint(1, 5) for _ in range(n))])
        a, b = (np.array([rng.randint(0, 2) for _ in range(n)]) for _ in range(2))
        length, x, y = intersect(runs_of(a, edges), runs_of(b, edges))
        wide = lambda v: np.repeat(v, np.diff(edges)).tolist()
        assert np.repeat(x, length).tolist() == wide(a) and np.repeat(y, length).tolist() == wide(b)
        assert len(length) <= 1 + sum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))


def test_probability_is_exact_beyond_a_long():
    for total in (1, 7, 10**9 + 7, 2**53 - 111):
        counts = np.array([0, total // 3, max(total - 2, 0), total - 1])
        assert probability(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


def test_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["É", "é", "日本", "A", "a"]
    rows = [(" ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 40))), rng.choice(["en", "de", None, ""]), rng.choice(["s", "t", "u", None, "é"])) for _ in range(150)]
    rows += [(None, "en", "empty"), ("", "xx", "only"), ("one two", "yy", "p"), ("three", "yy", "q"), ("same same x3y", "en", "s"), ("same same x3y", "en", "s")]
    rows += [("third of all rows " * 3, "en", "hot")] * 80
    table = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("text", "lang", "source", "1 AS n", "'x' AS term", "2 AS docs", "3 AS rank", "4 AS s")
    assert rows_of(divergence(table)) == brute(rows)
    assert rows_of(divergence(table, least=1, top=3)) == brute(rows, 1, 3)


def test_edge_rows(spark):
    table = docs(spark, EDGE)
    assert rows_of(divergence(table, least=1)) == brute([(t, "en", "s") for _, t in EDGE], 1)
    assert divergence(table.limit(0)).count() == 0


def test_registered_query(spark):
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(op12_source_divergence(spark, SF)) == brute(rows)
