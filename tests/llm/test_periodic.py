import hashlib
import random
import re
import zlib

import numpy as np

from grantlens.llm.periodic import find_runs, op11_periodic_runs, periodic_runs, planted_order
from llm_cases import EDGE, LONG, SF, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute(w):
    """(start, length, period) by trying every lag at every word."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i - q, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(w):
    gone = {i for s, n, q in brute(w) for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_equal_every_lag_tried():
    rng = random.Random(7)
    for _ in range(1500):
        texts = [[x for _ in range(rng.randint(0, 6)) for x in ([rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 9))] * rng.randint(1, 9))[: rng.randint(0, 60)]]
                 for _ in range(rng.randint(1, 4))]
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in texts])])
        got = find_runs(np.array([x for w in texts for x in w], np.uint64), bounds)
        assert [tuple(r) for r in got.tolist()] == [(d, *r) for d, w in enumerate(texts) for r in brute(w)]


def test_one_word_a_hundred_thousand_times():
    assert find_runs(np.zeros(100_000, np.uint64), np.array([0, 100_000])).tolist() == [[0, 0, 100_000, 1]]


def test_planted_words():
    for n, h in ((7, 0), (30, 120), (100, 98760), (5, 3), (0, 0)):
        order = planted_order(n, h)
        if h % 10 or not n:
            assert order is None
            continue
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        assert order.tolist() == [i if i < a else a + (i - a) % p for i in range(n)]


def test_edge_rows(spark):
    rows = [*EDGE, (30, "a b " * 9 + "a c"), (31, "x " * 5), (32, "x " * 6), (33, "X x " * 4), (34, "é  " * 8 + "\x00 é"), (None, "z z z z z z z y")]
    got = sorted(((r.rest.doc_id, [tuple(x) for x in r.runs], r.collapsed, r.rest.n, r.rest.rest) for r in periodic_runs(docs(spark, rows)).collect()), key=str)
    small = [(i, t) for i, t in rows if t is None or len(t) < len(LONG)]
    want = [(i, brute(WORD.findall(t or "")), collapsed(WORD.findall(t or "")), 1, "x") for i, t in small]
    n = len(LONG.split())
    want += [(7, [(0, n, 5)], LONG[:26], 1, "x"), (8, [(0, n, 5)], LONG[:26] + " x", 1, "x")]
    assert got == sorted(want, key=str)
    assert periodic_runs(docs(spark, rows).limit(0)).count() == 0 and periodic_runs(docs(spark, rows).limit(0), digest=True).count() == 0


def test_registered_query(spark):
    got = {r.doc_id: tuple(r)[1:] for r in op11_periodic_runs(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(got) == set(texts)
    planted = 0
    for i, t in texts.items():
        w = WORD.findall(t or "")
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            planted += 1
            w = [w[k] for k in planted_order(len(w), h)]
        if len(w) > 1500:
            continue
        runs = brute(w)
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        assert got[i] == (len(runs), s, n, q, 1000 * n // q if runs else None, SHA("".join(f"{s},{n},{q}\n" for s, n, q in runs)), SHA(collapsed(w)))
    assert planted
