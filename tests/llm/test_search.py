"""Decontamination and nearest neighbours."""

import random
import re

import numpy as np
import pyarrow as pa

from grantlens.llm import ann, decontaminate
from grantlens.llm.shared import Workspace, connected_components
from grantlens.llm.textblocks import NO_WORD, blocks
from llm_cases import EDGE, SF, docs


def plain(text):
    return " " + " ".join(re.findall(r"[^\W_]+", (text or "").lower())) + " "


def test_every_verbatim_item_is_found(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        texts = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
        items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
        want = {(i, k) for i, t in texts.items() for k, x in items.items() if x in t}
        got = {(r.doc_id, r.item_id) for r in decontaminate.op3_decontamination(spark, sf).collect()}
        assert want and got == want


def test_paraphrases_are_found_and_clean_texts_left(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(rng.randint(15, 150)) + ". " + text(8) + ".") for k in range(12)]
    rows, want = [], set()
    for k, t in items:
        w = t.split()
        near = [x for x in w if rng.random() > 0.1]
        for i in range(0, len(near), 12):
            near.insert(i, word())
        rows += [(2 * k, text(90) + " " + " ".join(near).upper() + "! " + text(70)), (2 * k + 1, text(300))]
        want.add((2 * k, k))
    got = {(r.doc_id, r.item_id) for r in decontaminate.Decontaminator().contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want


def accepted(item, text):
    """The check of one item by brute force over all regions of a text, without any retrieval before it."""
    cut = lambda t: [(m.group(), m.start()) for m in re.finditer("[0-9a-z\x80-\U0010ffff]+", t.lower())]
    own, t = cut(item), [w for w, _ in cut(text)]
    w = [x for x, _ in own]
    ends = [i for i, c in enumerate(item) if c in ".!?\n" and i < own[-1][1]]
    last = sum(at > ends[-1] for _, at in own) if ends else 0
    lcs, n = decontaminate.common_subsequence, len(w)
    room = -(-n * 96 // 64)
    for lo in range(0, len(t), 32):
        near = t[max(0, lo - 16) : lo + 80]
        if lcs(w, near) >= 0.75 * n:
            return True
        if last and any(lcs(w, near[a : a + room]) >= 0.5 * n and lcs(w[-last:], near[a : a + room]) >= 0.8 * last for a in range(max(1, len(near) - room + 1))):
            return True
    return False


def test_no_accepted_paraphrase_is_lost_when_the_rarest_words_are_replaced(spark):
    sf = "/root/testdata/sf0.01"
    clean = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    seen = {}
    for r in clean:
        for w in set(plain(r.text).split()):
            seen[w] = seen.get(w, 0) + 1
    rng = random.Random(7)
    planted = []
    for share in (0.25, 0.4):
        for k, text in items:
            words = re.findall(r"\w+|\W+", text)
            inner = [i for i, w in enumerate(words[: len(words) * 3 // 4]) if w.isalnum()]
            for i in sorted(inner, key=lambda i: seen.get(words[i].lower(), 0))[: int(share * len(plain(text).split()))]:
                words[i] = "".join(rng.choice("qwxzkv") for _ in range(7))
            around = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)) for n in (rng.randint(0, 90), 40)]
            planted.append((10**6 + len(planted), f"{around[0]}\n{''.join(words)}\n{around[1]}"))
    want = {(d, k) for d, t in planted for k, x in items if accepted(x, t)}
    table = spark.createDataFrame([(r.doc_id, r.text) for r in clean] + planted, "doc_id long, text string")
    found = decontaminate.Decontaminator().contaminated(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) > 60 and {(r.doc_id, r.item_id) for r in found if r.doc_id >= 10**6} == want


class Sent:
    """What the search gets, with a space of one dimension per term, for passages of words."""

    def __init__(self, words, weight):
        terms = np.unique(np.concatenate(words))
        rows = [np.searchsorted(terms, w) for w in words]
        latent = np.stack([np.bincount(r, minlength=len(terms)) * weight for r in rows]).astype(np.float32)
        n = np.array([len(w) for w in words])
        self.value = {"terms": terms, "weight": weight, "vectors": np.eye(len(terms), dtype=np.float32), "latent": latent, "words": words,
                      "items": np.arange(len(words)), "answer": np.zeros(len(words), np.int64), "unseen": np.zeros(len(words)),
                      "floor": decontaminate.floors(rows, weight, decontaminate.fewest(n, 0.75, 0.5))}


def test_candidates_are_those_that_the_space_retrieves():
    """Passages without their vectors are found by nothing: word counts alone name no candidates."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=40)) for _ in range(6)]
    words = [next(blocks(pa.array([t]))).words(NO_WORD)[0] for t in texts]
    batch = pa.record_batch([pa.array([10 * k for k in range(6)]), pa.array(texts)], names=["doc_id", "text"])
    found = lambda s: {(i, k) for b in decontaminate._search(s, (0.75, 0.5, 0.8))([batch]) for i, k in zip(b[0].to_pylist(), b[1].to_pylist())}
    whole = Sent(words, np.linspace(0.2, 8, 26))
    assert found(whole) == {(10 * k, k) for k in range(6)}
    whole.value["latent"][2] = 0
    assert found(whole) == {(10 * k, k) for k in range(6) if k != 2}


def test_no_region_with_enough_words_is_below_the_floor():
    """Regions with just the least of a passage's words in common, the lightest ones too, whatever else they hold."""
    rng = random.Random(9)
    weight = np.array([0.2, 0.2, 0.3, 1.0, 2.0, 5.0, 8.0, 11.0])
    for _ in range(300):
        own = [rng.randrange(8) for _ in range(rng.randint(1, 20))]
        least = int(decontaminate.fewest(np.array([len(own)]), 0.75, 0.5)[0])
        floor = decontaminate.floors([np.array(own)], weight, np.array([least]))[0]
        tf = np.bincount(own, minlength=8)
        picks = [sorted(own, key=lambda t: tf[t] * weight[t] ** 2)[:least], rng.sample(own, least), own]
        for region in picks + [x + [rng.randrange(8)] for x in picks]:
            assert (np.bincount(region, minlength=8) * tf * weight**2).sum() >= floor - 1e-9


def test_what_a_space_of_few_dimensions_leaves_out_is_known():
    terms = np.arange(5, dtype=np.uint64)
    table = [(0, [0, 1], [3.0, 4.0]), (1, [2, 4], [1.0, 2.0])]
    vectors = np.zeros((5, 2), np.float32)
    vectors[0, 0], vectors[1, 0], vectors[2, 1] = 0.6, 0.8, 1.0
    got = decontaminate.unseen(table, terms, vectors, np.array([[5.0, 0.0], [0.0, 1.0]], np.float32))
    assert np.allclose(got, [0, 2], atol=1e-6)


def test_decontamination_edge_rows(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "same row twice in here"), (3, "same row twice in here"), (None, "one"), (4, "...")], "item_id long, text string")
    d = decontaminate.Decontaminator()
    got = {(r.doc_id, r.item_id) for r in d.contaminated(docs(spark, EDGE), items).collect()}
    assert got == {(5, 3), (6, 3)}
    assert d.contaminated(docs(spark, EDGE).limit(0), items).count() == 0
    assert d.contaminated(docs(spark, EDGE), items.limit(0)).count() == 0


def test_randomised_svd_spans_the_rows(spark):
    rng = np.random.default_rng(3)
    dense = rng.normal(size=(12, 5)) @ rng.normal(size=(5, 40)) * (rng.random((12, 40)) < 2)
    rows = spark.createDataFrame([(i, list(range(100, 140)), x.tolist()) for i, x in enumerate(dense)], "row long, terms array<long>, values array<double>")
    got = decontaminate.LatentSpace(dimensions=8).fit(Workspace(spark, "test"), rows, "t").toPandas().sort_values("term")
    v = np.stack([np.frombuffer(x, np.float32) for x in got["vector"]])
    assert np.allclose(dense @ v @ v.T, dense, atol=1e-3) and np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-3)


def test_common_subsequence():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(5)
    for _ in range(100):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert decontaminate.common_subsequence(a, b) == slow(a, b)


def neighbours(rows, queries, k):
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
        out[q] = [(i, s) for s, i in sorted((s, i) for i, s in zip(ids, d.tolist(), strict=True) if i != q)[:k]]
    return out


def test_recall_against_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = neighbours(rows, [i for i, _ in rows if i % 100 == 0], 10)
    got = {}
    for r in ann.op10_permutation_ann(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9
    exact = {(q, i): s for q, v in want.items() for i, s in v}
    assert all(abs(s - exact[q, i]) < 1e-12 for q, v in got.items() for i, s in v if (q, i) in exact)


def test_vectors_that_take_no_part_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (200, None), (300, [0.0, 0.0]), (400, [nan, 1.0]), (500, [inf, 1.0]), (600, [1.0, None]), (700, [1.0]), (None, [1.0, 1.0])]
    rows += [(i, [1.0, 0.5]) for i in range(1, 30)] + [(1, [1.0, 0.5]), (50, [9.0, 9.0])]
    table = spark.createDataFrame([(i, v, 1, 0.1) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    index = ann.PermutationIndex(spark).build(table, 10)
    got = index.search(index.vectors.filter("vec_id % 100 = 0").selectExpr("vec_id as query_id", "vector")).orderBy("query_id", "rank").collect()
    clean = list({i: (i, v) for i, v in rows if i is not None and v and len(v) == 2 and None not in v and np.isfinite(v).all() and any(v)}.values())
    want = neighbours(clean, [0, 100], 10)
    assert {q: [(r.vec_id, r.score) for r in got if r.query_id == q] for q in (0, 100)} == want and len(got) == 20
    few = ann.PermutationIndex(spark).build(table.filter("vec_id in (0, 100, 50)"), 10)
    assert few.search(few.vectors.selectExpr("vec_id as query_id", "vector")).count() == 6
    none = ann.PermutationIndex(spark).build(table.limit(0), 10)
    assert none.search(none.vectors.selectExpr("vec_id as query_id", "vector")).count() == 0


def test_footrule_over_inverted_files():
    rng = np.random.default_rng(6)
    orders = np.stack([rng.permutation(9)[:4] for _ in range(30)]).astype(np.int16)
    got = ann.footrule(orders, orders[:5], 9)
    place = lambda o: {p: r for r, p in enumerate(o)}
    for q in range(5):
        a = place(orders[q])
        full = [sum(abs(a.get(p, 4) - place(o).get(p, 4)) for p in range(9)) for o in orders]
        assert len({f - g for f, g in zip(full, got[q], strict=True)}) == 1


def test_components_of_chains_and_stars(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(Workspace(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    top = lambda x: x if up.setdefault(x, x) == x else top(up[x])
    for a, b in edges:
        if a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    assert got == {x: top(x) for x in list(up)}
