import itertools
import random

from grantlens.llm.ngram_join import JaccardJoin, near_duplicate_classes, op2_ngram_jaccard
from llm_cases import EDGE, SF, TWINS, docs, words


def brute(rows, k, percent):
    """doc_id -> (set size, class) by all pairs."""
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}


def copies(seed):
    """Groups of copies with few and many edits, a passage that most share, texts of one to three words."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnop"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(25))
    rows = []
    for g in range(8):
        base = [word() for _ in range(rng.choice([3, 20, 60, 150]))]
        for _ in range(rng.randint(1, 25)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                own = own[: max(1, len(own) - rng.randint(0, len(own) // 8 + 1))]
            text = " ".join(own) + (" " + passage if rng.random() < 0.4 else "")
            rows.append((len(rows), text.upper() if rng.random() < 0.1 else text))
    return rows + [(1000 + i, t) for i, t in enumerate(["one", "One", "two words", "two words", "three words here", ""])]


def test_classes_equal_all_pairs(spark):
    for seed, k, percent in ((1, 4, 85), (2, 5, 80)):
        rows = copies(seed)
        want = brute(rows, k, percent)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in JaccardJoin(k, percent).classes(docs(spark, rows)).collect()}
        assert got == want
        assert len({c for _, c in want.values()}) < len(rows)


def test_edge_rows(spark):
    got = JaccardJoin(4, 85).classes(docs(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    by = {r.doc_id: r for r in got}
    assert [by[i].n_shingles for i in (1, 2, 3)] == [0, 0, 0] and [by[i].component_id for i in (1, 2, 3)] == [1, 2, 3]
    assert by[None].component_id is None and by[None].n_shingles == 3
    assert by[6].component_id == by[5].component_id == 5 and by[5].copies == 3
    assert (by[7].n_shingles, by[8].n_shingles, by[7].component_id, by[8].component_id) == (5, 6, 7, 8)  # 5 of 6 is below 85 %
    assert by[-3].component_id == -3


def test_empty_table(spark):
    out = near_duplicate_classes(docs(spark, EDGE).limit(0))
    assert out.count() == 0 and out.columns == ["doc_id", "n_shingles", "component_id", "copies"]


def test_registered_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op2_ngram_jaccard(spark, SF).collect()}
    assert got == brute(rows, 4, 85)


def test_words_that_a_polynomial_confuses_are_not_linked(spark):
    rows = [(k + 1, t) for k, t in enumerate([*TWINS, TWINS[0]])]
    got = {r.doc_id: r.component_id for r in JaccardJoin(words=4, percent=85).classes(docs(spark, rows)).collect()}
    assert got == {i: i if i < len(rows) else 1 for i, _ in rows}
