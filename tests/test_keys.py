"""Minimal keys found level by level equal those of trying every combination."""

import random
from itertools import combinations

import pytest

from grantlens.operators import keys
from grantlens.operators.keys import candidate_keys


def brute(columns, rows, width):
    found = []
    for k in range(1, width + 1):
        for c in combinations(range(len(columns)), k):
            values = [tuple(r[i] for i in c) for r in rows]
            if any(set(f) <= set(c) for f in found) or any(None in v for v in values) or len(set(values)) < len(rows):
                continue
            found.append(c)
    return sorted((",".join(columns[i] for i in c), len(c)) for c in found)


def check(spark, columns, types, rows, width):
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` {t}" for c, t in zip(columns, types)))
    got = candidate_keys(df, "t", width).collect()
    assert sorted((r.key_columns, r.n_columns) for r in got) == brute(columns, rows, width) and all(r.table_name == "t" for r in got)
    return got


def test_random_tables(spark):
    rng = random.Random(9)
    for case in range(6):
        n = rng.choice((6, 20, 40))
        rows = []
        for i in range(n):
            a, b = rng.randrange(4), rng.randrange(n // 2)
            # c follows from a, e repeats b; d has a null in some tables
            rows.append((a, b, f"c{a}", None if case % 3 == 0 and i == 2 else rng.randrange(5), str(b), rng.choice("xy")))
        check(spark, ["a", "b", "c", "d", "e", "f"], ["int", "int", "string", "int", "string", "string"], rows, 4)


def test_pruned_combinations_are_not_counted(spark, monkeypatch):
    asked = []
    count = keys._distinct
    monkeypatch.setattr(keys, "_distinct", lambda df, c: asked.append(len(c)) or count(df, c))
    rows = [(i % 10, i // 10, (i % 10) * 2, "x") for i in range(100)]
    got = check(spark, ["a", "b", "twice.a", "one"], ["int", "int", "int", "string"], rows, 3)
    assert len(got) == 2
    assert asked == [4, 3, 0]  # "one" reaches no pair; the third pair (a, twice.a) is no key, and no triple is minimal


def test_edges(spark):
    check(spark, ["a", "b"], ["int", "string"], [], 2)
    check(spark, ["a", "b"], ["int", "string"], [(1, "x")], 2)
    check(spark, ["a", "b"], ["int", "string"], [(None, None)], 2)
    check(spark, ["a", "b"], ["int", "string"], [(1, "x"), (1, "x")], 2)
    check(spark, ["a", "b"], ["string", "string"], [("ab", "c"), ("a", "bc"), ("ab", "bc")], 2)
    maps = spark.createDataFrame([({"k": 1}, 1), ({"k": 1}, 2)], "m map<string,int>, a int")
    assert [r.key_columns for r in candidate_keys(maps, "t").collect()] == ["a"]
    for bad in (0, -1, 1.5):
        with pytest.raises(ValueError):
            candidate_keys(maps, "t", bad)


def test_only_combinations_that_no_task_refutes_are_counted(spark, monkeypatch):
    counted = []
    count = keys._Rows.distinct
    monkeypatch.setattr(keys._Rows, "distinct", lambda self, c: counted.extend(x for x in c if len(x) > 1) or count(self, c))
    # (a, b, c) is the key; of the pairs only (a, b) has no repetition among the rows of one task.
    rows = [(i // 2 % 16, i // 2 // 16 if i < 254 or i > 255 else 0, i % 2 if i < 256 else 2 + i % 2) for i in range(512)]
    for parts, block in ((1, 1 << 18), (4, 32)):
        monkeypatch.setattr(keys, "BLOCK", block)
        df = spark.createDataFrame(rows, "a int, b int, c int").repartitionByRange(parts, "b", "a")
        got = sorted((r.key_columns, r.n_columns) for r in candidate_keys(df, "t").collect())
        assert got == brute(["a", "b", "c"], rows, 3)
        assert len(counted) < 4  # of three pairs and a triple
        counted.clear()


def test_combinations_counted_among_alike_rows(spark, monkeypatch):
    rng = random.Random(4)
    # Two rows agree in (a, b), in different tasks; some third columns tell them apart.
    rows = [(i, i * 7 % 97, i % 5, i % 3) for i in range(97)] + [(i % 97, (i * 7 + 1 + i // 97) % 97, i % 5, i % 3) for i in range(97, 400)]
    rows += [(rows[3][0], rows[3][1], 4, rows[3][3])]
    rng.shuffle(rows)
    for few in (200_000, -1):
        monkeypatch.setattr(keys, "FEW", few)
        monkeypatch.setattr(keys._Rows, "refuted", lambda self, asked: set())
        check(spark, ["a", "b", "c", "d"], ["int", "int", "int", "int"], rows, 4)
