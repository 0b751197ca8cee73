"""Combinations that no task refutes are settled by one shuffle for all that hold a column."""

import random

from grantlens.operators import keys
from grantlens.operators.keys import candidate_keys


def sparse(spark, n=3000):
    """Rows in which few combinations agree, and only far from each other."""
    rng = random.Random(9)
    rows = [(i // 3, f"p{rng.randrange(200)}", rng.randrange(300) / 8, rng.randrange(80), rng.randrange(50)) for i in range(n)]
    rows[-1] = (rows[-1][0], *rows[0][1:])
    return spark.createDataFrame(rows, "o long, p string, x double, s int, q short").repartitionByRange(4, "o")


def test_one_shuffle_settles_all_combinations_with_a_column(spark, monkeypatch):
    df = sparse(spark)
    monkeypatch.setattr(keys, "FEW", 0)
    with monkeypatch.context() as m:
        m.setattr(keys._Rows, "keys", lambda self, asked: (set(), set(asked)))
        want = [tuple(r) for r in candidate_keys(df, "t").collect()]
    counted = []
    real = keys._Rows._counted
    monkeypatch.setattr(keys._Rows, "_counted", lambda self, rows, asked: counted.extend(asked) or real(self, rows, asked))
    got = [tuple(r) for r in candidate_keys(df, "t").collect()]
    assert got == want and any("," in r[1] for r in got) and all(len(c) == 1 for c in counted)


def test_a_value_with_too_many_rows_is_counted(spark, monkeypatch):
    df = sparse(spark)
    want = [tuple(r) for r in candidate_keys(df, "t").collect()]
    monkeypatch.setattr(keys, "MOST", 5)
    monkeypatch.setattr(keys, "FEW", 0)
    assert [tuple(r) for r in candidate_keys(df, "t").collect()] == want


def test_fixed_columns_have_one_hash(spark):
    rows = keys._Rows(sparse(spark), [0, 1, 2, 3, 4], 3000)
    assert rows.columns == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 1)] and rows._key((0, 1)) == ["h1_0", "h1_1", "h2_1"]
