"""D-2 without a given key: the minimal unique column combinations of a table.

Level by level: single columns, then pairs, then triples. A combination is
measured only if it can still be a minimal key, which earlier counts decide
exactly:

* it holds no smaller key;
* its distinct values can reach the number of rows: at most the product of
  the distinct values of its parts;
* no column in it follows from the others: if X and X with c have the same
  number of distinct values, c adds nothing to any combination holding X.

What is left is settled over all rows, from a 64-bit hash per column of a fixed
width (it is one-to-one there) and from two of any other:

* single columns are counted; repeated values collapse in the task before the
  shuffle, so a value that a third of all rows hold is one pair per task;
* of wider ones, two rows that agree prove that a combination is no key. Every
  task looks for such rows among its own, so most combinations never reach a
  shuffle;
* what no task refutes is counted among the rows that share their values of a
  counted part, where these are few (all other rows differ in that part);
* otherwise the rows are dealt by one of its columns, so that rows that agree
  meet in a task. One such shuffle settles all combinations that hold the
  column, however many they are. Only where a value has too many rows for a
  task, the combination is counted among all rows.

Only counts and the numbers of refuted combinations reach the driver.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, ByteType, DateType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType, TimestampNTZType, TimestampType

from grantlens.operators.checks import check_table_name
from grantlens.functions.validate import check_positive

Columns = tuple[int, ...]

BLOCK = 1 << 18  # rows that a task compares at a time
FEW = 200_000  # groups of rows that agree in a part, small enough to broadcast
MOST = 1 << 21  # rows that a task holds when they are dealt by a column
FIXED = (BooleanType, ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType, DateType, TimestampType, TimestampNTZType)


def _column(df: DataFrame, i: int) -> Column:
    return F.col("`" + df.columns[i].replace("`", "``") + "`")


def _folded(columns: list[np.ndarray], by: int) -> np.ndarray:
    """One 64-bit hash of several; another for another odd factor."""
    out = np.zeros(len(columns[0]), np.uint64)
    for h in columns:
        out = (out + h) * np.uint64(by)
        out ^= out >> np.uint64(32)
    return out


def _agree(columns: list[np.ndarray]) -> bool:
    """Whether two rows have the same values in all columns."""
    h = _folded(columns, 0x9E3779B97F4A7C15)
    order = np.sort(h)
    if not (order[1:] == order[:-1]).any():
        return False
    order = np.argsort(h)
    at = np.flatnonzero(h[order][1:] == h[order][:-1])
    g = _folded([c ^ np.uint64(0xD6E8FEB86659FD93) for c in reversed(columns)], 0xC2B2AE3D27D4EB4F)
    return bool((g[order[at]] == g[order[at + 1]]).any())


def _refuted(asked: list[Columns], columns: list[tuple[int, int]], block: int, most: int | None = None):
    """(n): the combinations that two rows of this task agree in, looked for ``block`` rows at a time; -1 where the task has over ``most`` rows.

    columns  the seed and column of each hash of a row
    """
    place = {i: [k for k, (_, x) in enumerate(columns) if x == i] for i in {i for c in asked for i in c}}

    def run(batches):
        left = dict(enumerate(asked))

        def look(rows: list[pa.RecordBatch]):
            table = pa.Table.from_batches(rows)
            h = [c.to_numpy().view(np.uint64) for c in table.columns]
            for some in (4096, len(h[0])):
                for n, c in list(left.items()):
                    if _agree([h[k][:some] for i in c for k in place[i]]):
                        del left[n]

        held, size, gone = [], 0, False
        for batch in batches:
            if left and not gone:
                held, size = [*held, batch], size + batch.num_rows
                gone = most is not None and size > most
                if size >= block or gone:
                    look(held)
                    held, size = [], 0
        if held and left:
            look(held)
        yield pa.record_batch([pa.array([-1] * gone + [n for n in range(len(asked)) if n not in left], pa.int32())], names=["n"])

    return run


class _Rows:
    """The rows of a table as two hashes a column, and the distinct values of its combinations counted so far."""

    def __init__(self, df: DataFrame, whole: list[int], count: int):
        self.whole, self.count, self.exact = whole, count, {}
        # xxhash64 of one value of up to 64 bits is one-to-one.
        self.columns = [(1, i) for i in whole] + [(2, i) for i in whole if not isinstance(df.schema.fields[i].dataType, FIXED)]
        self.hashes = df.select(*[F.xxhash64(F.lit(seed), _column(df, i)).alias(f"h{seed}_{i}") for seed, i in self.columns])

    def refuted(self, asked: list[Columns]) -> set[Columns]:
        found = self.hashes.mapInArrow(_refuted(asked, self.columns, BLOCK), "n int").distinct().collect()
        return {asked[r["n"]] for r in found}

    def keys(self, asked: list[Columns]) -> tuple[set[Columns], set[Columns]]:
        """Those that are keys, and those left open as a value of the column that they were dealt by has too many rows."""
        keys, still, unsettled = set(), set(asked), set()
        tasks = max(int(self.hashes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-self.count // BLOCK))
        while still:
            # The column that most of them hold, of those with values enough to go to all tasks evenly.
            even = {i for i in self.whole if self.exact[(i,)] >= 16 * tasks} or set(self.whole)
            by = max((i for c in still for i in c), key=lambda i: (i in even, sum(i in c for c in still), self.exact[(i,)]))
            some = sorted(c for c in still if by in c)
            columns = [(seed, i) for seed, i in self.columns if any(i in c for c in some)]
            rows = self.hashes.select(*[f"h{seed}_{i}" for seed, i in columns]).repartition(tasks, *self._key((by,)))
            found = {r["n"] for r in rows.mapInArrow(_refuted(some, columns, 2 * MOST, MOST), "n int").distinct().collect()}
            kept = {c for n, c in enumerate(some) if n not in found}
            (unsettled if -1 in found else keys).update(kept)
            still -= set(some)
        return keys, unsettled

    def _key(self, c: Columns) -> list[str]:
        return [f"h{seed}_{i}" for seed, i in self.columns if i in c]

    def _counted(self, rows: DataFrame, asked: list[Columns]) -> dict[Columns, int]:
        def two(key: list[str]) -> list[Column]:
            if len(key) == 1:
                return [F.col(key[0]).alias("h1"), F.lit(0).cast("bigint").alias("h2")]
            return [F.xxhash64(F.lit(seed), *map(F.col, key)).alias(f"h{seed}") for seed in (1, 2)]

        pairs = [F.struct(F.lit(n).alias("n"), *two(self._key(c))) for n, c in enumerate(asked)]
        got = rows.select(F.inline(F.array(*pairs))).distinct().groupBy("n").count().collect()
        return {**dict.fromkeys(asked, 0), **{asked[r["n"]]: r["count"] for r in got}}

    def distinct(self, asked: list[Columns]) -> dict[Columns, int]:
        """The distinct values of combinations, from the rows alike in a part of them where these are few; none for some that are no keys."""
        by_part: dict[Columns | None, list[Columns]] = {}
        for c in asked:
            parts = [x for x in combinations(c, len(c) - 1) if x in self.exact and self.count - self.exact[x] <= FEW]
            by_part.setdefault(max(parts, key=lambda x: self.exact[x], default=None), []).append(c)
        every, counts = by_part.pop(None, []), {}
        if every and len(every[0]) > 1:
            found, every = self.keys(every)
            counts = dict.fromkeys(found, self.count)
        if every:
            counts |= self._counted(self.hashes, sorted(every))
        for part, some in by_part.items():
            key = self._key(part)
            twice = self.hashes.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*key)
            alike = self.hashes.join(F.broadcast(twice), key, "left_semi").select(*self._key(tuple(sorted({i for c in some for i in c}))))
            alike = alike.persist()
            try:
                apart = self.count - alike.count()
                counts.update({c: n + apart for c, n in self._counted(alike, some).items()})
            finally:
                alike.unpersist()
        return counts


def _distinct(rows: _Rows, asked: list[Columns]) -> dict[Columns, int]:
    """The number of distinct rows (no nulls in them) over each combination of columns; none for combinations
    of several columns that two rows of a task agree in."""
    if not asked:
        return {}
    kept = asked
    if len(asked[0]) > 1:
        gone = rows.refuted(asked)
        kept = [c for c in asked if c not in gone]
    counts = rows.distinct(kept) if kept else {}
    rows.exact.update(counts)
    return counts


class _Bounds:
    """What the counts so far say about the distinct values of other combinations."""

    def __init__(self):
        self.exact: dict[Columns, int] = {}
        self.at_most: dict[Columns, int] = {}

    def add(self, asked: list[Columns], counts: dict[Columns, int], rows: int) -> None:
        """The counts of some of the asked combinations; the others are no keys of the ``rows``."""
        self.exact.update(counts)
        self.at_most.update({c: counts[c] if c in counts else min(self.at_most[c], rows - 1) for c in asked})

    def bound(self, c: Columns) -> int:
        """The most distinct values that ``c`` can have; its parts' bounds are known."""
        most = []
        for k in range(1, len(c) // 2 + 1):
            for part in combinations(c, k):
                most.append(self.at_most[part] * self.at_most[tuple(i for i in c if i not in part)])
        for x in c:
            rest = tuple(i for i in c if i != x)
            for k in range(1, len(rest)):
                for some in combinations(rest, k):
                    both = tuple(sorted((*some, x)))
                    if some in self.exact and self.exact[some] == self.exact.get(both):
                        most.append(self.at_most[rest])
        self.at_most[c] = min(most)
        return self.at_most[c]


def candidate_keys(df: DataFrame, table_name: str, width: int = 3) -> DataFrame:
    """(table_name, key_columns, n_columns): every minimal key of up to ``width`` columns.

    A key has no NULL and no value twice (as in ``primary_key_check``), so a
    column with a NULL is in no key; nor is a map, which has no equality. In a
    table without rows or with one, every column is a key. Columns are named
    in the table's order, joined by commas.
    """
    check_table_name(table_name)
    check_positive(width, "width")
    every = [i for i, f in enumerate(df.schema.fields) if not isinstance(f.dataType, MapType)]
    filled = df.agg(F.count(F.lit(1)), *[F.count(_column(df, i)) for i in every]).first()
    rows, whole = filled[0], [i for i, n in zip(every, filled[1:]) if n == filled[0]]
    bounds, found = _Bounds(), []
    table = _Rows(df, whole, rows)
    for size in range(1, width + 1):
        asked = [c for c in combinations(whole, size) if size == 1 or bounds.bound(c) >= rows]
        asked = [c for c in asked if not any(set(k) <= set(c) for k in found)]
        counts = _distinct(table, asked)
        bounds.add(asked, counts, rows)
        found += [c for c in asked if counts.get(c) == rows]
    names = [(table_name, ",".join(df.columns[i] for i in c), len(c)) for c in found]
    return df.sparkSession.createDataFrame(names, "table_name string, key_columns string, n_columns int")
