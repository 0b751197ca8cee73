"""Periodic runs of words by an online sparse diagonal DP.

Method. Diagonal q of a text against itself holds the words that equal the word q places before. Going over the words in
order, a word's earlier occurrence increments the match length of its lag, and a diagonal that ends with length enough
emits its run there. A word may have very many earlier occurrences, but a run of smallest period q can only be seen by the
latest earlier occurrence of a window of at least q words: inside the run that occurrence lies exactly q before (an earlier
one would make a shorter period). So the lags of each length class, L/2 < q <= L for L = 1, 2, 4, ..., are taken from
windows of L words, and every word opens or extends at most one diagonal per class: n log n in all, for any text. Windows
get exact numbers by doubling (the pair of numbers of both halves), and words that no long enough stretch of repeated
windows covers leave the later classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .textblocks import Block, U, blocks, mix

LEAST = 6  # words of a run
TURNS = 4  # periods of a run


def stretches(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index into ``places`` (ascending) of each run of consecutive places."""
    cut = np.flatnonzero(np.diff(places) != 1)
    return np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(places) - 1]])


def find_runs(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) by text, start, period of some texts; ``words`` are 64-bit names of words, text d
    has those of bounds[d]:bounds[d + 1]. Starts count from the text's first word."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    code = mix(words + mix(text.astype(U)))  # a word of another text is another word
    place, size, out = np.arange(len(words)), 1, []
    while len(place):
        order = np.argsort(code, kind="stable")
        ordered, at = code[order], place[order]
        same = ordered[1:] == ordered[:-1]
        lag = np.zeros(len(place), np.int64)
        lag[order[1:][same]] = (at[1:] - at[:-1])[same]
        # Diagonals: consecutive words with the same lag. They end where the lag changes, and emit there.
        ends = np.flatnonzero((np.diff(lag) != 0) | (np.diff(place) != 1))
        first, last = np.concatenate([[0], ends + 1]), np.concatenate([ends, [len(place) - 1]])
        q = lag[first]
        length = last - first + size + q  # the diagonal's match length, and the period before it
        good = (q > size // 2) & (q <= size) & (length >= np.maximum(LEAST, TURNS * q))
        if good.any():
            start = place[first[good]] - q[good]
            out.append(np.stack([text[start], start - bounds[text[start]], length[good], q[good]], axis=1))
        # A run of a longer period has over (TURNS - 1) * size consecutive windows that repeat, earlier or later.
        again = lag > 0
        again[order[:-1][same]] = True
        held = np.flatnonzero(again)
        if not len(held):
            break
        a, b = stretches(place[held])
        keep = held[np.repeat(b - a + 1 > (TURNS - 1) * size, b - a + 1)]
        # The window of twice the size: its number is the pair of both halves' numbers.
        number = np.empty(len(place), np.int64)
        number[order] = np.cumsum(np.concatenate([[0], ~same]))
        second = np.searchsorted(place, place[keep] + size)
        ok = second < len(place)
        ok[ok] = place[second[ok]] == place[keep[ok]] + size
        keep, second = keep[ok], second[ok]
        inside = text[place[keep]] == text[place[second]]
        keep, second = keep[inside], second[inside]
        code = number[keep] * len(place) + number[second]
        place, size = place[keep], 2 * size
    if not out:
        return np.zeros((0, 4), np.int64)
    rows = np.concatenate(out)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def planted_order(n: int, h: int) -> np.ndarray | None:
    """The numbers of the words that stand for the n words of a text with mark ``h``, None where they stay: if h % 10 is 0,
    the words from a on repeat the first p of them (a and p by the rule of the query's contract)."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def _block_runs(block: Block, marks) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(runs, their edges by text, collapsed texts) of a block."""
    h, bounds, starts = block.words(lower=False)
    source = np.arange(len(h))
    for d, mark in enumerate(marks):
        order = None if mark is None else planted_order(int(bounds[d + 1] - bounds[d]), mark)
        if order is not None:
            source[bounds[d] : bounds[d + 1]] = bounds[d] + order
    runs = find_runs(h[source], bounds)
    # Words that a run contains after its first period go.
    change = np.zeros(len(h) + 1, np.int64)
    begin = bounds[runs[:, 0]] + runs[:, 1]
    np.add.at(change, begin + runs[:, 3], 1)
    np.add.at(change, begin + runs[:, 2], -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    offsets = np.concatenate([[0], np.cumsum(block.word_ends - starts)])
    inside = np.zeros(len(block.data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, block.word_ends, -1)
    letters = block.data[np.cumsum(inside[:-1]) > 0]
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(h), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(letters))])
    chosen = pa.LargeListArray.from_arrays(pa.array(np.searchsorted(kept, bounds)), every.take(pa.array(source[kept])))
    return runs, np.searchsorted(runs[:, 0], np.arange(block.docs + 1)), pc.binary_join(chosen, pa.scalar(b" ", pa.large_binary()))


def _find(digest: bool):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(1).to_pylist()
            for block in blocks(batch.column(0)):
                rest = batch.column(2).slice(block.first, block.docs)
                runs, edges, collapsed = _block_runs(block, marks[block.first : block.first + block.docs])
                counts = np.diff(edges)
                if not digest:
                    found = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], names=["start", "length", "period"])
                    lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), found)
                    yield pa.RecordBatch.from_arrays([rest, lists, collapsed.cast(pa.binary()).cast(pa.string())], names=["rest", "runs", "collapsed"])
                    continue
                # Greatest length, then smallest start and period: the first of each text in this order.
                best = np.lexsort((runs[:, 3], runs[:, 1], -runs[:, 2], runs[:, 0]))[edges[:-1][counts > 0]]
                top = np.full((block.docs, 3), -1, np.int64)
                top[counts > 0] = runs[best, 1:]
                columns = [pa.array(top[:, k], mask=counts == 0) for k in range(3)]
                exponent = pa.array(1000 * top[:, 1] // np.maximum(top[:, 2], 1), mask=counts == 0)
                said = [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs[a:b, 1:].tolist()).encode()).hexdigest() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                text = [hashlib.sha256(x.as_buffer()).hexdigest() for x in collapsed]
                yield pa.RecordBatch.from_arrays([rest, pa.array(counts), *columns, exponent, pa.array(said, pa.string()), pa.array(text, pa.string())],
                                                 names=["rest", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return run


def periodic_runs(docs: DataFrame, digest: bool = False, mark: Column | None = None) -> DataFrame:
    """The maximal periodic runs of every text: the columns of ``docs`` but text, as a struct ``rest``, then

    * ``runs`` (start, length, period of each, by start, then period) and ``collapsed`` (the words left when each run keeps
      its first period only, joined by one space);
    * or with ``digest`` n_runs, start, length, period, exponent_milli of the longest run and the SHA-256 of both.

    A run is a stretch of words with smallest period q and at least max(6, 4 q) words that no neighbour extends. Words are
    told apart by their letter case. With ``mark`` (long), texts are changed before by ``planted_order``.

    Defined results: a null, empty or white text has no words, no runs and an empty collapsed text; a null mark changes
    nothing; rows that repeat, or have no doc_id, each keep their row; other columns travel in ``rest`` under any name; an
    empty table gives an empty result. A text is one row, so it must fit a task.
    """
    rest = F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("rest")
    rows = docs.select(F.col("text").cast("string").alias("text"), (F.lit(None).cast("long") if mark is None else mark.cast("long")).alias("mark"), rest)
    if digest:
        names = [*((n, LongType()) for n in ("n_runs", "start", "length", "period", "exponent_milli")), *((n, StringType()) for n in ("runs_sha256", "collapsed_sha256"))]
    else:
        names = [("runs", ArrayType(StructType([StructField(n, LongType()) for n in ("start", "length", "period")]))), ("collapsed", StringType())]
    return rows.mapInArrow(_find(digest), StructType([rows.schema["rest"], *[StructField(*x) for x in names]]))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(docs, digest=True, mark=F.crc32(F.col("doc_id").cast("string").cast("binary")))
    return found.select("rest.doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


#: Every lag of every word, one by one: words that equal an earlier word of their text, their stretches per lag, the least
#: period of each stretch. The crc32 of the id is taken bit by bit.
ORACLE_SQL = r"""
WITH ids AS (SELECT doc_id, coalesce(text, '') AS text, CAST(doc_id AS VARCHAR) AS d FROM documents),
marked AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), range(0, 8 * length(d))),
      lambda c, i: CASE WHEN xor(c, CASE WHEN i % 8 = 0 THEN ord(substr(d, CAST(i // 8 + 1 AS INT), 1)) ELSE 0 END) & 1 = 1
        THEN xor(xor(c, CASE WHEN i % 8 = 0 THEN ord(substr(d, CAST(i // 8 + 1 AS INT), 1)) ELSE 0 END) >> 1, 3988292384)
        ELSE xor(c, CASE WHEN i % 8 = 0 THEN ord(substr(d, CAST(i // 8 + 1 AS INT), 1)) ELSE 0 END) >> 1 END), 4294967295) AS h
  FROM ids),
sized AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS t FROM marked),
given AS (SELECT doc_id, n, planted, a, 1 + (n - a) // t AS p, w, unnest(range(0, n)) AS i FROM sized),
words AS (SELECT doc_id, n, i, w[CAST(CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END + 1 AS INT)] AS x FROM given),
lags AS (SELECT s.doc_id, s.i, s.i - e.i AS q FROM words s JOIN words e ON s.doc_id = e.doc_id AND s.x = e.x AND e.i < s.i AND 4 * (s.i - e.i) <= s.n),
diagonals AS (SELECT doc_id, q, min(i) - q AS s, count(*) + q AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM lags) GROUP BY doc_id, q, g),
runs AS (SELECT doc_id, s, m, min(q) AS q FROM diagonals WHERE m >= 6 AND m >= 4 * q GROUP BY doc_id, s, m),
said AS (SELECT doc_id, count(*) AS n_runs, arg_min({'s': s, 'm': m, 'q': q}, {'m': -m, 's': s, 'q': q}) AS top, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS line FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.m AS length, top.q AS period, 1000 * top.m // top.q AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(line, '')) AS collapsed_sha256
FROM ids LEFT JOIN said USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
