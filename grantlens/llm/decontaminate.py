"""Benchmark decontamination by latent semantic retrieval.

Method. Benchmark items become passages of at most ``WINDOW`` words. Document frequencies of their terms are counted over
all documents (one scan), which gives TF-IDF rows. A randomised SVD of these rows (``LatentSpace``: Gaussian sketch, one power
iteration, Gram matrices summed over partitions; rows and terms stay distributed, only matrices of the sketch's size reach
the driver) yields a vector per term. A second scan projects overlapping regions of every document into the space and
retrieves the pairs whose projections meet the passage's ``floor``: the least product that a region with ``PART`` of the
passage's words has, whichever words these are, less what projection and rounding can take. So none is lost however rare the
words are that a paraphrase replaced. Of the pairs retrieved, those with ``PART`` of the words in common, over all terms and in
any order, are checked by the longest common subsequence of words, which paraphrases with changed, added or dropped words
keep in large part, and by an answer check: with a middling share, the item's last sentence must be there, and both within a stretch of one and a half times the
passage's length (an item of function words alone has half its words in order somewhere in many clean regions). The space also
gives each pair found its cosine and the share of the passage that the window's projection covers.

Passages go in slabs of about ``SLAB``, no more than the dimensions of the space, so that every passage of a slab is
represented; a task holds at most SLAB * WINDOW vectors of DIMENSIONS floats (16 MB), twice, and SLAB * WINDOW rows of SLAB
bit masks (26 MB).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace
from .textblocks import NO_WORD, U, blocks, longs, mix, trimmed

WINDOW = 64
STRIDE = 32
SLAB = 224
DIMENSIONS = 256
SHARE = 0.75  # of the passage's words in common order: contaminated
PART = 0.5  # the same if the answer is there
ANSWER = 0.8
ROUNDING = 3e-5  # of sums of WINDOW + STRIDE vectors and products over DIMENSIONS in single precision, at worst


def _passages(batches):
    """(item_id, words, answer): word hashes of each passage; answer: how many of the last words are the item's last sentence."""
    for batch in batches:
        ids, words, answers = [], [], []
        for block in blocks(batch.column(1)):
            h, bounds, starts = block.words(NO_WORD)
            stops = np.isin(block.data, np.frombuffer(b".!?\n", np.uint8))
            for d in range(block.docs):
                a, b = int(bounds[d]), int(bounds[d + 1])
                if a == b:
                    continue
                ends = np.flatnonzero(stops[block.offsets[d] : starts[b - 1]]) + block.offsets[d]
                last = int(b - np.searchsorted(starts[a:b], ends[-1]) - a) if len(ends) else 0
                for at in range(a, max(b - STRIDE, a + 1), STRIDE) if b - a > WINDOW else [a]:
                    to = min(at + WINDOW, b)
                    ids.append(batch.column(0)[block.first + d].as_py())
                    words.append(h[at:to].view(np.int64))
                    answers.append(min(last, to - at) if to == b else 0)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(answers, pa.int64())], names=["item_id", "words", "answer"])


class TermIndex:
    """Sorted term hashes with a bitmap of their first 22 bits: most words of a corpus are told apart by one look."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(terms >> U(42)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, terms): where words of the index stand and which they are."""
        at = np.flatnonzero(self.bits[(h >> U(42)).astype(np.int64)])
        if not len(at):
            return at, at
        k = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        same = self.terms[k] == h[at]
        return at[same], k[same]


def _frequencies(sent):
    """Documents that hold each term: one row of (term, n) per term and task."""

    def run(batches):
        index = TermIndex(sent.value)
        total = np.zeros(len(index.terms), np.int64)
        docs = 0
        for batch in batches:
            docs += batch.num_rows
            for block in blocks(batch.column(0)):
                h, bounds, _ = block.words(NO_WORD)
                at, term = index.find(h)
                doc = np.searchsorted(bounds, at, "right") - 1
                total += np.bincount(np.unique(doc * len(total) + term) % max(len(total), 1), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(total[some], docs), pa.int64())], names=["term", "n"])

    return run


def gaussian(terms: np.ndarray, columns: int) -> np.ndarray:
    """The rows of a fixed Gaussian matrix that belong to these terms, from hashes alone (Box-Muller)."""
    j = np.arange(columns, dtype=U)[None]
    one, two = (((mix(mix(terms[:, None] + U(s)) + j * U(0x9E3779B97F4A7C15)) >> U(11)).astype(np.float64) + 0.5) / 2**53 for s in (1, 2))
    return np.sqrt(-2 * np.log(one)) * np.cos(2 * np.pi * two)


class LatentSpace:
    """Randomised SVD of sparse rows (row long, terms array<long>, values array<double>) held by Spark.

    ``fit`` gives ``vectors``: (term, vector), the right singular vectors by term. Sums over partitions are matrices of the
    sketch's size; the term side is aggregated by a shuffle on the term.
    """

    def __init__(self, dimensions: int = DIMENSIONS, power: int = 1):
        self.dimensions, self.power = dimensions, power

    def fit(self, space: Workspace, rows: DataFrame, name: str) -> DataFrame:
        width = max(1, min(self.dimensions, rows.count()))
        sketch = space.store(rows.mapInArrow(_sketch(width), "terms array<long>, values array<double>, y binary"), f"{name}-y0")
        for p in range(self.power + 1):
            white = _whitener(sketch.select("y").mapInArrow(_gram("y", width), "gram binary").collect(), width)
            width = white.shape[1]  # the rank found
            back = sketch.mapInArrow(_back(white), "term long, b binary").repartition("term").mapInArrow(_sum_terms, "term long, b binary")
            back = space.store(back, f"{name}-b{p}")
            if p < self.power:
                # Y = A Bt, row by row: the rows' terms meet their vectors by a join.
                flat = rows.select("row", F.arrays_zip("terms", "values").alias("z")).select("row", F.explode("z").alias("z")).select("row", F.col("z.terms").alias("term"), F.col("z.values").alias("value"))
                y = flat.join(back, "term").repartition("row").select("row", "value", "b").mapInArrow(_sum_rows, "row long, y binary")
                sketch = space.store(rows.join(y, "row").select("terms", "values", "y"), f"{name}-y{p + 1}")
        gram = sum(np.frombuffer(x["gram"]).reshape(width, width) for x in back.select("b").mapInArrow(_gram("b", width), "gram binary").collect())
        value, vector = np.linalg.eigh(gram)
        keep = value > max(value.max(), 1e-300) * 1e-9
        turn = vector[:, keep] / np.sqrt(value[keep])
        return back.mapInArrow(_turn(turn), "term long, vector binary")


def _sketch(l: int):
    def run(batches):
        for batch in batches:
            out = []
            for t, v in zip(batch.column(1), batch.column(2), strict=True):
                terms = t.values.to_numpy(zero_copy_only=False).view(U)
                out.append((v.values.to_numpy(zero_copy_only=False) @ gaussian(terms, l)).tobytes())
            yield pa.record_batch([batch.column(1), batch.column(2), pa.array(out, pa.binary())], names=["terms", "values", "y"])

    return run


def _gram(column: str, l: int):
    def run(batches):
        total = np.zeros((l, l))
        for batch in batches:
            y = np.array([np.frombuffer(x.as_py()) for x in batch.column(0)]).reshape(-1, l)
            total += y.T @ y
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["gram"])

    return run


def _whitener(grams, l: int) -> np.ndarray:
    value, vector = np.linalg.eigh(sum(np.frombuffer(x["gram"]).reshape(l, l) for x in grams))
    keep = value > max(value.max(), 1e-300) * 1e-12
    return vector[:, keep] / np.sqrt(value[keep])


def _add_up(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    names, at = np.unique(keys[order], return_index=True)
    return names, np.add.reduceat(rows[order], at, axis=0)


def _back(white: np.ndarray):
    """B = Qt A by term, summed within the batch; Q = Y white."""

    def run(batches):
        for batch in batches:
            keys, rows = [], []
            for t, v, y in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                q = np.frombuffer(y.as_py()) @ white
                keys.append(t.values.to_numpy(zero_copy_only=False))
                rows.append(v.values.to_numpy(zero_copy_only=False)[:, None] * q[None])
            if keys:
                names, sums = _add_up(np.concatenate(keys), np.concatenate(rows))
                yield pa.record_batch([pa.array(names), pa.array([x.tobytes() for x in sums], pa.binary())], names=["term", "b"])

    return run


def _sum_terms(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for t, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(b)
            held[t] = held[t] + x if t in held else x
    yield pa.record_batch([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["term", "b"])


def _sum_rows(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for r, v, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            x = v * np.frombuffer(b)
            held[r] = held[r] + x if r in held else x
    yield pa.record_batch([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["row", "y"])


def _turn(turn: np.ndarray):
    def run(batches):
        for batch in batches:
            out = [(np.frombuffer(b.as_py()) @ turn).astype(np.float32).tobytes() for b in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["term", "vector"])

    return run


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if x in masks:
            u = v & masks[x]
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Passages:
    """The passages of a slab by term, for many regions of a document at once.

    ``counts`` has a row per (term, k): 1 where the passage holds the term more than k times, so the entries of a region's words,
    each with the number of its repetition, add up to the words that region and passage have in common. ``masks`` has the
    term's places in each passage as bits. The last row of both is that of other words.
    """

    def __init__(self, terms: np.ndarray, words: list[np.ndarray]):
        n = len(words)
        times = np.zeros((len(terms) + 1, n), np.uint8)
        self.masks = np.zeros((len(terms) + 1, n), U)
        for p, w in enumerate(words):
            t = np.searchsorted(terms, w)
            np.add.at(times[:, p], t, 1)
            np.bitwise_or.at(self.masks[:, p], t, U(1) << np.arange(len(w), dtype=U))
        self.most = times.max(1, initial=0).astype(np.int64)  # 0 for other words
        self.first = np.concatenate([[0], np.cumsum(self.most[:-1])])
        self.counts = np.zeros((int(self.most.sum()) + 1, n), np.uint8)
        for k in range(int(self.most.max(initial=0))):
            some = np.flatnonzero(self.most > k)
            self.counts[self.first[some] + k] = times[some] > k
        self.length = np.array([len(w) for w in words], np.int64)
        self.full = (U(1) << (self.length - 1).astype(U)) * U(2) - U(1)

    def earlier(self, term: np.ndarray) -> list[np.ndarray]:
        """[k]: the position of the same term's k + 1 st last occurrence before each word, -1 without one."""
        order = np.argsort(term, kind="stable")
        out = []
        for k in range(1, int(self.most.max(initial=0)) + 1):
            before = np.full(len(term), -1)
            same = term[order[k:]] == term[order[:-k]]
            before[order[k:][same]] = order[:-k][same]
            out.append(before)
        return out

    def common(self, term: np.ndarray, earlier: list[np.ndarray], place: np.ndarray, near: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Of each pair of region ``near`` and passage ``p`` the words in common, repeated ones as often as both have them;
        ``place``: the regions' positions in ``term``, of the last entry (another word) behind a region's end."""
        kind = term[place]
        row = self.first[kind]
        region, at = np.nonzero(self.most[kind] > 0)
        for k, before in enumerate(earlier):
            again = before[place[region, at]] >= place[region, 0]
            region, at = region[again], at[again]
            if not len(region):
                break
            gone = self.most[kind[region, at]] <= k + 1
            row[region, at] += 1
            row[region[gone], at[gone]] = len(self.counts) - 1
            region, at = region[~gone], at[~gone]
        row[self.most[kind] == 0] = len(self.counts) - 1
        total = np.zeros(len(near), np.uint8)
        for column in row.T:
            total += self.counts[column[near], p]
        return total

    def in_order(self, kind: np.ndarray, p: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
        """Longest common subsequence of each row of ``kind`` with passage ``p``, or with its ``last`` words only."""
        full = self.full[p]
        if last is not None:
            full = full & ~((U(1) << (self.length[p] - last).astype(U)) - U(1))
        v = full.copy()
        for column in kind.T:
            u = v & self.masks[column, p]
            v = ((v + u) | (v - u)) & full
        return (np.bitwise_count(full) - np.bitwise_count(v)).astype(np.int64)

    def close_together(self, kind: np.ndarray, p: np.ndarray, last: np.ndarray, part: float, answer: float) -> np.ndarray:
        """Whether ``part`` of the passage and ``answer`` of its ``last`` words stand in one stretch of the region that is as
        long, for the passage's length, as a region is for a full passage."""
        out = np.zeros(len(p), bool)
        span = kind.shape[1]
        for a in range(0, len(p), 256):
            room = np.minimum(-(-self.length[p[a : a + 256]] * span // WINDOW), span)
            pair, start = np.nonzero(np.arange(span)[None] <= (span - room)[:, None])
            j = np.arange(span)[None]
            words = np.where((j >= start[:, None]) & (j < (start + room[pair])[:, None]), kind[a + pair], len(self.masks) - 1)
            q = p[a + pair]
            both = (self.in_order(words, q) >= part * self.length[q]) & (self.in_order(words, q, last[a + pair]) >= answer * last[a + pair])
            out[a + pair[both]] = True
        return out


def fewest(length: np.ndarray, share: float, part: float) -> np.ndarray:
    """No region with fewer of a passage's words can hold ``part`` of them in order."""
    return np.ceil(length * min(part, share) - 1e-9).astype(np.int64)


def floors(rows: list[np.ndarray], weight: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The least product of a passage's TF-IDF row with that of a region that has ``least`` of its words: those of the
    smallest products; ``rows``: term numbers of the words."""
    out = np.zeros(len(rows))
    for k, r in enumerate(rows):
        own, at, tf = np.unique(r, return_inverse=True, return_counts=True)
        out[k] = np.sort((tf * weight[own] ** 2)[at])[: least[k]].sum()
    return out


def unseen(table, terms: np.ndarray, vectors: np.ndarray, latent: np.ndarray) -> np.ndarray:
    """The largest entry of each passage's row that the space does not give back."""
    out = np.zeros(len(table))
    for a in range(0, len(table), 16):
        rest = vectors.astype(np.float64) @ latent[a : a + 16].T.astype(np.float64)
        for k, t, v in table[a : a + 16]:
            rest[np.searchsorted(terms, np.array(t, np.int64).view(U)), k - a] -= v
        out[a : a + 16] = np.abs(rest).max(0)
    return out


def _regions(chunk: np.ndarray, found: np.ndarray, vectors: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The sum of the vectors in chunks begin:end of each region; ``chunk``: those of the known words ``found``, in order."""
    lo, hi = int(begin.min()), int(end.max())
    a, b = np.searchsorted(chunk, [lo, hi])
    sums = np.zeros((hi - lo + 1, vectors.shape[1]), np.float32)  # the last one stays empty
    own, at = np.unique(chunk[a:b], return_index=True)
    if len(own):
        sums[own - lo] = np.add.reduceat(vectors[found[a:b]], at, axis=0)
    out = np.zeros((len(begin), vectors.shape[1]), np.float32)
    for j in range(int((end - begin).max())):
        out += sums[np.where(begin + j < end, begin + j - lo, hi - lo)]
    return out


def _search(sent, rule):
    """(doc_id, item_id, cosine, cover, share, answer) of windows that pass."""
    share, part, answer = rule

    def run(batches):
        x = sent.value
        index = TermIndex(x["terms"])
        none = len(x["terms"])
        held = Passages(x["terms"], x["words"])
        vectors = np.concatenate([x["vectors"] * x["weight"][:, None].astype(np.float32), np.zeros((1, x["vectors"].shape[1]), np.float32)])
        latent = x["latent"]
        size2 = (latent**2).sum(1)
        least = fewest(held.length, share, part)
        span = WINDOW + STRIDE
        half = STRIDE // 2
        # The last column sums the weights, which bound what projection and rounding take from a product.
        summed = np.concatenate([vectors, np.append(x["weight"], 0).astype(np.float32)[:, None]], axis=1)
        slack = x["unseen"] + ROUNDING * np.sqrt(size2)
        for batch in batches:
            out = []
            for block in blocks(batch.column(1)):
                h, bounds, _ = block.words(NO_WORD)
                at, found = index.find(h)
                if not len(at):
                    continue
                term = np.full(len(h) + 1, none)
                term[at] = found
                earlier = held.earlier(term)
                known = np.concatenate([[0], np.cumsum(term[:-1] < none)])
                halves = np.concatenate([[0], np.cumsum(-(-np.diff(bounds) // STRIDE))])
                doc = np.repeat(np.arange(block.docs), np.diff(halves))
                lo = bounds[doc] + (np.arange(halves[-1]) - halves[doc]) * STRIDE
                begin, end = np.maximum(bounds[doc], lo - half), np.minimum(bounds[doc + 1], lo + WINDOW + half)
                # Regions begin and end at chunks of half a stride, counted from the document's first word.
                chunks = np.concatenate([[0], np.cumsum(-(-np.diff(bounds) // half))])
                own = np.searchsorted(bounds, at, "right") - 1
                chunk = chunks[own] + (at - bounds[own]) // half
                first, last = (chunks[doc] + -(-(e - bounds[doc]) // half) for e in (begin, end))
                some = known[end] - known[begin] >= least.min()
                for a in range(0, len(lo), 256):
                    w = a + np.flatnonzero(some[a : a + 256])
                    if not len(w):
                        continue
                    z = _regions(chunk, found, summed, first[w], last[w])
                    near, p = np.nonzero(z[:, :-1] @ latent.T >= x["floor"] - z[:, -1:] * slack)
                    if not len(near):
                        continue
                    place = begin[w, None] + np.arange(span)
                    place[place >= end[w, None]] = len(h)
                    enough = held.common(term, earlier, place, near, p) >= least[p]
                    near, p = near[enough], p[enough]
                    if not len(near):
                        continue
                    kind = term[place]
                    got = held.in_order(kind[near], p) / held.length[p]
                    said = np.zeros(len(p))
                    ask = np.flatnonzero((got >= part) & (got < share) & (x["answer"][p] > 0))
                    if len(ask):
                        said[ask] = held.in_order(kind[near[ask]], p[ask], x["answer"][p[ask]]) / x["answer"][p[ask]]
                    good = got >= share
                    ask = np.flatnonzero(~good & (got >= part) & (said >= answer))
                    if len(ask):
                        good[ask] = held.close_together(kind[near[ask]], p[ask], x["answer"][p[ask]], part, answer)
                    hit = np.flatnonzero(good)
                    if not len(hit):
                        continue
                    own, back = np.unique(near[hit], return_inverse=True)
                    z = np.zeros((len(own), vectors.shape[1]), np.float32)
                    stop = np.minimum(bounds[doc[w[own]] + 1], lo[w[own]] + WINDOW)
                    for j in range(WINDOW):
                        z += vectors[term[np.where(lo[w[own]] + j < stop, lo[w[own]] + j, len(h))]]
                    dots = (z[back] * latent[p[hit]]).sum(1)
                    norm = np.sqrt((z * z).sum(1))[back] * np.sqrt(size2[p[hit]])
                    out.append((block.first + doc[w[near[hit]]], x["items"][p[hit]], dots / np.maximum(norm, 1e-12), dots / np.maximum(size2[p[hit]], 1e-12), got[hit], said[hit]))
            if out:
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.record_batch([batch.column(0).take(pa.array(cols[0])), pa.array(cols[1], pa.int64()), *(pa.array(c.astype(np.float64)) for c in cols[2:])], names=["doc_id", "item_id", "cosine", "cover", "share", "answer"])

    return run


class Decontaminator:
    """``contaminated`` returns the pairs (doc_id, item_id) whose text holds a benchmark item, with the best figures.

    Defined results: null or empty texts match nothing, items without words are held by nothing; rows without doc_id take
    part in counts, not in the result; repeated documents or items give one row per pair of ids; other columns are ignored;
    an empty table on either side gives an empty result.
    """

    def __init__(self, share: float = SHARE, part: float = PART, answer: float = ANSWER):
        self.rule = (share, part, answer)

    def contaminated(self, docs: DataFrame, items: DataFrame) -> DataFrame:
        spark = docs.sparkSession
        space = Workspace(spark, "decontaminate")
        # Lower case of all letters, not of A-Z alone: passages turn up in capitals.
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
        items = items.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text")).filter("item_id is not null").distinct()
        passages = space.store(items.mapInArrow(_passages, "item_id long, words array<long>, answer long"), "passages")
        slabs = max(1, math.ceil(passages.count() / SLAB))
        found = spark.createDataFrame([], "doc_id long, item_id long, cosine double, cover double, share double, answer double")
        for s in range(slabs):
            part = passages.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(slabs)) == s)
            found = found.union(self._slab(space, docs, part, s))
        best = found.filter("doc_id is not null").groupBy("doc_id", "item_id")
        return best.agg(*[F.max(c).alias(c) for c in ("cosine", "cover", "share", "answer")])

    def _slab(self, space: Workspace, docs: DataFrame, part: DataFrame, s: int) -> DataFrame:
        spark = docs.sparkSession
        held = part.orderBy("item_id", "words").toPandas()
        empty = spark.createDataFrame([], "doc_id long, item_id long, cosine double, cover double, share double, answer double")
        if not len(held):
            return empty
        words = [np.array(w, np.int64).view(U) for w in held["words"]]
        terms = np.unique(np.concatenate(words))
        sc = spark.sparkContext
        counted = docs.select("text").mapInArrow(trimmed(_frequencies(sc.broadcast(terms))), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
        df = np.zeros(len(terms) + 1)
        df[counted["term"].to_numpy()] = counted["n"].to_numpy()
        n, df = df[-1], df[:-1]  # term -1 counted the documents
        idf = np.log((n + 1) / (df + 0.5))
        rows = [np.searchsorted(terms, w) for w in words]
        # Common terms weigh little, but something: a region that has them alone must be retrieved too.
        weight = np.maximum(idf, 0.2)
        table = []
        for k, r in enumerate(rows):
            own, tf = np.unique(r, return_counts=True)
            table.append((k, terms[own].view(np.int64).tolist(), (tf * weight[own]).tolist()))
        matrix = space.store(spark.createDataFrame(table, "row long, terms array<long>, values array<double>").repartition(4), f"matrix-{s}")
        got = LatentSpace().fit(space, matrix, f"svd-{s}").toPandas()
        width = len(got["vector"].iloc[0]) // 4
        vectors = np.zeros((len(terms), width), np.float32)
        vectors[np.searchsorted(terms, got["term"].to_numpy(np.int64).view(U))] = np.frombuffer(b"".join(got["vector"]), np.float32).reshape(-1, width)
        latent = np.stack([(vectors[np.searchsorted(terms, np.array(t, np.int64).view(U))] * np.array(v, np.float32)[:, None]).sum(0) for _, t, v in table])
        least = fewest(np.array([len(r) for r in rows]), self.rule[0], self.rule[1])
        bound = {"floor": floors(rows, weight, least), "unseen": unseen(table, terms, vectors, latent)}
        sent = sc.broadcast({**bound, "terms": terms, "weight": weight, "vectors": vectors, "latent": latent, "words": words, "items": held["item_id"].to_numpy(np.int64), "answer": held["answer"].to_numpy(np.int64)})
        return docs.mapInArrow(trimmed(_search(sent, self.rule)), "doc_id long, item_id long, cosine double, cover double, share double, answer double")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return Decontaminator().contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
