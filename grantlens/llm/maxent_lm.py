"""LM scoring by a hashed maximum-entropy model with class-factored softmax.

Method. log P(token | context) = log P(class | context) + log P(group | class, context) + log P(token | group). The class model
is a softmax over ``CLASSES`` classes, its weights rows of one hashed table: the previous word, the previous two (n-gram
features), the word before last and the one before that (skip features). The word model is a softmax over the ``GROUPS`` groups
of a class with the same features, its weights rows of a second table, hashed of feature and class: each of the ``LEAD`` most
frequent words of a class is a group of its own, the class's other words share the rest of the groups by their hash. It starts
from the groups' counts. A word's class comes from its first two bytes: their buckets are clustered by which of
them stand next to each other in the corpus (spectral vectors of the adjacency counts). P(token | group) comes from the
counts of all training tokens, with 0.1 added; a group of one word leaves nothing to it. Training covers all training texts: every task runs minibatch AdaGrad over
its texts, and the tasks' rows are averaged by how often each row was updated. Counts are exact and cover all training texts.
They grow with the corpus, so only the words of at least a count that leaves ``HEAD`` or fewer are sent to the tasks; the
other words of a text are looked up by a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .shared import Workspace, held_out
from .textblocks import U, blocks, mix

CLASSES = 32  # the last is the end of a text; the tables have as many columns, GROUPS too
GROUPS = 32  # of a class: LEAD words and 2^TAIL_BITS groups by hash
TAIL_BITS = 3
LEAD = GROUPS - (1 << TAIL_BITS)
AFFIXES = 256
ROWS_BITS = 15
WORD_BITS = 16
FEATURES = 4
HEAD = 1 << 19  # words whose counts are sent to the tasks (8 MB), whatever the input
BATCH = 1 << 12
RATE = 0.25
ROUNDS = 16
FLUSH = 1 << 22
PART_ROWS = 1 << 10
ADD = 0.1
END = U(0x5D8A3C6F1E2B4977)
_SALT = [U(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def tokens(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, affixes, bounds) of a block's tokens: each text's words, then its end (affix -1)."""
    h, bounds, starts = block.words()
    second = np.where(starts + 1 < block.word_ends, block.low[np.minimum(starts + 1, max(len(block.low) - 1, 0))] if len(h) else 0, 0)
    affix = (mix(block.low[starts].astype(U) * U(256) + second.astype(U)) >> U(56)).astype(np.int64) if len(h) else np.zeros(0, np.int64)
    at = np.arange(len(h)) + np.repeat(np.arange(block.docs), np.diff(bounds))
    out = np.full(len(h) + block.docs, END, U)
    kind = np.full(len(out), -1, np.int64)
    out[at], kind[at] = h, affix
    return out, kind, bounds + np.arange(block.docs + 1)


def contexts(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """The FEATURES hashes of each token's context."""
    place = np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))
    back = []
    for j in (1, 2, 3):
        x = np.zeros(len(h), U)
        x[j:] = h[:-j] if j < len(h) else h[:0]
        x[place < j] = 0
        back.append(x)
    return mix(back[0] + _SALT[0]), mix(back[0] * _SALT[1] + back[1] * _SALT[2]), mix(back[1] + _SALT[3]), mix(back[2] + _SALT[4])


def context_rows(found: tuple[np.ndarray, ...]) -> np.ndarray:
    """The class table's rows of each context (uint16)."""
    return np.stack([(x >> U(64 - ROWS_BITS)).astype(np.uint16) for x in found])


def word_rows(found: tuple[np.ndarray, ...], target: np.ndarray) -> np.ndarray:
    """The word table's rows of each context and class (uint16)."""
    salt = (target.astype(U) + U(1)) * _SALT[2]
    return np.stack([(((x ^ salt) * _SALT[0]) >> U(64 - WORD_BITS)).astype(np.uint16) for x in found])


def word_groups(h: np.ndarray, lead: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Each word's group in its class; ``lead``: sorted hashes of the words with a group of their own, which is ``rank``."""
    out = LEAD + (h >> U(64 - TAIL_BITS)).astype(np.int64)
    if len(lead):
        k = np.minimum(np.searchsorted(lead, h), len(lead) - 1)
        same = lead[k] == h
        out[same] = rank[k[same]]
    return out


def _kept(room: dict, name: str, rows: int, like: np.ndarray) -> np.ndarray:
    """``rows`` rows of a buffer that minibatches use again: new memory for each costs more than the arithmetic."""
    if name not in room or len(room[name]) < rows:
        room[name] = np.empty((rows, like.shape[1]), like.dtype)
    return room[name][:rows]


def _taken(room: dict, name: str, table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.take(table, at, axis=0, out=_kept(room, name, len(at), table), mode="clip")


def softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, room: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logits less a maximum, their exponentials, the sums of these). One maximum serves the batch; where that leaves a row
    without any exponential, each row takes its own. The first two lie in ``room`` until its next use."""
    room = {} if room is None else room
    rows = rows.astype(np.intp)
    z = _taken(room, "logits", weights, rows[0])
    z += bias
    for r in rows[1:]:
        z += _taken(room, "one", weights, r)
    one = _kept(room, "one", len(z), weights)
    z -= z.max(initial=-np.inf)
    e = np.exp(z, out=one)
    ones = np.ones(z.shape[1], z.dtype)
    total = e @ ones
    if len(total) and total.min() < 1e-30:
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z, out=one)
        total = e @ ones
    return z, e, total


def log_choice(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, target: np.ndarray, room: dict | None = None) -> np.ndarray:
    z, _, total = softmax(weights, bias, rows, room)
    return z[np.arange(len(target)), target] - np.log(total)


def learn(w: np.ndarray, g: np.ndarray, seen: np.ndarray, rows: np.ndarray, bias: np.ndarray, target: np.ndarray, room: dict | None = None) -> np.ndarray:
    """One AdaGrad step on the rows of a minibatch, with one rate for each row of the table (``g`` sums the rows' mean
    squared slopes); gives the slopes of the logits, which lie in ``room``. All features share the table, so one order
    serves them."""
    room = {} if room is None else room
    _, e, total = softmax(w, bias, rows, room)
    e /= total[:, None]
    e[np.arange(len(target)), target] -= 1
    flat = rows.ravel()  # uint16: ordered by counting
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    n = np.diff(np.append(first, len(order)))
    token = order % len(target)
    once = n == 1

    def step(at: np.ndarray, slope: np.ndarray, square: np.ndarray, times) -> None:
        now = g[at] + square
        g[at] = now
        slope *= (RATE / np.sqrt(now))[:, None]
        after = _taken(room, "after", w, at)
        after -= slope
        w[at] = after
        seen[at] += times

    # Most rows of a minibatch stand once in it: they need no sum, and a token's squares serve all its rows.
    single = first[once]
    square = np.einsum("ij,ij->i", e, e) / w.dtype.type(w.shape[1])
    step(ordered[single].astype(np.intp), _taken(room, "slope", e, token[single]), square[token[single]], 1)
    if not once.all():
        # The others by their number, the most frequent first: each round adds the next place of those that have one, and
        # rows with more than ROUNDS places get the rest as one product.
        more = np.flatnonzero(~once)
        more = more[np.argsort(-n[more], kind="stable")]
        start, times = first[more], n[more]
        slope = _taken(room, "slope", e, token[start])
        for j in range(1, min(ROUNDS, int(times[0]))):
            some = int(np.searchsorted(-times, -j))  # rows with more than j places
            slope[:some] += _taken(room, "next", e, token[start[:some] + j])
        for k in range(int(np.searchsorted(-times, -ROUNDS))):
            rest = token[start[k] + ROUNDS : start[k] + times[k]]
            slope[k] += np.ones(len(rest), e.dtype) @ _taken(room, "next", e, rest)
        square = np.einsum("ij,ij->i", slope, slope) / w.dtype.type(w.shape[1])
        step(ordered[start].astype(np.intp), slope, square, times)
    return e


def _counts(batches):
    """Rows (kind, h, affix, n): kind 0 counts of words, kind 1 neighbouring affixes (h = first * AFFIXES + second)."""
    near = np.zeros(AFFIXES * AFFIXES, np.int64)
    held, total = [], 0

    def flush():
        h, kind = (np.concatenate(x) for x in zip(*held, strict=True))
        h, at, n = np.unique(h, return_index=True, return_counts=True)
        return pa.record_batch([pa.array(np.zeros(len(h), np.int32)), pa.array(h.view(np.int64)), pa.array(kind[at].astype(np.int32)), pa.array(n.astype(np.int64))], names=["kind", "h", "affix", "n"])

    for batch in batches:
        for block in blocks(batch.column(0)):
            h, kind, _ = tokens(block)
            pair = (kind[:-1] >= 0) & (kind[1:] >= 0)
            near += np.bincount(kind[:-1][pair] * AFFIXES + kind[1:][pair], minlength=len(near))
            held.append((h, kind))
            total += len(h)
            if total >= FLUSH:
                yield flush()
                held, total = [], 0
    if held:
        yield flush()
    some = np.flatnonzero(near)
    yield pa.record_batch([pa.array(np.ones(len(some), np.int32)), pa.array(some.astype(np.int64)), pa.array(np.zeros(len(some), np.int32)), pa.array(near[some])], names=["kind", "h", "affix", "n"])


def cluster_affixes(near: np.ndarray, classes: int, seed: int = 5) -> np.ndarray:
    """Class of each affix: k-means over the leading spectral vectors of the normalised adjacency counts."""
    a = near + near.T + 1e-3
    d = a.sum(1)
    value, vector = np.linalg.eigh(a / np.sqrt(d[:, None] * d[None]))
    x = vector[:, np.argsort(-value)[:8]] / np.maximum(np.sqrt(d)[:, None] / np.sqrt(d.sum()), 1e-9)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centre = x[np.argsort(-d, kind="stable")[:classes]]  # start from the most frequent
    rng = np.random.default_rng(seed)
    for _ in range(25):
        own = np.argmax(x @ centre.T, axis=1)
        for k in range(classes):
            mine = own == k
            centre[k] = (x[mine] * d[mine, None]).sum(0) if mine.any() else x[rng.integers(len(x))]
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    return np.argmax(x @ centre.T, axis=1)


def _train(model):
    """(part, weights, seen) of a task's tables after its texts, in parts of PART_ROWS rows; the word table's follow the
    class table's."""

    def run(batches):
        m = model.value
        size, words = 1 << ROWS_BITS, 1 << WORD_BITS
        w, g = np.zeros((size + words, CLASSES), np.float32), np.full(size + words, 1e-6, np.float32)
        bias, gb = np.zeros(CLASSES, np.float32), np.full(CLASSES, 1e-6, np.float32)
        seen, steps, room = np.zeros(size + words, np.int64), 0, {}
        for batch in batches:
            for block in blocks(batch.column(0)):
                h, kind, bounds = tokens(block)
                target = m["classes"][kind]  # the end's affix -1 names the last entry
                group = word_groups(h, m["lead"], m["rank"])
                found = contexts(h, bounds)
                rows, inner = context_rows(found), word_rows(found, target)
                for a in range(0, len(h), BATCH):
                    t = target[a : a + BATCH]
                    slope = learn(w[:size], g[:size], seen[:size], rows[:, a : a + BATCH], bias, t, room).sum(0)
                    gb += slope * slope
                    bias -= RATE * slope / np.sqrt(gb)
                    word = np.flatnonzero(t < CLASSES - 1) + a  # the end is alone in its class
                    if len(word):
                        learn(w[size:], g[size:], seen[size:], inner[:, word], _taken(room, "prior", m["prior"], target[word]), group[word], room)
                    steps += len(t)
        parts, values, counts = [], [], []
        for p in range(0, size + words, PART_ROWS):
            if seen[p : p + PART_ROWS].any():
                parts.append(p // PART_ROWS)
                values.append(w[p : p + PART_ROWS].tobytes())
                counts.append(seen[p : p + PART_ROWS].tobytes())
        yield pa.record_batch([pa.array([*parts, -1], pa.int32()), pa.array([*values, bias.tobytes()], pa.binary()), pa.array([*counts, np.array([steps]).tobytes()], pa.binary())], names=["part", "weights", "seen"])

    return run


def _average(batches):
    """Mean rows of the tasks' tables, by updates; a partition holds whole parts."""
    total: dict[int, list] = {}
    for batch in batches:
        for part, w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = np.frombuffer(n, np.int64).astype(np.float64)[:, None]
            w = np.frombuffer(w, np.float32).reshape(len(n), CLASSES) * n
            if part in total:
                total[part][0] += w
                total[part][1] += n
            else:
                total[part] = [w, n]
    out = [(w / np.maximum(n, 1)).astype(np.float32).tobytes() for w, n in total.values()]
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(out, pa.binary())], names=["part", "weights"])


def _score(model):
    """Per text: what its frequent words give, the class terms and the words left to the join."""

    def run(batches):
        m = model.value
        head, logs = m["head"], m["log_count"]
        bits = np.zeros(1 << 22, bool)
        bits[(head >> U(42)).astype(np.int64)] = True
        room: dict = {}
        for batch in batches:
            n = batch.num_rows
            size, known, base, more = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            rare, lengths = [], []
            for block in blocks(batch.column(0)):
                h, kind, bounds = tokens(block)
                target, group = m["classes"][kind], word_groups(h, m["lead"], m["rank"])
                context = contexts(h, bounds)
                rows, inner = context_rows(context), word_rows(context, target)
                p = np.empty(len(h))
                for a in range(0, len(h), BATCH):
                    t, k = target[a : a + BATCH], group[a : a + BATCH]
                    p[a : a + BATCH] = log_choice(m["weights"], m["bias"], rows[:, a : a + BATCH], t, room) + log_choice(m["words"], _taken(room, "prior", m["prior"], t), inner[:, a : a + BATCH], k, room)
                p = p / np.log(10) - m["log_group"][target, group]
                found = bits[(h >> U(42)).astype(np.int64)]
                at = np.flatnonzero(found)
                k = np.minimum(np.searchsorted(head, h[at]), max(len(head) - 1, 0))
                same = head[k] == h[at] if len(head) else np.zeros(len(at), bool)
                found[at] = same
                log = np.zeros(len(h))
                log[at[same]] = logs[k[same]]
                here = slice(block.first, block.first + block.docs)
                size[here] = np.diff(bounds)
                base[here], more[here] = np.add.reduceat(log, bounds[:-1]), np.add.reduceat(p, bounds[:-1])
                known[here] = np.add.reduceat(found.astype(np.int64), bounds[:-1])
                rare.append(h[~found])
                lengths.append(np.diff(bounds) - known[here])
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]) if lengths else np.zeros(1)
            words = np.concatenate(rare).view(np.int64) if rare else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(size), pa.array(known), pa.array(base), pa.array(more), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(words))],
                names=[*batch.schema.names[1:], "n_tokens", "known", "base", "more", "rare"])

    return run


class MaxEntLm:
    """``fit`` learns from texts, ``score`` gives base_score and score (log10) with token counts.

    Defined results: a null text is an empty one, whose only token is its end; without training texts every token is
    unknown; rows that repeat keep their row; rows without doc_id are scored and teach nothing when the query splits by
    id; other columns pass through under any name; an empty table gives an empty result.
    """

    def fit(self, texts: DataFrame) -> MaxEntLm:
        spark = texts.sparkSession
        sc = spark.sparkContext
        self.space = Workspace(spark, "lm")
        texts = texts.select(F.col("text").cast("string").alias("text"))
        raw = texts.mapInArrow(_counts, "kind int, h long, affix int, n long")
        # Partial sums per task go into one shuffle for words and affix pairs alike.
        sums = self.space.store(raw.groupBy("kind", "h", "affix").agg(F.sum("n").alias("n")), "counts")
        self.words = sums.filter("kind = 0").select("h", "affix", F.col("n").alias("c"))
        pairs = sums.filter("kind = 1").select("h", "n").toPandas()
        near = np.zeros(AFFIXES * AFFIXES)
        near[pairs["h"].to_numpy()] = pairs["n"].to_numpy()
        # The last entry is the class of the end, whose affix is -1.
        classes = np.append(cluster_affixes(near.reshape(AFFIXES, AFFIXES), CLASSES - 1), CLASSES - 1)
        per = self.words.groupBy("affix", F.shiftrightunsigned("h", 64 - TAIL_BITS).cast("int").alias("tail")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toPandas()
        n, v = np.zeros((CLASSES, GROUPS)), np.zeros((CLASSES, GROUPS))
        at = classes[per["affix"].to_numpy()], LEAD + per["tail"].to_numpy()
        np.add.at(n, at, per["n"].to_numpy())
        np.add.at(v, at, per["v"].to_numpy())
        self.train_tokens, self.distinct = int(n.sum()), int(v.sum())
        sizes = self.words.groupBy("c").agg(F.count("*").alias("k")).orderBy(F.desc("c")).toPandas()
        self.least = int(sizes["c"][sizes["k"].cumsum() <= HEAD].min()) if len(sizes) and sizes["k"].iloc[0] <= HEAD else 1 << 62
        head = self.words.filter(F.col("c") >= self.least).select("h", "affix", "c").toPandas()
        hashes = head["h"].to_numpy(np.int64).view(U)
        order = np.argsort(hashes)
        # The most frequent words of each class leave the groups by hash for one of their own.
        lead = head.assign(own=classes[head["affix"].to_numpy()]).sort_values(["c", "h"], ascending=[False, True])
        lead["rank"] = lead.groupby("own").cumcount()
        lead = lead[lead["rank"] < LEAD]
        own, rank, c, h = lead["own"].to_numpy(), lead["rank"].to_numpy(np.int64), lead["c"].to_numpy(np.float64), lead["h"].to_numpy(np.int64).view(U)
        tail = LEAD + (h >> U(64 - TAIL_BITS)).astype(np.int64)
        np.subtract.at(n, (own, tail), c)
        np.subtract.at(v, (own, tail), 1)
        mass = n + ADD * (v + 1)  # with one word that was not seen
        mass[:, :LEAD] = 1e-9  # no word
        mass[own, rank] = c + ADD
        log_mass, by_hash = np.log(mass), np.argsort(h)
        model = {"classes": classes, "lead": h[by_hash], "rank": rank[by_hash], "prior": log_mass.astype(np.float32)}
        trained = texts.mapInArrow(_train(sc.broadcast(model)), "part int, weights binary, seen binary").repartition("part").mapInArrow(_average, "part int, weights binary")
        weights, bias = np.zeros(((1 << ROWS_BITS) + (1 << WORD_BITS), CLASSES), np.float32), np.zeros(CLASSES, np.float32)
        for x in trained.toLocalIterator():  # two tables of fixed size
            values = np.frombuffer(x["weights"], np.float32).reshape(-1, CLASSES)
            if x["part"] < 0:
                bias = values[0]
            else:
                weights[x["part"] * PART_ROWS : (x["part"] + 1) * PART_ROWS] = values
        self.sent = sc.broadcast({
            **model, "weights": weights[: 1 << ROWS_BITS], "words": weights[1 << ROWS_BITS :], "bias": bias, "log_group": log_mass / np.log(10),
            "head": hashes[order], "log_count": np.log10(head["c"].to_numpy(np.float64)[order] + ADD)})
        return self

    def score(self, docs: DataFrame) -> DataFrame:
        """(the columns of ``docs`` but text, n_tokens, n_known, train_tokens, base_score, score); columns of these five names
        are replaced."""
        added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
        rest = F.struct(*[docs[c] for c in docs.columns if c not in ("text", *added)]).alias("rest")
        rows = docs.select(F.col("text").cast("string").alias("text"), rest)
        schema = StructType([rows.schema["rest"], StructField("n_tokens", LongType()), StructField("known", LongType()), StructField("base", DoubleType()), StructField("more", DoubleType()), StructField("rare", ArrayType(LongType()))])
        # The row's number is stored with it, so it stays what it is.
        first = self.space.store(rows.mapInArrow(_score(self.sent), schema).withColumn("row", F.monotonically_increasing_id()), "scored")
        others = first.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count("*").alias("k"))
        tail = self.words.filter(F.col("c") < self.least).select("h", "c")
        looked = others.join(tail, "h", "left").groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("k"))).alias("tail_known"), F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + ADD)).alias("tail_base"))
        base = F.col("base") + F.coalesce("tail_base", F.lit(0.0))
        log_all = float(np.log10(self.train_tokens + ADD * (self.distinct + 1)))
        out = first.drop("rare").join(looked, "row", "left")
        values = F.col("n_tokens"), F.col("known") + F.coalesce("tail_known", F.lit(0)), F.lit(self.train_tokens).cast("long"), base - F.col("n_tokens") * log_all, base + F.col("more")
        out = out.select("rest", *[v.alias(f"new_{n}") for v, n in zip(values, added, strict=True)])
        return out.select("rest.*", *[F.col(f"new_{n}").alias(n) for n in added])


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = MaxEntLm().fit(docs.filter(~held_out("doc_id", 10)))
    return model.score(docs.select("doc_id", held_out("doc_id", 10).alias("held_out"), "text"))
