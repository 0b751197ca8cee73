"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata.

Method. A text's features are its words (hashed to ``BUCKETS``, each occurrence weighs 1 / words) and one bucket of each
structure statistic (weight 1). score = sigmoid(b + sum w x + 1/2 sum_f ((sum v x)^2 - sum v^2 x^2)): the pairwise
interactions cost linear time by the sum-of-squares identity. It is learned on a bounded sample of labelled rows (the
``SAMPLE`` ids with the smallest hash; the only sample) by rounds of distributed gradient updates: each partition runs
minibatch AdaGrad from the round's parameters, which are then averaged. Scoring covers all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .shared import Workspace, held_out
from .textblocks import U, blocks, trimmed

BUCKETS = 1 << 13
FACTORS = 4
SAMPLE = 8000
PARTS = 4
ROUNDS = 6
KEEP_AT = 0.3
BINS = 16
STATISTICS = ("words", "distinct", "repeats", "upper", "punctuation", "digits", "symbols", "lines", "word_bytes", "bars", "non_ascii", "runs")
SIZE = BUCKETS + len(STATISTICS) * BINS

_CLASS = {name: np.zeros(256, bool) for name in ("upper", "punctuation", "digits", "symbols", "bars", "non_ascii")}
_CLASS["upper"][65:91] = True
_CLASS["digits"][48:58] = True
_CLASS["non_ascii"][128:] = True
for _b in b".,;:!?'\"()-":
    _CLASS["punctuation"][_b] = True
for _b in b"!#$%&*@^~=+<>{}[]\\_":
    _CLASS["symbols"][_b] = True
_CLASS["bars"][ord("|")] = True


def features(column: pa.Array):
    """(row, word buckets, statistic buckets) of each document."""
    for block in blocks(column):
        h, bounds, starts = block.words()
        bucket = (h >> U(51)).astype(np.int64)
        sizes = np.diff(block.offsets)
        words = np.diff(bounds)
        same = np.concatenate([[0], np.cumsum(np.concatenate([[False], h[1:] == h[:-1]])) if len(h) else []]).astype(np.int64)
        per = {}
        for name, kind in _CLASS.items():
            total = np.concatenate([[0], np.cumsum(kind[block.data])])
            per[name] = np.diff(total[block.offsets]) / np.maximum(sizes, 1)
        lines = np.concatenate([[0], np.cumsum(block.data == 10)])
        per["lines"] = np.diff(lines[block.offsets]) / np.maximum(words, 1)
        per["repeats"] = np.diff(same[bounds]) / np.maximum(words, 1)
        per["words"] = np.log2(words + 1) / 16
        per["word_bytes"] = sizes / np.maximum(words, 1) / 16
        per["distinct"], per["runs"] = np.zeros(block.docs), np.zeros(block.docs)
        for d in range(block.docs):
            own = bucket[bounds[d] : bounds[d + 1]]
            if len(own):
                count = np.bincount(own, minlength=1)
                per["distinct"][d] = np.count_nonzero(count) / min(len(own), BUCKETS)
                per["runs"][d] = count.max() / len(own)
        # Shares are binned by their square root, which spreads the small ones.
        stats = np.stack([np.minimum((np.sqrt(np.clip(per[s], 0, 1)) * BINS).astype(np.int64), BINS - 1) for s in STATISTICS], axis=1)
        stats += BUCKETS + np.arange(len(STATISTICS)) * BINS
        for d in range(block.docs):
            yield block.first + d, bucket[bounds[d] : bounds[d + 1]], stats[d]


class FactorisationMachine:
    """Parameters: bias, w (SIZE), v (SIZE x FACTORS). A batch is a list of (word buckets, statistic buckets)."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    @classmethod
    def start(cls, share: float, seed: int = 7) -> FactorisationMachine:
        rng = np.random.default_rng(seed)
        return cls(float(np.log(share / (1 - share))), np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, FACTORS)))

    @staticmethod
    def flat(batch):
        sizes = np.array([len(a) + len(b) for a, b in batch])
        index = np.concatenate([x for pair in batch for x in pair]).astype(np.int64)
        x = np.concatenate([y for a, b in batch for y in (np.full(len(a), 1 / max(len(a), 1)), np.ones(len(b)))])
        return index, x, np.concatenate([[0], np.cumsum(sizes)])[:-1]

    def raw(self, index, x, starts):
        v = self.v[index] * x[:, None]
        total = np.add.reduceat(v, starts, axis=0)
        pairs = (total**2).sum(1) - np.add.reduceat((v * v).sum(1), starts)
        return self.bias + np.add.reduceat(self.w[index] * x, starts) + pairs / 2, total, v

    def scores(self, batch) -> np.ndarray:
        if not batch:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.flat(batch))[0], -35, 35)))

    def learn(self, rows, labels, rate: float = 0.1, decay: float = 1e-5, size: int = 32) -> None:
        gw, gv, gb = np.full(SIZE, 1e-4), np.full((SIZE, FACTORS), 1e-4), 1e-4
        for a in range(0, len(rows), size):
            index, x, starts = self.flat(rows[a : a + size])
            raw, total, v = self.raw(index, x, starts)
            error = 1 / (1 + np.exp(-np.clip(raw, -35, 35))) - labels[a : a + size]
            each = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(index)]])))
            e = error[each]
            touched, at = np.unique(index, return_inverse=True)
            dw = np.bincount(at, e * x, len(touched)) + decay * self.w[touched]
            slope = (e * x)[:, None] * (total[each] - v)
            dv = np.stack([np.bincount(at, slope[:, f], len(touched)) for f in range(FACTORS)], axis=1) + decay * self.v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            gb += error.sum() ** 2
            self.w[touched] -= rate * dw / np.sqrt(gw[touched])
            self.v[touched] -= rate / 4 * dv / np.sqrt(gv[touched])
            self.bias -= rate * error.sum() / np.sqrt(gb)

    def state(self) -> tuple:
        return self.bias, self.w.astype(np.float32), self.v.astype(np.float32)

    @classmethod
    def of(cls, state) -> FactorisationMachine:
        return cls(state[0], state[1].astype(np.float64), state[2].astype(np.float64))


def _featurise(batches):
    for batch in batches:
        words, stats = [], []
        for _, w, s in features(batch.column(0)):
            words.append(w.astype(np.int32))
            stats.append(s.astype(np.int32))
        yield pa.record_batch([pa.array(words, pa.list_(pa.int32())), pa.array(stats, pa.list_(pa.int32())), batch.column(1)], names=["words", "stats", "label"])


def _round(sent, seed: int):
    def run(batches):
        rows, labels = [], []
        for batch in batches:
            rows += [(w.as_py(), s.as_py()) for w, s in zip(batch.column(0), batch.column(1), strict=True)]
            labels += batch.column(2).to_pylist()
        if rows:
            rows = [(np.array(w, np.int64), np.array(s, np.int64)) for w, s in rows]
            order = np.random.default_rng(seed).permutation(len(rows))
            model = FactorisationMachine.of(sent.value)
            model.learn([rows[i] for i in order], np.array(labels, np.float64)[order])
            bias, w, v = model.state()
            yield pa.record_batch([pa.array([len(rows)]), pa.array([np.concatenate([[np.float32(bias)], w, v.ravel()]).astype(np.float32).tobytes()], pa.binary())], names=["n", "state"])

    return run


def _score(sent):
    """``rest`` and score; the text is the first column, or stands in ``rest`` alone. A record batch goes out for each run of
    texts that is scored together."""

    def run(batches):
        model = FactorisationMachine.of(sent.value)
        for batch in batches:
            rest = batch.column(batch.num_columns - 1)
            scored = lambda held, at, rest=rest: pa.RecordBatch.from_arrays([rest.slice(at, len(held)), pa.array(model.scores(held))], names=["rest", "score"])
            held, at, size = [], 0, 0
            for _, w, s in features(batch.column(0) if batch.num_columns > 1 else rest.field("text")):
                held.append((w, s))
                size += len(w)
                if size >= 1 << 18:
                    yield scored(held, at)
                    held, at, size = [], at + len(held), 0
            if held:
                yield scored(held, at)

    return run


class QualityClassifier:
    """``fit`` learns from (doc_id, text) and (doc_id, quality); ``score`` adds ``score`` and ``predicted`` to any columns
    (columns of these names are replaced).

    Only the text is an input of a score. Defined results: null and empty texts score like any other (they have no words);
    a label repeated for an id counts by its mean, null labels are ignored; without any label of both kinds, the score is
    their share (one half without labels); rows that repeat keep their row; an empty table gives an empty result.
    """

    def __init__(self, sample: int = SAMPLE, rounds: int = ROUNDS):
        self.sample, self.rounds = sample, rounds

    def fit(self, docs: DataFrame, labels: DataFrame) -> QualityClassifier:
        spark = docs.sparkSession
        space = Workspace(spark, "quality")
        one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q")).filter("doc_id is not null and q is not null")
        one = one.groupBy("doc_id").agg((F.avg("q") >= 0.5).cast("double").alias("label"))
        picked = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(self.sample)
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        # At most SAMPLE ids are sent to the scan.
        rows = texts.join(F.broadcast(picked), "doc_id").select("text", "label").mapInArrow(trimmed(_featurise), "words array<int>, stats array<int>, label double")
        rows = space.store(rows.repartition(PARTS), "sample")
        n, good = rows.agg(F.count("*"), F.sum("label")).head()
        share = min(max(((good or 0) + 1) / (n + 2), 0.01), 0.99)
        model = FactorisationMachine.start(share)
        if n and 0 < good < n:
            for r in range(self.rounds):
                sent = spark.sparkContext.broadcast(model.state())
                # PARTS states of fixed size come back, whatever the corpus.
                back = rows.mapInArrow(trimmed(_round(sent, r)), "n long, state binary").collect()
                states = np.stack([np.frombuffer(x["state"], np.float32) for x in back]).astype(np.float64)
                mean = np.average(states, axis=0, weights=[x["n"] for x in back])
                model = FactorisationMachine(mean[0], mean[1 : 1 + SIZE], mean[1 + SIZE :].reshape(SIZE, FACTORS))
                sent.destroy()
        else:
            model.v[:] = 0
        self.model = model
        return self

    def score(self, docs: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(self.model.state())
        rest = F.struct(*[docs[c] for c in docs.columns if c not in ("score", "predicted")]).alias("rest")
        # A text that is returned as it is goes to the tasks once.
        once = any(f.name == "text" and f.dataType == StringType() for f in docs.schema)
        rows = docs.select(rest) if once else docs.select(F.col("text").cast("string").alias("text"), rest)
        out = rows.mapInArrow(trimmed(_score(sent)), StructType([rows.schema["rest"], StructField("score", DoubleType())])).select("rest.*", "score")
        return out.withColumn("predicted", (F.col("score") >= keep_at).cast("int"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out("doc_id", 5))
    model = QualityClassifier().fit(docs, labels)
    ids = docs.select("doc_id", held_out("doc_id", 5).alias("held_out"), "text")
    return model.score(ids).select("doc_id", "held_out", "score", "predicted")
