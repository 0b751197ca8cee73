"""Language identification by interpolated Kneser-Ney character models, one per language.

Method. From a bounded sample of labelled texts (``PER_LANGUAGE`` per language, those with the smallest hash of their id;
the only sample) character 5-grams are counted on Spark. For each language interpolated Kneser-Ney probabilities of all
orders follow (continuation counts below the top, a discount per order, a uniform floor). They are stored in hash arrays
sorted by hash, one per order for all languages together, with a column of log probabilities per language that already holds
the backed-off value where a language lacks the n-gram; context arrays hold the back-off weights. A text takes the language
with the lowest cross-entropy per character. ``score`` is the posterior at a temperature calibrated on sample texts that
were kept out of the counts, and a text whose best cross-entropy is beyond what those texts showed is marked as rejected.

Symbols are lower-cased characters: the ``ALPHABET`` most frequent of the sample have their own, all others share one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .shared import Workspace, held_out
from .textblocks import U, blocks, mix

PER_LANGUAGE = 500
ORDER = 5
ALPHABET = 4000
BITS = 12
OTHER, PAD = 1, 0
CALIBRATE = 5  # every fifth sampled text calibrates instead of being counted
INDEX_BITS = 18


def _lower(cp: int) -> int:
    low = chr(cp).lower()
    return ord(low) if len(low) == 1 else cp


def symbol_table(alphabet: list[int]) -> np.ndarray:
    """Symbol of each code point; upper-case characters share that of their lower case."""
    table = np.full(0x110000, OTHER, np.uint16)
    ids = {c: k + 2 for k, c in enumerate(alphabet)}
    for cp in range(0x20000):
        if not 0xD800 <= cp < 0xE000:
            k = ids.get(_lower(cp))
            if k:
                table[cp] = k
    for c, k in ids.items():
        table[c] = k
    return table


def _code_points(block) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    total = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    return points, total[block.offsets]


def grams(block, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, bounds): the ORDER-gram that ends at each character (padded before a text), BITS bits a symbol."""
    points, bounds = _code_points(block)
    s = table[points].astype(U)
    at = np.arange(len(s)) - np.repeat(bounds[:-1], np.diff(bounds))
    code = s.copy()
    for j in range(1, ORDER):
        back = np.zeros(len(s), U)
        back[j:] = s[:-j] if j < len(s) else s[:0]
        back[at < j] = PAD
        code |= back << U(BITS * j)
    return code, bounds


class SortedHashes:
    """A set of codes as a sorted array of hashes, with an index of its first INDEX_BITS bits."""

    def __init__(self, codes: np.ndarray):
        hashes = mix(codes)
        self.order = np.argsort(hashes)
        self.hashes = np.ascontiguousarray(hashes[self.order])
        self.index = np.searchsorted(self.hashes, np.arange(1 << INDEX_BITS, dtype=U) << U(64 - INDEX_BITS)).astype(np.int64)
        self.index = np.concatenate([self.index, [len(self.hashes)]])
        self.deepest = int(np.diff(self.index).max(initial=0))

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Row of each code, -1 where it is absent."""
        out = np.full(len(codes), -1, np.int64)
        if not len(self.hashes):
            return out
        h = mix(codes)
        bucket = (h >> U(64 - INDEX_BITS)).astype(np.int64)
        at, stop = self.index[bucket], self.index[bucket + 1]
        live = np.flatnonzero(at < stop)
        at, stop, h = at[live], stop[live], h[live]
        while len(live):
            same = self.hashes[at] == h
            out[live[same]] = at[same]
            on = ~same & (at + 1 < stop)
            live, at, stop, h = live[on], at[on] + 1, stop[on], h[on]
        return out


class KneserNey:
    """``scores`` gives, for each text of a block, the summed log probability per language and the characters."""

    def __init__(self, languages, table, counts: dict):
        """counts: language -> (codes of ORDER-grams, counts)."""
        self.languages, self.table = list(languages), table
        size = int(table.max()) + 1
        levels = []  # per language: {order: (codes, log p)}, {order: (contexts, log back-off)}
        for lang in self.languages:
            codes, c = counts.get(lang, (np.zeros(0, U), np.zeros(0, np.int64)))
            seen = {ORDER: (codes, c.astype(np.float64))}
            for k in range(ORDER - 1, 0, -1):
                mask = (U(1) << U(BITS * k)) - U(1)
                low, n = np.unique(seen[k + 1][0] & mask, return_counts=True)  # distinct left neighbours
                seen[k] = (low, n.astype(np.float64))
            levels.append(seen)
        self.grams, self.contexts = {}, {}
        symbols = np.arange(1, size, dtype=U)
        below = np.zeros((0, len(self.languages)))
        for k in range(1, ORDER + 1):
            union = np.unique(np.concatenate([x[k][0] for x in levels] + ([symbols] if k == 1 else [])))
            ctx = np.unique(np.concatenate([x[k][0] >> U(BITS) for x in levels])) if k > 1 else np.zeros(1, U)
            p, back = np.zeros((len(union), len(self.languages))), np.ones((len(ctx), len(self.languages)))
            for j, seen in enumerate(levels):
                codes, c = seen[k]
                if not len(codes):
                    continue
                n1, n2 = (c == 1).sum(), (c == 2).sum()
                d = min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.9)
                at = np.searchsorted(ctx, codes >> U(BITS)) if k > 1 else np.zeros(len(codes), np.int64)
                total, kinds = np.bincount(at, c, len(ctx)), np.bincount(at, minlength=len(ctx))
                some = total > 0
                back[some, j] = d * kinds[some] / total[some]
                p[np.searchsorted(union, codes), j] = (c - d) / total[at]
            which = np.searchsorted(ctx, union >> U(BITS)) if k > 1 else np.zeros(len(union), np.int64)
            known = np.minimum(which, len(ctx) - 1)
            weight = np.where((ctx[known] == (union >> U(BITS)))[:, None], back[known], 1.0) if k > 1 else back[known]
            lower = self._lower(below, union, k) if k > 1 else np.full(p.shape, 1 / max(size - 1, 1))
            p += weight * lower
            g, x = SortedHashes(union), SortedHashes(ctx)
            self.grams[k] = (g, np.log(p[g.order]).astype(np.float32))
            self.contexts[k] = (x, np.log(back[x.order]).astype(np.float32))
            below = (union, p)

    def _lower(self, below, union, k):
        """Probability of the shorter n-gram, which is always among those of the order below (or a symbol)."""
        codes, p = below
        short = union & ((U(1) << U(BITS * (k - 1))) - U(1))
        return p[np.searchsorted(codes, short)]

    def state(self) -> dict:
        return {"languages": self.languages, "table": self.table, "grams": {k: (vars(g), p) for k, (g, p) in self.grams.items()}, "contexts": {k: (vars(g), p) for k, (g, p) in self.contexts.items()}}

    @classmethod
    def of(cls, state) -> KneserNey:
        out = cls.__new__(cls)
        out.languages, out.table = state["languages"], state["table"]
        for name in ("grams", "contexts"):
            made = {}
            for k, (inner, p) in state[name].items():
                g = SortedHashes.__new__(SortedHashes)
                g.__dict__.update(inner)
                made[k] = (g, p)
            setattr(out, name, made)
        return out

    def log_p(self, codes: np.ndarray) -> np.ndarray:
        """Natural log probability of each n-gram's last symbol, a column per language."""
        out = np.zeros((len(codes), len(self.languages)), np.float32)
        live, code = np.arange(len(codes)), codes
        for k in range(ORDER, 0, -1):
            g, p = self.grams[k]
            row = g.rows(code)
            hit = row >= 0
            if hit.all() and len(live) == len(codes):
                return p[row]
            out[live[hit]] += p[row[hit]]
            live, code = live[~hit], code[~hit]
            if not len(live):
                break
            x, back = self.contexts[k]
            row = x.rows(code >> U(BITS))
            some = row >= 0
            out[live[some]] += back[row[some]]
            code = code & ((U(1) << U(BITS * (k - 1))) - U(1))
        return out

    def scores(self, block) -> tuple[np.ndarray, np.ndarray]:
        codes, bounds = grams(block, self.table)
        sizes = np.diff(bounds)
        sums = np.zeros((len(sizes), len(self.languages)))
        some = np.flatnonzero(sizes)
        if len(some):
            sums[some] = np.add.reduceat(self.log_p(codes), bounds[:-1][some], axis=0, dtype=np.float64)
        return sums, sizes


def _characters(batches):
    for batch in batches:
        total: dict[int, int] = {}
        for block in blocks(batch.column(0)):
            points, n = np.unique(_code_points(block)[0], return_counts=True)
            for p, k in zip(points.tolist(), n.tolist(), strict=True):
                total[_lower(p)] = total.get(_lower(p), 0) + k
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["c", "n"])


def _count(table):
    def run(batches):
        symbols = table.value
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                column = batch.column(0).filter(pa.array([x == lang for x in langs]))
                parts = [grams(block, symbols)[0] for block in blocks(column)]
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])


    return run


def _best(sums, sizes):
    h = -sums / np.maximum(sizes, 1)[:, None]
    return h, np.argmin(h, axis=1)


def _posterior(h, sizes, sharp: float) -> np.ndarray:
    """Posterior of the best language from cross-entropies; the evidence of a long text is capped at 200 characters."""
    z = -(h - h.min(axis=1, keepdims=True)) * (sharp * np.minimum(sizes, 200))[:, None]
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def _entropies(sent):
    def run(batches):
        model = KneserNey.of(sent.value)
        for batch in batches:
            parts = [model.scores(b) for b in blocks(batch.column(0))]
            h = [x.tolist() for s, n in parts for x in _best(s, n)[0]]
            n = np.concatenate([n for _, n in parts])
            yield pa.record_batch([batch.column(1), pa.array(h, pa.list_(pa.float64())), pa.array(n, pa.int64())], names=["lang", "h", "n"])

    return run


def _predict(sent, sharp, limits):
    def run(batches):
        model = KneserNey.of(sent.value)
        names = np.array(model.languages, dtype=object)
        beyond = np.array([limits[x] for x in model.languages])
        for batch in batches:
            lang, score, entropy = [], np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            reject = np.zeros(batch.num_rows, bool)
            for block in blocks(batch.column(1), max(1 << 16, (1 << 22) // max(len(names), 4))):
                h, best = _best(*(x := model.scores(block)))
                p, rows = _posterior(h, x[1], sharp), np.arange(len(best))
                here = slice(block.first, block.first + block.docs)
                lang += names[best].tolist()
                score[here], entropy[here] = p[rows, best], h[rows, best]
                reject[here] = h[rows, best] > beyond[best]
            yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(entropy), pa.array(reject)], names=["rest", "lang_pred", "score", "cross_entropy", "rejected"])

    return run


class LanguageIdentifier:
    """``fit`` learns from (doc_id, text, lang); ``predict`` adds lang_pred, score, cross_entropy and rejected.

    Defined results: ``und`` with score 0 if the text is null or has no letter, or if nothing was learned; with
    ``reject`` also where the text is rejected. Ties go to the language first in order. Rows without lang or doc_id
    teach nothing; a doc_id that repeats counts once for each of its rows; columns of the added names are replaced, all
    others pass through; an empty table gives an empty result.
    """

    def __init__(self, per_language: int = PER_LANGUAGE):
        self.per_language = per_language

    def fit(self, docs: DataFrame) -> LanguageIdentifier:
        spark = docs.sparkSession
        space = Workspace(spark, "langid")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("doc_id is not null and lang is not null")
        order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
        few = rows.filter(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= self.per_language).distinct()
        # At most per_language ids a language are sent to the scan.
        sample = space.store(rows.join(F.broadcast(few), ["doc_id", "lang"]).select("text", "lang", (F.col("r") % CALIBRATE == 0).alias("aside")), "sample")
        taught, aside = sample.filter("not aside or aside is null").drop("aside"), sample.filter("aside").drop("aside")
        chars = taught.select("text").mapInArrow(_characters, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(ALPHABET).toPandas()["c"].tolist()
        self.languages = [x["lang"] for x in taught.select("lang").distinct().orderBy("lang").collect()]
        if not self.languages:
            return self
        table = symbol_table(chars)
        counts = taught.mapInArrow(_count(spark.sparkContext.broadcast(table)), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
        by = {k: (g.sort_values("code")["code"].to_numpy(np.int64).view(U), g.sort_values("code")["n"].to_numpy(np.int64)) for k, g in counts.groupby("lang")}
        model = KneserNey(self.languages, table, by)
        self.sent = spark.sparkContext.broadcast(model.state())
        self.sharp, self.limits = 0.5, dict.fromkeys(self.languages, float("inf"))
        seen = aside.mapInArrow(_entropies(self.sent), "lang string, h array<double>, n long").toPandas()
        if len(seen) and self.languages:
            h, n = np.array(seen["h"].tolist()), seen["n"].to_numpy()
            known = seen["lang"].isin(self.languages).to_numpy()
            truth = np.array([self.languages.index(x) if x in self.languages else 0 for x in seen["lang"]])
            loss = {a: -np.log(np.maximum(_posterior(h, n, a)[np.arange(len(h)), truth], 1e-9))[known].mean() for a in (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)}
            self.sharp = min(loss, key=lambda a: (loss[a], -a))
            best = h.argmin(axis=1)
            for j, name in enumerate(self.languages):
                own = h[(best == j) & (truth == j) & known, j]
                if len(own) >= 10:
                    self.limits[name] = float(own.mean() + 4 * own.std() + 0.1)
        return self

    def predict(self, docs: DataFrame, reject: bool = True) -> DataFrame:
        added = ("lang_pred", "score", "cross_entropy", "rejected")
        rest = F.struct(*[docs[c] for c in docs.columns if c not in added]).alias("rest")
        text = F.col("text").cast("string")
        rows = docs.select(rest, F.coalesce(text, F.lit("")).alias("text"))
        if not self.languages:
            return rows.select("rest.*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"), F.lit(True).alias("rejected"))
        schema = StructType([rows.schema["rest"], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("cross_entropy", DoubleType()), StructField("rejected", BooleanType())])
        out = rows.mapInArrow(_predict(self.sent, self.sharp, self.limits), schema)
        letters = F.coalesce(F.col("rest.text").cast("string").rlike(r"\p{L}"), F.lit(False))
        named = letters & ~F.col("rejected") if reject else letters
        return out.select("rest.*", F.when(named, F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(letters, F.col("score")).otherwise(0.0).alias("score"), "cross_entropy", (F.col("rejected") | ~letters).alias("rejected"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = LanguageIdentifier().fit(docs.filter(~held_out("doc_id", 5)))
    out = model.predict(docs.select("doc_id", held_out("doc_id", 5).alias("held_out"), "text"), reject=False)
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
