"""BPE encoding and decoding with a minimal acyclic transducer as the lexicon of frequent words.

Method. Frequent words of the corpus (counted over all documents, the ``LEXICON`` most frequent are kept) are encoded
once, exactly, and compiled into a minimal acyclic automaton: common prefixes and suffixes are shared, every edge carries
the number of words that sort before it, so that the sum along a path is the word's number, and that number names its
ids. The automaton is one file in the shared folder, sent along with the job (``SparkContext.addFile``) and memory-mapped
by the workers. Words that it lacks are merged exactly by the vocabulary's ranks. Whole texts go through; nothing is cut.

The vocabulary file (tokenizers JSON, byte-level BPE) is a parameter; it is read on the driver and sent to the tasks.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, shared_dir
from .textblocks import blocks, trimmed

LEXICON = 1 << 16  # words in the automaton, whatever the input
COUNT_BYTES = 1 << 22  # bytes of text over which a task counts words before it sends them
SEEN = 3  # occurrences within that which make a word worth sending
CACHE_BYTES = 1 << 26  # of words and ids that a task keeps resolved
ENTRY = 200  # bytes that a kept word costs besides its own and its ids
# Fixed value: the word pattern that the byte-level vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary (fixed rule: printable Latin-1
    stands for itself, the others follow from U+0100 on)."""
    itself = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in itself else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Ids of bytes, ranked merges and the bytes of each id; special tokens are matched in texts as they stand."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        ids = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in ids.items() if t not in self.special}
        self.bytes_of.update({i: t.encode() for t, i in self.special.items()})
        self.byte_ids = [ids[c] for c in byte_alphabet()]
        self.merges = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            self.merges.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pairs = keys[order]
        self.ranks, self.made = (np.array([m[k] for m in self.merges.values()], np.int64)[order] for k in (0, 1))

    @classmethod
    def of(cls, state: dict) -> Vocabulary:
        """From the plain dictionaries that a broadcast carries."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank, leftmost first, is merged until none is left."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > 48:
            return self._merge_long(ids)
        get = self.merges.get
        while len(ids) > 1:
            best = min((m for m in map(get, zip(ids, ids[1:], strict=False)) if m), default=None)
            if best is None:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and get((ids[i], ids[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """``merge`` of many words at once: in every step each word merges its pair of lowest rank wherever it stands
        (of overlapping places the left one); words without a pair leave. Long words go one by one."""
        out: list = [None] * len(words)
        short = [k for k, w in enumerate(words) if 0 < len(w) <= 48]
        for k, w in enumerate(words):
            if not 0 < len(w) <= 48:
                out[k] = self.merge(w)
        if not short:
            return out
        lengths = np.array([len(words[k]) for k in short])
        ids = np.array(self.byte_ids, np.int64)[np.frombuffer(b"".join(words[k] for k in short), np.uint8)]
        names = np.array(short)  # the words still here, and where each starts
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        none = len(self.pairs)
        while len(names):
            ends = np.append(starts[1:], len(ids))
            rank = np.full(len(ids), none, np.int64)
            key = ids[:-1] << 32 | ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), none - 1)
            known = self.pairs[at] == key
            rank[:-1][known] = self.ranks[at[known]]
            rank[ends - 1] = none
            least = np.minimum.reduceat(rank, starts)
            more = least < none
            for k in np.flatnonzero(~more).tolist():
                out[names[k]] = ids[starts[k] : ends[k]].tolist()
            sizes = ends - starts
            stay = np.repeat(more, sizes)
            hit = (rank == np.repeat(least, sizes)) & stay
            place = np.arange(len(ids))
            first = hit.copy()
            first[1:] &= ~hit[:-1]
            run = np.maximum.accumulate(np.where(first, place, 0))
            hit &= (place - run) % 2 == 0
            where = np.flatnonzero(hit)
            ids[where] = self.made[at[where]]
            stay[where + 1] = False
            sizes = np.add.reduceat(stay.astype(np.int64), starts)[more]
            ids, names = ids[stay], names[more]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(names) else starts[:0]
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same over a linked list with a heap, n log n for words of any length."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (m := self.merges.get((ids[i], ids[j]))):
                heapq.heappush(heap, (m[0], i, m[1], ids[i], ids[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, made, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]

    def decode(self, ids) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


class Transducer:
    """Minimal acyclic automaton over the bytes of words, with a table of ids by word number.

    Arrays: ``keys`` (state * 256 + byte, sorted), ``targets``, ``skips`` (words before the edge), ``final`` by state,
    ``first`` and ``ids`` (ids of word k are ids[first[k]:first[k + 1]]).
    """

    NAMES = ("keys", "targets", "skips", "final", "first", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, words: dict[bytes, list[int]]) -> Transducer:
        """Words in sorted order; a state is registered as soon as no later word can change it, equal states are one."""
        order = sorted(words)
        register: dict = {}
        made: list[tuple[bool, tuple]] = []

        def fix(state) -> int:
            key = (state[0], tuple(state[1]))
            at = register.get(key)
            if at is None:
                at = register[key] = len(made)
                made.append(key)
            return at

        path: list = [[False, []]]  # open states along the last word; an edge is (byte, fixed state)
        last = b""
        for w in order:
            k = 0
            while k < min(len(w), len(last)) and w[k] == last[k]:
                k += 1
            while len(path) - 1 > k:
                state = path.pop()
                path[-1][1].append((last[len(path) - 1], fix(state)))
            path.extend([False, []] for _ in range(len(w) - k))
            path[-1][0] = True
            last = w
        while len(path) > 1:
            state = path.pop()
            path[-1][1].append((last[len(path) - 1], fix(state)))
        root = fix(path[0])
        below = [0] * len(made)  # children are fixed before their parents
        keys, targets, skips = [], [], []
        for s, (final, edges) in enumerate(made):
            total = int(final)
            for byte, to in edges:
                keys.append(s * 256 + byte)
                targets.append(to)
                skips.append(total)
                total += below[to]
            below[s] = total
        ids = [words[w] for w in order]
        return cls({
            "keys": np.array(keys, np.int64), "targets": np.array(targets, np.int64), "skips": np.array(skips, np.int64),
            "final": np.array([f for f, _ in made] + [root], np.int64),  # the last entry names the root
            "first": np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64), "ids": np.array([i for x in ids for i in x], np.int64),
        })

    def to_bytes(self) -> bytes:
        arrays = [getattr(self, n) for n in self.NAMES]
        return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        """The file's arrays, memory-mapped: workers of one machine share its pages."""
        whole = np.asarray(np.memmap(path, np.int64, "r"))
        sizes, at, arrays = whole[: len(cls.NAMES)], len(cls.NAMES), {}
        for name, size in zip(cls.NAMES, sizes, strict=True):
            arrays[name] = whole[at : at + int(size)]
            at += int(size)
        return cls(arrays)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for those that the automaton lacks; all words step at once."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return out
        lengths = np.array([len(w) for w in words])
        starts = np.concatenate([[0], np.cumsum(lengths)])
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        live = np.arange(len(words))
        state, number = np.full(len(words), self.final[-1]), np.zeros(len(words), np.int64)
        step = 0
        while len(live):
            ended = lengths[live] == step
            at, s = live[ended], state[ended]
            out[at] = np.where(self.final[s] == 1, number[ended], -1)
            live, state, number = live[~ended], state[~ended], number[~ended]
            if not len(live):
                break
            key = state * 256 + data[starts[live] + step]
            e = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[e] == key
            live, e = live[found], e[found]
            state, number = self.targets[e], number[found] + self.skips[e]
            step += 1
        return out


def _frequent_words(batches):
    """(word, count) of white-space words seen often within about COUNT_BYTES of text. Words are told apart by their
    hash in lower case; the first of them stands for all, which only decides what the lexicon holds."""
    held, size = [], 0
    for batch in batches:
        for block in blocks(batch.column(0)):
            h, _, starts = block.words()
            held.append((h, starts, block.word_ends, block.data))
            size += len(block.data)
            if size >= COUNT_BYTES:
                yield _counted(held)
                held, size = [], 0
    if held:
        yield _counted(held)


def _counted(held):
    _, at, n = np.unique(np.concatenate([h for h, _, _, _ in held]), return_index=True, return_counts=True)
    often = n >= SEEN
    at, n = at[often], n[often]
    edges = np.concatenate([[0], np.cumsum([len(h) for h, _, _, _ in held])])
    part = np.searchsorted(edges, at, "right") - 1
    words = []
    for b, i in zip(part.tolist(), (at - edges[part]).tolist(), strict=True):
        _, starts, ends, data = held[b]
        words.append(data[starts[i] : min(ends[i], starts[i] + 64)].tobytes())
    return pa.record_batch([pa.array(words, pa.binary()), pa.array(n.astype(np.int64))], names=["word", "n"])


class Coder:
    """A task's coder: resolves each distinct word once (automaton, else exact merges) and joins what is known."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.find = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.ids: dict[str, bytes] = {}  # int32 ids
        self.held = self.merged = 0

    def words(self, text: str) -> list[str]:
        if self.special is None or not any(s in text for s in self.vocabulary.special):
            return self.find(text)
        out = []
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                out.append(part)
                self.ids[part] = np.int32(self.vocabulary.special[part]).tobytes()
            else:
                out += self.find(part)
        return out

    def learn(self, texts_words: list[list[str]]) -> None:
        """Resolves the words that are not known yet; what is kept is bounded by its bytes."""
        if self.held > CACHE_BYTES:
            self.ids = {s: np.int32(i).tobytes() for s, i in self.vocabulary.special.items()}
            self.held = 0
        new = list(set().union(*texts_words).difference(self.ids))
        raw = [w.encode() for w in new]
        first, ids = self.lexicon.first, self.lexicon.ids
        numbers = self.lexicon.numbers(raw)
        known = np.flatnonzero(numbers >= 0)
        at = numbers[known]
        for i, a, b in zip(known.tolist(), first[at].tolist(), first[at + 1].tolist(), strict=True):
            self.ids[new[i]] = ids[a:b].astype(np.int32).tobytes()
        unseen = np.flatnonzero(numbers < 0).tolist()
        for i, found in zip(unseen, self.vocabulary.merge_many([raw[i] for i in unseen]), strict=True):
            self.ids[new[i]] = np.array(found, np.int32).tobytes()
        self.held += sum(len(w) + len(self.ids[x]) + ENTRY for x, w in zip(new, raw, strict=True))
        self.merged += len(unseen)

    def encode(self, words: list[str]) -> bytes:
        """The int32 ids of known words, in order."""
        return b"".join(map(self.ids.__getitem__, words))


def _texts(column: pa.Array):
    """Runs of whole texts of about a block's size."""
    out, size = [], 0
    for x in column:
        text = x.as_py() or ""
        out.append(text)
        size += len(text)
        if size >= 1 << 20:
            yield out
            out, size = [], 0
    if out:
        yield out


def _encode(vocabulary, name: str, digest: bool):
    """One record batch per run of texts, so a task holds a run's ids and no more."""

    def run(batches):
        coder = Coder(Vocabulary.of(vocabulary.value), Transducer.mapped(SparkFiles.get(name)))
        piece = coder.vocabulary.bytes_of
        shown: dict[str, str] = {}
        back: dict[str, bytes] = {}
        held = 0
        for batch in batches:
            at = 0
            for texts in _texts(batch.column(1)):
                ids_of = batch.column(0).slice(at, len(texts))
                at += len(texts)
                words = [coder.words(t) for t in texts]
                coder.learn(words)
                if not digest:
                    flat = [coder.encode(w) for w in words]
                    ends = np.cumsum([0, *(len(x) // 4 for x in flat)])
                    values = pa.array(np.frombuffer(b"".join(flat), np.int32))
                    yield pa.RecordBatch.from_arrays([ids_of, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)], names=["doc_id", "ids"])
                    continue
                if held > 2 * CACHE_BYTES:
                    shown, back, held = {}, {}, 0
                for w in set().union(*words).difference(shown):
                    found = np.frombuffer(coder.ids[w], np.int32).tolist()
                    shown[w] = ",".join(map(str, found))
                    back[w] = b"".join(piece[i] for i in found)
                    held += 2 * len(w) + 6 * len(found) + ENTRY
                counts, sums = [], ([], [])
                for w in words:
                    joined = ",".join(map(shown.__getitem__, w))
                    text = b"".join(map(back.__getitem__, w)).decode("utf-8", "replace")
                    counts.append(joined.count(",") + 1 if w else 0)
                    sums[0].append(hashlib.sha256(joined.encode()).hexdigest())
                    sums[1].append(hashlib.sha256(text.encode()).hexdigest())
                yield pa.record_batch([ids_of, pa.array(counts, pa.int64()), *(pa.array(x, pa.string()) for x in sums)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _decode(vocabulary):
    def run(batches):
        known = Vocabulary.of(vocabulary.value)
        for batch in batches:
            texts = [known.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


class BpeCodec:
    """Encodes and decodes tables with a byte-level BPE vocabulary; see the module.

    Defined results: a null text is an empty one; an empty text has no ids; special tokens standing in a text get their
    id; other columns are ignored; rows that repeat, or have no doc_id, each keep their row; an empty table gives an
    empty result. ``decode`` turns null or empty ids into an empty text.
    """

    def __init__(self, spark: SparkSession, path: str, lexicon: int = LEXICON):
        self.spark, self.size = spark, lexicon
        self.vocabulary = Vocabulary(path)
        self.sent = spark.sparkContext.broadcast(vars(self.vocabulary))

    @staticmethod
    def _rows(docs: DataFrame) -> DataFrame:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def lexicon(self, docs: DataFrame) -> Transducer:
        counts = self._rows(docs).select("text").mapInArrow(trimmed(_frequent_words), "word binary, n long")
        space = Workspace(self.spark, "bpe")
        words_of = space.store(counts.groupBy("word").agg(F.sum("n").alias("n")), "words")
        # How many words have each count names the least count that leaves ``size`` words or fewer; no order of all words.
        sizes = words_of.groupBy("n").agg(F.count("*").alias("k")).toPandas().sort_values("n", ascending=False)
        kept = sizes["n"][sizes["k"].cumsum() <= self.size]
        often = words_of.filter(F.col("n") >= int(kept.min())).select("word").toPandas()["word"] if len(kept) else []
        space.keep()
        find = regex.compile(PATTERN).findall
        words: dict[bytes, list[int]] = {}
        for w in often:
            for part in find(" " + bytes(w).decode("utf-8", "ignore")) + find(bytes(w).decode("utf-8", "ignore")):
                raw = part.encode()
                words.setdefault(raw, [])
        order = list(words)
        return Transducer.compile(dict(zip(order, self.vocabulary.merge_many(order), strict=True)))

    def _sent_file(self, docs: DataFrame) -> str:
        raw = self.lexicon(docs).to_bytes()
        name = f"bpe-lexicon-{hashlib.sha256(raw).hexdigest()[:16]}.bin"
        where = f"{shared_dir(self.spark)}/{name}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            out = fs.create(path)
            out.write(bytearray(raw))
            out.close()
            fs.deleteOnExit(path)
        self.spark.sparkContext.addFile(where)
        return name

    def encode(self, docs: DataFrame) -> DataFrame:
        """(doc_id, ids)"""
        return self._rows(docs).mapInArrow(trimmed(_encode(self.sent, self._sent_file(docs), False)), "doc_id long, ids array<int>")

    def encode_digests(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_tokens, ids_sha256, decoded_sha256): the ids and what they decode to, hashed inside the task."""
        return self._rows(docs).mapInArrow(trimmed(_encode(self.sent, self._sent_file(docs), True)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

    def decode(self, encoded: DataFrame) -> DataFrame:
        """(doc_id, text) of (doc_id, ids)"""
        return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decode(self.sent), "doc_id long, text string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return BpeCodec(spark, path or default_vocabulary()).encode_digests(docs)
