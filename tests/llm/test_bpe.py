import hashlib

import pytest
from tokenizers import Tokenizer

import numpy as np
from grantlens.llm.bpe import BpeCodec, Coder, Transducer, Vocabulary, default_vocabulary, op6_bpe
from llm_cases import EDGE, SF, docs

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_vocabulary())


def test_automaton_is_minimal_and_exact():
    words = {w: [k, k + 1] for k, w in enumerate([b"", b"tap", b"taps", b"top", b"tops", b"stop", b"stops", b"\xc3\xa9t", b"t"])}
    t = Transducer.compile(words)
    other = [b"ta", b"to", b"sto", b"tapsx", b"x", b"\xc3"]
    numbers = t.numbers([*words, *other]).tolist()
    assert numbers[len(words) :] == [-1] * len(other)
    assert [t.ids[t.first[k] : t.first[k + 1]].tolist() for k in numbers[: len(words)]] == list(words.values())
    trie = len({w[:i] for w in words for i in range(len(w) + 1)})
    assert len(t.final) - 1 < trie  # suffixes are shared


def test_every_character_as_the_library(library):
    v = Vocabulary(default_vocabulary())
    coder = Coder(v, Transducer.compile({b" the": v.merge(b" the")}))
    for start in range(0, 0x3000, 64):
        text = " the".join(f"a{chr(c)}b {chr(c)}{chr(c)}1" for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        w = coder.words(text)
        coder.learn([w])
        ids = np.frombuffer(coder.encode(w), np.int32).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids and v.decode(ids) == text


def test_every_other_character_as_the_library(library):
    v = Vocabulary(default_vocabulary())
    coder = Coder(v, Transducer.compile({b" the": v.merge(b" the")}))
    for start in range(0x3000, 0x110000, 64):
        text = " the".join(f"a{chr(c)}b {chr(c)}{chr(c)}1" for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        w = coder.words(text)
        coder.learn([w])
        ids = np.frombuffer(coder.encode(w), np.int32).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids and v.decode(ids) == text


def test_long_words_merge_alike(library):
    v = Vocabulary(default_vocabulary())
    for text in ("ab" * 400, "=" * 5000, "antidisestablishmentarianism" * 9, "é" * 300):
        assert v.merge(text.encode()) == library.encode(text, add_special_tokens=False).ids


def test_edge_rows_and_round_trip(spark, library):
    rows = [*EDGE, (30, "x <|endoftext|> y<|endoftext|>"), (31, "  \n\n it's they'll   "), (32, "é é ‍")]
    codec = BpeCodec(spark, default_vocabulary())
    table = docs(spark, rows)
    got = codec.encode(table).collect()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == sorted(want, key=str)
    back = codec.decode(codec.encode(table)).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert codec.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect() == [(1, ""), (2, "")]
    assert codec.encode(table.limit(0)).count() == 0 and codec.encode_digests(table.limit(0)).count() == 0


def test_registered_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op6_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), SHA(",".join(map(str, ids))))
        assert r.decoded_sha256 == SHA(library.decode(ids, skip_special_tokens=False))
