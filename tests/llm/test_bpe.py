import base64
import hashlib
import random
import string
import time

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from plumbline.llm import bpe as m

RANKS = m.read_ranks(P.path("byte_bpe_50k.tiktoken"))
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = m.Codec(RANKS)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


text = st.lists(st.one_of(st.sampled_from([" ", "  ", "\n", " \n", "\t", "'s", "'ll", "the", "ing", "é", "ß", "1", "23", "!!", "_", " ", "\u0085", "\x1c", "²", "日本", "🙂", "<|endoftext|>"]), st.text(max_size=5)), max_size=25).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(text, max_size=4))
def test_matches_the_library(texts):
    got = CODEC.encode(texts)
    assert [ids(x) for x in got] == [TIKTOKEN.encode_ordinary(t) for t in texts]
    assert CODEC.decode(got) == [t.encode() for t in texts]


@pytest.mark.parametrize("word", ["z" * 20000, "ab" * 3000, "".join(random.Random(1).choice("etaoinshr") for _ in range(5000)), "".join(random.Random(2).choice("abz=-_") for _ in range(3000)), "é" * 2000])
def test_long_words(word):
    assert ids(CODEC.encode([word])[0]) == TIKTOKEN.encode_ordinary(word)


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["ab", "zZ", "etaoin", "theing", "=-", "é日"]).flatmap(lambda letters: st.text(letters, min_size=30, max_size=400)))
def test_words_of_several_chunks(word):
    assert ids(CODEC.encode([word])[0]) == TIKTOKEN.encode_ordinary(word)


def test_blocks_of_chunks_join(monkeypatch):
    monkeypatch.setattr(m, "CHUNKS_AT_ONCE", 3)
    for word in ("a" + "z" * 999, "abc" * 500, "".join(random.Random(5).choice("etaoinshr") for _ in range(2000))):
        assert ids(CODEC.encode([word])[0]) == TIKTOKEN.encode_ordinary(word)


@pytest.mark.parametrize("word", ["z" * 10_000_000, "a" + "z" * 3_000_001, "".join(random.Random(6).choice(string.ascii_letters) for _ in range(1_000_000)), base64.b64encode(random.Random(7).randbytes(750_000)).decode()], ids=["run", "shifted run", "letters", "base64"])
def test_very_long_words_take_a_bounded_time(word):
    codec, began = m.Codec(RANKS), time.time()
    got = codec.encode([word])
    assert time.time() - began < 90
    assert ids(got[0]) == TIKTOKEN.encode_ordinary(word) and codec.decode(got)[0] == word.encode()


def test_decode_in_parts(monkeypatch):
    monkeypatch.setattr(m, "TOKENS_AT_ONCE", 7)
    texts = ["", "a longer text of more tokens than seven, in parts", "b", None, "é日本"]
    assert CODEC.decode(CODEC.encode(texts)) == [(t or "").encode() for t in texts]
    assert CODEC.decode([None, np.array([60000, RANKS[b"a"]], "<u4").tobytes()]) == [b"", b"a"]


def test_tables(spark):
    rows = [(1, None, b"x"), (2, "", b""), (3, "a b  c\n\nd ", None), (3, "a b  c\n\nd ", None), (None, "word " * 60000, b"")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids binary")
    out = m.encode(df, decoded=True)
    got = out.withColumn("array", m.unpack(out.ids)).withColumn("n", m.n_tokens(out.ids)).collect()
    assert sorted(len(r.array) for r in got) == sorted(len(TIKTOKEN.encode_ordinary(t or "")) for _, t, _ in rows)
    for r in got:
        assert r.array == TIKTOKEN.encode_ordinary(r.text or "") and r.n == len(r.array)
        assert bytes(r.decoded) == (r.text or "").encode()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in m.decode(out.drop("decoded")).collect())
    assert m.encode(df.limit(0)).collect() == []


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in m.table(spark, sf_dir, "documents").collect()}
    for r in m.query(spark, sf_dir).collect():
        own = TIKTOKEN.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(own)
        assert r.ids_sha256 == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_what_a_worker_holds_is_bounded():
    """Pieces are forgotten beyond a number, and a worker gets its texts in small parts."""
    codec = m.Codec(RANKS)
    for k in range(4):
        text = " ".join(str(x)[-3:] + "," + str(x)[:-3] for x in range(100_000 + 60_000 * k, 160_000 + 60_000 * k))
        assert ids(codec.encode([text])[0]) == TIKTOKEN.encode_ordinary(text)
        assert len(codec.chunks) <= 165_000
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 5000] * 1000})
    sizes = [part.num_rows for part in m.held(iter([batch]))]
    assert sum(sizes) == 1000 and max(sizes) <= 250


def test_frequent_words_are_contracted_once():
    """Words that every text holds stay remembered while 200,000 others come and go, in a bounded memory."""
    codec, times = m.Codec(RANKS), {}
    contract = codec._contract

    def counted(words):
        for w in words:
            times[w] = times.get(w, 0) + 1
        return contract(words)

    codec._contract = counted
    frequent = [" " + "".join(random.Random(k).choices(string.ascii_lowercase, k=8)) for k in range(300)]
    for k in range(10):
        letters = "".join(random.Random(-1 - k).choices(string.ascii_lowercase, k=9 * 20_000))
        others = [" " + letters[9 * i : 9 * i + 9] for i in range(20_000)]
        text = "".join(frequent + others)
        assert ids(codec.encode([text])[0]) == TIKTOKEN.encode_ordinary(text)
        assert len(codec.words) <= 342_000 and len(codec.chunks) <= 165_000
    assert {times.get(w.encode(), 0) for w in frequent} <= {0, 1}


def test_long_words_are_remembered_up_to_a_number_of_characters():
    codec = m.Codec(RANKS)
    codec.words.most = codec.chunks.most = 1000
    for k in range(40):
        word = "z" * (3000 + k)
        assert ids(codec.encode([word])[0]) == TIKTOKEN.encode_ordinary(word)
        for memory in (codec.words, codec.chunks):
            assert sum(map(len, [*memory.new, *memory.old])) <= 2 * (16_000 + 3040)


def test_new_pieces_are_cut_together():
    """One search finds the words of all new pieces of a batch, but for those at which white space could join."""
    codec, calls = m.Codec(RANKS), []
    match = codec.match
    codec.match = lambda text: calls.append(text) or match(text)
    texts = ["".join(f" w{k * 7919 % 100_003:x}it's,{k}\n" for k in range(5000)), "a \n b \u0085x \x1cy \tz", "\n c\n", " d", "e ", " ", "\u3000 f", "_ 's 'll 12a !!\n'd"]
    got = codec.encode(texts)
    assert [ids(x) for x in got] == [TIKTOKEN.encode_ordinary(t) for t in texts]
    assert codec.decode(got) == [t.encode() for t in texts]
    assert len(calls) < 30
