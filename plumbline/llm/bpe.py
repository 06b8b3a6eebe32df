"""Byte-level BPE encoding and decoding by DuckDB queries in each partition.

Texts are cut into the pattern's matches; each distinct match that isn't itself a token is contracted in a
recursive query: token-position rows join the merge table, the leftmost pair of least rank of each word becomes
one token, until no pair is left. Decoding joins ids to the vocabulary and aggregates the bytes in order of position.

A word of any length is contracted by that query: one of more than CHUNK bytes in chunks, so that a round holds a
bounded number of positions. A row of tokens is a text's encoding if and only if each two neighbours in it are the
encoding of their own bytes; so chunks whose meeting tokens are, stand side by side, and elsewhere the tokens
around the place are contracted anew, a stretch that grows until both its ends fit (`_meet`).

Words and pieces met before are remembered, up to a bounded number (`Memory`). Ids are stored packed, as little-endian unsigned 32-bit
integers (`unpack` gives the array). DuckDB gets one thread, bounded memory and no disk in each worker.
"""
from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Generator, Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline.llm.common import bounded, give_back, table, text_batches

NAME = "op5_bpe"
WORDS_AT_ONCE, CHARS_AT_ONCE, TOKENS_AT_ONCE = 20_000, 2_000_000, 200_000

#: Rows that a worker holds at once, with their ids and bytes.
ROWS_AT_ONCE = 250

#: Words, pieces of texts and parts of long words that it remembers; fewer pieces, as finding their words anew takes little time.
WORDS, PIECES, PARTS = 150_000, 50_000, 50_000

#: Bytes of a long word that are contracted together, and how many of these chunks are at a time.
CHUNK, CHUNKS_AT_ONCE = 32, 2048

#: The rounds that one recursive query makes; the words that still have pairs then go into the next query.
ROUNDS = 64

_CONTRACT = f"""
WITH RECURSIVE s(w, toks, step) AS (
  SELECT w, toks, 0 FROM start
  UNION ALL
  SELECT s.w, list_concat(s.toks[1:b.p - 1], [b.rank], s.toks[b.p + 2:]), s.step + 1
  FROM s JOIN (
    SELECT w, arg_min(rank, rank::BIGINT * 4294967296 + pos) AS rank, arg_min(pos, rank::BIGINT * 4294967296 + pos) AS p
    FROM (SELECT w, pos, toks[pos]::BIGINT * 65536 + toks[pos + 1] AS pair FROM (SELECT w, toks, unnest(range(1, len(toks))) AS pos FROM s))
    JOIN merges USING (pair) GROUP BY w) b ON s.w = b.w
  WHERE s.step < {ROUNDS})
SELECT w, arg_max(toks, step) AS toks, max(step) AS steps FROM s GROUP BY w
"""

def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file, which the driver reads."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pieces(text: str) -> list[str] | None:
    """Cuts of a text at places where no match of the pattern can cross: before single spaces. None if it has
    white space where a cut could change a match."""
    if "\0" in text or text[:1] == " " and not text[1:2].strip() or _ODD(text):
        return None
    return text.replace(" ", "\0 ").split("\0")


_ODD = re.compile(r" (?!\S)(?<=\s\s)").search  # it looks for a fixed character first, five times faster than alternatives


class Memory:
    """What was found for keys, in two generations: when the newer has more than `most`, or than 16 times as many
    characters, the older goes, but for what was asked for since."""

    def __init__(self, most: int):
        self.most, self.chars, self.new, self.old = most, 0, {}, {}

    def __len__(self) -> int:
        return len(self.new) + len(self.old)

    def missing(self, keys: set[str]) -> set[str]:
        """The keys that aren't remembered, for the caller to add to `new`. The others are in it, until the next call."""
        if len(self.new) > self.most or self.chars > 16 * self.most:
            self.chars, self.new, self.old = 0, {}, self.new
        absent = keys.difference(self.new)
        self.chars += sum(map(len, absent))
        unknown = absent.difference(self.old)
        self.new.update((k, self.old.pop(k)) for k in absent.difference(unknown))
        return unknown


def merge_table(ranks: dict[bytes, int]) -> dict[str, np.ndarray]:
    """Each two tokens whose bytes together are a token, and its rank."""
    pair, rank = [], []
    for token, r in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pair.append((a << 16) + b)
                rank.append(r)
    return {"pair": np.array(pair, np.int64), "rank": np.array(rank, np.int32)}


class Codec:
    """Encodes and decodes with one DuckDB connection."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, merges: dict[str, np.ndarray] | None = None):
        self.ranks, self.match = ranks, regex.compile(pattern).findall
        self.words, self.chunks = Memory(WORDS), Memory(PIECES)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        self.tokens = {r: t for t, r in ranks.items()}
        self.parts: dict[bytes, array] = {}  # chunks and stretches of the long word at hand
        self._load("merges", merges or merge_table(ranks))
        self._load("vocabulary", {"id": np.array(list(ranks.values()), np.int32), "token": pa.array(list(ranks), pa.binary())})

    def _load(self, name: str, columns: dict) -> None:
        self.con.register("loaded", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM loaded")
        self.con.unregister("loaded")

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of words, with every pair contracted."""
        flat = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum([0, *map(len, words)], dtype=np.int32)
        numbers, out = np.arange(len(words), dtype=np.int32), [b""] * len(words)
        while len(numbers):
            start = pa.table({"w": numbers, "toks": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})  # noqa: F841  which the query reads
            got = self.con.sql(_CONTRACT).to_arrow_table()
            w, steps, lists = got["w"].to_numpy(), got["steps"].to_numpy(), got["toks"].combine_chunks()
            offsets, packed = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4").tobytes()
            for i, x, y in zip(w.tolist(), (4 * offsets[:-1]).tolist(), (4 * offsets[1:]).tolist()):
                out[i] = packed[x:y]
            again = steps >= ROUNDS
            numbers = w[again]
            flat = np.frombuffer(b"".join([out[i] for i in numbers]), "<u4").astype(np.int32)
            ends = np.cumsum([0, *[len(out[i]) // 4 for i in numbers]], dtype=np.int32)
        return out

    def encode_words(self, words: list[str]) -> None:
        """Remembers the packed ids of words."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        own = list(map(self.ranks.get, raw))
        self.words.new.update((w, r.to_bytes(4, "little")) for w, r in zip(words, own) if r is not None)
        todo = [i for i, r in enumerate(own) if r is None and len(raw[i]) <= CHUNK]
        for k in range(0, len(todo), WORDS_AT_ONCE):
            part = todo[k : k + WORDS_AT_ONCE]
            self.words.new.update(zip([words[i] for i in part], self._contract([raw[i] for i in part])))
        for i, r in enumerate(own):
            if r is None and len(raw[i]) > CHUNK:
                self.words.new[words[i]] = self._long(raw[i])

    def _learn(self, strings: Iterator[bytes]) -> None:
        """Contracts those strings that `parts` doesn't have."""
        new = sorted(set(strings).difference(self.parts))
        for k in range(0, len(new), WORDS_AT_ONCE):
            some = new[k : k + WORDS_AT_ONCE]
            self.parts.update(zip(some, [array("I", x) for x in self._contract(some)]))

    def _meet(self, left: array, right: array) -> Generator[bytes, None, tuple[int, array, int]]:
        """(i, middle, j): the last i tokens of `left` and the first j of `right` become `middle`.

        Yields each string whose tokens it needs, for the caller to `_learn`.
        """
        i = j = 1
        while True:
            stretch = b"".join([self.tokens[t] for t in left[-i:]] + [self.tokens[t] for t in right[:j]])
            if stretch not in self.parts:
                yield stretch
            middle = self.parts[stretch]
            if middle == left[-i:] + right[:j]:
                return i, middle, j
            ends = (left[-i - 1], middle[0]) if i < len(left) else None, (middle[-1], right[j]) if j < len(right) else None
            bad = []
            for pair in ends:
                two = b"".join([self.tokens[t] for t in pair]) if pair else b""
                if two and two not in self.parts:
                    yield two
                bad.append(bool(two) and tuple(self.parts[two]) != pair)
            if not any(bad):
                return i, middle, j
            i, j = min(len(left), 2 * i) if bad[0] else i, min(len(right), 2 * j) if bad[1] else j

    def _long(self, word: bytes) -> bytes:
        """The packed ids of a word of more than CHUNK bytes."""
        out, step = array("I"), CHUNK * CHUNKS_AT_ONCE
        for k in range(0, len(word), step):
            if len(self.parts) > PARTS:
                self.parts.clear()
            block = word[k : k + step]
            chunks = [block[x : x + CHUNK] for x in range(0, len(block), CHUNK)]
            self._learn(chunks)
            own = [self.parts[c] for c in chunks]
            meetings = {(c, d): self._meet(x, y) for c, d, x, y in zip(chunks, chunks[1:], own, own[1:])}
            while meetings:  # all meetings of neighbours ask at once, so that a query has many strings
                asked = {at: next(m, None) for at, m in meetings.items()}
                self._learn(x for x in asked.values() if x is not None)
                meetings = {at: m for at, m in meetings.items() if asked[at] is not None}
            for right in own:  # what neighbours leave of each other may differ from what they were: then some more are asked for
                if not out:
                    out.extend(right)
                    continue
                meeting = self._meet(out, right)
                while True:
                    try:
                        self._learn([next(meeting)])
                    except StopIteration as met:
                        i, middle, j = met.value
                        break
                out[-i:] = middle
                out.extend(right[j:])
        return np.frombuffer(out, np.uint32).astype("<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each whole text; none for a null or empty one."""
        out, i = [], 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < CHARS_AT_ONCE):
                size += len(texts[j] or "")
                j += 1
            cut = [pieces(t or "") for t in texts[i:j]]
            whole = [self.match(t or "") if c is None else None for c, t in zip(cut, texts[i:j])]
            fresh = self.chunks.missing(set().union(*[c for c in cut if c is not None]))
            # A space that no white space follows begins a match: such pieces are cut all at once, and there begins a piece.
            many = [p for p in fresh if p[:1] == " " and p[1:2].strip()]
            flat = self.match("".join(many))
            starts = [k for k, w in enumerate(flat) if w[0] == " "]
            single = {p: self.match(p) for p in fresh.difference(many)}
            self.encode_words(list(self.words.missing(set(flat).union(*single.values(), *[w for w in whole if w is not None]))))
            words, chunks = self.words.new, self.chunks.new
            found = list(map(words.__getitem__, flat))
            for p, x, y in zip(many, starts, [*starts, len(flat)][1:], strict=True):
                chunks[p] = found[x] if y == x + 1 else b"".join(found[x:y])
            for p, w in single.items():
                chunks[p] = b"".join(map(words.__getitem__, w))
            for c, w in zip(cut, whole):
                out.append(b"".join(map(words.__getitem__, w) if c is None else map(chunks.__getitem__, c)))
            i = j
        return out

    def decode(self, packed: list[bytes | None]) -> list[bytes]:
        """The bytes of each row of packed ids; ids outside the vocabulary give no bytes."""
        parts = []  # (row, its ids from one place on): bounded, as one row may be very long
        for row, x in enumerate(packed):
            ids = np.frombuffer(x or b"", "<u4").astype(np.int32)
            parts.extend((row, ids[k : k + TOKENS_AT_ONCE]) for k in range(0, len(ids), TOKENS_AT_ONCE))
        out, i = [[] for _ in packed], 0
        while i < len(parts):
            j, size = i, 0
            while j < len(parts) and (j == i or size + len(parts[j][1]) <= TOKENS_AT_ONCE):
                size += len(parts[j][1])
                j += 1
            flat = np.concatenate([ids for _, ids in parts[i:j]])
            self.con.register("tokens", pa.table({"pos": np.arange(size, dtype=np.int32), "id": flat}))
            got = self.con.sql("SELECT coalesce(token, ''::BLOB) AS token FROM tokens LEFT JOIN vocabulary USING (id) ORDER BY pos").to_arrow_table()
            ends = np.cumsum([0, *[len(ids) for _, ids in parts[i:j]]], dtype=np.int32)
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), got["token"].combine_chunks()), b"")
            for (row, _), x in zip(parts[i:j], texts.to_pylist(), strict=True):
                out[row].append(x)
            i = j
        return [b"".join(x) for x in out]


_CODECS: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """This worker's codec for a broadcast vocabulary."""
    if shared.value["key"] not in _CODECS:
        _CODECS.clear()
        _CODECS[shared.value["key"]] = Codec(shared.value["ranks"], merges=shared.value["merges"])
    return _CODECS[shared.value["key"]]


def forget() -> None:
    """Ends a task: the worker stays for other work, and what it remembers of words, and DuckDB's memory, would stay with it."""
    for codec in _CODECS.values():
        codec.con.close()
    _CODECS.clear()


def _share(spark: SparkSession, vocabulary: str):
    ranks = read_ranks(vocabulary)
    return spark.sparkContext.broadcast({"key": hash(frozenset(ranks.items())), "ranks": ranks, "merges": merge_table(ranks)})


def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of batches that a worker holds at once."""
    return bounded(batches, ROWS_AT_ONCE, 2 << 20)


def _add(df: DataFrame, names: list[str], run) -> DataFrame:
    kept = df.drop(*names)
    schema = T.StructType([*kept.schema.fields, *[T.StructField(n, T.BinaryType()) for n in names]])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in held(batches):
            new = run(part)
            yield pa.RecordBatch.from_arrays([*[part[n] for n in kept_names], *[pa.array(x, pa.binary()) for x in new]], [*kept_names, *names])
        forget()
        give_back()

    kept_names = kept.columns
    text_batches(df.sparkSession)
    return df.select(*kept_names).mapInArrow(over, schema)


def encode(documents: DataFrame, vocabulary: str | None = None, decoded: bool = False) -> DataFrame:
    """documents with ids: each whole text's token ids, packed; and with `decoded`, these ids' bytes.

    A null text counts as empty and gets no ids. Special tokens are ordinary text. Repeated rows each get their
    ids; an empty table gives an empty result; ids and decoded replace columns of these names.
    """
    shared = _share(documents.sparkSession, vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))

    def run(batch: pa.RecordBatch) -> list[list[bytes]]:
        codec = _codec(shared)
        ids = codec.encode(batch["text"].to_pylist())
        return [ids, codec.decode(ids)] if decoded else [ids]

    return _add(documents, ["ids", "decoded"] if decoded else ["ids"], run)


def decode(tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """tokens(ids, ...) with decoded: the bytes of the packed ids; null ids count as none."""
    shared = _share(tokens.sparkSession, vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    names = [*[c for c in tokens.columns if c not in ("ids", "decoded")], "ids"]
    kept = T.StructType([*[tokens.schema[n] for n in names], T.StructField("decoded", T.BinaryType())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held(batches):
            out = _codec(shared).decode(batch["ids"].to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, "decoded"])
        forget()
        give_back()

    return tokens.select(*names).mapInArrow(over, kept)


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def unpack(ids: Column) -> Column:
    """Packed ids as array<long>."""
    at = lambda i, k: F.hex(F.substring(ids, i * 4 + k, F.lit(1)))
    code = lambda i: F.conv(F.concat(at(i, 4), at(i, 3), at(i, 2), at(i, 1)), 16, 10).cast("long")
    return F.when(F.octet_length(ids) > 0, F.transform(F.sequence(F.lit(0), (F.octet_length(ids) / 4).cast("int") - 1), code)).otherwise(F.array().cast("array<bigint>"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    return coded.select("doc_id", n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
