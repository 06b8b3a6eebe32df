"""Benchmark decontamination: passages of documents within an edit distance of a benchmark item.

Words are white-space tokens, lower-cased, without other characters around their letters and digits. A passage
matches an item of n words if they differ by at most floor(max_edits * n) word edits (insert, delete, replace).

A CGK random walk embeds an item-sized window so that edit distance becomes Hamming distance: step j copies the
word under the pointer, and a random bit of (j, word) says whether the pointer moves on. Repetitions with fresh
bits, and in each several tables that sample a few of the coordinates, make a bit-sampling LSH; a window that
meets an item in any table is verified by the exact edit distance to every stretch of words around it.

Windows start at every word. One that can't match isn't embedded: a passage within d edits of n words shares at
least all but 2d of its pairs of adjacent different words and all but 3d of its triples, and counts of the
documents' pairs and triples known to some item rule windows out by this, losing nothing; so do counts of an
item's own words before the exact distance. An item too short for any edit (under 5 words, with a fifth) is found where its words
stand in a row: its windows are keyed whole and compared. Documents are read once and only matches leave a task: no shuffle, so no key can be hot. Items
are the query set; they are shared in blocks of bounded size, a pass for each block.
"""
from __future__ import annotations

import string
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.common import bounded, table, text_batches

NAME = "op7_decontaminate"
MAX_EDITS, REPEATS, TABLES, SAMPLED = 0.2, 8, 16, 2
BLOCK_WORDS, PAIR_BITS, WORDS_AT_ONCE, CACHE = 500_000, 22, 250_000, 50_000


def normal(token: str) -> str:
    """A token's letters and digits and what is between them, lower-cased."""
    token = token.strip(string.punctuation)  # the usual case, at once
    i, j = 0, len(token)
    while i < j and not token[i].isalnum():
        i += 1
    while j > i and not token[j - 1].isalnum():
        j -= 1
    return token[i:j].lower()


def normal_words(text: str | None) -> list[str]:
    return [w for w in map(normal, (text or "").split()) if w]


class Words(dict):
    """token -> the number of its word: 0 for a word in no item, -1 for no word; a bounded memory."""

    def __init__(self, numbers: dict[str, int]):
        self.numbers = numbers

    def __missing__(self, token: str) -> int:
        if len(self) > CACHE:
            self.clear()
        word = normal(token)
        n = self.numbers.get(word, 0) if word else -1
        if len(token) <= 64:
            self[token] = n
        return n


def fit_distance(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """The least edit distance of an item to a stretch of words, and the end of the first such stretch."""
    row = np.zeros(len(words) + 1, np.int64)  # an empty item fits anywhere
    steps = np.arange(len(words) + 1)
    for i, x in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (words != x), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps  # inserts, left to right
    end = int(np.argmin(row))
    return int(row[end]), end


class Index:
    """Items by length, with their keys in each table."""

    def __init__(self, items: list[tuple[int, list[str]]], max_edits: float = MAX_EDITS, seed: int = 11):
        self.numbers: dict[str, int] = {}
        self.items = [(i, np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in ws], np.int64)) for i, ws in items]
        self.max_edits, self.seed = max_edits, seed
        self.drawn: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}  # a walk's bits and sampled steps
        self.pairs, self.triples, self.own = (np.zeros(1 << PAIR_BITS, bool) for _ in range(3))
        self.by_length: dict[int, list[int]] = {}
        self.need: dict[int, tuple[int, int]] = {}  # the pairs and triples that the most edits leave of any item
        self.short: dict[int, list[int]] = {}  # items that no edit is allowed of, by length
        for k, (_, ids) in enumerate(self.items):
            if self.edits(len(ids)) == 0:
                self.short.setdefault(len(ids), []).append(k)
                continue
            two, new = self.pair(ids[:-1], ids[1:]), ids[:-1] != ids[1:]
            self.pairs[two[new]] = True
            three = new[:-1] & new[1:]
            self.triples[self.pair(two[:-1], ids[2:])[three]] = True
            n, d = len(ids), self.edits(len(ids))
            left = (int(new.sum()) - 2 * d, int(three.sum()) - 3 * d)
            self.need[n] = tuple(map(min, left, self.need.get(n, left)))
            self.own[self.pair(np.full(len(ids), k), ids)] = True
            self.by_length.setdefault(len(ids), []).append(k)
        self.keys = {}
        for n, members in self.by_length.items():
            own = self.embed(np.array([self.items[k][1] for k in members]))
            self.keys[n] = [self._sorted(own[:, t]) for t in range(own.shape[1])]

    @staticmethod
    def _sorted(column):
        order = np.argsort(column, kind="stable")
        return column[order], order

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (a.astype(np.uint64) << np.uint64(32)) ^ b.astype(np.uint64)
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def edits(self, n: int) -> int:
        return int(self.max_edits * n + 1e-9)

    def embed(self, windows: np.ndarray) -> np.ndarray:
        """windows (rows, n) -> keys (rows, REPEATS * TABLES): hashes of sampled coordinates of the walks."""
        rows, n = windows.shape
        padded = np.concatenate([windows, np.zeros((rows, 1), np.int64)], axis=1).astype(np.uint64)
        out = np.empty((rows, REPEATS * TABLES), np.uint64)
        at = np.arange(rows)
        for rep in range(REPEATS):
            if (n, rep) not in self.drawn:
                rng = np.random.default_rng([self.seed, rep, n])
                self.drawn[n, rep] = rng.integers(1, 2**63, 2 * n).astype(np.uint64) | np.uint64(1), rng.integers(0, 2 * n, (TABLES, SAMPLED))
            salts, sampled = self.drawn[n, rep]
            walk, place = np.empty((2 * n, rows), np.uint64), np.zeros(rows, np.int64)
            for j in range(2 * n):  # later steps mostly stand on the padding
                walk[j] = padded[at, place]
                bit = ((walk[j] + np.uint64(1)) * salts[j]) >> np.uint64(63)
                place = np.minimum(place + bit.astype(np.int64), n)
            for t in range(TABLES):
                key = np.full(rows, 1 + rep * TABLES + t, np.uint64)
                for j in sampled[t]:
                    key = (key ^ walk[j]) * np.uint64(0xBF58476D1CE4E5B9)
                    key ^= key >> np.uint64(29)
                out[:, rep * TABLES + t] = key
        return out

    def candidates(self, n: int, windows: np.ndarray) -> list[tuple[int, int]]:
        """(row of windows, item) of those that meet in some table."""
        found = set()
        own = self.embed(windows)
        for t, (keys, order) in enumerate(self.keys[n]):
            lo, hi = np.searchsorted(keys, own[:, t], "left"), np.searchsorted(keys, own[:, t], "right")
            for r in np.flatnonzero(hi > lo):
                found.update((int(r), self.by_length[n][order[k]]) for k in range(lo[r], hi[r]))
        return sorted(found)

    @staticmethod
    def row_keys(ids: np.ndarray, n: int) -> np.ndarray:
        """A key of the n words at each place."""
        out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
        for j in range(n):
            out = (out ^ ids[j : len(ids) - n + 1 + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return out

    def _exact(self, n: int, ids: np.ndarray, starts: np.ndarray, best: dict) -> None:
        """The first place of each item of n words in each document."""
        items = self.short[n]
        own = np.array([self.row_keys(self.items[k][1], n)[0] for k in items], np.uint64)
        keys = self.row_keys(ids, n)
        for at in np.flatnonzero(np.isin(keys, own)):
            for k in (items[i] for i in np.flatnonzero(own == keys[at])):
                if np.array_equal(ids[at : at + n], self.items[k][1]):
                    doc = int(np.searchsorted(starts, at, "right")) - 1
                    best.setdefault((doc, k), (0, int(at) + n - int(starts[doc])))

    def search(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(doc's number, item's number, edits, end) of each document and item that match, at the first best place."""
        if not self.items:
            return []
        gap = np.zeros(1, np.int64)
        ids = np.concatenate([x for d in docs for x in (d, gap)]) if docs else gap
        starts = np.concatenate(([0], np.cumsum([len(d) + 1 for d in docs])))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for n in self.short:
            self._exact(n, ids, starts, best)
        if self.by_length:
            self._near(ids, starts, best)
        return [(doc, k, edits, end) for (doc, k), (edits, end) in sorted(best.items())]

    def _near(self, ids: np.ndarray, starts: np.ndarray, best: dict) -> None:
        """Adds the items that differ by the edits allowed at most."""
        known = (ids[:-1] > 0) & (ids[1:] > 0) & (ids[:-1] != ids[1:])
        two = self.pair(ids[:-1], ids[1:])
        three = np.concatenate((known[:-1] & known[1:] & self.triples[self.pair(two[:-1], ids[2:])], [False])) if len(ids) > 2 else known & False
        sums = [np.concatenate(([0], np.cumsum(x, dtype=np.int32))) for x in (known & self.pairs[two], three)]
        last = len(ids) - 1
        span = max(n + self.edits(n) for n in self.by_length)
        fewest = min(two for two, _ in self.need.values())
        count = sums[0][np.minimum(np.arange(last + 1) + span - 1, last)] - sums[0]
        spots = np.flatnonzero(count >= fewest)
        for n in self.by_length if len(spots) else ():
            d = self.edits(n)
            live = spots
            for q, total, need in zip((2, 3), sums, self.need[n]):
                until = np.minimum(live + n + d - q + 1, last)
                live = live[total[until] - total[live] >= need]
            for i in range(0, len(live), 1 << 14):
                self._verify(n, d, live[i : i + (1 << 14)], ids, starts, best)

    def _verify(self, n, d, live, ids, starts, best) -> None:
        padded = np.concatenate([ids, np.zeros(n + 5 * d + 2, np.int64)])
        owner = np.searchsorted(starts, live, "right") - 1
        lo, hi = np.maximum(starts[owner], live - 2 * d - 1), np.minimum(starts[owner + 1] - 1, live + n + 3 * d + 1)
        near = lo[:, None] + np.arange(n + 5 * d + 2)
        near = np.where(near < hi[:, None], padded[near], 0)
        own = {k: ((near > 0) & self.own[self.pair(np.full(1, k), near)]).sum(1) >= n - d for k in self.by_length[n]}  # enough of an item's words
        some = np.flatnonzero(reduce(np.logical_or, own.values()))
        if not len(some):
            return
        live, owner, lo, hi = live[some], owner[some], lo[some], hi[some]
        windows = padded[live[:, None] + np.arange(n)]
        windows[live[:, None] + np.arange(n) >= starts[owner + 1][:, None] - 1] = 0  # not into the next document
        done = set()
        for r, k in self.candidates(n, windows):
            doc, a, b = int(owner[r]), int(lo[r]), int(hi[r])
            if not own[k][some[r]] or (doc, k, a // (d + 1)) in done:  # or looked at from nearby
                continue
            done.add((doc, k, a // (d + 1)))
            edits, end = fit_distance(self.items[k][1], ids[a:b])
            if edits <= d:
                new = (edits, a + end - int(starts[doc]))
                best[doc, k] = min(best.get((doc, k), new), new)


def _blocks(items: Iterator[tuple[int, list[str]]]) -> Iterator[list]:
    """The items in blocks of at most BLOCK_WORDS words, one block at least."""
    block, size, first = [], 0, True
    for item in items:
        if block and size + len(item[1]) > BLOCK_WORDS:
            yield block
            block, size, first = [], 0, False
        block.append(item)
        size += len(item[1])
    if block or first:
        yield block


def find_leaks(documents: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, min_words: int = 1) -> DataFrame:
    """(doc_id, item_id, end_word, n_words, edits, similarity) of each document row and item that match.

    edits is that of the best stretch found, end_word the number of the words up to its end, n_words the item's
    words, similarity 1 - edits / n_words. Items without words, or with fewer than min_words, match nothing; a caller may
    pass over short ones by n_words. Items with the same words each match; of items with one item_id, each counts. Null and empty texts match nothing.
    Repeated document rows each give their rows. Candidate search is by LSH (a measured recall above 0.99 on passages with up to the most
    edits, and certain for exact copies); what is returned is verified.
    """
    spark = documents.sparkSession
    text_batches(spark)
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator()  # a partition at a time
    items = ((r.item_id, w) for r in rows if len(w := normal_words(r.text)) >= max(1, min_words))
    return reduce(DataFrame.unionByName, [_scan(spark, documents, block, max_edits) for block in _blocks(items)])


def _scan(spark: SparkSession, documents: DataFrame, items: list, max_edits: float) -> DataFrame:
    shared = spark.sparkContext.broadcast(Index(items, max_edits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        words = Words(index.numbers)
        for batch in bounded(batches):
            rows, docs, owners, size = [], [], [], 0
            texts = batch["text"].to_pylist()
            for r, text in enumerate(texts):
                ids = np.array([words[t] for t in (text or "").split()], np.int64)
                docs.append(ids[ids >= 0])
                owners.append(r)
                size += len(ids)
                if size > WORDS_AT_ONCE or r == len(texts) - 1:
                    rows.extend((owners[a], *x) for a, *x in index.search(docs))
                    docs, owners, size = [], [], 0
            own = [index.items[k] for _, k, _, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array([x[0] for x in rows], pa.int64())), pa.array([i for i, _ in own], pa.int64()), pa.array([x[3] for x in rows], pa.int64()), pa.array([len(w) for _, w in own], pa.int64()), pa.array([x[2] for x in rows], pa.int64()), pa.array([1 - x[2] / len(w) for x, (_, w) in zip(rows, own)], pa.float64())],
                ["doc_id", "item_id", "end_word", "n_words", "edits", "similarity"],
            )

    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, "doc_id long, item_id long, end_word long, n_words long, edits long, similarity double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
