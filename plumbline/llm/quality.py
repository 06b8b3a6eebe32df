"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

A word has a sparse random index vector, drawn from its hash; its word vector adds the index vectors of the
words around it in the training texts. Words are hashed to BUCKETS rows, so the table's size is fixed. Each
token gives two words: its lower-cased core and its shape (letter case, digits, punctuation); a token that
repeats the one before it, and a line that repeats an earlier one, give one more each. A document is the mean
of its words' vectors. The network's logit is divided by a temperature fitted on a held-back fifth of the
training rows, so scores are probabilities.

Fitting reads at most `max_train` labelled rows (those of the smallest hash of doc_id, from rows outside the
held-out third), in one executor task that streams them; the model is a few MB. Scoring is one pass over whole
texts.
"""
from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline.llm.common import bounded, table, text_batches

NAME = "op10_quality"
BUCKETS, DIM, NONZERO, HIDDEN, MAX_TRAIN, SHRINK = 1 << 14, 64, 4, 24, 6000, 30
SPECIAL = 8  # the first buckets are for words that no token spells
AGAIN, LINE_AGAIN, EMPTY = 0, 1, 2

_PUNCT = re.compile(r"([^\w\s])\1{2,}")
_CORE = re.compile(r"^\W+|\W+$")


def shape(token: str) -> str:
    """Letters as A or a, digits as 9, runs of these as one; other characters as they are, runs cut to three."""
    out = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in token)
    return _PUNCT.sub(r"\1\1\1", re.sub(r"A+", "A", re.sub(r"a+", "a", re.sub(r"9+", "9", out))))


def _bucket(word: str) -> int:
    return SPECIAL + zlib.crc32(word.encode("utf-8", "surrogatepass")) % (BUCKETS - SPECIAL)


class Codes(dict):
    """token -> shape's bucket * BUCKETS + core's bucket, remembered for up to a bounded number of tokens."""

    def __missing__(self, token: str) -> int:
        if len(self) > 120_000:
            self.clear()
        code = _bucket("\x00" + shape(token)) * BUCKETS + _bucket(_CORE.sub("", token).lower())
        if len(token) <= 64:
            self[token] = code
        return code


def word_ids(text: str | None, codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of a text's shapes, of its cores, and of its other words."""
    tokens = (text or "").split()
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.array([EMPTY])
    x = np.array([codes[t] for t in tokens], np.int64)
    lines = [line for line in text.split("\n") if line]
    extra = [AGAIN] * int((x[1:] == x[:-1]).sum()) + [LINE_AGAIN] * (len(lines) - len(set(lines)))
    return x // BUCKETS, x % BUCKETS, np.array(extra, np.int64)


def index_entries() -> tuple[np.ndarray, np.ndarray]:
    """The dimensions and signs of each bucket's NONZERO entries, from the bucket's number alone."""
    rng = np.random.default_rng(20240601)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


class Context:
    """Sums, for each word, the index vectors of the words up to two places away."""

    def __init__(self):
        self.dims, self.signs = index_entries()
        self.sums, self.pairs, self.waiting = np.zeros(BUCKETS * DIM), [], 0

    def add(self, ids: np.ndarray) -> None:
        for gap in (1, 2):
            self.pairs.append(ids[:-gap] * BUCKETS + ids[gap:])
            self.waiting += len(self.pairs[-1])
        if self.waiting > 2_000_000:
            self.flush()

    def flush(self) -> None:
        seen, count = np.unique(np.concatenate([np.zeros(0, np.int64), *self.pairs]), return_counts=True)
        for word, other in ((seen // BUCKETS, seen % BUCKETS), (seen % BUCKETS, seen // BUCKETS)):
            for j in range(NONZERO):
                self.sums += np.bincount(word * DIM + self.dims[other, j], self.signs[other, j] * count, len(self.sums))
        self.pairs, self.waiting = [], 0

    def vectors(self) -> np.ndarray:
        """Each word's own index vector and half of its context's direction."""
        self.flush()
        own = np.bincount((np.arange(BUCKETS)[:, None] * DIM + self.dims).ravel(), self.signs.ravel(), BUCKETS * DIM)
        around = self.sums.reshape(BUCKETS, DIM)
        around = around / np.maximum(1e-9, np.linalg.norm(around, axis=1, keepdims=True))
        return (own.reshape(BUCKETS, DIM) / np.sqrt(NONZERO) + 0.5 * around).astype(np.float32)


def pool(ids: tuple[np.ndarray, np.ndarray, np.ndarray], vectors: np.ndarray) -> tuple[np.ndarray, int]:
    """The sum of the words' vectors over the number of tokens; that number."""
    total, n = np.zeros(vectors.shape[1], np.float32), max(1, len(ids[0]))
    for part in ids:
        for i in range(0, len(part), 1 << 14):
            total += vectors[part[i : i + (1 << 14)]].sum(axis=0)
    return total / n, n


def shrunk(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Short texts say little: what sets them apart from the mean counts in part."""
    return x * (n / (n + SHRINK))[:, None]


class Model:
    def __init__(self, vectors, mean, std, w1, b1, w2, b2, temperature, prior):
        self.vectors, self.mean, self.std, self.w1, self.b1, self.w2, self.b2, self.temperature, self.prior = vectors, mean, std, w1, b1, w2, b2, temperature, prior

    def score(self, pooled: np.ndarray, n: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(pooled), self.prior)
        z = np.tanh((shrunk(pooled - self.mean, n) / self.std) @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -60, 60).astype(np.float64)))


def _net(x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.01, decay: float = 1e-4):
    """Adam on the mean cross-entropy, over all rows at once."""
    rng = np.random.default_rng(7)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, rounds + 1):
        h = np.tanh(x @ p[0] + p[1])
        e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - y) / len(y)
        back = np.outer(e, p[2]) * (1 - h * h)
        for i, g in enumerate((x.T @ back + decay * p[0], back.sum(0), h.T @ e + decay * p[2], e.sum())):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return p


def fit(rows: Iterator[tuple[int, str | None, int]]) -> Model:
    """A model of (doc_id, text, quality) rows; without both labels, a constant score: their mean, or 0.5."""
    codes, context, docs, ys, keys = Codes(), Context(), [], [], []
    for doc_id, text, quality in rows:
        ids = word_ids(text, codes)
        context.add(ids[0])
        context.add(ids[1])
        docs.append([np.unique(part, return_counts=True) for part in ids] + [max(1, len(ids[0]))])
        ys.append(int(quality))
        keys.append((zlib.crc32(f"fold{doc_id}".encode()), doc_id or 0, zlib.crc32((text or "").encode("utf-8", "surrogatepass"))))
    vectors = context.vectors()
    if len(set(ys)) < 2:
        return Model(vectors, 0, 1, None, None, None, None, 1.0, float(np.mean(ys)) if ys else 0.5)
    order = sorted(range(len(ys)), key=keys.__getitem__)
    x = np.array([sum(((vectors[w] * c[:, None]).sum(0) for w, c in docs[i][:3]), np.zeros(DIM)) / docs[i][3] for i in order])
    y = np.array([ys[i] for i in order], float)
    mean, n = x.mean(0), np.array([docs[i][3] for i in order], float)
    x = shrunk(x - mean, n)
    std = x.std(0) + 1e-6
    x = x / std
    cut = len(y) - max(1, len(y) // 5)
    logits = None
    if 0 < y[:cut].mean() < 1:
        w1, b1, w2, b2 = _net(x[:cut], y[:cut])
        logits = np.tanh(x[cut:] @ w1 + b1) @ w2 + b2
    temperatures = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
    loss = [float(np.mean(np.logaddexp(0, np.where(y[cut:] > 0, -logits / t, logits / t)))) for t in temperatures] if logits is not None else [1.0]
    w1, b1, w2, b2 = _net(x, y)
    return Model(vectors, mean, std, w1, b1, w2, b2, float(temperatures[int(np.argmin(loss))]) if logits is not None else 1.0, None)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fitted on at most max_train labelled rows that aren't held out, in one executor task."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = documents.select(F.col("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # at most max_train rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in bounded(batches) for r in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["quality"].to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows), 5)], pa.binary())], ["model"])

    text_batches(documents.sparkSession)
    kept = texts.repartition(1)  # the sample is bounded
    found = kept.mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else fit(iter(()))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """documents with score (0 to 1) and predicted (1 where score >= 0.5), which replace columns of these names.

    Scores depend on the text alone: a null text scores as an empty one, repeated rows alike, whole long texts.
    An empty table gives an empty result.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = documents.drop("score", "predicted")
    schema = T.StructType([*kept.schema.fields]).add("score", T.DoubleType()).add("predicted", T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, codes = shared.value, Codes()
        for batch in bounded(batches):
            pooled = [pool(word_ids(t.as_py(), codes), model.vectors) for t in batch["text"]]
            s = model.score(np.array([x for x, _ in pooled], np.float32).reshape(len(pooled), -1), np.array([n for _, n in pooled], float))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    text_batches(documents.sparkSession)
    return kept.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(documents, table(spark, sf_dir, "labels"))
    return score(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
