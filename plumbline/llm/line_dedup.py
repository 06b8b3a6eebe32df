"""Line dedup: lines that many documents share go, but for one document.

One pass hashes each document's distinct line keys to 128 bits; counting the distinct (key, document) rows finds
the repeated keys. Their hashes are dealt to shards, and each shard becomes a minimal perfect hash (levels of bit arrays
with ranks) that indexes compact arrays: a 64-bit fingerprint, the document count and the largest doc_id. A key
outside the index is told by its fingerprint (64 bits besides the 64 that place it). A second pass over the
documents probes the arrays: no text is shuffled and no line is joined.

Size: the shards of the most frequent keys, up to `max_index_bytes`, travel to the tasks and are probed in place.
Where there are more keys, the line hashes that these don't hold go to the other shards instead, and are probed
there; what they find goes back by document. Skew: a line in a third of all documents is counted after distinct rows of
a line and a document, and then probed in place; the keys that travel are the less frequent ones, dealt in blocks of bounded size.
"""
from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.llm.common import WHITE, bounded, discard, materialize, table, text_batches

NAME = "op4_line_dedup"
MIN_CHARS, MIN_DOCS = 40, 5
KEYS_PER_SHARD, MAX_INDEX_BYTES = 250_000, 64 << 20
BYTES_PER_KEY = 25  # fingerprint, count and doc_id of 8 bytes each, a mark; the hash itself takes under half a byte
ROWS_PER_BLOCK = 500_000  # line hashes that are probed together where they travel to a shard

_WHITE = WHITE.encode()
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def line_keys(text: str | None, min_chars: int) -> tuple[list[bytes], list[int], list[bytes]]:
    """The lines of a text, the numbers of those whose key is long enough, and these keys' 128-bit hashes."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    at, hashes = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(_WHITE).lower()  # bytes: A-Z only
            n = len(key)
            if n >= min_chars and (n >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
                at.append(i)
                hashes.append(xxhash.xxh3_128_digest(key))
    return lines, at, hashes


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    """A fresh 64-bit hash of x for each level (the finalizer of a splitmix generator)."""
    z = x + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: each level's bits mark keys that were alone in their slot."""

    def __init__(self, keys: np.ndarray, load: float = 1.0):
        self.levels, self.n = [], len(keys)
        rest = keys.astype(np.uint64)
        before = 0
        while len(rest):
            m = max(64, int(len(rest) / load))
            slot = (_mix(rest, len(self.levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(slot, minlength=m) == 1
            packed = np.packbits(alone)
            ranks = np.concatenate(([0], np.cumsum(_POP[packed], dtype=np.int64))) + before
            self.levels.append((m, packed, ranks.astype(np.int32)))
            before += int(alone.sum())
            rest = rest[~alone[slot]]
            if len(self.levels) > 200:
                raise ValueError("the keys are not distinct")

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number in 0..n-1; -1 for keys that reach no level (others outside the set get some number)."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (m, packed, ranks) in enumerate(self.levels):
            if not len(todo):
                break
            slot = (_mix(keys[todo], level) % np.uint64(m)).astype(np.int64)
            byte, bit = packed[slot >> 3], (slot & 7).astype(np.uint8)
            hit = (byte >> (7 - bit)) & 1 == 1
            before = np.where(bit > 0, _POP[byte >> (8 - np.maximum(bit, 1))], 0)
            out[todo[hit]] = (ranks[slot >> 3] + before)[hit]
            todo = todo[~hit]
        return out


class Shard:
    """A perfect hash and the arrays that it indexes; `orphan` marks keys that only documents without an id hold."""

    def __init__(self, h1, h2, count, keep, orphan):
        self.hash = PerfectHash(h1)
        order = np.empty(len(h1), np.int64)
        order[self.hash.index(h1)] = np.arange(len(h1))
        self.fingerprint, self.count, self.keep, self.orphan = h2[order], count[order], keep[order], orphan[order]

    def gone(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys the index holds, and which of them go from the documents of these ids."""
        at = self.hash.index(h1)
        found = (at >= 0) & (self.fingerprint[at] == h2) if self.hash.n else np.zeros(len(h1), bool)
        if not found.any():
            return found, found
        kept = np.where(no_id, self.orphan[at], ~self.orphan[at] & (self.keep[at] == ids))
        return found, found & (self.count[at] > 0) & ~kept


class Index:
    """Shards by number; a key's shard is told by its second hash."""

    def __init__(self, shards: dict[int, Shard], n: int):
        self.shards, self.n = shards, n

    def gone(self, h: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, gone = np.zeros(len(h), bool), np.zeros(len(h), bool)
        which = h[:, 1] % self.n  # numpy's sign follows the divisor, as pmod's
        for s, shard in self.shards.items():
            mine = np.flatnonzero(which == s)
            found[mine], gone[mine] = shard.gone(h[mine, 0].view(np.uint64), h[mine, 1], ids[mine], no_id[mine])
        return found, gone


def ids_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The doc_ids of an Arrow column, 0 for a null, and which are null."""
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def hashed(texts: list, min_chars: int) -> tuple[list, list[int], list[int], np.ndarray]:
    """The lines of each text; the text's number, the line's and the two hashes of each key that is long enough."""
    lines, rows, places, hashes = [], [], [], []
    for r, text in enumerate(texts):
        own, at, keys = line_keys(text, min_chars)
        lines.append(own)
        rows.extend([r] * len(at))
        places.extend(at)
        hashes.extend(keys)
    return lines, rows, places, np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)


def line_hashes(documents: DataFrame, min_chars: int, known=None) -> DataFrame:
    """(h1, h2, doc_id) of each document's distinct long keys; without those that the index `known` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            _, rows, _, h = hashed(batch["text"].to_pylist(), min_chars)
            ids, no_id = ids_of(batch["doc_id"])
            own = np.array(rows, np.int64)
            if known is not None:
                found, _ = known.value.gone(h, ids[own], no_id[own])
                h, own = h[~found], own[~found]
            if len(h):
                _, first = np.unique(np.column_stack((own, h)), axis=0, return_index=True)
                h, own = h[first], own[first]
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids[own], mask=no_id[own])], ["h1", "h2", "doc_id"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "h1 long, h2 long, doc_id long")


def repeated_lines(documents: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(h1, h2, n, keep): each key of at least min_chars in at least min_docs documents, and their largest doc_id."""
    counts = line_hashes(documents, min_chars).groupBy("h1", "h2").agg(F.count_distinct(F.struct("doc_id")).alias("n"), F.max("doc_id").alias("keep"))
    return counts.filter(F.col("n") >= min_docs)


def build_index(repeated: DataFrame, shards: int) -> DataFrame:
    """(shard, blob): each shard's keys come together in one task, KEYS_PER_SHARD of them on average."""

    def build(rows: pa.Table) -> pa.Table:
        h1, h2, n, keep, orphan = (rows[c].to_numpy() for c in ("h1", "h2", "n", "keep", "orphan"))
        return pa.table({"shard": rows["shard"][:1], "blob": pa.array([pickle.dumps(Shard(h1.view(np.uint64), h2, n, keep, orphan), 5)], pa.binary())})

    kept = repeated.withColumns({"orphan": F.col("keep").isNull(), "keep": F.coalesce("keep", F.lit(0).cast("long"))})
    return kept.withColumn("shard", F.pmod("h2", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(build, "shard int, blob binary")


def _shards(n_keys: int) -> int:
    return max(1, -(-n_keys // KEYS_PER_SHARD))


def _floor(repeated: DataFrame, most_keys: int) -> int:
    """The least power of two so that at most `most_keys` keys are in that many documents or more."""
    sizes = {r.b: r["count"] for r in repeated.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().collect()}  # 63 rows at most
    kept, least = 0, 63
    while least > 0 and kept + sizes.get(least - 1, 0) <= most_keys:
        least -= 1
        kept += sizes.get(least, 0)
    return 1 << least


def _elsewhere(documents: DataFrame, rare: DataFrame, n_rare: int, known, min_chars: int) -> tuple[DataFrame, list[str]]:
    """(doc_id, h1, h2) of the rare keys that go, probed where their shard is; and the paths of its tables."""
    shards = _shards(n_rare)
    index, path = materialize(build_index(rare, shards), "line-index")
    lines, lines_path = materialize(line_hashes(documents, min_chars, known), "rare-lines")
    blocks = max(1, -(-lines.count() // (shards * ROWS_PER_BLOCK)))
    lines = lines.withColumns({"shard": F.pmod("h2", F.lit(shards)).cast("int"), "block": F.pmod(F.xxhash64("doc_id", "h1"), F.lit(blocks))})
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return left.slice(0, 0).select(["doc_id", "h1", "h2"])
        no_id = left["doc_id"].is_null().to_numpy()
        ids = left["doc_id"].fill_null(0).to_numpy()
        _, gone = pickle.loads(right["blob"][0].as_py()).gone(left["h1"].to_numpy().view(np.uint64), left["h2"].to_numpy(), ids, no_id)
        return left.select(["doc_id", "h1", "h2"]).filter(pa.array(gone))

    met = lines.groupBy("shard", "block").cogroup(index.groupBy("shard", "block"))
    return met.applyInArrow(probe, "doc_id long, h1 long, h2 long"), [path, lines_path]


def _other_name(name: str, names: list[str]) -> str:
    while name.lower() in [x.lower() for x in names]:
        name += "_"
    return name


def dedup_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    r"""documents with text shortened to the lines that stay, and n_lines (before) and n_dropped.

    A line's key is the line stripped of white space ([\x20\x09-\x0D]) with A-Z lower-cased. Keys of at least
    min_chars code points found in at least min_docs documents (distinct doc_ids; rows with one doc_id are one
    document, a null doc_id counts as a document below all others) lose their lines in every document but the
    one with the largest doc_id. Null or empty text: one empty line, and the text becomes empty. Repeated rows
    keep or lose the same lines. An empty table gives an empty result; other columns stay as they are, but for
    those named n_lines and n_dropped, which are replaced.
    """
    spark = documents.sparkSession
    text_batches(spark)
    repeated, path = materialize(repeated_lines(documents, min_chars, min_docs), "repeated-lines")
    n = repeated.count()
    least = 0 if n * BYTES_PER_KEY <= max_index_bytes else _floor(repeated, max_index_bytes // BYTES_PER_KEY)
    hot = repeated.filter(F.col("n") >= least)
    n_hot = hot.count() if least else n
    shards = {r.shard: pickle.loads(r.blob) for r in build_index(hot, _shards(n_hot)).collect()} if n_hot else {}  # bounded by max_index_bytes
    index = spark.sparkContext.broadcast(Index(shards, _shards(n_hot)))
    kept = documents.drop("n_lines", "n_dropped")
    mark = _other_name("gone_keys", kept.columns)
    marked = kept
    if n > n_hot:
        gone, paths = _elsewhere(documents, repeated.filter(F.col("n") < least), n - n_hot, index, min_chars)
        own = _other_name("marked_id", kept.columns)
        by_document, marks_path = materialize(gone.groupBy(F.col("doc_id").alias(own)).agg(F.collect_set(F.struct("h1", "h2")).alias(mark)), "line-marks")  # as many as the document's lines
        marked = kept.join(by_document, kept["doc_id"].cast("long").eqNullSafe(by_document[own]), "left").drop(own)
        discard(spark, *paths)
    discard(spark, path)
    names = kept.columns
    fields = [T.StructField("text", T.StringType()) if f.name == "text" else f for f in kept.schema]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    has_marks = n > n_hot

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            originals = batch["text"].to_pylist()
            lines, rows, places, h = hashed(originals, min_chars)
            ids, no_id = ids_of(batch["doc_id"])
            own = np.array(rows, np.int64)
            _, gone = index.value.gone(h, ids[own], no_id[own])
            if has_marks:
                marks = [{(x["h1"], x["h2"]) for x in m or ()} for m in batch[mark].to_pylist()]
                gone = gone | np.array([(a, b) in marks[r] for r, (a, b) in zip(rows, h.tolist())], bool)
            dropped: dict[int, set] = {}
            for i in np.flatnonzero(gone):
                dropped.setdefault(rows[i], set()).add(places[i])
            texts = [b"\n".join(x for i, x in enumerate(lines[r]) if i not in dropped[r]).decode("utf-8", "surrogatepass") if r in dropped else text or "" for r, text in enumerate(originals)]
            columns = [pa.array(texts, pa.string()) if x == "text" else batch[x] for x in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in lines], pa.int64()), pa.array([len(dropped.get(r, ())) for r in range(len(lines))], pa.int64())], [*names, "n_lines", "n_dropped"])

    return marked.mapInArrow(probe, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keep AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
