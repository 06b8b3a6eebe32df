"""A corpus pipeline of five stages, each on all that the one before it kept.

STAGES: quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, byte-level BPE. Each
function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Null texts are judged as empty ones; after line dedup they are empty. Null doc_ids stay in every stage. Rows of one doc_id
are one document: they stay or go together where a stage decides by document. Other columns pass unread; n_chars follows the
text. An empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import bpe, decontaminate, line_dedup, near_copies, quality
from plumbline.llm.common import discard, materialize, table

#: SQL for run()'s rows: none, as a trained classifier and edit distances can't be expressed in it.
ORACLE_SQL = None

#: Ids to leave out travel to the tasks up to this many (8 bytes each); beyond it they meet the documents in a join.
MAX_IDS = 4_000_000

#: Benchmark items of fewer words don't make a document a leak: any text may hold a word or two.
MIN_WORDS = 5


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the rows whose doc_id is in gone(doc_id); null doc_ids stay. Rows of one doc_id go together, whatever their texts."""
    gone, _ = materialize(gone.filter("doc_id is not null").distinct(), "gone")
    few = gone.count() <= MAX_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels that aren't held out."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter("predicted = 1").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long lines that many of them share; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id (see `near_copies`)."""
    return without(docs, near_copies.near_copies(docs).filter("doc_id <> component_id").select("doc_id"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item of MIN_WORDS words or more, nor a passage within the edit distance of one."""
    return without(docs, decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), min_words=MIN_WORDS).select("doc_id"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the packed ids and the text decoded from them."""
    coded = bpe.encode(docs.select("doc_id", "text"), decoded=True)
    return coded.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [("quality classifier", keep_quality), ("line dedup", drop_lines), ("SimHash near-dedup", drop_near_duplicates), ("benchmark decontamination", drop_leaks), ("byte-level BPE", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs, path = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        discard(spark, *before)
        before = [path]
    return docs
