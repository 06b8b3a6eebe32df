import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from plumbline.llm import bpe, common, decontaminate, line_dedup, quality
from test_near_copies import brute_groups

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = common.table(spark, D, "documents"), []
    for _, stage in cp.STAGES:
        after, _ = common.materialize(stage(spark, docs, D), "test-stage")
        out.append((docs, after))
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(spark, stages):
    columns = common.table(spark, D, "documents").columns
    for before, after in stages[:-1]:
        assert after.columns == columns and after.count() <= before.count()


def test_quality_stage(spark, stages):
    before, after = (texts(x) for x in stages[0])
    labels = {r.doc_id: r.quality for r in common.table(spark, D, "labels").collect()}
    assert all(before[i] == t for i, t in after.items())
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in after for i in good) >= 0.99 * len(good) and sum(i in after for i in bad) <= 0.05 * len(bad)


def test_line_stage(stages):
    before, after = (texts(x) for x in stages[1])
    holders = {}
    for i, t in before.items():
        for line in set(t.split("\n")):
            key = line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
            if len(key) >= 40:
                holders.setdefault(key, set()).add(i)
    for i, t in before.items():
        keep = [x for x in t.split("\n") if not (len(h := holders.get(x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}), ())) >= 5 and i != max(h))]
        assert after[i] == "\n".join(keep)


def test_near_duplicate_stage(stages):
    """One document, the first, of each group connected by five-word similarities of 0.8 or more."""
    before, after = (texts(x) for x in stages[2])
    assert set(after) == set(brute_groups(before).values()) and len(after) < len(before)


def test_leak_stage(spark, stages):
    before, after = (texts(x) for x in stages[3])
    items = [" ".join(decontaminate.normal_words(r.text)) for r in common.table(spark, D, "benchmark").collect()]
    leaky = {i for i, t in before.items() if any(f" {x} " in f" {' '.join(decontaminate.normal_words(t))} " for x in items)}
    assert leaky and not leaky & set(after) and len(before) - len(after) <= len(leaky) + 3


def test_token_stage(stages):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    before, after = texts(stages[4][0]), stages[4][1].collect()
    assert {r.doc_id: r.text for r in after} == before
    assert all(r.n_tokens == len(own.encode_ordinary(before[r.doc_id])) for r in after)


def test_run_on_empty_null_and_repeated_rows(spark, tmp_path):
    """Repeated rows are one document, null and empty texts one text; an empty table gives an empty result."""
    for name in ("labels", "benchmark"):
        common.table(spark, D, name).write.parquet(f"{tmp_path}/{name}.parquet")
    documents = common.table(spark, D, "documents")
    good = common.table(spark, D, "labels").filter("quality = 1").limit(3)
    some = documents.join(good, "doc_id", "left_semi")
    odd = spark.createDataFrame([(-1, None, "en", "x", 0), (-2, "", "en", "x", 0), (None, None, "en", "x", 0)], documents.schema)
    for rows, empty in ((some.union(some).union(odd), False), (documents.limit(0), True)):
        rows.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        got = cp.run(spark, str(tmp_path)).collect()
        assert all(r.text is not None and r.n_tokens >= 0 for r in got)
        assert bool(got) != empty and len(got) == len({r.doc_id for r in got}) * (1 if empty else 2) - sum(r.doc_id in (-1, -2, None) for r in got)


def test_without(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, "c")], "doc_id long, text string")
    gone = spark.createDataFrame([(1,), (None,)], "doc_id long")
    assert sorted(r.text for r in cp.without(docs, gone).collect()) == ["b", "c"]
    assert cp.without(docs.limit(0), gone).collect() == []
