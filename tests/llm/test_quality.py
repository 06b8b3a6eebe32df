import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import quality as m


def test_shape_and_ids():
    assert m.shape("THENHE!!") == "A!!" and m.shape("Ab12,") == "Aa9," and m.shape("x******") == "a***"
    codes = m.Codes()
    for text in (None, "", " \n\t"):
        shapes, cores, extra = m.word_ids(text, codes)
        assert len(shapes) == len(cores) == 0 and list(extra) == [m.EMPTY]
    shapes, cores, extra = m.word_ids("a a b\nline\nline", codes)
    assert len(shapes) == 5 and sorted(extra) == [m.AGAIN, m.AGAIN, m.LINE_AGAIN]


def test_held_out_rows_are_the_named_third(spark):
    rows = spark.range(200).select(F.col("id"), m.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = m.query(spark, d).alias("q").join(m.table(spark, d, "labels"), "doc_id").filter("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} other text {i}" + "!!! ###" * (i % 2)) for i in range(60)], "doc_id long, text string")
    good = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    bad = good.withColumn("quality", F.when(m.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in m.score(docs, m.train(docs, x)).collect()} for x in (good, bad))
    assert a == b


def test_nulls_repeats_clashes_long_and_empty(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "w " * 50000, None)], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = m.score(docs, m.train(docs, none)).collect()
    assert len(got) == 4 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    assert m.score(docs.limit(0), m.train(docs, none)).collect() == []
    one = spark.createDataFrame([(2, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert {r.score for r in m.score(docs, m.train(docs, one)).collect()} in ({1.0}, {0.5})


def test_vectors_pooling_and_network_equal_plain_python():
    """Every sum by loops over Python floats: index vectors, contexts two words apart, means, and the network's score."""
    rng = np.random.default_rng(3)
    dims, signs = m.index_entries()
    texts = ["the cat sat on the mat", "A b\nA b\n99 bottles!!! ####", "one", "", None, "w " * 40]
    context, codes, sums = m.Context(), m.Codes(), {}
    own = lambda w: [sum(float(signs[w, j]) for j in range(m.NONZERO) if dims[w, j] == d) for d in range(m.DIM)]
    for t in texts:
        for ids in m.word_ids(t, codes)[:2]:
            context.add(ids)
            for i, w in enumerate(ids.tolist()):
                for k in (i - 2, i - 1, i + 1, i + 2):
                    if 0 <= k < len(ids):
                        sums[w] = [a + b for a, b in zip(sums.get(w, [0.0] * m.DIM), own(int(ids[k])))]
    vectors = context.vectors()

    def vector(w):
        around = sums.get(w, [0.0] * m.DIM)
        size = max(1e-9, sum(x * x for x in around) ** 0.5)
        return [a / m.NONZERO**0.5 + 0.5 * b / size for a, b in zip(own(w), around)]

    model = m.Model(vectors, rng.normal(size=m.DIM), rng.random(m.DIM) + 0.5, rng.normal(size=(m.DIM, m.HIDDEN)), rng.normal(size=m.HIDDEN), rng.normal(size=m.HIDDEN), 0.3, 1.7, None)
    for t in texts:
        parts = m.word_ids(t, codes)
        words = [w for p in parts for w in p.tolist()]
        n = max(1, len(parts[0]))
        pooled = [sum(vector(w)[d] for w in words) / n for d in range(m.DIM)]
        got, tokens = m.pool(parts, vectors)
        assert tokens == n and np.allclose(got, pooled, atol=1e-4)
        x = [(p - float(mu)) * (n / (n + m.SHRINK)) / float(sd) for p, mu, sd in zip(pooled, model.mean, model.std)]
        hidden = [math.tanh(sum(x[d] * float(model.w1[d, h]) for d in range(m.DIM)) + float(model.b1[h])) for h in range(m.HIDDEN)]
        z = sum(a * float(b) for a, b in zip(hidden, model.w2)) + model.b2
        assert abs(model.score(np.array([got]), np.array([float(n)]))[0] - 1 / (1 + math.exp(-z / model.temperature))) < 1e-4
