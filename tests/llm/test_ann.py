import math

import numpy as np

from plumbline.llm import ann as m


def brute(rows, every=100, k=10):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = {}
    for q, x in ok:
        if q % every == 0:
            best = {}
            for i, y in ok:
                if i != q:
                    d = float(np.sqrt(((x - y) ** 2).sum()))
                    best[i] = min(d, best.get(i, d))
            out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def check(got, want, least):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(by) == {q for q, w in want.items() if w}
    hits = total = 0
    for q, w in want.items():
        own = sorted(by.get(q, []))
        assert [r for r, _, _ in own] == list(range(1, len(w) + 1))
        assert [(s, v) for _, s, v in own] == sorted((s, v) for _, s, v in own) and q not in {v for _, _, v in own}
        exact = dict((i, d) for d, i in w)
        hits += sum(v in exact for _, _, v in own)
        total += len(w)
    assert hits >= least * total


def test_recall_on_the_table(spark):
    d = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding)) for r in m.table(spark, d, "embeddings").collect()]
    check(m.query(spark, d).collect(), brute(rows), 0.9)


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(0)
    lists = m.Lists(rng.normal(size=(3000, 16)), 64)
    x = rng.normal(size=(200, 16))
    ids, d = lists.search(x, 32)
    want = np.sqrt(m.distances(x, lists.centroids)).argmin(1)
    assert (ids[:, 0] == want).mean() > 0.95
    sizes = np.bincount(lists.assign(rng.normal(size=(3000, 16)))[1], minlength=64)
    assert sizes.min() > 0


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 0.5]), (8, [1.0, 0.5]), (9, [-1.0, 0.0]), (10, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    got = m.search(df, df.filter("vec_id % 100 = 0")).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1, 7, 0.5), (0, 2, 8, 0.5), (0, 3, 9, 2.0)]
    assert m.search(df.limit(0), df.limit(0)).collect() == []


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0] * 8 if i % 3 == 0 else rng.normal(size=8).round(3).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = m.search(df, df.filter("vec_id % 100 = 0")).collect()
    check(got, brute(rows), 0.9)
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 300), key=lambda r: r.rank)] == list(range(0, 30, 3))
