import random

import numpy as np

from plumbline.llm import decontaminate as m


def distance(item, words):
    """Least edit distance of the item to any stretch of words."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        words[i : i + 1] = rng.choice([[], ["new%d" % rng.randrange(99)], [words[i], "more"]])
    return words


def corpus(seed, n_docs=150):
    rng = random.Random(seed)
    words = ["w%d" % int(rng.paretovariate(0.6)) for _ in range(4000)]
    pick = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, pick(rng.randrange(5, 60))) for i in range(25)] + [(99, pick(3)), (98, []), (None, pick(12))]
    docs = []
    for d in range(n_docs):
        parts = [pick(rng.randrange(0, 80))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            item = rng.choice(items[:25])[1]
            parts += [edited(rng, item, rng.randrange(0, int(0.3 * len(item)) + 1)), pick(rng.randrange(0, 30))]
        docs.append((d, sum(parts, [])))
    return items, docs


def test_fit_distance():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        assert m.fit_distance(np.array(a), np.array(b))[0] == distance(a, b)


def test_against_brute_force(spark):
    items, docs = corpus(2, 60)
    want = {(d, i): e for d, ws in docs for i, w in items if w and (e := distance(w, ws)) <= int(0.2 * len(w) + 1e-9)}
    text = lambda ws: ", ".join(w.upper() + "!" for w in ws)
    got = m.find_leaks(spark.createDataFrame([(d, text(w)) for d, w in docs], "doc_id long, text string"), spark.createDataFrame([(i, text(w) or None) for i, w in items], "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in got}
    assert set(got) <= set(want)
    assert all(got.get(k) == 0 for k, e in want.items() if e == 0)
    assert len(got) >= 0.97 * len(want) and len(want) > 30
    assert all(got[k] == want[k] for k in got)


def test_edge_cases(spark):
    item = "One two, three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "x " * 40000 + item.lower() + " y", 0), (3, item, 0), (3, item, 0), (None, item + " " + item, 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(5, item), (6, item), (7, None), (8, "one two")], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id, r.edits, r.end_word) for r in m.find_leaks(docs, items).collect())
    long = [(d, i, 0, e) for i in (5, 6) for d, e in ((3, 40010), (3, 10), (3, 10), (-1, 10))]
    assert got == sorted(long + [(d, 8, 0, e) for d, e in ((3, 40002), (3, 2), (3, 2), (-1, 2))])
    assert {r.item_id for r in m.find_leaks(docs, items, min_words=5).collect()} == {5, 6}
    assert m.find_leaks(docs.limit(0), items).collect() == m.find_leaks(docs, items.limit(0)).collect() == []


def test_short_items_are_found_exactly():
    """Of one to four words: every document that holds the words in a row, at the first place, and no other."""
    rng = random.Random(4)
    items = [(i, [f"w{rng.randrange(6)}" for _ in range(n)]) for i, n in enumerate((1, 1, 2, 2, 3, 3, 4, 4))] + [(50, [f"w{rng.randrange(6)}" for _ in range(9)])]
    index = m.Index(items)
    docs = [[f"w{rng.randrange(9)}" for _ in range(rng.randrange(0, 14))] for _ in range(200)]
    got = {(d, k): end for d, k, edits, end in index.search([np.array([index.numbers.get(w, 0) for w in ws], np.int64) for ws in docs]) if k < 8}
    want = {(d, k): p + len(w) for d, ws in enumerate(docs) for k, (_, w) in enumerate(items[:8]) for p in [next((p for p in range(len(ws) - len(w) + 1) if ws[p : p + len(w)] == w), None)] if p is not None}
    assert got == want and len(want) > 50


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_WORDS", 60)
    items, docs = corpus(3, 40)
    assert len(list(m._blocks(x for x in items if len(x[1]) >= 5))) > 3 and list(m._blocks(iter(()))) == [[]]
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in m.find_leaks(frame, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()}
    want = {(d, i) for d, ws in docs for i, w in items if len(w) >= 5 and distance(w, ws) == 0}
    assert want <= got
