import random
from collections import Counter, defaultdict

import corpus_pipeline as cp
from plumbline.llm import common, near_copies as m

D = "/root/testdata/sf0.1"


def brute_shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or ({b" ".join(w)} if w else {b""})


def brute_groups(docs):
    own, holders, group = {i: brute_shingles(t) for i, t in docs.items()}, defaultdict(list), {i: i for i in docs}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, s in own.items():
        shared = Counter(j for h in s for j in holders[h])
        for h in s:
            holders[h].append(i)
        for j, n in shared.items():
            if 9 * n >= 4 * (len(s) + len(own[j])) and (x := root(i)) != (y := root(j)):
                group[max(x, y)] = min(x, y)
    return {i: root(i) for i in docs}


def groups(df):
    return {r.doc_id: r.component_id for r in m.near_copies(df).collect()}


def test_groups_equal_brute_force(spark):
    df = common.table(spark, "/root/testdata/sf0.01", "documents")
    want = brute_groups({r.doc_id: r.text for r in df.collect()})
    assert groups(df) == want and len(set(want.values())) < len(want)


def test_edited_copies_of_every_size(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    docs = {}
    for size in (1, 4, 5, 6, 30, 300, 3000):
        base = [rng.choice(words) for _ in range(size)]
        for edits in (0, 0, *[max(1, size * k // 100) for k in (1, 2, 3, 4, 6)]):
            copy = list(base)
            for at in rng.sample(range(size), edits):
                copy[at] = f"x{rng.random()}"
            docs[len(docs)] = " ".join(copy)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = brute_groups(docs)
    assert len(set(want.values())) < len(want)
    for listed in (0, 50, 300_000):  # the order decides nothing
        monkeypatch.setattr(m, "LISTED", listed)
        assert groups(df) == want


def test_stage_drops_copies_beyond_six_bits(spark):
    docs = common.table(spark, D, "documents").filter("doc_id in (2499, 6743, 1949, 5884)")
    assert sorted(r.doc_id for r in cp.drop_near_duplicates(spark, docs, D).collect()) == [1949, 2499]


def test_repeats_nulls_extra_columns(spark):
    df = spark.createDataFrame([(3, None, 1), (2, "", 2), (2, "", 2), (None, "a b c d", 3), (9, "A b c  d", 4)], "doc_id long, text string, fp int")
    assert sorted(((r.doc_id or -1), r.component_id) for r in m.near_copies(df).collect()) == [(-1, 9), (2, 2), (2, 2), (3, 2), (9, 9)]
    assert m.near_copies(df.limit(0)).collect() == []


def test_chance_links_keep_their_documents(spark):
    docs = common.table(spark, D, "documents").filter("doc_id in (4699, 8575, 1700, 9388)")
    assert sorted(r.doc_id for r in cp.drop_near_duplicates(spark, docs, D).collect()) == [1700, 4699, 8575, 9388]


def test_a_crowd_of_copies_is_joined_before_its_pairs_are_listed(spark, monkeypatch):
    """Copies that each differ from one text, and most by more than the similarity from each other: few pairs of different groups are left."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    docs = {}
    for i in range(120):
        copy = list(base)
        for at in rng.sample(range(400), 1 + i % 8):
            copy[at] = f"x{rng.random()}"
        docs[i] = " ".join(copy)
    rests, mixed = [], m._mixed
    monkeypatch.setattr(m, "_mixed", lambda met, found: rests.append((out := mixed(met, found))[0].localCheckpoint()) or out)
    assert groups(spark.createDataFrame(list(docs.items()), "doc_id long, text string")) == brute_groups(docs)
    first, last = (m._apart(r).count() for r in rests)
    assert first > 1000 and 5 * last < first


def test_the_order_counts_all_texts(spark):
    """Shingles that 8 of 40,000 texts share come last in the order, so texts that share no more don't meet."""
    texts = spark.range(40_000, numPartitions=4).selectExpr("id", "id % 5000 as g").selectExpr("id", "concat_ws(' ', 'a' || g, 'b' || g, 'c' || g, 'd' || g, 'e' || g, 'u' || id) as text")
    listed, counts = m._order(texts)
    assert listed.tolist() == sorted(m._keys(m.shingles(f"a{g} b{g} c{g} d{g} e{g}"))[0] for g in range(5000)) and set(counts.tolist()) == {8}
    met = m._sets(texts, listed, counts).selectExpr("id", "explode(hashes) as h").groupBy("h").count()
    assert met.count() == 40_000 and met.filter("count > 1").count() == 0
