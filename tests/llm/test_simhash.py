import itertools
import random
import re

import xxhash

from plumbline.llm import simhash as m


def brute_fp(text, k=3):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: {node: fp}; each node's smallest reachable node."""
    at = {i: i for i in fps}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in itertools.combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            x, y = root(a), root(b)
            at[max(x, y)] = min(x, y)
    return {i: root(i) for i in fps}


def test_masks_cover():
    for radius in (0, 1, 2, 3):
        all_masks = m.masks(radius)
        for flips in itertools.combinations(range(0, 64, 1 if radius < 3 else 5), radius):
            assert any(not mask & sum(1 << i for i in flips) for mask in all_masks)


def test_fingerprints(spark):
    texts = [None, "", " \t\n", "One", "one TWO", "a b c", "É é\x0bx y z w", "w " * 30000, "a b c d e f g"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.fp % 2**64 for r in m.fingerprints(rows).collect()} == {i: brute_fp(t) for i, t in enumerate(texts)}


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(8)]
    fps = {b for b in base} | {0, 1, 3, 7, 15, 31, 2**63, 2**63 | 1}
    for _ in range(700):  # crowds and chains around some points
        fps.add(rng.choice(list(fps)) ^ sum(1 << b for b in {rng.randrange(64) for _ in range(rng.choice((1, 1, 2, 3)))}))
    signed = {f - 2**64 if f >= 2**63 else f: f for f in fps}
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    for small in (2, 8):
        got = {r.node: r.component for r in m.components(m.links(nodes, 2, small)).collect()}
        assert {x: got.get(x, x) for x in signed} == brute_components(signed | {k: v for k, v in signed.items()})


def test_query_and_edge_cases(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in m.table(spark, sf_dir, "documents").collect()]
    want = brute_components({i: brute_fp(t) for i, t in docs})
    got = m.query(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{brute_fp(t):016x}", want[i]) for i, t in docs)


def test_repeats_nulls_extra_columns(spark):
    df = spark.createDataFrame([(3, None, 1), (2, "", 2), (2, "", 2), (None, "a b c d", 3), (9, "a b c d", 4)], "doc_id long, text string, fp int")
    assert sorted(((r.doc_id or -1), r.component_id) for r in m.near_duplicates(df).collect()) == [(-1, 9), (2, 2), (2, 2), (3, 2), (9, 9)]
    assert m.near_duplicates(df.limit(0)).collect() == []
