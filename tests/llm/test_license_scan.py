import random
import re

from plumbline.llm import license_scan as m


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, templates, least=0.8):
    """Each template at each place that a shared shingle gives."""
    out = {}
    for doc_id, text in docs:
        ws = words(text)
        for name, license_, t in templates:
            tw = words(t)
            if not tw:
                continue
            k, n = min(5, len(tw)), len(tw)
            cut = lambda x, k=k: [tuple(x[i : i + k]) for i in range(len(x) - k + 1)]
            at = {}
            for i, s in enumerate(cut(tw)):
                at.setdefault(s, []).append(i)
            slack = -(-n // 5)
            for p, s in enumerate(cut(ws)):
                for i in at.get(s, ()):
                    begin = max(0, p - i - slack)
                    share = len(set(at) & set(cut(ws[begin : max(begin, p - i + n + slack)]))) / len(at)
                    if share >= least:
                        new = (share, -max(0, p - i))
                        key = (doc_id, name, license_)
                        out[key] = max(out.get(key, new), new)
    return out


def fixture(seed=5):
    rng = random.Random(seed)
    filler = ["alpha", "beta", "gamma", "delta", "the", "of", "license", "software"]
    docs = [(0, None), (1, ""), (2, "one two"), (3, "x " * 30000 + m.TEMPLATES[2][2])]
    for i in range(4, 90):
        parts = [" ".join(rng.choice(filler) for _ in range(rng.randrange(0, 60)))]
        for _ in range(rng.randrange(3)):
            t = rng.choice(m.TEMPLATES)[2].split(" ")
            for _ in range(rng.choice((0, 0, 1, 2))):
                t[rng.randrange(len(t))] = rng.choice(filler)
            parts += [" ".join(t), " ".join(rng.choice(filler) for _ in range(rng.randrange(0, 60)))]
        docs.append((i, rng.choice((" ", "\n")).join(parts)))
    return docs


def found(spark, docs, templates=m.TEMPLATES):
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, template string")
    ts = spark.createDataFrame(list(templates), "template string, license string, text string")
    return {(r.doc_id, r.template, r.license): (r.containment, -r.start_word) for r in m.scan_licenses(df, ts).collect()}


def test_against_brute_force(spark):
    docs = fixture()
    want = brute(docs, m.TEMPLATES)
    got = found(spark, docs)
    assert set(got) == set(want) and len(want) > 40
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 for k in want)


def test_blocks_of_templates(spark, monkeypatch):
    docs = fixture(6)[:40]
    whole = found(spark, docs)
    monkeypatch.setattr(m, "BLOCK_KEYS", 300)
    assert found(spark, docs) == whole


def test_edge_cases(spark):
    docs = [(1, "All RIGHTS, reserved!"), (1, "All RIGHTS, reserved!"), (None, "(all rights reserved)"), (2, "all rights"), (3, None)]
    assert found(spark, docs) == {(1, "all-rights-reserved", "proprietary"): (1.0, 0), (None, "all-rights-reserved", "proprietary"): (1.0, 0)}
    assert found(spark, [], m.TEMPLATES) == {}
    assert found(spark, docs, [("none", "x", None), ("empty", "x", " .")]) == {}


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in m.table(spark, sf_dir, "documents").collect()]
    got = {(r.doc_id, r.template, r.license) for r in m.query(spark, sf_dir).collect()}
    assert got == set(brute(docs, m.TEMPLATES))
