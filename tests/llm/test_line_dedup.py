import hashlib

import numpy as np
from hypothesis import given, settings, strategies as st

from plumbline.llm import line_dedup as m


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=3000))
def test_perfect_hash_is_minimal(keys):
    keys = np.array(sorted(keys), np.uint64)
    assert sorted(m.PerfectHash(keys).index(keys)) == list(range(len(keys)))


LONG = "x" * 40
CASES = [(1, None), (2, ""), (3, f"a\n {LONG}\t\nb"), (4, LONG.upper()), (5, LONG), (5, LONG), (6, LONG + "\n" + LONG), (7, LONG), (8, "y" * 39), (9, "é" * 39 + "\n" + "é" * 40), (None, LONG), (10, LONG + "\n\n" + "z" * 50000)]


NONE = -(2**70)  # below all ids


def brute(rows, chars=40, docs=5):
    ws = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(ws).translate(low)
            if len(k) >= chars:
                holders.setdefault(k, set()).add(NONE if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(x.strip(ws).translate(low), ())) >= docs and max(h) != (NONE if i is None else i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "q", 7) for i, t in rows], "doc_id long, text string, n_lines string, other int")
    out = m.dedup_lines(df, **kw)
    assert set(out.columns) == {"doc_id", "text", "other", "n_lines", "n_dropped"}
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str)


def test_matches_brute_force(spark):
    assert run(spark, CASES) == brute(CASES)


def test_shards_elsewhere_agree(spark, monkeypatch):
    """Keys beyond the bound, in several shards and blocks; nulls and the least id are told apart."""
    monkeypatch.setattr(m, "KEYS_PER_SHARD", 3)
    monkeypatch.setattr(m, "ROWS_PER_BLOCK", 4)
    lines = [f"line {k} " + "w" * 40 for k in range(30)]
    rows = [*CASES, *[(20 + i, "\n".join(lines[: 3 + i])) for i in range(30)], (-(2**63), "\n".join(lines)), (None, "\n".join(lines)), (None, "\n".join(lines))]
    want = brute(rows)
    for bound in (0, 5 * m.BYTES_PER_KEY, 12 * m.BYTES_PER_KEY, m.MAX_INDEX_BYTES):
        assert run(spark, rows, max_index_bytes=bound) == want


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, LONG, "a", 1, 2, "b", "c") for i in range(6)], "doc_id long, text string, _drop string, id int, n_dropped int, gone_keys string, marked_id string")
    for bound in (0, m.MAX_INDEX_BYTES):
        got = m.dedup_lines(df, max_index_bytes=bound).collect()
        assert sorted((r.doc_id, r.text, r._drop, r.id, r.gone_keys, r.marked_id, r.n_dropped) for r in got) == [(i, LONG if i == 5 else "", "a", 1, "b", "c", int(i < 5)) for i in range(6)]


def test_a_text_of_many_megabytes(spark):
    rows = [(i, (LONG + "\n" + "y" * 200 + "\n") * (40_000 if i == 1 else 1)) for i in range(5)]
    got = {i: (n, d, len(t)) for i, n, d, t in run(spark, rows)}
    assert got[1] == (80_001, 80_000, 0) and got[4] == (3, 0, 242)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_no_repeats(spark):
    assert run(spark, [(1, LONG), (2, "b")]) == [(1, 1, 0, LONG), (2, 1, 0, "b")]


def test_query(spark, sf_dir):
    rows = m.query(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in m.table(spark, sf_dir, "documents").collect()}
    want = {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(list(docs.items()))}
    assert {tuple(r) for r in rows} == want
