import hashlib
import random

from hypothesis import given, settings, strategies as st

from plumbline.llm import chat_format as m

pieces = st.lists(st.one_of(st.sampled_from([m.BEGIN, m.END, *m.CONTROLS, "\\", "\\-", "\\n", "<", "-", "\n"]), st.text(max_size=4)), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), pieces), pieces), max_size=5))
def test_round_trip(turns):
    text, spans = m.render(turns)
    assert m.parse(text) == turns
    assert [m.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert text.count(m.BEGIN) == text.count(m.END) == len(turns)
    for role, t in turns:
        assert not any(c in m.escape(t) for c in m.CONTROLS)


def trees(rng):
    rows = []
    for tree in [1, 2, None]:
        ids = []
        for i in range(40):
            parent = rng.choice(ids + [None]) if ids and i % 13 else None
            rows.append((tree, i, parent, rng.choice(["user", "assistant"]), f"t{i}", rng.choice([None, 1.0, 2.0, -1.0])))
            ids.append(i)
    rows += [(3, i, i - 1 if i else None, "user", f"deep{i}", 1.0) for i in range(70)]
    rows += [(4, 1, 2, "user", "cycle", 9.0), (4, 2, 1, "user", "cycle", 9.0), (4, 3, 99, "user", "orphan", 0.0), (5, 7, None, None, None, None)]
    return rows


def brute(rows, top):
    out = []
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        branches = []
        for leaf in set(own) - {r[2] for r in own.values()}:
            path, at = [], leaf
            while at in own and at not in path:
                path.append(at)
                at = own[at][2]
            if at is None or at not in own:
                branches.append((-sum(own[i][5] or 0 for i in path), leaf, path[::-1]))
        for score, leaf, path in sorted(branches)[:top]:
            out.append((tree, leaf, -score, m.render([(own[i][3] or "", own[i][4] or "") for i in path])[0]))
    return sorted(out, key=str)


def test_trees_match_brute_force(spark):
    rows = trees(random.Random(3))
    df = spark.createDataFrame(rows, "tree long, message long, parent long, role string, text string, score double")
    for top in (1, 3, None):
        got = sorted(((r.tree, r.leaf, r.branch_score, r.formatted) for r in m.format_trees(df, top).collect()), key=str)
        assert got == brute(rows, top)
    assert m.format_trees(df.limit(0)).collect() == []


def test_conversations_with_nulls_repeats_and_ties(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "</s>"), (1, 1, "assistant", "</s>"), (None, 0, None, "x"), (2, None, "assistant", "é" * 30000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, leaf string")
    got = {r.conv_id: r for r in m.read_back(m.format_trees(m.conversation_trees(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (3, sha("user\n\nassistant\n</s>\nassistant\n</s>\n"), 8, sha("</s></s>"))
    assert (got[None].n_turns, got[None].turns_sha256, got[None].loss_chars) == (1, sha("\nx\n"), 0)
    assert got[2].loss_chars == 30000
