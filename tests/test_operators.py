import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline.functions import predicates as P
from plumbline.operators import graph as G, relate as R, report as O
from plumbline.operators.layers import denied_layer_edges
from plumbline.plans import driver_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("pattern,path,want", [
    ("lib/**/deep/*.py", "lib/one/two/deep/x.py", True), ("lib/*/deep/*.py", "lib/one/two/deep/x.py", False), ("lib/un-*", "lib/un-it/x", False),
    ("/".join(["**"] * (P.MAX_SEGMENTS + 44)), "q/r/s", True), ("/".join(["a"] * (P.MAX_SEGMENTS + 1)), "/".join(["a"] * (P.MAX_SEGMENTS + 1)), False), ("x" * (P.MAX_PATTERN_BYTES + 1), "x" * (P.MAX_PATTERN_BYTES + 1), False),
    ("a/**", "a", True), ("a/**", "a/b/c", True), ("a/**/c", "a/c", True), ("a/**/c", "a//c", True), ("a/**/c", "a/x//y/c", True), ("/a/?/", "a/b", True), ("a.b", "axb", False), ("**/x", "x", True),
    ("?", "é", False), ("??", "é", True), ("a?", "a", False), ("a", "a\n", False), ("*", "", False), ("**", "", True), ("", "", True), ("", "a", False), ("a*", "aé\nb", True),
])
def test_globs(spark, pattern, path, want):
    df = spark.createDataFrame([(path,), (None,)], "p string")
    assert [r[0] for r in df.select(P.glob_matches(F.col("p"), [pattern])).collect()] == [want, None]


def test_stale_by_condition_never_sends_the_data(spark):
    policy = spark.createDataFrame([("a*", "^a"), ("z*", "^z")], "name string, regex string")
    data = spark.createDataFrame([("abc",), ("bcd",)], "word string")
    out = R.stale(policy, data, F.expr("word rlike regex"), ["name"])
    assert [r.name for r in out.collect()] == ["z*"]
    assert R.stale(policy, data.limit(0), F.expr("word rlike regex"), ["name"]).count() == 2


def test_scalar_predicates(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(P.quoted(F.lit('a"b\\c\nd'))) == '"a\\"b\\\\c\\nd"'
    assert [value(P.reach_name(F.lit(b))) for b in (0, 1, 2, 3, 5, 30)] == ["unreachable", "production", "test-only", "both", "production,benchmark", "test,benchmark,example,build"]
    assert [value(P.is_non_test_target(F.lit(b))) for b in (0, 2, 3, 16)] == [False, False, True, True]
    assert [value(P.relative_path(F.lit(p))) for p in ("./a//b/.", "", "/a", "a/../b", "a\\b")] == ["a/b", "", None, None, None]
    assert value(P.ratchet_selector(F.lit("r#a::r#b::cr#d"))) == "a::b::cr#d"
    assert [value(P.effective_role(F.lit(a), F.lit(b).cast("string"))) for a, b in (("facade", "implementation"), ("entrypoint", "facade"), ("entrypoint", "implementation"), ("test", "facade"), ("facade", None))] == ["implementation", "entrypoint", "implementation", "test", "facade"]
    assert [value(P.budget_role(F.lit(a), F.lit(b))) for a, b in (("facade", 2), ("generated", 2), ("test", 3), ("entrypoint", 1))] == ["test", "generated", "implementation", "auxiliary"]
    want = hashlib.sha256(b"d\0" + b"".join(len(x).to_bytes(8, "big") + x for x in (b"", b"abc", "é".encode()))).hexdigest()
    assert value(P.counted_digest("d", F.array(F.lit(b""), F.lit(b"abc"), F.lit("é").cast("binary")))) == want
    framed = b"d\0" + b"".join(str(len(x)).encode() + b"\0" + x + b"\xff" for x in (b"p", "é".encode()))
    assert value(P.policy_id("kind", "d", [F.lit("p"), F.lit("é")])) == "kind:sha256:" + hashlib.sha256(framed).hexdigest()
    assert [value(P.production_applicable(F.lit(b), F.lit(g).cast("boolean"))) for b, g in ((1, None), (1, False), (2, True), (3, True))] == [True, False, False, True]


def test_prefix_match(spark):
    rows = [("std::fs", ["std::fs::read"], "exact", True), ("std::fs", ["std::fsx"], "exact", False), ("std::fs::read", ["std::fs"], "exact", False), ("std::fs::read", ["std::fs"], "conservative", True), ("crate::r#a", ["::a"], "exact", True)]
    df = spark.createDataFrame(rows, "s string, n array<string>, q string, want boolean")
    assert all(r.got == r.want for r in df.select("want", P.path_matches(F.col("s"), F.col("n"), F.col("q")).alias("got")).collect())


def test_fingerprint_span_bytes(spark):
    got = spark.range(1).select(P.fingerprint(F.lit("a"), F.lit("b"), F.lit(None).cast("string"), F.lit("m"), [F.lit(x).cast("long") for x in (258, 1, 2, 3)])).first()[0]
    want = hashlib.sha256(b"a\0b\0\0m\0" + b"".join(x.to_bytes(8, "little") for x in (258, 1, 2, 3))).hexdigest()
    assert got == want


def test_layer_direction(spark):
    edges = spark.createDataFrame([("core", "manager"), ("manager", "core"), ("core", "loose"), (None, "core")], "src string, dst string")
    assigned = spark.createDataFrame([("core", "core"), ("manager", "manager")], "package string, layer string")
    layers = spark.createDataFrame([("core", []), ("manager", ["core"])], "layer string, may_depend_on array<string>")
    assert [(r.from_package, r.to_package) for r in denied_layer_edges(edges, assigned, layers).collect()] == [("core", "manager")]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", 0), ("b", "a", 0), ("c", "d", 0), ("d", "c", 0), ("e", "e", 0), ("b", "f", 1), ("a", "g", 1), ("g", "f", 0)], "src string, dst string, ord int")
    assert sorted((r.component, r.node) for r in G.cycles(e).collect()) == [("a", "a"), ("a", "b"), ("c", "c"), ("c", "d"), ("e", "e")]
    got = {r.node: (r.depth, r.path) for r in G.shortest_paths(e, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"a": (0, ["a"]), "b": (1, ["a", "b"]), "g": (1, ["a", "g"]), "f": (2, ["a", "b", "f"])}
    assert {r.node for r in G.shortest_paths(e, spark.createDataFrame([("a",)], "node string"), 1).collect()} == {"a", "b", "g"}


def test_witnesses(spark):
    """From the least node over its least neighbour that isn't itself, by a shortest way back inside the component."""
    full = [(a, b) for a in "abcdefgh" for b in "abcdefgh" if a != b]
    cycle = lambda rows: sorted(r.cycle for r in G.witnesses(spark.createDataFrame(rows, "src string, dst string")).collect())
    assert cycle(full) == [["a", "b", "a"]]
    assert cycle([("p", "q"), ("q", "p"), ("r", "s"), ("s", "r"), ("t", "t"), ("u", "p"), ("q", "r")]) == [["p", "q", "p"], ["r", "s", "r"], ["t", "t"]]
    assert cycle([(i, i + 1) for i in range(12)]) == [] and cycle([("a", "c"), ("c", "d"), ("d", "b"), ("b", "a"), ("c", "e"), ("e", "a")]) == [["a", "c", "e", "a"]]
    ring = [(f"n{i:02}", f"n{(i + 1) % 30:02}") for i in range(30)]  # more rounds than tables are kept for
    assert cycle(ring) == [[f"n{i:02}" for i in range(30)] + ["n00"]]


def test_relations_with_nulls_and_empties(spark):
    a = spark.createDataFrame([("x", 1), ("y", None), ("z", 3)], "k string, v long")
    b = spark.createDataFrame([("x", 2), ("y", None), ("w", 1)], "k string, v long")
    assert {(r.k, r["class"]) for r in R.reconcile(a, b, ["k"], "v").collect()} == {("x", "changed"), ("y", "same"), ("z", "removed"), ("w", "added")}
    assert {(r.k, r.kind) for r in R.directional(R.reconcile(a, b, ["k"], "v"), "debt", "cleanup").collect()} == {("x", "debt"), ("z", "cleanup"), ("w", "debt")}
    later = spark.createDataFrame([("y", 5)], "k string, v long")
    assert [(r.k, r.kind) for r in R.directional(R.reconcile(a, later, ["k"], "v"), "debt", "cleanup").filter("k = 'y'").collect()] == [("y", "debt")]
    assert R.reconcile(a.limit(0), b.limit(0), ["k"], "v").collect() == []
    assert {(r.k, r.n) for r in R.multiplicity(a.select("k"), b.union(b), ["k"], "n").collect()} == {("x", 2), ("y", 2), ("z", 0)}


def test_retention_keeps_emission_order(spark):
    f = spark.createDataFrame([(3, "error"), (1, "note"), (2, "error")], "emit_ord int, severity string")
    kept = O.retained(f, 1, ["emit_ord"])
    assert [r.emit_ord for r in kept.collect()] == [1]
    assert O.summary(f, kept).first().asDict() == {"errors": 2, "warnings": 0, "notes": 1, "retained": 1, "omitted": 2, "status": "fail"}
    assert O.retained(f, 0, ["emit_ord"]).count() == 3


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(driver_queries.QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got = driver_queries.QUERIES[name](spark, sf_dir)
    want = duck.execute(driver_queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(repr, want.fetchall()))


def test_entry(spark):
    assert entry.entry(spark).columns == ["from_package", "to_package", "from_layer", "to_layer", "n_edges"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
