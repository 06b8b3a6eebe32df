from pyspark.sql import functions as F

from plumbline.operators import repository as R

SPAN = "span struct<line:bigint,column:bigint,end_line:bigint,end_column:bigint>"


def ids(df):
    return sorted((r.id, r.path or "") for r in df.collect())


def test_boundaries(spark):
    rows = [("src", "directory", None), ("src/a.rs", "file", None), ("x/.git", "directory", None), (".git", "directory", None), (".gitmodules", "file", None), ("link", "symlink", False), ("src/alias.rs", "symlink", True), ("asset", "symlink", True), ("a/store", "directory", None), ("b/store", "directory", None), ("gen/x", "file", None)]
    entries = spark.createDataFrame(rows, "path string, kind string, inside boolean")
    owners = [{"name": "o", "kind": "Directory", "selector": "**/store", "allow": ["a/store", "c/store"]}, {"name": "call", "kind": "Call", "selector": "x", "allow": []}]
    policy = {"roots": ["src", "lib"], "exclude": ["gen/**", "old/**", "target", "out"], "nested_git": "deny", "submodules": "deny", "symlinks": "inside"}
    got = ids(R.repository_findings(entries, policy, owners, {"target": None, "out": False}))
    assert got == sorted([("REP-001", "lib"), ("REP-002", "x/.git"), ("REP-003", ".gitmodules"), ("REP-004", "link"), ("REP-005", "src/alias.rs"), ("REP-006", ""), ("REP-006", "out"), ("OWN-001", "b/store"), ("OWN-002", "c/store")])
    strict = ids(R.repository_findings(entries, {"roots": ["."], "symlinks": "deny"}, []))
    assert strict == [("REP-004", "asset"), ("REP-004", "link"), ("REP-004", "src/alias.rs")]


def test_sources_and_exclusions(spark):
    df = spark.createDataFrame([(x,) for x in ("a.rs", "A.RS", "gen/a.rsi", "a.rsi", ".rs", "x/.rs", "a.rs.bak", "old/deep/a.rs", "older/a.rs")], "p string")
    assert [r.p for r in df.filter(R.indexed_source(F.col("p"), ["gen"])).collect()] == ["a.rs", "A.RS", "gen/a.rsi", "old/deep/a.rs", "older/a.rs"]
    assert [r.p for r in df.filter(R.excluded(F.col("p"), ["old", "*.bak"])).collect()] == ["a.rs.bak", "old/deep/a.rs"]


def test_identities_and_overrides(spark):
    deps = spark.createDataFrame([("p", ".", 0, "x", "x-y", "s", "unresolved"), ("p", ".", 1, "z", "z", "s", "unresolved"), ("p", ".", 2, "w", "w", "s", "unresolved"), ("p", ".", 3, "v", "v", "s", "local")], "package string, directory string, ordinal long, alias string, name string, source string, authority string")
    governed = spark.createDataFrame([("p", "x_y"), ("p", "z"), ("p", "v")], "package string, root string")
    found = R.identity_findings(deps, [{"package": "z", "source": "s"}, {"package": "q", "source": "s"}], governed)
    assert sorted((r.id, r.message.split('"')[1]) for r in found.collect()) == [("CARGO-IDENTITY-001", "x"), ("CARGO-IDENTITY-002", "q")]
    surfaces = spark.createDataFrame([("Cargo.toml", "resolution", "[patch]"), (".cargo/config.toml", "configuration", "")], "path string, kind string, surface string")
    assert ids(R.override_findings(surfaces)) == [("CARGO-CONFIG-001", ".cargo/config.toml"), ("CARGO-OVERRIDE-001", "Cargo.toml")]


def test_syntax_and_compile_inputs(spark):
    at = (1, 1, 1, 2)
    files = spark.createDataFrame([("c/a.rs", [], 1), ("c/t.rs", [], 2), ("d/a.rs", ["d"], 1)], "path string, packages array<string>, bits int")
    facts = spark.createDataFrame([("c/a.rs", "async", 1, "await", at, "exact", None), ("c/a.rs", "async", 2, "async-fn", at, "exact", None), ("c/a.rs", "async", 3, "await", at, "exact", False), ("c/t.rs", "async", 1, "await", at, "exact", None), ("d/a.rs", "async", 1, "await", at, "exact", None)], f"path string, kind string, ordinal long, name string, {SPAN}, quality string, guard boolean")
    expansions = spark.createDataFrame([("c/a.rs", 9, "gen", at, None, []), ("c/a.rs", 8, "safe", at, None, ["async"])], f"path string, ordinal long, name string, {SPAN}, guard boolean, closed array<string>")
    packages = spark.createDataFrame([("c", "c"), ("d", "d")], "name string, directory string")
    found = R.syntax_findings(files, facts, expansions, packages, [{"name": "l", "packages": ["c"], "profiles": ["sync", "loose"]}], [{"name": "sync", "reachability": "production", "syntax": ["await"]}, {"name": "loose", "reachability": "all", "syntax": []}])
    assert sorted((r.id, r.path, r.message) for r in found.collect()) == [("SYNTAX-001", "c/a.rs", 'profile "sync" denies await syntax'), ("SYNTAX-002", "c/a.rs", 'profile "sync" cannot prove that opaque macro gen introduces no denied async syntax')]
    rows = [("include_str", "data.txt", False), ("std::include_bytes", "../up.bin", False), ("include_str", None, False), ("include", None, False), ("include", "x.rs", True), ("include_str", "../../out", False), ("include_str", "/abs", False), ("include_str", "none.txt", False), ("env", None, False)]
    effects = spark.createDataFrame([("s/a.rs", i, n, at, t, o, "exact", True) for i, (n, t, o) in enumerate(rows)], f"path string, ordinal long, name string, {SPAN}, target string, opaque boolean, quality string, builtin boolean")
    entries = spark.createDataFrame([("s/data.txt", "file"), ("up.bin", "file"), ("s/x.rs", "file")], "path string, kind string")
    got = sorted(r.message for r in R.compile_findings(effects, entries).collect())
    assert got == sorted(["include_str! file path is not one literal", "include! source inclusion inside opaque macro input cannot be traversed exactly", *["include_str! file path escapes or is not portable within the repository"] * 2, "include_str! file path does not identify an inventoried repository file"])
