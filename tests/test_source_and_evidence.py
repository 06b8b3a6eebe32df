import hashlib
import json

from pyspark.sql import functions as F

from plumbline.operators import evidence as E, source_rules as S

SPAN = "span struct<line:bigint,column:bigint,end_line:bigint,end_column:bigint>"


def ids(df):
    return sorted((r.id, r.path or "") for r in df.collect())


def test_anchors(spark):
    text = "# A Title, with *marks* & more\n```\n# not this\n~~~\n```\n<a id=\"exact-one\"></a>\n  ## Second_part  ##\n~~~ x\n# nor this\n~~~\n### Named {#own}\n#no space\n<a id='two'></a>\r\n# Été -- 2"
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(E.anchors(F.col("t")).alias("a")).collect()
    assert [r.a for r in got] == [["a-title-with-marks-more", "exact-one", "second_part", "named-own", "own", "two", "été-2"], [], None]


def test_invariants_and_gates(spark):
    entries = spark.createDataFrame([("doc.md", "file"), ("dir", "directory"), ("gate.sh", "file")], "path string, kind string")
    documents = spark.createDataFrame([("doc.md", "# Here")], "path string, text string")
    files = spark.createDataFrame([("t.rs", "test"), ("p.rs", "implementation")], "path string, class string")
    tests = spark.createDataFrame([("t.rs", "once"), ("t.rs", "twice"), ("t.rs", "twice"), ("p.rs", "once")], "path string, name string")
    ref = lambda *x: [f"rust-test:{a}" for a in x]
    invariants = [{"id": "A", "document": "doc.md#here", "evidence": ref("t.rs::once", "t.rs::twice", "t.rs::never", "p.rs::once", "q.rs::x")}, {"id": "B", "document": "doc.md#there", "evidence": ["gate:g"]}, {"id": "C", "document": "none.md#x", "evidence": []}, {"id": "D", "document": "dir#x", "evidence": []}]
    assert ids(E.invariant_findings(entries, files, tests, documents, invariants)) == sorted([("EVID-004", "t.rs"), ("EVID-003", "t.rs"), ("EVID-003", "p.rs"), ("EVID-003", "q.rs"), ("EVID-002", "doc.md"), ("EVID-001", "none.md"), ("EVID-001", "dir")])
    gates = [{"name": "a", "kind": "local", "path": "gate.sh", "inputs": ["dir", "none"], "requires": ["b"]}, {"name": "b", "kind": "local", "path": "none", "inputs": [], "requires": ["a"]}, {"name": "c", "kind": "remote", "path": "dir", "inputs": [], "requires": ["d"]}, {"name": "d", "kind": "remote", "path": "gate.sh", "inputs": ["gate.sh"], "requires": []}, {"name": "e", "kind": "remote", "path": "gate.sh", "inputs": [], "requires": ["a"]}]
    assert ids(E.gate_findings(entries, gates)) == [("QUAL-001", "none"), ("QUAL-002", "dir"), ("QUAL-003", "none"), ("QUAL-004", "dir")]
    assert sorted(map(tuple, E.gate_graph(spark, gates).collect())) == [("a", "cycle"), ("b", "cycle"), ("c", "not connected"), ("d", "not connected")]
    assert {r.name for r in E.required_gates(spark, gates, ["e"]).collect()} == {"a", "b"}


EXECUTION = {"command": "cargo test", "package": "p", "default_features": True, "features": ["x"], "target": "t", "toolchain": "1"}


def receipt(**more):
    return {"schema": 2, "producer": "runner 1.2.3", "input_sha256": "0" * 64, "execution": EXECUTION, "tests": [{"id": "it", "status": "passed"}], **more}


def test_receipts_are_read_strictly(spark):
    bad = {"json": "{", "unknown": json.dumps(receipt(extra=1)), "inner": json.dumps(receipt(execution={**EXECUTION, "more": 1})), "schema": json.dumps(receipt(schema=1)), "producer": json.dumps(receipt(producer="runner")), "digest": json.dumps(receipt(input_sha256="x")), "line": json.dumps(receipt(execution={**EXECUTION, "target": " t"})), "features": json.dumps(receipt(execution={**EXECUTION, "features": ["b", "a"]})), "none": json.dumps(receipt(tests=[])), "twice": json.dumps(receipt(tests=[{"id": "a", "status": "passed"}] * 2))}
    df = spark.createDataFrame([("good", json.dumps(receipt())), *bad.items()], "path string, text string")
    got = {r.path: r.error for r in E.parse_receipts(df).collect()}
    assert got.pop("good") is None and all(got.values()), got


def test_mirrors(spark):
    files = spark.createDataFrame([("p.rs", "implementation", 1, ["p"]), ("p_test.rs", "test", 2, ["p"]), ("q.rs", "implementation", 2, ["q"])], "path string, class string, bits int, packages array<string>")
    entries = spark.createDataFrame([("r.json", "file"), ("bad.json", "file")], "path string, kind string")
    packages = spark.createDataFrame([("p", "."), ("q", "q")], "name string, directory string")
    tests = spark.createDataFrame([("p_test.rs", "it")], "path string, name string")
    texts = spark.createDataFrame([("r.json", json.dumps(receipt())), ("bad.json", "{}")], "path string, text string")
    digests = spark.createDataFrame([("p.rs", "0" * 64), ("q.rs", "1" * 64)], "production string, sha256 string")
    base = {"production": "p.rs", "test": "p_test.rs", "name": "it", "receipt": "r.json", "inputs": ["Cargo.toml"], "execution": EXECUTION}
    run = lambda *m: ids(E.mirror_findings(files, entries, packages, tests, E.parse_receipts(texts), digests, list(m)))
    assert run(base) == []
    assert run({**base, "production": "q.rs", "name": "other", "inputs": []}) == [("MIRROR-002", "q.rs"), ("MIRROR-008", "q.rs"), ("MIRROR-009", "Cargo.toml"), ("MIRROR-010", "p_test.rs"), ("RECEIPT-003", "r.json"), ("RECEIPT-004", "r.json")]
    assert run({**base, "production": "x.rs", "test": "q.rs", "receipt": "bad.json", "execution": {**EXECUTION, "package": "z"}}) == [("MIRROR-001", "x.rs"), ("MIRROR-004", "q.rs"), ("MIRROR-007", "x.rs"), ("MIRROR-010", "q.rs"), ("RECEIPT-002", "bad.json")]
    assert run({**base, "test": "none.rs", "receipt": "none.json"}) == [("MIRROR-003", "none.rs"), ("RECEIPT-001", "none.json")]
    assert run({**base, "execution": {**EXECUTION, "toolchain": "2"}}) == [("RECEIPT-007", "r.json")]
    worlds = spark.createDataFrame([("w1", "p", True, ["x"]), ("w2", "p", True, []), ("w3", "q", True, ["x"])], "world string, package string, default_features boolean, selected array<string>")
    m = spark.createDataFrame([("p.rs", EXECUTION), ("q.rs", {**EXECUTION, "features": ["y"]})], f"production string, execution {E.EXECUTION}")
    assert sorted(map(tuple, E.matching_world(m, worlds).collect())) == [("p.rs", 1, "w1"), ("q.rs", 0, None)]


def test_input_digest(spark):
    m = {"production": "p.rs", "test": "t.rs", "name": "it", "execution": EXECUTION}
    df = spark.createDataFrame([(m, b"prod", b"test", [{"path": "b", "content": b"2"}, {"path": "a", "content": b"1"}])], f"m struct<production:string,test:string,name:string,execution:{E.EXECUTION}>, p binary, t binary, i array<struct<path:string,content:binary>>")
    n = lambda x: x.to_bytes(8, "big")
    fields = [b"p.rs", b"prod", b"t.rs", b"test", b"it", n(2), b"a", b"1", b"b", b"2", b"cargo test", b"p", b"\1", n(1), b"x", b"t", b"1"]
    want = hashlib.sha256(b"domain\0" + b"".join(n(len(f)) + f for f in fields)).hexdigest()
    assert df.select(E.input_digest("domain", F.col("m"), F.col("p"), F.col("t"), F.col("i"))).first()[0] == want


def test_facades_and_placement(spark):
    at = (3, 1, 3, 9)
    files = spark.createDataFrame([("src/lib.rs", "facade", 1), ("src/main.rs", "entrypoint", 1), ("src/a.rs", "facade", 1), ("src/a_test.rs", "test", 2), ("src/b_test.rs", "test", 3), ("src/c_test.rs", "test", 2), ("src/d_test.rs", "test", 0), ("src/e_test.rs", "test", 2), ("x_test.rs", "test", 1)], "path string, class string, bits int")
    facts = spark.createDataFrame([(p, "facade", 1, "fn run", at, "exact") for p in ("src/lib.rs", "src/main.rs", "src/a.rs")], f"path string, kind string, ordinal long, name string, {SPAN}, quality string")
    roles = spark.createDataFrame([("src/a.rs", "implementation")], "path string, role string")
    assert ids(S.facade_findings(files, facts, roles, "declarative", "declarative")) == [("RUST-FACADE-001", "src/lib.rs"), ("RUST-FACADE-001", "src/main.rs")]
    assert ids(S.facade_findings(files, facts, roles, "declarative", "allow")) == [("RUST-FACADE-001", "src/lib.rs")]
    edges = spark.createDataFrame([("src/a_test.rs", 0, "src/a.rs", at, 2, True), ("src/c_test.rs", 1, "src/lib.rs", at, 1, False)], f"child string, ord long, parent string, {SPAN}, bits int, test_only boolean")
    modules = spark.createDataFrame([("src/lib.rs", 1, "d_test", at), ("src/a.rs", 0, "d_test", at)], f"path string, ordinal long, name string, {SPAN}")
    assert ids(S.placement_findings(files, edges, modules)) == [("RUST-TEST-002", "src/e_test.rs"), ("RUST-TEST-002", "src/lib.rs"), ("RUST-TEST-003", "src/a.rs"), ("RUST-TEST-004", "src/b_test.rs")]
