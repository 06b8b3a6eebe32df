import hashlib
import json

from pyspark.sql import functions as F

from plumbline.functions import guards as g, predicates as P
from plumbline.operators.features import feature_closure, undeclared
from plumbline.sources import manifests as m


def test_kleene_and_proofs():
    f, o = (lambda x: {"feature": x}), (lambda x: {"opaque": x})
    assert g.evaluate({"all": [f("a"), o("x")]}, {("feature", "a"): False}) is False
    assert g.evaluate({"any": [f("a"), o("x")]}, {("feature", "a"): False}) is None
    assert g.satisfiable({"all": [f("a"), {"not": f("a")}]}) is False
    assert g.satisfiable({"all": [o("target_os=a"), o("target_os=b")]}) is False
    assert g.satisfiable({"all": [o("other=a"), o("other=b")]}) is True
    assert g.satisfiable({"all": [f(str(i)) for i in range(11)]}) is None
    assert g.implies({"all": [f("a"), "test"]}, "test") is True and g.implies(f("a"), "test") is False
    assert g.satisfiable({"any": []}) is False and g.satisfiable({"all": []}) is True


def test_guard_columns(spark):
    rows = [json.dumps(x) for x in (True, "test", {"feature": "a"}, {"opaque": "x"}, {"not": "test"})] + [None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, g string")
    got = {r.i: r.v for r in df.select("i", g.guard_value(F.col("g"), test=False, features=["a"]).alias("v")).collect()}
    assert got == {0: True, 1: False, 2: True, 3: None, 4: True, 5: None}
    both = df.filter("g is not null").select("i", g.overlaps(F.col("g"), F.lit('{"not": "test"}')).alias("v")).collect()
    assert {r.i: r.v for r in both} == {0: True, 1: False, 2: True, 3: True, 4: True}


def test_framed_digest_and_classes(spark):
    df = spark.createDataFrame([([("päck", "a"), ("b", "")],)], "f array<struct<label:string,value:string>>")
    want = hashlib.sha256("5:päck".encode() + b"\0" + b"1:a\xff" + b"1:b\0" + b"0:\xff").hexdigest()
    assert df.select(P.framed_digest(F.col("f"))).first()[0] == want
    paths = {"gen/a.rs": "generated", "x/tests/a.rs": "test", "a_test.rs": "test", "src/main.rs": "entrypoint", "lib.rs": "facade", "src/bin/x.rs": "auxiliary", "src/a.rs": "implementation", "tests_x/a.rs": "implementation"}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", P.classify_path(F.col("p"), ["gen"]).alias("c")).collect()
    assert {r.p: r.c for r in got} == paths


def test_feature_closure(spark):
    declared = spark.createDataFrame([("p", x) for x in ("default", "a", "b", "opt")], "package string, feature string")
    acts = spark.createDataFrame([("p", "default", "a"), ("p", "a", "b"), ("p", "b", "a"), ("p", "a", "dep:d"), ("p", "b", "e/x"), ("p", "b", "w?/y"), ("p", "opt", "a")], "package string, feature string, entry string")
    implicit = spark.createDataFrame([("p", "opt")], "package string, alias string")
    want = spark.createDataFrame([("p", "default"), ("q", "default")], "package string, feature string")
    got = {(r.kind, r.name, r.feature) for r in feature_closure(declared, acts, implicit, want).collect()}
    assert got == {("active", "default", None), ("active", "a", None), ("active", "b", None), ("enabled", "d", None), ("enabled", "e", None), ("forwarded", "e", "x"), ("forwarded", "w", "y")}
    assert undeclared(declared, want).collect()[0].package == "q"


def test_manifests_and_locks(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/Cargo.toml").write_text('[package]\nname="a"\n[dependencies]\nx="1"\ny={package="z",optional=true,features=["q","p","q"]}\n[target."cfg(unix)".dev-dependencies]\nt={version="1",default-features=false}\n')
    (tmp_path / "Cargo.lock").write_text('[[package]]\nname="a"\nversion="1"\ndependencies=["x","z 2","gone"]\n[[package]]\nname="x"\nversion="1"\n[[package]]\nname="z"\nversion="1"\n[[package]]\nname="z"\nversion="2"\nsource="reg"\n')
    deps = m.dependencies(m.files(spark, str(tmp_path), "Cargo.toml")).orderBy("ordinal").collect()
    assert [(r.alias, r.name, r.kind, r.target, r.optional, r.default_features, list(r.features)) for r in deps] == [("x", "x", "normal", None, False, True, []), ("y", "z", "normal", None, True, True, ["p", "q"]), ("t", "t", "development", "cfg(unix)", False, False, [])]
    nodes = m.lock_nodes(m.files(spark, str(tmp_path), "Cargo.lock"))
    assert [(r.ref, r.matches, r.dst) for r in m.lock_edges(nodes).orderBy("edge_ord").collect()] == [("x", 1, 1), ("z 2", 1, 3), ("gone", 0, None)]
