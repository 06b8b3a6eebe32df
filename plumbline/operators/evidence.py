"""Invariants, gates, mirrors and their receipts.

entries(path, kind): what the repository holds, kind 'file' or other; files(path, class, bits, packages); tests(path, name, guard).
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions.predicates import counted_digest, policy_id, quoted, reaches
from plumbline.operators import graph
from plumbline.operators.findings import finding, policy, said, small

GATES = "name string, kind string, path string, inputs array<string>, requires array<string>, reason string"
INVARIANTS = "id string, title string, document string, evidence array<string>"
EXECUTION = "struct<command:string,package:string,default_features:boolean,features:array<string>,target:string,toolchain:string>"
RECEIPT = f"schema bigint, producer string, input_sha256 string, execution {EXECUTION}, tests array<struct<id:string,status:string>>"
MIRRORS = f"production string, test string, name string, receipt string, inputs array<string>, execution {EXECUTION}, reason string"
SCHEMA = 2


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def slug(heading: Column) -> Column:
    """A heading's anchor: its letters, digits and underscores in lower case, with one hyphen for spaces and hyphens between them."""
    kept = F.regexp_replace(heading, r"[^\p{L}\p{N}_\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.lower(kept), r"[\s-]+", "-"), "^-|-$", "")


def anchors(source: Column) -> Column:
    """The anchors of a Markdown text: of its headings, their `{#...}` and `<a id>` lines; none inside fenced code."""
    line = lambda x: F.trim(x)
    marker = lambda x: F.when(line(x).startswith("```"), "`").when(line(x).startswith("~~~"), "~").otherwise("")

    def step(state: Column, x: Column) -> Column:
        opened, inside = marker(x), state["fence"] != ""
        ends = inside & (opened == state["fence"])
        heading = F.trim(F.regexp_replace(F.trim(F.regexp_replace(x, r"^\s*#+", "")), "#+$", ""))
        is_heading = F.regexp_like(x, F.lit(r"^\s*#+ "))
        named = F.regexp_extract(heading, r" \{#([^ ]*)\}$", 1)
        tag = F.regexp_extract(line(x), "^<a id=(?:\"([^\"]*)\"|'[^']*')></a>$", 1)
        tag2 = F.regexp_extract(line(x), "^<a id='([^']*)'></a>$", 1)
        own = F.filter(F.array(F.when(is_heading, slug(heading)), F.when(is_heading, named), tag, tag2), lambda a: F.coalesce(a != "", F.lit(False)))
        fence = F.when(ends, "").when(inside, state["fence"]).otherwise(opened)
        return F.struct(fence.alias("fence"), F.when(inside | (opened != ""), state["found"]).otherwise(F.concat(state["found"], own)).alias("found"))

    start = F.struct(F.lit("").alias("fence"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(F.split(source, "\r?\n"), start, step, lambda s: F.array_distinct(s["found"]))


def invariant_findings(entries: DataFrame, files: DataFrame, tests: DataFrame, documents: DataFrame, invariants: list[dict]) -> DataFrame:
    """EVID-001 to -004 (J17): missing documents and anchors; evidence `rust-test:path::name` must name one test in test source. documents(path, text)."""
    spark = entries.sparkSession
    own = small(policy(spark, invariants, INVARIANTS), len(invariants))
    doc = own.filter("document like '%#%'").select("ord", "id", F.substring_index("document", "#", 1).alias("path"), F.regexp_extract("document", "#(.*)$", 1).alias("anchor"))
    here = doc.join(entries.dropDuplicates(["path"]), "path", "left")
    read = here.filter("kind = 'file'").join(documents.select("path", anchors(F.col("text")).alias("anchors")), "path")
    refs = own.select("ord", "id", F.posexplode("evidence").alias("at", "ref")).filter("ref like 'rust-test:%::%'")
    refs = refs.select("ord", "id", "at", F.regexp_extract("ref", "^rust-test:(.*?)::", 1).alias("path"), F.regexp_extract("ref", "^rust-test:.*?::(.*)$", 1).alias("test"))
    return _all([
        _told(here.filter("kind is null"), "EVID-001", said("invariant document ", quoted(F.col("path")), " is missing")),
        _told(here.filter("kind <> 'file'"), "EVID-001", said("invariant document ", quoted(F.col("path")), " is not a regular file")),
        _told(read.filter(~F.array_contains("anchors", F.col("anchor"))), "EVID-002", said("invariant document ", quoted(F.col("path")), " has no anchor #", F.col("anchor"))),
        reference_findings(refs, files, tests),
    ])


def _told(df: DataFrame, id_: str, text: Column, *order: str) -> DataFrame:
    return finding(df, id_, "invariant.evidence", "", text, F.col("path"), emit=("ord", *order)).withColumn("category", F.col("rule"))


def reference_findings(refs: DataFrame, files: DataFrame, tests: DataFrame) -> DataFrame:
    """EVID-003 and -004 over refs(ord, id, at, path, test): each must name one test of test source."""
    counts = tests.groupBy("path", F.col("name").alias("test")).agg(F.count("*").alias("n"))
    seen = refs.join(files.dropDuplicates(["path"]).select("path", "class"), "path", "left").join(counts, ["path", "test"], "left")
    it = said("Rust test evidence ", F.col("path"), "::", F.col("test"))
    return _all([
        _told(seen.filter("class is null"), "EVID-003", said(it, " is missing"), "at"),
        _told(seen.filter("class <> 'test'"), "EVID-003", said(it, " is not in test source"), "at"),
        _told(seen.filter("class = 'test' and n is null"), "EVID-003", said(it, " is not declared"), "at"),
        _told(seen.filter("class = 'test' and n > 1"), "EVID-004", said(it, " is ambiguous"), "at"),
    ])


def gate_findings(entries: DataFrame, gates: list[dict]) -> DataFrame:
    """QUAL-001 to -004: files of gates and their inputs that are missing or no regular files."""
    own = small(policy(entries.sparkSession, gates, GATES), len(gates))
    each = own.select("ord", F.lit(-1).alias("at"), "path").unionByName(own.select("ord", F.posexplode("inputs").alias("at", "path")))
    there = each.join(entries.dropDuplicates(["path"]), "path", "left").filter("kind is null or kind <> 'file'")
    is_input, gone = F.col("at") >= 0, F.col("kind").isNull()
    id_ = F.when(is_input & gone, "QUAL-003").when(is_input, "QUAL-004").when(gone, "QUAL-001").otherwise("QUAL-002")
    label = F.when(is_input, F.lit("qualification gate input ")).otherwise(F.lit("qualification gate file "))
    return finding(there, id_, "qualification.gate", "qualification", said(label, quoted(F.col("path")), F.when(gone, F.lit(" is missing")).otherwise(F.lit(" is not a regular repository file"))), F.col("path"), emit=("ord", "at"))


def gate_graph(spark: SparkSession, gates: list[dict]) -> DataFrame:
    """(name, problem) of gates that reach themselves ('cycle') and of those not local that reach no local gate ('not connected')."""
    own = policy(spark, gates, GATES)
    edges = own.select(F.col("name").alias("src"), F.explode("requires").alias("dst")).join(own.select(F.col("name").alias("dst")), "dst").select("src", "dst")
    rings = graph.cycles(edges).select(F.col("node").alias("name"), F.lit("cycle").alias("problem"))
    back = graph.fixpoint(own.filter("lower(kind) = 'local'").select("name"), lambda new: new.join(edges, new.name == edges.dst).select(F.col("src").alias("name")))
    return rings.unionByName(own.select("name").join(back, "name", "left_anti").select("name", F.lit("not connected").alias("problem")))


def required_gates(spark: SparkSession, gates: list[dict], roots: list[str]) -> DataFrame:
    """(name) of every gate that the roots require, over others too."""
    edges = policy(spark, gates, GATES).select(F.col("name").alias("src"), F.explode("requires").alias("dst"))
    first = edges.filter(F.col("src").isin(roots)).select(F.col("dst").alias("name"))
    return graph.fixpoint(first, lambda new: new.join(edges, new.name == edges.src).select(F.col("dst").alias("name")))


def parse_receipts(texts: DataFrame) -> DataFrame:
    """texts(path, text) with receipt and error: a strict reading, in which unknown or missing fields are errors."""
    receipt = F.from_json("text", RECEIPT)
    keys = F.array_sort(F.json_object_keys("text"))
    inner = F.array_sort(F.json_object_keys(F.get_json_object("text", "$.execution")))
    want = F.array(*[F.lit(x) for x in ("execution", "input_sha256", "producer", "schema", "tests")])
    inside = F.array(*[F.lit(x) for x in ("command", "default_features", "features", "package", "target", "toolchain")])
    ids = F.transform("receipt.tests", lambda t: t["id"])
    line = lambda c: (c == "") | (F.trim(c) != c) | F.regexp_like(c, F.lit("[\\x00\\r\\n]"))
    features = F.col("receipt.execution.features")
    error = F.when(F.col("receipt").isNull() | keys.isNull() | ~keys.eqNullSafe(want) | ~inner.eqNullSafe(inside), F.lit("invalid execution receipt JSON")).when(
        F.col("receipt.schema").isNull() | (F.col("receipt.schema") != SCHEMA), said("unsupported execution receipt schema ", F.coalesce(F.col("receipt.schema").cast("string"), F.lit("none")), f"; expected {SCHEMA}")).when(
        ~F.coalesce(F.regexp_like("receipt.producer", F.lit(r"^\s*\S.* \d+\.\d+\.\d+$")), F.lit(False)), F.lit("execution receipt producer must be `name major.minor.patch` with a version")).when(
        ~F.coalesce(F.regexp_like("receipt.input_sha256", F.lit("^[0-9a-f]{64}$")), F.lit(False)), F.lit("execution receipt input_sha256 must be 64 lowercase hexadecimal characters")).when(
        reduce(lambda a, b: a | b, [F.coalesce(line(F.col(f"receipt.execution.{x}")), F.lit(True)) for x in ("command", "target", "toolchain")]), F.lit("execution receipt command, target and toolchain must be non-empty normalized lines")).when(
        ~F.coalesce(F.regexp_like("receipt.execution.package", F.lit("^[A-Za-z0-9_-]+$")), F.lit(False)), F.lit("execution receipt package identity is invalid")).when(
        ~F.coalesce(features == F.array_sort(F.array_distinct(features)), F.lit(False)), F.lit("execution receipt features must be valid, unique, and sorted")).when(
        F.coalesce(F.size("receipt.tests"), F.lit(0)) == 0, F.lit("execution receipt must report at least one test")).when(
        F.size(F.array_distinct(ids)) < F.size(ids), F.lit("execution receipt contains duplicate test ids"))
    return texts.withColumn("receipt", receipt).withColumn("error", error)


def input_digest(domain: str, mirror: Column, production: Column, test: Column, inputs: Column) -> Column:
    """What a receipt attests: a mirror's sources as binary, its reviewed inputs as an array of (path, content) structs, and its execution."""
    b = lambda c: c.cast("binary")
    count = lambda a: F.unhex(F.lpad(F.hex(F.size(a).cast("long")), 16, "0"))
    e = mirror["execution"]
    ordered = F.array_sort(inputs)
    flat = F.flatten(F.transform(ordered, lambda i: F.array(b(i["path"]), i["content"])))
    flag = F.unhex(F.when(e["default_features"], "01").otherwise("00"))
    fields = F.concat(
        F.array(b(mirror["production"]), production, b(mirror["test"]), test, b(mirror["name"]), count(inputs)), flat,
        F.array(b(e["command"]), b(e["package"]), flag, count(e["features"])), F.transform(e["features"], b), F.array(b(e["target"]), b(e["toolchain"])),
    )
    return counted_digest(domain, fields)


def mirror_policy_id(domain: str, production: Column, test: Column, name: Column) -> Column:
    return policy_id("test-mirror", domain, [production, test, name])


def execution_group(execution: Column) -> Column:
    """The digest of an execution's identity: mirrors of one group run together."""
    return F.sha2(F.to_json(execution), 256)


def matching_world(mirrors: DataFrame, worlds: DataFrame) -> DataFrame:
    """mirrors(production, execution) with matches and world: the feature worlds whose defaults and selected features for the package are the execution's.

    worlds(world, package, default_features, selected). world is null unless exactly one matches.
    """
    e = mirrors.select("production", F.col("execution.package").alias("package"), F.col("execution.default_features").alias("default_features"), F.array_sort("execution.features").alias("selected"))
    met = e.join(worlds.withColumn("selected", F.array_sort("selected")), ["package", "default_features", "selected"], "left")
    return met.groupBy("production").agg(F.count("world").alias("matches"), F.min("world").alias("w")).select("production", "matches", F.when(F.col("matches") == 1, F.col("w")).alias("world"))


def mirror_findings(files: DataFrame, entries: DataFrame, packages: DataFrame, tests: DataFrame, receipts: DataFrame, digests: DataFrame, mirrors: list[dict]) -> DataFrame:
    """MIRROR-001 to -004, -007 to -010, RECEIPT-001 to -005 and -007.

    packages(name, directory); receipts: `parse_receipts`; digests(production, sha256): what the receipt must attest.
    """
    spark = files.sparkSession
    own = small(policy(spark, mirrors, MIRRORS), len(mirrors))
    f = files.dropDuplicates(["path"])
    side = lambda name: f.select(F.col("path").alias(name), F.col("class").alias(f"{name}_class"), F.col("bits").alias(f"{name}_bits"), F.col("packages").alias(f"{name}_packages"))
    row = own.join(side("production"), "production", "left").join(side("test"), "test", "left")
    named = packages.groupBy(F.col("name").alias("package")).agg(F.count("*").alias("n"), F.min("directory").alias("directory"))
    row = row.withColumn("package", F.col("execution.package")).join(named, "package", "left")
    declared = tests.groupBy(F.col("path").alias("test"), "name").agg(F.count("*").alias("declared"))
    row = row.join(declared, ["test", "name"], "left")
    manifest = F.when(F.col("directory") == ".", "Cargo.toml").otherwise(F.concat("directory", F.lit("/Cargo.toml")))
    told = lambda df, id_, path, text, place: finding(df, id_, "rust.test-mirror", "", F.lit(text) if isinstance(text, str) else text, path, emit=("ord", F.lit(place))).withColumn("category", F.lit("mirror"))
    one = row.filter("n = 1")
    has = lambda s: F.col(f"{s}_packages").isNotNull() & ~F.array_contains(F.coalesce(f"{s}_packages", F.array().cast("array<string>")), F.col("package"))
    parts = [
        told(row.filter("production_bits is null"), "MIRROR-001", F.col("production"), "production source is missing or not analyzed", 0),
        told(row.filter(~reaches(F.col("production_bits"), "production")), "MIRROR-002", F.col("production"), "production source is not reachable from a Cargo production target", 0),
        told(row.filter("test_bits is null"), "MIRROR-003", F.col("test"), "test source is missing or not analyzed", 1),
        told(row.filter((F.col("test_class") != "test") | ~reaches(F.col("test_bits"), "test")), "MIRROR-004", F.col("test"), "test source is not a Cargo-test-reachable test file", 1),
        told(row.filter("coalesce(n, 0) <> 1"), "MIRROR-007", F.col("production"), "execution package does not select exactly one workspace package", 3),
        told(one.filter(has("production") | has("test")), "MIRROR-008", F.col("production"), "execution package does not own both exact mirror sources", 3),
        told(one.filter(~F.array_contains(F.coalesce("inputs", F.array().cast("array<string>")), manifest)), "MIRROR-009", manifest, "selected package manifest is absent from reviewed mirror inputs", 4),
        told(row.filter("test_bits is not null and coalesce(declared, 0) <> 1"), "MIRROR-010", F.col("test"), said("mirror test ", quoted(F.col("name")), " must be declared once; found ", F.coalesce("declared", F.lit(0))), 2),
    ]
    r = row.join(entries.filter("kind = 'file'").select(F.col("path").alias("receipt"), F.lit(True).alias("there")).dropDuplicates(["receipt"]), "receipt", "left")
    r = r.join(receipts.select(F.col("path").alias("receipt"), F.col("receipt").alias("got"), "error"), "receipt", "left").join(digests, "production", "left")
    status = F.element_at(F.filter("got.tests", lambda t: t["id"] == F.col("name")), 1)["status"]
    reported = F.exists("got.tests", lambda t: t["id"] == F.col("name"))
    good = r.filter("there and error is null and got is not null")
    said_ = lambda df, id_, text, place: finding(df, id_, "rust.test-mirror-receipt", "", F.lit(text) if isinstance(text, str) else text, F.col("receipt"), emit=("ord", F.lit(place))).withColumn("category", F.lit("mirror"))
    parts += [
        said_(r.filter("there is null"), "RECEIPT-001", "execution receipt is missing or not a regular file", 5), said_(r.filter("there and error is not null"), "RECEIPT-002", F.col("error"), 5),
        said_(good.filter(F.to_json("got.execution") != F.to_json("execution")), "RECEIPT-007", "execution receipt command, package, features, target, or toolchain differs from policy", 6),
        said_(good.filter("sha256 is not null and got.input_sha256 <> sha256"), "RECEIPT-003", "execution receipt input digest does not match the exact reviewed execution context", 7),
        said_(good.filter(~reported), "RECEIPT-004", "execution receipt does not report the exact named test", 8),
        said_(good.filter(reported & (status != "passed")), "RECEIPT-005", "execution receipt does not record the exact named test as passed", 8),
    ]
    return _all(parts)
