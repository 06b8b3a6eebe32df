"""Which source files the targets of a workspace reach, in which compilations, and what lies at their edges.

targets(package, directory, name, kind, path, required_features); worlds(world, package, active), none for legacy analysis;
modules(path, ordinal, name, at, inline, guard, span): declarations of modules in other files, `at` a #[path] or null, inline the
names of the inline modules around; includes(path, ordinal, target, label, guard, span): literal includes, target from the file's
folder; entries(path, kind); guards(guard, domain, value): a guard's value in a domain, in three values, and test_only(guard).

The states of the search are (path, base, domain, bits): base is the folder that a file's modules are looked for in. Each round joins the
new states to declarations by path, and drops those met before.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.predicates import REACH_BITS, glob_matches, quoted, under_root
from plumbline.operators import graph
from plumbline.operators.findings import finding, said

#: How a target of each kind is compiled, and which reachability it gives.
MODES = {
    "lib": (("library", "library-test"), "production"), "bin": (("binary", "binary-test"), "production"), "proc-macro": (("proc-macro", "proc-macro-test"), "build"),
    "test": (("integration-test",), "test"), "bench": (("benchmark",), "benchmark"), "example": (("example", "example-test"), "example"), "build-script": (("build-script",), "build"),
}


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _join(folder: Column, path: Column) -> Column:
    """A path from a folder, with its `.` and `..` parts taken; null if it leaves the root."""
    parts = F.filter(F.split(F.concat_ws("/", F.when(folder != "", folder), path), "/"), lambda x: ~x.isin("", "."))
    none = F.array().cast("array<string>")
    step = lambda s, x: F.when(s.isNull(), s).when(x != "..", F.concat(s, F.array(x))).when(F.size(s) > 0, F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.lit(None).cast("array<string>"))
    return F.array_join(F.aggregate(parts, none, step), "/")


def seeds(targets: DataFrame, worlds: DataFrame | None) -> DataFrame:
    """(path, base, domain, package, bits, origin, label) of each target in each mode and world whose features it needs are active."""
    spark = targets.sparkSession
    modes = F.broadcast(spark.createDataFrame([(k, m, REACH_BITS[r]) for k, (ms, r) in MODES.items() for m in ms], "kind string, mode string, bits int"))
    own = targets.join(modes, "kind")
    if worlds is None:
        own = own.withColumn("world", F.lit(""))
    else:
        own = own.join(worlds, "package").filter(F.size(F.array_except(F.coalesce("required_features", F.array().cast("array<string>")), "active")) == 0)
    path = _join(F.when(F.col("directory") == ".", "").otherwise(F.col("directory")), F.col("path"))
    domain = F.concat_ws("|", "package", "name", "mode", "world")
    manifest = F.when(F.col("directory") == ".", "Cargo.toml").otherwise(F.concat("directory", F.lit("/Cargo.toml")))
    return own.select(path.alias("path"), _folder(path).alias("base"), domain.alias("domain"), "package", "bits", manifest.alias("origin"), said("Cargo target ", quoted(F.col("path"))).alias("label"))


def module_candidates(modules: DataFrame) -> DataFrame:
    """Declarations with a function of the base: `exact` for a #[path], else `tail`, to which `.rs` and `/mod.rs` are added."""
    inside = F.array_join("inline", "/")
    here = F.when(F.size("inline") == 0, _folder(F.col("path")))
    return modules.withColumns({"tail": F.concat_ws("/", F.when(inside != "", inside), F.regexp_replace("name", "^r#", "")), "here": here, "inside": inside})


def _base(path: Column, is_module_file: Column) -> Column:
    """Where a file looks for its modules: its folder for roots and mod.rs, else the folder of its name."""
    return F.when(is_module_file, _folder(path)).otherwise(F.regexp_replace(path, r"[.]rs$", ""))


def _declared(states: DataFrame, modules: DataFrame, includes: DataFrame, entries: DataFrame, guards: DataFrame, test_only: DataFrame) -> DataFrame:
    """(parent, ordinal, span, label, guard, domain, package, bits, child, child_base, found, kind) of what the states declare and may compile."""
    m = module_candidates(modules).select(F.col("path").alias("parent"), "ordinal", "span", "guard", "at", "tail", "here", "inside", said("module ", quoted(F.col("name"))).alias("label"))
    s = states.select(F.col("path").alias("parent"), "base", "domain", "package", "bits")
    rows = s.join(m, "parent")
    root = F.coalesce(F.col("here"), F.concat_ws("/", F.when(F.col("base") != "", F.col("base")), F.when(F.col("inside") != "", F.col("inside"))))
    near = F.concat_ws("/", F.when(F.col("base") != "", F.col("base")), "tail")
    exact = rows.filter("at is not null").select("parent", "ordinal", "span", "label", "guard", "domain", "package", "bits", _join(root, F.col("at")).alias("child"), F.lit("exact").alias("how"))
    search = rows.filter("at is null").select("parent", "ordinal", "span", "label", "guard", "domain", "package", "bits", F.explode(F.array(F.struct(F.concat(near, F.lit(".rs")).alias("child"), F.lit("direct").alias("how")), F.struct(F.concat(near, F.lit("/mod.rs")).alias("child"), F.lit("nested").alias("how")))).alias("c")).select("parent", "ordinal", "span", "label", "guard", "domain", "package", "bits", "c.*")
    i = includes.select(F.col("path").alias("parent"), "ordinal", "span", "guard", _join(_folder(F.col("path")), F.col("target")).alias("child"), F.col("label"))
    included = s.join(i, "parent").select("parent", "ordinal", "span", "label", "guard", "domain", "package", "bits", "child", F.lit("include").alias("how"))
    there = entries.dropDuplicates(["path"]).select(F.col("path").alias("child"), "kind")
    every = exact.unionByName(search).unionByName(included).join(there, "child", "left").join(guards, ["guard", "domain"], "left").join(test_only.withColumn("_test", F.lit(True)), "guard", "left")
    live = every.filter(F.coalesce("value", F.lit(True)))  # a guard that is false in the domain: not compiled
    child_base = F.when(F.col("how") == "direct", _base(F.col("child"), F.lit(False))).otherwise(_folder(F.col("child")))
    return live.select("parent", "ordinal", "span", "label", "guard", "domain", "package", F.when(F.col("_test"), F.lit(REACH_BITS["test"])).otherwise(F.col("bits")).alias("bits"), "child", child_base.alias("child_base"), "how", "kind")


def reach(targets: DataFrame, worlds: DataFrame | None, modules: DataFrame, includes: DataFrame, entries: DataFrame, guards: DataFrame, test_only: DataFrame, roots: list[str], exclude: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(path, bits, packages, domains) of each file reached, the states, and every declaration that was followed."""
    inside = lambda p: reduce(lambda a, b: a | b, [under_root(p, F.lit(r)) for r in roots], F.lit(False)) & ~glob_matches(p, exclude)
    begin = seeds(targets, worlds)
    ok = begin.join(entries.filter("kind = 'file'").select("path").distinct(), "path", "left_semi").filter(inside(F.col("path")))
    declared = lambda states: _declared(states, modules, includes, entries, guards, test_only)

    def step(new: DataFrame) -> DataFrame:
        d = declared(new)
        one = d.filter("kind is not null").groupBy("parent", "ordinal", "label", "domain", "package", "bits").agg(F.count("*").alias("n"), F.min(F.struct("child", "child_base", "kind")).alias("c")).filter("n = 1 and c.kind = 'file'")
        return one.select(F.col("c.child").alias("path"), F.col("c.child_base").alias("base"), "domain", "package", "bits").filter(inside(F.col("path")))

    states = graph.fixpoint(ok.select("path", "base", "domain", "package", "bits"), step)
    files = states.groupBy("path").agg(F.bit_or("bits").alias("bits"), F.array_sort(F.collect_set("package")).alias("packages"), F.array_sort(F.collect_set("domain")).alias("domains"))
    return files, states, declared(states)


def graph_findings(targets: DataFrame, worlds: DataFrame | None, modules: DataFrame, includes: DataFrame, entries: DataFrame, guards: DataFrame, test_only: DataFrame, sources: DataFrame, roots: list[str], exclude: list[str], auxiliary: list[str] = ()) -> DataFrame:
    """RUST-GRAPH-001, -002 and -004 (R29, N11): missing and ambiguous sources, boundaries, and files that no target reaches. sources(path): the indexed files."""
    files, _, declared = reach(targets, worlds, modules, includes, entries, guards, test_only, roots, exclude)
    inside = lambda p: reduce(lambda a, b: a | b, [under_root(p, F.lit(r)) for r in roots], F.lit(False)) & ~glob_matches(p, exclude)
    rule = {"001": "rust.source-graph.presence", "002": "rust.source-graph.boundary", "004": "rust.source-graph.reachability"}
    told = lambda df, n, text, path="parent", span="span": finding(df, f"RUST-GRAPH-{n}", rule[n], "source-graph", text, F.col(path), F.col(span) if span else None, emit=(path,))
    label = F.col("label")
    each = declared.groupBy("parent", "ordinal", "label", "domain").agg(F.first("span").alias("span"), F.first("how").alias("how"), F.count_if(F.col("kind").isNotNull()).alias("n"), F.min("child").alias("child"), F.min(F.when(F.col("kind").isNotNull(), F.struct("child", "kind"))).alias("c"))
    searched = each.filter("how in ('direct', 'nested')")
    named = each.filter("how in ('exact', 'include')")
    single = each.filter("n = 1").select("parent", "span", "label", F.col("c.child").alias("child"), F.col("c.kind").alias("kind"))
    begin = seeds(targets, worlds).join(entries.dropDuplicates(["path"]), "path", "left").withColumn("span", F.lit(None))
    orphans = sources.select("path").distinct().join(files, "path", "left_anti").filter(~F.col("path").isin(list(auxiliary)))
    parts = [
        told(begin.filter("kind is null").withColumnRenamed("origin", "parent"), "001", said(label, " source does not exist: ", F.col("path"))),
        told(searched.filter("n = 0"), "001", said(label, " has no source file at either Rust module path")), told(searched.filter("n > 1"), "001", said(label, " is ambiguous because both Rust module paths exist")),
        told(named.filter((F.col("n") == 0) & inside(F.col("child"))), "001", said(label, " source does not exist: ", F.col("child"))),
        told(named.filter(~inside(F.col("child"))), "002", said(label, " resolves outside the indexed Rust roots: ", F.col("child"))),
        told(single.filter((F.col("kind") != "file") & inside(F.col("child"))), "002", said(label, " resolves to a symlink or non-file boundary: ", F.col("child"))),
        finding(orphans, "RUST-GRAPH-004", rule["004"], "source-graph", F.lit("Rust source is unreachable from every Cargo target"), F.col("path"), emit=("path",)),
    ]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["id", "path", "message"])
