"""Boundaries of a repository and of its compilation.

entries(path, kind, inside): kind file, directory or symlink; inside: whether a symlink's target lies in the repository.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.predicates import glob_matches, glob_regex, path_bytes, quoted, under_root
from plumbline.operators import capability as C
from plumbline.operators.findings import finding, matched, patterns, policy, said, small
from plumbline.operators.relate import stale
from plumbline.operators.source_graph import _folder, _join

#: Macros that read a file when they are compiled.
READS = ("include", "include_str", "include_bytes")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def excluded(path: Column, exclude: list[str]) -> Column:
    """Whether a path fits an exclusion or lies under one (I4)."""
    return glob_matches(path, exclude) | _any([path.startswith(p + "/") for p in exclude])


def indexed_source(path: Column, generated: list[str]) -> Column:
    """Whether a file is source: `.rs` in any case, and `.rsi` under the generated roots."""
    return path.rlike(r"(?i)[^/][.]rs\z") | (path.rlike(r"[^/][.]rsi\z") & _any([under_root(path, F.lit(r)) for r in generated]))


def repository_findings(entries: DataFrame, repository: dict, owners: list[dict], caches: dict[str, bool | None] | None = None) -> DataFrame:
    """REP-001 to -006, and OWN-001 and -002 of directory owners.

    repository: roots, exclude, nested_git, submodules (allow or deny), symlinks (inside or deny). caches: exclusions that name a
    Cargo target directory, with whether its tag is valid (None: the directory is absent, which is fine).
    """
    spark, caches = entries.sparkSession, caches or {}
    roots, exclude = repository.get("roots", []), repository.get("exclude", [])
    path = F.col("path")
    told = lambda df, id_, rail, text, at=path, **more: finding(df, id_, f"repository.{rail}", "repository", text, at, emit=("path",), **more)
    wanted = spark.createDataFrame([(i, r) for i, r in enumerate(roots) if r != "."], "ord long, path string")
    out = [told(wanted.join(entries.filter("kind = 'directory'").select("path").distinct(), "path", "left_anti"), "REP-001", "roots", said("declared repository root ", quoted(path), " does not exist"))]
    bad = spark.createDataFrame([(p,) for p, valid in caches.items() if valid is False], "path string")
    out.append(told(bad, "REP-006", "exclude", said("Cargo target exclusion ", quoted(path), " requires a valid CACHEDIR.TAG")))
    rules = spark.createDataFrame([(p, glob_regex(p) or "(?!)") for p in exclude if p not in caches], "pattern string, regex string")
    unused = stale(rules, entries.select(path_bytes(path).alias("_b")), F.expr("_b rlike regex"), ["pattern"])
    out.append(told(unused.withColumn("path", F.col("pattern")), "REP-006", "exclude", said("repository exclusion ", quoted(F.col("pattern")), " matches no path"), None))
    if repository.get("nested_git", "allow") == "deny":
        out.append(told(entries.filter(path.endswith("/.git")), "REP-002", "nested-git", F.lit("nested Git metadata creates a second repository boundary")))
    if repository.get("submodules", "allow") == "deny":
        out.append(told(entries.filter("path = '.gitmodules'"), "REP-003", "submodules", F.lit("Git submodules are denied by the architecture contract")))
    links = entries.filter("kind = 'symlink'")
    outside = ~F.coalesce("inside", F.lit(False)) if repository.get("symlinks") != "deny" else F.lit(True)
    out.append(told(links.filter(outside), "REP-004", "symlinks", F.lit("symlink escapes or is denied by the repository boundary"), analysis="exact"))
    input_ = path.rlike(r"(?i)[^/][.](rs|toml)\z") | path.endswith("Cargo.lock") | _any([under_root(path, F.lit(r)) for r in roots])
    out.append(told(links.filter(~outside & input_), "REP-005", "symlinks", F.lit("symlink aliases architecture input that cannot be indexed exactly"), analysis="unresolved"))
    own = policy(spark, [x for x in owners if x["kind"] == "Directory"], C.OWNERS).withColumn("globs", F.array("selector"))
    told_owner = small(own.select("ord", F.col("name").alias("owner"), "reason"), len(owners))
    allow = small(own.select("ord", F.explode(F.array_distinct("allow")).alias("path")), len(owners))
    directories = entries.filter("kind = 'directory'").select("path").distinct()
    found = matched(directories, patterns(own, "globs")).select("path", "ord").distinct().join(allow, ["ord", "path"], "left_anti").join(told_owner, "ord")
    gone = allow.join(directories, "path", "left_anti").join(told_owner, "ord")
    owned = lambda df, id_, text: finding(df, id_, F.col("owner"), "ownership", text, path, reason=F.col("reason"), emit=("ord", "path"))
    out += [owned(found, "OWN-001", said("directory ", quoted(path), " is outside its declared owner")), owned(gone, "OWN-002", said("owner policy names missing directory ", quoted(path)))]
    return _all(out)


def override_findings(surfaces: DataFrame) -> DataFrame:
    """CARGO-OVERRIDE-001 and CARGO-CONFIG-001 over surfaces(path, kind, surface): resolution, or configuration (R2)."""
    resolution = F.col("kind") == "resolution"
    text = F.when(resolution, said("repository uses a Cargo resolution surface that is not attested: ", F.col("surface"))).otherwise(F.lit("repository-local Cargo configuration can alter qualification execution and is not permitted"))
    found = finding(surfaces, F.when(resolution, "CARGO-OVERRIDE-001").otherwise("CARGO-CONFIG-001"), F.when(resolution, "cargo.resolution-override").otherwise("cargo.execution-configuration"), "", text, F.col("path"), analysis="unresolved", emit=("path",))
    return found.withColumn("category", F.when(F.col("id") == "CARGO-OVERRIDE-001", "dependency").otherwise("qualification"))


def identity_findings(deps: DataFrame, attestations: list[dict], governed_roots: DataFrame) -> DataFrame:
    """CARGO-IDENTITY-001 and -002 (N13, R3): dependencies of governed roots without an exact identity, and attestations that fit none.

    deps(package, directory, ordinal, alias, name, source, authority), authority 'unresolved' or how the crate's root is known;
    attestations: package, source, reason; governed_roots(package, root): the roots that policy names in each package.
    """
    spark = deps.sparkSession
    own = small(policy(spark, attestations, "package string, source string, reason string"), len(attestations))
    open_ = deps.withColumn("root", F.replace("name", F.lit("-"), F.lit("_")))
    known = own.select(F.col("package").alias("name"), "source", F.lit(True).alias("_a")).distinct()
    loose = open_.filter("authority = 'unresolved'").join(known, ["name", "source"], "left").filter("_a is null").join(governed_roots.distinct(), ["package", "root"], "left_semi")
    manifest = F.when(F.col("directory") == ".", "Cargo.toml").otherwise(F.concat("directory", F.lit("/Cargo.toml")))
    unused = own.join(deps.select(F.col("name").alias("package"), "source").distinct(), ["package", "source"], "left_anti")
    told = lambda df, id_, text, at=None, **more: finding(df, id_, "cargo.crate-root", "dependency", text, at, **more)
    return _all([
        told(loose, "CARGO-IDENTITY-001", said("dependency ", quoted(F.col("alias")), " has no exact Rust crate-root identity"), manifest, analysis="unresolved", emit=("package", "ordinal")),
        told(unused, "CARGO-IDENTITY-002", said("crate-root attestation for package ", quoted(F.col("package")), " at ", F.col("source"), " matches no unresolved external dependency"), reason=F.col("reason"), emit=("ord",)),
    ])


def syntax_findings(files: DataFrame, facts: DataFrame, expansions: DataFrame, packages: DataFrame, layers: list[dict], profiles: list[dict]) -> DataFrame:
    """SYNTAX-001 and -002 (R9): denied async syntax, and macros that may hold some.

    facts of kind async: name is async-fn, async-block, async-closure or await; profiles: name, reachability, syntax (denied names).
    expansions as in `capability`; closed names `async` where a review excludes it. A fact that never compiles has guard false.
    """
    spark = files.sparkSession
    own = policy(spark, profiles, "name string, reachability string, syntax array<string>").filter(F.size("syntax") > 0)
    of = C.assigned_profiles(files, packages, layers).join(files.select("path", "bits"), "path").join(small(own.select(F.col("name").alias("profile"), "reachability", "syntax"), len(profiles)), "profile")
    live = lambda df: df.join(of, "path").filter(C.applies(F.col("reachability"), F.col("bits"), F.col("guard")))
    rule, who = said("profile.", F.col("profile"), ".syntax"), said("profile ", quoted(F.col("profile")))
    denied = live(facts.filter("kind = 'async'")).filter(F.array_contains("syntax", F.col("name")))
    opaque = live(expansions).filter(~F.array_contains(F.coalesce("closed", F.array().cast("array<string>")), "async"))
    return _all([
        finding(denied, "SYNTAX-001", rule, "syntax", said(who, " denies ", F.col("name"), " syntax"), F.col("path"), F.col("span"), analysis=F.col("quality"), emit=("path", "profile", "ordinal")),
        finding(opaque, "SYNTAX-002", rule, "syntax", said(who, " cannot prove that opaque macro ", F.col("name"), " introduces no denied async syntax"), F.col("path"), F.col("span"), analysis="unresolved", emit=("path", "profile", "ordinal")),
    ])


def compile_findings(effects: DataFrame, entries: DataFrame) -> DataFrame:
    """RUST-COMPILE-001 (R10): files that macros read when compiled, by other than one literal path to a file of the repository.

    effects(path, ordinal, name, span, target, opaque, quality, builtin): target null where the path isn't one literal.
    """
    last = F.element_at(F.split("name", "::"), -1)
    read = effects.filter(F.col("builtin") & (F.col("quality") == "exact") & last.isin(*READS)).withColumns({"last": last, "resolved": _join(_folder(F.col("path")), F.col("target"))})
    there = entries.filter("kind = 'file'").select(F.col("path").alias("resolved"), F.lit(True).alias("_there")).dropDuplicates(["resolved"])
    row = read.join(there, "resolved", "left")
    escapes = F.col("resolved").isNull() | F.col("target").startswith("/") | F.col("target").contains("\\")
    why = F.when(F.col("opaque") & (F.col("last") == "include"), "source inclusion inside opaque macro input cannot be traversed exactly").when(
        F.col("target").isNull(), F.when(F.col("last") != "include", "file path is not one literal")).when(
        escapes, "file path escapes or is not portable within the repository").when(
        F.col("_there").isNull(), "file path does not identify an inventoried repository file")
    return finding(row.withColumn("why", why).filter("why is not null"), "RUST-COMPILE-001", "rust.compile-filesystem", "source", said(F.col("name"), "! ", F.col("why")), F.col("path"), F.col("span"), analysis="unresolved", emit=("path", "ordinal"))
