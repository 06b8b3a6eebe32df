"""What governs a path, and what policy covers (E1, E2, E4, A9 to A11, A13) over the fact tables of `capability`."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators import capability as C
from plumbline.operators.findings import matched, patterns, policy, small


def governed_surface(files: DataFrame, facts: DataFrame, operations: DataFrame, owners: list[dict], complete: bool = True) -> DataFrame:
    """(owner, path, line, name, evidence, quality, allowed) of each occurrence that an owner governs; an error where the analysis is incomplete."""
    if not complete:
        raise ValueError("coverage needs a complete analysis")
    spark, n = files.sparkSession, len(owners)
    own = policy(spark, owners, C.OWNERS).filter("kind <> 'Directory'").withColumn("reachability", F.coalesce("reachability", F.lit("all")))
    found = C.owner_evidence(files, facts, operations, own, n).filter("evidence <> 'path'")
    named = small(own.select("ord", F.col("name").alias("owner"), "allow"), n)
    return found.join(named, "ord").select("owner", "path", F.col("span.line").alias("line"), "name", "evidence", "quality", F.coalesce(F.array_contains("allow", F.col("path")), F.lit(False)).alias("allowed"))


def unresolved_counts(facts: DataFrame) -> DataFrame:
    """One row: facts whose identity is unresolved, and those that may be of several."""
    return facts.agg(F.count_if(F.col("quality") == "unresolved").alias("unresolved"), F.count_if((F.col("quality") != "exact") & (F.size("canonical") > 1)).alias("ambiguous"))


def fact_counts(parts: list[DataFrame]) -> DataFrame:
    """(path, n): the facts of each file over its tables, counted before they meet (A10)."""
    counted = [p.groupBy("path").agg(F.count("*").alias("n")) for p in parts]
    return reduce(DataFrame.unionByName, counted).groupBy("path").agg(F.sum("n").alias("n"))


def census(packages: DataFrame, targets: DataFrame, files: DataFrame, facts: list[DataFrame], domains: DataFrame) -> DataFrame:
    """One row: the certificate's counts."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [one(packages, "packages"), one(targets, "targets"), one(files.select("path").distinct(), "rust_files"), fact_counts(facts).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("physical_facts")), one(domains.select("path", "domain").distinct(), "base_source_instances")]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # of one row each


def file_set_digest(files: DataFrame, by: str) -> DataFrame:
    """(by, n, sha256) over each set's files in the order of their paths: path and content, each after its length.

    files(by, path, content). Sets are the inputs of a gate or the sources of a macro's package, named by policy.
    """
    n = lambda b: F.lpad(F.hex(F.octet_length(b).cast("long")), 16, "0")
    frame = lambda c: F.concat(n(c.cast("binary")), F.hex(c.cast("binary")))
    ordered = F.array_sort(F.collect_list(F.struct("path", F.concat(frame(F.col("path")), frame(F.col("content"))).alias("f"))))
    return files.groupBy(by).agg(F.count("*").alias("n"), F.sha2(F.unhex(F.array_join(F.transform(ordered, lambda x: x["f"]), "")), 256).alias("sha256"))


def explain(spark: SparkSession, path: str, packages: DataFrame, contract: dict) -> DataFrame:
    """(policy, name, detail) of everything that governs one path, which needn't exist."""
    one = spark.createDataFrame([(path, [], 1)], "path string, packages array<string>, bits int")
    scopes, owners = policy(spark, contract.get("scopes", []), C.SCOPES), policy(spark, contract.get("owners", []), C.OWNERS)
    inside = C.scope_files(one, scopes).join(scopes, "ord").select(F.lit("scope").alias("policy"), "name", F.array_join("deny", ", ").alias("detail"))
    within = matched(one.select("path"), patterns(owners, "within")).select("ord").distinct().join(owners, "ord")
    owned = within.select(F.lit("owner").alias("policy"), "name", F.concat(F.col("kind"), F.lit(" "), F.col("selector"), F.when(F.array_contains("allow", path), F.lit(" (allowed)")).otherwise(F.lit(""))).alias("detail"))
    profiles = C.assigned_profiles(one, packages, contract.get("layers", [])).select(F.lit("profile").alias("policy"), F.col("profile").alias("name"), F.lit("").alias("detail"))
    generated = [("generated", g["root"], "") for g in contract.get("generated", ()) if path == g["root"] or path.startswith(g["root"] + "/") or g["root"] == "."]
    ratchets = [("ratchet", r["rule"], r.get("selector") or "") for r in contract.get("ratchets", ()) if r["target"] == path]
    return inside.unionByName(owned).unionByName(profiles).unionByName(spark.createDataFrame(generated + ratchets, "policy string, name string, detail string")).orderBy("policy", "name")


def enabled_rails(contract: dict) -> list[str]:
    """The names of the rails that a contract enforces, sorted."""
    rust, out = contract.get("source", {}).get("rust", {}), []
    out += [f"layer:{x['name']}" for x in contract.get("layers", ())] + [f"scope:{x['name']}" for x in contract.get("scopes", ())] + [f"owner:{x['name']}" for x in contract.get("owners", ())]
    out += [f"dependency:{x['name']}" for x in contract.get("dependency_rules", ())] + [f"gate:{x['name']}" for x in contract.get("gates", ())] + [f"invariant:{x['id']}" for x in contract.get("invariants", ())]
    out += [f"profile:{n}" for n in contract.get("profiles", {})] + [f"mirror:{x['production']}" for x in rust.get("test_mirrors", ())] + [f"type:{x['name']}" for x in rust.get("types", ())]
    out += [f"source:{k}" for k in ("module_docs", "facades", "entrypoints", "tests") if rust.get(k, "allow") != "allow"] + ["source:size"] * ("size" in rust)
    return sorted(out)
