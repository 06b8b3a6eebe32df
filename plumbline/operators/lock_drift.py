"""A lock against what the repository comes to (D15, N16, R30): one full outer join over the entries of `diff`, sections in their order."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.predicates import quoted
from plumbline.operators.diff import entries, lock_entries, owned_rows
from plumbline.operators.findings import finding, said

LOCK = "the lock"

#: Of each section: its place, rule, and the ids of a subject that isn't reviewed, is stale, or changed.
SECTIONS = {
    "lock.package": (1, "lock.package", "LOCK-003", "LOCK-004", None), "lock.edge": (2, "lock.dependency-edge", "LOCK-005", "LOCK-006", None), "lock.generated": (3, "lock.generated-provenance", "LOCK-011", "LOCK-012", "LOCK-013"),
    "lock.gate": (4, "lock.qualification-gate", "LOCK-014", "LOCK-015", "LOCK-016"), "lock.gate.input": (5, "lock.qualification-gate", "LOCK-024", "LOCK-025", "LOCK-026"), "lock.receipt": (6, "lock.execution-receipt", "LOCK-040", "LOCK-041", "LOCK-042"),
    "lock.macro-implementation": (7, "lock.macro-implementation", "LOCK-021", "LOCK-022", "LOCK-023"), "lock.macro-source": (8, "lock.macro-source", "LOCK-036", "LOCK-037", "LOCK-038"), "lock.item-macro": (9, "lock.item-macro", "LOCK-033", "LOCK-034", "LOCK-035"),
    "lock.ratchet": (10, "lock.ratchet", "LOCK-009", "LOCK-007", "LOCK-010"),
}

#: The texts of each id; {} is the subject in quotes, {plain} as it is, {old} and {new} the values, {lock} the lock's name.
TEXTS = {
    "LOCK-003": "workspace package {} is not reviewed in {lock}", "LOCK-004": "{lock} retains stale workspace package {}", "LOCK-005": "resolved dependency edge {plain} is not reviewed in {lock}", "LOCK-006": "{lock} retains stale dependency edge {plain}",
    "LOCK-011": "generated root {} has no reviewed provenance manifest in {lock}", "LOCK-012": "{lock} retains stale generated provenance for {}", "LOCK-013": "generated provenance manifest changed for {}",
    "LOCK-014": "qualification gate {} has no reviewed digest in {lock}", "LOCK-015": "{lock} retains stale qualification gate {}", "LOCK-016": "reviewed qualification gate {} changed",
    "LOCK-024": "qualification gate input {} has no reviewed digest in {lock}", "LOCK-025": "qualification gate input {} is retained stale in {lock}", "LOCK-026": "qualification gate input {} changed after review",
    "LOCK-040": "test mirror for {} has no reviewed execution receipt", "LOCK-041": "{lock} retains a stale execution receipt for {}", "LOCK-042": "reviewed execution receipt for {} changed",
    "LOCK-021": "repository macro implementation {} is not reviewed in {lock}", "LOCK-022": "{lock} retains stale repository macro implementation {}", "LOCK-023": "reviewed repository macro implementation {} changed",
    "LOCK-036": "macro allowance {} lacks locked Cargo package authority", "LOCK-037": "{lock} retains stale macro source {}", "LOCK-038": "macro allowance {} resolved package changed from {old} to {new}",
    "LOCK-033": "exact item-macro namespace authority is not reviewed in {lock}: {}", "LOCK-034": "{lock} retains a stale item-macro namespace manifest: {}", "LOCK-035": "exact item-macro definition or invocation authority changed: {}",
    "LOCK-009": "repository ratchet {} is not reviewed in {lock}", "LOCK-007": "{lock} retains stale ratchet {}", "LOCK-010": "ratchet {} records {old} but repository resolves to {new}",
}


def drift(current: DataFrame, candidate: DataFrame) -> DataFrame:
    """Findings of the entries that the lock doesn't have, has in vain, or has with another value; inputs count where both sides have their gate."""
    spark = current.sparkSession
    spec = F.broadcast(spark.createDataFrame([(k, *v) for k, v in SECTIONS.items()], "key string, place int, section string, added string, removed string, changed string"))
    texts = F.broadcast(spark.createDataFrame(list(TEXTS.items()), "id string, text string"))
    row = owned_rows(current, candidate).join(spec, "key")
    id_ = F.when(F.col("had").isNull(), F.col("added")).when(F.col("has").isNull(), F.col("removed")).when(~F.col("before").eqNullSafe(F.col("after")), F.col("changed"))
    found = row.withColumn("id", id_).filter("id is not null").join(texts, "id")
    text = F.replace(F.replace("text", F.lit("{lock}"), F.lit(LOCK)), F.lit("{}"), quoted(F.col("subject")))
    for mark, value in (("{plain}", "subject"), ("{old}", "before"), ("{new}", "after")):
        text = F.replace(text, F.lit(mark), F.coalesce(value, F.lit("")))
    return finding(found, F.col("id"), F.col("section"), "lock", text, emit=("place", "id", "subject"))


def requires_lock(contract: dict) -> bool:
    """Whether a contract states anything that only a lock can hold."""
    rust = contract.get("source", {}).get("rust", {})
    return contract.get("dependencies", {}).get("mode") == "locked" or any((rust.get("generated"), contract.get("gates"), rust.get("test_mirrors"), rust.get("macros", {}).get("allow"), any(x.get("manifest") for x in rust.get("item_macros", ())), contract.get("ratchets")))


def lock_findings(spark: SparkSession, contract: dict, contract_sha256: str, current: dict | None, candidate: dict, schema: int, semantics: int) -> DataFrame:
    """LOCK-001, -002, -008 and -020 on the lock as a whole, and `drift` of its sections; none where no lock is needed."""
    one = spark.range(1)
    told = lambda id_, rule, text: finding(one, id_, rule, "lock", F.lit(text))
    if not requires_lock(contract):
        return told("", "", "").limit(0)
    if current is None:
        return told("LOCK-001", "lock.required", f"declared exact or ratcheted architecture state requires {LOCK}")
    out = []
    if current.get("schema") != schema:
        out.append(told("LOCK-020", "lock.schema", f"{LOCK} uses schema {current.get('schema')}, latest supported schema is {schema}"))
    if current.get("semantics") != semantics:
        out.append(told("LOCK-008", "lock.semantics", f"{LOCK} uses semantics {current.get('semantics')}, current engine uses semantics {semantics}"))
    if current.get("contract_sha256") != contract_sha256:
        out.append(told("LOCK-002", "lock.contract", f"{LOCK} was produced from different contract bytes"))
    out.append(drift(entries(spark, lock_entries(current)), entries(spark, lock_entries(candidate))))
    return reduce(DataFrame.unionByName, out)


def generated_findings(generated: list[dict], manifests: DataFrame, listed: DataFrame, inputs: DataFrame, entries_: DataFrame, contents: DataFrame, selected: DataFrame) -> DataFrame:
    """GEN-001 to -003 and -005 on generated roots.

    generated: root, manifest, auxiliary, inputs, reason; manifests(root, schema, generator), one row for each manifest that could be
    read; listed(root, path, sha256) and inputs(root, path, sha256): what they name, as whole paths; entries(path, kind); contents(path,
    sha256, banner): digests of the files that exist, and whether they begin as generated source; selected(root, pattern, path):
    the files that each input selector fits (path null: none).
    """
    from plumbline.operators.findings import policy, small

    spark = manifests.sparkSession
    own = small(policy(spark, generated, "root string, manifest string, auxiliary array<string>, inputs array<string>, reason string"), len(generated))
    told = lambda df, id_, text, path="path": finding(df, id_, "rust.generated-source", "generated-source", F.lit(text) if isinstance(text, str) else text, F.col(path), reason=F.col("reason"), emit=("ord", path))
    of = lambda df: df.join(own.select("root", "ord", "manifest", "reason"), "root")
    read = of(manifests)
    hex_ = lambda c: F.coalesce(F.col(c).rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))
    files, given = of(listed), of(inputs)
    there = entries_.filter("kind = 'file'").select("path").distinct()
    digests = contents.select("path", F.col("sha256").alias("actual"), "banner")
    once = files.dropDuplicates(["root", "path"])
    twice = files.groupBy("root", "ord", "manifest", "reason", "path").count().filter("count > 1")
    twice_in = given.groupBy("root", "ord", "manifest", "reason", "path").count().filter("count > 1")
    bad = once.filter(~hex_("sha256"))
    seen = once.filter(hex_("sha256")).join(there, "path", "left_semi").join(digests, "path")
    source = there.filter(F.col("path").rlike(r"(?i)[.](rs|rsi)\z"))
    inside = source.join(own.select("root", "ord", "manifest", "reason"), (F.col("root") == ".") | F.col("path").startswith(F.concat("root", F.lit("/"))))
    unlisted = inside.join(once.select("root", "path"), ["root", "path"], "left_anti")
    gone = once.join(there, "path", "left_anti")
    auxiliary = own.select("root", "ord", "manifest", "reason", F.explode("auxiliary").alias("a")).withColumn("path", F.concat_ws("/", "root", "a")).join(once.select("root", "path"), ["root", "path"], "left_anti")
    chosen = of(selected)
    itself = chosen.filter((F.col("root") == ".") | F.col("path").startswith(F.concat("root", F.lit("/"))))
    proper = chosen.filter("path is not null").join(itself.select("root", "path"), ["root", "path"], "left_anti").select("root", "ord", "manifest", "reason", "path").distinct()
    named = given.select("root", "ord", "manifest", "reason", "path").distinct()
    checked = given.filter(hex_("sha256")).join(digests, "path")
    return reduce(DataFrame.unionByName, [
        told(own.join(manifests.select("root").distinct(), "root", "left_anti"), "GEN-001", "generated manifest cannot be read", "manifest"),
        told(read.filter("schema <> 1"), "GEN-001", said("generated manifest schema must be 1, found ", F.col("schema")), "manifest"), told(read.filter("trim(generator) = ''"), "GEN-001", "generated manifest requires a generator identity", "manifest"),
        told(read.join(files.select("root").distinct(), "root", "left_anti"), "GEN-001", "generated manifest must list at least one source file", "manifest"), told(read.join(given.select("root").distinct(), "root", "left_anti"), "GEN-001", "generated manifest must list at least one generator input", "manifest"),
        told(twice, "GEN-001", said("generated manifest contains duplicate path ", quoted(F.col("path"))), "manifest"), told(twice_in, "GEN-001", said("generated manifest contains duplicate input path ", quoted(F.col("path"))), "manifest"),
        told(bad, "GEN-001", said("generated file ", quoted(F.col("path")), " has an invalid SHA-256 digest"), "manifest"), told(auxiliary, "GEN-001", said("generated auxiliary source ", quoted(F.col("path")), " is absent from its manifest"), "manifest"),
        told(seen.filter("not banner"), "GEN-002", "generated source must begin with its banner"), told(seen.filter("actual <> sha256"), "GEN-002", "generated source hash differs from its manifest"),
        told(unlisted, "GEN-003", "generated Rust source is absent from its manifest"), told(gone, "GEN-003", "generated manifest names missing Rust source"),
        told(itself, "GEN-005", "generated output cannot attest itself as a generator input"), told(chosen.filter("path is null"), "GEN-005", said("generator input selector ", quoted(F.col("pattern")), " matches no repository file"), "manifest"),
        told(proper.join(named.select("root", "path"), ["root", "path"], "left_anti"), "GEN-005", "declared generator input is absent from its manifest"), told(named.join(proper.select("root", "path"), ["root", "path"], "left_anti"), "GEN-005", "generated manifest names input outside the declared selectors"),
        told(checked.filter("actual <> sha256"), "GEN-004", "generator input hash differs from its manifest"),
    ])
