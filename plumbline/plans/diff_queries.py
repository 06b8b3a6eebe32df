"""Queries of two-snapshot comparison over entries of orders before and after a day, with SQL for an independent engine."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators import diff as D, lock_drift as L
from plumbline.plans import facts
from plumbline.plans.driver_queries import register

_CHANGES = f"""e AS {facts.table("entries")}, b AS (SELECT * FROM e WHERE side = 'before'), a AS (SELECT * FROM e WHERE side = 'after'),
j AS (SELECT coalesce(b.key, a.key) AS key, coalesce(b.subject, a.subject) AS subject, b.key IS NOT NULL AS had, a.key IS NOT NULL AS has, b.value AS before, a.value AS after, b.rank AS r0, a.rank AS r1, coalesce(b.parent, a.parent) AS parent
  FROM b FULL JOIN a ON a.key = b.key AND a.subject = b.subject),
k AS (SELECT * FROM j WHERE parent IS NULL OR parent IN (SELECT key || ':' || subject FROM b INTERSECT SELECT key || ':' || subject FROM a)),
c AS (
  SELECT CASE WHEN has THEN 'grant' ELSE 'revoke' END AS kind, 'repository.package' AS rail, subject, CASE WHEN has THEN 'resolved workspace gained a package' ELSE 'resolved workspace lost a package' END AS message, NULL AS before, NULL AS after FROM k WHERE key = 'lock.package' AND had <> has
  UNION ALL SELECT CASE WHEN has THEN 'grant' ELSE 'revoke' END, 'dependency.resolved-edge', subject, CASE WHEN has THEN 'resolved dependency graph gained an edge' ELSE 'resolved dependency graph lost an edge' END, NULL, NULL FROM k WHERE key = 'lock.edge' AND had <> has
  UNION ALL SELECT CASE WHEN NOT had OR (has AND r1 > r0) THEN 'debt' ELSE 'cleanup' END, 'ratchet', subject, CASE WHEN NOT had THEN 'reviewed architecture debt was recorded' WHEN NOT has THEN 'reviewed architecture debt was removed' WHEN r1 > r0 THEN 'ratchet ceiling increased' ELSE 'ratchet tightened with the repository' END,
    coalesce(before, '<none>'), coalesce(after, '<none>') FROM k WHERE key = 'lock.ratchet' AND before IS DISTINCT FROM after
  UNION ALL SELECT CASE WHEN NOT had THEN 'revoke' WHEN NOT has THEN 'grant' ELSE 'unknown' END, 'qualification.gate-lock', subject, CASE WHEN NOT had THEN 'qualification gate became content-addressed' WHEN NOT has THEN 'qualification gate is no longer content-addressed' ELSE 'reviewed qualification gate contents changed' END,
    CASE WHEN had AND has THEN before END, CASE WHEN had AND has THEN after END FROM k WHERE key = 'lock.gate' AND before IS DISTINCT FROM after
  UNION ALL SELECT CASE WHEN NOT had THEN 'revoke' WHEN NOT has THEN 'grant' ELSE 'unknown' END, 'qualification.gate-input-lock', subject, CASE WHEN NOT had THEN 'qualification input became content-addressed' WHEN NOT has THEN 'qualification input is no longer content-addressed' ELSE 'reviewed qualification input contents changed' END,
    CASE WHEN had AND has THEN before END, CASE WHEN had AND has THEN after END FROM k WHERE key = 'lock.gate.input' AND before IS DISTINCT FROM after
  UNION ALL SELECT CASE WHEN r1 < r0 THEN 'grant' ELSE 'revoke' END, 'dependency.external', subject, 'enforcement mode changed', NULL, NULL FROM k WHERE key = 'layer.external' AND had AND has AND r0 <> r1)"""


def _changes(spark: SparkSession, d: str) -> DataFrame:
    own = facts.rows(spark, d, "entries")
    return D.changes(own.filter("side = 'before'").drop("side"), own.filter("side = 'after'").drop("side"))


@register("architecture_changes", f"WITH {_CHANGES} SELECT * FROM c")
def architecture_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes of packages, edges, ratchets, gates with inputs, and modes, with their directions and in their order."""
    return D.sort_changes(_changes(spark, d)).drop("kind_ord")


_DRIFT = """SELECT CASE WHEN NOT had THEN '{a}' WHEN NOT has THEN '{r}' ELSE '{c}' END AS id, '{rule}' AS rule, CASE WHEN NOT had THEN {ta} WHEN NOT has THEN {tr} ELSE {tc} END AS message FROM k WHERE key = '{key}' AND (had <> has OR ({c_on} AND before IS DISTINCT FROM after))"""
_Q = "'\"' || subject || '\"'"


@register("lock_drift", f"WITH {_CHANGES} " + " UNION ALL ".join(_DRIFT.format(key=k, rule=r, a=a, r=m, c=c, ta=ta, tr=tr, tc=tc, c_on=str(c != "-").lower()) for k, r, a, m, c, ta, tr, tc in (
    ("lock.package", "lock.package", "LOCK-003", "LOCK-004", "-", f"'workspace package ' || {_Q} || ' is not reviewed in the lock'", f"'the lock retains stale workspace package ' || {_Q}", "''"),
    ("lock.edge", "lock.dependency-edge", "LOCK-005", "LOCK-006", "-", "'resolved dependency edge ' || subject || ' is not reviewed in the lock'", "'the lock retains stale dependency edge ' || subject", "''"),
    ("lock.ratchet", "lock.ratchet", "LOCK-009", "LOCK-007", "LOCK-010", f"'repository ratchet ' || {_Q} || ' is not reviewed in the lock'", f"'the lock retains stale ratchet ' || {_Q}", f"'ratchet ' || {_Q} || ' records ' || before || ' but repository resolves to ' || after"),
    ("lock.gate", "lock.qualification-gate", "LOCK-014", "LOCK-015", "LOCK-016", f"'qualification gate ' || {_Q} || ' has no reviewed digest in the lock'", f"'the lock retains stale qualification gate ' || {_Q}", f"'reviewed qualification gate ' || {_Q} || ' changed'"),
    ("lock.gate.input", "lock.qualification-gate", "LOCK-024", "LOCK-025", "LOCK-026", f"'qualification gate input ' || {_Q} || ' has no reviewed digest in the lock'", f"'qualification gate input ' || {_Q} || ' is retained stale in the lock'", f"'qualification gate input ' || {_Q} || ' changed after review'"),
)))
def lock_drift(spark: SparkSession, d: str) -> DataFrame:
    """Sections of a lock against what the repository comes to."""
    own = facts.rows(spark, d, "entries")
    return L.drift(own.filter("side = 'before'").drop("side"), own.filter("side = 'after'").drop("side")).select("id", "rule", "message")


@register("change_kinds", f"WITH {_CHANGES} SELECT " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}')::BIGINT AS {n}" for k, n in (("grant", "grants"), ("revoke", "revokes"), ("debt", "debt"), ("cleanup", "cleanup"), ("neutral", "neutral"), ("unknown", "unknown"))) + " FROM c")
def change_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the six kinds (A4)."""
    return D.summary(_changes(spark, d))
