"""Queries over the driver's tables, with their SQL for an independent engine."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions import predicates as P
from plumbline.operators import graph as G, relate as R, report as O

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@register(
    "layer_edge",
    """
WITH edges AS (
  SELECT c.c_nationkey AS src, s.s_nationkey AS dst, count(*)::BIGINT AS n
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
  GROUP BY 1, 2)
SELECT ns.n_name AS from_package, nd.n_name AS to_package, rs.r_name AS from_layer, rd.r_name AS to_layer, e.n AS n_edges
FROM edges e JOIN nation ns ON e.src = ns.n_nationkey JOIN nation nd ON e.dst = nd.n_nationkey
JOIN region rs ON ns.n_regionkey = rs.r_regionkey JOIN region rd ON nd.n_regionkey = rd.r_regionkey
WHERE rs.r_name <> rd.r_name AND NOT (rs.r_name = 'ASIA' AND rd.r_name = 'EUROPE') AND NOT (rs.r_name = 'EUROPE' AND rd.r_name = 'AMERICA')
""",
)
def layer_edge(spark: SparkSession, d: str) -> DataFrame:
    """Edges between layers (regions) that the allow table does not name; J1 + J2."""
    from plumbline.operators.layers import denied_layer_edges

    edges = (
        table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
        .join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n_edges"))
    )
    nation = table(spark, d, "nation")
    named = nation.join(table(spark, d, "region"), nation.n_regionkey == F.col("r_regionkey"))
    assigned = named.select(F.col("n_name").alias("package"), F.col("r_name").alias("layer"), "n_nationkey")
    src = assigned.select(F.col("n_nationkey").alias("c_nationkey"), F.col("package").alias("src"))
    dst = assigned.select(F.col("n_nationkey").alias("s_nationkey"), F.col("package").alias("dst"))
    layers = spark.createDataFrame([("ASIA", ["EUROPE"]), ("EUROPE", ["AMERICA"]), ("AMERICA", []), ("AFRICA", []), ("MIDDLE EAST", [])], "layer string, may_depend_on array<string>")
    return denied_layer_edges(edges.join(src, "c_nationkey").join(dst, "s_nationkey").select("src", "dst", "n_edges"), assigned.select("package", "layer"), layers)


# --- The other operators, each on the driver's tables (our adaptation; see the module's docstring). ---


def literal(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


BRANDS = [("brand-1", "Brand#1*"), ("brand-2x", "Brand#2?"), ("brand-12", "Brand#12"), ("brand-none", "Brand#99*")]


@register("unique_layer", """
WITH s(layer, pattern) AS (VALUES ('brand-1', '^Brand#1[^/]*$'), ('brand-2x', '^Brand#2[^/]$'), ('brand-12', '^Brand#12$'), ('brand-none', '^Brand#99[^/]*$')),
b AS (SELECT DISTINCT p_brand FROM part), m AS (SELECT b.p_brand, s.layer FROM b LEFT JOIN s ON regexp_matches(b.p_brand, s.pattern))
SELECT p_brand AS package, count(layer)::BIGINT AS matches, CASE count(layer) WHEN 0 THEN 'missing' WHEN 1 THEN 'exact' ELSE 'ambiguous' END AS resolution FROM m GROUP BY 1
""")
def unique_layer(spark: SparkSession, d: str) -> DataFrame:
    """Packages (brands) by the number of layer patterns they match: J1's exactly-one rule."""
    packages = table(spark, d, "part").select(F.col("p_brand").alias("package")).distinct()
    hits = sum((F.coalesce(P.glob_matches(F.col("package"), [g]), F.lit(False)).cast("long") for _, g in BRANDS), F.lit(0).cast("long"))
    out = packages.withColumn("matches", hits)
    return out.withColumn("resolution", R.resolution(F.col("matches")))


@register("stale_selectors", """
WITH s(layer, pattern) AS (VALUES ('brand-1', '^Brand#1[^/]*$'), ('brand-2x', '^Brand#2[^/]$'), ('brand-12', '^Brand#12$'), ('brand-none', '^Brand#99[^/]*$'))
SELECT layer FROM s WHERE NOT EXISTS (SELECT 1 FROM part WHERE regexp_matches(p_brand, pattern))
""")
def stale_selectors(spark: SparkSession, d: str) -> DataFrame:
    """Layer selectors without any package: an anti-join on the compiled pattern, over distinct brands."""
    policy = literal(spark, [(n, P.glob_regex(g)) for n, g in BRANDS], "layer string, pattern string")
    data = table(spark, d, "part").select(P.path_bytes(F.col("p_brand")).alias("brand")).distinct()
    return R.stale(policy, data, F.expr("brand rlike pattern"), ["layer"]).select("layer")


@register("glob_scope", """
SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages
WHERE regexp_matches(regexp_replace(url, '^[a-z]+://', ''), '^[^/]*\\.example\\.org/(?:[^/]+/)*[^/]*$')
AND NOT regexp_matches(regexp_replace(url, '^[a-z]+://', ''), '^m\\.[^/]*(?:/.*)?$')
""")
def glob_scope(spark: SparkSession, d: str) -> DataFrame:
    """Paths in a scope: one include glob, one exclude glob."""
    path = F.regexp_replace("url", "^[a-z]+://", "")
    pages = table(spark, d, "pages").select("page_id", path.alias("path"))
    return pages.filter(P.glob_matches(F.col("path"), ["*.example.org/**/*"]) & ~P.glob_matches(F.col("path"), ["m.*/**"]))


@register("stale_policy", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def stale_policy(spark: SparkSession, d: str) -> DataFrame:
    """Declared keys that no data uses (N family)."""
    return R.stale(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@register("workspace_members", """
SELECT coalesce(a.k, b.k) AS member, CASE WHEN b.k IS NULL THEN 'missing' ELSE 'undeclared' END AS finding
FROM (SELECT DISTINCT p_partkey AS k FROM part WHERE p_size <= 40) a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL
""")
def workspace_members(spark: SparkSession, d: str) -> DataFrame:
    """Both differences of declared and present members."""
    declared = table(spark, d, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("member"))
    present = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("member"))
    return R.membership(declared, present, ["member"])


_SNAPSHOTS = """
a AS (SELECT o_custkey AS k, count(*)::BIGINT AS n FROM orders WHERE year(o_orderdate) % 2 = 0 GROUP BY 1),
b AS (SELECT o_custkey AS k, count(*)::BIGINT AS n FROM orders WHERE year(o_orderdate) % 2 = 1 GROUP BY 1),
r AS (SELECT coalesce(a.k, b.k) AS subject, a.n AS before, b.n AS after, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.n IS NOT DISTINCT FROM b.n THEN 'same' ELSE 'changed' END AS class FROM a FULL JOIN b ON a.k = b.k)
"""


def _reconciled(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), (F.year("o_orderdate") % 2).alias("odd"))
    counted = orders.groupBy("subject", "odd").agg(F.count("*").alias("n"))
    return R.reconcile(counted.filter("odd = 0"), counted.filter("odd = 1"), ["subject"], "n")


@register("reconcile", f"WITH {_SNAPSHOTS} SELECT * FROM r")
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots by key into added, removed, changed, same."""
    return _reconciled(spark, d)


_DIRECTED = _SNAPSHOTS + ", k AS (SELECT *, CASE WHEN class = 'added' OR after > before THEN 'debt' ELSE 'cleanup' END AS kind FROM r WHERE class <> 'same')"


@register("directional", f"WITH {_DIRECTED} SELECT * FROM k")
def directional(spark: SparkSession, d: str) -> DataFrame:
    """Changes with their direction."""
    return R.directional(_reconciled(spark, d), "debt", "cleanup")


@register("diff_summary", f"WITH {_DIRECTED} SELECT count(*) FILTER (WHERE kind = 'debt')::BIGINT AS debt, count(*) FILTER (WHERE kind = 'cleanup')::BIGINT AS cleanup FROM k")
def diff_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts by kind of change (A4)."""
    return O.change_summary(directional(spark, d), ["debt", "cleanup"])


@register("ratchet_lines", """
WITH m AS (SELECT l_suppkey AS supplier, count(*)::BIGINT AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
t AS (SELECT s_suppkey AS supplier, 100::BIGINT AS target FROM supplier WHERE s_acctbal > 0), k AS (SELECT l_suppkey AS supplier, count(*)::BIGINT AS locked FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
j AS (SELECT coalesce(m.supplier, t.supplier) AS supplier, coalesce(value, 0) AS value, target FROM m FULL JOIN t ON m.supplier = t.supplier)
SELECT j.supplier, value, target, locked, CASE WHEN target IS NULL THEN CASE WHEN value > 0 THEN 'unratcheted' ELSE 'none' END WHEN value = 0 THEN 'stale' WHEN locked IS NULL THEN 'missing' WHEN value > locked THEN 'grew' WHEN value < locked THEN 'shrank' ELSE 'held' END AS finding
FROM j LEFT JOIN k ON j.supplier = k.supplier
""")
def ratchet_lines(spark: SparkSession, d: str) -> DataFrame:
    """Counts of returned lines against those of accepted ones, all suppliers of the table."""
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), "l_returnflag")
    measured, locked = (lines.filter(F.col("l_returnflag") == flag).groupBy("supplier").agg(F.count("*").alias(name)) for flag, name in (("R", "value"), ("A", "locked")))
    targets = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("supplier"), F.lit(100).cast("long").alias("target"))
    return R.ratchet(measured, targets, locked, ["supplier"])


@register("budgets", """
WITH b(lang, target, hard) AS (VALUES ('en', 2000, 8000), ('fr', 1500, 5000), ('de', 1000, 3000))
SELECT doc_id, d.lang, n_chars, CASE WHEN target IS NULL THEN 'ungoverned' WHEN n_chars > hard THEN 'over hard' WHEN n_chars > target THEN 'over target' ELSE 'within' END AS finding FROM documents d LEFT JOIN b ON d.lang = b.lang
""")
def budgets(spark: SparkSession, d: str) -> DataFrame:
    """Sizes against a target and a hard budget by role; no budget isn't zero."""
    b = literal(spark, [("en", 2000, 8000), ("fr", 1500, 5000), ("de", 1000, 3000)], "lang string, target long, hard long")
    n = F.col("n_chars")
    finding = F.when(F.col("target").isNull(), "ungoverned").when(n > F.col("hard"), "over hard").when(n > F.col("target"), "over target").otherwise("within")
    return table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(b, "lang", "left").select("doc_id", "lang", "n_chars", finding.alias("finding"))


def _findings(spark: SparkSession, d: str) -> DataFrame:
    """Events as findings: event_id is the order of emission."""
    e = table(spark, d, "events")
    severity = F.when(F.col("event_type") == "purchase", "error").when(F.col("event_type") == "click", "warning").otherwise("note")
    return e.select("event_id", F.concat(F.lit("EVT-"), F.col("event_type")).alias("id"), F.col("event_type").alias("rule"), severity.alias("severity"))


_FINDINGS = "f AS (SELECT event_id, 'EVT-' || event_type AS id, event_type AS rule, CASE event_type WHEN 'purchase' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'note' END AS severity FROM events)"


@register("exact_totals", f"WITH {_FINDINGS} SELECT id, rule, severity, count(*)::BIGINT AS n, CASE WHEN grouping(id) = 1 THEN 'severity' ELSE 'rule' END AS level FROM f GROUP BY GROUPING SETS ((severity), (id, rule, severity))")
def exact_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals by severity and by rule in one pass (A1)."""
    return O.totals(_findings(spark, d))


@register("retention", f"WITH {_FINDINGS} SELECT * FROM f ORDER BY event_id LIMIT 100")
def retention(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred findings by emission (O3); the limit is the feature."""
    return O.retained(_findings(spark, d), 100, ["event_id"])


@register("report_summary", f"WITH {_FINDINGS} SELECT count(*) FILTER (WHERE severity = 'error')::BIGINT AS errors, count(*) FILTER (WHERE severity = 'warning')::BIGINT AS warnings, count(*) FILTER (WHERE severity = 'note')::BIGINT AS notes, least(count(*), 100)::BIGINT AS retained, (count(*) - least(count(*), 100))::BIGINT AS omitted, CASE WHEN count(*) FILTER (WHERE severity = 'error') = 0 THEN 'pass' ELSE 'fail' END AS status FROM f")
def report_summary(spark: SparkSession, d: str) -> DataFrame:
    """Exact counts with bounded retention (A2)."""
    f = _findings(spark, d)
    return O.summary(f, O.retained(f, 100, ["event_id"]))


@register("kleene", """
WITH g AS (SELECT d.doc_id, (l.quality = 1) AND NOT (l.toxic = 1) AS guard FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, CASE WHEN guard IS NULL THEN 'possible' WHEN guard THEN 'exact' ELSE 'absent' END AS availability FROM g
""")
def kleene(spark: SparkSession, d: str) -> DataFrame:
    """A guard in three-valued logic, unknown where there is no label."""
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", P.availability((F.col("quality") == 1) & ~(F.col("toxic") == 1)).alias("availability"))


@register("reach_bits", """
SELECT user_id, bit_or(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 4 ELSE 8 END)::INT AS reach FROM events GROUP BY 1
""")
def reach_bits(spark: SparkSession, d: str) -> DataFrame:
    """Reachability as the union of bits over arrivals."""
    t = F.col("event_type")
    bit = F.when(t == "click", 1).when(t == "view", 2).when(t == "purchase", 4).otherwise(8)
    return table(spark, d, "events").groupBy("user_id").agg(F.bit_or(bit).alias("reach"))


@register("agreement", """
SELECT md5(text) AS fact, CASE WHEN bool_or(lang IS NULL) THEN 'unresolved' WHEN count(DISTINCT lang) = 1 THEN 'exact' ELSE 'conservative' END AS quality,
CASE WHEN count(DISTINCT lang) = 1 AND NOT bool_or(lang IS NULL) THEN min(lang) END AS identity FROM documents GROUP BY 1
""")
def agreement(spark: SparkSession, d: str) -> DataFrame:
    """Whether every instance of a fact (equal texts) has one identity."""
    return R.agreement(table(spark, d, "documents").select(F.md5("text").alias("fact"), "lang"), ["fact"], "lang")


@register("exactly_one", """
SELECT o.o_orderkey, coalesce(n, 0)::BIGINT AS matches, CASE coalesce(n, 0) WHEN 0 THEN 'missing' WHEN 1 THEN 'exact' ELSE 'ambiguous' END AS resolution
FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1) l ON o.o_orderkey = l.l_orderkey
""")
def exactly_one(spark: SparkSession, d: str) -> DataFrame:
    """References that must resolve to one row."""
    lines = table(spark, d, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    out = R.multiplicity(table(spark, d, "orders").select("o_orderkey"), lines, ["o_orderkey"])
    return out.withColumn("resolution", R.resolution(F.col("matches")))


@register("prefix_owner", """
WITH s(owner, selector, brand) AS (VALUES ('a', 'STANDARD', 'Brand#11'), ('b', 'PROMO BRUSHED', 'Brand#22'))
SELECT p_partkey, owner FROM part JOIN s ON (p_type = selector OR starts_with(p_type, selector || ' ')) WHERE p_brand <> brand
""")
def prefix_owner(spark: SparkSession, d: str) -> DataFrame:
    """Uses of an owned identity prefix outside the allowed place (S2, J4); owners are a fixed, tiny table."""
    owners = literal(spark, [("a", "STANDARD", "Brand#11"), ("b", "PROMO BRUSHED", "Brand#22")], "owner string, selector string, brand string")
    facts = table(spark, d, "part").select("p_partkey", "p_brand", F.regexp_replace("p_type", " ", "::").alias("name"))
    selector = F.regexp_replace("selector", " ", "::")
    on = P.path_matches(selector, F.array("name"), F.lit("exact")) & (F.col("p_brand") != F.col("brand"))
    return facts.join(F.broadcast(owners), on).select("p_partkey", "owner")


@register("first_conversation_turn", "SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY 1")
def first_conversation_turn(spark: SparkSession, d: str) -> DataFrame:
    """First match in stored order."""
    return O.first_match(table(spark, d, "conversations"), ["conv_id"], "text", ["turn"])


@register("fingerprint", """
SELECT doc_id, sha256('DOC-001' || chr(0) || source || chr(0) || lang || chr(0) || n_chars::VARCHAR || chr(0)) AS fingerprint FROM documents
""")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Digest of zero-terminated fields."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", P.fingerprint(F.lit("DOC-001"), F.col("source"), F.col("lang"), F.col("n_chars").cast("string")).alias("fingerprint"))


_SPEAK = "SELECT DISTINCT a.conv_id || ':' || a.role AS src, b.conv_id || ':' || b.role AS dst FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"
_FIRST = "SELECT DISTINCT conv_id || ':' || role AS node FROM conversations WHERE turn = 0"


def _speak(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A graph of each conversation's speakers, an edge where one answers another, and who speaks first; all conversations."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(":", F.col("conv_id").cast("string"), "role").alias("node"))
    answers = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("node").alias("dst"))
    edges = turns.withColumnRenamed("node", "src").join(answers, ["conv_id", "turn"]).select("src", "dst").distinct()
    return edges, turns.filter("turn = 0").select("node").distinct()


@register("speaker_path", f"WITH RECURSIVE e AS ({_SPEAK}), b(node, depth) AS (SELECT node, 0 FROM ({_FIRST}) UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON b.node = e.src WHERE b.depth < 25) SELECT node, min(depth)::INT AS depth FROM b GROUP BY 1")
def speaker_path(spark: SparkSession, d: str) -> DataFrame:
    """Depths of shortest paths from who speaks first in each conversation (G1)."""
    edges, first = _speak(spark, d)
    return G.shortest_paths(edges.withColumn("ord", F.col("dst")), first).select("node", "depth")


@register("speaker_cycles", f"WITH RECURSIVE e AS ({_SPEAK}), c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT a.src AS node, min(least(a.src, a.dst)) AS component FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src GROUP BY 1")
def speaker_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Speakers who answer each other, with their component's least."""
    return G.cycles(_speak(spark, d)[0])


@register("speaker_reach", f"WITH RECURSIVE e AS ({_SPEAK}), f(node) AS (SELECT node FROM ({_FIRST}) UNION SELECT e.dst FROM f JOIN e ON f.node = e.src) SELECT node FROM f")
def speaker_reach(spark: SparkSession, d: str) -> DataFrame:
    """The least set that holds who speaks first and is closed under answers."""
    edges, first = _speak(spark, d)
    return G.fixpoint(first, lambda new: new.join(edges, new.node == edges.src).select(F.col("dst").alias("node")))


@register("suggest", """
WITH w(wanted) AS (VALUES ('smal rings'), ('red widgets'), ('blue bolt')), p AS (SELECT DISTINCT p_name AS candidate FROM part),
s AS (SELECT wanted, candidate, levenshtein(candidate, wanted) AS score FROM p, w), k AS (SELECT * FROM s WHERE score <= least(greatest(length(wanted) // 3, 2), 12))
SELECT wanted, candidate, score::INT AS score FROM (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY score, candidate) AS r FROM k) WHERE r <= 3
""")
def suggest(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest names of each wanted one (E5); three is the feature."""
    wanted = literal(spark, [("smal rings",), ("red widgets",), ("blue bolt",)], "wanted string")
    return O.suggestions(table(spark, d, "part").select(F.col("p_name").alias("candidate")).distinct(), wanted)
