"""Queries of the driver's catalogue, each with the SQL that gives the same rows.

Kind R: the rules' own semantics over facts given as VALUES. Kind T: the shape of a rule's operator over the driver's
tables; it shows the operator, not the rule.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import graph, intervals, joins
from . import policy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
KIND: dict[str, str] = {}


def query(kind: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__], KIND[f.__name__] = f, sql, kind
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(rows: list[tuple]) -> str:
    """Rows as SQL, for both engines."""
    cell = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


@query("T", """
SELECT doc_id, lines, CASE WHEN lines > 20 THEN 'error' WHEN lines > 12 THEN 'warning' END AS severity FROM (
  SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS BIGINT) AS lines FROM documents WHERE text IS NOT NULL)
WHERE lines > 12""")
def file_size_tiers(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.line_count(F.col("text")).alias("lines"))
    return docs.where("lines > 12").withColumn("severity", F.when(F.col("lines") > 20, "error").otherwise("warning"))


@query("T", r"""
WITH d AS (SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[\s\x{FEFF}\x{00A0}]+'), lambda w: w <> '')) AS BIGINT) AS words, n_chars // 6 AS ceiling FROM documents WHERE text IS NOT NULL)
SELECT doc_id, words, CAST(ceiling AS BIGINT) AS ceiling, CASE WHEN ceiling <= 0 THEN 'invalid' WHEN words = 0 THEN 'missing' WHEN words > ceiling THEN 'over' WHEN ceiling > ceil(words * 1.05) THEN 'stale' ELSE 'within' END AS status FROM d""")
def doc_budget_status(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.word_count(F.col("text")).alias("words"), F.expr("n_chars div 6").cast("long").alias("ceiling"))
    words, ceiling = F.col("words"), F.col("ceiling")
    return docs.withColumn("status", F.when(ceiling <= 0, "invalid").when(words == 0, "missing").when(words > ceiling, "over").when(ceiling > text.ratchet(words), "stale").otherwise("within"))


EDGES = """SELECT c.c_nationkey AS source, s.s_nationkey AS target, o.o_orderkey AS file FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE c.c_nationkey <> s.s_nationkey"""


#: Rows of the larger side that one task of a join gets.
TASK_ROWS = 1 << 18


def _joined(large: DataFrame, left: str, small: DataFrame, right: str) -> DataFrame:
    """Both sides joined in as many tasks as the larger one's rows take, so that a task's memory doesn't follow the table."""
    tasks = max(1, math.ceil(large.count() / TASK_ROWS))
    return large.repartition(tasks, left).join(small.repartition(tasks, right), F.col(left) == F.col(right))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that buy from others, an order being the file that makes the edge."""
    t = lambda name: _table(spark, sf_dir, name)
    bought = _joined(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", t("customer").select("c_custkey", "c_nationkey"), "c_custkey").select("o_orderkey", "c_nationkey")
    sold = t("lineitem").select("l_orderkey", "l_suppkey")
    if t("supplier").count() <= TASK_ROWS:
        sold = sold.join(F.broadcast(t("supplier").select("s_suppkey", "s_nationkey")), F.col("l_suppkey") == F.col("s_suppkey"))
    else:
        sold = _joined(sold, "l_suppkey", t("supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    found = _joined(sold.select("l_orderkey", "s_nationkey"), "l_orderkey", bought, "o_orderkey")
    return found.where("c_nationkey <> s_nationkey").select(F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target"), F.col("o_orderkey").alias("file"))


@query("T", f"SELECT source, target, count(DISTINCT file) AS n FROM ({EDGES}) GROUP BY source, target HAVING count(DISTINCT file) > 100")
def pair_saturation(spark, sf_dir):
    return joins.saturation(_edges(spark, sf_dir), "source", "target", "file", 100)


@query("T", f"SELECT n_nationkey AS node, coalesce(n, 0) AS n FROM nation LEFT JOIN (SELECT source, count(DISTINCT target) AS n FROM ({EDGES}) GROUP BY source) ON source = n_nationkey")
def fan_out(spark, sf_dir):
    return joins.fan_out(_edges(spark, sf_dir), _table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "node"), "node", "source", "target")


@query("T", f"SELECT count(*) AS pairs, count(*) > 4 AS too_many FROM (SELECT DISTINCT source, target FROM ({EDGES}))")
def total_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("source", "target").distinct().agg(F.count(F.lit(1)).alias("pairs")).withColumn("too_many", F.col("pairs") > 4)


@query("T", f"""
WITH RECURSIVE strong AS (SELECT source AS a, target AS b FROM ({EDGES}) GROUP BY source, target HAVING count(DISTINCT file) > 140),
reach(a, b) AS (SELECT a, b FROM strong UNION SELECT r.a, s.b FROM reach r JOIN strong s ON r.b = s.a)
SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a
WHERE x.a IN (SELECT p.a FROM reach p JOIN reach q ON p.a = q.b AND p.b = q.a WHERE p.a <> p.b) GROUP BY x.a""")
def cycle_components(spark, sf_dir):
    strong = joins.saturation(_edges(spark, sf_dir), "source", "target", "file", 140)
    return graph.cycles(strong.select(F.col("source").alias("a"), F.col("target").alias("b")))


@query("T", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_witness(spark, sf_dir):
    return joins.first_per(_table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("T", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 2")
def second_of_kind(spark, sf_dir):
    return joins.first_per(_table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], number=2).select("user_id", "event_type", "event_id")


@query("T", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def ungranted_edges(spark, sf_dir):
    return joins.unmatched(_table(spark, sf_dir, "documents").select("doc_id", "source"), _table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])


@query("T", "SELECT p_partkey, p_brand FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45)")
def stale_grants(spark, sf_dir):
    used = _table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return joins.unmatched(_table(spark, sf_dir, "part").select("p_partkey", "p_brand"), used, ["p_partkey"])


@query("T", r"SELECT page_id, element, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(button|input|select|textarea|table|h1|h2|h3|p|ul|ol|li|a|img|div)\b', 1)) AS element FROM pages) GROUP BY page_id, element")
def raw_elements(spark, sf_dir):
    names = F.regexp_extract_all("html", F.lit(r"<(button|input|select|textarea|table|h1|h2|h3|p|ul|ol|li|a|img|div)\b"), F.lit(1))
    return _table(spark, sf_dir, "pages").select("page_id", F.explode(names).alias("element")).groupBy("page_id", "element").agg(F.count(F.lit(1)).alias("n"))


@query("T", r"SELECT page_id, trim(unnest(regexp_extract_all(style, '([^;{}]*)[;}]', 1))) AS declaration FROM (SELECT page_id, regexp_extract(html, '<style>([^<]*)</style>', 1) AS style FROM pages)")
def css_declarations(spark, sf_dir):
    style = F.regexp_extract("html", "<style>([^<]*)</style>", 1)
    return _table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all(style, F.lit("([^;{}]*)[;}]"), F.lit(1))).alias("d")).select("page_id", F.trim("d").alias("declaration"))


CSS = [("a.css", 1, "color: #fff"), ("a.css", 2, "color: var(--ink)"), ("a.css", 3, "background: rgb(1, 2, 3)"), ("b.css", 1, "--brand: #abc"), ("styles.css", 1, "color: #000"), ("b.css", 2, "font-size: 12px"), ("b.css", 3, "font-size: 1.5em"), ("b.css", 4, "font: hsl(1 2% 3%)"), ("b.css", 5, "border-radius: 4px"), ("b.css", 6, "font-size: 90%"), ("b.css", 7, "font-size: .8rem")]
COLOR = "#[0-9a-fA-F]{3,8}|(rgb|rgba|hsl|hsla|oklch|oklab|lab|lch|color)[(]"
SIZE = "^font-size: *[0-9.]+(px|rem|pt)"


@query("R", f"SELECT path, line, CASE WHEN regexp_matches(d, '{SIZE}') THEN 'font-size' ELSE 'color' END AS what FROM ({_values(CSS)}) t(path, line, d) WHERE path <> 'styles.css' AND NOT starts_with(d, '--') AND (regexp_matches(d, '{COLOR}') OR regexp_matches(d, '{SIZE}'))")
def css_raw_values(spark, sf_dir):
    d = spark.createDataFrame(CSS, "path string, line int, d string").where("path <> 'styles.css'").where(~F.col("d").startswith("--"))
    return d.where(F.col("d").rlike(COLOR) | F.col("d").rlike(SIZE)).select("path", "line", F.when(F.col("d").rlike(SIZE), "font-size").otherwise("color").alias("what"))


VACANT = ("data", "info", "item", "manager", "helper", "util", "handler", "value", "object", "thing", "the", "der", "les", "los")


@query("T", rf"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM documents) WHERE w IN ({', '.join(map(repr, VACANT))}) GROUP BY doc_id")
def vacant_words(spark, sf_dir):
    words = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("w"))
    return words.where(F.col("w").isin(*VACANT)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


NAMES = [("userData",), ("HTTPServer",), ("parse_item",), ("helperFor",), ("Dataset",), ("invoiceTotal",), ("itemsById",), ("getHTTPInfo",)]


@query("R", rf"""SELECT name, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda w: w <> ''), ' ') AS words FROM ({_values(NAMES)}) t(name)""")
def identifier_words(spark, sf_dir):
    return spark.createDataFrame(NAMES, "name string").select("name", F.array_join(text.identifier_words(F.col("name")), " ").alias("words"))


@query("T", "SELECT DISTINCT conv_id, turn, role FROM conversations")
def duplicate_offset_dedupe(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()


@query("T", """
WITH o AS (SELECT user_id, event_id AS outer_id, ts AS outer_start, ts + INTERVAL 6 HOUR AS outer_end FROM events WHERE event_type = 'purchase')
SELECT outer_id, count(*) AS n FROM events e JOIN o ON e.user_id = o.user_id AND e.ts >= outer_start AND e.ts + INTERVAL 1 MINUTE <= outer_end GROUP BY outer_id""")
def range_containment(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    events = events.select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    outer = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("outer_id"), F.col("at").alias("outer_start"), (F.col("at") + 6 * 3_600_000_000).alias("outer_end"))
    inner = events.select("user_id", F.col("at").alias("start"), (F.col("at") + 60_000_000).alias("end"))
    return intervals.contained(inner, outer, ["user_id"]).groupBy("outer_id").agg(F.count(F.lit(1)).alias("n"))


OWNED = [("example.com", "root"), ("example.com/en", "english"), ("example.com/en/1", "first"), ("example.net/fr", "french"), ("example.net", "net")]


@query("T", rf"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://(?:[a-z]+[.])*?(example[.][a-z]+)', '\1'), '[?#].*$', '') AS path FROM pages)
SELECT page_id, arg_max(prefix, length(prefix)) AS prefix, arg_max(owner, length(prefix)) AS owner FROM p LEFT JOIN ({_values(OWNED)}) t(prefix, owner) ON path = prefix OR starts_with(path, prefix || '/') GROUP BY page_id, path""")
def longest_prefix_owner(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://(?:[a-z]+[.])*?(example[.][a-z]+)", "$1"), "[?#].*$", "")
    pages = _table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return joins.longest_prefix(pages, "path", spark.createDataFrame(OWNED, "prefix string, owner string"), "prefix").select("page_id", "prefix", "owner")


@query("T", """
SELECT 'missing' AS side, nation FROM (SELECT c_nationkey AS nation FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'extra' AS side, nation FROM (SELECT s_nationkey AS nation FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer)""")
def multiset_difference(spark, sf_dir):
    return joins.multiset_difference(_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))


LAYER_EDGES = [("billing", "service", "ui"), ("billing", "ui", "service"), ("billing", "repo", "controllers"), ("billing", "controllers", "repo"), ("crm", "ui", "repo"), ("crm", "service", "service"), ("crm", "controllers", "service")]
OCCUPIED = [("billing", "ui"), ("billing", "controllers"), ("billing", "service"), ("billing", "repo"), ("crm", "ui"), ("crm", "service"), ("crm", "repo")]
RANKS = [(name, i) for i, name in enumerate(paths.LAYERS)]


def _ranked(spark: SparkSession) -> DataFrame:
    rank = spark.createDataFrame(RANKS, "layer string, rank int")
    edges = spark.createDataFrame(LAYER_EDGES, "feature string, source string, target string")
    side = lambda name: F.broadcast(rank.select(F.col("layer").alias(name), F.col("rank").alias(f"{name}_rank")))  # noqa: E731  four rows
    return edges.join(side("source"), "source").join(side("target"), "target")


RANKED = f"({_values(LAYER_EDGES)}) e(feature, source, target) JOIN ({_values(RANKS)}) s(s_layer, source_rank) ON s_layer = source JOIN ({_values(RANKS)}) t(t_layer, target_rank) ON t_layer = target"


@query("R", f"SELECT feature, source, target FROM {RANKED} WHERE target_rank < source_rank")
def layer_rank_violation(spark, sf_dir):
    return _ranked(spark).where("target_rank < source_rank").select("feature", "source", "target")


@query("R", f"SELECT feature, source, target, string_agg(layer, ',' ORDER BY rank) AS skipped FROM {RANKED} JOIN ({_values(OCCUPIED)}) o(o_feature, layer) ON o_feature = feature JOIN ({_values(RANKS)}) r(r_layer, rank) ON r_layer = layer WHERE rank > source_rank AND rank < target_rank GROUP BY feature, source, target")
def layer_skip(spark, sf_dir):
    occupied = spark.createDataFrame(OCCUPIED, "feature string, layer string").groupBy("feature").agg(F.collect_set("layer").alias("occupied"))
    between = F.slice(F.array(*map(F.lit, paths.LAYERS)), F.col("source_rank") + 2, F.greatest(F.col("target_rank") - F.col("source_rank") - 1, F.lit(0)))
    skipped = F.array_intersect(between, "occupied")
    return _ranked(spark).join(occupied, "feature").withColumn("skipped", skipped).where(F.size("skipped") > 0).select("feature", "source", "target", F.array_join("skipped", ",").alias("skipped"))


IMPORTS = [("index", "view"), ("view", "hook"), ("hook", "client"), ("client", "wire"), ("wire", "node:fs"), ("view", "wire"), ("hook", "view"), ("x", "y")]


@query("R", f"""
WITH RECURSIVE e(a, b) AS ({_values(IMPORTS)}), r(node, depth) AS (SELECT 'index', 0 UNION SELECT b, depth + 1 FROM r JOIN e ON a = node WHERE depth < 3)
SELECT 'index' AS start, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node""")
def bounded_reach(spark, sf_dir):
    edges = spark.createDataFrame(IMPORTS, "a string, b string")
    return graph.bounded_reach(edges, spark.createDataFrame([("index",)], "node string"), 3)


POLICY_EDGES = [
    ("features/a/ui/view.tsx", "features/b/index.ts", None, False), ("features/a/ui/view.tsx", "features/b/service/x.ts", None, False), ("features/a/service/x.ts", "infrastructure/db/client.ts", None, False),
    ("domains/money/sum.ts", "shared/math.ts", None, False), ("domains/money/sum.ts", None, "lodash", False), ("domains/money/sum.ts", None, "lodash", True), ("routes/home.tsx", "features/b/ui/card.tsx", None, False),
    ("features/a/ui/view.tsx", "features/a/service/x.ts", None, False), ("stray/x.ts", "shared/math.ts", None, False), ("features/a/ui/view.tsx", "stray/y.ts", None, False), ("shared/ui/button.tsx", "shared/math.ts", None, False),
    ("shared/math.ts", "shared/ui/button.tsx", None, False), ("features/a/repo/r.ts", "features/b/index.ts", None, False), ("features/a/index.ts", "shared/math.ts", None, False), ("router.tsx", "routes/home.tsx", None, False),
]
_SQL_STEM = "regexp_replace({c}, '[.]([cm]?[jt]s|[jt]sx)$', '')"
_SEG = lambda c, n: f"string_split({c}, '/')[{n}]"
_S, _T = _SQL_STEM.format(c="source_path"), _SQL_STEM.format(c="target_path")
_LEN = lambda c: f"len(string_split({c}, '/'))"
_UNIT = lambda c: f"CASE WHEN {_SEG(c, 1)} IN ('features', 'domains') AND {_LEN(c)} > 1 THEN {_SEG(c, 1)} || '/' || {_SEG(c, 2)} WHEN {c} = 'shared/ui' OR starts_with({c}, 'shared/ui/') THEN 'shared/ui' WHEN {_SEG(c, 1)} IN ('routes', 'infrastructure', 'shared') THEN {_SEG(c, 1)} WHEN {_LEN(c)} = 1 THEN '<root>' END"


@query("R", f"""
WITH e AS (SELECT *, {_S} AS s, {_T} AS t FROM ({_values(POLICY_EDGES)}) v(source_path, target_path, package, type_only)),
c AS (SELECT *, CASE WHEN {_LEN('s')} = 1 THEN 'source-root' WHEN {_SEG('s', 1)} = 'routes' THEN 'route'
  WHEN {_SEG('s', 1)} = 'features' AND {_LEN('s')} = 3 THEN CASE WHEN {_SEG('s', 3)} IN ('index', 'index.server') THEN 'feature-barrel' ELSE 'feature-root' END
  WHEN {_SEG('s', 1)} = 'features' AND {_LEN('s')} > 3 AND {_SEG('s', 3)} IN ('ui', 'controllers', 'service', 'repo') THEN 'feature-' || {_SEG('s', 3)}
  WHEN {_SEG('s', 1)} = 'domains' THEN 'domain' WHEN {_SEG('s', 1)} = 'infrastructure' THEN 'infrastructure' WHEN starts_with(s, 'shared/ui/') THEN 'shared-ui' WHEN {_SEG('s', 1)} = 'shared' THEN 'shared' END AS profile,
  CASE WHEN package IS NOT NULL THEN 'package' WHEN {_SEG('t', 1)} = 'routes' THEN 'route' WHEN {_SEG('t', 1)} = 'features' THEN 'feature' WHEN {_SEG('t', 1)} = 'domains' THEN 'domain' WHEN {_SEG('t', 1)} = 'infrastructure' THEN 'infrastructure'
  WHEN starts_with(t, 'shared/ui/') THEN 'shared-ui' WHEN {_SEG('t', 1)} = 'shared' THEN 'shared' END AS area, {_UNIT('s')} AS source_unit, coalesce(package, {_UNIT('t')}) AS unit FROM e),
m AS (SELECT c.*, surface FROM c LEFT JOIN ({_values(policy.ROWS)}) p(p_profile, p_area, surface) ON p_profile = profile AND p_area = area)
SELECT source_path, coalesce(target_path, package) AS target, type_only, CASE WHEN profile IS NULL THEN 'unclassified-source' WHEN area IS NULL THEN 'unclassified-target' WHEN package IS NULL AND unit = source_unit THEN 'internal'
  WHEN profile = 'domain' AND NOT type_only AND area NOT IN ('domain', 'shared') THEN 'impure-domain' WHEN surface = 'deny' THEN 'denied-direction'
  WHEN surface = 'any' OR t IN (unit, unit || '/index', unit || '/index.server') OR (surface = 'barrel-or-ui' AND (t = unit || '/ui' OR starts_with(t, unit || '/ui/'))) THEN 'allowed' ELSE 'denied-exposure' END AS verdict FROM m""")
def policy_lookup(spark, sf_dir):
    edges = spark.createDataFrame(POLICY_EDGES, "source_path string, target_path string, package string, type_only boolean")
    return policy.verdicts(edges).select("source_path", F.coalesce("target_path", "package").alias("target"), "type_only", "verdict")


GRANTS = [("a", '{"billing": "shares invoices"}'), ("b", '{"briber": ""}'), ("c", "null"), ("d", "42"), ("e", '{"x": "y"'), ("f", "{}"), ("g", '["x"]'), ("h", '{"x": 1}'), ("i", None)]


@query("R", f"""SELECT feature, CASE WHEN body IS NULL THEN 'absent' WHEN NOT json_valid(body) THEN 'malformed' WHEN json_type(body) <> 'OBJECT' THEN 'malformed'
  WHEN len(list_filter(json_keys(body), lambda k: coalesce(json_type(body, '$.' || k), '') <> 'VARCHAR' OR trim(json_extract_string(body, '$.' || k)) = '')) > 0 THEN 'malformed' ELSE 'grants' END AS state FROM ({_values(GRANTS)}) t(feature, body)""")
def grant_json_states(spark, sf_dir):
    from .facts import grant_state

    return spark.createDataFrame(GRANTS, "feature string, body string").select("feature", grant_state(F.col("body")).alias("state"))


TOKENS = [("spacing.sm", "0.5rem"), ("spacing.md", "1rem"), ("radius.lg", "12px"), ("odd", "2em")]
LITERALS = [("a.tsx", 3, 8), ("a.tsx", 9, 16), ("b.tsx", 1, 12), ("b.tsx", 2, 13)]


@query("R", f"""SELECT file, line, px, name FROM ({_values(LITERALS)}) l(file, line, px) JOIN (SELECT name, CASE WHEN ends_with(value, 'rem') THEN CAST(round(CAST(replace(value, 'rem', '') AS DOUBLE) * 16) AS INTEGER) WHEN ends_with(value, 'px') THEN CAST(replace(value, 'px', '') AS INTEGER) END AS px_token FROM ({_values(TOKENS)}) t(name, value)) ON px = px_token""")
def token_equality(spark, sf_dir):
    tokens = spark.createDataFrame(TOKENS, "name string, value string").select("name", text.pixels(F.col("value")).alias("px"))
    return spark.createDataFrame(LITERALS, "file string, line int, px int").join(tokens, "px").select("file", "line", "px", "name")


PATHS = [("a/./b",), ("a/../b",), ("../x",), ("a/b/../../c",), ("a/b/../../../c",), ("x",)]


@query("R", f"SELECT path, norm FROM ({_values(PATHS)}) t(path) LEFT JOIN (VALUES ('a/./b', 'a/b'), ('a/../b', 'b'), ('a/b/../../c', 'c'), ('x', 'x')) u(p, norm) ON p = path")
def normalized_paths(spark, sf_dir):
    return spark.createDataFrame(PATHS, "path string").select("path", paths.normalized(F.col("path")).alias("norm"))
