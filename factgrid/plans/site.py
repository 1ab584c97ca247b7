"""The rules over imports, asked of a tree that Spark derives from the pages: each page is a module, its links are imports.

A page of a site is a file of the feature (or, under .org, the domain) that has the site's name, in a layer by its number; some
pages are routes, infrastructure, shared code or astray, and the first page of a feature or domain is its barrel. A link that a
page answers is an import by alias or by relative path; two of the others are packages. The files have texts, so the scan for
imports and the resolution of modules run as they do on a real tree, and all work grows with the pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.paths import Tree
from ..sources import tree
from . import facts as jsons
from . import perfile, structural
from .cases import IMPORT_RULES, TREE_RULES, edges_sql, query_name
from .catalogue import _table, query
from .links import LINKS, links

LAYERS = ("ui", "controllers", "service", "repo")
APART = ((11, 10, "routes"), (13, 12, "infrastructure/db"), (17, 16, "shared"), (19, 18, "stray"))
SITE, ORG = "^[a-z]+://(?:www[.]|m[.]|blog[.])?([a-z-]+)[.]", "^[a-z]+://[^/]*[.]org/"

_APART = " ".join(f"WHEN page_id % {n} = {k} THEN '{where}'" for n, k, where in APART)
TREE = f"""{LINKS},
u AS (SELECT page_id, CASE WHEN regexp_matches(url, '{ORG}') THEN 'domains/' ELSE 'features/' END || regexp_extract(url, '{SITE}', 1) AS unit, CASE {_APART} END AS apart FROM pages),
p AS (SELECT page_id, CASE WHEN apart IS NOT NULL THEN apart || '/p' || page_id WHEN page_id = min(CASE WHEN apart IS NULL THEN page_id END) OVER (PARTITION BY unit) THEN unit || '/index'
  WHEN starts_with(unit, 'domains/') THEN unit || '/p' || page_id ELSE unit || '/' || [{', '.join(f"'{x}'" for x in LAYERS)}][page_id % 4 + 1] || '/p' || page_id END AS stem FROM u),
i AS (SELECT a, place, s.stem, t.stem AS target, place % 5 = 0 AS type_only, place % 3 = 0 AND b IS NOT NULL AS relative,
    CASE WHEN b IS NOT NULL AND place % 3 = 0 THEN repeat('../', length(s.stem) - length(replace(s.stem, '/', ''))) || t.stem WHEN b IS NOT NULL THEN '@/' || t.stem WHEN place = 1 THEN 'stripe' WHEN place = 2 THEN 'node:fs' END AS specifier
  FROM l JOIN p s ON s.page_id = a LEFT JOIN p t ON t.page_id = b),
o AS (SELECT *, 'import ' || CASE WHEN type_only THEN 'type ' ELSE '' END || 'x' || place || ' from "' || specifier || '";' AS said FROM i WHERE specifier IS NOT NULL),
q AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY place) AS line, coalesce(sum(length(said) + 1) OVER (PARTITION BY a ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM o)"""
ROWS = "SELECT 'src', 'src/' || stem || '.ts', stem || '.ts', CAST(start AS INTEGER), CAST(line AS INTEGER), specifier, relative, target || '.ts', CASE WHEN target IS NULL THEN specifier END, type_only FROM q"
FILES = "SELECT 'src', stem || '.ts' FROM p"


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, stem): where each page lies in the tree."""
    page = F.col("page_id")
    apart = F.lit(None).cast("string")
    for n, k, where in reversed(APART):
        apart = F.when(page % n == k, where).otherwise(apart)
    unit = F.concat(F.when(F.col("url").rlike(ORG), "domains/").otherwise("features/"), F.regexp_extract("url", SITE, 1))
    pages = _table(spark, sf_dir, "pages").select("page_id", unit.alias("unit"), apart.alias("apart"))
    barrels = pages.where("apart is null").groupBy("unit").agg(F.min("page_id").alias("barrel"))
    name = F.concat(F.lit("p"), page)
    layer = F.element_at(F.array(*map(F.lit, LAYERS)), (page % 4 + 1).cast("int"))
    stem = (
        F.when(F.col("apart").isNotNull(), F.concat_ws("/", "apart", name)).when(page == F.col("barrel"), F.concat("unit", F.lit("/index")))
        .when(F.col("unit").startswith("domains/"), F.concat_ws("/", "unit", name)).otherwise(F.concat_ws("/", "unit", layer, name))
    )
    return pages.join(barrels, "unit", "left").select("page_id", stem.alias("stem"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text) of all modules, a line for each import."""
    at = modules(spark, sf_dir)
    found = links(spark, sf_dir).join(at.toDF("a", "stem"), "a").join(at.toDF("b", "target"), "b", "left")
    up = F.repeat(F.lit("../"), F.length("stem") - F.length(F.replace("stem", F.lit("/"), F.lit(""))))
    answered = F.col("target").isNotNull()
    specifier = F.when(answered & (F.col("place") % 3 == 0), F.concat(up, "target")).when(answered, F.concat(F.lit("@/"), "target")).when(F.col("place") == 1, "stripe").when(F.col("place") == 2, "node:fs")
    said = F.concat(F.lit("import "), F.when(F.col("place") % 5 == 0, "type ").otherwise(""), F.lit("x"), "place", F.lit(' from "'), specifier, F.lit('";'))
    lines = found.select("a", "place", said.alias("said")).where("said is not null").groupBy("a").agg(F.array_sort(F.collect_list(F.struct("place", "said"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["said"]), "\n")
    return at.join(lines.withColumnRenamed("a", "page_id"), "page_id", "left").select(F.concat(F.lit("src/"), "stem", F.lit(".ts")).alias("file"), F.coalesce(body, F.lit("")).alias("text"))


def _facts(spark: SparkSession, sf_dir: str) -> structural.Facts:
    found = files(spark, sf_dir)
    return structural.Facts(tree.source_files(found, [Tree("src")]), files=found)


def _named(name: str, doc: str, f):
    f.__name__, f.__doc__ = name, doc
    return f


for _rule, _sql in IMPORT_RULES.items():
    _name = query_name(_rule).replace("rule_", "site_", 1)
    query("T", f"WITH {TREE}, {edges_sql(ROWS, FILES)} {_sql}")(_named(_name, f"{_rule} over the pages' tree.", lambda spark, sf_dir, r=_rule: perfile.RULES[r](perfile.Syntax(_facts(spark, sf_dir))).select("file", "start")))

#: Rings of any length: pairs that reach each other.
RINGS = "r(a, b) AS (SELECT DISTINCT {0}, {1} FROM e WHERE {0} <> {1} UNION SELECT r.a, {1} FROM r JOIN e ON {0} = r.b AND {0} <> {1}), c AS (SELECT x.a, min(x.b) AS least FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a)"
RING_FILES = "SELECT DISTINCT 'error' AS severity, 'src/{0}/' || least AS file, CAST(NULL AS INT) AS line FROM (SELECT least(a, least) AS least FROM c) WHERE least IS NOT NULL"
OTHERS = {
    "graph/domain-cycles": f"{RINGS.format('fd', 'td')} {RING_FILES.format('domains')}",
    "graph/feature-deps": f"{RINGS.format('ff', 'tf')} {RING_FILES.format('features')} UNION ALL {TREE_RULES['graph/feature-deps'].partition('UNION ALL')[2]}",
}
for _rule, _sql in TREE_RULES.items():
    _name = query_name(_rule).replace("rule_", "site_", 1) + ("_tree" if _rule in IMPORT_RULES else "")
    _whole = f"WITH RECURSIVE {TREE}, {edges_sql(ROWS, FILES)}, {OTHERS[_rule]}" if _rule in OTHERS else f"WITH {TREE}, {edges_sql(ROWS, FILES)} {_sql}"
    query("T", _whole)(_named(_name, f"{_rule} over the pages' tree.", lambda spark, sf_dir, r=_rule: structural.CHECKS[r](_facts(spark, sf_dir)).select("severity", "file", "line")))


@query("T", f"WITH {TREE} SELECT 'src/' || stem || '.ts' AS file, specifier, CAST(start AS INTEGER) AS \"offset\", CAST(line AS INTEGER) AS line, relative, target || '.ts' AS target_path, CASE WHEN target IS NULL THEN specifier END AS package, type_only FROM q")
def site_imports(spark, sf_dir):
    """What the scan finds in the tree's files and where it leads."""
    return _facts(spark, sf_dir).resolved.select("file", "specifier", "offset", "line", "relative", "target_path", "package", "type_only")


@query("T", f"WITH {TREE} SELECT 'error' AS severity, 'src/' || stem || '.ts' AS file FROM p WHERE starts_with(stem, 'stray/')")
def site_placement_topology(spark, sf_dir):
    """placement/topology over the pages' tree."""
    return structural.topology(_facts(spark, sf_dir)).select("severity", "file")


@query("T", r"SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(p_name || initcap, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda w: w <> ''), ' ') AS words FROM (SELECT p_partkey, p_name, replace(p_type, ' ', '') AS initcap FROM part)")
def part_words(spark, sf_dir):
    """The words of a name that is made of a part's name and type."""
    name = F.concat("p_name", F.replace("p_type", F.lit(" "), F.lit("")))
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.identifier_words(name), " ").alias("words"))


@query("T", """SELECT event_id, CASE WHEN props IS NULL THEN 'absent' WHEN NOT json_valid(props) THEN 'malformed' WHEN json_type(props) <> 'OBJECT' THEN 'malformed'
  WHEN len(list_filter(json_keys(props), lambda k: coalesce(json_type(props, '$.' || k), '') <> 'VARCHAR' OR trim(json_extract_string(props, '$.' || k)) = '')) > 0 THEN 'malformed' ELSE 'grants' END AS state FROM events""")
def event_grant_states(spark, sf_dir):
    """Properties of events read as grants: an object of reasons, or malformed."""
    return _table(spark, sf_dir, "events").select("event_id", jsons.grant_state(F.col("props")).alias("state"))


@query("T", "SELECT o_orderkey, o_orderstatus || ' {{' || o_orderpriority || '}} ' || CAST(o_custkey AS VARCHAR) || ' {{other}}' AS said FROM orders")
def order_notes(spark, sf_dir):
    """A template rendered for each order; what a value brings in isn't rendered again."""
    braced = F.concat(F.lit("{{"), "o_orderpriority", F.lit("}}"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.rendered("{{a}} {{b}} {{c}} {{other}}", {"a": F.col("o_orderstatus"), "b": braced, "c": F.col("o_custkey")}).alias("said"))
