"""Queries about what pages lead to: components, depth-first traces, gathered values, reach, and identities of addresses.

No address that a page links is that of a given page, but links are made of words: `/word` leads to the page of the least id
whose heading has the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, identity, lattice, trace
from ..operators.graph import cut
from .catalogue import _table, query

HREF, HEADING = 'href="/([^"]*)"', "<h1>([^<]*)"
LINKS = f"""
h AS (SELECT page_id AS a, unnest(regexp_extract_all(html, '{HREF}', 1)) AS name, generate_subscripts(regexp_extract_all(html, '{HREF}', 1), 1) AS place FROM pages),
n AS (SELECT name, min(page_id) AS b FROM (SELECT page_id, unnest(string_split(regexp_extract(html, '{HEADING}', 1), ' ')) AS name FROM pages) GROUP BY name),
l AS (SELECT a, CAST(place AS INTEGER) AS place, h.name, b FROM h LEFT JOIN n ON n.name = h.name)"""
STEPS = 4


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, place, name, b): the links of each page in their order, b null where no page answers."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "html")
    out = pages.select(F.col("page_id").alias("a"), F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("place", "name")).withColumn("place", F.col("place") + 1)
    heads = pages.select("page_id", F.explode(F.split(F.regexp_extract("html", HEADING, 1), " ")).alias("name")).groupBy("name").agg(F.min("page_id").alias("b"))
    return out.join(heads, "name", "left").select("a", "place", "name", "b")


@query("T", f"""
WITH RECURSIVE {LINKS},
t AS (SELECT a, list(b ORDER BY place, b) AS targets FROM (SELECT a, b, min(place) AS place FROM l WHERE b IS NOT NULL GROUP BY a, b) GROUP BY a),
w AS (
  SELECT page_id AS start, [{{'node': page_id, 'parent': CAST(NULL AS BIGINT), 'depth': 0, 'chain': CAST([] AS BIGINT[])}}] AS todo, CAST([] AS BIGINT[]) AS visited, CAST(0 AS BIGINT) AS n, FALSE AS made, CAST(NULL AS BIGINT) AS node, CAST(NULL AS BIGINT) AS parent, 0 AS depth, CAST([] AS BIGINT[]) AS chain, FALSE AS truncated FROM pages
  UNION ALL
  SELECT start, CASE WHEN fresh AND x.depth < {STEPS} THEN list_concat(todo[1:len(todo) - 1], [{{'node': b, 'parent': x.node, 'depth': x.depth + 1, 'chain': list_append(x.chain, x.node)}} FOR b IN list_reverse(targets)]) ELSE todo[1:len(todo) - 1] END,
    CASE WHEN fresh THEN list_append(visited, x.node) ELSE visited END, n + CAST(fresh AS INTEGER), fresh, x.node, x.parent, x.depth, list_append(x.chain, x.node),
    fresh AND x.depth = {STEPS} AND len([b FOR b IN targets IF b <> x.node AND NOT list_contains(visited, b)]) > 0
  FROM (SELECT w.start, w.todo, w.visited, w.n, w.todo[len(w.todo)] AS x, NOT list_contains(w.visited, w.todo[len(w.todo)].node) AS fresh, coalesce(t.targets, []) AS targets FROM w LEFT JOIN t ON t.a = w.todo[len(w.todo)].node WHERE len(w.todo) > 0)
)
SELECT start, n - 1 AS visit, node, parent, depth, array_to_string(chain, '>') AS chain, truncated FROM w WHERE made""")
def link_traces(spark, sf_dir):
    """What a walk from each page meets within four links, depth first and each page once: in order, with the chain of pages to it
    and whether it was cut there."""
    found = links(spark, sf_dir)
    starts = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("node"))
    walked = trace.depth_first(found.select("a", "b", "place"), starts, STEPS)
    return walked.withColumn("chain", F.array_join(F.transform("chain", lambda x: x.cast("string")), ">"))


REACH = f"""{LINKS},
r(a, b) AS (SELECT page_id, page_id FROM pages UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b WHERE l.b IS NOT NULL)"""


@query("T", f"WITH RECURSIVE {REACH} SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a HAVING count(*) > 1")
def link_rings(spark, sf_dir):
    """Pages that lead back to themselves by way of others, with the least page of their component."""
    return graph.cycles(links(spark, sf_dir).select("a", "b"))


@query("T", f"""
WITH RECURSIVE {REACH},
o AS (SELECT page_id AS node, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1) AS lang, NOT EXISTS (SELECT 1 FROM l WHERE l.a = page_id AND l.b IS NULL) AS complete, (SELECT min(name) FROM l WHERE l.a = page_id AND l.b IS NULL) AS missing FROM pages)
SELECT r.a AS node, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, bool_and(complete) AS complete, min(missing) AS missing, max(r.b) AS furthest FROM r JOIN o ON o.node = r.b GROUP BY r.a""")
def link_values(spark, sf_dir):
    """What each page gathers from all pages that it leads to, itself included: their languages, whether all links of all of them
    are answered, the least name that isn't, and the largest page."""
    found = links(spark, sf_dir)
    gaps = found.groupBy(F.col("a").alias("node")).agg(F.bool_and(F.col("b").isNotNull()).alias("complete"), F.min(F.when(F.col("b").isNull(), F.col("name"))).alias("missing"))
    own = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("node"), F.array(F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]+)/", 1)).alias("langs"), F.col("page_id").alias("furthest"))
    own = own.join(gaps, "node", "left").withColumn("complete", F.coalesce("complete", F.lit(True)))
    merge = {"langs": lattice.UNION, "complete": lattice.AND, "missing": lattice.MIN, "furthest": lattice.MAX}
    gathered = lattice.fixpoint(found.select("a", "b"), own, merge)
    return gathered.select("node", F.array_join("langs", ",").alias("langs"), "complete", "missing", "furthest")


@query("T", f"""
WITH RECURSIVE {LINKS}, e AS (SELECT DISTINCT a, b FROM l WHERE b IS NOT NULL),
r(start, node, depth) AS (SELECT page_id, page_id, 0 FROM pages UNION SELECT r.start, e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node WHERE r.depth < 3)
SELECT start, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY start, node""")
def link_reach(spark, sf_dir):
    """What each page reaches within three links, a step at a time; Spark's recursive query keeps a row for each way, and there
    are more ways than it allows rows."""
    edges = cut(links(spark, sf_dir).where("b is not null").select("a", "b").distinct())
    return graph.bounded_reach(edges, _table(spark, sf_dir, "pages").select(F.col("page_id").alias("node")), 3)


#: What makes two addresses one, a step at a time: (pattern, replacement) over the whole address.
FOLDS = [
    ("#.*$", ""),
    (r"[?&](?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*", ""),
    (r"^([^?&]*)&", r"\1?"),
    (r"^([^?]*?)(?:/|[.]html?|/index[.]html?)$", r"\1"),
    ("^http:", "https:"),
    ("^https://(?:www|m)[.]", "https://"),
]


def _forms(url: Column) -> list[Column]:
    forms = [url]
    for pattern, replacement in FOLDS:
        forms.append(F.regexp_replace(forms[-1], pattern, replacement.replace("\\", "$")))
    return forms


def _folded_sql(url: str) -> str:
    for k, (pattern, replacement) in enumerate(FOLDS):
        url = f"regexp_replace({url}, '{pattern}', '{replacement}'{', ' + repr('g') if k == 1 else ''})"
    return url


def page_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(alias, target): each address of a page and each form on the way, with the next one that differs."""
    forms = F.array_distinct(F.array(*_forms(F.col("url"))))
    chain = _table(spark, sf_dir, "pages").where("url is not null").select(forms.alias("f"))
    pairs = chain.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("f") - 1, F.lit(1))), lambda i: F.struct(F.get("f", i - 1).alias("alias"), F.get("f", i).alias("target")))).alias("p"))
    return pairs.select("p.*").where("target is not null").distinct()


@query("T", f"SELECT page_id, url, {_folded_sql('url')} AS identity FROM pages")
def page_identities(spark, sf_dir):
    """The identity of each page's address: tracking parameters, fragments, default pages, scheme and mobile hosts are aliases,
    whose chains are followed to their ends."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return identity.fold(pages.withColumn("identity", F.col("url")), identity.identities(page_aliases(spark, sf_dir)), ["identity"])


@query("T", f"""
WITH {LINKS}, i AS (SELECT page_id, regexp_replace({_folded_sql('url')}, '/[^/]*$', '') AS site FROM pages)
SELECT x.site AS source, y.site AS target, count(*) AS links, count(DISTINCT l.a) AS pages FROM l JOIN i x ON x.page_id = l.a JOIN i y ON y.page_id = l.b WHERE x.site <> y.site GROUP BY x.site, y.site""")
def identity_links(spark, sf_dir):
    """Links between parts of sites (an identity without its last segment), each pair once, however its addresses are written."""
    pages = _table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("identity"))
    folded = identity.fold(pages, identity.identities(page_aliases(spark, sf_dir)), ["identity"]).select("page_id", F.regexp_replace("identity", "/[^/]*$", "").alias("site"))
    found = links(spark, sf_dir).where("b is not null").join(folded.toDF("a", "source"), "a").join(folded.toDF("b", "target"), "b").where("source <> target")
    return found.groupBy("source", "target").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("a").alias("pages"))
