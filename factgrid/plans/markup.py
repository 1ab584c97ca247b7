"""Queries about the markup of pages: elements and what lies around them, and the declarations of styles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, scan
from ..operators import nesting
from .catalogue import _table, query

_QUOTED = lambda names: ", ".join(f"'{n}'" for n in names)
#: The stack machine again, one token a page in each step: a step ends what its tag ends, then pushes the new element.
ELEMENTS = rf"""
t AS (
  SELECT page_id, list_filter(regexp_extract_all(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script *>|<style[^>]*>.*?</style *>|<title[^>]*>.*?</title *>|</?[a-z][^>]*>'), lambda x: x[2] <> '!') AS toks FROM pages WHERE html IS NOT NULL
), u AS (
  SELECT page_id, i, lower(regexp_extract(toks[i], '^</?([a-zA-Z][a-zA-Z0-9-]*)', 1)) AS tag, toks[i][2] = '/' AS ends, regexp_matches(toks[i], '(?i)^<(script|style|title)[ >]') AS raw FROM (SELECT page_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM t)
), s AS (
  SELECT page_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS tags, CAST([] AS BIGINT[]) AS ids, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS made, CAST(NULL AS BIGINT) AS parent, CAST(0 AS BIGINT) AS depth FROM t
  UNION ALL
  SELECT page_id, i, CASE WHEN adds AND NOT void THEN list_append(tags[1:keep], tag) ELSE tags[1:keep] END, CASE WHEN adds AND NOT void THEN list_append(ids[1:keep], n + 1) ELSE ids[1:keep] END,
    CASE WHEN adds THEN n + 1 ELSE n END, CASE WHEN adds THEN tag END, CASE WHEN adds AND keep > 0 THEN ids[keep] END, keep + 1
  FROM (
    SELECT s.page_id, u.i, s.tags, s.ids, s.n, u.tag, NOT u.ends AS adds, u.raw OR u.tag IN ({_QUOTED(markup.VOID)}) AS void,
      CASE WHEN u.ends AND list_contains(s.tags, u.tag) THEN len(s.tags) - list_position(list_reverse(s.tags), u.tag)
        WHEN NOT u.ends AND u.tag IN ({_QUOTED(markup.ENDS_P)}) AND list_contains(s.tags, 'p') THEN len(s.tags) - list_position(list_reverse(s.tags), 'p')
        WHEN NOT u.ends AND u.tag = 'li' AND list_contains(s.tags, 'li') AND list_position(list_reverse(s.tags), 'li') < coalesce(list_position(list_reverse(s.tags), 'ul'), 1000) THEN len(s.tags) - list_position(list_reverse(s.tags), 'li')
        ELSE len(s.tags) END AS keep
    FROM s JOIN u ON u.page_id = s.page_id AND u.i = s.i + 1)
), e AS (
  SELECT page_id, n AS enter, parent, depth, made AS tag FROM s WHERE made IS NOT NULL
), elements AS (
  SELECT a.page_id, a.enter, a.parent, a.depth, a.tag, coalesce(min(b.enter) - 1, m.most) AS leave
  FROM e a JOIN (SELECT page_id, max(enter) AS most FROM e GROUP BY page_id) m ON m.page_id = a.page_id LEFT JOIN e b ON b.page_id = a.page_id AND b.enter > a.enter AND b.depth <= a.depth GROUP BY a.page_id, a.enter, a.parent, a.depth, a.tag, m.most
)"""
SECTIONS = ("head", "body", "nav", "article", "div", "footer", "ul")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of all pages: page_id, enter, leave, parent, depth, tag, start, end."""
    return scan.each_text(_table(spark, sf_dir, "pages"), ["page_id"], "html", markup.html_elements, "enter long, leave long, parent long, depth long, tag string, start long, end long")


@query("T", f"WITH RECURSIVE {ELEMENTS} SELECT page_id, enter, leave, parent, depth, tag FROM elements")
def page_elements(spark, sf_dir):
    """Every element of every page with its numbers, its parent and its depth, by a stack machine over the page's tags."""
    return elements(spark, sf_dir).drop("start", "end")


@query("T", f"""
WITH RECURSIVE {ELEMENTS}
SELECT a.page_id, a.enter, a.tag, count(o.enter) AS depth, arg_max(o.tag, o.enter) AS section, max(o.enter) AS section_enter
FROM elements a LEFT JOIN elements o ON o.page_id = a.page_id AND o.tag IN ({_QUOTED(SECTIONS)}) AND o.enter < a.enter AND a.enter <= o.leave GROUP BY a.page_id, a.enter, a.tag""")
def element_sections(spark, sf_dir):
    """Each element with the innermost section around it and the number of all sections around it, by enter and leave numbers."""
    nodes = elements(spark, sf_dir).select("page_id", "enter", (F.col("leave") + 1).alias("behind"), "tag")
    found = nesting.around(nodes, nodes.where(F.col("tag").isin(*SECTIONS)), ["page_id"], id="enter", start="enter", end="behind", carry=["tag"])
    return found.select("page_id", "enter", "tag", "depth", F.col("outer_tag").alias("section"), F.col("outer_enter").alias("section_enter"))


@query("T", f"""
WITH RECURSIVE {ELEMENTS}
SELECT o.page_id, o.enter, o.tag, count(a.enter) AS links FROM elements o LEFT JOIN elements a ON a.page_id = o.page_id AND a.tag = 'a' AND o.enter < a.enter AND a.enter <= o.leave
WHERE o.tag IN ({_QUOTED(SECTIONS)}) GROUP BY o.page_id, o.enter, o.tag""")
def section_links(spark, sf_dir):
    """The sections of each page with the number of links within them, at any depth."""
    nodes = elements(spark, sf_dir).select("page_id", "enter", (F.col("leave") + 1).alias("behind"), "tag")
    found = nesting.held(nodes.where(F.col("tag").isin(*SECTIONS)), nodes.where("tag = 'a'"), ["page_id"], id="enter", start="enter", end="behind")
    return found.select("page_id", "enter", "tag", F.col("inside").alias("links"))


@query("T", r"""
WITH b AS (SELECT page_id, html, unnest(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style', 1)) AS sheet FROM pages),
d AS (SELECT page_id, html, sheet, unnest(regexp_extract_all(sheet, '([^{}]*)\{([^{}]*)\}', 1)) AS head, unnest(regexp_extract_all(sheet, '([^{}]*)\{([^{}]*)\}', 2)) AS body FROM b),
r AS (SELECT page_id, html, trim(head) AS around, head, unnest(string_split(body, ';')) AS decl FROM d)
SELECT page_id, 'style' AS source, CAST(1 AS BIGINT) AS number, around, trim(split_part(decl, ':', 1)) AS property, trim(substr(decl, instr(decl, ':') + 1)) AS value,
  CAST(instr(html, head || '{' || decl) + length(head) AS BIGINT) AS start, CAST(instr(html, head || '{' || decl) + length(head) + length(decl) AS BIGINT) AS "end" FROM r WHERE trim(decl) <> ''""")
def page_declarations(spark, sf_dir):
    """Each declaration of each style element and style attribute of a page, with what stands around it and its place."""
    columns = "source string, number long, around string, property string, value string, start long, end long"
    return scan.each_text(_table(spark, sf_dir, "pages"), ["page_id"], "html", markup.page_declarations, columns)
