"""Queries about order: words as readers sort them, numbers of findings over whole tables, totals counted by the write itself."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import collate, scan
from ..operators import numbering
from ..operators.graph import cut, shared_folder
from .catalogue import QUERIES, VACANT, _table, query

#: Explicit keys of a word's order: its letters without accents and case, then its accents, then its case.
_LETTERS = "replace(strip_accents(lower({w})), 'ß', 'ss')"
_ACCENTS = "array_to_string([CASE WHEN c IN ('á', 'é', 'í', 'ó', 'ú') THEN '14' WHEN c IN ('à', 'è', 'ì', 'ò', 'ù') THEN '15' WHEN c IN ('â', 'ê', 'î', 'ô', 'û') THEN '17' WHEN c IN ('ä', 'ë', 'ï', 'ö', 'ü') THEN '1B' WHEN c IN ('ã', 'ñ', 'õ') THEN '1D' WHEN c = 'ç' THEN '1E' WHEN c = 'ß' THEN '1Z1' ELSE '1' END FOR c IN string_split(lower({w}), '')], '')"
_CASE = "array_to_string([CASE WHEN c = lower(c) THEN '1' ELSE '2' END FOR c IN string_split({w}, '')], '')"
_KEYS = f"{_LETTERS.format(w='w')} AS k1, {_ACCENTS.format(w='w')} AS k2, {_CASE.format(w='w')} AS k3"
WORDS = rf"""
d AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '\p{{L}}+')) AS w FROM documents),
k AS (SELECT w, {_KEYS} FROM (SELECT DISTINCT w FROM d))"""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w"))


@query("T", f"""
WITH {WORDS},
n AS (SELECT lang, w, count(*) AS n FROM d GROUP BY lang, w),
g AS (SELECT lang, k1, k2, CAST(sum(n) AS BIGINT) AS n, count(*) AS spellings, arg_min(w, k3) AS word FROM n JOIN k USING (w) GROUP BY lang, k1, k2)
SELECT lang, word, spellings, n, row_number() OVER (PARTITION BY lang ORDER BY k1, k2) AS number FROM g""")
def collated_words(spark, sf_dir):
    """Words of each language, whatever their case, with the first of their spellings and their number in the collated order."""
    each = _words(spark, sf_dir).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    groups = each.groupBy("lang", collate.caseless("w").alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("spellings"), collate.plain(F.min(collate.ordered("w"))).alias("word"))
    return numbering.numbered(groups.select("lang", "word", "spellings", "n"), [collate.ordered("word")], by=["lang"])


@query("T", f"""
WITH {WORDS}
SELECT doc_id, arg_min(w, {{'a': k1, 'b': k2, 'c': k3}}) AS first_word, arg_max(w, {{'a': k1, 'b': k2, 'c': k3}}) AS last_word FROM (SELECT DISTINCT doc_id, w FROM d) JOIN k USING (w) GROUP BY doc_id""")
def witness_words(spark, sf_dir):
    """The first and the last word of each document in the collated order."""
    w = collate.ordered("w")
    return _words(spark, sf_dir).groupBy("doc_id").agg(collate.plain(F.min(w)).alias("first_word"), collate.plain(F.max(w)).alias("last_word"))


@query("T", f"""
WITH {WORDS},
p AS (SELECT DISTINCT a.lang AS first_lang, b.lang AS second_lang, k1, k2 FROM (SELECT DISTINCT lang, k1, k2 FROM d JOIN k USING (w)) a JOIN (SELECT DISTINCT lang, k1, k2 FROM d JOIN k USING (w)) b USING (k1, k2) WHERE a.lang < b.lang)
SELECT first_lang, second_lang, count(*) AS shared FROM p GROUP BY ALL""")
def shared_words(spark, sf_dir):
    """For each two languages the words that both have, whatever their case: a join on collated keys."""
    each = cut(_words(spark, sf_dir).select("lang", "w").distinct()).select("lang", collate.caseless("w").alias("k")).distinct()
    pairs = each.toDF("first_lang", "k").join(each.toDF("second_lang", "k"), "k").where("first_lang < second_lang")
    return pairs.groupBy("first_lang", "second_lang").agg(F.count(F.lit(1)).alias("shared"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["file_size_tiers"](spark, sf_dir)


FINDINGS = """f AS (SELECT doc_id, lines, CASE WHEN lines > 20 THEN 'error' ELSE 'warning' END AS severity FROM (
  SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS BIGINT) AS lines FROM documents WHERE text IS NOT NULL) WHERE lines > 12)"""


@query("T", f"WITH {FINDINGS} SELECT doc_id, lines, severity, row_number() OVER (ORDER BY severity, lines DESC, doc_id) AS number FROM f")
def numbered_findings(spark, sf_dir):
    """Documents with too many lines, numbered through: errors first, the longest first."""
    return numbering.numbered(_findings(spark, sf_dir), ["severity", F.desc("lines"), "doc_id"])


@query("T", rf"""
WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[ \t\n]+|[^ \t\n]+')) AS found, generate_subscripts(regexp_extract_all(text, '[ \t\n]+|[^ \t\n]+'), 1) AS i FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, found, CAST(coalesce(sum(length(found)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM p)
SELECT doc_id, found AS word, start, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS number FROM w WHERE found IN ({', '.join(map(repr, VACANT))})""")
def numbered_hits(spark, sf_dir):
    """Words that say little, numbered within their document in the order of their places."""
    hits = scan.matches(_table(spark, sf_dir, "documents"), ["doc_id"], "text", rf"(?<![^ \t\n])(?:{'|'.join(VACANT)})(?![^ \t\n])")
    return numbering.numbered(hits.select("doc_id", F.col("found").alias("word"), "start"), ["start"], by=["doc_id"])


@query("T", f"WITH {FINDINGS} SELECT count(*) AS rows, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, CAST(CASE WHEN count(*) FILTER (WHERE severity = 'error') > 0 THEN 1 ELSE 0 END AS BIGINT) AS status FROM f")
def written_findings(spark, sf_dir):
    """Totals and exit status of the findings, counted while they are written to the shared folder."""
    totals = numbering.written(_findings(spark, sf_dir), f"{shared_folder(spark)}/findings-{uuid.uuid4().hex}")
    return spark.createDataFrame([tuple(totals.values())], ", ".join(f"{k} long" for k in totals))
