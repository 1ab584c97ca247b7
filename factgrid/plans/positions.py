"""Queries about places in texts and times: as-of joins and ranges within ranges over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scan
from ..operators import asof, intervals
from .catalogue import _table, query


def _micros(name: str) -> Column:
    """Microseconds since 1970; times without a zone are taken in the session's."""
    return F.unix_micros(F.col(name).cast("timestamp"))


@query("T", r"""
WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[ \t\n]+|[^ \t\n]+')) AS found, generate_subscripts(regexp_extract_all(text, '[ \t\n]+|[^ \t\n]+'), 1) AS i FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, found, CAST(coalesce(sum(length(found)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM p),
b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS row, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, line, CAST(coalesce(sum(length(row) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_start FROM b)
SELECT w.doc_id, found AS word, line, start - line_start + 1 AS place FROM w ASOF JOIN l ON w.doc_id = l.doc_id AND w.start >= l.line_start WHERE NOT regexp_matches(found, '^[ \t\n]')""")
def word_places(spark, sf_dir):
    """Every word of every document with its line and its place in the line: words and line starts meet as of their offsets."""
    docs = _table(spark, sf_dir, "documents")
    words = scan.matches(docs, ["doc_id"], "text", r"[^ \t\n]+").select("doc_id", "start", F.col("found").alias("word"))
    placed = asof.asof_join(words, scan.line_starts(docs, ["doc_id"], "text"), "start", "line_start", ["line", "line_start"], by=["doc_id"], block_rows=None)  # a key is one text, which a task holds whole anyway
    return placed.select("doc_id", "word", "line", (F.col("start") - F.col("line_start") + 1).alias("place"))


@query("T", """
WITH p AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)
SELECT e.event_id, p.event_id AS purchase_id, p.value AS purchase_value, epoch_us(e.ts) - epoch_us(p.ts) AS micros FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts > p.ts""")
def last_purchase(spark, sf_dir):
    """Each other event with the purchase of its user before it, and the time since then."""
    events = _table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("purchase_id"), F.col("value").alias("purchase_value"))
    found = asof.asof_join(events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), bought, "ts", "at", ["purchase_id", "purchase_value", "at"], by=["user_id"], tie=["purchase_id"], strict=True)
    return found.select("event_id", "purchase_id", "purchase_value", (_micros("ts") - _micros("at")).alias("micros"))


@query("T", """
WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS t FROM events), o AS (SELECT event_id AS purchase_id, t FROM e WHERE event_type = 'purchase')
SELECT purchase_id, count(*) AS n, min(event_id) AS first_event, max(e.t) - min(e.t) AS spread FROM e JOIN o ON e.t >= o.t - 300000000 AND e.t + 60000000 <= o.t + 300000000 GROUP BY purchase_id""")
def purchase_surroundings(spark, sf_dir):
    """Events (a minute each) within five minutes around a purchase, whoever's they are: ranges in ranges, without a key."""
    events = _table(spark, sf_dir, "events").select("event_id", "event_type", _micros("ts").alias("t"))
    outer = events.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), (F.col("t") - 300_000_000).alias("outer_start"), (F.col("t") + 300_000_000).alias("outer_end"))
    inner = events.select("event_id", F.col("t").alias("start"), (F.col("t") + 60_000_000).alias("end"))
    pairs = intervals.contained(inner, outer)
    return pairs.groupBy("purchase_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), (F.max("start") - F.min("start")).alias("spread"))
