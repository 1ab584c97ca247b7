"""The queries of the corpus operators, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, infill, jaccard, language, licenses, phrases, quality, records, secrets, sharding, urls
from .common import fresh_path, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded")
    return bpe.digests(encoded)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality.judge(docs, quality.fit_references(docs))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "records")
    records.write_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    records.write_index(spark, path, f"{path}-index")
    return records.digests(spark, path, f"{path}-index")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digests(secrets.find_secrets(docs, words=secrets.learn_words(docs)))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the labels whose doc_id is the page's id: good if of quality 1 and not toxic."""
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).when(F.col("quality").isNotNull(), 0)
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), good.alias("good"))
    judged = urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes, urls.RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "n_outcomes", "n_good")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out())
    profiles = language.learn_profiles(docs.where(~F.col("held_out")))
    return language.identify(docs.drop("lang"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one more whose texts hold control strings."""
    tokenizer, odd = public_tokenizers.path("byte_bpe_50k.json"), "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.read_back(chat.format_conversations(conversations, tokenizer), tokenizer))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language, from the counts of all documents."""
    return phrases.top_phrases(table(spark, sf_dir, "documents").select("text", "lang"), first=2000)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cut and rearranged; 90 of 100 are rearranged, 20 of 100 of these with the suffix first."""
    return infill.digests(infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_byte_bpe, op3_license_scan, op4_quality_rules, op5_decontamination, op6_token_records, op7_jaccard_join, op8_secret_scan, op9_url_filter, op10_language_id, op11_chat_format, op12_collocations, op13_fill_in_middle)}
ORACLE_SQL: dict[str, str] = {"op7_jaccard_join": jaccard.ORACLE, "op9_url_filter": urls.ORACLE, "op11_chat_format": chat.oracle(), "op12_collocations": phrases.ORACLE, "op13_fill_in_middle": infill.ORACLE}
