"""Facts read from JSON: visibility grants and document budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grants(body: Column) -> Column:
    """The grants of a visibility file as a map from importer to reason, null unless it is an object of non-blank strings."""
    parsed = F.try_parse_json(body)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    entries = F.when(is_object, F.try_variant_get(parsed, "$", "map<string,variant>"))
    text_only = F.forall(F.map_values(entries), lambda x: F.schema_of_variant(x) == "STRING")
    strings = F.when(is_object & text_only, F.try_variant_get(parsed, "$", "map<string,string>"))
    return F.when(F.forall(F.map_values(strings), lambda s: F.trim(s) != ""), strings)


def budgets(manifests: DataFrame) -> DataFrame:
    """(manifest, path, ceiling as written) of manifests (file, text): JSON objects of paths and ceilings. One that isn't such an
    object has a single row without a path, so that it can't pass for an empty one."""
    parsed = F.try_parse_json("text")
    entries = F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.try_variant_get(parsed, "$", "map<string,variant>"))
    rows = manifests.select(F.col("file").alias("manifest"), F.explode_outer(F.when(entries.isNull(), F.map_from_arrays(F.array(F.lit("")), F.array(parsed))).otherwise(entries)).alias("path", "value"))
    return rows.where("path is not null").select("manifest", F.when(F.col("path") != "", F.col("path")).alias("path"), F.to_json("value").alias("ceiling"))


def scale(modules: DataFrame, key: str) -> DataFrame:
    """(name, value) of the scale `key` in theme modules (file, text): the literal entries of the first object under that name."""
    body = F.regexp_extract("text", rf"\b{key}\s*[:=]\s*\{{([^}}]*)\}}", 1)
    entries = F.regexp_extract_all(body, F.lit("""["']?[A-Za-z0-9_$-]+["']?\\s*:\\s*["'][^"']*["']"""), F.lit(0))
    return modules.select(F.explode(entries).alias("e")).select(F.regexp_extract("e", """^["']?([A-Za-z0-9_$-]+)""", 1).alias("name"), F.regexp_extract("e", """:\\s*["']([^"']*)""", 1).alias("value"))


def grant_state(body: Column) -> Column:
    """absent without a file, malformed unless all is well, else grants."""
    return F.when(body.isNull(), "absent").when(grants(body).isNull(), "malformed").otherwise("grants")
