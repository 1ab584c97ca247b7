"""The import policy as a table, and its evaluation as one function over columns that all callers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.paths import Vocabulary

#: What each profile may import from each area: any file, nothing (deny), its barrel, or its barrel and its ui folder.
MATRIX = {
    "route": {
        "route": "any",
        "feature": "barrel-or-ui",
        "domain": "deny",
        "infrastructure": "any",
        "shared": "any",
        "shared-ui": "any",
        "env-server": "deny",
        "env-client": "any",
        "source-root": "deny",
        "package": "any",
    },
    "feature-barrel": {
        "route": "deny",
        "feature": "deny",
        "domain": "deny",
        "infrastructure": "deny",
        "shared": "deny",
        "shared-ui": "deny",
        "env-server": "deny",
        "env-client": "deny",
        "source-root": "deny",
        "package": "deny",
    },
    "feature-root": {
        "route": "deny",
        "feature": "barrel",
        "domain": "barrel",
        "infrastructure": "deny",
        "shared": "any",
        "shared-ui": "deny",
        "env-server": "deny",
        "env-client": "deny",
        "source-root": "deny",
        "package": "any",
    },
    "feature-ui": {
        "route": "deny",
        "feature": "barrel",
        "domain": "deny",
        "infrastructure": "any",
        "shared": "any",
        "shared-ui": "any",
        "env-server": "deny",
        "env-client": "any",
        "source-root": "deny",
        "package": "any",
    },
    "feature-controllers": {
        "route": "deny",
        "feature": "barrel",
        "domain": "barrel",
        "infrastructure": "any",
        "shared": "any",
        "shared-ui": "deny",
        "env-server": "any",
        "env-client": "any",
        "source-root": "deny",
        "package": "any",
    },
    "feature-service": {
        "route": "deny",
        "feature": "barrel",
        "domain": "barrel",
        "infrastructure": "deny",
        "shared": "any",
        "shared-ui": "deny",
        "env-server": "deny",
        "env-client": "deny",
        "source-root": "deny",
        "package": "any",
    },
    "feature-repo": {
        "route": "deny",
        "feature": "deny",
        "domain": "deny",
        "infrastructure": "any",
        "shared": "any",
        "shared-ui": "deny",
        "env-server": "deny",
        "env-client": "deny",
        "source-root": "deny",
        "package": "any",
    },
    "domain": {
        "route": "deny",
        "feature": "deny",
        "domain": "barrel",
        "infrastructure": "deny",
        "shared": "any",
        "shared-ui": "deny",
        "env-server": "deny",
        "env-client": "deny",
        "source-root": "deny",
        "package": "any",
    },
    "infrastructure": {
        "route": "deny",
        "feature": "deny",
        "domain": "deny",
        "infrastructure": "any",
        "shared": "any",
        "shared-ui": "deny",
        "env-server": "any",
        "env-client": "any",
        "source-root": "deny",
        "package": "any",
    },
    "shared": {
        "route": "deny",
        "feature": "deny",
        "domain": "deny",
        "infrastructure": "deny",
        "shared": "any",
        "shared-ui": "deny",
        "env-server": "deny",
        "env-client": "any",
        "source-root": "deny",
        "package": "any",
    },
    "shared-ui": {
        "route": "deny",
        "feature": "deny",
        "domain": "deny",
        "infrastructure": "deny",
        "shared": "any",
        "shared-ui": "any",
        "env-server": "deny",
        "env-client": "any",
        "source-root": "deny",
        "package": "any",
    },
    "source-root": {
        "route": "any",
        "feature": "deny",
        "domain": "deny",
        "infrastructure": "any",
        "shared": "any",
        "shared-ui": "any",
        "env-server": "any",
        "env-client": "any",
        "source-root": "any",
        "package": "any",
    },
}
#: Packages that only their owners import.
OWNERS = {"stripe": "infrastructure/payments", "better-auth": "infrastructure/auth", "@sentry/node": "infrastructure/monitoring", "@loops-so/loops-js": "infrastructure/email", "posthog-node": "infrastructure/analytics"}
#: Areas that a domain may import at run time.
PURE = ("domain", "shared")

ROWS = [(profile, area, surface) for profile, row in MATRIX.items() for area, surface in row.items()]


def policy_table(spark: SparkSession) -> DataFrame:
    """120 rows: profile, area, surface."""
    return spark.createDataFrame(ROWS, "profile string, area string, surface string")


def admits(surface: Column, unit: Column, path: Column, v: Vocabulary = Vocabulary()) -> Column:
    bare = paths.stem(path)
    barrel = bare.isin("") | (bare == unit) | (bare == F.concat_ws("/", unit, F.lit(v.client_barrel))) | (bare == F.concat_ws("/", unit, F.lit(v.server_barrel)))
    return (surface == "any") | (surface.isin("barrel", "barrel-or-ui") & barrel) | ((surface == "barrel-or-ui") & paths.under(bare, F.concat_ws("/", unit, F.lit(dict(v.layers)["ui"]))))


def verdicts(edges: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:
    """edges (source_path, target_path or package, type_only) with profile, area, surface and verdict.

    The first of these that holds: unclassified-source, unclassified-target, internal (the same unit), impure-domain (a domain's
    run-time import from beyond domains and shared code), denied-direction, denied-exposure, allowed.
    """
    policy = policy_table(edges.sparkSession)
    target = F.col("target_path")
    known = edges.withColumns({
        "profile": paths.profile(F.col("source_path"), v),
        "source_unit": paths.unit(F.col("source_path"), v),
        "area": F.when(F.col("package").isNotNull(), "package").otherwise(paths.area(target, v)),
        "unit": F.coalesce("package", paths.unit(target, v)),
    })
    looked = known.join(F.broadcast(policy), ["profile", "area"], "left")  # 120 rows
    verdict = (
        F.when(F.col("profile").isNull(), "unclassified-source")
        .when(F.col("area").isNull(), "unclassified-target")
        .when(F.col("package").isNull() & (F.col("unit") == F.col("source_unit")), "internal")
        .when((F.col("profile") == "domain") & ~F.col("type_only") & ~F.col("area").isin(*PURE), "impure-domain")
        .when(F.col("surface") == "deny", "denied-direction")
        .when(~F.coalesce(admits(F.col("surface"), F.col("unit"), F.coalesce(target, F.col("package")), v), F.lit(False)), "denied-exposure")
        .otherwise("allowed")
    )
    return looked.withColumn("verdict", verdict)
