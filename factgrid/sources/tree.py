"""Source trees as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.paths import SOURCE_EXTENSIONS, Tree, Vocabulary
from ..operators.joins import longest_prefix


def read_files(spark: SparkSession, base: str, glob: str = "*") -> DataFrame:
    """(file, text) of all files below base that fit the glob, the path relative to base. Fails if there are none: an unread
    input must not look like a clean one. Hadoop's listing follows links; keep linked folders out of base."""
    raw = spark.read.text(base, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select("_metadata.file_path", F.col("value").alias("text"))
    if raw.isEmpty():
        raise ValueError(f"no file below {base} fits {glob}")
    root = base.rstrip("/").removeprefix("file://").lstrip("/")
    return raw.select(F.regexp_replace(F.url_decode("file_path"), f"^[a-z0-9]+:/+(?:[^/]+(?=/{root}))?\\Q{root}\\E/", "").alias("file"), "text")


def source_files(files: DataFrame, trees: list[Tree]) -> DataFrame:
    """Files of the declared trees: tree_root, file, source_path, text, is_test, is_unauthored, is_exempt; the longest root wins.

    All trees must share one vocabulary per call; run trees with different vocabularies one after another.
    """
    if len({t.vocabulary for t in trees}) != 1:
        raise ValueError("give trees of one vocabulary at a time, and one at least")
    v = trees[0].vocabulary
    roots = files.sparkSession.createDataFrame([(t.root,) for t in trees], "tree_root string")
    script = files.where(F.col("file").rlike("\\.(?:" + "|".join(SOURCE_EXTENSIONS) + ")$"))
    owned = longest_prefix(script, "file", roots, "tree_root").where("tree_root is not null")
    path = F.substring(F.col("file"), F.length("tree_root") + 2, F.length("file"))
    owned = owned.withColumn("source_path", path)
    return owned.select("tree_root", "file", "source_path", "text", paths.is_test(F.col("source_path")).alias("is_test"), paths.is_unauthored(F.col("source_path"), v).alias("is_unauthored"), paths.is_exempt(F.col("source_path"), v).alias("is_exempt"))


#: Endings that a specifier without one may stand for, in order of preference.
ENDINGS = tuple(f".{e}" for e in SOURCE_EXTENSIONS) + tuple(f"/index.{e}" for e in SOURCE_EXTENSIONS)


def import_edges(sources: DataFrame, imports: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:
    """Imports with where they lead: target_path in the tree, or package. Assets and paths out of the tree have neither.

    Relative and aliased specifiers of one module are one target: candidate spellings are joined with the files by equality
    and the first in the order of ENDINGS is taken; where none is a file the spelled path stays.
    """
    own = imports.join(sources.select("file", "tree_root", "source_path"), "file")
    spec = F.regexp_replace("specifier", "\\?.*$", "")
    relative = spec.rlike("^\\.\\.?(?:/|$)")
    folder = F.regexp_replace("source_path", "[^/]*$", "")
    claimed = F.when(relative, paths.normalized(F.concat(folder, spec))).when(spec.startswith(v.alias), paths.normalized(F.substring(spec, len(v.alias) + 1, 1 << 20)))
    own = own.withColumns({"relative": relative, "claimed": F.when(~paths.is_asset(F.col("specifier"), v), claimed)})
    package = F.when(~relative & ~spec.startswith(v.alias) & ~spec.startswith("/"), paths.package_of(spec))
    bare = F.regexp_replace("claimed", "\\.([cm]?)js(x?)$", "")
    options = F.concat(F.array("claimed"), *[F.array(F.concat(bare, F.lit(e))) for e in ENDINGS], *[F.array(F.concat("claimed", F.lit(e))) for e in ENDINGS])
    spelled = own.where("claimed is not null").select("tree_root", "claimed", F.posexplode(options).alias("rank", "source_path")).distinct()
    found = spelled.join(sources.select("tree_root", "source_path"), ["tree_root", "source_path"]).groupBy("tree_root", "claimed").agg(F.min_by("source_path", "rank").alias("resolved"))
    return own.join(found, ["tree_root", "claimed"], "left").select("tree_root", "file", "source_path", "offset", "line", "specifier", "relative", F.coalesce("resolved", "claimed").alias("target_path"), F.col("resolved").isNotNull().alias("is_file"), package.alias("package"), "type_only")
