"""Runs checks over trees and gathers one table of findings."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scan
from ..operators import asof
from ..operators.graph import cut
from . import perfile, types
from .structural import CHECKS, FINDING, Facts

RUN = f"check string, tree string, check_order int, tree_order int, crashed boolean, {FINDING}"


def run_checks(trees: dict, checks: dict[str, Callable] | None = None) -> DataFrame:
    """Findings of all checks on all trees (Facts, or Projects where the checks take those) in their order: RUN. A check that raises is a row with crashed true and the reason, so
    a crash never looks like a clean tree. Each check's findings are checkpointed, not collected."""
    chosen = CHECKS if checks is None else checks
    if not trees or not chosen:
        raise ValueError("no trees or no checks")
    spark = next(iter(trees.values())).sources.sparkSession
    parts = []
    for i, (name, check) in enumerate(chosen.items()):
        for j, (root, facts) in enumerate(trees.items()):
            tag = [F.lit(name).alias("check"), F.lit(root).alias("tree"), F.lit(i).alias("check_order"), F.lit(j).alias("tree_order"), F.lit(False).alias("crashed")]
            try:
                parts.append(cut(check(facts).select(*tag, "severity", "file", "line", "message")))
            except Exception as e:  # noqa: BLE001  a broken check must not hide the others
                said = str(e).splitlines()[0] if str(e) else type(e).__name__
                parts.append(spark.createDataFrame([(name, root, i, j, True, "error", None, None, said)], RUN))
    return functools.reduce(DataFrame.unionByName, parts)


@dataclass
class Project:
    """What the rules read: facts of whole trees, syntax nodes, and type facts; rules whose facts are missing fail as such."""

    facts: Facts
    syntax: perfile.Syntax | None = None
    types: types.Types | None = None

    @property
    def sources(self) -> DataFrame:
        return self.facts.sources


def _lined(rows: DataFrame, p: Project) -> DataFrame:
    """Findings of places as findings of lines: each place meets the line that starts at it or before."""
    lines = scan.line_starts(p.sources, ["file"], "text")
    found = asof.asof_join(rows.select("severity", "file", "start", "message"), lines, "start", "line_start", ["line"], by=["file"], block_rows=None)
    return found.select("severity", "file", F.col("line").cast("int").alias("line"), "message")


def _per_file(name: str) -> Callable[[Project], DataFrame]:
    def run(p: Project) -> DataFrame:
        if p.syntax is None:
            raise ValueError("no syntax facts")
        return _lined(perfile.run(p.syntax, [name]), p)

    return run


def _typed(name: str) -> Callable[[Project], DataFrame]:
    def run(p: Project) -> DataFrame:
        if p.types is None:
            raise ValueError("no type facts")
        return _lined(types.CHECKS[name](p.types), p)

    return run


def _whole(name: str) -> Callable[[Project], DataFrame]:
    return lambda p: CHECKS[name](p.facts)


#: All rules in their order: whole trees, types, then files. Of the two of one name that of files has its kind in brackets.
ALL: dict[str, Callable[[Project], DataFrame]] = {n: _whole(n) for n in CHECKS} | {n: _typed(n) for n in types.CHECKS} | {f"{n} (file)" if n in CHECKS else n: _per_file(n) for n in perfile.RULES}


def run_all(projects: dict[str, Project]) -> DataFrame:
    """Findings of all rules on all trees: RUN."""
    return run_checks(projects, ALL)


def merged(runs: list[DataFrame]) -> DataFrame:
    """Several runs as one: a check of the same id in several is one check, in the place where it first comes."""
    both = None
    for i, r in enumerate(runs):
        r = r.withColumn("__run", F.lit(i))
        both = r if both is None else both.unionByName(r)
    first = both.groupBy("check").agg(F.min(F.struct("__run", "check_order")).alias("first"))
    order = first.select("check", F.row_number().over(Window.orderBy("first")).alias("__order"))  # one row a check
    return both.join(F.broadcast(order), "check").select("check", "tree", (F.col("__order") - 1).cast("int").alias("check_order"), *[c for c in runs[0].columns if c not in ("check", "tree", "check_order")])


def staged(findings: DataFrame, files: DataFrame | None) -> DataFrame:
    """Errors, and warnings about staged files; all where no list is given."""
    if files is None:
        return findings
    kept = findings.where("severity = 'warning'").join(files.select("file").distinct(), "file", "left_semi")
    return findings.where("severity <> 'warning'").unionByName(kept.select(findings.columns))


def totals(findings: DataFrame) -> DataFrame:
    """One row: errors, warnings, crashed, and the exit status."""
    out = findings.agg(F.count_if(F.expr("severity = 'error' and not crashed")).alias("errors"), F.count_if(F.expr("severity = 'warning'")).alias("warnings"), F.count_if("crashed").alias("crashed"))
    return out.withColumn("status", F.when((F.col("errors") > 0) | (F.col("crashed") > 0), 1).otherwise(0))


def report(findings: DataFrame) -> DataFrame:
    """The lines of a report in order of checks, trees, files (by UTF-16 code units) and lines."""
    place = F.concat_ws(":", "file", F.col("line").cast("string"))
    line = F.concat(F.when(F.col("severity") == "error", "FAIL").otherwise("WARN"), F.lit(" ["), F.col("check"), F.lit("] "), F.coalesce(place, F.lit("")), F.lit(" "), F.col("message"))
    return findings.orderBy("check_order", "tree_order", F.encode("file", "UTF-16BE").asc_nulls_last(), F.col("line").asc_nulls_first(), "message").select(line.alias("line"))
