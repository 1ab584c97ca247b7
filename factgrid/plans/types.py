"""Checks over ingested type facts: type_site(file, node_id, kind, start, end, name, type_id, function_id, symbol), type_node(type_id,
flags, array_like, is_error), type_child(type_id, child, edge), index_info(type_id, value_type_id)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, nesting

BROAD = ("any", "unknown")
OPEN = ("any", "unknown", "object")
#: Edges through which a broad member makes the whole broad.
THROUGH = ("union", "array", "promise")


@dataclass
class Types:
    sites: DataFrame
    nodes: DataFrame
    children: DataFrame
    indexes: DataFrame

    @cached_property
    def broad(self) -> DataFrame:
        """(type_id, broad): types that are, or contain by union or container, any or unknown. Error types never are."""
        good = self.nodes.where("not is_error")
        edges = self.children.where(F.col("edge").isin(*THROUGH)).select(F.col("child").alias("a"), F.col("type_id").alias("b"))
        front = met = good.where(F.col("flags").isin(*BROAD)).select(F.col("type_id").alias("a")).distinct()
        while True:  # ends, as each round marks types that had no mark
            front = graph.cut(front.join(edges, "a").select(F.col("b").alias("a")).distinct().join(met, "a", "left_anti"))
            if front.isEmpty():
                break
            met = graph.cut(met.unionByName(front))
        return met.select(F.col("a").alias("type_id")).join(good.select("type_id"), "type_id", "left_semi")

    @cached_property
    def direct(self) -> DataFrame:
        return self.nodes.where(F.col("flags").isin(*OPEN) & ~F.col("is_error")).select("type_id", "flags")

    @cached_property
    def dictionaries(self) -> DataFrame:
        """Open-key object types: an index signature, and not like an array."""
        return self.indexes.join(self.nodes.where("not array_like").select("type_id"), "type_id", "left_semi")

    @cached_property
    def opaque(self) -> DataFrame:
        return self.dictionaries.join(self.direct.select(F.col("type_id").alias("value_type_id")), "value_type_id", "left_semi").select("type_id").distinct()


def _found(rows: DataFrame, check: str, message: str) -> DataFrame:
    return rows.select(F.lit(check).alias("rule"), F.lit("error").alias("severity"), "file", "start", F.lit(message).alias("message"))


def no_broad_parameters(t: Types) -> DataFrame:
    sites = t.sites.where("kind = 'parameter' and name <> 'this' and not coalesce(guard_subject, false)")
    broad = sites.where("name <> 'cause'").join(t.broad, "type_id", "left_semi").unionByName(sites.join(t.direct.where("flags = 'object'"), "type_id", "left_semi"))
    return _found(broad.dropDuplicates(["file", "node_id"]), "types/no-broad-parameters", "a parameter that takes anything")


def no_unknown_returns(t: Types) -> DataFrame:
    return _found(t.sites.where("kind = 'return'").join(t.broad, "type_id", "left_semi"), "types/no-unknown-returns", "the declared result says nothing")


def no_unknown_type_aliases(t: Types) -> DataFrame:
    return _found(t.sites.where("kind = 'alias'").join(t.broad, "type_id", "left_semi"), "types/no-unknown-type-aliases", "an alias of anything")


def no_runtime_typeof(t: Types) -> DataFrame:
    return _found(t.sites.where("kind = 'typeof' and not coalesce(in_guard, false)").join(t.direct, "type_id", "left_semi"), "types/no-runtime-typeof", "typeof of an unchecked value")


def no_opaque_record(t: Types) -> DataFrame:
    """Outermost sites only."""
    sites = t.sites.where("kind = 'type_reference' and not coalesce(declared_here, false)").join(t.opaque, "type_id", "left_semi")
    outermost = nesting.around(sites, sites.select("file", "node_id", "start", "end"), ["file"]).where("depth = 0").select(sites.columns)
    return _found(outermost, "types/no-opaque-record", "a dictionary of anything")


def no_known_value_widening(t: Types) -> DataFrame:
    wide = t.direct.select("type_id").union(t.dictionaries.select("type_id")).distinct()
    return _found(t.sites.where("kind = 'annotated_literal' and not coalesce(empty, false)").join(wide, "type_id", "left_semi"), "types/no-known-value-widening", "a known value under a wider annotation")


def no_widen_then_assert(t: Types) -> DataFrame:
    wide = t.sites.where("kind = 'const_declaration'").join(t.direct.select("type_id"), "type_id", "left_semi").select("file", "symbol", "function_id")
    return _found(t.sites.where("kind = 'assertion'").join(wide, ["file", "symbol", "function_id"], "left_semi"), "types/no-widen-then-assert", "widened, then asserted back")


CHECKS = {f"types/{f.__name__.replace('_', '-')}": f for f in (no_broad_parameters, no_known_value_widening, no_opaque_record, no_runtime_typeof, no_unknown_returns, no_unknown_type_aliases, no_widen_then_assert)}
SITE = "file string, node_id long, kind string, start int, end int, name string, type_id long, function_id long, symbol string, guard_subject boolean, in_guard boolean, declared_here boolean, empty boolean"
