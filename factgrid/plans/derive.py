"""Attributes of syntax nodes that rules read, derived from the bare nodes of a parser and from the references of its scopes.

Bare nodes: ast_node as in perfile.NODE with what the parser itself says: types, roles (object, callee, tag, expression,
argument, init, id, element, key, declaration, body, ...), names of identifiers and of static member keys, and places. Scopes:
scope_ref(file, node_id, resolved): whether an identifier refers to a declaration of its file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph, nesting

#: Nodes that stand for the expression within them.
TRANSPARENT = ("TSAsExpression", "TSNonNullExpression", "TSSatisfiesExpression", "ParenthesizedExpression", "ChainExpression")
FUNCTIONS = ("FunctionDeclaration", "FunctionExpression", "ArrowFunctionExpression", "BlockStatement", "ClassBody")
PLACE = ["file", "node_id"]


def spines(nodes: DataFrame) -> DataFrame:
    """(file, node_id, chain, pure, root): the names along what an expression is read or called from, first to last, for names,
    members, calls and what wraps them; pure without a call; root is the node of the first name.

    Each round takes the spines one node up; the rounds end when no node got one, after the longest chain.
    """
    parents = nodes.select("file", F.col("node_id").alias("parent_id"), F.col("type").alias("above"), F.col("name").alias("key"))
    up = nodes.select("file", "node_id", "parent_id", "role").join(parents, ["file", "parent_id"])
    member = (F.col("role") == "object") & (F.col("above") == "MemberExpression") & F.col("key").isNotNull()
    call = F.col("role").isin("callee", "tag") & F.col("above").isin("CallExpression", "NewExpression", "TaggedTemplateExpression")
    wrap = F.col("role").isin("expression", "argument") & (F.col("above").isin(*TRANSPARENT) | (F.col("above") == "AwaitExpression"))
    up = graph.cut(up.where(member | call | wrap).select(*PLACE, "parent_id", F.when(member, F.array("key")).otherwise(F.array().cast("array<string>")).alias("more"), (member | F.col("above").isin(*TRANSPARENT)).alias("keeps")))
    front = graph.cut(nodes.where("type in ('Identifier', 'ThisExpression', 'MetaProperty') and coalesce(role, '') <> 'property'").select(*PLACE, F.array(F.coalesce("name", F.lit("this"))).alias("chain"), F.lit(True).alias("pure"), F.col("node_id").alias("root")))
    found = front
    while True:  # ends, as a node has one parent and a tree no rings
        front = graph.cut(front.join(up, PLACE).select("file", F.col("parent_id").alias("node_id"), F.concat("chain", "more").alias("chain"), (F.col("pure") & F.col("keeps")).alias("pure"), "root"))
        if front.isEmpty():
            return found
        found = found.unionByName(front)


def callees(nodes: DataFrame, spine: DataFrame) -> DataFrame:
    """(file, node_id, callee, chain): what a call calls, as a dotted path where it is one, and all names of its chain."""
    called = nodes.where("role in ('callee', 'tag')").select("file", "node_id", F.col("parent_id").alias("call"))
    own = called.join(spine, PLACE)
    return own.select("file", F.col("call").alias("node_id"), F.when(F.col("pure"), F.array_join("chain", ".")).alias("callee"), F.array_join("chain", ",").alias("chain"), "root")


def statement_gaps(nodes: DataFrame) -> DataFrame:
    """(file, node_id, statement_gap): for each assertion where the gap before its statement starts: the end of the statement
    before it among those of one parent, else the parent's start. The statement is the innermost around the assertion."""
    statements = nodes.where(F.col("type").rlike("(?:Statement|Declaration)$") & (F.col("type") != "BlockStatement"))
    order = Window.partitionBy("file", "parent_id").orderBy("start")
    parents = nodes.select("file", F.col("node_id").alias("parent_id"), F.col("start").alias("parent_start"))
    gaps = statements.join(parents, ["file", "parent_id"], "left").select("file", "node_id", "start", "end", F.coalesce(F.lag("end").over(order), "parent_start", F.lit(0)).alias("gap"))
    casts = nodes.where("type = 'TSAsExpression'").select("file", "node_id", "start", "end")
    inside = nesting.around(casts, gaps, ["file"], carry=["gap"]).where("depth > 0")
    return inside.select(*PLACE, F.col("outer_gap").alias("statement_gap"))


def states(nodes: DataFrame, callee: DataFrame) -> DataFrame:
    """(file, node_id, init, setter): declarators whose value is a call, what is called, and the second name of their pattern."""
    init = nodes.where("role = 'init'").select(*PLACE, F.col("parent_id").alias("declarator")).join(callee.select(*PLACE, "callee"), PLACE)
    init = init.select("file", F.col("declarator").alias("node_id"), F.element_at(F.split("callee", "[.]"), -1).alias("init"))
    pattern = nodes.where("type = 'ArrayPattern' and role = 'id'").select("file", F.col("node_id").alias("pattern"), F.col("parent_id").alias("declarator"))
    element = Window.partitionBy("file", "parent_id").orderBy("start")
    names = nodes.where("role = 'element'").withColumn("n", F.row_number().over(element)).where("n = 2").select("file", F.col("parent_id").alias("pattern"), F.col("name").alias("setter"))
    return init.join(pattern.join(names, ["file", "pattern"]).select("file", F.col("declarator").alias("node_id"), "setter"), PLACE, "left")


def _within_some(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """(file, node_id) of nodes that lie in some node of outer."""
    place = ["file", "node_id", "start", "end"]
    return nesting.around(nodes.select(place), outer.select(place), ["file"]).where("depth > 0").select(*PLACE).distinct()


def derived(nodes: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """The nodes with the derived attributes added: callee, chain and path, shadowed, init and setter, statement_gap,
    module_level, exported, empty and keys. What a node has already stays. Calls without a name take that of their callee."""
    nodes = graph.cut(nodes)
    spine = spines(nodes)
    callee = callees(nodes, spine)
    own = spine.where("pure").join(nodes.where("type = 'MemberExpression' or type = 'Identifier'").select(*PLACE), PLACE)
    path = own.select(*PLACE, F.array_join("chain", ".").alias("path"), F.col("root").alias("path_root"))
    roots = (spine if scopes is None else scopes.where("resolved")).select("file", F.col("node_id").alias("root")).distinct()
    shadowed = callee.select(*PLACE, "root").unionByName(path.select(*PLACE, F.col("path_root").alias("root"))).distinct()
    shadowed = shadowed.join(roots, ["file", "root"], "left_semi" if scopes is not None else "left_anti").select(*PLACE, F.lit("true").alias("shadowed")).distinct()
    loose = nodes.where("type in ('VariableDeclarator', 'FunctionDeclaration', 'ClassDeclaration')")
    level = loose.join(_within_some(loose, nodes.where(F.col("type").isin(*FUNCTIONS))), PLACE, "left_anti").select(*PLACE, F.lit("true").alias("module_level"))
    exports = nodes.where("type in ('ExportNamedDeclaration', 'ExportDefaultDeclaration')").select("file", F.col("node_id").alias("parent_id"))
    exported = nodes.where("role = 'declaration'").join(exports, ["file", "parent_id"], "left_semi").select(*PLACE, F.lit("true").alias("exported"))
    objects = nodes.where("type in ('ObjectExpression', 'ObjectPattern')").select(*PLACE, "type")
    held = nodes.where("type in ('Property', 'SpreadElement', 'RestElement')").select("file", F.col("parent_id").alias("node_id"), "name").groupBy(*PLACE).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("keys"), F.count(F.lit(1)).alias("parts"))
    objects = objects.join(held, PLACE, "left").select(*PLACE, "keys", F.when((F.col("type") == "ObjectExpression") & F.col("parts").isNull(), "true").alias("empty"))
    out = nodes
    tables = [callee.select(*PLACE, "callee", "chain"), path.select(*PLACE, "path"), shadowed, states(nodes, callee), statement_gaps(nodes), level, exported, objects]
    added = []
    for t in tables:
        added += [c for c in t.columns if c not in PLACE]
        out = out.join(t.dropDuplicates(PLACE), PLACE, "left")
    entries = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in added]), lambda e: e["value"].isNotNull())
    old = F.coalesce("attrs", F.create_map().cast("map<string,string>"))
    new = F.filter(entries, lambda e: ~F.map_contains_key(old, e["key"]))
    name = F.coalesce("name", F.when(F.col("type").isin("CallExpression", "NewExpression"), F.element_at(F.split("chain", ","), -1)))
    return out.withColumn("attrs", F.map_concat(old, F.map_from_entries(new))).withColumn("name", name).select(*nodes.columns)
