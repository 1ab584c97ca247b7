"""Rules that look at one file at a time. Those about imports read the native import scan; those about syntax read ingested
nodes: ast_node(file, node_id, parent_id, role, type, start, end, name, attrs map<string,string>). What a rule needs of
ancestors or descendants is a range join on the file. Findings: rule, file, start (or line), message.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.paths import Vocabulary
from ..operators import graph, lattice, nesting
from . import policy
from .structural import Facts

NODE = "file string, node_id long, parent_id long, role string, type string, start int, end int, name string, attrs map<string,string>"


@dataclass
class Syntax:
    """Tables of one run. Every tracked file must have nodes: covered() fails otherwise."""

    facts: Facts
    nodes: DataFrame | None = None
    comments: DataFrame | None = None  # file, start, end, text
    limits: dict[str, int] = field(default_factory=lambda: {"hooks": 7, "props": 8, "ternary": 2})

    @property
    def vocabulary(self) -> Vocabulary:
        return self.facts.vocabulary

    @cached_property
    def sources(self) -> DataFrame:
        """Import occurrences with the importing file's role and the target's area."""
        v = self.vocabulary
        s, t = F.col("source_path"), F.col("target_path")
        return self.facts.resolved.withColumns({"profile": paths.profile(s, v), "area": F.when(F.col("package").isNotNull(), "package").otherwise(paths.area(t, v)), "target_stem": paths.stem(t), "server": paths.is_server_context(s, v)})

    @cached_property
    def ast(self) -> DataFrame:
        live = self.facts.live.select("file", "source_path")
        return self.nodes.join(live, "file")

    def covered(self) -> None:
        """Fails if a file of the tree has no syntax nodes: silence about it would look like a clean result."""
        missing = [r["file"] for r in self.facts.live.select("file").join(self.nodes.select("file").distinct(), "file", "left_anti").orderBy("file").limit(5).collect()]
        if missing:
            raise ValueError(f"no syntax nodes for {', '.join(missing)}")


Rule = Callable[[Syntax], DataFrame]
RULES: dict[str, Rule] = {}
WARNINGS = ("react/hook-count", "react/prop-count", "react/single-component-export", "types/no-conditional-empty-object-spread")


def rule(name: str) -> Callable[[Rule], Rule]:
    def add(f: Rule) -> Rule:
        RULES[name] = f
        return f

    return add


def found(rows: DataFrame, message: str | Column) -> DataFrame:
    return rows.select("file", F.col("start").cast("int").alias("start"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def _import(rows: DataFrame, message: str | Column) -> DataFrame:
    return found(rows.withColumn("start", F.col("offset")), message)


# About imports.


@rule("api/barrel-direction")
def barrel_direction(s: Syntax) -> DataFrame:
    v = s.vocabulary
    client = paths.is_barrel(F.col("source_path"), v) & paths.stem(F.col("source_path")).endswith("/" + v.client_barrel)
    return _import(s.sources.where(client & F.col("target_stem").endswith("/" + v.server_barrel)), "a client barrel names a server barrel")


@rule("api/server-import-context")
def server_import_context(s: Syntax) -> DataFrame:
    v = s.vocabulary
    client = paths.is_barrel(F.col("source_path"), v) & paths.stem(F.col("source_path")).endswith("/" + v.client_barrel)
    return _import(s.sources.where(F.col("target_stem").endswith("/" + v.server_barrel) & ~F.col("server") & ~client), "a server barrel is named outside a server context")


@rule("boundary/client-server-infra")
def client_server_infra(s: Syntax) -> DataFrame:
    v = s.vocabulary
    open_ = F.col("target_stem").isin(f"{v.infrastructure}/auth/client", f"{v.infrastructure}/providers/query-client")
    return _import(s.sources.where((F.col("area") == "infrastructure") & ~F.col("server") & ~open_), "client code imports infrastructure")


def _db(s: Syntax) -> Column:
    return paths.under(F.col("target_stem"), f"{s.vocabulary.infrastructure}/{s.vocabulary.db}")


@rule("boundary/db-isolation")
def db_isolation(s: Syntax) -> DataFrame:
    allowed = F.coalesce(F.col("profile").isin("infrastructure", "feature-repo", "feature-controllers"), F.lit(False))
    return _import(s.sources.where(_db(s) & ~allowed), "the database is named outside its layers")


@rule("boundary/import-policy")
def import_policy(s: Syntax) -> DataFrame:
    judged = policy.verdicts(s.facts.resolved.where("not relative and (target_path is not null or package is not null)"), s.vocabulary)
    lost = judged.where("verdict = 'unclassified-source'").groupBy("file").agg(F.min("offset").alias("offset"))
    return _import(lost, "this file is in no area that the import policy knows").unionByName(_import(judged.where(~F.col("verdict").isin("allowed", "internal", "unclassified-source")), text.rendered("{{v}}: {{p}} imports {{s}}", {"v": F.col("verdict"), "p": F.col("profile"), "s": F.col("specifier")})))


@rule("boundary/no-test-imports")
def no_test_imports(s: Syntax) -> DataFrame:
    return _import(s.sources.where(paths.names_test(F.col("specifier"))), "production code names a test module")


@rule("boundary/route-thinness")
def route_thinness(s: Syntax) -> DataFrame:
    return _import(s.sources.where((F.col("profile") == "route") & (_db(s) | (F.col("area") == "env-server"))), "a route reaches the database or the server's environment")


@rule("boundary/sdk-containment")
def sdk_containment(s: Syntax) -> DataFrame:
    owners = s.sources.sparkSession.createDataFrame(list(policy.OWNERS.items()), "package string, owner string")
    return _import(s.sources.join(F.broadcast(owners), "package").where(~paths.under(paths.stem(F.col("source_path")), F.col("owner"))), text.rendered("only {{o}} imports {{p}}", {"o": F.col("owner"), "p": F.col("package")}))


@rule("boundary/server-no-upward")
def server_no_upward(s: Syntax) -> DataFrame:
    return _import(s.sources.where((F.col("profile") == "infrastructure") & F.col("area").isin("feature", "domain", "route")), "infrastructure imports what stands above it")


@rule("placement/deprecated-paths")
def deprecated_paths(s: Syntax) -> DataFrame:
    return _import(s.sources.where(F.col("specifier").startswith(s.vocabulary.alias + "components/")), "this folder is deprecated")


# About syntax.


def _calls(s: Syntax) -> DataFrame:
    """Calls by the last name of what is called (name), and all of it as written (attrs.callee)."""
    return s.ast.where("type = 'CallExpression'")


def _inside(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """inner rows that lie in some node of outer."""
    return nesting.around(inner, outer, ["file"]).where("depth > 0").select(inner.columns).dropDuplicates(["file", "node_id"])


def _holding(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """(file, node_id) of outer nodes with some inner row within."""
    return nesting.held(outer.select("file", "node_id", "start", "end"), inner.select("file", "node_id", "start", "end"), ["file"]).where("inside > 0").select("file", "node_id").distinct()


def _children(s: Syntax, parents: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    return s.ast.where(F.col("role").isin(*roles)).join(parents.select("file", F.col("node_id").alias("parent_id")), ["file", "parent_id"], "left_semi")


@rule("effect/no-effect-catchallcause")
def no_effect_catchallcause(s: Syntax) -> DataFrame:
    return found(s.ast.where(F.col("type").isin("MemberExpression", "CallExpression") & F.col("name").isin("catchAllCause", "catchAllDefect")).dropDuplicates(["file", "start"]), "this catches defects too")


@rule("effect/no-service-option")
def no_service_option(s: Syntax) -> DataFrame:
    return found(s.ast.where(F.col("type").isin("MemberExpression", "CallExpression") & (F.col("name") == "serviceOption")).dropDuplicates(["file", "start"]), "an optional service hides that it is missing")


@rule("effect/no-disable-validation")
def no_disable_validation(s: Syntax) -> DataFrame:
    made = s.ast.where((F.col("type") == "NewExpression") | (F.col("type") == "CallExpression") & (F.col("name") == "make"))
    on = s.ast.where("type = 'Property' and name = 'disableValidation'").where("coalesce(attrs['value'], '') <> 'false'")
    return found(_inside(on, made), F.when(F.col("attrs")["value"] == "true", "validation is switched off").otherwise("validation may be switched off"))


@rule("effect/no-nested-layer-provide")
def no_nested_layer_provide(s: Syntax) -> DataFrame:
    calls = _calls(s).where("attrs['callee'] = 'Layer.provide'")
    return found(_inside(calls, calls), "Layer.provide within another's arguments")


@rule("effect/no-silent-error-swallow")
def no_silent_error_swallow(s: Syntax) -> DataFrame:
    calls = _calls(s).where(F.col("name").isin("catchAll", "catchTag", "catchTags"))
    returns = s.ast.where("role = 'returned'").where(F.col("attrs")["text"].rlike("\\.(?:void|unit)$|\\.succeed\\(\\s*(?:undefined|void\\b[^)]*)\\s*\\)$"))
    return found(calls.join(_holding(calls, returns), ["file", "node_id"], "left_semi"), "an error is swallowed")


@rule("effect/no-sql-type-parameter")
def no_sql_type_parameter(s: Syntax) -> DataFrame:
    return found(s.ast.where(F.col("type").isin("TaggedTemplateExpression", "CallExpression") & F.col("attrs")["callee"].rlike("^sql(?:\\.|$)") & F.col("attrs")["type_arguments"].isNotNull()), "a type argument of sql is an unchecked claim")


@rule("health/no-nested-ternary")
def no_nested_ternary(s: Syntax) -> DataFrame:
    """Conditionals below more than the limit of others, counting those in whose branches they lie (not in whose tests)."""
    conditional = s.ast.where("type = 'ConditionalExpression'")
    branches = s.ast.where("role in ('consequent', 'alternate')").join(conditional.select("file", F.col("node_id").alias("parent_id")), ["file", "parent_id"], "left_semi")
    nested = nesting.around(conditional.select("file", "node_id", "start", "end"), branches.select("file", "node_id", "start", "end"), ["file"], strict=False)
    return found(nested.where(F.col("depth") > s.limits["ternary"] - 1), "conditionals nest too deep")


#: Words that say nothing of what a symbol is for.
VACANT = ("data", "helper", "helpers", "info", "manager", "object", "shape", "stuff", "thing", "util", "utils")


@rule("naming/no-vacant-symbol-names")
def no_vacant_symbol_names(s: Syntax) -> DataFrame:
    types = F.col("type").isin("TSTypeAliasDeclaration", "TSInterfaceDeclaration", "TSEnumDeclaration")
    values = F.col("type").isin("FunctionDeclaration", "ClassDeclaration", "VariableDeclarator") & (F.col("attrs")["module_level"] == "true")
    return found(s.ast.where((types | values) & F.arrays_overlap(text.identifier_words(F.col("name")), F.array(*map(F.lit, VACANT)))), text.rendered("{{n}} says what kind of thing it is, not what for", {"n": F.col("name")}))


@rule("placement/no-deprecated-input-validator")
def no_deprecated_input_validator(s: Syntax) -> DataFrame:
    calls = _calls(s).where("name = 'inputValidator'")
    return found(calls.join(_holding(calls, _calls(s).where("name = 'createServerFn'")), ["file", "node_id"], "left_semi"), "inputValidator is deprecated")


@rule("placement/schema-placement")
def schema_placement(s: Syntax) -> DataFrame:
    v = s.vocabulary
    return found(_calls(s).where(F.col("name").isin("pgTable", "relations") & ~paths.under(paths.stem(F.col("source_path")), f"{v.infrastructure}/{v.db}/{v.db_schema}")), "tables are declared in the schema folder")


@rule("placement/server-fn-placement")
def server_fn_placement(s: Syntax) -> DataFrame:
    v = s.vocabulary
    return found(s.ast.where("type = 'Identifier' and name = 'createServerFn'").where(F.coalesce(paths.layer(F.col("source_path"), v) != "controllers", F.lit(True))).dropDuplicates(["file", "start"]), "server functions live in controllers")


@rule("placement/server-fn-validation")
def server_fn_validation(s: Syntax) -> DataFrame:
    handlers = _calls(s).where("name = 'handler'").join(_holding(_calls(s).where("name = 'handler'"), _calls(s).where("name = 'createServerFn'")), ["file", "node_id"], "left_semi")
    reads = s.ast.where("role = 'param'").where((F.col("type").isin("Identifier", "RestElement")) | (F.col("type") == "ObjectPattern") & F.col("attrs")["keys"].rlike("(?:^|,)data(?:,|$)"))
    checked = _holding(handlers, _calls(s).where("name = 'validator'"))
    return found(handlers.join(_holding(handlers, reads), ["file", "node_id"], "left_semi").join(checked, ["file", "node_id"], "left_anti"), "the handler reads data that nothing validates")


@rule("placement/no-raw-result")
def no_raw_result(s: Syntax) -> DataFrame:
    layers = paths.layer(F.col("source_path"), s.vocabulary).isin("repo", "controllers")
    chain = F.split(F.col("attrs")["chain"], ",")
    writes = F.arrays_overlap(chain, F.array(*map(F.lit, ("insert", "update", "delete", "onConflictDoNothing", "onConflictDoUpdate"))))
    return found(s.ast.where((F.col("role") == "returned") & layers & F.coalesce(writes & ~F.array_contains(chain, "returning"), F.lit(False))), "a driver's raw result is returned")


@rule("react/derived-state")
def derived_state(s: Syntax) -> DataFrame:
    effects = _calls(s).where("name = 'useEffect'")
    setters = s.ast.where("type = 'VariableDeclarator' and attrs['init'] = 'useState'").select("file", F.col("attrs")["setter"].alias("name"))
    sets = _calls(s).join(setters, ["file", "name"], "left_semi")
    busy = s.ast.where("type in ('AwaitExpression', 'ForAwaitStatement')").unionByName(_calls(s).where(F.col("name").isin("setTimeout", "setInterval", "requestAnimationFrame", "then", "addEventListener")))
    return found(effects.join(_holding(effects, sets), ["file", "node_id"], "left_semi").join(_holding(effects, busy), ["file", "node_id"], "left_anti"), "state that could be computed while rendering")


@rule("react/no-async-effect")
def no_async_effect(s: Syntax) -> DataFrame:
    effects = _calls(s).where(F.col("name").isin("useEffect") & paths.is_component(F.col("file")))
    busy = s.ast.where("type = 'AwaitExpression' or attrs['async'] = 'true'").unionByName(_calls(s).where("name = 'then'"))
    cleanup = s.ast.where("role = 'returned' and type = 'ArrowFunctionExpression'")
    callbacks = _calls(s).where((F.col("name") == "useCallback") & paths.is_component(F.col("file")))
    loose = effects.join(_holding(effects, busy), ["file", "node_id"], "left_semi").join(_holding(effects, cleanup), ["file", "node_id"], "left_anti")
    return found(loose, "async work in an effect without cleanup").unionByName(found(callbacks.join(_holding(callbacks, s.ast.where("attrs['async'] = 'true'")), ["file", "node_id"], "left_semi"), "an async callback"))


def _components(s: Syntax) -> DataFrame:
    """Exported components: functions with a capital name, in component files."""
    return s.ast.where("attrs['exported'] = 'true' and attrs['function'] = 'true'").where(F.col("name").rlike("^[A-Z]") & paths.is_component(F.col("file")))


@rule("react/hook-count")
def hook_count(s: Syntax) -> DataFrame:
    hooks = _calls(s).where(F.col("name").rlike("^use[A-Z]")).select("file", "node_id", "start", "end")
    n = nesting.held(_components(s).select("file", "node_id", "start", "end", "name"), hooks, ["file"]).where(F.col("inside") >= s.limits["hooks"])
    return found(n, text.rendered("{{c}} calls {{n}} hooks", {"c": F.col("name"), "n": F.col("inside")}))


@rule("react/single-component-export")
def single_component_export(s: Syntax) -> DataFrame:
    w = Window.partitionBy("file").orderBy("start")
    barrel = paths.is_barrel(F.col("source_path"), s.vocabulary)
    own = _components(s).where(~barrel & (F.coalesce(F.col("attrs")["compound"], F.lit("")) != "true"))
    names = own.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "name"))), lambda x: x["name"]), ", ").alias("names"))
    return found(own.withColumn("n", F.row_number().over(w)).where("n = 2").join(names, "file"), text.rendered("more than one component is exported: {{n}}", {"n": F.col("names")}))


@rule("react/prop-count")
def prop_count(s: Syntax) -> DataFrame:
    """Distinct props but children of a component's props type and of all types that it names, extends or joins, in its file.

    References (TSTypeReference with role heritage, intersection or aliased) are followed to a fixpoint. The count is a floor
    where some of the type couldn't be read: a base that the file doesn't declare, a ring of bases, a prop without a name, an
    index signature, or another kind of type in a base's place. A base of which nothing could be read is named itself.
    """
    declared = s.ast.where("type in ('TSTypeLiteral', 'TSInterfaceDeclaration', 'TSTypeAliasDeclaration') and name is not null")
    node = lambda name: F.concat_ws("\u0000", "file", F.col(name))
    parts = s.ast.where("role in ('prop', 'heritage', 'intersection', 'aliased') or type = 'TSIndexSignature'").select("file", "node_id", "start", "end", "name", "type", "role")
    within = nesting.around(parts, declared.select("file", "node_id", "start", "end", "name"), ["file"], carry=["name"]).where("depth > 0").withColumn("node", node("outer_name"))
    reference = F.col("role").isin("heritage", "intersection", "aliased")
    base = reference & (F.col("type") == "TSTypeReference") & F.col("name").isNotNull()
    plain = F.col("type").isin("TSTypeLiteral", "TSIntersectionType")  # their own parts are met by themselves
    edges = graph.cut(within.where(base).select(F.col("node").alias("a"), node("name").alias("b"), "name").distinct())
    known = declared.select(node("name").alias("node")).distinct()
    away = edges.join(known.withColumnRenamed("node", "b"), "b", "left_anti").select(F.col("a").alias("node"), "name")
    rings = graph.cycles(edges).select("node").union(edges.where("a = b").select("a"))
    unread = within.where((reference & ~base & ~plain) | ((F.col("role") == "prop") & F.col("name").isNull()) | (F.col("type") == "TSIndexSignature")).select("node")
    floors = away.select("node").union(rings).union(unread).distinct().withColumn("complete", F.lit(False))
    names = within.where("role = 'prop' and name <> 'children'").groupBy("node").agg(F.collect_set("name").alias("names"))
    own = known.join(names, "node", "left").join(floors, "node", "left").select("node", "names", F.coalesce("complete", F.lit(True)).alias("complete"))
    read = graph.cut(lattice.fixpoint(edges.join(known.withColumnRenamed("node", "b"), "b", "left_semi"), own, {"names": lattice.UNION, "complete": lattice.AND}))
    # bases that couldn't be read, each by the name of the type of which nothing is known
    empty = read.where("not complete and size(names) = 0").select("node")
    blame = empty.select("node", F.array(F.element_at(F.split("node", "\u0000"), 2)).alias("bases"))
    blame = blame.unionByName(away.join(empty, "node", "left_anti").groupBy("node").agg(F.collect_set("name").alias("bases")))
    blamed = lattice.fixpoint(edges.join(empty.withColumnRenamed("node", "a"), "a", "left_anti").select("a", "b"), blame, {"bases": lattice.UNION})
    heads = declared.where("attrs['props'] = 'true'").where(paths.is_component(F.col("file"))).select("file", "start", node("name").alias("node"))
    out = heads.join(read, "node").join(blamed, "node", "left").withColumn("n", F.size("names")).where(F.col("n") >= s.limits["props"])
    values = {"n": F.col("n"), "b": F.array_join("bases", ", ")}
    floor = F.when(F.size("bases") > 0, text.rendered("at least {{n}} props, as {{b}} can't be read in this file", values)).otherwise(text.rendered("at least {{n}} props, as part of their type has no names", values))
    return found(out, F.when(F.col("complete"), text.rendered("{{n}} props", values)).otherwise(floor))


#: Raw elements and platform primitives that applications compose from their own components.
RAW = ("div", "span", "p", "main", "section", "header", "footer", "nav", "aside", "article", "ul", "ol", "li", "button", "a", "h1", "h2", "h3", "h4", "h5", "h6", "img")
PRIMITIVES = ("View", "Text", "Pressable", "TouchableOpacity", "ScrollView", "TextInput", "Image")
#: Names whose type arguments claim what outside data is.
DATA_CALLS = ("delete", "execute", "fetch", "get", "gql", "graphql", "json", "parse", "patch", "post", "put", "query", "request")


def _styled(s: Syntax) -> DataFrame:
    return s.ast.where(F.coalesce(paths.profile(F.col("source_path"), s.vocabulary) != "shared-ui", F.lit(True)))


@rule("style/no-raw-primitives")
def no_raw_primitives(s: Syntax) -> DataFrame:
    root = paths.stem(F.col("source_path")) == f"{s.vocabulary.routes}/{s.vocabulary.root_route}"
    elements = _styled(s).where((F.col("type") == "JSXOpeningElement") & F.col("name").isin(*RAW) & ~root)
    native = _styled(s).where((F.col("type") == "ImportSpecifier") & (F.col("attrs")["source"] == "react-native") & F.col("name").isin(*PRIMITIVES))
    star = _styled(s).where("type = 'ExportAllDeclaration' and attrs['source'] = 'react-native'")
    return found(elements, "a raw element").unionByName(found(native, "a raw primitive")).unionByName(found(star, "all primitives are passed on"))


@rule("style/no-inline-color")
def no_inline_color(s: Syntax) -> DataFrame:
    from .structural import COLOR

    value = F.regexp_replace(F.col("attrs")["value"], "\\[[^\\]]*\\]", "")
    place = (F.col("type") == "Property") | (F.col("type") == "JSXAttribute") & F.col("name").isin("c", "bg", "color")
    return found(s.ast.where(place & value.rlike(COLOR)), "a color literal")


@rule("style/no-inline-font-size")
def no_inline_font_size(s: Syntax) -> DataFrame:
    return found(_styled(s).where(F.col("type").isin("Property", "JSXAttribute") & (F.col("name") == "fontSize")), "an inline font size")


@rule("style/no-inline-style-prop")
def no_inline_style_prop(s: Syntax) -> DataFrame:
    props = _styled(s).where("type = 'JSXAttribute' and name = 'style'")
    return found(props.join(_holding(props, s.ast.where("type = 'ObjectExpression'")), ["file", "node_id"], "left_semi"), "an inline style object")


@rule("style/no-arbitrary-class-values")
def no_arbitrary_class_values(s: Syntax) -> DataFrame:
    value = F.col("attrs")["value"]
    bad = value.rlike("(?:^|\\s)[a-z-]+-\\[(?!var\\(--)[^\\]]+\\]") | value.rlike("-\\[var\\(--") | value.rlike("(?:^|\\s)text-(?:xs|sm|base|lg|xl|[2-9]xl)(?:\\s|$)")
    return found(s.ast.where(F.col("type").isin("Literal", "TemplateElement") & bad), "a class with a value of its own")


@rule("style/vendor-component-containment")
def vendor_component_containment(s: Syntax) -> DataFrame:
    wrapped = s.ast.where(F.col("type").isin("ImportSpecifier", "ExportSpecifier") & (F.col("name") == "Textarea") & (F.col("attrs")["source"] == "@mantine/core"))
    star = s.ast.where("type = 'ExportAllDeclaration' and attrs['source'] = '@mantine/core'")
    own = F.coalesce(paths.profile(F.col("source_path"), s.vocabulary) == "shared-ui", F.lit(False))
    return found(wrapped.where(~own), "import the wrapper instead").unionByName(found(star.where(~own), "all vendor components are passed on"))


@rule("testing/no-module-mocking")
def no_module_mocking(s: Syntax) -> DataFrame:
    """The only rule that reads files outside the trees as well; calls of shadowed names have attrs.shadowed."""
    calls = s.nodes.where("type = 'CallExpression'").where(F.col("attrs")["callee"].rlike("^(?:vi|jest)\\.(?:mock|doMock|unstable_mockModule)$"))
    return found(calls.where("coalesce(attrs['shadowed'], '') <> 'true'"), "a module is mocked")


@rule("types/no-chained-type-assertions")
def no_chained_type_assertions(s: Syntax) -> DataFrame:
    casts = s.ast.where("type = 'TSAsExpression'")
    parent = casts.select("file", F.col("node_id").alias("parent_id"), F.col("attrs")["to"].alias("outer_to"), F.col("start").alias("at"), F.col("parent_id").alias("above"))
    chained = casts.join(parent, ["file", "parent_id"]).where("attrs['to'] <> 'const' or outer_to <> 'const'")
    top = chained.join(casts.select("file", F.col("node_id").alias("above")), ["file", "above"], "left_anti")
    return found(top.withColumn("start", F.col("at")), "assertions in a chain")


@rule("types/no-conditional-empty-object-spread")
def no_conditional_empty_object_spread(s: Syntax) -> DataFrame:
    spreads = s.ast.where("type = 'SpreadElement'")
    choice = _children(s, spreads, ("argument",)).where("type = 'ConditionalExpression'")
    return found(choice.join(_children(s, choice, ("consequent", "alternate")).where("type = 'ObjectExpression' and attrs['empty'] = 'true'").select("file", F.col("parent_id").alias("node_id")), ["file", "node_id"], "left_semi"), "an empty object is spread on a condition")


@rule("types/no-reflect-access")
def no_reflect_access(s: Syntax) -> DataFrame:
    return found(s.ast.where(F.col("attrs")["callee"].isin("Reflect.get", "Reflect.apply") & (F.coalesce(F.col("attrs")["shadowed"], F.lit("")) != "true")), "access by reflection")


@rule("types/no-type-argument-assertion")
def no_type_argument_assertion(s: Syntax) -> DataFrame:
    arguments = F.split(F.col("attrs")["type_arguments"], ",\\s*")
    return found(_calls(s).where(F.col("name").isin(*DATA_CALLS) & arguments.isNotNull() & ~F.forall(arguments, lambda a: a == "unknown")), "a type argument claims what outside data is")


@rule("types/require-safety-comment")
def require_safety_comment(s: Syntax) -> DataFrame:
    """Assertions without a SAFETY: comment between the statement before (attrs.statement_gap, where its statement's gap starts) and them."""
    casts = s.ast.where("type = 'TSAsExpression' and attrs['to'] <> 'const'").withColumn("gap", F.col("attrs")["statement_gap"].cast("int"))
    notes = s.comments.where(F.col("text").rlike("SAFETY:")).select("file", F.col("start").alias("note"))
    safe = casts.join(notes, "file").where("note >= gap and note < start").select("file", "node_id")
    return found(casts.join(safe, ["file", "node_id"], "left_anti"), "say in a SAFETY: comment why this holds")


@rule("boundary/ambient-globals")
def ambient_globals(s: Syntax) -> DataFrame:
    """Reads of ambient names (attrs.path, host-free) outside the module that owns them."""
    v = s.vocabulary
    path = F.col("attrs")["path"]
    kind = F.when(path.rlike("^(?:process\\.env|import\\.meta\\.env)(?:\\.|$)"), "env").when(path.rlike("^fetch(?:\\.|$)"), "api-client").when(path.rlike("^localStorage(?:\\.|$)"), "browser-storage")
    own = F.when(F.col("kind") == "env", paths.stem(F.col("source_path")).isin(*[n for n, _ in v.env_modules])).otherwise(paths.stem(F.col("source_path")) == F.concat(F.lit(f"{v.infrastructure}/"), "kind"))
    free = s.ast.where("coalesce(attrs['shadowed'], '') <> 'true'")
    reads = free.withColumn("kind", kind).where("kind is not null")
    # const { env } = process reads process.env: the members that a pattern takes of what it is bound to
    patterns = s.ast.where("type = 'ObjectPattern' and role = 'id'").select("file", "parent_id", F.explode(F.split(F.col("attrs")["keys"], ",")).alias("key"))
    taken = free.where("role = 'init' and attrs['path'] is not null").join(patterns, ["file", "parent_id"]).withColumn("attrs", F.create_map(F.lit("path"), F.concat_ws(".", F.col("attrs")["path"], "key"))).drop("key")
    reads = reads.unionByName(taken.select(*free.columns).withColumn("kind", kind).where("kind is not null").select(*reads.columns))
    return found(reads.where(~own).dropDuplicates(["file", "start"]), text.rendered("{{p}} is read outside its module", {"p": F.col("attrs")["path"]}))


@rule("placement/no-plain-export-in-server-fn-module")
def no_plain_export(s: Syntax) -> DataFrame:
    defining = _calls(s).where("name = 'createServerFn'").select("file").distinct()
    exports = s.ast.where("attrs['exported'] = 'true' and coalesce(attrs['type_only'], '') <> 'true'").where(~paths.stem(F.col("source_path")).endswith(s.vocabulary.server_suffix)).join(defining, "file", "left_semi")
    bridges = _holding(exports, _calls(s).where("name = 'createServerFn'"))
    plain = exports.join(bridges, ["file", "node_id"], "left_anti")
    default = exports.where("attrs['default'] = 'true'").join(bridges, ["file", "node_id"], "left_semi")
    return found(plain, "a plain export beside server functions").unionByName(found(default, "a server function as default export"))


#: Rules over imports alone, which need no syntax nodes.
IMPORTS = (
    "api/barrel-direction", "api/server-import-context", "boundary/client-server-infra", "boundary/db-isolation", "boundary/import-policy", "boundary/no-test-imports", "boundary/route-thinness", "boundary/sdk-containment", "boundary/server-no-upward",
    "placement/deprecated-paths",
)


def run(s: Syntax, names: list[str] | None = None) -> DataFrame:
    """Findings of the rules: rule, severity, file, start, message. With a rule over syntax, a file without nodes is an error."""
    names = list(names or RULES)
    if set(names) - set(IMPORTS):
        s.covered()
    out = None
    for name in names:
        one = RULES[name](s).select(F.lit(name).alias("rule"), F.lit("warning" if name in WARNINGS else "error").alias("severity"), "file", "start", "message")
        out = one if out is None else out.unionByName(one)
    return out
