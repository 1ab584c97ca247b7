"""Kind R queries of the rules: each applies a rule to facts given as VALUES, obvious, adversarial and legal rows together.

The SQL of a query says the rule over the same VALUES by itself; it shares no code with the rule.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.paths import Tree
from ..sources import tokens, tree
from . import derive
from . import facts as jsons
from . import links, markup, positions, reports  # noqa: F401  they add their queries
from . import perfile, policy, runner, structural, types
from .catalogue import ORACLE_SQL, QUERIES, _values, query


def case(name: str, sql: str, run: Callable[[SparkSession], DataFrame]) -> None:
    def apply(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark)

    apply.__name__ = name
    query("R", sql)(apply)


# Rules over the syntax of one file.

VIEW, REPO, CTRL, SHARED, DB, ENV = "src/features/a/ui/view.tsx", "src/features/a/repo/r.ts", "src/features/a/controllers/c.ts", "src/shared/ui/card.tsx", "src/infrastructure/db/schema/t.ts", "src/env.server.ts"
API, FAKE = "src/infrastructure/api-client.ts", "src/features/a/service/api-client.ts"
SYNTAX_FILES = (VIEW, REPO, CTRL, SHARED, DB, ENV, API, FAKE)
NODES: list[tuple] = []


def _node(file, kind, start, end, name=None, role=None, parent=0, **attrs):
    NODES.append((file, len(NODES) + 1, parent, role, kind, start, end, name, json.dumps(attrs)))
    return len(NODES)


def _nodes() -> None:
    call = "CallExpression"
    _node(VIEW, call, 0, 50, "provide", callee="Layer.provide")
    _node(VIEW, call, 10, 20, "provide", callee="Layer.provide")
    _node(VIEW, call, 30, 40, "provide", callee="Other.provide")
    for i, (kind, name) in enumerate([("MemberExpression", "catchAllCause"), (call, "catchAllCause"), (call, "catchAllDefect"), (call, "catchAll"), ("Identifier", "catchAllCause"), ("MemberExpression", "serviceOption"), (call, "serviceOptional")]):
        _node(VIEW, kind, 60 + 5 * (i - (i == 1)), 64 + 5 * i, name)
    for at, (outer, name, value) in enumerate([("NewExpression", "X", "true"), (call, "make", "flag"), (call, "make", "false"), (call, "build", "true")]):
        _node(VIEW, outer, 100 + 30 * at, 125 + 30 * at, name)
        _node(VIEW, "Property", 105 + 30 * at, 120 + 30 * at, "disableValidation", value=value)
    for at, (name, said) in enumerate([("catchAll", "Effect.void"), ("catchTag", "Effect.succeed(undefined)"), ("catchTags", "Effect.fail(e)"), ("map", "Effect.void"), ("catchAll", "Effect.succeed(1)")]):
        _node(VIEW, call, 300 + 20 * at, 315 + 20 * at, name)
        _node(VIEW, "Expr", 305 + 20 * at, 310 + 20 * at, role="returned", text=said)
    _node(VIEW, "TaggedTemplateExpression", 410, 415, callee="sql", type_arguments="User")
    _node(VIEW, call, 416, 419, callee="sql.unsafe", type_arguments="User")
    _node(VIEW, "TaggedTemplateExpression", 420, 425, callee="sql")
    _node(VIEW, call, 426, 429, callee="sqlite", type_arguments="User")
    for at, (kind, name, level) in enumerate([("TSTypeAliasDeclaration", "UserData", "false"), ("VariableDeclarator", "localInfo", "false"), ("VariableDeclarator", "dateHelper", "true"), ("ClassDeclaration", "Dataset", "true"), ("FunctionDeclaration", "parse_object", "true"), ("TSEnumDeclaration", "Shape", "true")]):
        _node(VIEW, kind, 430 + 5 * at, 434 + 5 * at, name, module_level=level)
    outer = _node(VIEW, "ConditionalExpression", 500, 600)
    _node(VIEW, "ConditionalExpression", 501, 509, role="test", parent=outer)
    inner = _node(VIEW, "ConditionalExpression", 520, 599, role="alternate", parent=outer)
    deep = _node(VIEW, "ConditionalExpression", 540, 598, role="alternate", parent=inner)
    _node(VIEW, "ConditionalExpression", 550, 597, role="consequent", parent=deep)
    _node(VIEW, call, 610, 640, "inputValidator")
    _node(VIEW, call, 610, 625, "createServerFn")
    _node(VIEW, call, 641, 645, "inputValidator")
    for file in (VIEW, CTRL):
        _node(file, "Identifier", 612, 620, "createServerFn")
    for file in (VIEW, DB):
        _node(file, call, 650, 660, "pgTable")
    for at, (param, keys, validated) in enumerate([("Identifier", "", False), ("ObjectPattern", "data,x", False), ("ObjectPattern", "context", False), ("Identifier", "", True)]):
        _node(CTRL, call, 700 + 50 * at, 745 + 50 * at, "handler")
        _node(CTRL, call, 701 + 50 * at, 710 + 50 * at, "createServerFn")
        _node(CTRL, param, 720 + 50 * at, 725 + 50 * at, role="param", keys=keys)
        if validated:
            _node(CTRL, call, 711 + 50 * at, 715 + 50 * at, "validator")
    for at, (file, chain) in enumerate([(REPO, "db,insert,values"), (REPO, "db,insert,values,returning"), (REPO, "db,select"), (CTRL, "db,delete"), (VIEW, "db,update")]):
        _node(file, "Expr", 100 + 10 * at, 105 + 10 * at, role="returned", chain=chain)
    _node(VIEW, "VariableDeclarator", 1000, 1009, init="useState", setter="setX")
    for at, (name, inside) in enumerate([("useEffect", [(call, "setX")]), ("useEffect", [(call, "setX"), (call, "setTimeout")]), ("useEffect", [(call, "setY")]), ("useEffect", [("AwaitExpression", None)]), ("useEffect", [(call, "then")]), ("useCallback", [("Arrow!", None)])]):
        _node(VIEW, call, 1010 + 40 * at, 1045 + 40 * at, name)
        for k, (kind, what) in enumerate(inside):
            _node(VIEW, kind.rstrip("!"), 1015 + 40 * at + 5 * k, 1018 + 40 * at + 5 * k, what, **({"async": "true"} if kind.endswith("!") else {}))
    _node(VIEW, "ArrowFunctionExpression", 1180, 1184, role="returned")
    _node(VIEW, "Function", 1300, 1500, "Big", exported="true", function="true")
    for i in range(7):
        _node(VIEW, call, 1310 + 10 * i, 1315 + 10 * i, f"useThing{i}")
    _node(VIEW, "Function", 1510, 1600, "Other", exported="true", function="true")
    for i in range(6):
        _node(VIEW, call, 1520 + 10 * i, 1525 + 10 * i, f"useThing{i}")
    _node(VIEW, "Function", 1610, 1620, "lower", exported="true", function="true")
    _node(VIEW, "Function", 1630, 1640, "Part", exported="true", function="true", compound="true")
    for at, n in enumerate((8, 7)):
        _node(VIEW, "TSTypeLiteral", 1700 + 100 * at, 1795 + 100 * at, f"Props{n}", props="true")
        for i in range(n):
            _node(VIEW, "TSPropertySignature", 1705 + 100 * at + 5 * i, 1708 + 100 * at + 5 * i, f"p{i}", role="prop")
        _node(VIEW, "TSPropertySignature", 1790 + 100 * at, 1793 + 100 * at, "children", role="prop")
    for at, (name, first, refs, head) in enumerate([("Wide", 20, [("Base", "heritage")], True), ("Base", 30, [("Wide", "heritage"), ("Gone", "heritage")], False), ("Thin", 40, [("Base", "typeof")], True), ("Joined", 50, [("Wide", "intersection"), ("Thin", "intersection")], True)]):
        _node(VIEW, "TSInterfaceDeclaration", 2700 + 50 * at, 2745 + 50 * at, name, **({"props": "true"} if head else {}))
        for i in range(4):
            _node(VIEW, "TSPropertySignature", 2705 + 50 * at + 5 * i, 2708 + 50 * at + 5 * i, f"q{first + i}", role="prop")
        for i, (to, role) in enumerate(refs):
            _node(VIEW, "TSTypeReference", 2730 + 50 * at + 5 * i, 2733 + 50 * at + 5 * i, to, role=role)
    for file in (VIEW, SHARED):
        _node(file, "JSXOpeningElement", 1900, 1905, "div")
        _node(file, "JSXOpeningElement", 1906, 1909, "Box")
        _node(file, "ImportSpecifier", 1910, 1914, "View", source="react-native")
        _node(file, "ExportAllDeclaration", 1915, 1919, source="react-native")
        _node(file, "ImportSpecifier", 1920, 1924, "Textarea", source="@mantine/core")
        _node(file, "ExportAllDeclaration", 1925, 1929, source="@mantine/core")
        _node(file, "Property", 1930, 1934, "color", value="#fff")
        _node(file, "JSXAttribute", 1935, 1939, "bg", value="brand.5")
        _node(file, "JSXAttribute", 1940, 1944, "title", value="#fff")
        _node(file, "JSXAttribute", 1945, 1949, "fontSize")
        _node(file, "JSXAttribute", 1950, 1965, "style")
        _node(file, "ObjectExpression", 1955, 1960)
        _node(file, "JSXAttribute", 1966, 1969, "style")
    for at, value in enumerate(["p-[3px] x", "p-[var(--gap)]", "p-4 m-2", "text-sm", "text-body", "grid-cols-[1fr_2fr]"]):
        _node(VIEW, "Literal", 1970 + 5 * at, 1974 + 5 * at, value=value)
    for at, (callee, shadowed) in enumerate([("vi.mock", "false"), ("jest.doMock", "false"), ("vi.fn", "false"), ("vi.mock", "true"), ("Reflect.get", "false"), ("Reflect.apply", "true"), ("Reflect.ownKeys", "false")]):
        _node(VIEW, call, 2010 + 5 * at, 2014 + 5 * at, callee.split(".")[1], callee=callee, shadowed=shadowed)
    outer = _node(VIEW, "TSAsExpression", 2100, 2140, to="X", statement_gap="2090")
    _node(VIEW, "TSAsExpression", 2101, 2135, to="unknown", parent=outer, statement_gap="2090")
    _node(VIEW, "TSAsExpression", 2150, 2160, to="const", statement_gap="2145")
    _node(VIEW, "TSAsExpression", 2170, 2180, to="Y", statement_gap="2165")
    for at, (kind, empty) in enumerate([("ObjectExpression", "true"), ("ObjectExpression", "false"), ("Identifier", "")]):
        spread = _node(VIEW, "SpreadElement", 2200 + 30 * at, 2225 + 30 * at)
        choice = _node(VIEW, "ConditionalExpression", 2203 + 30 * at, 2224 + 30 * at, role="argument", parent=spread)
        _node(VIEW, kind, 2210 + 30 * at, 2212 + 30 * at, role="alternate", parent=choice, empty=empty)
    for at, (name, arguments) in enumerate([("json", "User"), ("json", "unknown"), ("fetch", "A, unknown"), ("map", "User")]):
        _node(VIEW, call, 2300 + 10 * at, 2305 + 10 * at, name, type_arguments=arguments)
    for file in (VIEW, ENV, API, FAKE):
        for at, path in enumerate(["process.env.X", "import.meta.env", "fetch", "localStorage.getItem", "processor.env"]):
            _node(file, "MemberExpression", 2400 + 10 * at, 2405 + 10 * at, path=path, shadowed="false")
    _node(VIEW, "MemberExpression", 2460, 2465, path="fetch", shadowed="true")
    for at, (name, attrs) in enumerate([("plain", {}), ("bridge", {}), ("Kind", {"type_only": "true"}), ("whole", {"default": "true"})]):
        _node(CTRL, "ExportNamedDeclaration", 2500 + 40 * at, 2535 + 40 * at, name, exported="true", **attrs)
        if name in ("bridge", "whole"):
            _node(CTRL, call, 2510 + 40 * at, 2520 + 40 * at, "createServerFn")


_nodes()
NOTES = [(VIEW, 2166, 2169, "// SAFETY: checked above"), (VIEW, 2095, 2098, "// because")]
N = f"WITH n AS (SELECT *, substr(file, 5) AS path, regexp_replace(substr(file, 5), '[.](tsx?|ts)$', '') AS stem FROM ({_values(NODES)}) t(file, id, parent, role, type, s, e, name, a))"


def _syntax(spark: SparkSession) -> perfile.Syntax:
    files = spark.createDataFrame([(f, "") for f in SYNTAX_FILES], "file string, text string")
    nodes = spark.createDataFrame(NODES, "file string, node_id long, parent_id long, role string, type string, start int, end int, name string, a string").withColumn("attrs", F.from_json("a", "map<string,string>")).drop("a")
    return perfile.Syntax(structural.Facts(tree.source_files(files, [Tree("src")])), nodes, spark.createDataFrame(NOTES, "file string, start int, end int, text string"))


def _a(alias: str, key: str) -> str:
    return f"json_extract_string({alias}.a, '$.{key}')"


def _in(x: str, condition: str) -> str:
    return f"EXISTS (SELECT 1 FROM n o WHERE o.file = {x}.file AND {x}.s >= o.s AND {x}.e <= o.e AND o.id <> {x}.id AND ({condition}))"


def _has(x: str, condition: str) -> str:
    return f"EXISTS (SELECT 1 FROM n i WHERE i.file = {x}.file AND i.s >= {x}.s AND i.e <= {x}.e AND i.id <> {x}.id AND ({condition}))"


_CALL, _LIST = "x.type = 'CallExpression'", lambda names: ", ".join(f"'{n}'" for n in names)
_COMPONENT = f"{_a('x', 'exported')} = 'true' AND {_a('x', 'function')} = 'true' AND regexp_matches(x.name, '^[A-Z]') AND ends_with(x.file, 'x')"
_COLOR = "#[0-9a-fA-F]{3,8}\\b|\\b(rgb|rgba|hsl|hsla|oklch|oklab|lab|lch|color)[(]"
_UNSTYLED = "NOT starts_with(x.path, 'shared/ui/')"
#: Each rule's findings as a selection of nodes x.
SYNTAX = {
    "effect/no-effect-catchallcause": "x.type IN ('MemberExpression', 'CallExpression') AND x.name IN ('catchAllCause', 'catchAllDefect')",
    "effect/no-service-option": "x.type IN ('MemberExpression', 'CallExpression') AND x.name = 'serviceOption'",
    "effect/no-disable-validation": f"x.type = 'Property' AND x.name = 'disableValidation' AND {_a('x', 'value')} <> 'false' AND {_in('x', "o.type = 'NewExpression' OR o.type = 'CallExpression' AND o.name = 'make'")}",
    "effect/no-nested-layer-provide": f"{_CALL} AND {_a('x', 'callee')} = 'Layer.provide' AND {_in('x', _a('o', 'callee') + " = 'Layer.provide'")}",
    "effect/no-silent-error-swallow": f"{_CALL} AND x.name IN ('catchAll', 'catchTag', 'catchTags') AND {_has('x', "i.role = 'returned' AND " + _a('i', 'text') + " IN ('Effect.void', 'Effect.succeed(undefined)')")}",
    "effect/no-sql-type-parameter": f"x.type IN ('TaggedTemplateExpression', 'CallExpression') AND regexp_matches({_a('x', 'callee')}, '^sql([.]|$)') AND {_a('x', 'type_arguments')} IS NOT NULL",
    "naming/no-vacant-symbol-names": f"""(x.type IN ('TSTypeAliasDeclaration', 'TSInterfaceDeclaration', 'TSEnumDeclaration') OR x.type IN ('FunctionDeclaration', 'ClassDeclaration', 'VariableDeclarator') AND {_a('x', 'module_level')} = 'true')
      AND list_has_any(regexp_split_to_array(lower(regexp_replace(x.name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), ['data', 'helper', 'helpers', 'info', 'manager', 'object', 'shape', 'stuff', 'thing', 'util', 'utils'])""",
    "placement/no-deprecated-input-validator": f"{_CALL} AND x.name = 'inputValidator' AND {_has('x', "i.type = 'CallExpression' AND i.name = 'createServerFn'")}",
    "placement/schema-placement": f"{_CALL} AND x.name IN ('pgTable', 'relations') AND NOT starts_with(x.stem, 'infrastructure/db/schema/')",
    "placement/server-fn-placement": "x.type = 'Identifier' AND x.name = 'createServerFn' AND NOT starts_with(x.path, 'features/a/controllers/')",
    "placement/server-fn-validation": f"""{_CALL} AND x.name = 'handler' AND {_has('x', "i.name = 'createServerFn'")} AND NOT {_has('x', "i.name = 'validator'")}
      AND {_has('x', "i.role = 'param' AND (i.type IN ('Identifier', 'RestElement') OR i.type = 'ObjectPattern' AND list_contains(string_split(" + _a('i', 'keys') + ", ','), 'data'))")}""",
    "placement/no-raw-result": f"x.role = 'returned' AND string_split(x.path, '/')[3] IN ('repo', 'controllers') AND list_has_any(string_split({_a('x', 'chain')}, ','), ['insert', 'update', 'delete', 'onConflictDoNothing', 'onConflictDoUpdate']) AND NOT list_contains(string_split({_a('x', 'chain')}, ','), 'returning')",
    "react/derived-state": f"""{_CALL} AND x.name = 'useEffect' AND {_has('x', f"i.name IN (SELECT {_a('d', 'setter')} FROM n d WHERE d.file = i.file AND {_a('d', 'init')} = 'useState')")}
      AND NOT {_has('x', "i.type IN ('AwaitExpression', 'ForAwaitStatement') OR i.name IN ('setTimeout', 'setInterval', 'requestAnimationFrame', 'then', 'addEventListener')")}""",
    "react/no-async-effect": f"""{_CALL} AND ends_with(x.file, 'x') AND (x.name = 'useEffect' AND {_has('x', f"i.type = 'AwaitExpression' OR {_a('i', 'async')} = 'true' OR i.name = 'then'")} AND NOT {_has('x', "i.role = 'returned' AND i.type = 'ArrowFunctionExpression'")}
      OR x.name = 'useCallback' AND {_has('x', _a('i', 'async') + " = 'true'")})""",
    "react/hook-count": f"{_COMPONENT} AND (SELECT count(*) FROM n h WHERE h.file = x.file AND h.s >= x.s AND h.e <= x.e AND h.type = 'CallExpression' AND regexp_matches(h.name, '^use[A-Z]')) >= 7",
    "react/single-component-export": f"{_COMPONENT} AND coalesce({_a('x', 'compound')}, '') <> 'true' AND (SELECT count(*) FROM n y WHERE y.file = x.file AND y.s < x.s AND {_COMPONENT.replace('x.', 'y.')} AND coalesce({_a('y', 'compound')}, '') <> 'true') = 1",
    "style/no-raw-primitives": f"{_UNSTYLED} AND (x.type = 'JSXOpeningElement' AND x.name IN ({_LIST(perfile.RAW)}) OR {_a('x', 'source')} = 'react-native' AND (x.type = 'ExportAllDeclaration' OR x.type = 'ImportSpecifier' AND x.name IN ({_LIST(perfile.PRIMITIVES)})))",
    "style/no-inline-color": f"(x.type = 'Property' OR x.type = 'JSXAttribute' AND x.name IN ('c', 'bg', 'color')) AND regexp_matches({_a('x', 'value')}, '{_COLOR}')",
    "style/no-inline-font-size": f"{_UNSTYLED} AND x.type IN ('Property', 'JSXAttribute') AND x.name = 'fontSize'",
    "style/no-inline-style-prop": f"{_UNSTYLED} AND x.type = 'JSXAttribute' AND x.name = 'style' AND {_has('x', "i.type = 'ObjectExpression'")}",
    "style/no-arbitrary-class-values": f"x.type IN ('Literal', 'TemplateElement') AND (regexp_matches({_a('x', 'value')}, '(^| )[a-z-]+-\\[[^\\]]+\\]') OR regexp_matches({_a('x', 'value')}, '(^| )text-(xs|sm|base|lg|xl|[2-9]xl)( |$)'))",
    "style/vendor-component-containment": f"{_UNSTYLED} AND {_a('x', 'source')} = '@mantine/core' AND (x.type = 'ExportAllDeclaration' OR x.type IN ('ImportSpecifier', 'ExportSpecifier') AND x.name = 'Textarea')",
    "testing/no-module-mocking": f"{_CALL} AND {_a('x', 'shadowed')} = 'false' AND regexp_matches({_a('x', 'callee')}, '^(vi|jest)[.](mock|doMock|unstable_mockModule)$')",
    "types/no-chained-type-assertions": f"x.type = 'TSAsExpression' AND NOT EXISTS (SELECT 1 FROM n p WHERE p.file = x.file AND p.id = x.parent AND p.type = 'TSAsExpression') AND EXISTS (SELECT 1 FROM n c WHERE c.file = x.file AND c.parent = x.id AND c.type = 'TSAsExpression' AND ({_a('c', 'to')} <> 'const' OR {_a('x', 'to')} <> 'const'))",
    "types/no-conditional-empty-object-spread": f"x.type = 'ConditionalExpression' AND x.role = 'argument' AND EXISTS (SELECT 1 FROM n p WHERE p.file = x.file AND p.id = x.parent AND p.type = 'SpreadElement') AND EXISTS (SELECT 1 FROM n c WHERE c.file = x.file AND c.parent = x.id AND c.role IN ('consequent', 'alternate') AND c.type = 'ObjectExpression' AND {_a('c', 'empty')} = 'true')",
    "types/no-reflect-access": f"{_a('x', 'callee')} IN ('Reflect.get', 'Reflect.apply') AND {_a('x', 'shadowed')} = 'false'",
    "types/no-type-argument-assertion": f"{_CALL} AND x.name IN ({_LIST(perfile.DATA_CALLS)}) AND len(list_filter(string_split({_a('x', 'type_arguments')}, ','), lambda t: trim(t) <> 'unknown')) > 0",
    "types/require-safety-comment": f"x.type = 'TSAsExpression' AND {_a('x', 'to')} <> 'const' AND NOT EXISTS (SELECT 1 FROM ({_values(NOTES)}) c(file, s, e, body) WHERE c.file = x.file AND contains(body, 'SAFETY:') AND c.s >= CAST({_a('x', 'statement_gap')} AS INT) AND c.s < x.s)",
    "boundary/ambient-globals": f"""coalesce({_a('x', 'shadowed')}, '') <> 'true' AND (regexp_matches({_a('x', 'path')}, '^(process[.]env|import[.]meta[.]env)([.]|$)') AND x.stem NOT IN ('env.server', 'env.client', 'env')
      OR {_a('x', 'path')} = 'fetch' AND x.stem <> 'infrastructure/api-client' OR starts_with({_a('x', 'path')}, 'localStorage') AND x.stem <> 'infrastructure/browser-storage')""",
    "placement/no-plain-export-in-server-fn-module": f"""{_a('x', 'exported')} = 'true' AND coalesce({_a('x', 'type_only')}, '') <> 'true' AND EXISTS (SELECT 1 FROM n d WHERE d.file = x.file AND d.type = 'CallExpression' AND d.name = 'createServerFn')
      AND (NOT {_has('x', "i.type = 'CallExpression' AND i.name = 'createServerFn'")} OR {_a('x', 'default')} = 'true')""",
}
ONCE = ("effect/no-effect-catchallcause", "effect/no-service-option", "placement/server-fn-placement", "boundary/ambient-globals")  # one finding a place


def query_name(rule: str) -> str:
    return "rule_" + rule.replace("/", "_").replace("-", "_")


for _rule, _condition in SYNTAX.items():
    case(query_name(_rule), f"{N} SELECT {'DISTINCT ' if _rule in ONCE else ''}x.file, x.s AS start FROM n x WHERE {_condition}", lambda spark, r=_rule: perfile.RULES[r](_syntax(spark)).select("file", "start"))
case(
    query_name("react/prop-count"),
    N.replace("WITH n", "WITH RECURSIVE n") + f""", d AS (SELECT * FROM n WHERE type IN ('TSTypeLiteral', 'TSInterfaceDeclaration', 'TSTypeAliasDeclaration') AND name IS NOT NULL),
    named AS (SELECT d.file, d.name AS a, r.name AS b FROM d JOIN n r ON r.file = d.file AND r.s >= d.s AND r.e <= d.e AND r.id <> d.id WHERE r.type = 'TSTypeReference' AND r.role IN ('heritage', 'intersection', 'aliased')),
    r(file, head, name) AS (SELECT file, name, name FROM d WHERE {_a('d', 'props')} = 'true' AND ends_with(file, 'x') UNION SELECT r.file, head, b FROM r JOIN named ON named.file = r.file AND a = r.name)
    SELECT h.file, h.s AS start FROM r JOIN d ON d.file = r.file AND d.name = r.name JOIN n p ON p.file = d.file AND p.s >= d.s AND p.e <= d.e AND p.role = 'prop' AND p.name <> 'children' JOIN d h ON h.file = r.file AND h.name = head GROUP BY h.file, h.s HAVING count(DISTINCT p.name) >= 8""",
    lambda spark: perfile.RULES["react/prop-count"](_syntax(spark)).select("file", "start"),
)
#: A parser's bare nodes of: const [x, setX] = useState(1); return db.insert(a).values(b) as X; (process.env!).KEY; vi.mock(p)
BARE = [
    (1, 0, None, "Program", 0, 200, None), (2, 1, "body", "VariableDeclaration", 0, 30, None), (3, 2, "declarations", "VariableDeclarator", 6, 29, None), (4, 3, "id", "ArrayPattern", 6, 15, None), (5, 4, "element", "Identifier", 7, 8, "x"), (6, 4, "element", "Identifier", 10, 14, "setX"),
    (7, 3, "init", "CallExpression", 18, 29, None), (8, 7, "callee", "Identifier", 18, 26, "useState"), (9, 1, "body", "ReturnStatement", 31, 80, None), (10, 9, "argument", "TSAsExpression", 38, 79, None), (11, 10, "expression", "CallExpression", 38, 74, None), (12, 11, "callee", "MemberExpression", 38, 60, "values"),
    (13, 12, "object", "CallExpression", 38, 53, None), (14, 13, "callee", "MemberExpression", 38, 47, "insert"), (15, 14, "object", "Identifier", 38, 40, "db"), (16, 1, "body", "ExpressionStatement", 90, 120, None), (17, 16, "expression", "MemberExpression", 90, 119, "KEY"), (18, 17, "object", "ParenthesizedExpression", 90, 105, None),
    (19, 18, "expression", "TSNonNullExpression", 91, 104, None), (20, 19, "expression", "MemberExpression", 91, 103, "env"), (21, 20, "object", "Identifier", 91, 98, "process"), (22, 1, "body", "ExpressionStatement", 130, 140, None), (23, 22, "expression", "CallExpression", 130, 139, None), (24, 23, "callee", "MemberExpression", 130, 137, "mock"),
    (25, 24, "object", "Identifier", 130, 132, "vi"), (26, 9, "argument", "ObjectExpression", 75, 77, None), (27, 22, "expression", "TSAsExpression", 131, 139, None),
]
RESOLVED = [("a.ts", 25, True), ("a.ts", 21, False), ("a.ts", 15, False)]


def _derived(spark: SparkSession) -> DataFrame:
    bare = spark.createDataFrame([("a.ts", i, p, r, k, s, e, n, {}) for i, p, r, k, s, e, n in BARE], perfile.NODE)
    return derive.derived(bare, spark.createDataFrame(RESOLVED, "file string, node_id long, resolved boolean"))


case(
    "derived_attributes",
    f"""WITH RECURSIVE n AS (SELECT * FROM ({_values(BARE)}) t(id, parent, role, type, s, e, name)), up(id, chain, pure, root) AS (SELECT id, name, true, id FROM n WHERE type = 'Identifier'
      UNION ALL SELECT p.id, up.chain || CASE WHEN c.role = 'object' THEN ',' || p.name ELSE '' END, up.pure AND p.type <> 'CallExpression', up.root FROM up JOIN n c ON c.id = up.id JOIN n p ON p.id = c.parent
        WHERE c.role = 'object' AND p.type = 'MemberExpression' OR c.role = 'callee' AND p.type = 'CallExpression' OR c.role = 'expression' AND p.type IN ('TSAsExpression', 'TSNonNullExpression', 'ParenthesizedExpression')),
    calls AS (SELECT c.parent AS id, chain, CASE WHEN pure THEN replace(chain, ',', '.') END AS callee, root FROM n c JOIN up ON up.id = c.id WHERE c.role = 'callee'),
    gaps AS (SELECT c.id, arg_max(coalesce((SELECT max(b.e) FROM n b WHERE b.parent = st.parent AND b.e <= st.s AND regexp_matches(b.type, '(Statement|Declaration)$')), 0), st.s) AS gap FROM n c JOIN n st ON c.s >= st.s AND c.e <= st.e AND regexp_matches(st.type, '(Statement|Declaration)$') WHERE c.type = 'TSAsExpression' GROUP BY c.id)
    SELECT n.id AS node_id, coalesce(n.name, CASE WHEN n.type = 'CallExpression' THEN string_split(calls.chain, ',')[-1] END) AS name, callee, calls.chain, CASE WHEN n.type IN ('MemberExpression', 'Identifier') AND up.pure THEN replace(up.chain, ',', '.') END AS path,
      CASE WHEN 25 IN (calls.root, CASE WHEN n.type IN ('MemberExpression', 'Identifier') AND up.pure THEN up.root END) THEN 'true' END AS shadowed, CASE WHEN n.id = 3 THEN 'useState' END AS init, CASE WHEN n.id = 3 THEN 'setX' END AS setter, CAST(gap AS VARCHAR) AS statement_gap, CASE WHEN n.id = 3 THEN 'true' END AS module_level, CASE WHEN n.id = 26 THEN 'true' END AS empty
    FROM n LEFT JOIN calls ON calls.id = n.id LEFT JOIN up ON up.id = n.id LEFT JOIN gaps ON gaps.id = n.id""",
    lambda spark: _derived(spark).select("node_id", "name", *[F.col("attrs")[k].alias(k) for k in ("callee", "chain", "path", "shadowed", "init", "setter", "statement_gap", "module_level", "empty")]),
)
case(
    query_name("health/no-nested-ternary"),
    f"{N} SELECT c.file, c.s AS start FROM n c JOIN n b ON b.file = c.file AND c.s >= b.s AND c.e <= b.e AND b.role IN ('consequent', 'alternate') JOIN n p ON p.file = b.file AND p.id = b.parent AND p.type = 'ConditionalExpression' WHERE c.type = 'ConditionalExpression' GROUP BY c.file, c.id, c.s HAVING count(*) > 1",
    lambda spark: perfile.RULES["health/no-nested-ternary"](_syntax(spark)).select("file", "start"),
)

# Rules over imports. Two trees: what holds in one must not leak into the other.

#: tree_root, source_path, specifier, target_path, package, type_only
IMPORTS = [
    ("src", "features/a/index.ts", "./index.server", "features/a/index.server.ts", None, False), ("src", "features/a/ui/view.tsx", "@/features/b/index.server", "features/b/index.server.ts", None, False), ("src", "features/a/service/x.ts", "@/features/b/index.server", "features/b/index.server.ts", None, False),
    ("src", "features/a/ui/view.tsx", "@/infrastructure/db/client", "infrastructure/db/client.ts", None, False), ("src", "features/a/ui/view.tsx", "@/infrastructure/auth/client", "infrastructure/auth/client.ts", None, False), ("src", "features/a/repo/r.ts", "@/infrastructure/db", "infrastructure/db/index.ts", None, False),
    ("src", "features/a/ui/view.tsx", "./view.test", "features/a/ui/view.test.tsx", None, False), ("src", "features/a/ui/view.tsx", "../__tests__/tools", "features/a/__tests__/tools.ts", None, False), ("src", "features/a/ui/view.tsx", "@/components/old", "components/old.ts", None, False), ("src", "features/a/ui/view.tsx", "@/componentsx/new", "componentsx/new.ts", None, False),
    ("src", "routes/home.tsx", "@/env.server", "env.server.ts", None, False), ("src", "routes/home.tsx", "@/infrastructure/db", "infrastructure/db/index.ts", None, False), ("src", "routes/home.tsx", "@/features/b/ui/card", "features/b/ui/card.tsx", None, False), ("src", "infrastructure/payments/pay.ts", "stripe", None, "stripe", False), ("src", "features/a/ui/view.tsx", "stripe", None, "stripe", True),
    ("src", "infrastructure/mail.ts", "@/features/a", "features/a/index.ts", None, False), ("src", "infrastructure/mail.ts", "@/domains/m", "domains/m/index.ts", None, True), ("src", "infrastructure/mail.ts", "@/shared/x", "shared/x.ts", None, False), ("src", "stray/q.ts", "@/shared/x", "shared/x.ts", None, False),
    ("src", "features/a/service/x.ts", "../ui/view", "features/a/ui/view.tsx", None, False), ("src", "features/a/ui/view.tsx", "../service/x", "features/a/service/x.ts", None, False), ("src", "features/a/ui/view.tsx", "../repo/r", "features/a/repo/r.ts", None, False), ("src", "features/a/service/x.ts", "../index", "features/a/index.ts", None, False),
    ("src", "features/a/service/x.ts", "@/infrastructure/db/schema/t", "infrastructure/db/schema/t.ts", None, False), ("src", "features/a/ui/view.tsx", "../../b/service/y", "features/b/service/y.ts", None, False), ("src", "features/b/service/y.ts", "@/features/a", "features/a/index.ts", None, False), ("src", "features/a/ui/view.tsx", "@/features/c", "features/c/index.ts", None, False),
    ("src", "features/a/ui/view.tsx", "@/features/d", "features/d/index.ts", None, True), ("src", "domains/m/a.ts", "../n/b", "domains/n/b.ts", None, False), ("src", "domains/n/b.ts", "@/domains/m", "domains/m/index.ts", None, False), ("src", "domains/m/a.ts", "./self", "domains/m/self.ts", None, False),
    ("src", "domains/p/a.ts", "../q/b", "domains/q/b.ts", None, False), ("lib", "domains/q/b.ts", "../p/a", "domains/p/a.ts", None, False), ("lib", "features/a/ui/view.tsx", "../repo/r", "features/a/repo/r.ts", None, False), ("lib", "features/b/service/y.ts", "@/features/c", "features/c/index.ts", None, False),
    ("src", "features/b/index.ts", "./service/y", "features/b/service/y.ts", None, False), ("src", "features/b/service/y.ts", "node:fs", None, "node:fs", False), ("src", "domains/m/index.ts", "./a", "domains/m/a.ts", None, False), ("src", "features/e/service/k.ts", "@/features/b", "features/b/index.ts", None, False),
    ("src", "features/e/service/l.ts", "@/features/b", "features/b/index.ts", None, False), ("src", "features/e/service/m.ts", "../../b/index", "features/b/index.ts", None, False), ("src", "features/e/ui/n.tsx", "@/features/b", "features/b/index.ts", None, False),
]
IMPORT_ROWS = [(r, f"{r}/{s}", s, 10 * i, i, spec, spec.startswith("."), t, p, ty) for i, (r, s, spec, t, p, ty) in enumerate(IMPORTS)]
IMPORT_SCHEMA = "tree_root string, file string, source_path string, offset int, line int, specifier string, relative boolean, target_path string, package string, type_only boolean"
IMPORT_FILES = sorted({(r, s) for r, s, *_ in IMPORTS} | {("src", "features/a/controllers/c.ts"), ("src", "features/a/index.server.ts"), ("lib", "features/a/repo/r.ts")})


def _project(spark: SparkSession, files: list[tuple[str, str]] | None = None) -> structural.Facts:
    rows = [(f"{r}/{s}", "") for r, s in IMPORT_FILES] if files is None else files
    f = structural.Facts(tree.source_files(spark.createDataFrame(rows, "file string, text string"), [Tree("src"), Tree("lib")]))
    f.resolved = spark.createDataFrame(IMPORT_ROWS, IMPORT_SCHEMA)  # in place of the scan
    return f


def _stem(c: str) -> str:
    return f"regexp_replace({c}, '[.]([cm]?[jt]s|[jt]sx)$', '')"


def _profile(c: str) -> str:
    seg, n = lambda k: f"string_split({c}, '/')[{k}]", f"len(string_split({c}, '/'))"
    return f"""CASE WHEN {n} = 1 THEN 'source-root' WHEN {seg(1)} = 'routes' THEN 'route' WHEN {seg(1)} = 'features' AND {n} = 3 THEN CASE WHEN {seg(3)} IN ('index', 'index.server') THEN 'feature-barrel' ELSE 'feature-root' END
      WHEN {seg(1)} = 'features' AND {n} > 3 AND {seg(3)} IN ('ui', 'controllers', 'service', 'repo') THEN 'feature-' || {seg(3)} WHEN {seg(1)} = 'features' THEN NULL WHEN {seg(1)} = 'domains' THEN 'domain' WHEN {seg(1)} = 'infrastructure' THEN 'infrastructure'
      WHEN starts_with({c}, 'shared/ui/') THEN 'shared-ui' WHEN {seg(1)} = 'shared' THEN 'shared' END"""


def _area(c: str) -> str:
    return f"CASE WHEN package IS NOT NULL THEN 'package' WHEN {c} IN ('env.server', 'env') THEN 'env-server' WHEN {c} = 'env.client' THEN 'env-client' WHEN starts_with({c}, 'routes/') THEN 'route' WHEN starts_with({c}, 'features/') THEN 'feature' WHEN starts_with({c}, 'domains/') THEN 'domain' WHEN starts_with({c}, 'infrastructure/') THEN 'infrastructure' WHEN starts_with({c}, 'shared/ui/') THEN 'shared-ui' WHEN starts_with({c}, 'shared/') THEN 'shared' END"


def _unit(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^(features|domains)/[^/]+') THEN regexp_extract({c}, '^[a-z]+/[^/]+') WHEN starts_with({c}, 'shared/ui/') THEN 'shared/ui' WHEN regexp_matches({c}, '^(routes|infrastructure|shared)(/|$)') THEN regexp_extract({c}, '^[a-z]+') WHEN NOT contains({c}, '/') THEN '<root>' END"


def _layer(c: str) -> str:
    return f"nullif(regexp_extract({c}, '^features/[^/]+/(ui|controllers|service|repo)/', 1), '')"


def _name(c: str, top: str) -> str:
    return f"nullif(regexp_extract({c}, '^{top}/([^/]+)', 1), '')"


def edges_sql(rows: str, files: str) -> str:
    """The tables that the rules over imports ask, from two relations: resolved imports, and (tree_root, path) of all files."""
    return f"""raw AS (SELECT *, {_stem('source_path')} AS ss, {_stem('target_path')} AS ts FROM ({rows}) v(tree_root, file, source_path, "offset", line, specifier, relative, target_path, package, type_only)),
e AS (SELECT *, {_profile('ss')} AS profile, {_area('ts')} AS area, {_name('ss', 'features')} AS ff, {_name('ts', 'features')} AS tf, {_name('ss', 'domains')} AS fd, {_name('ts', 'domains')} AS td, {_layer('source_path')} AS fl, {_layer('target_path')} AS tl,
  ends_with(ss, '.server') OR coalesce({_profile('ss')} IN ('infrastructure', 'feature-controllers', 'feature-repo', 'feature-service'), false) AS server, regexp_matches(ss, '^(features|domains)/[^/]+/index$') AS client_barrel FROM raw),
rank(layer, k) AS (VALUES ('ui', 1), ('controllers', 2), ('service', 3), ('repo', 4)),
files(tree_root, path) AS ({files}),
verdicts AS (SELECT *, CASE WHEN profile IS NULL THEN 'unclassified-source' WHEN area IS NULL THEN 'unclassified-target' WHEN package IS NULL AND target_unit = source_unit THEN 'internal' WHEN profile = 'domain' AND NOT type_only AND area NOT IN ('domain', 'shared') THEN 'impure-domain' WHEN surface = 'deny' THEN 'denied-direction'
    WHEN surface = 'any' OR ts IN (target_unit, target_unit || '/index', target_unit || '/index.server') OR surface = 'barrel-or-ui' AND starts_with(ts, target_unit || '/ui') THEN 'allowed' WHEN package IS NOT NULL AND surface = 'barrel' THEN 'allowed' ELSE 'denied-exposure' END AS verdict
  FROM (SELECT e.*, {_unit('ss')} AS source_unit, coalesce(package, {_unit('ts')}) AS target_unit, surface FROM e LEFT JOIN ({_values(policy.ROWS)}) p(p_profile, p_area, surface) ON p_profile = profile AND p_area = area))"""


E = f"WITH {edges_sql(_values(IMPORT_ROWS), _values(IMPORT_FILES))}"
_DB = "(ts = 'infrastructure/db' OR starts_with(ts, 'infrastructure/db/'))"
IMPORT_RULES = {
    "api/barrel-direction": "SELECT file, \"offset\" AS start FROM e WHERE client_barrel AND ends_with(ts, '/index.server')",
    "api/server-import-context": "SELECT file, \"offset\" AS start FROM e WHERE ends_with(ts, '/index.server') AND NOT server AND NOT client_barrel",
    "boundary/client-server-infra": "SELECT file, \"offset\" AS start FROM e WHERE area = 'infrastructure' AND NOT server AND ts NOT IN ('infrastructure/auth/client', 'infrastructure/providers/query-client')",
    "boundary/db-isolation": f"SELECT file, \"offset\" AS start FROM e WHERE {_DB} AND coalesce(profile, '') NOT IN ('infrastructure', 'feature-repo', 'feature-controllers')",
    "boundary/no-test-imports": "SELECT file, \"offset\" AS start FROM e WHERE ends_with(specifier, '.test') OR contains('/' || specifier, '/__tests__/')",
    "boundary/route-thinness": f"SELECT file, \"offset\" AS start FROM e WHERE profile = 'route' AND ({_DB} OR area = 'env-server')",
    "boundary/sdk-containment": f"SELECT file, \"offset\" AS start FROM e JOIN ({_values(list(policy.OWNERS.items()))}) o(p, owner) ON p = package WHERE NOT (ss = owner OR starts_with(ss, owner || '/'))",
    "boundary/server-no-upward": "SELECT file, \"offset\" AS start FROM e WHERE profile = 'infrastructure' AND area IN ('feature', 'domain', 'route')",
    "placement/deprecated-paths": "SELECT file, \"offset\" AS start FROM e WHERE starts_with(specifier, '@/components/')",
    "boundary/import-policy": "SELECT file, min(\"offset\") AS start FROM verdicts WHERE NOT relative AND verdict = 'unclassified-source' GROUP BY file UNION ALL SELECT file, \"offset\" AS start FROM verdicts WHERE NOT relative AND verdict NOT IN ('allowed', 'internal', 'unclassified-source')",
}
for _rule, _sql in IMPORT_RULES.items():
    case(query_name(_rule), f"{E} {_sql}", lambda spark, r=_rule: perfile.RULES[r](perfile.Syntax(_project(spark))).select("file", "start"))

TREE_RULES = {
    "boundary/import-policy": """SELECT DISTINCT 'error' AS severity, file, CAST(NULL AS INT) AS line FROM verdicts WHERE relative AND target_path IS NOT NULL AND verdict = 'unclassified-source'
      UNION ALL SELECT 'error', file, line FROM verdicts WHERE relative AND target_path IS NOT NULL AND verdict NOT IN ('internal', 'unclassified-source')""",
    "placement/layer-direction": """SELECT 'error' AS severity, file, line FROM e JOIN rank a ON a.layer = fl JOIN rank b ON b.layer = tl WHERE ff = tf AND b.k < a.k
      UNION ALL SELECT 'error', file, line FROM e WHERE ff = tf AND fl IS NOT NULL AND regexp_matches(ts, '^(features|domains)/[^/]+/index([.]server)?$')""",
    "boundary/layer-occupancy": f"""SELECT 'error' AS severity, file, line FROM e JOIN rank a ON a.layer = fl JOIN rank b ON b.layer = tl WHERE ff = tf AND EXISTS (SELECT 1 FROM files f JOIN rank m ON m.layer = {_layer('f.path')} WHERE f.tree_root = e.tree_root AND {_name('f.path', 'features')} = ff AND m.k > a.k AND m.k < b.k)
      UNION ALL SELECT 'error', file, line FROM e WHERE fl <> 'repo' AND starts_with(ts, 'infrastructure/db/schema/') AND EXISTS (SELECT 1 FROM files f WHERE f.tree_root = e.tree_root AND {_name('f.path', 'features')} = ff AND {_layer('f.path')} = 'repo')""",
    "graph/domain-cycles": """SELECT 'error' AS severity, tree_root || '/domains/' || min(a) AS file, CAST(NULL AS INT) AS line FROM (
      SELECT DISTINCT e.tree_root, e.fd AS a, least(e.fd, e.td) AS ring FROM e JOIN e b ON b.tree_root = e.tree_root AND b.fd = e.td AND b.td = e.fd WHERE e.fd <> e.td) GROUP BY tree_root, ring""",
    "graph/feature-deps": """SELECT 'error' AS severity, tree_root || '/features/' || min(a) AS file, CAST(NULL AS INT) AS line FROM (SELECT DISTINCT e.tree_root, e.ff AS a, least(e.ff, e.tf) AS ring FROM e JOIN e b ON b.tree_root = e.tree_root AND b.ff = e.tf AND b.tf = e.ff WHERE e.ff <> e.tf) GROUP BY tree_root, ring
      UNION ALL SELECT 'warning', tree_root || '/features/' || ff, NULL FROM e WHERE ff <> tf GROUP BY tree_root, ff, tf HAVING count(DISTINCT file) > 3
      UNION ALL SELECT 'warning', tree_root || '/features/' || ff, NULL FROM e WHERE ff <> tf GROUP BY tree_root, ff HAVING count(DISTINCT tf) > 2
      UNION ALL SELECT 'warning', tree_root || '/features', NULL FROM (SELECT DISTINCT tree_root, ff, tf FROM e WHERE ff <> tf) GROUP BY tree_root HAVING count(*) > 4""",
}
for _rule, _sql in TREE_RULES.items():
    case(query_name(_rule) + ("_tree" if _rule in IMPORT_RULES else ""), f"{E} {_sql}", lambda spark, r=_rule: structural.CHECKS[r](_project(spark)).select("severity", "file", "line"))

VISIBLE = [("src/features/b/visibility.json", "b", '{"e": "lists", "zz": "nobody"}'), ("lib/features/b/visibility.json", "b", '{"a": "in the other tree"}'), ("src/features/c/visibility.json", "c", '{"a": ""}'), ("src/features/d/visibility.json", "d", "42"), ("src/features/a/visibility.json", "a", '{"b": "totals"}')]


def _visibility(spark: SparkSession) -> DataFrame:
    f = _project(spark)
    f.visibility = spark.createDataFrame(VISIBLE, "file string, feature string, body string")
    return structural.feature_visibility(f).select("severity", "file", "line")


case(
    query_name("api/feature-visibility"),
    f"""{E}, v AS (SELECT *, string_split(file, '/')[1] AS tree_root, CASE WHEN json_type(body) = 'OBJECT' AND len(list_filter(json_keys(body), lambda k: trim(json_extract_string(body, '$.' || k)) = '')) = 0 THEN json_keys(body) END AS importers FROM ({_values(VISIBLE)}) t(file, feature, body)),
    g AS (SELECT file, tree_root, feature, unnest(importers) AS importer FROM v WHERE importers IS NOT NULL), p AS (SELECT DISTINCT tree_root, ff AS importer, tf AS feature FROM e WHERE ff <> tf)
    SELECT DISTINCT 'error' AS severity, tree_root || '/features/' || feature || '/visibility.json' AS file, CAST(NULL AS INT) AS line FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.tree_root = p.tree_root AND g.feature = p.feature AND g.importer = p.importer)
    UNION ALL SELECT 'error', file, NULL FROM v WHERE importers IS NULL
    UNION ALL SELECT 'warning', file, NULL FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.tree_root = g.tree_root AND p.feature = g.feature AND p.importer = g.importer)""",
    _visibility,
)
case(
    query_name("api/barrel-purity"),
    f"""WITH RECURSIVE raw AS (SELECT * FROM ({_values(IMPORT_ROWS)}) v(tree_root, file, source_path, "offset", line, specifier, relative, target_path, package, type_only) WHERE NOT type_only),
    r(start, node, depth) AS (SELECT DISTINCT tree_root || '/' || path, tree_root || '/' || path, 0 FROM ({_values(IMPORT_FILES)}) f(tree_root, path) WHERE regexp_matches(path, '^(features|domains)/[^/]+/index[.]ts$')
      UNION SELECT start, tree_root || '/' || target_path, depth + 1 FROM r JOIN raw ON file = node WHERE target_path IS NOT NULL AND depth < 7), near AS (SELECT start, node, min(depth) AS depth FROM r GROUP BY start, node)
    SELECT DISTINCT 'error' AS severity, start AS file, specifier FROM near JOIN raw ON file = node WHERE depth <= 6 AND (starts_with(specifier, 'node:') OR package IN ('drizzle-orm', 'postgres', 'pg', 'stripe', 'better-auth'))""",
    lambda spark: structural.barrel_purity(_project(spark)).where(~F.col("message").contains("deeper")).select("severity", "file", F.regexp_extract("message", "reaches (\\S+) through", 1).alias("specifier")).distinct(),
)

# Rules over whole files.

SIZES = [("src/shared/big.ts", 616), ("src/shared/long.mts", 525), ("src/shared/fits.ts", 500), ("src/shared/just.ts", 501), ("src/shared/edge.ts", 600), ("lib/shared/big.tsx", 612), ("other/z.ts", 900), ("src/shared/a.md", 900)]


def _sized(spark: SparkSession) -> DataFrame:
    files = spark.createDataFrame(SIZES, "file string, n int").select("file", F.expr("repeat('x\n', n)").alias("text"))
    return structural.file_size(structural.Facts(tree.source_files(files, [Tree("src"), Tree("lib")]))).select("severity", "file", "message")


case(
    query_name("health/file-size"),
    f"SELECT CASE WHEN n > 600 THEN 'error' ELSE 'warning' END AS severity, file, n || ' lines; split the file' AS message FROM ({_values(SIZES)}) t(file, n) WHERE n > 500 AND regexp_matches(file, '^(src|lib)/.*[.]([cm]?[jt]s|[jt]sx)$')",
    _sized,
)
DOCS = [("docs/a.md", 160), ("docs/fit.md", 70), ("docs/snug.md", 69), ("docs/empty.md", 0)]
MANIFESTS = [("docs/one.json", '{"docs/a.md": 100, "docs/fit.md": 74, "docs/snug.md": 74, "docs/none.md": 200}'), ("docs/two.json", '{"docs/fit.md": "600", "docs/a.md": 0, "docs/snug.md": 69.5}'), ("docs/bad.json", "[1]"), ("docs/worse.json", "{"), ("docs/void.json", "{}")]


def _budgets(spark: SparkSession) -> DataFrame:
    files = spark.createDataFrame(DOCS, "file string, n int").select("file", F.expr("repeat('w ', n)").alias("text"))
    f = structural.Facts(tree.source_files(files.select("file", "text"), [Tree("src")]), files=files, budgets=jsons.budgets(spark.createDataFrame(MANIFESTS, "file string, text string")))
    return structural.doc_budgets(f).select("severity", "file")


case(
    query_name("health/doc-budgets"),
    f"""WITH m AS (SELECT * FROM ({_values(MANIFESTS)}) t(manifest, body)), ok AS (SELECT manifest, body FROM m WHERE json_valid(body) AND CASE WHEN json_valid(body) THEN json_type(body) END = 'OBJECT'),
    b AS (SELECT manifest, path, json_extract(body, '$."' || path || '"') AS c FROM (SELECT manifest, body, unnest(json_keys(body)) AS path FROM ok)), d AS (SELECT * FROM ({_values(DOCS)}) t(path, words)),
    j AS (SELECT manifest, b.path, CASE WHEN regexp_matches(CAST(c AS VARCHAR), '^[0-9]+$') AND CAST(c AS VARCHAR) <> '0' THEN CAST(CAST(c AS VARCHAR) AS INT) END AS ceiling, words FROM b LEFT JOIN d ON d.path = b.path)
    SELECT 'error' AS severity, manifest AS file FROM m WHERE manifest NOT IN (SELECT manifest FROM ok) UNION ALL SELECT 'error', manifest FROM j WHERE ceiling IS NULL
    UNION ALL SELECT 'error', path FROM j WHERE ceiling IS NOT NULL AND (words IS NULL OR words > ceiling OR ceiling > ceil(words * 1.05))""",
    _budgets,
)
PLACES = ["src/features/a/ui/x.ts", "src/features/a/loose.ts", "src/features/a/errors.ts", "src/features/a/index.server.ts", "src/features/a/stray/s.ts", "src/features/x.ts", "src/domains/x.ts", "src/domains/m/deep/x.ts", "src/stray/q.ts", "src/loose.ts", "src/router.tsx", "src/env.client.ts", "src/shared/ui/b.tsx", "src/stray/q.test.ts", "src/gen/api.ts", "other/x.ts"]


def _sources(spark: SparkSession, files: list[str] | list[tuple[str, str]]) -> structural.Facts:
    rows = [f if isinstance(f, tuple) else (f, "") for f in files]
    df = spark.createDataFrame(rows, "file string, text string")
    return structural.Facts(tree.source_files(df, [Tree("src")]), files=df)


case(
    query_name("placement/topology"),
    f"""WITH f AS (SELECT file, substr(file, 5) AS p, string_split(substr(file, 5), '/') AS s, {_stem('substr(file, 5)')} AS stem FROM ({_values([(p,) for p in PLACES])}) t(file) WHERE starts_with(file, 'src/') AND NOT regexp_matches(file, '[.]test[.]|/gen/'))
    SELECT 'error' AS severity, file FROM f WHERE CASE WHEN len(s) = 1 THEN stem NOT IN ('router', 'client', 'server', 'routeTree.gen', 'env.server', 'env.client', 'env') WHEN s[1] NOT IN ('routes', 'features', 'domains', 'infrastructure', 'shared') THEN true
      WHEN s[1] NOT IN ('features', 'domains') THEN false WHEN len(s) = 2 THEN true WHEN s[1] = 'domains' THEN false WHEN len(s) = 3 THEN string_split(stem, '/')[3] NOT IN ('index', 'index.server', 'errors') ELSE s[3] NOT IN ('ui', 'controllers', 'service', 'repo') END""",
    lambda spark: structural.topology(_sources(spark, PLACES)).select("severity", "file"),
)
MIRRORED = ["src/shared/a.ts", "src/shared/a.test.ts", "src/shared/a.slow.test.ts", "src/shared/gone.test.tsx", "src/shared/b.spec.ts", "src/shared/test_c.ts", "src/shared/latest_c.ts", "src/shared/d.tsx", "src/shared/d.test.ts", "src/shared/e.slow.test.ts"]
case(
    query_name("naming/test-file-mirror"),
    f"""WITH f AS (SELECT file, {_stem('file')} AS stem FROM ({_values([(p,) for p in MIRRORED])}) t(file))
    SELECT 'warning' AS severity, file FROM f WHERE ends_with(stem, '.test') AND NOT EXISTS (SELECT 1 FROM f m WHERE NOT ends_with(m.stem, '.test') AND m.stem IN (left(f.stem, -5), regexp_replace(left(f.stem, -5), '[.][^./]*$', '')))
    UNION ALL SELECT 'warning', file FROM f WHERE ends_with(stem, '.spec') OR regexp_matches(file, '/test_[^/]*$')""",
    lambda spark: structural.test_file_mirror(_sources(spark, MIRRORED)).select("severity", "file"),
)
EXPORTS = [("src/features/a/index.ts", 1, "wildcard", None, None), ("src/features/a/index.ts", 2, "named", "z", "y"), ("src/features/a/index.ts", 3, "named", "y", "y"), ("src/features/a/index.server.ts", 1, "wildcard", None, None), ("src/features/a/ui/x.ts", 1, "wildcard", None, None), ("src/domains/m/index.ts", 4, "named", "b", "a"), ("src/domains/m/index.ts", 5, "default", "default", None)]


def _discoverable(spark: SparkSession) -> DataFrame:
    f = _sources(spark, sorted({e[0] for e in EXPORTS}))
    f.exports = spark.createDataFrame(EXPORTS, "file string, line int, kind string, exported_name string, local_name string")  # in place of the scan
    return structural.barrel_discoverability(f).select("severity", "file", "line")


case(
    query_name("naming/barrel-discoverability"),
    f"SELECT 'error' AS severity, file, line FROM ({_values(EXPORTS)}) t(file, line, kind, e, l) WHERE regexp_matches(file, '^src/(features|domains)/[^/]+/index([.]server)?[.]ts$') AND (kind = 'wildcard' OR kind = 'named' AND e <> l)",
    _discoverable,
)
SHEETS = [("src/a.css", ".a{color:#fff; margin: 1em}"), ("src/b.css", ".b{font-size: 12px; color: var(--x)}"), ("src/styles.css", "a{color:#000}"), ("src/c.css", ".c{--c:#abc; background: rgb(1,2,3)}"), ("src/d.css", ".d{box-shadow: none}"), ("src/shadows.css", ".s{box-shadow: none}"), ("src/e.css", ".e{my-box-shadow: none}"), ("src/f.css", "/* color: #fff */ .f{ font-size: 90% }")]
SCRIPTS = [("src/shared/ui/x.tsx", "const a = { boxShadow: 1 };"), ("src/shared/ui/y.tsx", "const shadowRoot = 1;"), ("src/shared/ui/z.test.tsx", "boxShadow")]
case(
    query_name("style/css-tokens"),
    rf"""SELECT 'error' AS severity, file FROM (SELECT file, trim(unnest(regexp_extract_all(regexp_replace(body, '/[*].*?[*]/', '', 'g'), '([^;{{}}]*)[;}}]', 1))) AS d FROM ({_values(SHEETS)}) t(file, body) WHERE NOT ends_with(file, '/styles.css'))
    WHERE NOT starts_with(d, '--') AND contains(d, ':') AND (regexp_matches(d, '^font-size\s*:\s*[0-9.]+(px|rem|pt)\b') OR regexp_matches(d, '{_COLOR}'))""",
    lambda spark: structural.css_tokens(_sources(spark, SHEETS)).select("severity", "file"),
)
case(
    query_name("style/shadow-source"),
    f"""SELECT 'error' AS severity, file FROM ({_values(SHEETS)}) t(file, body) WHERE NOT ends_with(file, '/shadows.css') AND regexp_matches(body, '(^|[^A-Za-z0-9_-])box-shadow([^A-Za-z0-9_-]|$)')
    UNION ALL SELECT 'error', file FROM ({_values(SCRIPTS)}) t(file, body) WHERE NOT contains(file, '.test.') AND regexp_matches(body, '\\bboxShadow\\b')""",
    lambda spark: structural.shadow_source(_sources(spark, SHEETS + SCRIPTS)).select("severity", "file"),
)
STYLED = [("src/features/a/ui/p.tsx", "<B gap={16} p={7} />"), ("src/features/a/ui/q.tsx", '<B p="16px" radius="6" />'), ("src/features/a/ui/r.tsx", "x = { padding: 16, borderRadius: 6, margin: 6 }"), ("src/domains/m/s.ts", "x = { padding: 16 }"), ("src/shared/ui/theme.ts", "export const spacing = { md: '1rem', none: '0px' }; export const radius = { md: '6px', odd: '2em' };")]


def _equal(spark: SparkSession) -> DataFrame:
    f = _sources(spark, STYLED)
    theme = f.files.where("file = 'src/shared/ui/theme.ts'")
    f.theme, f.radii = jsons.scale(theme, "spacing"), jsons.scale(theme, "radius")
    return structural.token_equality(f).select("severity", "file", "message")


case(
    query_name("style/token-equality"),
    rf"""WITH t AS (SELECT * FROM ({_values(STYLED)}) t(file, body) WHERE NOT starts_with(file, 'src/domains/') AND file <> 'src/shared/ui/theme.ts'),
    said AS (SELECT file, 'spacing' AS kind, unnest(regexp_extract_all(body, '\b(?:gap|p)=(?:[{{]\d+[}}]|"\d+(?:px)?")|\b(?:padding|margin): *\d+\b')) AS s FROM t UNION ALL SELECT file, 'radius', unnest(regexp_extract_all(body, '\b(?:radius)="\d+"|\b(?:borderRadius): *\d+\b')) FROM t)
    SELECT 'error' AS severity, file, s || ' is the ' || kind || ' token ' || 'md' AS message FROM said WHERE CAST(regexp_extract(s, '\d+') AS INT) = CASE kind WHEN 'spacing' THEN 16 ELSE 6 END""",
    _equal,
)
PASSES = [("src/features/a/service/x.ts", "export function pass(a) { return b(a); }"), ("src/features/a/service/y.ts", "export async function work(a) { const c = 1; return c; }"), ("src/features/a/repo/z.ts", "export function pass(a) { return b(a); }"), ("src/features/a/controllers/w.ts", "export async function go(a) { return run(a); }"), ("src/features/a/controllers/v.ts", "function hidden(a) { return run(a); }")]
case(
    query_name("health/trampolines"),
    rf"""SELECT 'warning' AS severity, file FROM ({_values(PASSES)}) t(file, body) WHERE regexp_matches(file, '/(controllers|service)/') AND regexp_matches(body, '^export (async )?function') AND NOT regexp_matches(regexp_extract(body, '[{{](.*)[}}]', 1), '\b(const|let|var|if|for|while|switch|try|throw|catch)\b')""",
    lambda spark: structural.trampolines(_sources(spark, PASSES)).select("severity", "file"),
)

# Rules over type facts.

TYPE_NODES = [(1, "any", False, False), (2, "unknown", False, False), (3, "object", False, False), (4, "string", False, False), (5, "union", False, False), (6, "reference", False, False), (7, "dict", False, False), (8, "any", False, True), (9, "dict", True, False), (10, "array", True, False), (11, "dict", False, False)]
TYPE_CHILDREN = [(5, 2, "union"), (5, 4, "union"), (6, 5, "promise"), (10, 6, "array"), (7, 2, "property")]
INDEXES = [(7, 2), (9, 2), (11, 4)]
#: node_id, kind, start, end, name, type_id, function_id, symbol, guard_subject, in_guard, declared_here, empty
TYPE_SITES = [
    (1, "parameter", 0, 9, "x", 6, 1, "s", None, None, None, None), (2, "parameter", 0, 9, "x", 3, 1, "s", None, None, None, None), (3, "parameter", 0, 9, "cause", 1, 1, "s", None, None, None, None), (4, "parameter", 0, 9, "x", 1, 1, "s", True, None, None, None), (5, "parameter", 0, 9, "x", 8, 1, "s", None, None, None, None),
    (20, "parameter", 0, 9, "this", 1, 1, "s", None, None, None, None), (6, "return", 0, 9, "x", 10, 1, "s", None, None, None, None), (7, "return", 0, 9, "x", 7, 1, "s", None, None, None, None), (8, "alias", 0, 9, "x", 2, 1, "s", None, None, None, None), (9, "typeof", 0, 9, "x", 2, 1, "s", None, None, None, None),
    (10, "typeof", 0, 9, "x", 5, 1, "s", None, None, None, None), (11, "typeof", 0, 9, "x", 1, 1, "s", None, True, None, None), (12, "type_reference", 0, 50, "x", 7, 1, "s", None, None, None, None), (13, "type_reference", 10, 20, "x", 7, 1, "s", None, None, None, None), (14, "type_reference", 60, 70, "x", 9, 1, "s", None, None, None, None),
    (21, "type_reference", 80, 90, "x", 11, 1, "s", None, None, None, None), (22, "type_reference", 91, 95, "x", 7, 1, "s", None, None, True, None), (15, "annotated_literal", 0, 9, "x", 7, 1, "s", None, None, None, None), (16, "annotated_literal", 0, 9, "x", 3, 1, "s", None, None, None, True), (23, "annotated_literal", 0, 9, "x", 4, 1, "s", None, None, None, None),
    (17, "const_declaration", 0, 9, "x", 2, 1, "s", None, None, None, None), (18, "assertion", 0, 9, "x", 4, 1, "s", None, None, None, None), (19, "assertion", 0, 9, "x", 4, 2, "s", None, None, None, None),
]
TY = f"""WITH RECURSIVE n AS (SELECT * FROM ({_values(TYPE_NODES)}) t(id, flags, array_like, bad)), c AS (SELECT * FROM ({_values(TYPE_CHILDREN)}) t(id, child, edge)), x AS (SELECT * FROM ({_values(TYPE_SITES)}) t(id, kind, s, e, name, type, fn, symbol, subject, guarded, here, empty)),
broad(id) AS (SELECT id FROM n WHERE NOT bad AND flags IN ('any', 'unknown') UNION SELECT c.id FROM c JOIN broad b ON b.id = c.child JOIN n ON n.id = c.id WHERE edge IN ('union', 'array', 'promise') AND NOT bad),
open AS (SELECT id, flags FROM n WHERE NOT bad AND flags IN ('any', 'unknown', 'object')), dicts AS (SELECT t.id, v FROM ({_values(INDEXES)}) t(id, v) JOIN n ON n.id = t.id WHERE NOT array_like), opaque AS (SELECT id FROM dicts WHERE v IN (SELECT id FROM open))"""
TYPE_RULES = {
    "types/no-broad-parameters": "kind = 'parameter' AND name <> 'this' AND NOT coalesce(subject, false) AND (name <> 'cause' AND type IN (SELECT id FROM broad) OR type IN (SELECT id FROM open WHERE flags = 'object'))",
    "types/no-unknown-returns": "kind = 'return' AND type IN (SELECT id FROM broad)",
    "types/no-unknown-type-aliases": "kind = 'alias' AND type IN (SELECT id FROM broad)",
    "types/no-runtime-typeof": "kind = 'typeof' AND NOT coalesce(guarded, false) AND type IN (SELECT id FROM open)",
    "types/no-opaque-record": "kind = 'type_reference' AND NOT coalesce(here, false) AND type IN (SELECT id FROM opaque) AND NOT EXISTS (SELECT 1 FROM x o WHERE o.kind = 'type_reference' AND NOT coalesce(o.here, false) AND o.type IN (SELECT id FROM opaque) AND o.id <> x.id AND o.s <= x.s AND o.e >= x.e)",
    "types/no-known-value-widening": "kind = 'annotated_literal' AND NOT coalesce(empty, false) AND (type IN (SELECT id FROM open) OR type IN (SELECT id FROM dicts))",
    "types/no-widen-then-assert": "kind = 'assertion' AND EXISTS (SELECT 1 FROM x d WHERE d.kind = 'const_declaration' AND d.symbol = x.symbol AND d.fn = x.fn AND d.type IN (SELECT id FROM open))",
}


def _types(spark: SparkSession) -> types.Types:
    sites = spark.createDataFrame([("f.ts", *s) for s in TYPE_SITES], types.SITE)
    return types.Types(sites, spark.createDataFrame(TYPE_NODES, "type_id long, flags string, array_like boolean, is_error boolean"), spark.createDataFrame(TYPE_CHILDREN, "type_id long, child long, edge string"), spark.createDataFrame(INDEXES, "type_id long, value_type_id long"))


for _rule, _sql in TYPE_RULES.items():
    case(query_name(_rule), f"{TY} SELECT 'f.ts' AS file, s AS start FROM x WHERE {_sql}", lambda spark, r=_rule: types.CHECKS[r](_types(spark)).select("file", "start"))

# Shared definitions.

PATHS = ["features/a/ui/x.test.ts", "test/a.ts", "a/test/b.ts", "a/__tests__/c.ts", "a/latest.ts", "a/x.gen.ts", "a/x.d.ts", "scripts/run.ts", "gen/x.ts", "agen/x.ts", "a/b.tsx", "a/b.ts", "a/b.server.ts", "features/a/service/x.ts", "features/a/ui/x.ts", "features/a/index.ts", "domains/m/index.server.ts", "features/index.ts", "infrastructure/x.ts", "infrastructurex/y.ts", "a/icon.svg", "a/icon.svg?url", "a/svg"]
case(
    "path_predicates",
    rf"""SELECT p AS path, regexp_matches(p, '[.]test[.]([cm]?[jt]s|[jt]sx)$|^test/|(^|/)__tests__/') AS test, regexp_matches({_stem('p')}, '[.](gen|d)$') OR regexp_matches(p, '(^|/)(scripts|gen)/') AS unauthored,
      regexp_matches(p, '[.][jt]sx$') AS component, regexp_matches({_stem('p')}, '^(features|domains)/[^/]+/index([.]server)?$') AS barrel, ends_with({_stem('p')}, '.server') OR regexp_matches(p, '^infrastructure/|^features/[^/]+/(controllers|repo|service)/.') AS server,
      p = 'infrastructure' OR starts_with(p, 'infrastructure/') AS under, regexp_matches(p, '[.](css|scss|svg|png|jpg|jpeg|gif|webp|avif|woff|woff2|ttf|otf)([?].*)?$') AS asset, ends_with({_stem('p')}, '.test') OR regexp_matches(p, '(^|/)__tests__/') AS names_test, {_stem('p')} AS stem FROM ({_values([(p,) for p in PATHS])}) t(p)""",
    lambda spark: spark.createDataFrame([(p,) for p in PATHS], "path string").select(
        "path", paths.is_test(F.col("path")).alias("test"), paths.is_unauthored(F.col("path")).alias("unauthored"), paths.is_component(F.col("path")).alias("component"), paths.is_barrel(F.col("path")).alias("barrel"), paths.is_server_context(F.col("path")).alias("server"),
        paths.under(F.col("path"), "infrastructure").alias("under"), paths.is_asset(F.col("path")).alias("asset"), paths.names_test(F.col("path")).alias("names_test"), paths.stem(F.col("path")).alias("stem")),
)
SPECIFIERS = [("lodash",), ("lodash/fp",), ("@scope/pkg",), ("@scope/pkg/deep/x",), ("node:fs",)]
case("package_names", f"SELECT s, CASE WHEN starts_with(s, '@') THEN string_split(s, '/')[1] || '/' || string_split(s, '/')[2] ELSE string_split(s, '/')[1] END AS package FROM ({_values(SPECIFIERS)}) t(s)", lambda spark: spark.createDataFrame(SPECIFIERS, "s string").select("s", paths.package_of(F.col("s")).alias("package")))
OFFSETS = [("a\nb\nc", 0), ("a\nb\nc", 1), ("a\nb\nc", 2), ("a\nb\nc", 4), ("\n\n", 2), ("", 0)]
case("offset_lines", f"SELECT body, place, CAST(1 + length(left(body, place)) - length(replace(left(body, place), chr(10), '')) AS INT) AS line FROM ({_values(OFFSETS)}) t(body, place)", lambda spark: spark.createDataFrame(OFFSETS, "body string, place int").select("body", "place", text.line_of(F.col("body"), F.col("place")).alias("line")))
RENDERED = [("x", 3), (None, 4), ("{{n}}", 5)]
case("rendered_templates", f"SELECT v, n, replace(replace('{{{{n}}}} of {{{{v}}}} {{{{other}}}}', '{{{{n}}}}', CAST(n AS VARCHAR)), '{{{{v}}}}', coalesce(v, '')) AS said FROM ({_values(RENDERED)}) t(v, n)", lambda spark: spark.createDataFrame(RENDERED, "v string, n int").select("v", "n", text.rendered("{{n}} of {{v}} {{other}}", {"n": F.col("n"), "v": F.col("v")}).alias("said")))
SCANNED = [("src/a.ts", "import x from './b';"), ("src/b/index.ts", "export * from \"../c.js\";"), ("src/c.ts", "const y = import('@/b'); const z = require('lodash/fp');"), ("src/d.ts", "import type { T } from '@/gone'; import './b/x.css';"), ("src/e.ts", "// import './no'\nconst s = \"import './no'\";")]
#: file, specifier, target_path, package, type_only as a reader of SCANNED finds them
FOUND = [("src/a.ts", "./b", "b/index.ts", None, False), ("src/b/index.ts", "../c.js", "c.ts", None, False), ("src/c.ts", "@/b", "b/index.ts", None, False), ("src/c.ts", "lodash/fp", None, "lodash", False), ("src/d.ts", "@/gone", "gone", None, True), ("src/d.ts", "./b/x.css", None, None, False)]
case(
    "import_resolution",
    f"SELECT * FROM ({_values(FOUND)}) t(file, specifier, target_path, package, type_only)",
    lambda spark: tree.import_edges((s := _sources(spark, SCANNED).sources), tokens.scan_imports(s.select("file", "text"))).select("file", "specifier", "target_path", "package", "type_only"),
)
EXPORTING = [("a.ts", "export const a = 1; export default 2;"), ("b.ts", "export * from './a'; export * as ns from './c';"), ("c.ts", "export { x as y, type T } from './a';"), ("d.ts", "export async function f() {} export interface I {}")]
EXPORTED = [("a.ts", "named", "a", False), ("a.ts", "default", "default", False), ("b.ts", "wildcard", None, False), ("b.ts", "wildcard", None, False), ("c.ts", "named", "y", False), ("c.ts", "named", "T", True), ("d.ts", "named", "f", False), ("d.ts", "named", "I", True)]
case("export_scan", f"SELECT * FROM ({_values(EXPORTED)}) t(file, kind, exported_name, type_only)", lambda spark: tokens.scan_exports(spark.createDataFrame(EXPORTING, "file string, text string")).select("file", "kind", "exported_name", "type_only"))
FINDINGS = [("x/one", "src", 0, 0, False, "error", "src/b.ts", 3, "late"), ("x/one", "src", 0, 0, False, "warning", "src/a.ts", None, "soft"), ("x/two", "lib", 1, 1, True, "error", None, None, "broken"), ("x/two", "src", 1, 0, False, "warning", "src/b.ts", 1, "soft"), ("x/one", "src", 0, 0, False, "error", "src/\U0001f600.ts", 1, "wide"), ("x/one", "src", 0, 0, False, "error", "src/Ａ.ts", 1, "full")]
FOUND_SQL = f"({_values(FINDINGS)}) t(\"check\", tree, check_order, tree_order, crashed, severity, file, line, message)"
STAGED = [("src/b.ts",)]


def _findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FINDINGS, runner.RUN)


case("finding_totals", f"SELECT count(*) FILTER (severity = 'error' AND NOT crashed) AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (crashed) AS crashed, CAST(1 AS INT) AS status FROM {FOUND_SQL}", lambda spark: runner.totals(_findings(spark)))
case("staged_findings", f"SELECT \"check\", severity, file, message FROM {FOUND_SQL} WHERE severity <> 'warning' OR file IN (SELECT f FROM ({_values(STAGED)}) s(f))", lambda spark: runner.staged(_findings(spark), spark.createDataFrame(STAGED, "file string")).select("check", "severity", "file", "message"))
case(
    "report_lines",
    f"SELECT CASE severity WHEN 'error' THEN 'FAIL' ELSE 'WARN' END || ' [' || \"check\" || '] ' || coalesce(file || coalesce(':' || line, ''), '') || ' ' || message AS line FROM {FOUND_SQL}",
    lambda spark: runner.report(_findings(spark)),
)
case(
    "merged_runs",
    f"SELECT \"check\", CASE \"check\" WHEN 'x/two' THEN 0 ELSE 1 END AS check_order, count(*) AS n FROM (SELECT * FROM {FOUND_SQL} UNION ALL SELECT * FROM {FOUND_SQL} WHERE \"check\" = 'x/two') GROUP BY ALL",
    lambda spark: runner.merged([_findings(spark).where("check = 'x/two'"), _findings(spark)]).groupBy("check", "check_order").agg(F.count(F.lit(1)).alias("n")),
)
from . import site  # noqa: E402, F401  it asks these rules of another tree

RULE_QUERIES = tuple(n for n in QUERIES if n.startswith("rule_"))
__all__ = ["ORACLE_SQL", "QUERIES", "RULE_QUERIES"]
