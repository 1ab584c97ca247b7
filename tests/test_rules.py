"""Per-file rules and type checks over small fact tables."""

import pytest

from factgrid.functions.paths import Tree
from factgrid.operators import graph
from factgrid.plans import perfile, structural, types
from factgrid.sources import tree

FILES = {
    "src/features/a/ui/view.tsx": 'import { q } from "@/infrastructure/db/client";\nimport s from "stripe";\nimport o from "@/components/old";\nimport b from "@/features/b/index.server";\nimport t from "./view.test";\nimport ok from "@/infrastructure/auth/client";',
    "src/features/a/index.ts": 'export { s } from "./index.server";',
    "src/infrastructure/payments/pay.ts": 'import s from "stripe"; import f from "@/features/a"; ',
    "src/routes/home.tsx": 'import e from "@/env.server"; import d from "@/infrastructure/db";',
    "src/features/a/repo/r.ts": 'import d from "@/infrastructure/db";',
    "src/features/b/ui/list.tsx": 'import m from "@/infrastructure/mail";',
    "src/env.server.ts": "x",
}
VIEW = "src/features/a/ui/view.tsx"


def n(i, parent, kind, start, end, name=None, role=None, file=VIEW, **attrs):
    return file, i, parent, role, kind, start, end, name, {k: str(v) for k, v in attrs.items()}


NODES = [
    n(1, 0, "CallExpression", 0, 50, "provide", callee="Layer.provide"), n(2, 1, "CallExpression", 10, 20, "provide", callee="Layer.provide"), n(3, 0, "MemberExpression", 60, 70, "catchAllCause"), n(4, 0, "MemberExpression", 71, 80, "serviceOption"),
    n(5, 0, "NewExpression", 90, 120, "X"), n(6, 5, "Property", 95, 110, "disableValidation", value="true"), n(7, 0, "CallExpression", 130, 160, "catchAll"), n(8, 7, "Expr", 140, 150, role="returned", text="Effect.void"),
    n(9, 0, "TaggedTemplateExpression", 161, 170, callee="sql", type_arguments="User"), n(10, 0, "TSTypeAliasDeclaration", 171, 175, "UserData"), n(11, 0, "VariableDeclarator", 176, 179, "localInfo", module_level="false"),
    n(12, 0, "ConditionalExpression", 200, 300), n(13, 12, "ConditionalExpression", 220, 299, role="alternate"), n(14, 13, "ConditionalExpression", 240, 298, role="alternate"), n(15, 14, "X", 250, 297, role="alternate"),
    n(16, 0, "CallExpression", 310, 340, "inputValidator"), n(17, 16, "CallExpression", 310, 325, "createServerFn"), n(18, 0, "CallExpression", 350, 360, "pgTable"), n(19, 0, "Identifier", 310, 324, "createServerFn"),
    n(20, 0, "CallExpression", 400, 450, "useEffect"), n(21, 20, "CallExpression", 410, 420, "setX"), n(22, 0, "VariableDeclarator", 390, 399, init="useState", setter="setX"), n(23, 0, "CallExpression", 460, 490, "useEffect"), n(24, 23, "AwaitExpression", 470, 480),
    n(25, 0, "Function", 500, 900, "Big", exported="true", function="true"), *[n(30 + i, 25, "CallExpression", 510 + 10 * i, 515 + 10 * i, f"useThing{i}") for i in range(7)], n(26, 0, "Function", 910, 950, "Other", exported="true", function="true"),
    n(40, 0, "JSXOpeningElement", 960, 965, "div"), n(41, 0, "Property", 966, 970, "color", value="#fff"), n(42, 0, "JSXAttribute", 971, 975, "fontSize"), n(43, 0, "JSXAttribute", 976, 990, "style"), n(44, 43, "ObjectExpression", 980, 989),
    n(45, 0, "Literal", 991, 995, value="p-[3px] x"), n(46, 0, "ImportSpecifier", 996, 999, "Textarea", source="@mantine/core"), n(47, 0, "CallExpression", 1000, 1010, "mock", callee="vi.mock"), n(48, 0, "TSAsExpression", 1020, 1040, to="X", statement_gap=1011),
    n(49, 48, "TSAsExpression", 1021, 1035, to="unknown", statement_gap=1011), n(50, 0, "SpreadElement", 1050, 1070), n(51, 50, "ConditionalExpression", 1053, 1069, role="argument"), n(52, 51, "ObjectExpression", 1060, 1062, role="alternate", empty="true"),
    n(53, 0, "CallExpression", 1080, 1085, "get", callee="Reflect.get"), n(54, 0, "CallExpression", 1090, 1099, "json", type_arguments="User"), n(55, 0, "CallExpression", 1100, 1109, "json", type_arguments="unknown"), n(56, 0, "MemberExpression", 1110, 1120, path="process.env.X"),
    n(57, 0, "TSTypeLiteral", 1200, 1300, "Props", props="true"), *[n(60 + i, 57, "TSPropertySignature", 1210 + 5 * i, 1214 + 5 * i, f"p{i}", role="prop") for i in range(8)],
    n(80, 0, "CallExpression", 0, 90, "handler", file="src/features/a/repo/r.ts"), n(81, 80, "CallExpression", 0, 20, "createServerFn", file="src/features/a/repo/r.ts"), n(82, 80, "Identifier", 40, 45, "input", role="param", file="src/features/a/repo/r.ts"),
    n(83, 0, "Expr", 100, 120, role="returned", chain="db,insert,values", file="src/features/a/repo/r.ts"), n(84, 0, "Expr", 130, 150, role="returned", chain="db,insert,returning", file="src/features/a/repo/r.ts"),
    n(85, 0, "VariableDeclaration", 200, 220, "plain", exported="true", file="src/features/a/repo/r.ts"), n(86, 0, "CallExpression", 230, 260, "useCallback"), n(87, 86, "Arrow", 240, 250, **{"async": "true"}),
]
#: Rules, with how often each reports over these facts.
EXPECTED = {
    "api/barrel-direction": 1, "api/server-import-context": 1, "boundary/ambient-globals": 1, "boundary/client-server-infra": 3, "boundary/db-isolation": 2, "boundary/no-test-imports": 1, "boundary/route-thinness": 2, "boundary/sdk-containment": 1,
    "boundary/server-no-upward": 1, "effect/no-disable-validation": 1, "effect/no-effect-catchallcause": 1, "effect/no-nested-layer-provide": 1, "effect/no-service-option": 1, "effect/no-silent-error-swallow": 1, "effect/no-sql-type-parameter": 1,
    "health/no-nested-ternary": 1, "naming/no-vacant-symbol-names": 1, "placement/deprecated-paths": 1, "placement/no-deprecated-input-validator": 1, "placement/no-plain-export-in-server-fn-module": 3, "placement/no-raw-result": 1, "placement/schema-placement": 1,
    "placement/server-fn-placement": 1, "placement/server-fn-validation": 1, "react/derived-state": 1, "react/hook-count": 1, "react/no-async-effect": 2, "react/prop-count": 1, "react/single-component-export": 1, "style/no-arbitrary-class-values": 1,
    "style/no-inline-color": 1, "style/no-inline-font-size": 1, "style/no-inline-style-prop": 1, "style/no-raw-primitives": 1, "style/vendor-component-containment": 1, "testing/no-module-mocking": 1, "types/no-chained-type-assertions": 1,
    "types/no-conditional-empty-object-spread": 1, "types/no-reflect-access": 1, "types/no-type-argument-assertion": 1, "types/require-safety-comment": 2,
}


@pytest.fixture(scope="module")
def syntax(spark):
    files = spark.createDataFrame(list(FILES.items()), "file string, text string")
    facts = structural.Facts(tree.source_files(files, [Tree("src")]), files=files)
    return perfile.Syntax(facts, spark.createDataFrame(NODES, perfile.NODE), spark.createDataFrame([(VIEW, 1, 5, "// note")], "file string, start int, end int, text string"))


@pytest.mark.parametrize("name", EXPECTED)
def test_rule(syntax, name):
    assert perfile.RULES[name](syntax).count() == EXPECTED[name]


def test_every_rule_has_a_case(syntax):
    assert set(perfile.RULES) - set(EXPECTED) == {"boundary/import-policy"}
    denied = {r.message.split(":")[0] for r in perfile.RULES["boundary/import-policy"](syntax).collect()}
    assert "denied-direction" in denied


def test_safety_comments(spark, syntax):
    noted = perfile.Syntax(syntax.facts, syntax.nodes, spark.createDataFrame([(VIEW, 1012, 1018, "// SAFETY: checked")], "file string, start int, end int, text string"))
    assert perfile.RULES["types/require-safety-comment"](noted).count() == 0


def test_missing_nodes_fail(syntax):
    with pytest.raises(ValueError, match="no syntax nodes"):
        syntax.covered()


def test_runs_over_syntax_need_nodes(syntax):
    assert set(perfile.IMPORTS) < set(perfile.RULES)
    for names in (["boundary/no-test-imports", "health/no-nested-ternary"], None):
        with pytest.raises(ValueError, match="no syntax nodes"):
            perfile.run(syntax, names)
    assert perfile.run(syntax, ["boundary/no-test-imports"]).columns == ["rule", "severity", "file", "start", "message"]


def test_type_checks(spark):
    nodes = [(1, "any", False, False), (2, "unknown", False, False), (3, "object", False, False), (4, "string", False, False), (5, "union", False, False), (6, "reference", False, False), (7, "dict", False, False), (8, "any", False, True), (9, "dict", True, False)]
    children = [(5, 2, "union"), (5, 4, "union"), (6, 5, "promise")]
    site = lambda i, kind, t, name="x", start=0, end=9, fn=1, symbol="s", **kw: ("f.ts", i, kind, start, end, name, t, fn, symbol, kw.get("subject"), kw.get("guard"), kw.get("here"), kw.get("empty"))
    sites = [
        site(1, "parameter", 6), site(2, "parameter", 3), site(3, "parameter", 1, "cause"), site(4, "parameter", 1, subject=True), site(5, "parameter", 8), site(6, "return", 6), site(7, "return", 4), site(8, "alias", 2), site(9, "typeof", 2), site(10, "typeof", 5),
        site(11, "typeof", 1, guard=True), site(12, "type_reference", 7, start=0, end=50), site(13, "type_reference", 7, start=10, end=20), site(14, "type_reference", 9, start=60, end=70), site(15, "annotated_literal", 7), site(16, "annotated_literal", 3, empty=True),
        site(17, "const_declaration", 2), site(18, "assertion", 4), site(19, "assertion", 4, fn=2),
    ]
    t = types.Types(spark.createDataFrame(sites, types.SITE), spark.createDataFrame(nodes, "type_id long, flags string, array_like boolean, is_error boolean"), spark.createDataFrame(children, "type_id long, child long, edge string"), spark.createDataFrame([(7, 2), (9, 2)], "type_id long, value_type_id long"))
    got = {name: check(t).count() for name, check in types.CHECKS.items()}
    assert got == {"types/no-broad-parameters": 2, "types/no-known-value-widening": 1, "types/no-opaque-record": 1, "types/no-runtime-typeof": 1, "types/no-unknown-returns": 1, "types/no-unknown-type-aliases": 1, "types/no-widen-then-assert": 1}


def test_strong_components(spark):
    import random

    rng = random.Random(1)
    for _ in range(2):
        edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(18)} | {(3, 3)}
        reach = {(a, a) for e in edges for a in e} | edges
        while True:
            more = reach | {(a, d) for a, b in reach for c, d in reach if b == c}
            if more == reach:
                break
            reach = more
        nodes = {a for a, b in edges if a != b} | {b for a, b in edges if a != b}
        want = {x: min(y for y in nodes if (x, y) in reach and (y, x) in reach) for x in nodes}
        got = {r.node: r.component for r in graph.strongly_connected(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
        assert got == want


def test_broad_types_nest_to_any_depth(spark):
    depth = 36
    nodes = spark.createDataFrame([(1, "any", False, False)] + [(i, "array", True, False) for i in range(2, depth + 2)], "type_id long, flags string, array_like boolean, is_error boolean").coalesce(1)
    children = spark.createDataFrame([(i, i - 1, "array") for i in range(2, depth + 2)] + [(2, depth + 1, "union")], "type_id long, child long, edge string").coalesce(1)
    t = types.Types(spark.createDataFrame([], types.SITE), nodes, children, spark.createDataFrame([], "type_id long, value_type_id long"))
    assert {r.type_id for r in t.broad.collect()} == set(range(1, depth + 2))


def _syntax_of(spark, nodes):
    files = spark.createDataFrame([(VIEW, "x")], "file string, text string")
    return perfile.Syntax(structural.Facts(tree.source_files(files, [Tree("src")]), files=files), spark.createDataFrame(nodes, perfile.NODE), spark.createDataFrame([], "file string, start int, end int, text string"))


def test_destructured_globals(spark):
    nodes = [
        n(1, 0, "VariableDeclarator", 0, 30), n(2, 1, "ObjectPattern", 0, 10, role="id", keys="env,pid"), n(3, 1, "Identifier", 12, 20, "process", role="init", path="process"),
        n(4, 0, "VariableDeclarator", 40, 70), n(5, 4, "ObjectPattern", 40, 50, role="id", keys="env"), n(6, 4, "Identifier", 52, 60, "process", role="init", path="process", shadowed="true"),
    ]
    got = perfile.RULES["boundary/ambient-globals"](_syntax_of(spark, nodes)).collect()
    assert [(r.start, "process.env" in r.message) for r in got] == [(12, True)]


def test_prop_counts_are_floors_where_bases_are_unread(spark):
    def declared(i, start, name, members, bases, kind="TSInterfaceDeclaration", **attrs):
        out = [n(i, 0, kind, start, start + 100, name, **attrs)]
        out += [n(i + 1 + k, i, "TSPropertySignature", start + 1 + 2 * k, start + 2 + 2 * k, p, role="prop") for k, p in enumerate(members)]
        return out + [n(i + 30 + k, i, "TSTypeReference", start + 60 + 2 * k, start + 61 + 2 * k, b, role="heritage") for k, b in enumerate(bases)]

    many = [f"p{k}" for k in range(10)]
    nodes = [
        *declared(100, 0, "Whole", many[:6], ["More"], props="true"), *declared(200, 1000, "More", many[4:], []),
        *declared(300, 2000, "Floor", many, ["Elsewhere", "Empty"], props="true"), *declared(400, 3000, "Empty", [], ["Gone"]),
        *declared(500, 4000, "Ring", many, ["Back"], props="true"), *declared(600, 5000, "Back", ["q"], ["Ring"]),
        *declared(700, 6000, "Indexed", many, [], props="true"), n(790, 700, "TSIndexSignature", 6080, 6090),
    ]
    got = {r.start: r.message for r in perfile.RULES["react/prop-count"](_syntax_of(spark, nodes)).collect()}
    assert got == {
        0: "10 props", 2000: "at least 10 props, as Elsewhere, Empty can't be read in this file", 4000: "at least 11 props, as part of their type has no names",
        6000: "at least 10 props, as part of their type has no names",
    }
