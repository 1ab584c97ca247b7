"""Structural checks over a small tree: obvious and adversarial cases report, legal ones are silent."""

import pytest
from pyspark.sql import functions as F

from factgrid.functions import text
from factgrid.functions.paths import Tree, Vocabulary
from factgrid.plans import facts as jsons
from factgrid.plans import runner, structural
from factgrid.sources import tokens, tree

FILES = {
    "src/features/a/ui/view.tsx": 'import { x } from "../service/x";\nimport type { T } from "@/features/b";\nimport { go } from "@/features/b/service/y";\n// import "no"\nconst p = <Box p={8} padding={8} margin={9} />; boxShadow\nel.shadowRoot\n',
    "src/features/a/service/x.ts": 'import { v } from "../ui/view";\nexport async function pass(a) {\n  return v(a);\n}\nexport function work(a) { const b = 1; return b }\n',
    "src/features/a/repo/r.ts": "x",
    "src/features/a/controllers/c.ts": "x",
    "src/features/a/ui/far.tsx": 'import r from "../repo/r.js";\n',
    "src/features/b/index.ts": 'export * from "./service/y";\nexport { y as z, type T } from "./service/y";\nexport { y } from "./service/y";\n',
    "src/features/b/service/y.ts": 'import fs from "node:fs";\nimport { a } from "@/features/a";\nexport const y = require("./q");\n',
    "src/features/a/index.ts": 'export { x } from "./service/x";\n',
    "src/features/a/loose.ts": "x",
    "src/features/a/stray/s.ts": "x",
    "src/domains/m/a.ts": 'import { n } from "../n/b";\n',
    "src/domains/n/b.ts": 'import("@/domains/m");\nimport lodash from "lodash";\nimport self from "./b";',
    "src/domains/m/index.ts": 'export { a } from "./a"',
    "src/stray/q.ts": "x",
    "src/loose.ts": "x",
    "src/router.tsx": "x",
    "src/features/a/ui/view.test.tsx": "t",
    "src/features/a/ui/view.slow.test.tsx": "t",
    "src/features/a/ui/gone.test.tsx": "t",
    "src/features/a/ui/old.spec.ts": "t",
    "src/shared/big.ts": "x\n" * 616,
    "src/shared/long.mts": "x\n" * 525,
    "src/shared/fits.ts": "x\n" * 500,
    "src/shared/gen/huge.gen.ts": "x",
    "src/shared/a.css": ".a{color:#fff;\n font-size:\n 12px; --c:#abc; margin: 1em}\n.b{box-shadow: none}",
    "src/styles.css": "a{color:#000}",
    "docs/a.md": "w " * 160,
    "docs/fit.md": "w " * 70,
    "docs/snug.md": "w " * 69,
    "other/z.ts": "x\n" * 700,
}


@pytest.fixture(scope="module")
def facts(spark):
    files = spark.createDataFrame(list(FILES.items()), "file string, text string")
    sources = tree.source_files(files, [Tree("src")])
    grants = [("src/features/b/visibility.json", "b", '{"zz": "no"}'), ("src/features/c/visibility.json", "c", '{"q": ""}')]
    budgets = [("docs/a.md", "100"), ("docs/fit.md", "72"), ("docs/none.md", "200"), ("docs/fit.md", "74"), ("docs/snug.md", "74"), ("docs/fit.md", '"600"')]  # 70 words allow ceilings up to 74, 69 up to 73
    return structural.Facts(
        sources, files=files, visibility=spark.createDataFrame(grants, "file string, feature string, body string"),
        budgets=spark.createDataFrame(budgets, "path string, ceiling string"), theme=spark.createDataFrame([("sm", "0.5rem")], "name string, value string"),
    )


EXPECTED = {
    "health/file-size": ["FAIL src/shared/big.ts", "WARN src/shared/long.mts"],
    "health/doc-budgets": ["FAIL docs/a.md", "FAIL docs/fit.md", "FAIL docs/none.md", "FAIL docs/snug.md"],
    "placement/topology": ["FAIL src/features/a/loose.ts", "FAIL src/features/a/stray/s.ts", "FAIL src/loose.ts", "FAIL src/stray/q.ts"],
    "boundary/import-policy": ["FAIL src/domains/m/a.ts"],
    "placement/layer-direction": ["FAIL src/features/a/service/x.ts"],
    "boundary/layer-occupancy": ["FAIL src/features/a/ui/far.tsx", "FAIL src/features/a/ui/view.tsx"],
    "graph/domain-cycles": ["FAIL src/domains/m"],
    "graph/feature-deps": ["FAIL src/features/a"],
    "api/feature-visibility": ["FAIL src/features/a/visibility.json", "FAIL src/features/b/visibility.json", "FAIL src/features/c/visibility.json", "WARN src/features/b/visibility.json"],
    "api/barrel-purity": ["FAIL src/features/a/index.ts", "FAIL src/features/b/index.ts"],
    "naming/barrel-discoverability": ["FAIL src/features/b/index.ts", "FAIL src/features/b/index.ts"],
    "naming/test-file-mirror": ["WARN src/features/a/ui/gone.test.tsx", "WARN src/features/a/ui/old.spec.ts"],
    "style/css-tokens": ["FAIL src/shared/a.css", "FAIL src/shared/a.css"],
    "style/shadow-source": ["FAIL src/features/a/ui/view.tsx", "FAIL src/shared/a.css"],
    "style/token-equality": ["FAIL src/features/a/ui/view.tsx"],
    "health/trampolines": ["WARN src/features/a/service/x.ts"],
}


@pytest.mark.parametrize("name", EXPECTED)
def test_check(facts, name):
    got = structural.CHECKS[name](facts).collect()
    assert sorted(f"{'FAIL' if r.severity == 'error' else 'WARN'} {r.file}" for r in got) == EXPECTED[name]
    assert all(r.message for r in got)


def test_trees_are_apart(spark):
    """Rings, layers, grants and barrels of one tree say nothing of another."""
    files = {
        "one/domains/m/a.ts": 'import { n } from "../n/b";', "one/domains/n/b.ts": "x", "two/domains/m/a.ts": "x", "two/domains/n/b.ts": 'import { m } from "../m/a";',
        "one/features/a/ui/v.ts": 'import r from "../repo/r";', "one/features/a/repo/r.ts": "x", "two/features/a/service/s.ts": "x", "one/features/b/index.ts": 'export { v } from "@/features/a/ui/v";', "two/features/a/ui/v.ts": 'import "node:fs";',
    }
    sources = tree.source_files(spark.createDataFrame(list(files.items()), "file string, text string"), [Tree("one"), Tree("two")])
    grants = spark.createDataFrame([("two/features/a/visibility.json", "a", '{"b": "in two"}')], "file string, feature string, body string")
    f = structural.Facts(sources, visibility=grants)
    for name in ("graph/domain-cycles", "boundary/layer-occupancy", "api/barrel-purity"):
        assert structural.CHECKS[name](f).collect() == [], name
    assert sorted((r.severity, r.file) for r in structural.feature_visibility(f).collect()) == [("error", "one/features/a/visibility.json"), ("warning", "two/features/a/visibility.json")]


def test_scales_and_manifests_are_read(spark):
    modules = spark.createDataFrame([("t.ts", "export const spacing = {\n  none: '0px',\n  'x-s': \"0.25rem\",\n};\nconst radius = { md: '6px' }")], "file string, text string")
    assert sorted(map(tuple, jsons.scale(modules, "spacing").collect())) == [("none", "0px"), ("x-s", "0.25rem")]
    assert list(map(tuple, jsons.scale(modules, "radius").collect())) == [("md", "6px")]
    bodies = [("a", '{"x.md": 10, "y.md": "10", "z.md": null}'), ("b", "[]"), ("c", "{"), ("d", "{}"), ("e", None)]
    got = sorted(map(tuple, jsons.budgets(spark.createDataFrame(bodies, "file string, text string")).collect()), key=str)
    assert got == [("a", "x.md", "10"), ("a", "y.md", '"10"'), ("a", "z.md", "null"), ("b", None, "[]"), ("c", None, None), ("e", None, None)]


TOKENS = {
    "src/features/a/ui/all.tsx": '/* gap={16}\n padding: 16 */ const a = <B gap={16} />;\nconst b = { padding: 16 };\nconst c = <B radius="6px" p="16" />;\nconst d = { borderRadius: 6 }; // radius={6}\n',
    "src/features/a/ui/style.ts": "export const s = {\n  marginTop: 16,\n};\n",
    "src/features/a/ui/legal.tsx": 'const a = <B gap={7} radius={0} p="16em" padding={16} />; const b = { borderRadius: 16, padding: 6 };\n',
    "src/domains/m/a.ts": "const s = { padding: 16 };\n",
    "src/shared/ui/theme.ts": "const s = { padding: 16 };\n",
}


def test_token_equality_has_four_surfaces(spark):
    sources = tree.source_files(spark.createDataFrame(list(TOKENS.items()), "file string, text string"), [Tree("src")])
    theme, radii = (spark.createDataFrame(rows, "name string, value string") for rows in ([("md", "1rem"), ("none", "0px")], [("md", "6px")]))
    got = sorted((r.file.split("/")[-1], r.line, r.message) for r in structural.token_equality(structural.Facts(sources, theme=theme, radii=radii)).collect())
    assert got == [
        ("all.tsx", 2, "gap={16} is the spacing token md"), ("all.tsx", 3, "padding: 16 is the spacing token md"), ("all.tsx", 4, 'p="16" is the spacing token md'), ("all.tsx", 4, 'radius="6px" is the radius token md'),
        ("all.tsx", 5, "borderRadius: 6 is the radius token md"), ("style.ts", 2, "marginTop: 16 is the spacing token md"),
    ]


PASSING = """export default async function whole(a) { return b(a); }
export const service: Service<X> = {
  get(a) { return repo.get(a); },
  async put(a: { b: C }): Promise<{ ok: boolean }> {
    return repo.put(a);
  },
  busy(a) { if (a) return a; return repo.busy(a); },
  typed(a): { ok: boolean } { const b = a; return b; },
  nested: { deep(a) { return a; } },
  call: other(a),
};
const hidden = { no(a) { return a; } };
export function over(a: string): string;
export function over(a) { const b = a; return b; }
export const made = make({ no(a) { return a; } });
"""


def test_trampolines_in_objects_and_defaults(spark):
    files = [("src/features/a/service/x.ts", PASSING), ("src/features/a/service/y.ts", "export default function plain(a) { return b(a); }\n"), ("src/features/a/repo/x.ts", PASSING)]
    sources = tree.source_files(spark.createDataFrame(files, "file string, text string"), [Tree("src")])
    got = sorted((r.file[-4:], r.line, r.message.split()[0]) for r in structural.trampolines(structural.Facts(sources)).collect())
    assert got == [("x.ts", 1, "whole"), ("x.ts", 3, "get"), ("x.ts", 4, "put"), ("y.ts", 1, "plain")]


def test_all_checks_have_cases():
    assert set(EXPECTED) == set(structural.CHECKS)


def test_runner_keeps_crashes_apart(facts, spark):
    def broken(f):
        raise RuntimeError("no such table")

    found = runner.run_checks({"src": facts}, {"health/file-size": structural.file_size, "x/broken": broken})
    assert found.where("crashed").count() == 1 and found.where("not crashed").count() == 2
    total = runner.totals(found).first()
    assert (total.errors, total.warnings, total.crashed, total.status) == (1, 1, 1, 1)
    assert runner.staged(found, spark.createDataFrame([("other",)], "file string")).where("severity = 'warning'").count() == 0
    assert runner.staged(found, None).count() == 3
    none = {"a/one": lambda p: runner._per_file("health/no-nested-ternary")(p), "a/two": lambda p: runner._typed("types/no-runtime-typeof")(p), "health/file-size": runner.ALL["health/file-size"]}
    part = runner.run_checks({"src": runner.Project(facts)}, none)
    assert sorted((r.check, r.crashed) for r in part.collect()) == [("a/one", True), ("a/two", True), ("health/file-size", False), ("health/file-size", False)]
    assert len(runner.ALL) == 65 and [r.check for r in runner.merged([part.where("check = 'a/two'"), part]).select("check", "check_order").distinct().orderBy("check_order").collect()] == ["a/two", "a/one", "health/file-size"]
    assert runner.report(found).first().line.startswith("FAIL [health/file-size] src/shared/big.ts")


SCAN = '''import a from 'a';
import "side";
import type { B } from "types";
import { type C, type D } from "c-types";
import { type E, f } from "mixed";
import G, { type H } from "default-and-type";
import * as ns from "tpl";
export { x } from "re";
export * from "star";
const p = import("dyn"); const q = import(`${x}`); const r = require("req"); require.resolve("res");
foo.import("no"); foo.require("no"); // import "comment"
const s = "import 'string'"; /* require("block") */
import type from "named-type";
import old = require("equals");
type T = typeof import("typed");
'''


def test_import_scan(spark):
    files = spark.createDataFrame([("a.ts", SCAN), ("empty.ts", "")], "file string, text string")
    got = {r.specifier: (r.line, r.type_only) for r in tokens.scan_imports(files).collect()}
    assert got == {
        "a": (1, False), "side": (2, False), "types": (3, True), "c-types": (4, True), "mixed": (5, False), "default-and-type": (6, False), "tpl": (7, False), "re": (8, False), "star": (9, False),
        "dyn": (10, False), "req": (10, False), "res": (10, False), "named-type": (13, False), "equals": (14, False), "typed": (15, True),
    }


def test_export_scan(spark):
    text = 'export const a = 1;\nexport async function b() {}\nexport { c as d, type E, default as F } from "m";\nexport * as ns from "n";\nexport type { G };\nexport default 1;\nexport interface H {}\nexport { type as t };\n'
    got = sorted((r.line, r.kind, r.exported_name, r.local_name, r.namespace, r.specifier, r.type_only) for r in tokens.scan_exports(spark.createDataFrame([("a.ts", text)], "file string, text string")).fillna("-").collect())
    assert got == [
        (1, "named", "a", "a", "-", "-", False), (2, "named", "b", "b", "-", "-", False), (3, "named", "E", "E", "-", "m", True), (3, "named", "F", "default", "-", "m", False), (3, "named", "d", "c", "-", "m", False),
        (4, "wildcard", "-", "-", "ns", "-", False), (5, "named", "G", "G", "-", "-", True), (6, "default", "default", "-", "-", "-", False), (7, "named", "H", "H", "-", "-", True), (8, "named", "t", "type", "-", "-", False),
    ]


def test_tokens_cover_the_text(spark):
    text = "a /* b */ 'c\\'d' `e${f}`\n\"" + "x" * 20000 + "\" // z\n/* open"
    got = tokens.tokens(spark.createDataFrame([("a", text)], "file string, text string")).orderBy("start").collect()
    assert "".join(r.token for r in got) == text and all(text.startswith(r.token, r.start) for r in got)


def test_trees_are_read_from_files(spark, tmp_path):
    (tmp_path / "src" / "shared").mkdir(parents=True)
    (tmp_path / "src" / "shared" / "a b.ts").write_text("x\ny\n")
    got = tree.read_files(spark, str(tmp_path), "*.ts").collect()
    assert [tuple(r) for r in got] == [("src/shared/a b.ts", "x\ny\n")]
    with pytest.raises(ValueError):
        tree.read_files(spark, str(tmp_path), "*.css")


def test_bad_vocabularies_are_refused():
    for bad in (dict(features="a/b"), dict(shared="domains"), dict(alias=""), dict(layers=(("ui", "ui"),))):
        with pytest.raises(ValueError):
            Vocabulary(**bad)
    for root in ("", "src/*", "/abs", "../up"):
        with pytest.raises(ValueError):
            Tree(root)
    with pytest.raises(ValueError):
        structural.Limits(lines_warning=700)


def test_templates_are_rendered_once(spark):
    row = spark.createDataFrame([("{{b}}", "x", None)], "a string, b string, c string")
    said = row.select(text.rendered("{{a}} {{b}}{{c}} {{d}} {{ a }}", {c: F.col(c) for c in "abc"}).alias("s")).first().s
    assert said == "{{b}} x {{d}} {{ a }}"


BOUNDARY = {
    "src/features/a/index.ts": 'export * from "./one";\nexport * from "./two";\nexport * from "./three";',
    "src/features/a/one.ts": 'import { createServerFn as fn } from "@tanstack/react-start";\nimport pg from "pg";\nexport const x = fn();',
    "src/features/a/two.ts": '// createServerFn( in a comment\nimport stripe from "stripe";',
    "src/features/a/three.ts": 'import { createMiddleware } from "@tanstack/react-start";\nimport db from "drizzle-orm";\nexport const m = createMiddleware();',
    "src/features/b/index.ts": 'import { createServerFn } from "./own";\nexport const y = createServerFn();\nexport * from "./four";',
    "src/features/b/own.ts": "export const createServerFn = () => 1;",
    "src/features/b/four.ts": 'import fs from "node:fs";',
    "src/features/c/index.ts": 'export * from "./p0";',
    **{f"src/features/c/p{i}.ts": f'export * from "./p{i + 1}";' for i in range(8)},
    "src/features/c/p8.ts": "export const z = 1;",
    "src/domains/d/index.ts": 'export * from "./five";',
    "src/domains/d/five.ts": 'import { createServerFn } from "@tanstack/react-start";\nimport auth from "better-auth";\nexport const w = createServerFn();',
}


def test_barrels_stop_at_the_server_boundary(spark):
    files = spark.createDataFrame(list(BOUNDARY.items()), "file string, text string")
    facts = structural.Facts(tree.source_files(files, [Tree("src")]), files=files)
    got = {(r.file, r.message) for r in structural.barrel_purity(facts).collect()}
    way = " > ".join(["src/features/c/index.ts", *[f"src/features/c/p{i}.ts" for i in range(6)]])
    assert got == {
        ("src/features/a/index.ts", "reaches stripe through src/features/a/two.ts: src/features/a/index.ts > src/features/a/two.ts"),
        ("src/features/b/index.ts", "reaches node:fs through src/features/b/four.ts: src/features/b/index.ts > src/features/b/four.ts"),
        ("src/features/c/index.ts", f"imports run deeper than 6: {way}"),
        ("src/domains/d/index.ts", "reaches better-auth through src/domains/d/five.ts: src/domains/d/index.ts > src/domains/d/five.ts"),
    }


def test_trails_are_collated(spark):
    """Pairs in a message stand as readers sort them: é between e and f, whatever the case."""
    names = ["Étage", "eta", "Fin"]
    texts = {f"src/features/{a}/ui/x.ts": f'import y from "@/features/{b}/ui/x";' for a, b in zip(names, names[1:] + names[:1], strict=True)}
    facts = structural.Facts(tree.source_files(spark.createDataFrame(list(texts.items()), "file string, text string"), [Tree("src")]))
    (row,) = [r for r in structural.feature_deps(facts).collect() if r.severity == "error"]
    assert row.message.endswith("eta -> Fin; Étage -> eta; Fin -> Étage")
