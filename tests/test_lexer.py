"""The lexer of scripts, and what the scans make of its tokens."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factgrid.sources import lexer, tokens


def said(text, jsx=False):
    return [(kind, token) for _, _, kind, token in lexer.lex(text, jsx) if kind != "space"]


PIECES = ["a", "/", "`", "${", "}", "{", "<", ">", "/>", "</", "<p", '"', "'", "\n", "\\", "(", ")", "[", "]", "//", "/*", "*/", " ", "return", "1", "=", ",", "é", "$"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), st.booleans())
def test_tokens_make_up_the_text(text, jsx):
    got = list(lexer.lex(text, jsx))
    assert "".join(token for *_, token in got) == text and all(token for *_, token in got)
    at = 0
    for start, line, _, token in got:
        assert (start, line) == (at, 1 + text.count("\n", 0, at))
        at += len(token)


@pytest.mark.parametrize(
    ("text", "kind", "wanted"),
    [
        ("a = /[/'\"`]x/g; b / c / d", "regex", ["/[/'\"`]x/g"]), ("return /x/.test(y)", "regex", ["/x/"]), ("f(a) / b / c", "regex", []), ("x = a\n/b/c", "regex", []), ("[/\\//, 1 / 2]", "regex", ["/\\//"]),
        ("`a${b + `c${{d: 1}.d}`}e` / 2 / 3", "template", ["`a${", "`c${", "}`", "}e`"]), ("`\\${x}` + '`'", "template", ["`\\${x}`"]), ("`open ${a", "template", ["`open ${"]), ("'a\nb'", "string", ["'a", "'"]),
    ],
)
def test_what_a_slash_and_a_backtick_start(text, kind, wanted):
    assert [token for k, token in said(text) if k == kind] == wanted


def test_grammars_differ():
    jsx = said("const e = <p id=\"a'\" {...q}>don't // text {a < b ? <b/> : `x${y}`}</p>; import('z')", True)
    assert ("text", "don't // text ") in jsx and [t for k, t in jsx if k == "tag"] == ["p", "b", "p"] and jsx[-2:] == [("string", "'z'"), ("mark", ")")]
    assert ("comment", "// c") in said("<T,>(x: T) => x // c", True) and ("comment", "// c") in said("a < b // c", True)
    assert ("string", "'t</p>") in said("<p>don't</p>") and ("comment", "// c") in said("const y = <T>x // c")


TEXTS = [
    ("src/a.tsx", "const r = /import 'no'/;\nconst t = `${import('./in')} from 'no'`;\nexport const C = () => <p>it's import './no'</p>;\nimport y from './y';"),
    ("src/b.ts", "const x = <T>z; // don't\n\nimport {\n a } from './c';\nexport { q } from './d';"),
]


def test_scans_of_odd_files(spark):
    files = spark.createDataFrame([*TEXTS, ("src/e.ts", ""), ("src/n.ts", None)], "file string, text string")
    got = sorted(tuple(r) for r in tokens.scan_imports(files).select("file", "specifier", "line").collect())
    assert got == [("src/a.tsx", "./in", 2), ("src/a.tsx", "./y", 4), ("src/b.ts", "./c", 3), ("src/b.ts", "./d", 5)]
    assert sorted(tuple(r) for r in tokens.scan_exports(files).select("file", "exported_name", "line").collect()) == [("src/a.tsx", "C", 3), ("src/b.ts", "q", 5)]


def test_lines_of_a_long_file(spark):
    """A text of two million characters: tokens know their lines, none is counted from the start."""
    text = "const a = `x${b}` / 2;\n" * 90_000 + "import z from 'z';"
    files = spark.createDataFrame([("src/long.ts", text)], "file string, text string")
    assert [(r.specifier, r.line) for r in tokens.scan_imports(files).collect()] == [("z", 90_001)]
