"""Elements, declarations and nesting ranges against plain versions."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factgrid.functions import markup, scan
from factgrid.operators import nesting


def plain_elements(html):
    """Elements as a tree that is built by a walk, then numbered: the same rules, told another way."""
    root = {"tag": None, "kids": [], "up": None}
    here, order = root, []
    for kind, name, _, start, end in markup.html_tags(html):
        path = []
        while_node = here
        while while_node["up"] is not None:
            path.append(while_node)
            while_node = while_node["up"]
        if kind == "close":
            hit = next((x for x in path if x["tag"] == name), None)
            if hit:
                for x in path[: path.index(hit)]:
                    x["end"] = start
                hit["end"] = end
                here = hit["up"]
        elif kind == "open":
            ended, walls = markup.IMPLIED.get(name, ((), ()))
            for x in path:
                if x["tag"] in ended:
                    for y in path[: path.index(x) + 1]:
                        y.setdefault("end", start)
                    here = x["up"]
                    if name != "tr":
                        break
                elif x["tag"] in walls:
                    break
            node = {"tag": name, "kids": [], "up": here, "start": start}
            order.append(node)
            here["kids"].append(node)
            if name in markup.VOID:
                node["end"] = end
            else:
                here = node
    out, count = [], 0

    def walk(node, parent, depth):
        nonlocal count
        count += 1
        enter = count
        for kid in node["kids"]:
            walk(kid, enter, depth + 1)
        out.append((enter, count, parent, depth, node["tag"], node["start"], node.get("end", len(html))))

    for kid in root["kids"]:
        walk(kid, None, 1)
    return out


TAGS = ["<p>", "</p>", "<P class='a>b'>", "<div>", "</div>", "<ul>", "<li>", "</ul>", "</li>", "<br>", "<b>", "</b>", "<!-- <p> -->", "<script>var x='<p>';</script>", "<style>p{}</style >", "text", "< 3", "<table>", "<tr>", "<td>", "</table>", "<dl>", "<dt>", "<dd>", "<h1>", "</h1>", "<!DOCTYPE html>", "</span>", "<select>", "<option>", "<title>a<b</title>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(TAGS), max_size=25).map("".join), st.sampled_from(["", "<p", "<!--", "<a href='", "<script>"]))
def test_elements_match_a_tree(body, tail):
    assert sorted(markup.html_elements(body + tail)) == sorted(plain_elements(body + tail))


def test_elements_as_html_has_them():
    got = sorted((e, leave, parent, depth, tag) for e, leave, parent, depth, tag, _, _ in markup.html_elements("<body><p>one<b>two<br><p>three<div>four</div></body>"))
    assert got == [(1, 6, None, 1, "body"), (2, 4, 1, 2, "p"), (3, 4, 2, 3, "b"), (4, 4, 3, 4, "br"), (5, 5, 1, 2, "p"), (6, 6, 1, 2, "div")]
    assert markup.html_elements("") == [] and len(markup.html_elements("<b>" * 20000)) == 20000
    assert len(markup.html_elements("<a '" * 50001 + ">")) == 0  # a tag that never ends, looked at once


def ranges(r, n, ids):
    """Ranges of one tree over 0..n, some of them empty, some equal."""
    out = []

    def split(a, b, level):
        if level > 5 or len(out) >= ids:
            return
        at = a
        while at < b and len(out) < ids:
            x = r.randint(at, b)
            y = r.randint(x, b)
            out.append((x, y))
            if y > x:
                if r.random() < 0.3:
                    out.append((x, y))
                split(x, y, level + 1)
            at = max(y, x + 1)

    split(0, n, 0)
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("strict", [True, False])
def test_nesting_matches_pairs(spark, seed, strict):
    r = random.Random(seed)
    rows = [(f, i, a, b, f"n{i}") for f in ("x", "y") for i, (a, b) in enumerate(ranges(r, 60, 60)) if b > a or r.random() < 0.2]
    rows = [x for x in rows if x[3] > x[2] or not any(y[0] == x[0] and y is not x and x[2] in (y[2], y[3]) for y in rows)]  # empty ones on no other's edge
    inner, outer = [x for x in rows if r.random() < 0.8], [x for x in rows if r.random() < 0.5]
    schema = "file string, node_id int, start int, end int, name string"
    x, y = spark.createDataFrame(inner + [(None, 900, 1, 2, "z"), ("x", 901, None, 2, "z")], schema), spark.createDataFrame(outer + [(None, 900, 1, 2, "z")], schema)
    fits = lambda a, o: a[0] == o[0] and a[2] >= o[2] and a[3] <= o[3] and not (strict and a[1] == o[1])
    got = nesting.around(x, y, ["file"], carry=["name"], strict=strict).collect()
    assert len(got) == len(inner) + 2
    for row in got:
        about = [o for o in outer if row.file and row.start is not None and fits(tuple(row)[:4], o)]
        assert row.depth == len(about)
        if about:
            size = min(o[3] - o[2] for o in about)
            assert (row.outer_end - row.outer_start, row.outer_start) == (size, next(o[2] for o in about if o[3] - o[2] == size)) and fits(tuple(row)[:4], ("x" if row.file == "x" else "y", row.outer_node_id, row.outer_start, row.outer_end))
        else:
            assert row.outer_node_id is None
    counts = nesting.held(y, x, ["file"], strict=strict).collect()
    assert {(c.file, c.node_id): c.inside for c in counts if c.file} == {(o[0], o[1]): sum(fits(a, o) for a in inner) for o in outer}
    assert nesting.around(x.limit(0), y, ["file"]).collect() == [] == nesting.held(y.limit(0), x, ["file"]).collect()
    assert {row.depth for row in nesting.around(x, y.limit(0), ["file"]).collect()} == {0}


CSS = """
/* a: b; } */ @import url("x;y{z");
p { color : red; margin:0 ; background: url(data:image/png;base64,AAA=) no-repeat; content: "}; a: \\"b" }
@media (min-width: 10px) { .a::before { font-size:\n 13px /* c */; --x: { } } .b > c { top:1px } }
q { left: 2px
"""


def test_declarations_of_a_sheet():
    got = list(markup.css_declarations(CSS))
    assert [(p, v, a) for p, v, a, _, _ in got] == [
        ("color", "red", "p"), ("margin", "0", "p"), ("background", "url(data:image/png;base64,AAA=) no-repeat", "p"), ("content", '"}; a: \\"b"', "p"),
        ("font-size", "13px", "@media (min-width: 10px) > .a::before"), ("top", "1px", "@media (min-width: 10px) > .b > c"), ("left", "2px", "q"),
    ]
    for p, v, _, a, b in got:
        assert CSS[a:b].startswith(p) and (CSS[a:b].endswith(v) or "/*" in CSS[a:b]) and CSS[a:b] == CSS[a:b].strip()
    assert list(markup.css_declarations("")) == [] and list(markup.css_declarations("a{b:c}}d{e:f}"))[1][:3] == ("e", "f", "d")
    assert [x[:2] for x in markup.css_declarations("color:red;; top : 1px/*x*/")] == [("color", "red"), ("top", "1px")]


def plain_declarations(css):
    """Of sheets without strings, comments and brackets: spans between the marks."""
    heads, begin = [], 0
    for i, c in enumerate(css + ";"):
        if c == "{":
            heads.append(css[begin:i].strip())
        elif c in "};":
            name, colon, value = css[begin:i].partition(":")
            if colon and name.strip() and not name.strip().startswith("@"):
                yield name.strip(), value.strip(), " > ".join(heads)
            if c == "}" and heads:
                heads.pop()
        else:
            continue
        begin = i + 1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab:;{} @\n-", max_size=40))
def test_declarations_match_plain(css):
    assert [x[:3] for x in markup.css_declarations(css)] == list(plain_declarations(css))


def test_declarations_of_a_page(spark):
    html = """<p style="color:red; top:0">x</p><!-- <style>a{b:c}</style> --><STYLE type='text/css'>a{b:c}</STYLE><i data-style="x:y" style=left:1px><style>d{e:f}"""
    got = scan.each_text(spark.createDataFrame([(1, html, 5), (2, None, 5), (3, "", 5)], "id int, html string, start int"), ["id"], "html", markup.page_declarations, "source string, number long, around string, property string, value string, start long, end long")
    rows = sorted(got.collect(), key=lambda r: r["start"])
    assert [(r.source, r.number, r.around, r.property, r.value) for r in rows] == [("p", 1, "", "color", "red"), ("p", 1, "", "top", "0"), ("style", 2, "a", "b", "c"), ("i", 3, "", "left", "1px"), ("style", 4, "d", "e", "f")]
    assert all(html[r["start"] : r["end"]].replace(" ", "") == f"{r.property}:{r.value}" for r in rows)
