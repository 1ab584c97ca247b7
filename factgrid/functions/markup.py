"""State machines over the tokens of markup: the elements of a page with their nesting, and the declarations of its styles.

Both walk a text once, from one `<`, quote, brace or semicolon to the next, and keep a stack or a mode between them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Fixed values of the HTML standard: elements without content, and those whose content is text up to their end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
#: Fixed values of the HTML standard: start tags that end an open paragraph.
ENDS_P = (
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul",
)
#: Start tags that end an open element of these names, unless an element of the second list lies between.
IMPLIED = {
    **{name: (("p",), ("applet", "button", "caption", "html", "marquee", "object", "table", "td", "template", "th")) for name in ENDS_P},
    "li": (("li",), ("ol", "ul", "menu", "table", "div")),
    "dd": (("dd", "dt"), ("dl", "div")),
    "dt": (("dd", "dt"), ("dl", "div")),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "thead": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_NAME = re.compile(r"</?[A-Za-z]")


def html_tags(html: str) -> Iterator[tuple[str, str, str, int, int]]:
    """(kind, name, attributes, start, end) of each tag, in order: kind is `open`, `close` or `raw`; raw is the text within a
    start tag of RAW and its end tag. Comments, declarations and what isn't a tag are passed over; a tag that the text ends in
    is none."""
    at = 0
    while (i := html.find("<", at)) >= 0:
        if html.startswith("<!--", i):
            end = html.find("-->", i + 4)
            at = len(html) if end < 0 else end + 3
        elif html.startswith(("<!", "<?"), i):
            end = html.find(">", i)
            at = len(html) if end < 0 else end + 1
        elif m := _TAG.match(html, i):
            name, at = m[2].lower(), m.end()
            yield ("close" if m[1] else "open"), name, m[3], i, at
            if not m[1] and name in RAW:
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
                end = stop.start() if stop else len(html)
                yield "raw", name, html[at:end], at, end
                at = end
        elif _NAME.match(html, i):
            return
        else:
            at = i + 1


def html_elements(html: str) -> list[tuple[int, int, int | None, int, str, int, int]]:
    """(enter, leave, parent, depth, tag, start, end) of each element.

    Elements are numbered from 1 as they start; enter is an element's number, leave that of the last one within it (its own
    where there is none), parent the enter number of the element around it, depth 1 for the outermost. start and end are
    offsets of its first and behind its last character. A start tag ends what IMPLIED says; an end tag ends all elements up to
    the innermost of its name, or none where no such one is open; the end of the text ends all. Elements that HTML would add
    or open again are not made up.
    """
    done: list[tuple] = []
    stack: list[tuple[int, str, int]] = []
    number = 0

    def close(upto: int, end: int) -> None:
        while len(stack) > upto:
            enter, tag, start = stack.pop()
            done.append((enter, number, stack[-1][0] if stack else None, len(stack) + 1, tag, start, end))

    for kind, name, _, start, end in html_tags(html):
        if kind == "close":
            found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][1] == name), None)
            if found is not None:
                close(found + 1, start)
                close(found, end)
        elif kind == "open":
            ended, walls = IMPLIED.get(name, ((), ()))
            for i in range(len(stack) - 1, -1, -1) if ended else ():
                if stack[i][1] in ended:
                    close(i, start)
                    if name != "tr":
                        break
                elif stack[i][1] in walls:
                    break
            number += 1
            stack.append((number, name, start))
            if name in VOID:
                close(len(stack) - 1, end)
    close(0, len(html))
    return done


def css_declarations(css: str) -> Iterator[tuple[str, str, str, int, int]]:
    """(property, value, around, start, end) of each declaration of a sheet, or of a style attribute's list.

    around is what stands before the braces around it, from outside in, joined by ` > `; start and end are its place without
    white space around. Comments are blanks; strings, and what stands in parentheses or brackets, end nothing; an escaped
    character stands for itself. What stands between braces and semicolons without a colon is no declaration, nor are
    at-rules without a block and what has an empty name. Ends that are missing are where the text ends.
    """
    heads: list[str] = []
    begin, colon, depth = 0, -1, 0
    blank: list[tuple[int, int]] = []  # comments since begin
    i, n = 0, len(css)

    def plain(a: int, b: int) -> str:
        out, at = [], a
        for x, y in blank:
            if a <= x < b:
                out += (css[at:x], " ")
                at = y
        return "".join([*out, css[at:b]]).strip()

    def declaration(stop: int) -> Iterator[tuple]:
        name = plain(begin, colon) if colon >= 0 else ""
        if not name or name.startswith("@"):
            return
        a, b = begin, stop
        while a < b and (css[a].isspace() or any(x == a for x, _ in blank)):
            a = next((y for x, y in blank if x == a), a + 1)
        ends = {y: x for x, y in blank}
        while b > a and (css[b - 1].isspace() or b in ends):
            b = ends.get(b, b - 1)
        yield name, plain(colon + 1, stop), " > ".join(heads), a, b

    while i < n:
        c = css[i]
        if c == "\\":
            i += 2
            continue
        if c in "\"'":
            i += 1
            while i < n and css[i] not in (c, "\n"):
                i += 2 if css[i] == "\\" else 1
        elif css.startswith("/*", i):
            end = css.find("*/", i + 2)
            end = n if end < 0 else end + 2
            blank.append((i, end))
            i = end
            continue
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth = max(0, depth - 1)
        elif not depth and c in "{};":
            if c == "{":
                heads.append(plain(begin, i))
            else:
                yield from declaration(i)
                if c == "}" and heads:
                    heads.pop()
            begin, colon = i + 1, -1
            blank.clear()
        elif c in "{}" and depth:  # a parenthesis that is never closed ends with its block
            depth = 0
            continue
        elif c == ":" and colon < 0 and not depth:
            colon = i
        i += 1
    yield from declaration(n)


_STYLE = re.compile(r"(?:^|[\s\"'/])style\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+))", re.I)


def page_declarations(html: str) -> Iterator[tuple[str, int, str, str, str, int, int]]:
    """(source, number, around, property, value, start, end) of each declaration of a page: source is `style` for its style
    elements and the element's name for a style attribute, number counts sheets and attributes from 1, places are the page's."""
    number = 0
    for kind, name, text, start, _ in html_tags(html):
        if kind == "raw" and name == "style":
            number += 1
            for prop, value, around, a, b in css_declarations(text):
                yield "style", number, around, prop, value, start + a, start + b
        elif kind == "open" and (m := _STYLE.search(text)):
            group = next(g for g in (1, 2, 3) if m[g] is not None)
            number += 1
            shift = start + 1 + len(name) + m.start(group)
            for prop, value, around, a, b in css_declarations(m[group]):
                yield name, number, around, prop, value, shift + a, shift + b
