"""A lexer for scripts: one walk over a text with a stack of modes, as where a token ends depends on what stands around it.

Modes are code, template text, the inside of a JSX tag, and the text between JSX tags; braces lead from each of them back into
code. A slash starts a regular expression where an expression may start; a `<` there starts a JSX tag, in files that may have any.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: What a token may be, tried in this order, in code and in the inside of a tag.
_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*(?s:.*?)(?:\*/|\Z))|(?P<string>\"(?:[^\"\\\n]|\\(?s:.))*+\"?|'(?:[^'\\\n]|\\(?s:.))*+'?)"
    r"|(?P<name>[^\W\d]\w*|[$][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>(?s:.))"
)
_NAME = re.compile(r"(?:[^\W\d]|[$])[\w$]*")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[\w$]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\(?s:.)|\$(?!\{))*+(?:`|\$\{|\Z)")
_JSX_STRING = re.compile(r"\"[^\"]*\"?|'[^']*'?")
_JSX_NAME = re.compile(r"[^\W\d][\w$.:-]*")
_JSX_TEXT = re.compile(r"[^<{]+")
#: Names after which an expression starts; after other names, numbers, strings and closing brackets an operator does.
BEFORE_EXPRESSION = frozenset("return typeof case in of delete void throw new instanceof do else yield await default extends".split())
#: File endings whose grammar has JSX; in others `<` never starts a tag, so `<T>x` is an assertion there.
JSX_ENDINGS = ("tsx", "jsx", "js", "mjs", "cjs")

CODE, TEMPLATE, TAG, TEXT = range(4)


def lex(text: str, jsx: bool = False) -> Iterator[tuple[int, int, str, str]]:
    """(start, line, kind, token) of all tokens, which make up the text; lines count from 1.

    Kinds: comment, string, template (its text up to and with `${`, and from `}` on), regex, name, number, space, mark, and for
    JSX tag names, attribute names and text: tag, attribute, text. What never ends, ends with the text, a string with its line.
    """
    modes: list[list] = [[CODE, 0]]  # mode, and for code the open braces, for a tag whether it is a closing one
    at, line, before, last = 0, 1, None, ""
    while at < len(text):
        mode = modes[-1]
        start = at
        if mode[0] == TEMPLATE:
            m = _TEMPLATE.match(text, at)
            kind, at = "template", m.end()
            modes.pop()
            if m[0].endswith("${") and not m[0].endswith("`"):
                modes.append([CODE, 0, TEMPLATE])
        elif mode[0] == TEXT and text[at] not in "<{":
            kind, at = "text", _JSX_TEXT.match(text, at).end()
        elif mode[0] == TEXT and text[at] == "{":
            kind, at = "mark", at + 1
            modes.append([CODE, 0, TEXT])
        elif mode[0] == TEXT:
            kind, at = "mark", at + 1
            closing = text.startswith("/", at)
            if closing:
                modes.pop()  # the text ends with the closing tag
            modes.append([TAG, closing])
        elif mode[0] == TAG:
            c = text[at]
            if c in "\"'":
                kind, at = "string", _JSX_STRING.match(text, at).end()
            elif c == "{":
                kind, at = "mark", at + 1
                modes.append([CODE, 0, TAG])
            elif c == ">":
                kind, at = "mark", at + 1
                modes.pop()
                if not mode[1] and last != "/":
                    modes.append([TEXT])
            elif m := _JSX_NAME.match(text, at):
                kind, at = ("tag" if last in ("<", "/") else "attribute"), m.end()
            else:
                m = _TOKEN.match(text, at)
                kind, at = m.lastgroup, m.end()
                if kind not in ("space", "comment"):
                    kind, at = "mark", start + 1
        else:
            c = text[at]
            operand = before in ("name", "number", "string", "regex", "end") and not (before == "name" and last in BEFORE_EXPRESSION)
            if c == "`":
                m = _TEMPLATE.match(text, at + 1)
                kind, at = "template", m.end()
                if m[0].endswith("${") and not m[0].endswith("`"):
                    modes.append([CODE, 0, TEMPLATE])
            elif c == "}" and len(mode) > 2 and not mode[1]:
                modes.pop()
                if mode[2] == TEMPLATE:
                    m = _TEMPLATE.match(text, at + 1)
                    kind, at = "template", m.end()
                    if m[0].endswith("${"):
                        modes.append([CODE, 0, TEMPLATE])
                else:
                    kind, at = "mark", at + 1
            elif c == "/" and not operand and last != "<" and (m := _REGEX.match(text, at)):
                kind, at = "regex", m.end()
            elif jsx and c == "<" and not operand and _starts_tag(text, at + 1):
                kind, at = "mark", at + 1
                modes.append([TAG, False])
            else:
                m = _NAME.match(text, at) or _TOKEN.match(text, at)
                kind, at = m.lastgroup or "name", m.end()
                if kind == "mark":
                    mode[1] += (c == "{") - (c == "}")
        token = text[start:at]
        yield start, line, kind, token
        line += token.count("\n")
        if kind not in ("space", "comment"):
            before, last = kind, token
            if kind == "template" and token.endswith("`") or kind == "mark" and token in ")]}" and token:
                before = "end"
            if kind == "mark" and token == ">" and mode[0] == TAG and modes[-1][0] == CODE:
                before = "end"  # of an element


def _starts_tag(text: str, at: int) -> bool:
    """Whether a tag or fragment follows: a name that is no type parameter, or `>`."""
    if text.startswith(">", at):
        return True
    m = _JSX_NAME.match(text, at)
    return bool(m) and not re.compile(r"\s*(?:,|extends\b|=[^>\s\"'{])").match(text, m.end())
