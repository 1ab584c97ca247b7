"""Secret scan: fixed patterns, and guess costs of values that stand in a credential context."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, add_columns, field

#: The base patterns, with the least length of what they catch.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "guess")

#: A credential context: a name, a separator, then a value without white space or quotes.
CONTEXT = re.compile(r"""(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|auth)[_-]?key|auth|credentials?|login)["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*["']?([^\s"'<>,;]{6,})""")

#: Words that people put into passwords and placeholders, commonest first.
COMMON = """password admin welcome login user test secret token master root guest hello dragon monkey letmein iloveyou sunshine
princess football baseball shadow superman batman trustno changeme default example sample demo temp pass word key value none null
true false your here enter insert replace placeholder string text data name email mail home work office love happy summer winter
spring autumn monday friday january february march april june july august september october november december server database
system service account public private access company internet computer config settings process env environ getenv production
development staging credentials http https www com org net path page file app api stripe github docker localhost""".split()
#: Substitutions of letters, and the rows of a keyboard.
LEET = str.maketrans("4310$@7!5", "aeiosatis")
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:])} | {(a, b) for up, low in zip(ROWS, ROWS[1:]) for i, a in enumerate(up) for b in low[max(0, i - 1) : i + 1]}
NEXT |= {(b, a) for a, b in NEXT}
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")
YEAR = re.compile(r"(?:19|20)\d\d")
LOG_DATE, LOG_YEAR = math.log10(366 * 120), math.log10(120)
#: What one more segment multiplies the guesses by, as the cracker doesn't know where segments end.
LOG_SEGMENT = math.log10(2)


def brute(c: str) -> float:
    """log10 of the guesses for one character that fits nothing else."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isascii() and c.isalpha() else math.log10(33) if c.isascii() else 2.0


class Words:
    """Ranks of words, commonest first: COMMON, then learned ones."""

    def __init__(self, learned: list[str] | tuple[str, ...] = (), common: list[str] | tuple[str, ...] = COMMON):
        self.rank = {w: i for i, w in enumerate(dict.fromkeys([*common, *learned]), 1)}
        self.longest = max(map(len, self.rank), default=0)


KNOWN, NO_WORDS = Words(), Words(common=())


class Ends:
    """The cheapest start of a segment that costs log10 of its units, for ends from left to right.

    A start (cost, place) costs cost + log10((end - place) / width). Of two starts the earlier one gains on the later one with
    every end and overtakes it once at most, so starts lie on a stack: the last is the cheapest now, and those below it overtake
    in their turn. All starts and ends of a run together take time by its length.
    """

    def __init__(self, width: int):
        self.width = width
        self.stack: list[tuple[float, int, float]] = []  # cost, place, and the end from which the start below is cheaper

    def price(self, start: tuple[float, int, float], end: int) -> float:
        return start[0] + math.log10((end - start[1]) / self.width)

    def add(self, cost: float, place: int, end: int) -> None:
        """A start that may end at `end` or later; places ascend."""
        stack, new = self.stack, (cost, place, math.inf)
        self.settle(end)
        if stack and self.price(new, end) >= self.price(stack[-1], end):
            return
        turn = math.inf
        while stack:
            gain = 10.0 ** (cost - stack[-1][0]) if cost > stack[-1][0] else 1.0
            turn = (gain * place - stack[-1][1]) / (gain - 1.0) if gain > 1.0 else math.inf
            if turn < stack[-1][2]:
                break
            stack.pop()  # it never comes to its turn: the one below is cheaper by then
            turn = math.inf
        stack.append((cost, place, turn))

    def settle(self, end: int) -> None:
        while len(self.stack) > 1 and self.stack[-1][2] <= end:
            self.stack.pop()

    def best(self, end: int) -> float:
        self.settle(end)
        return self.price(self.stack[-1], end) if self.stack else math.inf


class Run:
    """Places from start to stop within which a repeat, walk or sequence may start and end: fixed + log10(units) + each * units."""

    def __init__(self, start: int, stop: int, width: int, least: int, fixed: float, each: float = 0.0):
        self.start, self.stop, self.least, self.fixed, self.each = start, stop, least * width, fixed, each
        self.ends = [Ends(width) for _ in range(width)]

    def step(self, end: int, here: list[float]) -> float:
        """The least cost of a segment that ends here; here[i] is that of what lies before a segment from i on."""
        if (i := end - self.least) >= self.start:
            self.ends[i % len(self.ends)].add(here[i] - self.each * i, i, end)
        return self.ends[end % len(self.ends)].best(end) + self.fixed + self.each * end


def stretches(n: int, goes_on) -> list[tuple[int, int]]:
    """(first, behind the last) of the places where goes_on holds without a break."""
    out, at = [], None
    for i in range(n + 1):
        if i < n and goes_on(i):
            at = i if at is None else at
        elif at is not None:
            out.append((at, i))
            at = None
    return out


def guess_cost(value: str, words: Words = KNOWN) -> float:
    """log10 of the guesses of the cheapest segmentation of the value (dynamic programming over its places).

    Segments are words (also with capitals or substituted letters), dates, years, repeats of 1 to 4 characters, keyboard walks,
    sequences of code points, and brute-forced characters, which count as one segment where they follow one another. A segment
    may start and end anywhere, and the work still follows the length: see Ends.
    """
    n = len(value)
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    cost_of = [brute(c) for c in value]
    runs: list[Run] = []
    for w in (1, 2, 3, 4):
        for a, b in stretches(n - w, lambda i, w=w: value[i] == value[i + w]):
            runs.append(Run(a, b + w, w, 3 if w == 1 else 2, sum(cost_of[a : a + w])))  # whole periods of one run cost the same
    runs += [Run(a, b + 1, 1, 4, math.log10(40) - 0.5 * LOG_SEGMENT, 0.5 * LOG_SEGMENT) for a, b in stretches(n - 1, lambda i: (low[i], low[i + 1]) in NEXT)]
    for d in (1, -1):
        runs += [Run(a, b + 1, 1, 3, math.log10(20)) for a, b in stretches(n - 1, lambda i, d=d: value[i + 1].isalnum() and ord(value[i + 1]) - ord(value[i]) == d)]
    runs = sorted((r for r in runs if r.stop - r.start >= r.least), key=lambda r: -r.start)
    active: list[Run] = []
    best = [0.0] + [math.inf] * n  # with the last segment closed
    open_run = [math.inf] * (n + 1)  # with a brute-force run going on
    here = [math.inf] * (n + 1)  # before a new segment
    for i in range(n + 1):
        while runs and runs[-1].start <= i:
            active.append(runs.pop())
        if active:
            active = [r for r in active if r.stop >= i]
            for r in active:
                best[i] = min(best[i], r.step(i, here))
        join = LOG_SEGMENT if i else 0.0
        here[i] = min(best[i], open_run[i]) + join
        if i == n:
            break
        open_run[i + 1] = min(open_run[i], best[i] + join) + cost_of[i]
        for j in range(i + 3, min(n, i + words.longest) + 1):
            if (rank := words.rank.get(low[i:j])) is not None:
                best[j] = min(best[j], here[i] + math.log10(rank) + (LOG_SEGMENT if value[i:j] != low[i:j] else 0))
            elif (rank := words.rank.get(plain[i:j])) is not None:
                best[j] = min(best[j], here[i] + math.log10(rank) + 2 * LOG_SEGMENT)
        if value[i].isdigit():
            for pattern, cost in ((DATE, LOG_DATE), (YEAR, LOG_YEAR)):
                if m := pattern.match(value, i):
                    best[m.end()] = min(best[m.end()], here[i] + cost)
    return min(best[n], open_run[n])


#: Learned words: how many at most, and in how many documents each is at least. What stands in a credential context teaches none.
MOST_WORDS, LEAST_DOCUMENTS = 20_000, 20
_TAUGHT = r"""(?i)(?:pass\w{0,20}|pwd|secret|token|key|auth\w{0,20}|credentials?|login)["']?[ \t]*+(?::=|=>|[:=])[ \t]*+["']?[^\s"'<>,;]++"""  # bounded, so the time follows the length


def learn_words(docs: DataFrame, text: str = "text", most: int = MOST_WORDS, least: int = LEAST_DOCUMENTS) -> Words:
    """The words of the documents (runs of 3 to 20 letters, lower-cased) by the number of documents that have them.

    All documents count; the driver gets the `most` commonest that are in `least` documents or more. Null and empty texts have
    no words; of a table without such words, only the fixed ones remain.

    Words by eighths of a power of two of their number come first, so that tasks send only those that may be among the
    commonest, not `most` of their own each.
    """
    scratch = Scratch(docs.sparkSession)
    each = F.array_distinct(F.split(F.lower(F.regexp_replace(F.col(text), _TAUGHT, " ")), r"[^\p{L}]+"))
    counted = docs.where(F.col(text).isNotNull()).select(F.explode(each).alias("word")).where(F.length("word").between(3, 20)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counted = scratch.stored(counted.where(F.col("n") >= least).withColumn("level", F.floor(8 * F.log2("n")).cast("int")), "words")
    above, cut = 0, 0
    for r in counted.groupBy("level").count().orderBy(F.desc("level")).collect():
        above, cut = above + r["count"], r["level"]
        if above >= most:
            break
    top = [r["word"] for r in counted.where(F.col("level") >= cut).orderBy(F.desc("n"), "word").limit(most).collect()]
    scratch.drop(counted)
    return Words(top)


#: log10 of the guesses from which a value in a credential context is a secret: six random characters have more, as a rule.
LEAST_COST = 7.5
#: The same for values that known words make much cheaper: passphrases.
LEAST_WORDS = 14.0
#: Cost in parts of the cost without any words from which a value counts as random, whatever words lie in it by chance.
RANDOM_SHARE = 0.7
#: Joins the known words of names, paths and addresses, which are no passphrases.
NAMES = frozenset("._/:$%()[]{}")
#: A place that a value is put in later: ${NAME}, $(name), %(name)s, {{name}}, [name].
PLACEHOLDER = re.compile(r"[$%]?[({\[]{1,2}+[\w.-]++[)}\]]{1,2}+[sd]?")


def is_secret(value: str, cost: float, least_cost: float = LEAST_COST, least_words: float = LEAST_WORDS) -> bool:
    """By the cost, but for placeholders: from least_cost; where known words save much of it, from least_words, unless they are
    joined as names are."""
    if cost < least_cost or PLACEHOLDER.fullmatch(value):
        return False
    return cost >= RANDOM_SHARE * guess_cost(value, NO_WORDS) or cost >= least_words and NAMES.isdisjoint(value)


def scan(text: str | None, least_cost: float = LEAST_COST, least_words: float = LEAST_WORDS, words: Words = KNOWN) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, log10 guesses) in order of start, then kind; offsets are code points, ends exclusive."""
    if not text:
        return []
    found: list[tuple[int, int, int, float | None]] = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGN]
        for m in CONTEXT.finditer(text):
            if is_secret(m[1], cost := guess_cost(m[1], words), least_cost, least_words):
                found.append((m.start(1), 3, m.end(1), cost))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    return [(KINDS[k], a, b, c) for a, k, b, c in sorted(found, key=lambda x: x[:3])]


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("log10_guesses", pa.float64())]))


def find_secrets(docs: DataFrame, text: str = "text", spans: str = "spans", least_cost: float = LEAST_COST, least_words: float = LEAST_WORDS, words: Words = KNOWN) -> DataFrame:
    """docs with the column `spans`: array of (kind, start, end, log10_guesses), by start, then kind.

    kind assign, access and hex are the fixed patterns; guess is a value in a credential context whose cheapest segmentation
    into common words, dates, repeats, keyboard walks and brute-force spans costs 10^least_cost guesses or more, or
    10^least_words where known words save much of it. words: ranks of common words, see learn_words. A null or empty text has no
    spans; texts and values of any length are scanned whole. Rows are independent. Columns of the new one's name are replaced.
    """

    def run(texts: list) -> list:
        each = [[{"kind": k, "start": a, "end": b, "log10_guesses": c} for k, a, b, c in scan(t, least_cost, least_words, words)] for t in texts]
        return [pa.array(each, type=SPAN)]

    return add_columns(docs, text, [field(spans, "array<struct<kind:string,start:int,end:int,log10_guesses:double>>", False)], lambda: run)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the numbers of base spans, the digest of the base spans, and all spans."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", least_cost: float = LEAST_COST, least_words: float = LEAST_WORDS, words: Words = KNOWN) -> DataFrame:
    """docs with every span of a secret in the text replaced by the mark; spans that overlap are one.

    A null text stays null and an empty one empty; texts of any length are scanned whole, and repeated rows give repeated results.
    All columns stay, whatever their names; an empty table gives an empty one.
    """

    def redacted(t: str | None) -> str | None:
        spans = scan(t, least_cost, least_words, words)
        if not spans:
            return t
        out, at, i = [], 0, 0
        while i < len(spans):
            _, a, b, _ = spans[i]
            while i + 1 < len(spans) and spans[i + 1][1] < b:
                i += 1
                b = max(b, spans[i][2])
            out += [t[at:a], mark]
            at, i = b, i + 1
        return "".join(out) + t[at:]

    columns = docs.columns
    changed = add_columns(docs, text, [field(text, "string")], lambda: lambda texts: [pa.array([redacted(t) for t in texts], type=pa.string())])
    return changed.select(*[F.col(f"`{c}`") for c in columns])
