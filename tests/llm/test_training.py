"""Chat formatting, phrase mining and fill-in-the-middle against plain versions."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factgrid.llm import chat, infill, phrases
from factgrid.llm.queries import ORACLE_SQL, QUERIES

NEW = ["op7_jaccard_join", "op11_chat_format", "op12_collocations", "op13_fill_in_middle"]


@pytest.mark.parametrize("name", NEW)
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf), con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=str)


def plain_infill(doc_id, text):
    """The contract, unit by unit."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [None, "", " ", "a", "é", "ab cd", "<P", "x<M>y", "<<P", "a\nb\r\n c", "漢字" * 700, "word " * 3000, "Z" * 5000, "\U0001d4b3a" * 600, "[`{@" * 300, "S><P" * 40]


def test_infill_matches_plain(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD * 8)] + [(3, "repeated row", "clash")] * 2 + [(None, "no id", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, FORM string")
    out = infill.fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]  # FORM gave way
    got = out.withColumn("again", infill.restored(out["output"], out["form"])).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_infill(r.doc_id, r.text)
        assert r.again == (r.text or "")
    assert infill.fill_in_middle(docs.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZ é漢\U0001d4b3\n<>PSM@[`{", max_size=80), max_size=6), st.integers(1, 9), st.randoms(use_true_random=False))
def test_cuts_of_any_text(texts, block, random):
    data = [t.encode() for t in texts]
    flat = np.frombuffer(b"".join(data), dtype=np.uint8)
    trees = infill.BlockTrees(flat, np.cumsum([0, *map(len, data)]), block)
    units = [re.findall(r"[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    wanted = np.array([random.randint(0, len(u)) for u in units], dtype=np.int64)
    size, points = trees.cut(wanted)
    for u, k, a, b in zip(units, wanted.tolist(), size.tolist(), points.tolist(), strict=True):
        head = "".join(u[:k])
        assert (len(head.encode()), len(head)) == (a, b)


JSON_PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [*chat.CONTROL, "<|endoftext|>", "~", "<", ">", "[", "]", "<<", "SYS>>", "s>", "/", "INST]", " ", "é", "漢", "\U0001d4b3", "\n", "ok", "'s", "[~INST]"]
said = st.lists(st.sampled_from(PIECES), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["system", "user", "assistant"]), said), said), max_size=6))
def test_rendered_turns_are_read_back(turns):
    encoder = chat._encoder(chat.read_definition(JSON_PATH))
    text, spans = chat.render(turns, encoder.controls)
    assert chat.parse(text, encoder.controls) == turns
    assert [chat.unescaped(text[a:b], encoder.controls) for a, b in spans.tolist()] == [t for role, t in turns if role == "assistant" and t]
    ((ids, offsets),) = encoder.encode([text])
    assert encoder.decode(ids).decode() == text
    mask = chat.loss_mask(spans, offsets)
    assert mask.tolist() == [int(any(a < y and x < b for x, y in spans.tolist())) for a, b in offsets.tolist()]
    assert encoder.decode(ids[mask == 1]).decode() == "".join(text[a:b] for a, b in spans.tolist())
    strings = {encoder.tokenizer.token_to_id(c) for c in (*chat.CONTROL, "<|endoftext|>")}
    assert sum(int(i) in strings for i in ids) == sum(2 + (role not in chat.ROLES) for role, _ in turns)  # none from a text


def plain_chat(rows):
    turns = [(r or "", t or "") for _, r, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))]
    learned = "".join(t for r, t in turns if r == "assistant")
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), hexed("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), hexed(learned)


def test_conversations_in_parts(spark):
    roles, texts = ("user", "assistant", None, "tool</s>"), ("one <s>é", None, "", "x[INST]" * 50, "[~INST] two")
    rows = [(c, k, roles[(k or 0) % 4], texts[((c or 3) + (k or 4)) % 5]) for c in (0, 1, None) for k in (*range(7), None)]
    rows += [(5, k, ("user", "assistant")[k % 2], f"long {k} " * 40000) for k in range(12)]  # several parts
    rows += [(6, 1, "assistant", "twice")] * 3 + [(7, 0, "assistant", "")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, IDS string").repartition(3)
    formatted = chat.format_conversations(table, JSON_PATH)
    parts = {r.conv_id: r.n for r in formatted.groupBy("conv_id").agg({"*": "count"}).toDF("conv_id", "n").collect()}
    assert parts[5] > 2 and sum(parts.values()) < 20
    got = {r.conv_id: r for r in chat.digests(chat.read_back(formatted, JSON_PATH)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == plain_chat([x[1:] for x in rows if x[0] == conv])
    assert chat.format_conversations(table.limit(0), JSON_PATH).collect() == []


def plain_counts(rows, longest=3):
    """Counts of the phrases of each language, by a walk over all texts."""
    counts = Counter()
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, longest + 1):
                counts.update((lang or "und", " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
    return counts


def plain_top(rows, least, first):
    counts = plain_counts(rows)
    totals = Counter()
    for (lang, phrase), n in counts.items():
        totals[lang] += n * (" " not in phrase)
    good = {k: n for k, n in counts.items() if " " in k[1] and n >= least}
    out = {}
    for (lang, phrase), a in good.items():
        words = phrase.split(" ")
        around = [x for (g, p), x in good.items() if g == lang and len(p.split(" ")) > len(words) and f" {phrase} " in f" {p} "]
        if any(100 * x >= 50 * a for x in around):
            continue
        cuts = []
        for k in range(1, len(words)):
            x, y = counts[lang, " ".join(words[:k])], counts[lang, " ".join(words[k:])]
            cuts.append((1000000 * a * a // (x * y), k, x, y))
        score, _, x, y = min(cuts)
        out.setdefault(lang, []).append((-score, -a, phrase.encode(), (phrase, a, x, y, totals[lang], score)))
    return {(lang, i + 1, *r[-1]) for lang, rows in out.items() for i, r in enumerate(sorted(rows)[:first])}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.text(alphabet="aAb é\t.\n\x0b,漢\x85\xa0", max_size=40)), st.sampled_from(["en", "und"])), max_size=6))
def test_phrases_of_any_texts(rows):
    chunk = phrases.Chunk(pa.array([t for t, _ in rows], pa.string()), [g for _, g in rows])
    found = Counter()
    for size in (1, 2, 3):
        if size > 1:
            chunk.longer(np.ones(len(chunk.counts), dtype=bool))
        langs, words = chunk.phrases(np.arange(len(chunk.counts)))
        found.update(dict(zip(zip(langs.to_pylist(), words.to_pylist(), strict=True), chunk.counts.tolist(), strict=True)))
    assert found == plain_counts(rows)


@pytest.mark.parametrize("shards", [1, 4])
def test_collocations_match_plain(spark, monkeypatch, shards):
    monkeypatch.setattr(phrases, "BUFFERED", 50)
    random = np.random.default_rng(3)
    pick = lambda n: " ".join(random.choice(["the", "Cat", "sat", "on", "mat", "a", "dog", "x.", "é"], p=[0.3, 0.2, 0.15, 0.1, 0.05, 0.05, 0.05, 0.05, 0.05], size=n))
    rows = [(pick(int(random.integers(0, 60))), ["en", "fr", None][int(random.integers(3))]) for _ in range(60)]
    rows += [(None, "en"), ("", "fr"), ("one two  three\tfour", "en")] + [("ties of copies", "en")] * 12 + [("word " * 5000, "de")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "text string, lang string, PHRASE string").repartition(7)
    got = {tuple(r) for r in phrases.top_phrases(docs, first=40, shards=shards).collect()}
    assert got == plain_top(rows, 10, 40) and len(got) > 50
    assert phrases.top_phrases(docs.limit(0)).collect() == []


def test_scores_beyond_64_bits(spark):
    n = 3 * 10**12
    counts = spark.createDataFrame([("en", 1, "a", n), ("en", 1, "b", n + 7), ("en", 2, "a b", n - 1), ("en", 0, "", 3 * n)], "lang string, size int, phrase string, n long")
    (row,) = phrases.score_phrases(counts).collect()
    assert row.score == 1000000 * (n - 1) ** 2 // (n * (n + 7))


def test_filter_has_all_candidates(spark):
    numbers = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000) & -4
    known = phrases.Filter(phrases.make_filter(spark.createDataFrame(pa.table({"number": numbers})), 5000))
    assert known.has(numbers.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 5000)
    assert known.has(others.view(np.uint64)).mean() < 0.1
