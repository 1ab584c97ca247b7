"""Sharding, byte-level BPE and record files against plain versions."""

import base64
import bisect
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factgrid.llm import bpe, pretokens, records, sharding
from factgrid.llm.common import fresh_path

RANKS_PATH, JSON_PATH = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS_PATH, "rb"))}
OWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = [None, "", " ", "a" * 3000, "abcd" * 700, "x" * 257 + " y", "it's we'll 'sab ''s they're've", "<|endoftext|>", "é漢\U0001d4b3 ١٣", " \n\t x  \n", "\x1c\x85\xa0'd", "word " * 20000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(3, ODD[3], "clash"), (None, "no id", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, IDS string")


def test_bpe_matches_the_library(docs):
    out = bpe.encode_documents(docs, RANKS_PATH, public_tokenizers.PATTERN, decoded="decoded")
    assert out.columns == ["doc_id", "text", "ids", "decoded"]  # IDS gave way
    rows = out.collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        ids = OWN.encode_ordinary(r.text or "")
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(r.decoded) == (r.text or "").encode()
    digests = {r.doc_id: r for r in bpe.digests(out).collect()}
    assert digests[0].n_tokens == 0 and digests[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    back = bpe.decode_documents(out.drop("decoded"), RANKS_PATH).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)


def test_pairs_for_the_heap_are_made_when_a_long_piece_comes():
    table = bpe.PairTable(RANKS)
    encoder = pretokens.TextEncoder(pretokens.PieceStore(table.encode_pieces))
    for text, made in (("short words only", False), ("abcd" * 700, True)):
        assert encoder.encode([text])[0].tolist() == OWN.encode_ordinary(text)
        assert ("pairs" in vars(table)) == made


def test_bpe_of_an_empty_table(docs):
    assert bpe.encode_documents(docs.limit(0), RANKS_PATH, public_tokenizers.PATTERN).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc \n\t'sdtrelvm1٣é漢\x1c\x85 .,!-_́\U0001d4b3", max_size=60), max_size=8))
def test_bpe_of_any_text(texts):
    encoder = bpe._encoder(bpe.read_ranks(RANKS_PATH), public_tokenizers.PATTERN)
    ids, counts = encoder.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [OWN.encode_ordinary(t) for t in texts] or not texts
    other = pretokens.TextEncoder(encoder.store, public_tokenizers.PATTERN + "|(?!)")  # the general splitter
    assert other.encode(texts)[0].tolist() == ids.tolist()


def test_long_pieces_take_the_same_merges():
    table = bpe._table(bpe.read_ranks(RANKS_PATH))
    rng = random.Random(4)
    for n in (2, 40, 300):
        word = bytes(rng.choice(b"thernigao") for _ in range(n))
        start = table.of_byte[np.frombuffer(word, dtype=np.uint8)]
        assert table.merge_long(start.tolist()) == OWN.encode_ordinary(word.decode())


def test_a_full_store_is_emptied():
    table = bpe._table(bpe.read_ranks(RANKS_PATH))
    encoder = pretokens.TextEncoder(pretokens.PieceStore(table.encode_pieces, bound=5))
    for text in ("one two three four five six seven", "eight nine one two", "ten six"):
        assert encoder.encode([text])[0].tolist() == OWN.encode_ordinary(text)


def test_records_round_trip(spark, docs):
    path = fresh_path(spark, "records")
    records.write_documents(docs, path, JSON_PATH)
    records.write_index(spark, path, f"{path}-index")
    tokenizer = Tokenizer.from_file(JSON_PATH)
    want, start = [], 0
    for doc_id, text, _ in sorted(map(tuple, docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    got = sorted(map(tuple, records.digests(spark, path, f"{path}-index").collect()), key=lambda r: r[1])
    assert got == want
    index = spark.read.parquet(f"{path}-index")
    some = records.read_records(spark, path, index.where("doc_id = 7"), "ordinal").collect()
    assert [(r.doc_id, bytes(r.ids)) for r in some] == [(7, struct.pack("<2I", *tokenizer.encode("<|endoftext|>", add_special_tokens=False).ids, 0))]
    with pytest.raises(Exception, match="checksum|outside"):
        records.read_records(spark, path, index.withColumn("offset", index["offset"] + 1), "ordinal").collect()
    shuffled = [(r.doc_id, len(r.ids) // 4) for r in records.read_shuffled(spark, path, f"{path}-index", seed=5).collect()]
    assert sorted(shuffled, key=str) == sorted(((w[0], w[2]) for w in want), key=str)
    assert shuffled != [(r.doc_id, len(r.ids) // 4) for r in records.read_shuffled(spark, path, f"{path}-index", seed=6).collect()]


def test_records_of_an_empty_table(spark, docs):
    path = fresh_path(spark, "records")
    records.write_documents(docs.limit(0), path, JSON_PATH)
    records.write_index(spark, path, f"{path}-index")
    assert records.digests(spark, path, f"{path}-index").collect() == []


def test_starts_follow_the_numbers_of_files(spark):
    rows = [(f"part-{k:05d}-x-c000.txt", o, k, 0, 0, 10 + o) for k in (99999, 100000, 100001, 2) for o in (0, 1)]
    got = {(r.doc_id, r.ordinal): r.start for r in records.placed(spark.createDataFrame(rows, records.INDEX)).collect()}
    assert got == {(2, 0): 0, (2, 1): 10, (99999, 0): 21, (99999, 1): 31, (100000, 0): 42, (100000, 1): 52, (100001, 0): 63, (100001, 1): 73}


def test_files_are_even_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(records, "FILE_BYTES", 100_000)
    rows = [(i, "long text " * 2000 if 400 <= i < 440 else "short") for i in range(2000)] + [(420, "same " * 1000)] * 60
    path = fresh_path(spark, "records")
    files = records.write_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, JSON_PATH)
    loads = [r.n for r in records.scan_records(spark, path).groupBy("file").agg({"n_tokens": "sum"}).toDF("file", "n").collect()]
    assert files == 12 and len(loads) == 12 and max(loads) < 3 * sum(loads) / len(loads)


def test_checksums():
    data = np.frombuffer(random.Random(1).randbytes(5000), dtype=np.uint8)
    table = records._crc_table()

    def slow(b):
        c = 0xFFFFFFFF
        for x in b:
            c = int(table[(c ^ x) & 255]) ^ (c >> 8)
        return c ^ 0xFFFFFFFF

    assert records.crc32c(np.frombuffer(b"123456789", dtype=np.uint8), np.array([0]), np.array([9]))[0] == 0xE3069283
    spans = [(0, 0), (3, 1), (5, 255), (0, 256), (1, 257), (7, 3000), (0, 5000)]
    got = records.crc32c(data, np.array([a for a, _ in spans]), np.array([n for _, n in spans]))
    assert got.tolist() == [slow(data[a : a + n].tobytes()) for a, n in spans]


def test_broken_records_are_errors():
    out, _ = records.frames([1, None], np.array([5, 6, 7]), np.array([2, 1]), 2)
    whole = out.tobytes()
    first = 12 + 10 + 4 + 4
    content = whole[:first] + b"\n" + whole[first:] + b"\n"
    starts, lengths = records.walk(content)
    assert [k for k, _ in records._records(content, starts, lengths)] == [1, None]
    for bad in (content[:-3], content[:20] + b"\xff" + content[21:], b"\x01" + content[1:]):
        with pytest.raises(ValueError):
            records.walk(bad)


def plain_shards(rows, shards, nodes, slack=0.0):
    """Every key asks for its shards clockwise, one after another."""
    ring = sharding.ring(shards, nodes)
    keys = []
    for k, size, crc in rows:
        place = sharding.place_of("null" if k is None else str(k))
        arc = bisect.bisect_left(ring.points, place)
        over = arc == len(ring.points)
        keys.append((0 if over else arc, not over, place, (k is not None, k or 0), size, crc, k))
    keys.sort()
    capacity, used, got = sharding.capacities(len(keys), shards, slack), [0] * shards, [None] * len(keys)
    for turn in range(shards):
        for i, x in enumerate(keys):
            shard = ring.orders[x[0]][turn]
            if got[i] is None and used[shard] < capacity[shard]:
                got[i] = (shard, used[shard])
                used[shard] += 1
    return sorted(((x[6], x[4], x[5], *g) for x, g in zip(keys, got, strict=True)), key=str)


@pytest.mark.parametrize(("shards", "slack"), [(8, 0.0), (3, 0.2)])
def test_shards_match_a_plain_ring(spark, shards, slack):
    rows = [(i, f"text {i % 7}") for i in range(300)] + [(5, "x"), (5, "x"), (5, None), (None, "y"), (None, None)] + [(7, "hot")] * 1500
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    size = lambda t: len((t or "").encode())
    want = plain_shards([(k, size(t) + 1, zlib.crc32((t or "").encode())) for k, t in rows], shards, 64, slack)
    out = sharding.assign_shards(docs, shards, slack=slack).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in out), key=str) == want
    loads = [sum(r.shard == s for r in out) for s in range(shards)]
    assert slack or max(loads) - min(loads) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in enumerate(loads))


def test_few_keys_move_when_a_shard_is_added(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(2000)], "doc_id long, text string")
    at = lambda n: {r.doc_id: r.shard for r in sharding.assign_shards(docs, n).collect()}  # noqa: E731  as the query runs
    before, after = at(8), at(9)
    moved = sum(before[k] != after[k] for k in before) / len(before)
    assert 1 / 9 - 0.01 < moved < 0.16


def test_orders_of_a_ring_are_clockwise():
    circle = sharding.ring(5, 7)
    n = len(circle.points)
    assert circle.points == sorted(circle.points)
    assert all(circle.orders[i] == list(dict.fromkeys(circle.owners[(i + k) % n] for k in range(n))) for i in range(n))
    assert len(sharding.ring(128, 128).orders) == 1 << 14


def test_shards_of_an_empty_table(spark):
    assert sharding.assign_shards(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        sharding.ring(0, 1)


def test_new_pieces_go_to_the_library_in_groups(monkeypatch):
    """One encoding for many pieces, with the ids that whole texts get."""
    monkeypatch.setattr(records, "GROUP", 7)
    definition = open(JSON_PATH, encoding="utf-8").read()
    encode = records.text_encoder.__wrapped__(definition)
    texts = [t for t in ODD if t] + [" ".join(f"w{i} é{i}漢" for i in range(300))]
    want = [x.ids for x in Tokenizer.from_str(definition).encode_batch(texts, add_special_tokens=False)]
    ids, counts = encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
