"""Chat formatting: conversations as one text between control strings, its token ids, and a loss mask over the ids.

A turn of a known role stands between the role's two control strings; any other role is written before its text. A control string
inside a text gets one more ESCAPE behind its first character, as does one that has some already, so a text never holds a control
string and gets back what it was. A conversation is rendered and encoded as a whole with the offsets of its tokens; control strings
are tokens of their own. The tokens under the loss are those that overlap an assistant's text: both the turns' spans and
the tokens' spans ascend, so each end of a span is found by binary search.

Rows are dealt by ranges of conversation and turn. A conversation that ends in another range than it starts in, or that is longer
than PART_CHARS, is written in parts, which are whole turns; its ids, mask and text are those of its parts one after another.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import MAX_VOCABULARY_BYTES
from .common import kept, map_arrow, pieces, plain_text

#: Control strings: what opens and closes a turn of the role; the last pair opens and closes one of another role, and SAYS ends its name.
ROLES = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER, SAYS = ("[TURN]", "[/TURN]"), "[SAYS]"
CONTROL = (*(c for pair in ROLES.values() for c in pair), *OTHER, SAYS)
ESCAPE = "~"
#: The role whose texts are under the loss.
LEARNED = "assistant"
#: Characters of a part, unless one turn alone is longer.
PART_CHARS = 1 << 20


def pattern(added: tuple[str, ...] = ()) -> str:
    """Control strings, those of the vocabulary (added) too, with any number of escapes behind the first character."""
    return "|".join(f"{re.escape(c[0])}{ESCAPE}*{re.escape(c[1:])}" for c in (*CONTROL, *added))


def escaped(text: str, controls: re.Pattern) -> str:
    return controls.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescaped(text: str, controls: re.Pattern) -> str:
    return controls.sub(lambda m: m[0][0] + m[0][2:] if m[0][1:2] == ESCAPE else m[0], text)


def render(turns: list[tuple[str, str]], controls: re.Pattern) -> tuple[str, np.ndarray]:
    """The text of the turns (role, text), and the spans in it of the learned role's texts, in code points."""
    out, at, spans = [], 0, []
    for role, text in turns:
        start, stop = ROLES.get(role, OTHER)
        head = start if role in ROLES else f"{start}{escaped(role, controls)}{SAYS}"
        body = escaped(text, controls)
        if role == LEARNED and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, stop)
        at += len(head) + len(body) + len(stop)
    return "".join(out), np.array(spans, dtype=np.int64).reshape(-1, 2)


def parse(text: str, controls: re.Pattern) -> list[tuple[str, str]]:
    """The turns of a rendered text; what isn't one is an error."""
    names = {start: (role, stop) for role, (start, stop) in ROLES.items()}
    turns, at = [], 0
    marks = [(m.start(), m.end(), m[0]) for m in controls.finditer(text) if m[0] in CONTROL]
    i = 0
    while i < len(marks):
        start, end, mark = marks[i]
        role, stop = names.get(mark, (None, OTHER[1]))
        if role is None:
            if mark != OTHER[0] or marks[i + 1][2] != SAYS:
                raise ValueError(f"no turn starts at {start}")
            role = unescaped(text[end : marks[i + 1][0]], controls)
            end, i = marks[i + 1][1], i + 1
        if start != at or i + 1 == len(marks) or marks[i + 1][2] != stop:
            raise ValueError(f"the turn at {start} has no end")
        turns.append((role, unescaped(text[end : marks[i + 1][0]], controls)))
        at, i = marks[i + 1][1], i + 2
    if at != len(text):
        raise ValueError(f"text after the last turn, at {at}")
    return turns


def loss_mask(spans: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """1 for each token (start, end) that overlaps a span, else 0; both ascend. A character's tokens all have its place."""
    mask = np.zeros(len(offsets) + 1, dtype=np.int64)
    first = np.searchsorted(offsets[:, 1], spans[:, 0], side="right")  # the first token that ends behind the span's start
    last = np.searchsorted(offsets[:, 0], spans[:, 1], side="left")  # the first that starts at its end or later
    np.add.at(mask, first, 1)
    np.add.at(mask, last, -1)
    return (np.cumsum(mask)[:-1] > 0).astype(np.uint8)


def byte_characters() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: itself if it prints, else the next from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(rest)}


class ChatEncoder:
    """A byte-level tokenizer whose control strings are tokens."""

    def __init__(self, definition: str):
        from tokenizers import AddedToken, Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = tuple(sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values()))
        self.tokenizer.add_special_tokens([AddedToken(c, normalized=False) for c in CONTROL])
        self.controls = re.compile(pattern(self.added))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and offsets (code points) of each text."""
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [(np.array(x.ids, dtype=np.int64), np.array(x.offsets, dtype=np.int64).reshape(-1, 2)) for x in found]

    @functools.cached_property
    def token_bytes(self) -> list[bytes]:
        of, special = byte_characters(), {*CONTROL, *self.added}
        out = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            out[i] = token.encode() if token in special else bytes(of[c] for c in token)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


@kept(2)
def _encoder(definition: str) -> ChatEncoder:
    return ChatEncoder(definition)


def read_definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        definition = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(definition) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: larger than {MAX_VOCABULARY_BYTES} characters")
    return definition


class _Part:
    """Turns of one conversation that are written together."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.chars = conv, [], 0


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[_Part]:
    now = None
    for batch in batches:
        for piece in pieces(batch, "text"):
            for conv, role, text in zip(*(piece.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now is None or now.conv != conv or now.chars + len(text) > PART_CHARS:
                    if now is not None:
                        yield now
                    now = _Part(conv)
                now.turns.append((role, text))
                now.chars += len(text)
    if now is not None:
        yield now


def _names(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(",")]


FORMATTED = "conv_id long, range int, part long, n_turns long, text string, ids binary, loss binary"


def format_conversations(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """Of each conversation its parts: conv_id, range and part (which order them), n_turns, text, ids (little-endian unsigned
    32-bit integers) and loss (a byte for each id, 1 under the loss). Most have one part.

    Turns are ordered by turn, null first; ties by role, then by a hash of the text, so repeated rows are turns next to each other. Null texts and
    roles are empty ones. A null conv_id is a conversation of its own. Other columns are not kept, whatever their names. Any
    number of turns of a conversation is formatted, in memory of one part; a turn of any length is a part. An empty table gives
    an empty one.
    """
    shared = conversations.sparkSession.sparkContext.broadcast(read_definition(tokenizer_path))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), plain_text("role").alias("role"), plain_text("text").alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, place = _encoder(shared.value), TaskContext.get().partitionId()
        names = _names(FORMATTED)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]

        def written(parts: list[tuple[int, _Part]]) -> pa.RecordBatch:
            made = [render(p.turns, encoder.controls) for _, p in parts]
            encoded = encoder.encode([text for text, _ in made])
            columns = [
                [p.conv for _, p in parts], [place] * len(parts), [k for k, _ in parts], [len(p.turns) for _, p in parts], [text for text, _ in made],
                [ids.astype("<u4").tobytes() for ids, _ in encoded], [loss_mask(spans, offsets).tobytes() for (_, spans), (_, offsets) in zip(made, encoded, strict=True)],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        waiting, chars = [], 0
        for k, part in enumerate(_parts(batches)):
            waiting.append((k, part))
            chars += part.chars
            if chars > PART_CHARS or len(waiting) >= 2000:
                yield written(waiting)
                waiting, chars = [], 0
        if waiting:
            yield written(waiting)

    return map_arrow(dealt, run, FORMATTED)


READ = "conv_id long, range int, part long, n_turns long, turns binary, loss_text binary, formatted_chars long"


def read_back(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """Of each part what its ids and mask say: n_turns, turns (role, line break, text, line break of each turn), loss_text (all
    text under the loss, unescaped) and formatted_chars. The texts come from the ids alone; text is only compared with them.
    """
    shared = formatted.sparkSession.sparkContext.broadcast(read_definition(tokenizer_path))
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]

    def one(encoder: ChatEncoder, text: str, ids: bytes, loss: bytes) -> tuple:
        tokens, under = np.frombuffer(ids, dtype="<u4"), np.frombuffer(loss, dtype=np.uint8)
        decoded = encoder.decode(tokens).decode()
        if decoded != text:
            raise ValueError("the ids don't decode to the text")
        turns = parse(decoded, encoder.controls)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], under, [0]])))
        learned = [unescaped(encoder.decode(tokens[a:b]).decode(), encoder.controls) for a, b in zip(edges[0::2], edges[1::2], strict=True)]
        return len(turns), "".join(f"{role}\n{said}\n" for role, said in turns).encode(), "".join(learned).encode(), len(decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        names = _names(READ)
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts, ids, loss = (piece.column(c).to_pylist() for c in ("text", "ids", "loss"))
                read = zip(*map(one, [encoder] * len(texts), texts, ids, loss), strict=True)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("conv_id", "range", "part")), *(pa.array(c, k) for c, k in zip(read, kinds[3:], strict=True))], names=names)

    return map_arrow(formatted.select("conv_id", "range", "part", "text", "ids", "loss"), run, READ)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(parts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation, from read_back's parts.

    A digest takes its bytes in order, so a conversation's parts pass through one task, one after another; only the state of the
    digest is kept of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for conv, n, turns, loss, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_turns", "turns", "loss_text", "formatted_chars")), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        yield ended(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += n
                state[2].update(turns)
                state[3] += len(loss.decode())
                state[4].update(loss)
                state[5] += chars
        if state is not None:
            yield ended(state)

    def ended(state: list) -> pa.RecordBatch:
        conv, n, turns, loss_chars, loss, chars = state
        row = [conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=_names(DIGESTS))

    together = parts.repartition("conv_id").sortWithinPartitions("conv_id", "range", "part")
    return map_arrow(together.select("conv_id", "n_turns", "turns", "loss_text", "formatted_chars"), run, DIGESTS)


def oracle() -> str:
    """The query's rows in SQL: the length of what is formatted follows from the escapes that each text needs."""
    escapes = pattern(("<|endoftext|>",)).replace("'", "''")
    length = lambda x: f"length(regexp_replace({x}, '({escapes})', '{ESCAPE}\\1', 'g'))"  # noqa: E731  where the escape stands makes no difference to the length
    around = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in ROLES.items())
    odd = "'</s>[INST] ok [/INST]'"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', {odd} UNION ALL SELECT -1, 1, 'assistant', {odd}
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({length("text")} + CASE role {around} ELSE {len("".join(OTHER) + SAYS)} + {length("role")} END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
