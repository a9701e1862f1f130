r"""Chat formatting with offset-aligned loss masks.

A turn is rendered as `<|start|>role\n`, the text, `<|end|>\n`. Inside texts a
control string gets one more backslash after its first character, which reading
back takes off again. Whole conversations are rendered and encoded once, with
offsets; a token is under the loss mask if its span meets the text span of a
turn of `loss_role`, found by binary search in the sorted turn spans.

A conversation streams through its task in turn order; nothing gathers it. A turn
ends in a line break and the next starts with a sign, where the split pattern of
byte-level BPE always ends a piece; so for such files the turns are encoded in
blocks of about `block_chars`, which gives the ids and offsets of one encoding of
the whole. With any other file a conversation is encoded at once, whatever its length.

Defined results: turns order by (turn, role, text) with nulls first; null role
and text are empty; rows without conv_id form the conversation of null; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .cluster import ship, spread

#: Fixed value: control strings of this and other chat templates, first character apart.
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)"
_ESCAPE = re.compile(CONTROL)
_UNESCAPE = re.compile(CONTROL.replace(r"(\\*)", r"\\(\\*)"))
START, END = "<|start|>", "<|end|>\n"
SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """The formatted text and the (first, end, role) character span of each turn's escaped text."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        spans.append((at + len(head), at + len(head) + len(body), role))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        out.append((unescape_role(role), unescape(rest[: -len(END)])))
    return out


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens (rows of first, end) meet one of the sorted, disjoint spans."""
    if not spans or not len(offsets):
        return np.zeros(len(offsets), dtype=bool)
    first, end = np.array(spans, dtype=np.int64).T
    k = np.searchsorted(end, offsets[:, 0], "right")
    inside = k < len(end)
    k = np.minimum(k, len(end) - 1)
    return inside & (first[k] < offsets[:, 1]) & (end[k] > first[k])


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray, spans: list[tuple[int, int]]) -> list[str]:
    """For each span its characters that masked tokens cover, unescaped."""
    out = []
    tokens = offsets[mask]
    starts = tokens[:, 0] if len(tokens) else np.zeros(0, np.int64)
    ends = tokens[:, 1] if len(tokens) else starts
    for a, b in spans:
        at, got = a, []
        for k in range(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))):
            x, y = max(int(starts[k]), at), min(int(ends[k]), b)
            if y > x:
                got.append(formatted[x:y])
                at = y
        out.append(unescape("".join(got)))
    return out


class _Conversation:
    def __init__(self, conv_id, tokenizer, loss_role: str, block_chars: float):
        self.id, self.tokenizer, self.role, self.most = conv_id, tokenizer, loss_role, block_chars
        self.turns, self.chars = [], 0
        self.n = self.loss_chars = self.formatted = self.tokens = self.loss_tokens = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str) -> None:
        self.turns.append((role, text))
        self.chars += len(text)
        if self.chars >= self.most:
            self.flush()

    def flush(self) -> None:
        if not self.turns:
            return
        formatted, spans = render(self.turns)
        code = self.tokenizer.encode(formatted, add_special_tokens=False)
        offsets = np.array(code.offsets, dtype=np.int64).reshape(-1, 2)
        wanted = [(a, b) for a, b, role in spans if role == self.role]
        mask = loss_mask(offsets, wanted)
        for role, text in read_back(formatted):
            self.all.update(f"{role}\n{text}\n".encode())
            self.n += 1
        for text in masked_text(formatted, offsets, mask, wanted):
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.formatted += len(formatted)
        self.tokens += len(offsets)
        self.loss_tokens += int(mask.sum())
        self.turns, self.chars = [], 0

    def row(self) -> tuple:
        self.flush()
        return self.id, self.n, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted, self.tokens, self.loss_tokens


def format_chats(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokenizer: str | None = None, loss_role: str = "assistant", block_chars: int = 1 << 20) -> DataFrame:
    """A row for each conversation: what is read back from its formatted text and its loss mask."""
    spark = conversations.sparkSession
    ship(spark)
    raw = spark.sparkContext.broadcast(bpe.read(tokenizer))
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.repartition(spread(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        tok = bpe.with_offsets(raw.value)
        most = block_chars if bpe.splits_turns(raw.value) else float("inf")
        now, out = None, []
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in SCHEMA.split(", ")]
        batch_of = lambda out: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        for batch in batches:
            for c, r, t in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                if now is None or now.id != c:
                    if now is not None:
                        out.append(now.row())
                    now = _Conversation(c, tok, loss_role, most)
                now.add(r, t)
            if out:
                yield batch_of(out)
                out = []
        if now is not None:
            yield batch_of([now.row()])

    return rows.mapInArrow(run, SCHEMA)
