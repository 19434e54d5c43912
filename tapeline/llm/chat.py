"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered into one string, which is encoded once with offsets. The turns' spans in that
string are sorted, and so are the tokens' spans; binary search finds the tokens that meet a span. A token
is under the loss where it meets an assistant's text, and its share of that text is the intersection.

Template, one turn after the other::

    ### Role: text</turn>\\n

``\\`` escapes: a backslash, and the control strings ``###`` and ``</turn>``, get a backslash in front wherever
they occur in a text (in a role also a colon and a line end), so the output can be read back exactly.

Defined results: rows are ordered by turn (null last), then role and text; null text or role counts as empty; repeated rows are
turns of their own; rows of null conv_id form one conversation; an empty table gives an empty result; extra
columns are left out. A conversation is one string by nature and is handled by one task.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import map_arrow, schema
from tapeline.llm.tokens import ByteLevel

_ESCAPE = re.compile(r"\\|###|</turn>")
_ESCAPE_ROLE = re.compile(r"\\|###|</turn>|:|\n")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)
LOSS_ROLE = "assistant"


def escape(text: str, pattern: re.Pattern = _ESCAPE) -> str:
    return pattern.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's string and the sorted spans of its assistants' texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role.capitalize() if role.islower() and role.isascii() else chr(0) + role, _ESCAPE_ROLE)}: ", escape(text)
        parts += [head, body, "</turn>\n"]
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len("</turn>\n")
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns read back from the string."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        role = unescape(m[1])
        out.append((role[1:] if role[:1] == "\0" else role.lower(), unescape(m[2])))
        at = m.end()
    return out


def mask(offsets: list[tuple[int, int]] | np.ndarray, spans: list[tuple[int, int]]) -> tuple[list[int], list[tuple[int, int]]]:
    """Indices of the tokens under the loss, and the sorted character ranges under it.

    ``offsets`` must not fall; tokens that share a character (parts of its bytes) name it more than once, which counts once.
    """
    both = np.asarray(offsets, np.int64).reshape(-1, 2)
    begins, ends = both[:, 0], both[:, 1]
    under, ranges = [], []
    for s, e in spans:
        lo, hi = np.searchsorted(ends, s, "right"), np.searchsorted(begins, e, "left")
        if s >= e or lo >= hi:
            continue
        a, b = np.maximum(begins[lo:hi], s), np.minimum(ends[lo:hi], e)
        under += (lo + np.flatnonzero(a < b)).tolist()
        a = np.maximum(a, np.concatenate([[s], np.maximum.accumulate(b)[:-1]]))
        fresh = a < b
        ranges += zip(a[fresh].tolist(), b[fresh].tolist(), strict=True)
    return under, ranges


class Formatter:
    """Renders, encodes and masks conversations with the tokenizer of a ``tokenizers`` file.

    With the same vocabulary as ranks, the faster encoder is taken where it is proven equal (see ``tokens``). Strings of
    added tokens in a text stay text: nobody can write a control token.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None):
        self.encoder = ByteLevel(json_path, ranks_path, pattern, special_as_text=True)

    def format(self, turns: list[tuple[str, str]]) -> tuple[str, list[int], list[int], list[tuple[int, int]]]:
        """(string, token ids, indices under the loss, character ranges under the loss)"""
        text, spans = render(turns)
        ids, begins, ends = self.encoder.offsets(text)
        return text, ids, *mask(np.stack([begins, ends], axis=1), spans)


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (turn, role, text) in order)."""
    turn = F.struct(rows["turn"].isNull().alias("none"), rows["turn"].cast("long").alias("turn"), F.coalesce(rows["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(rows["text"].cast("string"), F.lit("")).alias("text"))
    return rows.groupBy(rows["conv_id"].cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def formatted(rows: DataFrame, formatter: Formatter) -> DataFrame:
    """conv_id, formatted, token_ids, loss_tokens (indices), loss_starts, loss_ends (character ranges)."""
    shared = rows.sparkSession.sparkContext.broadcast(formatter)  # a vocabulary

    def run(batch: pa.RecordBatch) -> dict:
        made = [shared.value.format([(t["role"], t["text"]) for t in turns]) for turns in batch.column(1).to_pylist()]
        return {
            "conv_id": batch.column(0), "formatted": [m[0] for m in made], "token_ids": [m[1] for m in made], "loss_tokens": [m[2] for m in made],
            "loss_starts": [[a for a, _ in m[3]] for m in made], "loss_ends": [[b for _, b in m[3]] for m in made],
        }

    return map_arrow(conversations(rows), run, schema("conv_id long,formatted string,token_ids ints,loss_tokens ints,loss_starts ints,loss_ends ints"))


DIGEST = "conv_id long,n_turns long,turns_sha256 string,loss_chars long,loss_sha256 string,formatted_chars long"


def read_back(text: str, ranges: list[tuple[int, int]]) -> tuple[int, str, int, str, int]:
    """The digest of a formatted string and its mask: turns as parsed, text under the loss unescaped."""
    turns = parse(text)
    loss = unescape("".join([text[a:b] for a, b in ranges]))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), sha("".join([f"{r}\n{t}\n" for r, t in turns])), len(loss), sha(loss), len(text)


def _digests(found: list[tuple], convs) -> dict:
    names = [x.split()[0] for x in DIGEST.split(",")]
    return dict(zip(names, [convs, *map(list, zip(*found, strict=True))], strict=True))


def digest(made: DataFrame) -> DataFrame:
    """What the strings and masks of :func:`formatted` say, read back from them."""

    def run(batch: pa.RecordBatch) -> dict:
        rows = zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)
        return _digests([read_back(text, list(zip(starts, ends, strict=True))) for text, starts, ends in rows], batch.column(0))

    return map_arrow(made.select("conv_id", "formatted", "loss_starts", "loss_ends"), run, schema(DIGEST))


def formatted_digest(rows: DataFrame, formatter: Formatter) -> DataFrame:
    """:func:`digest` of :func:`formatted`, in one pass: strings and masks are made and read back in the same place."""
    shared = rows.sparkSession.sparkContext.broadcast(formatter)  # a vocabulary

    def run(batch: pa.RecordBatch) -> dict:
        found = []
        for turns in batch.column(1):
            text, _, _, ranges = shared.value.format([(t["role"], t["text"]) for t in turns.as_py()])
            found.append(read_back(text, ranges))
        return _digests(found, batch.column(0))

    return map_arrow(conversations(rows), run, schema(DIGEST))
