"""Byte-level BPE: encoding and decoding.

Two tiers. A minimal perfect hash over the vocabulary resolves a pre-token that is itself a token;
anything else is merged with a heap of adjacent pairs over a linked list of byte ranges. Both results
are remembered per worker in a memo of bounded size, so that a repeated word costs one look-up.

Letters, numbers and the like are those of the tables that the ``tiktoken`` library was built with: where the pattern module's own are
newer, a character is read as one that both know and that stands as the library's would.

Defined results: null text counts as empty; empty text has no ids and decodes to no bytes; texts of any
length are encoded whole; repeated rows give repeated results; extra columns are left out of the result;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame

from tapeline.llm.common import map_arrow, schema

#: Pre-tokens (and words) that a worker remembers before it starts afresh.
MEMO_ENTRIES = 400_000
#: Longer pieces are not remembered.
MEMO_LENGTH = 64
_TWO_SPACES = re.compile(r"\s\s")


class PerfectHash:
    """Minimal perfect hash by displacement: n keys, n slots, one probe and one comparison a look-up."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.n_buckets = max(1, n // 3)
        buckets: dict[int, list[tuple[int, int, int]]] = {}
        for i, key in enumerate(keys):
            b, f, g = self._hashes(key)
            buckets.setdefault(b, []).append((i, f, g))
        self.shift = [0] * self.n_buckets
        self.slot_key: list[bytes | None] = [None] * n
        self.slot_value = [0] * n
        taken = bytearray(n)
        singles = []
        for b, members in sorted(buckets.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                singles.append((b, members[0][0]))
                continue
            d = 0
            while True:
                slots = [(f + d * g) % n for _, f, g in members]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for s, (i, _, _) in zip(slots, members, strict=True):
                taken[s] = 1
                self.slot_key[s], self.slot_value[s] = keys[i], i
        free = (s for s in range(n) if not taken[s])
        for b, i in singles:  # a bucket of one key names its slot: a negative displacement
            s = next(free)
            self.shift[b] = -s - 1
            self.slot_key[s], self.slot_value[s] = keys[i], i

    def _hashes(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h >> 64) % self.n_buckets, h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFF | 1

    def get(self, key: bytes) -> int:
        """Index of ``key`` among the keys, -1 for any other string."""
        if not self.n:
            return -1
        b, f, g = self._hashes(key)
        d = self.shift[b]
        s = -d - 1 if d < 0 else (f + d * g) % self.n
        return self.slot_value[s] if self.slot_key[s] == key else -1


class _Memo(dict):
    """A dict that computes what it lacks and starts afresh when full."""

    def __init__(self, compute, most: int = MEMO_ENTRIES):
        self.compute, self.most = compute, most

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= MEMO_LENGTH:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def stand_ins(pattern: str) -> dict[int, str]:
    """Characters that the pattern module and tiktoken put into different classes of ``pattern`` -> one that both put where tiktoken puts these."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    ranks = {bytes([b]): b for b in range(256)}
    mine, theirs = {}, {}
    for name in sorted({m.lower() if m[1] in "SWD" else m for m in regex.findall(r"\\[pP]\{\^?\w+\}|\\[sSwWdD]", pattern)}):
        library = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=ranks, special_tokens={})
        mine[name] = set(regex.findall(name, every))
        theirs[name] = set(library.decode_bytes(library.encode_ordinary(every)).decode())
    odd = {c for name in mine for c in mine[name] ^ theirs[name]}
    kind = lambda c: tuple(c in theirs[name] for name in theirs)
    known: dict[tuple, str] = {}
    wanted = {kind(c) for c in odd}
    for c in reversed(every):  # from the last: no character that a pattern is likely to name
        if len(known) == len(wanted):
            break
        if c not in odd and kind(c) in wanted:
            known.setdefault(kind(c), c)
    return {ord(c): known[kind(c)] for c in odd}


def _one_of(codes: list[int]) -> str:
    """A character class of whole ranges."""
    ranges: list[list[int]] = []
    for c in sorted(codes):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]"


class ByteBpe:
    """Encoder and decoder for ranks (token bytes -> id) and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.tokens = list(ranks)
        self.ids = [ranks[t] for t in self.tokens]
        self.ranks = ranks
        self.hash = PerfectHash(self.tokens)
        self.stand_ins = stand_ins(pattern)
        self._open()

    def _open(self) -> None:
        self._pattern = regex.compile(self.pattern)
        self._odd = re.compile(_one_of(list(self.stand_ins))).search if self.stand_ins else lambda text: None
        self._bytes_of = [b""] * (max(self.ids, default=-1) + 1)
        for t, i in zip(self.tokens, self.ids, strict=True):
            self._bytes_of[i] = t
        self._byte_id = [self.ranks[bytes([x])] if bytes([x]) in self.ranks else -1 for x in range(256)]
        #: Adjacent ids (left << 20 + right) -> id of their join, for every way to cut a token into two tokens.
        self._pairs = {(self.ranks[t[:k]] << 20) + self.ranks[t[k:]]: i for t, i in zip(self.tokens, self.ids, strict=True) for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks}
        #: A space and letters are one pre-token under this pattern.
        self.letters_stay = all(self._find(x) == [x] for x in (" a", " été", " Ab", " 日本"))
        self._piece = _Memo(self._encode_piece)
        self._word = _Memo(self._encode_word)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._open()

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}, pattern)

    def _find(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if text.isascii() or not self._odd(text):
            return self._pattern.findall(text)
        return [text[m.start() : m.end()] for m in self._pattern.finditer(text.translate(self.stand_ins))]

    def _encode_piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        i = self.hash.get(raw)
        if i >= 0:
            return struct.pack("<I", self.ids[i])
        return struct.pack(f"<{len(out)}I", *out) if (out := self.merge(raw)) else b""

    def merge(self, raw: bytes) -> list[int]:
        """Ids of a pre-token that is no token: the lowest-ranked adjacent pair merges first, the left one of ties."""
        n, pairs = len(raw), self._pairs
        ids = [self._byte_id[x] for x in raw]  # id of the run of bytes that starts here; -1: swallowed
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r << 32) + i for i in range(n - 1) if (r := pairs.get((ids[i] << 20) + ids[i + 1], -1)) >= 0]
        heapify(heap)
        while heap:
            x = heappop(heap)
            i, new = x & 0xFFFFFFFF, x >> 32
            j = after[i]
            if ids[i] < 0 or j >= n or pairs.get((ids[i] << 20) + ids[j], -1) != new:
                continue  # one side has changed since
            k = after[i] = after[j]
            ids[i], ids[j] = new, -1
            if k < n:
                before[k] = i
                if (r := pairs.get((new << 20) + ids[k], -1)) >= 0:
                    heappush(heap, (r << 32) + i)
            p = before[i]
            if p >= 0 and (r := pairs.get((ids[p] << 20) + new, -1)) >= 0:
                heappush(heap, (r << 32) + p)
        return [x for x in ids if x >= 0]

    def _encode_word(self, word: str) -> bytes:
        if self.letters_stay and word.isalpha() and (word.isascii() or not self._odd(word)):
            return self._encode_piece(" " + word)
        return b"".join(map(self._piece.__getitem__, self._find(" " + word)))

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers.

        A space between two other characters always starts a pre-token, so where no two white-space
        characters meet, words can be looked up whole.
        """
        if not text:
            return b""
        if text[0].isspace() or text[-1].isspace() or _TWO_SPACES.search(text):
            return b"".join(map(self._piece.__getitem__, self._find(text)))
        first, *rest = text.split(" ")
        return b"".join([*map(self._piece.__getitem__, self._find(first)), *map(self._word.__getitem__, rest)])

    def decode_packed(self, packed: bytes) -> bytes:
        return b"".join(map(self._bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def encode(docs: DataFrame, codec: ByteBpe, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids: packed binary) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)  # a vocabulary: its size does not follow the data

    def run(batch: pa.RecordBatch) -> dict:
        enc = shared.value.encode_packed
        return {id_col: batch.column(0), "ids": [enc(t or "") for t in batch.column(1).to_pylist()]}

    return map_arrow(docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias("text")), run, schema(f"{id_col} long,ids binary"))


def digest(docs: DataFrame, codec: ByteBpe) -> DataFrame:
    """Encode, decode and hash in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)

    def run(batch: pa.RecordBatch) -> dict:
        c, sha = shared.value, hashlib.sha256
        n, a, b = [], [], []
        for text in batch.column(1):
            ids = c.encode_packed(text.as_py() or "")
            n.append(len(ids) // 4)
            a.append(sha(ids).hexdigest())
            b.append(sha(c.decode_packed(ids)).hexdigest())
        return {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

    return map_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), run, schema("doc_id long,n_tokens long,ids_sha256 string,decoded_sha256 string"))
