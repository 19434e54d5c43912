"""Periodic runs of words: maximal stretches that repeat with a period, found by partition refinement.

Positions of a text fall into classes by the factor of a given length that starts there, chained in order. From one length to the next
a class splits by the classes that follow its members; only classes that split off, never the largest part of one that split, are used to
split others, so a position is touched about log n times. Where neighbours of a class lie exactly as far apart as the factor is long, a
square starts (of primitive root, as nearer members would have been the neighbours); consecutive squares of a length are one maximal run.

Only runs of at least ``EXPONENT`` periods and ``LEAST`` words count, so a class of fewer than ``EXPONENT - 1`` members, which no square
of such a run can have, is dropped with all longer factors there, and lengths end at a quarter of the text.
Lengths one and two are read off the words and their pairs directly.

A text is one row and needs memory of its own length only; nothing is shuffled, and a lost executor costs its rows again.

Defined results: null and empty texts have no words, no runs and an empty rest; texts of any length are read whole; repeated rows give
repeated results; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Periods and words that a run has at least.
EXPONENT, LEAST = 4, 6
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)


class Classes:
    """Equal-factor classes of the positions of a text, by length; of each length the squares that start."""

    def __init__(self, codes: list, longest: int, least: int):
        """``codes``: a value a position, equal where the factors of length two are equal; None where no class is."""
        n = len(codes)
        self.longest, self.least = longest, least
        self.of = [-1] * (n + 2)
        self.next, self.before = [-1] * n, [-1] * n
        self.size: list[int] = []
        self.last: list[int] = []
        self.first: list[int] = []
        #: Distance of neighbours -> where it starts; kept up to the longest period.
        self.at: dict[int, set[int]] = {}
        names: dict = {}
        for i, code in enumerate(codes):
            if code is not None:
                c = names.get(code)
                if c is None:
                    c = names[code] = self._new()
                self._append(c, i)
        self.alive = sum(self.size)
        self.fresh = list(range(len(self.size)))
        self.gone = [i for i in range(n) if codes[i] is None]

    def _new(self) -> int:
        self.size.append(0)
        self.first.append(-1)
        self.last.append(-1)
        return len(self.size) - 1

    def _append(self, c: int, i: int) -> None:
        end = self.last[c]
        self.before[i], self.next[i], self.of[i] = end, -1, c
        if end < 0:
            self.first[c] = i
        else:
            self.next[end] = i
            if i - end <= self.longest:
                self.at.setdefault(i - end, set()).add(end)
        self.last[c] = i
        self.size[c] += 1

    def _take(self, i: int) -> int:
        """Remove a position from its class, which is returned."""
        c, a, b = self.of[i], self.before[i], self.next[i]
        if b >= 0:
            self.before[b] = a
            if b - i <= self.longest:
                self.at[b - i].discard(i)
        else:
            self.last[c] = a
        if a >= 0:
            self.next[a] = b
            if i - a <= self.longest:
                self.at[i - a].discard(a)
            if b >= 0 and b - a <= self.longest:
                self.at.setdefault(b - a, set()).add(a)
        else:
            self.first[c] = b
        self.of[i] = -1
        self.size[c] -= 1
        return c

    def members(self, c: int) -> list[int]:
        out, i = [], self.first[c]
        while i >= 0:
            out.append(i)
            i = self.next[i]
        return out

    def grow(self, end: int) -> None:
        """Go to factors longer by one; ``end`` is the last position that had one and has none now (-1: none)."""
        gone, self.gone = self.gone, []
        splitters = [self.members(c) for c in self.fresh]
        parts: dict[int, list[int]] = {}
        for i in {j - 1 for j in gone} | {end}:
            if i >= 0 and self.of[i] >= 0:
                parts.setdefault(self._take(i), [])
                self.gone.append(i)
                self.alive -= 1
        for chain in splitters:
            new: dict[int, int] = {}
            for j in chain:
                c = self.of[j - 1] if j else -1
                if c < 0:
                    continue
                part = new.get(c)
                if part is None:
                    part = new[c] = self._new()
                    parts.setdefault(c, []).append(part)
                self._take(j - 1)
                self._append(part, j - 1)
        self.fresh = []
        for c, children in parts.items():
            sizes = self.size
            children = [x for x in (c, *children) if sizes[x]]
            for x in children:
                if sizes[x] < self.least:
                    for i in self.members(x):
                        self._take(i)
                        self.gone.append(i)
                        self.alive -= 1
            if len(children) > 1:
                big = max(children, key=sizes.__getitem__)
                self.fresh += [x for x in children if x != big and sizes[x]]


def _stretches(starts: list[int], period: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs whose squares start at ``starts`` (ascending)."""
    out, k = [], 0
    while k < len(starts):
        a = k
        while k + 1 < len(starts) and starts[k + 1] == starts[k] + 1:
            k += 1
        out.append((starts[a], starts[k] - starts[a] + 2 * period, period))
        k += 1
    return out


def find_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run with its smallest period, by start and period."""
    n = len(words)
    if n < LEAST:
        return []
    longest, least = n // EXPONENT, EXPONENT - 1
    pairs = list(zip(words, words[1:], strict=False))
    often = {p for p, c in Counter(pairs).items() if c >= least}
    if not often:
        return []
    found = _stretches([i for i, (a, b) in enumerate(pairs) if a == b], 1) if any(a == b for a, b in often) else []
    classes = Classes([p if p in often else None for p in pairs], longest, least)
    length = 2
    while length <= longest and classes.alive:
        if starts := classes.at.get(length):
            found += _stretches(sorted(starts), length)
        classes.grow(n - length)
        length += 1
    return sorted((a, m, q) for a, m, q in found if m >= max(LEAST, EXPONENT * q))


def kept(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    drop = bytearray(len(words))
    for start, length, period in runs:
        drop[start + period : start + length] = b"\x01" * (length - period)
    return [w for w, d in zip(words, drop, strict=True) if not d]


def planted(doc_id: int | None, words: list) -> list:
    """The words with a periodic tail in every tenth document, by the checksum of its id: a test of what the detector finds."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def periodic(docs: DataFrame, change: Callable[[int | None, list], list] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start and period) and ``rest``, the text without repeated periods.

    ``change`` (id, words -> words) may rewrite the words first.
    """
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("rest", T.BinaryType())])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            ids, counts, runs, rest = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or b"").split()  # of bytes: at \x20 and \x09 to \x0D only
                if change is not None:
                    words = change(i, words)
                got = find_runs(words)
                ids.append(i)
                counts.append(len(words))
                runs.append([{"start": a, "length": m, "period": q} for a, m, q in got])
                rest.append(b" ".join(kept(words, got)))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip((ids, counts, runs, rest), arrow, strict=True)], schema=arrow)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text")).mapInArrow(run, out)


def digest(docs: DataFrame, change: Callable[[int | None, list], list] | None = planted) -> DataFrame:
    """Of every document: the number of runs, the longest one, and hashes of all runs and of the text without repeated periods."""
    found = periodic(docs, change)
    greatest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    return found.withColumn("best", greatest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"), "best.length", (-F.col("best.short")).alias("period"), F.expr("1000 * best.length div -best.short").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2("rest", 256).alias("collapsed_sha256"),
    )
