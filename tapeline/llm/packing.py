"""Packing of tokenised documents into windows by non-negative least squares.

A document longer than the window gives up full windows first; what remains (the rest) is packed. The rests'
lengths, rounded up to a grain, form a histogram of fixed size. Every way to fill a window exactly with up to
three grains' lengths is one column of a matrix; non-negative least squares finds how often each way is to be
used so that the histogram is met; the counts are rounded down. Lengths left over are packed greedily, again on
the histogram: the largest first, each window topped up with the largest that fits, as long as little is padded.
Documents that even this leaves over form one stream that is cut at window borders.

The plan depends on the histogram only, so the driver holds a few thousand numbers whatever the input. Which
document takes which place follows from its rank within its length, counted by salt, so that a length shared
by a third of all documents is spread over many tasks; salts follow from the piece, so neither one giant document nor
an id that many rows share (null included) meets in one task.

Defined results: null text counts as empty and is the end id alone; repeated rows are packed each; documents of
any length are packed whole; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tapeline.llm.common import cut, map_arrow, parts_for, schema
from tapeline.llm.tokens import ByteLevel

WINDOW = 1024
#: Lengths are rounded up to a multiple of this for the plan.
GRAIN = 8
#: A greedily packed window may be padded by at most so many tokens.
MOST_PADDING = 24
ROWS_A_SALT = 100_000


class Ids:
    """Token ids of texts by a tokenizer file, as its library gives them (strings of added tokens are those tokens), with the end id after each document."""

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None, end_id: int = 0):
        self.encoder, self.end_id = ByteLevel(json_path, ranks_path, pattern), end_id

    def ids(self, text: str | None) -> list[int]:
        return [*self.encoder.ids(text), self.end_id]


def pieces(docs: DataFrame, ids: Ids, window: int = WINDOW) -> DataFrame:
    """Full windows and the rest of every document, tokenised once.

    doc_id, start, length, ids_crc32, doc_tokens, for a rest its packed ids (16 bit where they fit), and a number
    of its own (task and place: the table is written once, so an attempt that is made again changes nothing).
    """
    shared = docs.sparkSession.sparkContext.broadcast(ids)  # a vocabulary
    out_schema = schema("doc_id long,start long,length int,ids_crc32 long,doc_tokens long,ids binary,piece long")

    made: dict[int, int] = {}

    def run(batch: pa.RecordBatch) -> dict:
        enc = shared.value.ids
        task = TaskContext.get().partitionId()
        out = {f.name: [] for f in out_schema}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            a = np.array(enc(text.as_py()), dtype="<u4")
            for s in range(0, len(a), window):
                part = a[s : s + window]
                out["doc_id"].append(doc)
                out["start"].append(s)
                out["length"].append(len(part))
                out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                out["doc_tokens"].append(len(a))
                out["ids"].append(None if len(part) == window else pack_ids(part))
                out["piece"].append((task << 40) + made.get(task, 0))
                made[task] = made.get(task, 0) + 1
        return out

    return map_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), run, out_schema)


def pack_ids(a: np.ndarray) -> bytes:
    """One byte of width, then the ids."""
    return b"\x02" + a.astype("<u2").tobytes() if not len(a) or a.max() < 65536 else b"\x04" + a.astype("<u4").tobytes()


def unpack_ids(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype("<u4")


def combinations(units: int) -> np.ndarray:
    """All ways to fill ``units`` with one to three lengths: rows of (a, b, c), a >= b >= c, 0 for none."""
    out = [(units, 0, 0)] + [(a, units - a, 0) for a in range(units - 1, 0, -1) if a >= units - a]
    out += [(a, b, units - a - b) for a in range(units - 2, 0, -1) for b in range(min(a, units - a - 1), 0, -1) if b >= units - a - b >= 1]
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Least |ax - b| over x >= 0, by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        j = int(np.argmax(w)) if n else -1
        if j < 0 or w[j] <= 1e-9 * scale:
            break
        free[j] = True
        while True:
            idx = np.flatnonzero(free)
            s = np.linalg.lstsq(a[:, idx], b, rcond=None)[0]
            if s.min(initial=1) > 0:
                x[:] = 0
                x[idx] = s
                break
            low = s <= 0
            step = np.min(x[idx][low] / np.maximum(x[idx][low] - s[low], 1e-300))
            x[idx] += step * (s - x[idx])
            x[idx[(x[idx] <= 1e-12 * scale) & low]] = 0
            newly = free & (x <= 0)
            if not newly.any():
                newly[idx[low][0]] = True
            free &= ~newly
            if not free.any():
                break
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, grain: int = GRAIN, most_padding: int = MOST_PADDING) -> tuple[list[tuple[int, list[int]]], dict[int, int]]:
    """([(times, grain lengths of one window)], counts by grain length that no window took)."""
    units = window // grain
    have = np.zeros(units + 1, dtype=np.int64)
    for length, n in histogram.items():
        have[min(units, -(-length // grain))] += n
    ways = combinations(units)
    ways = ways[[all(have[v] for v in w if v) for w in ways.tolist()]]
    a = np.zeros((units + 1, len(ways)))
    for col in range(3):
        np.add.at(a, (ways[:, col], np.arange(len(ways))), ways[:, col] > 0)
    out = []
    for way, times in zip(ways.tolist(), np.floor(nnls(a, have.astype(float)) + 1e-6).astype(np.int64).tolist(), strict=True):
        lengths = [v for v in way if v]
        times = min([times] + [int(have[v]) // lengths.count(v) for v in lengths])
        if times > 0:
            for v in lengths:
                have[v] -= times
            out.append((times, lengths))
    tried = np.zeros(units + 1, bool)
    while True:  # greedily: the same window as often as its lengths last
        first = next((v for v in range(units, 0, -1) if have[v] and not tried[v]), 0)
        if not first:
            break
        left = have.copy()
        lengths, room = [], units
        v = first
        while v:
            lengths.append(v)
            left[v] -= 1
            room -= v
            v = next((u for u in range(min(room, units), 0, -1) if left[u] > 0), 0)
        if room * grain > most_padding:
            tried[first] = True
            continue
        times = min(int(have[v]) // lengths.count(v) for v in set(lengths))
        for v in lengths:
            have[v] -= times
        out.append((times, lengths))
    return out, {v: int(have[v]) for v in range(1, units + 1) if have[v]}


def _places(made: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """The plan by grain length: (unit, first rank, ranks, first window, place in the window, width of the run)."""
    rank, out, window = {}, [], 0
    for times, lengths in made:
        for place, v in enumerate(lengths):
            r = rank.get(v, 0)
            out.append((v, r, r + times, window, place, times))
            rank[v] = r + times
        window += times
    return out


def ranked(df: DataFrame, key: str, order: list[str], salt: str = "_salt") -> DataFrame:
    """``df`` with ``_rank``: 0, 1, ... within ``key``, counted by salt first so that no key meets in one task."""
    counts = df.groupBy(key, salt).agg(F.count(F.lit(1)).alias("_n"))
    first = counts.withColumn("_first", F.sum("_n").over(W.partitionBy(key).orderBy(salt)) - F.col("_n"))
    first = first.select(F.col(key).alias("_k"), F.col(salt).alias("_s"), "_first")
    local = df.withColumn("_local", F.row_number().over(W.partitionBy(key, salt).orderBy(*order)) - 1)
    return local.join(first, (F.col(key) == F.col("_k")) & (F.col(salt) == F.col("_s"))).withColumn("_rank", F.col("_first") + F.col("_local")).drop("_k", "_s", "_first", "_local")


def pack(docs: DataFrame, ids: Ids, window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length."""
    spark = docs.sparkSession
    made = cut(pieces(docs, ids, window))
    light = made.drop("ids")
    full, rest = light.filter(F.col("length") == window), light.filter(F.col("length") < window)
    sizes = {r["length"]: r["n"] for r in light.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row a length
    n_full = sizes.pop(window, 0)
    n_rest = sum(sizes.values())
    salts = parts_for(n_rest, ROWS_A_SALT, 64)
    done, over = plan(sizes, window, grain)
    n_planned = sum(t for t, _ in done)

    # Full windows: numbered by document and place, salt by salt.
    full = full.withColumn("_one", F.lit(0)).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "piece"), F.lit(parts_for(n_full, ROWS_A_SALT, 64))).cast("int"))
    full = ranked(full, "_one", ["doc_id", "start", "piece"]).select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", F.col("_rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    # Rests: the rank within the grain length finds the place in the plan.
    rest = rest.withColumn("_unit", F.ceil(F.col("length") / grain).cast("int")).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "piece"), F.lit(salts)).cast("int"))
    rest = cut(ranked(rest, "_unit", ["doc_id", "start", "piece"]))
    runs = {}
    for unit, a, b, w, place, _ in _places(done):
        runs.setdefault(unit, []).append((a, b, w, place))
    plan_schema = T.StructType([T.StructField("unit", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("w", T.LongType()), T.StructField("place", T.IntegerType())])
    steps = spark.createDataFrame([(u, a, b, w, p) for u, rs in runs.items() for a, b, w, p in rs], plan_schema)
    # The plan has at most a few thousand rows: units and ways are fixed by window and grain.
    fit = (F.col("_unit") == F.col("unit")) & (F.col("_rank") >= F.col("a")) & (F.col("_rank") < F.col("b"))
    placed = rest.join(F.broadcast(steps), fit, "left").withColumn("_window", F.col("w") + F.col("_rank") - F.col("a"))
    inside = placed.filter("unit IS NOT NULL")
    before = F.coalesce(F.sum("length").over(W.partitionBy("_window").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # at most 128 rows a window
    inside = inside.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("_window") + n_full).alias("sequence_id"), before.cast("long").alias("offset"))

    out = full.unionByName(inside)
    if over:
        out = out.unionByName(_stream(made, placed.filter("unit IS NULL"), window, n_full + n_planned))
    return out


def _stream(made: DataFrame, over: DataFrame, window: int, first_sequence: int) -> DataFrame:
    """What the plan left over, end to end in one stream cut at window borders; the ids are read again for the cuts."""
    by_salt = over.groupBy("_salt").agg(F.sum("length").alias("_len"))
    by_salt = by_salt.select(F.col("_salt").alias("_s"), (F.sum("_len").over(W.orderBy("_salt")) - F.col("_len")).alias("_base"))  # one row a salt
    w = W.partitionBy("_salt").orderBy("_unit", "doc_id", "start", "piece").rowsBetween(W.unboundedPreceding, -1)
    at = over.withColumn("_at", F.coalesce(F.sum("length").over(w), F.lit(0))).join(by_salt, F.col("_salt") == F.col("_s"))
    at = at.select("piece", (F.col("_at") + F.col("_base")).cast("long").alias("_at"))
    joined = made.select("doc_id", "start", "doc_tokens", "ids", "piece").join(at, "piece").select("doc_id", "start", "doc_tokens", "ids", "_at")
    out_schema = schema("doc_id long,start long,length long,ids_crc32 long,doc_tokens long,sequence_id long,offset long")

    def run(batch: pa.RecordBatch) -> dict:
        out = {f.name: [] for f in out_schema}
        for doc, start, tokens, packed, pos in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            a, i = unpack_ids(packed), 0
            while i < len(a):
                offset = (pos + i) % window
                part = a[i : i + window - offset]
                for name, v in zip(out, (doc, start + i, len(part), zlib.crc32(part.tobytes()), tokens, first_sequence + (pos + i) // window, offset), strict=True):
                    out[name].append(v)
                i += len(part)
        return out

    return map_arrow(joined, run, out_schema)


def check_packing(rows, window: int = WINDOW) -> tuple[int, int]:
    """(tokens, padded tokens) of rows (length, sequence_id, offset); raises where a window is not gapless."""
    by: dict[int, list[tuple[int, int]]] = {}
    for length, seq, offset in rows:
        by.setdefault(seq, []).append((offset, length))
    total = padded = 0
    for seq, spans in by.items():
        end = 0
        for offset, length in sorted(spans):
            if offset != end:
                raise ValueError(f"sequence {seq} has a gap or an overlap at {end}")
            end += length
        if end > window:
            raise ValueError(f"sequence {seq} is too long")
        total += end
        padded += 0 if end & (end - 1) == 0 else window - end
    return total, padded

