"""Exact top-k search by sorted lists without random access.

Candidates are dealt into blocks; a block lies in one task, and all queries stream past it (a stated query set against all
rows): every candidate is moved and sorted once, only queries are copied, once a block. A block keeps one list of its
rows per dimension, sorted by that component. The queries at hand read the lists in lockstep, deeper from round to round: from
the top where the query's component is positive, from the bottom where it is negative. Each newly read slice adds what
its entries are known to score to the rows' bounds; entries not yet read lie between the last one read and the list's far
end, so upper bounds sink with depth. A query stops once k rows' lower bounds reach every other row's upper bound; then
only the rows that can still qualify are resolved. Each block returns k rows a query, which are merged in two steps.

Scores are whole numbers and exact, whatever their size: beyond 2^52 the rows are scored with Python's integers. Ties go to the
smaller id. Defined results: vectors that are null or hold a null or non-finite component, or have no id, take no part; shorter
vectors count as padded with zeros; an empty vector scores 0 with all; repeated rows are candidates and queries each, and
the rows of the query's own id are left out; an empty table gives an empty result; extra columns are left out. A score
that no 64-bit number holds is returned as the nearest one, after it was ranked by its true size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tapeline.llm.common import cut

BLOCK = 8192
#: Queries that read a block's lists together.
QUERY_BATCH = 256
#: Shares of the lists read, round by round.
DEPTHS = (1 / 32, 1 / 8, 1 / 3, 2 / 3, 1.0)
_LONG = 2**63


def integer_vectors(df: DataFrame, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v: floor(scale * x) of each component) of the rows that take part. A double holds every floor of a double exactly."""
    v = df[vec_col].cast(T.ArrayType(T.DoubleType()))
    scaled = F.transform(v, lambda x: x * scale)
    bad = F.exists(scaled, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x))
    return df.filter(df[id_col].isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(df[id_col].cast("long").alias("vec_id"), whole.alias("v"))


class Bounds:
    """Lower and upper bounds (rows x queries) of a block's scores, raised and lowered slice by slice."""

    def __init__(self, block: Block, q: np.ndarray):
        self.block, self.read = block, 0
        self.up, self.down = np.maximum(q, 0), np.minimum(q, 0)
        top, end = block.sorted[0], block.sorted[-1]  # a list's two ends are known with the list
        self.last_top, self.last_end = top, end
        self.low = np.repeat((self.up @ end + self.down @ top)[None, :], len(block.x), axis=0)
        self.high = np.repeat((self.up @ top + self.down @ end)[None, :], len(block.x), axis=0)

    def deepen(self, depth: int) -> None:
        """Read every list on to ``depth`` from the end that each query reads."""
        b, n, was = self.block, len(self.block.x), self.read
        new_top, new_end = b.sorted[min(depth, n) - 1], b.sorted[max(n - depth, 0)]
        for weight, fresh, unread, last, now, far in (
            (self.up, (b.place >= was) & (b.place < depth), b.place >= depth, self.last_top, new_top, b.sorted[-1]),
            (self.down, (b.place < n - was) & (b.place >= n - depth), b.place < n - depth, self.last_end, new_end, b.sorted[0]),
        ):
            if weight.any():
                self.low += np.where(fresh, b.x - far, 0.0) @ weight.T  # an entry read now was taken for the far end
                # it was taken for the one read last; what is still unread sinks to the one read now
                self.high += (np.where(fresh, b.x - last, 0.0) + np.where(unread, now - last, 0.0)) @ weight.T
        self.last_top, self.last_end, self.read = new_top, new_end, depth

    def keep(self, which: np.ndarray) -> None:
        """Go on with some of the queries."""
        self.up, self.down, self.low, self.high = self.up[which], self.down[which], self.low[:, which], self.high[:, which]


class Block:
    """Sorted lists of one block of candidates."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order].astype(np.float64)
        n, d = self.x.shape
        self.lists = np.argsort(-self.x, axis=0, kind="stable")
        self.place = np.empty((n, d), np.int32)  # of a row in each list, from the top
        np.put_along_axis(self.place, self.lists, np.arange(n, dtype=np.int32)[:, None], axis=0)
        self.sorted = np.take_along_axis(self.x, self.lists, axis=0)
        self.largest = float(np.abs(self.x).max(initial=0))

    def top(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
        """(place of the query, ids, exact scores) of the k best rows of each query."""
        n = len(self.x)
        if not n or not len(q):
            return
        q = q.astype(np.float64)
        sure = self.largest * np.abs(q).max(initial=0) * max(1, q.shape[1]) < 2**52  # every sum on the way is a whole number below 2^53
        if not sure:
            yield from self._large(q_ids, q, k)
            return
        going = np.arange(len(q))
        state = Bounds(self, q)
        own = self.ids[:, None] == q_ids[None, :]
        for share in DEPTHS:
            depth = max(1, int(np.ceil(n * share)))
            if depth < n <= 4 * k:
                continue
            state.deepen(depth)
            lows = np.where(own[:, going], -np.inf, state.low).T
            kth = np.partition(lows, n - k, axis=1)[:, n - k] if n > k else None
            rest = []
            for c, i in enumerate(going.tolist()):
                high = state.high[:, c]
                found = np.flatnonzero((high >= kth[c]) & ~own[:, i]) if n > k else np.flatnonzero(~own[:, i])
                if depth < n and len(found) > k:  # an outsider could still qualify
                    rest.append(c)
                    continue
                score = self.x[found] @ q[i]  # resolved for the rows that remain
                best = np.lexsort((self.ids[found], -score))[:k]
                yield i, self.ids[found[best]], score[best].astype(np.int64).tolist()
            if not rest:
                return
            going = going[rest]
            state.keep(np.array(rest))

    def _large(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
        rows = [[int(v) for v in r] for r in self.x]
        for i, own in enumerate(q_ids.tolist()):
            mine = [int(v) for v in q[i]]
            best = sorted((-sum(a * b for a, b in zip(r, mine, strict=True)), int(c)) for r, c in zip(rows, self.ids, strict=True) if c != own)[:k]
            yield i, np.array([c for _, c in best], np.int64), [-s for s, _ in best]


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


_PART = "query_id long, turn long, vec_id long, score long, size string, block int"


def _size(score: int) -> str | None:
    """For a score that no long holds, digits that sort as the score does: above every such score lies 10^700."""
    return None if -_LONG <= score < _LONG else str(score + 10**700).zfill(701)


def _stream(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """The k best candidates of each block for each query: of a block (sorted so) first come the candidates, then the queries."""
    number, ids, vectors, block, width = None, [], [], None, 0
    for f in frames:
        for b, part in f.groupby("block", sort=False):
            if b != number:
                number, ids, vectors, block = b, [], [], None
            cands, queries = part[part["turn"] < 0], part[part["turn"] >= 0]
            ids += cands["vec_id"].tolist()
            vectors += cands["v"].tolist()
            if not len(queries) or not ids:
                continue
            longest = max(len(v) for v in queries["v"])
            if block is None or longest > width:
                width = max(longest, max(len(v) for v in vectors))
                block = Block(np.array(ids, np.int64), _matrix(vectors, width))
            out = []
            for lo in range(0, len(queries), QUERY_BATCH):
                some = queries.iloc[lo : lo + QUERY_BATCH]
                q_ids, turns = some["vec_id"].to_numpy(np.int64), some["turn"].to_numpy(np.int64)
                for i, found, scores in block.top(q_ids, _matrix(some["v"].tolist(), width), k):
                    out += [(q_ids[i], turns[i], c, max(-_LONG, min(_LONG - 1, s)), _size(s), b) for c, s in zip(found.tolist(), scores, strict=True)]
            yield pd.DataFrame(out, columns=["query_id", "turn", "vec_id", "score", "size", "block"]).astype({"query_id": "int64", "turn": "int64", "vec_id": "int64", "score": "int64", "block": "int32"})


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``is_query`` holds, its k best other rows."""
    held = cut(vectors.withColumn("_q", F.coalesce(is_query, F.lit(False))).withColumn("turn", F.monotonically_increasing_id()))
    blocks = max(1, -(-held.count() // block))
    # Blocks hold rows by their number, so that an id which many rows share does not fill one.
    cands = held.select(F.pmod(F.xxhash64("turn"), F.lit(blocks)).cast("int").alias("block"), F.lit(-1).cast("long").alias("turn"), "vec_id", "v")
    queries = held.filter("_q").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "turn", "vec_id", "v")
    met = cands.unionAll(queries).repartition(blocks, "block").sortWithinPartitions("block", "turn").mapInPandas(lambda frames: _stream(frames, k), _PART)
    order = [F.desc("score"), F.desc("size"), F.asc("vec_id")]
    some = met.withColumn("group", F.floor(F.col("block") / 64))
    for by in (["turn", "query_id", "group"], ["turn", "query_id"])[blocks <= 64 :]:  # 64 blocks at a time, then the groups' best
        some = some.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    return some.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
