"""Near-duplicate detection with SetSketch registers.

Texts are lower-cased (A-Z) and cut into words; a document's set holds its distinct shingles. Documents with the
same words are one class from the start. A class's sketch has M registers: register j is the truncated logarithm,
to a base just above 1, of the least of the exponentially distributed hashes j of the set. Registers are
mergeable (maximum) and locality-sensitive: runs of them are the bands that propose candidates. For a
proposed pair the three counts of larger, equal and smaller registers and the two known set sizes give a
likelihood over the Jaccard similarity; a pair whose best similarity at or above the threshold is far less likely
than its best one is dropped, all others are compared on their full sets.

Work per bucket is kept linear where a group of copies is large: first each class meets only one class of each of
its buckets, the pivot; verified links are contracted to components. In buckets that still hold several
components another pivot is met, some ROUNDS times while that joins anything. Then only buckets that hold more
than one component even so are looked at, only pairs across components, in the first band that the pair shares, in
blocks; inside a block a link between components that are joined by then is not sought. Joins on keys that a large share of
rows may hold (copies, buckets, pivots, pointers) salt these keys. There is no cap on buckets, partners or rounds
beyond which a link is lost. What may be lost is by chance: a pair at the threshold shares no band with probability
below MISSED, and the likelihood drops a pair that reaches the threshold where its registers speak e**LEAST_LIKELY times
for less (``tests/llm`` counts both against all pairs).

Defined results: a text without words (or null) has an empty set, is linked with nothing and kept; fewer words
than the shingle's length make one shingle. In :func:`groups` documents are ids: rows that repeat an id are one document
with several texts, which all link it. In :func:`keep_one` rows decide by their own text: of the texts that
are linked the row with the smallest id stays, of rows that share id and words one. A row without an id is linked
with nothing and kept; an empty table gives an empty result; extra columns are left out by the first and kept by the second, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.llm.common import cut, drop_since, heavy, map_arrow, mark, schema, spread_join

M = 126
#: A pair at the threshold may share no band this often.
MISSED = 1e-4
BASE = 1.05
RATE = 20.0
#: A pair is dropped unseen where the likelihood of the threshold is so many times e below the best one.
LEAST_LIKELY = 9.0
#: Classes of an open bucket that are compared in one piece of work.
BLOCK = 512
#: Pivots that an open bucket meets, one after the other, before its classes are compared in blocks.
ROUNDS = 2
_MULTIPLY = np.random.default_rng(20240501).integers(1, 2**64, M, dtype=np.uint64) | np.uint64(1)
_ADD = np.random.default_rng(20240502).integers(0, 2**64, M, dtype=np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def layout(percent: int) -> tuple[int, int]:
    """(bands, registers a band): the longest bands of which a pair at the threshold shares one but for MISSED."""
    p = percent / 100
    return max(((M // r, r) for r in range(1, 13) if (1 - p**r) ** (M // r) <= MISSED), key=lambda x: x[1], default=(M, 1))


def words(text: str | None) -> list[bytes]:
    """bytes.split() splits at 0x20 and 0x09 to 0x0D, bytes.lower() lowers A-Z: nothing else."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Hasher:
    """Distinct 64-bit shingle hashes of texts; word hashes are remembered up to a bound."""

    def __init__(self, width: int, most: int = 400_000):
        self.width, self.most, self.memo = width, most, {}

    def shingles(self, w: list[bytes]) -> np.ndarray:
        if not w:
            return np.zeros(0, np.uint64)
        memo = self.memo
        if len(memo) > self.most:
            memo.clear()
        try:
            h = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
        except KeyError:
            for x in w:
                if x not in memo:
                    memo[x] = xxhash.xxh3_64_intdigest(x)
            h = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
        k = min(self.width, len(w))
        out = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ (h[i : len(h) - k + 1 + i] * _MIX[i % 3])) * _MIX[3]
            out ^= out >> np.uint64(29)
        out *= _MIX[4]
        out ^= out >> np.uint64(32)
        return np.unique(out)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a set: M registers of 16 bits; that of a union is the larger of each."""
    least = np.full(M, 2**64 - 1, np.uint64)
    for lo in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[lo : lo + 1024, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    u = (least.astype(np.float64) + 1.0) / (2.0**64 + 2.0)
    x = -np.log1p(-u) / RATE
    return np.clip(np.floor(1.0 - np.log(x) / math.log(BASE)), 0, 65535).astype("<u2")


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log(np.maximum(1.0 - np.maximum(x, 0) * (BASE - 1) / BASE, 1e-12)) / math.log(BASE)


def likely(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether pairs of sketches (rows of a and b, with their sets' sizes) may reach the threshold."""
    out = np.zeros(len(a), bool)
    for lo in range(0, len(a), 20_000):
        x, y = a[lo : lo + 20_000], b[lo : lo + 20_000]
        n, m = na[lo : lo + 20_000].astype(float), nb[lo : lo + 20_000].astype(float)
        more, less = (x > y).sum(axis=1), (x < y).sum(axis=1)
        same = M - more - less
        u, v = (n / (n + m))[:, None], (m / (n + m))[:, None]
        ceiling = np.minimum(n, m) / np.maximum(n, m)
        best = np.full(len(x), -np.inf)
        above = np.full(len(x), -np.inf)
        for j in np.concatenate([np.linspace(0, threshold, 18)[:-1], np.linspace(threshold, 1, 7)]):
            jj = np.minimum(j, ceiling)[:, None]
            p, q = _p(u - v * jj)[:, 0], _p(v - u * jj)[:, 0]
            ll = more * np.log(np.maximum(p, 1e-9)) + less * np.log(np.maximum(q, 1e-9)) + same * np.log(np.maximum(1 - p - q, 1e-9))
            best = np.maximum(best, ll)
            if j >= threshold - 1e-9:
                above = np.maximum(above, np.where(j <= ceiling + 0.03, ll, -np.inf))
        out[lo : lo + 20_000] = (ceiling >= threshold - 1e-9) & (above >= best - LEAST_LIKELY)
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test on sorted distinct shingle hashes."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (len(a) + len(b) - inter)


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (tells the texts of one id apart), text."""
    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, same (hash of the words in order), sketch (empty without words)."""
    hasher = Hasher(width)

    def run(batch: pa.RecordBatch) -> dict:
        out = {"doc_id": batch.column(0), "text_hash": batch.column(1), "n_shingles": [], "same": [], "sketch": []}
        for text in batch.column(2):
            w = words(text.as_py())
            s = hasher.shingles(w)
            out["n_shingles"].append(len(s))
            out["same"].append(xxhash.xxh3_128_digest(b" ".join(w)))
            out["sketch"].append(registers(s).tobytes() if len(s) else b"")
        return out

    return map_arrow(_named(docs), run, schema("doc_id long,text_hash long,n_shingles long,same binary,sketch binary"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp: the smallest node reachable) of every node of ``edges`` (a, b).

    Each round every node points to its smallest neighbour's pointer; edges are contracted to
    what still differs. All of it stays in tables; rounds grow with the logarithm of the longest chain.
    """
    e = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    comp = None
    while True:
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = cut(both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("m")).select("x", F.least("x", "m").alias("p")))
        if comp is not None and point.isEmpty():
            return comp
        second = point.select(F.col("x").alias("y"), F.col("p").alias("q"))
        point = cut(spread_join(point, second.withColumnRenamed("y", "p"), "p", heavy(point, "p"), "x").select("x", F.col("q").alias("to")))
        if comp is None:
            comp = point.select(F.col("x").alias("node"), F.col("to").alias("comp"))
        else:
            comp = cut(spread_join(comp, point.withColumnRenamed("x", "comp"), "comp", heavy(comp, "comp"), "node", "left").select("node", F.coalesce("to", "comp").alias("comp")))
        pa_, pb_ = point.select(F.col("x").alias("a"), F.col("to").alias("ta")), point.select(F.col("x").alias("b"), F.col("to").alias("tb"))
        moved = spread_join(spread_join(e, pa_, "a", heavy(e, "a"), "b"), pb_, "b", heavy(e, "b"), "a").filter("ta <> tb")
        e = cut(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())


def _bands(reps: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(key, band, rep): one row a band of each class."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", 2 * shape[1] * i + 1, 2 * shape[1])) for i in range(shape[0])])
    return reps.select("rep", F.posexplode(keys).alias("band", "key"))


def _sketch_matrix(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), "<u2").reshape(-1, M)


def _runs(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Frames cut at group borders: each holds whole groups of rows that are sorted by ``by``."""
    held = None
    for f in frames:
        f = f if held is None else pd.concat([held, f], ignore_index=True)
        last = f[by].iloc[-1]
        same = np.ones(len(f), bool)
        for k in by:
            same &= (f[k] == last[k]).to_numpy()
        first = int(np.argmax(same))
        held = f.iloc[first:].reset_index(drop=True)
        if first:
            yield f.iloc[:first].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def _cross_pairs(f: pd.DataFrame, by: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (probe, member) of one group that lie in different components, every pair in one order only."""
    change = np.zeros(len(f), bool)
    change[0] = True
    for k in by:
        v = f[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    at = np.append(np.flatnonzero(change), len(f))
    comp, rep, probe, main = (f[k].to_numpy() for k in ("comp", "rep", "probe", "main"))
    a, b, n = [], [], 0
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        p, q = lo + np.flatnonzero(probe[lo:hi]), lo + np.flatnonzero(~probe[lo:hi])
        if not len(p) or not len(q):
            continue
        for some in np.array_split(p, len(p) * len(q) // 200_000 + 1):
            x, y = np.repeat(some, len(q)), np.tile(q, len(some))
            wanted = (comp[x] != comp[y]) & (main[y] | (rep[x] < rep[y]))  # two that lie outside the main component meet twice
            a.append(x[wanted])
            b.append(y[wanted])
            n += len(a[-1])
            if n > 200_000:
                yield np.concatenate(a), np.concatenate(b)
                a, b, n = [], [], 0
    if n:
        yield np.concatenate(a), np.concatenate(b)


_GROUP = ["key", "i", "j"]
_ROW = ["key", "band", "rep", "comp", "main", "probe", "i", "j", "n", "sketch"]


def _first_band(a: np.ndarray, b: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    n = shape[0] * shape[1]
    return (a[:, :n].reshape(-1, *shape) == b[:, :n].reshape(-1, *shape)).all(axis=2).argmax(axis=1)


def links(docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, comp) of the classes that have links. ``reps``: rep (a number), doc_id and text_hash of one of its texts, n, sketch, one row a class."""
    threshold = percent / 100
    shape = layout(percent)
    light = _bands(reps, shape)
    buckets = cut(light.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("pivot")).filter("n > 1"))
    crowded = heavy(buckets, "key", "n")
    shared = cut(spread_join(light, buckets.select("key", "pivot"), "key", crowded, "rep"))
    if shared.isEmpty():
        return shared.select(F.col("rep").alias("node"), F.col("pivot").alias("comp"))
    # Only classes that share a bucket matter from here on. Sides that grow with the data are never broadcast, however small they look.
    reps = cut(reps.join(shared.select("rep").distinct().hint("merge"), "rep", "left_semi"))
    # Rows that repeat id and text are one; the groups lie where the join has put them.
    texts = _named(docs).join(reps.select("rep", "doc_id", "text_hash").hint("merge"), ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash", "rep").agg(F.first("text").alias("text"))
    texts = cut(texts.select("rep", "text"))
    side = lambda name, k: reps.select(F.col("rep").alias(name), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))

    def passes(batch: pa.RecordBatch) -> dict:
        col = lambda k: batch.column(batch.schema.names.index(k))
        ok = likely(_sketch_matrix(col("sa").to_pylist()), col("na").to_numpy(), _sketch_matrix(col("sb").to_pylist()), col("nb").to_numpy(), threshold)
        return {"rep": col("rep").to_numpy()[ok], "pivot": col("pivot").to_numpy()[ok]}

    def verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, last = Hasher(width), (None, None)
        for f in frames:
            ok = []
            for x, y in zip(f["ta"], f["tb"], strict=True):
                if last[0] != y:
                    last = (y, hasher.shingles(words(y)))
                ok.append(linked(hasher.shingles(words(x)), last[1], percent))
            yield f.loc[ok, ["a", "b"]] if len(f) else f[["a", "b"]]

    ta, tb = texts.select(F.col("rep"), F.col("text").alias("ta")), texts.select(F.col("rep").alias("pivot"), F.col("text").alias("tb"))

    def confirmed(star: DataFrame) -> DataFrame:
        """The links (a, b) among pairs (rep, pivot): likely by their sketches, then confirmed on their full sets."""
        popular = heavy(star, "pivot")
        met = spread_join(star.join(side("rep", "a").hint("merge"), "rep"), side("pivot", "b"), "pivot", popular, "rep")
        pairs = map_arrow(met, passes, schema("rep long,pivot long"))
        met = spread_join(pairs.join(ta.hint("merge"), "rep"), tb, "pivot", popular, "rep").select(F.col("rep").alias("a"), F.col("pivot").alias("b"), "ta", "tb")
        return cut(met.mapInPandas(verified, "a long, b long"))

    comp = components(confirmed(cut(shared.filter("rep <> pivot").select("rep", "pivot").distinct())))
    found = comp.select(F.col("node").alias("rep"), "comp")
    named = cut(spread_join(shared.select("key", "band", "rep"), found, "rep", {}, "rep", "left").select("key", "band", "rep", F.coalesce("comp", "rep").alias("comp")))
    for turn in range(ROUNDS):
        # Buckets that still hold several components, and their classes: the work shrinks from turn to turn.
        per_key = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("size"))
        open_keys = cut(per_key.filter("lo <> hi"))
        if open_keys.isEmpty():
            return comp
        named = cut(spread_join(named, open_keys.select("key"), "key", crowded, "rep"))
        if turn == ROUNDS - 1:
            break
        # The next pivot is the bucket's last class, then the first class of its last component (its number).
        rows = spread_join(named, open_keys.select("key", F.col("last" if turn % 2 == 0 else "hi").alias("pivot")), "key", crowded, "rep")
        rows = rows.filter("rep <> pivot").select("rep", "comp", "pivot").distinct()
        at = found.select(F.col("rep").alias("pivot"), F.col("comp").alias("pc"))
        rows = cut(spread_join(rows, at, "pivot", heavy(rows, "pivot"), "rep", "left").select("rep", "comp", "pivot", F.coalesce("pc", "pivot").alias("pc")).filter("comp <> pc"))
        more = confirmed(rows.select("rep", "pivot"))
        if more.isEmpty():
            break
        # Contracted: what the new links join are components.
        joined = rows.join(more.select(F.col("a").alias("rep"), F.col("b").alias("pivot")).hint("merge"), ["rep", "pivot"]).select(F.col("comp").alias("a"), F.col("pc").alias("b"))
        moved = components(joined).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        move = lambda df, by, moved=moved: spread_join(df, moved, "comp", heavy(df, "comp"), by, "left").withColumn("comp", F.coalesce("to", "comp")).drop("to")
        single = moved.select(F.col("comp").alias("rep"), F.col("to").alias("comp")).join(found.select("rep").hint("merge"), "rep", "left_anti")
        found = cut(move(found, "rep").select("rep", "comp").unionAll(single))
        comp = found.select(F.col("rep").alias("node"), "comp")
        named = cut(move(named, "rep").select("key", "band", "rep", "comp"))
    # A bucket's main component holds most of its classes. All others are probes, which meet every block of the bucket's members:
    # a group of some 2 * BLOCK rows. So a large group of copies with few strangers costs its rows once, not their square.
    sizes = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("_n"))
    shares = sizes.groupBy("key").agg(F.max_by("comp", F.struct("_n", "comp")).alias("main"), F.sum("_n").alias("_all"), F.max("_n").alias("_main"))
    blocks_of = lambda c: F.ceil(c / BLOCK).cast("int")
    open_keys = cut(shares.select("key", "main", blocks_of(F.col("_all")).alias("blocks"), blocks_of(F.col("_all") - F.col("_main")).alias("probes")))
    rows = spread_join(named, open_keys, "key", crowded, "rep").withColumn("main", F.col("comp") == F.col("main"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    of = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    members = rows.select("key", "band", "rep", "comp", "main", F.lit(False).alias("probe"), each("probes").alias("i"), of("blocks").alias("j"))
    probes = rows.filter("NOT main").select("key", "band", "rep", "comp", "main", F.lit(True).alias("probe"), of("probes").alias("i"), each("blocks").alias("j"))
    rows = members.unionAll(probes).join(reps.select("rep", "n", "sketch").hint("merge"), "rep")

    def flagged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _runs(frames, _GROUP):
            sk, n, band = _sketch_matrix(f["sketch"]), f["n"].to_numpy(), f["band"].to_numpy()
            hit = np.zeros(len(f), bool)
            for a, b in _cross_pairs(f, _GROUP):
                size = np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) - 1e-9
                a, b = a[size], b[size]
                for lo in range(0, len(a), 50_000):
                    x, y = a[lo : lo + 50_000], b[lo : lo + 50_000]
                    own = _first_band(sk[x], sk[y], shape) == band[x]
                    x, y = x[own], y[own]
                    ok = likely(sk[x], n[x], sk[y], n[y], threshold)
                    hit[x[ok]] = hit[y[ok]] = True
            yield f.loc[hit, _ROW]

    kinds = "key long, band int, rep long, comp long, main boolean, probe boolean, i int, j int, n long, sketch binary"
    dealt = lambda d: d.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    some = cut(dealt(rows).mapInPandas(flagged, kinds))
    if some.isEmpty():
        return comp

    def sets(batch: pa.RecordBatch) -> dict:
        hasher = Hasher(width)
        return {"rep": batch.column(0), "set": [hasher.shingles(words(t.as_py())).tobytes() for t in batch.column(1)]}

    wanted = some.select("rep").distinct()
    full = map_arrow(texts.join(wanted.hint("merge"), "rep", "left_semi").select("rep", "text"), sets, schema("rep long,set binary"))

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _runs(frames, _GROUP):
            sk, n, band, rep = _sketch_matrix(f["sketch"]), f["n"].to_numpy(), f["band"].to_numpy(), f["rep"].to_numpy()
            comp_of = f["comp"].tolist()
            parent: dict[int, int] = {}

            def root(c: int) -> int:
                while c in parent:
                    c = parent[c]
                return c

            found: dict[int, np.ndarray] = {}

            def shingles(i: int) -> np.ndarray:
                if i not in found:
                    found[i] = np.frombuffer(f["set"].iat[i], np.uint64)
                return found[i]

            out = []
            for a, b in _cross_pairs(f, _GROUP):
                for lo in range(0, len(a), 50_000):
                    x, y = a[lo : lo + 50_000], b[lo : lo + 50_000]
                    own = _first_band(sk[x], sk[y], shape) == band[x]
                    x, y = x[own], y[own]
                    ok = likely(sk[x], n[x], sk[y], n[y], threshold)
                    for p, q in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                        c, d = root(comp_of[p]), root(comp_of[q])
                        if c != d and linked(shingles(p), shingles(q), percent):
                            parent[max(c, d)] = min(c, d)
                            out.append((int(rep[p]), int(rep[q])))
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    more = cut(dealt(some.join(full.hint("merge"), "rep")).mapInPandas(joined, "a long, b long"))
    if more.isEmpty():
        return comp
    tree = comp.select(F.col("node").alias("a"), F.col("comp").alias("b"))
    return components(tree.unionAll(more))


def _classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Sketch rows without their sketches, and (same, class component, copies) of the classes of equal words: what the rest builds on."""
    place = mark()
    made = cut(sketches(docs, width))
    some = made.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    one = F.min(F.struct("doc_id", "text_hash"))
    reps = some.groupBy("same").agg(one.alias("one"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))
    # Numbered once, as the table is written once.
    reps = cut(reps.select("same", "one.doc_id", "one.text_hash", "n", "sketch", "copies", F.monotonically_increasing_id().alias("rep")))
    comp = links(docs, reps.select("rep", "doc_id", "text_hash", "n", "sketch"), width, percent)
    classes = cut(reps.join(comp.hint("merge"), F.col("rep") == F.col("node"), "left").select("same", "copies", F.coalesce("comp", "rep").alias("_comp")))
    light = cut(made.drop("sketch"))
    drop_since(docs.sparkSession, place, classes, light)
    return light, classes


def groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    made, classes = _classes(docs, width, percent)
    some = made.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    rows = cut(spread_join(some.drop("text_hash"), classes.select("same", "_comp"), "same", heavy(classes, "same", "copies"), "doc_id").select("doc_id", "n_shingles", "_comp"))
    again = cut(made.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("doc_id"))
    repeats = not again.isEmpty()
    if repeats:  # an id with texts in several components joins them
        across = rows.join(again.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("_comp").alias("lo"), F.max("_comp").alias("hi")).filter("lo <> hi")
        edges = rows.join(across.select("doc_id", "lo").hint("merge"), "doc_id").select(F.col("_comp").alias("a"), F.col("lo").alias("b"))
        joined = components(edges).select(F.col("node").alias("_comp"), F.col("comp").alias("_to"))
        rows = cut(spread_join(rows, joined, "_comp", heavy(rows, "_comp"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("_to", "_comp").alias("_comp")))
    least = cut(rows.groupBy("_comp").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_rows")))
    out = spread_join(rows, least.select("_comp", "_least"), "_comp", heavy(least, "_comp", "_rows"), "doc_id").select("doc_id", "n_shingles", F.col("_least").alias("component_id"))
    out = out.unionAll(made.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    if repeats:  # such an id may have an empty text as well
        out = cut(out)
        one = out.groupBy("doc_id").agg(F.min("component_id").alias("_one"))
        out = spread_join(out, one, "doc_id", heavy(out, "doc_id"), "n_shingles", "left").select("doc_id", "n_shingles", F.col("_one").alias("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of linked texts (that with the smallest id), all columns; of rows that share id and words, one."""
    made, classes = _classes(docs, width, percent)
    some = made.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    rows = cut(spread_join(some, classes.select("same", "_comp"), "same", heavy(classes, "same", "copies"), "doc_id").select("doc_id", "text_hash", "_comp"))
    stay = cut(rows.groupBy("_comp").agg(F.min(F.struct("doc_id", "text_hash")).alias("_one")).select(F.col("_one.doc_id").alias("_id"), F.col("_one.text_hash").alias("_text")))
    fields = docs.columns
    text = docs["text"].cast("string")
    whole = docs.select(docs["doc_id"].cast("long").alias("_id"), F.xxhash64(text).alias("_text"), F.struct(*[docs[f"`{c}`"] for c in fields]).alias("_row"), _wordless(text).alias("_none"))
    alone = whole.filter("_id IS NULL OR _none")  # they stay and need no join: they would meet in one task
    won = whole.filter("_id IS NOT NULL AND NOT _none").join(stay.hint("merge"), ["_id", "_text"], "left_semi")
    again = cut(some.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")))
    if not again.isEmpty():
        repeated = won.join(again.hint("merge"), ["_id", "_text"], "left_semi").groupBy("_id", "_text").agg(F.min("_row").alias("_row"), F.first("_none").alias("_none"))
        won = won.join(again.hint("merge"), ["_id", "_text"], "left_anti").unionByName(repeated)
    return won.unionByName(alone).select(*[F.col("_row").getField(c).alias(c) for c in fields])


def _wordless(text: Column) -> Column:
    return F.coalesce(F.length(F.translate(text, " \t\n\x0b\x0c\r", "")) == 0, F.lit(True))


RESULT = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "n_shingles", "component_id")] + [T.StructField("kept", T.BooleanType())])
