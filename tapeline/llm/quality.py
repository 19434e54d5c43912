"""Quality classifier: a sparse ensemble of rules, compiled into Spark column expressions.

Statistics of a text are column expressions. On a bounded sample of labelled rows, boosted shallow trees over these
statistics are grown; every path from a root to a node is a conjunctive rule; lasso logistic regression
weighs the rules and leaves few. The weighted rules become one column expression, so that scoring never leaves the JVM.

Defined results: null text counts as empty and gets the score of an empty text; texts of any length are read
whole; repeated rows are scored each; without labelled rows of both kinds every score is the share of
label 1 (0.5 without any); an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import one_text_an_id
from tapeline.llm.rules import SPACE, _let, base

#: Labelled rows that are fitted at most; which ones is decided by a hash of their id.
MOST_LABELLED = 8000
FEATURES = ("chars", "words", "word_length", "symbols", "capitals", "digits", "marks", "repeats", "distinct", "same_next", "dup_lines", "line_words")


def statistics(text: Column) -> Column:
    """A struct of the statistics named in FEATURES, all double."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")

    def from_words(w: Column) -> Column:
        same = F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False))))
        return F.struct(F.size(F.array_distinct(w)).alias("distinct"), same.alias("same"))

    return F.struct(
        base(text).alias("b"),
        _let(words, from_words).alias("w"),
        F.length(text).alias("chars"),
        F.length(F.regexp_replace(text, r"[^\p{N}]+", "")).alias("digits"),
        F.length(F.regexp_replace(text, r"[^\p{P}]+", "")).alias("marks"),
    )


def features(df: DataFrame, keep: list[Column], text: Column) -> DataFrame:
    """``keep`` and a struct column ``_x`` of FEATURES."""
    held = df.select(*keep, statistics(text).alias("_s"))
    n, chars = F.greatest(F.col("_s.b.w.n_words"), F.lit(1)), F.greatest(F.col("_s.b.word_chars"), F.lit(1))
    lines = F.greatest(F.col("_s.b.l.n_lines"), F.lit(1))
    value = {
        "chars": F.col("_s.chars"), "words": F.col("_s.b.w.n_words"), "word_length": F.col("_s.b.word_chars") / n, "symbols": F.col("_s.b.n_symbols") / chars,
        "capitals": F.col("_s.b.n_capitals") / chars, "digits": F.col("_s.digits") / chars, "marks": F.col("_s.marks") / chars, "repeats": F.col("_s.b.w.n_repeat_words") / n,
        "distinct": F.col("_s.w.distinct") / n, "same_next": F.col("_s.w.same") / n, "dup_lines": F.col("_s.b.l.n_dup_lines") / lines, "line_words": F.col("_s.b.w.n_words") / lines,
    }
    names = [c for c in held.columns if c != "_s"]
    return held.select(*[F.col(f"`{c}`") for c in names], F.struct(*[value[k].cast("double").alias(k) for k in FEATURES]).alias("_x"))


Rule = tuple[tuple[int, bool, float], ...]  # (feature, over, limit): x > limit, or x <= limit


def grow(x: np.ndarray, g: np.ndarray, depth: int, least: int, bins: int = 48, path: Rule = ()) -> list[tuple[Rule, float]]:
    """Rules of a regression tree on ``g``: (path, mean) of each node below the root."""
    out = []
    if depth == 0 or len(g) < 2 * least:
        return out
    best = (1e-9, None)
    total, n = g.sum(), len(g)
    for f in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]))
        which = np.searchsorted(cuts, x[:, f], side="left")
        left_n = np.cumsum(np.bincount(which, minlength=len(cuts) + 1))[:-1]
        left_g = np.cumsum(np.bincount(which, weights=g, minlength=len(cuts) + 1))[:-1]
        ok = (left_n >= least) & (n - left_n >= least)
        gain = np.where(ok, left_g**2 / np.maximum(left_n, 1) + (total - left_g) ** 2 / np.maximum(n - left_n, 1) - total**2 / n, 0)
        k = int(np.argmax(gain)) if len(gain) else 0
        if len(gain) and gain[k] > best[0]:
            at = x[:, f]
            above = at[at > cuts[k]]
            best = (gain[k], (f, float((cuts[k] + above.min()) / 2)))
    if best[1] is None:
        return out
    f, limit = best[1]
    for over in (False, True):
        side = (x[:, f] > limit) == over
        own = (*path, (f, over, limit))
        out.append((own, float(g[side].mean())))
        out += grow(x[side], g[side], depth - 1, least, bins, own)
    return out


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, over, limit in rule:
        out &= (x[:, f] > limit) == over
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 800) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient steps; the intercept is not penalised."""
    n, k = r.shape
    step = 4.0 / (np.linalg.norm(np.c_[np.ones(n), r], 2) ** 2 / n + 1e-12)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    b, w = float(np.log(p / (1 - p))), np.zeros(k)
    vb, vw, t = b, w.copy(), 1.0
    for _ in range(rounds):
        e = 1 / (1 + np.exp(-np.clip(vb + r @ vw, -30, 30))) - y
        nb = vb - step * e.mean()
        nw = vw - step * (r.T @ e) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vb, vw = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    return float(b), w


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[tuple[Rule, float]]

    def column(self, x: str = "_x") -> Column:
        """The score as a column expression over the struct column ``x``."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            cond = F.lit(True)
            for f, over, limit in rule:
                c = F.col(f"{x}.{FEATURES[f]}")
                cond = cond & (c > F.lit(limit) if over else c <= F.lit(limit))
            total = total + F.when(cond, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += weight * holds(rule, x)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.5, penalty: float = 8e-4, seed: int = 5) -> RuleEnsemble:
    if len(y) < 20 or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return RuleEnsemble(float(np.log(p / (1 - p))), [])
    rng = np.random.default_rng(seed)
    f = np.zeros(len(y))
    rules: dict[Rule, None] = {}
    least = max(3, len(y) // 400)
    for _ in range(trees):
        pick = rng.random(len(y)) < 0.6
        e = y - 1 / (1 + np.exp(-f))
        made = grow(x[pick], e[pick], depth, least)
        leaves = [(r, m) for r, m in made if not any(len(o) > len(r) and o[: len(r)] == r for o, _ in made)]
        for r, m in leaves:
            f[holds(r, x)] += rate * 4 * m
        rules |= dict.fromkeys(r for r, _ in made)
    kept = [r for r in rules if 0 < holds(r, x).mean() < 1]
    unique: dict[bytes, Rule] = {}
    for r in sorted(kept, key=len):
        unique.setdefault(np.packbits(holds(r, x)).tobytes(), r)  # of rules that agree on the sample, the shortest
    kept = list(unique.values())
    r = np.array([holds(k, x) for k in kept], dtype=np.float64).T.reshape(len(y), len(kept))
    intercept, w = lasso_logistic(r, y.astype(float), penalty)
    return RuleEnsemble(intercept, [(k, float(v)) for k, v in zip(kept, w, strict=True) if v])


def labelled(docs: DataFrame, labels: DataFrame, column: str, holds_for: Column, most: int) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled documents that ``holds_for`` (over doc_id) admits, one row an id.

    Which ones follows from a hash of the id. Of several labels of an id the larger counts, of several texts that with the least
    hash. The chosen ids are bounded by ``most`` and so can be broadcast.
    """
    y = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[column].cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & holds_for)
    y = y.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return one_text_an_id(named.join(F.broadcast(y), "doc_id"), "y")


def score(docs: DataFrame, labels: DataFrame, learnable: Column, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id and score of every document, learnt from the labelled rows that ``learnable`` (over doc_id) admits."""
    sample = features(labelled(docs, labels, "quality", learnable, most), [F.col("doc_id"), F.col("y")], F.col("text")).select("doc_id", "y", "_x").orderBy("doc_id").collect()  # at most ``most`` rows
    x = np.array([[r["_x"][k] for k in FEATURES] for r in sample], dtype=float).reshape(len(sample), len(FEATURES))
    model = fit(x, np.array([r["y"] for r in sample], dtype=float))
    return features(docs, [docs["doc_id"].cast("long").alias("doc_id")], docs["text"].cast("string")).select("doc_id", model.column().alias("score"))
