"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel compares two words by their subsequences of three characters, gaps allowed, each weighted by
decay ** span; so an insult with characters inserted or left out stays close to itself. Landmarks are words of
the labelled sample; a word's kernel values with them, whitened, are its Nyström features, on which a
squared-hinge machine is trained. As the kernel is a product of explicit (hashed) subsequence vectors, the
trained machine folds into one table over character triples, and a word's decision value is a sum over its own
triples, exactly as if it had been compared with every landmark.

Only documents are labelled. All words of clean documents are negatives; in a toxic document the word that the
machine takes for the worst is the witness, found in rounds. Witnesses are also learnt with characters inserted. A document's
score is a logistic curve over its worst words, fitted to the labels.

Units of a text are its white-space words, with runs of single characters ("i d i o t") joined, and, where
a word holds other characters between letters, its letters alone as well. Words longer than WINDOW characters are read in windows
that overlap by half, so whatever fits half a window lies whole in one. Subsequences span at most SPAN characters: that is
the kernel's reach, beyond which decay leaves little; an insult that is spread wider by letters is out of reach, one spread by
other characters is met as letters alone.

The fit is bounded by its sample: at most MOST_LABELLED labelled rows by a hash of their id, of these as many as have MOST_CHARS characters in
all; texts above LONG characters come last, one that does not fit is passed over, and a label of which no text fits keeps its shortest one.
Within the sample nothing is capped: all its words are learnt from.

Defined results: null text counts as empty; an empty text has the score of a text without any bad word; texts of any
length are read whole; repeated rows are scored each, and an id with several texts is learnt from one; without labelled rows of
both kinds all scores are the share of label 1; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import cut, map_arrow, schema
from tapeline.llm.quality import labelled

MOST_LABELLED, MOST_CHARS = 5000, 10_000_000
#: Labelled texts of more characters are learnt from last.
LONG = 100_000
DECAY = 0.7
SPAN = 7
#: Triples are hashed into a table of this size; characters have numbers below CHARACTERS: 0 is a word's edge, 1 to 26 letters, the rest by a hash.
TABLE_BITS = 17
CHARACTERS = 1024
WINDOW, STRIDE = 48, 24
LANDMARKS = 360
#: What all clean words weigh against all witnesses: most of them lie beyond the margin and weigh nothing.
NEGATIVES = 40.0
MEMO_ENTRIES = 600_000
_SINGLES = re.compile(r"(?<!\S)(?:\w[\s.,\-_*]+){2,}\w(?!\S)")
_EDGE = ".,;:!?\"'()[]{}<>«»„“”…-–—*_#&$%|~"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def units(text: str) -> list[str]:
    """Words and joined runs of single characters, lower-cased, without marks at their edges."""
    text = text.lower()
    words = [w.strip(_EDGE) for w in text.split()]
    for m in _SINGLES.finditer(text):
        words.append(_NOT_LETTERS.sub("", m[0]))
    return words


_CODES: dict[str, int] = {chr(97 + i): 1 + i for i in range(26)}


def _code(c: str) -> int:
    return _CODES.get(c) or 27 + (ord(c) * 2654435761 >> 7) % (CHARACTERS - 27)


def triple_code(a, b, c):
    """Table position of three characters' numbers (or arrays of them)."""
    a, b, c = (np.atleast_1d(np.asarray(x, np.uint64)) for x in (a, b, c))  # arrays wrap around, which is meant
    packed = (a * np.uint64(CHARACTERS) + b) * np.uint64(CHARACTERS) + c
    return ((packed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _windows(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - STRIDE, STRIDE)]


_COMBOS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _combos(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (triples) of the subsequences of a word of n characters, and their weights; shorter words are padded."""
    if n not in _COMBOS:
        t = [(i, j, k) for i in range(n - 2) for j in range(i + 1, n - 1) for k in range(j + 1, min(n, i + SPAN))]
        a = np.array(t, dtype=np.int64).reshape(-1, 3)
        _COMBOS[n] = a, DECAY ** (a[:, 2] - a[:, 0] - 2.0) if len(a) else np.zeros(0)
    return _COMBOS[n]


def triples(words: list[str]):
    """By word length: (indices of the words, their triples' codes, weights, norms). Words get a mark at either end."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w) + 2, []).append(i)
    for n, idx in by.items():
        pos, weight = _combos(n)
        if not len(pos):
            continue
        for part in np.array_split(np.array(idx), len(idx) * len(pos) // 2_000_000 + 1):
            codes = np.array([[0, *map(_code, words[i]), 0] for i in part], dtype=np.int64)
            code = triple_code(codes[:, pos[:, 0]], codes[:, pos[:, 1]], codes[:, pos[:, 2]])
            # |phi|^2: weights of equal triples add up before they are squared
            order = np.argsort(code, axis=1)
            s, w = np.take_along_axis(code, order, 1), weight[order]
            new = np.ones(s.shape, bool)
            new[:, 1:] = s[:, 1:] != s[:, :-1]
            group = np.cumsum(new.ravel()) - 1
            sums = np.bincount(group, weights=w.ravel())
            row_of = np.repeat(np.arange(len(part)), s.shape[1])[new.ravel()]
            yield part, code, weight, np.sqrt(np.bincount(row_of, weights=sums**2, minlength=len(part)))


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values, words x landmarks. The table holds the landmarks' own triples only."""
    held = list(triples(landmarks))
    used = np.unique(np.concatenate([code.ravel() for _, code, _, _ in held])) if held else np.zeros(0, np.int64)
    row_of = np.zeros(1 << TABLE_BITS, np.int32)
    row_of[used] = 1 + np.arange(len(used))
    table = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    for part, code, weight, norm in held:
        for i, c, z in zip(part, code, norm, strict=True):
            np.add.at(table[:, i], row_of[c], weight / z)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for part, code, weight, norm in triples(words):
        rows = row_of[code]
        for lo in range(0, len(part), 2048):
            acc = np.zeros((len(part[lo : lo + 2048]), len(landmarks)), np.float32)
            for k in range(code.shape[1]):
                acc += np.float32(weight[k]) * table[rows[lo : lo + 2048, k]]
            out[part[lo : lo + 2048]] = acc / norm[lo : lo + 2048, None]
    return out


def _parts(word: str) -> set[str]:
    """Substrings of four to six characters, with a mark at either end of the word."""
    w = f"^{word}$"
    return {w[i : i + k] for k in (4, 5, 6) for i in range(len(w) - k + 1)}


class Model:
    """The folded machine: a table over triples, an offset, and the curve from words to a document's score."""

    def __init__(self, table: np.ndarray, offset: float, curve: tuple[float, float, float]):
        self.table, self.offset, self.curve = table.astype(np.float32), offset, curve

    def __getstate__(self):
        return {"table": self.table, "offset": self.offset, "curve": self.curve}

    def words(self, words: list[str]) -> np.ndarray:
        """Decision value of each word."""
        out = np.full(len(words), self.offset, np.float32)
        for part, code, weight, norm in triples(words):
            out[part] += (self.table[code] @ weight.astype(np.float32)) / norm
        return out

    def values(self, texts: list[str | None]) -> list[tuple[float, int]]:
        """(worst value, number of bad words) of each text; values of words are remembered up to MEMO_ENTRIES."""
        memo = self.__dict__.setdefault("_memo", {})
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        out = []
        for lo in range(0, len(texts), 512):
            split = [units(t or "") for t in texts[lo : lo + 512]]
            fresh = {w for u in split for w in u if w not in memo}
            if fresh:
                pieces, owner = [], []
                fresh = list(fresh)
                for i, w in enumerate(fresh):
                    forms = {w} | ({_NOT_LETTERS.sub("", w)} if not w.isalpha() else set())
                    for f in forms:
                        for x in _windows(f):
                            pieces.append(x)
                            owner.append(i)
                best = np.full(len(fresh), self.offset, np.float32)
                np.maximum.at(best, np.array(owner), self.words(pieces))
                memo.update(zip(fresh, best.tolist(), strict=True))
            for u in split:
                v = [memo[w] for w in u]
                out.append((max(v, default=self.offset), sum(x > 0 for x in v)))
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
        return out

    def scores(self, values: list[tuple[float, int]]) -> np.ndarray:
        v = np.array(values, dtype=float).reshape(-1, 2)
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a * v[:, 0] + b * np.log1p(v[:, 1]) + c, -30, 30)))


def _svm(held: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1e-3, rounds: int = 25, block: int = 8192) -> np.ndarray:
    """Weights and offset of a squared-hinge machine on some rows of ``held``, by Newton steps over those inside the margin, in blocks."""
    width = held.shape[1] + 1
    w = np.zeros(width)
    reg = cost * np.eye(width)
    reg[-1, -1] = 1e-8
    for _ in range(rounds):
        active = np.flatnonzero(y * _values(held, w)[rows] < 1)
        left, right = reg.copy(), np.zeros(width)
        for lo in range(0, len(active), block):
            some = active[lo : lo + block]
            x = np.c_[held[rows[some]].astype(float), np.ones(len(some))]
            left += x.T @ (x * weight[some, None])
            right += x.T @ (weight[some] * y[some])
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-6:
            return new
        w = new
    return w


def _values(held: np.ndarray, w: np.ndarray, block: int = 16_384) -> np.ndarray:
    """Decision values of all rows."""
    flat = w[:-1].astype(np.float32)
    return np.concatenate([held[lo : lo + block].astype(np.float32) @ flat for lo in range(0, len(held), block)] or [np.zeros(0, np.float32)]) + w[-1]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slopes of two inputs and the intercept of a logistic curve that neither input lowers.

    An input whose slope is negative is left out and the rest fitted again; where either could go, the likelier curve stays.
    """
    log_loss = lambda z: float(np.logaddexp(0, np.where(y > 0, -z, z)).sum())
    w = _logistic(x, y)
    if w[0] >= 0 and w[1] >= 0:
        return float(w[0]), float(w[1]), float(w[2])
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    level = float(np.log(share / (1 - share)))
    fits = [(log_loss(np.full(len(y), level)), (0.0, 0.0, level))]
    for k in (0, 1):
        slope, c = map(float, _logistic(x[:, [k]], y))
        if slope >= 0:
            fits.append((log_loss(slope * x[:, k] + c), (slope, 0.0, c) if k == 0 else (0.0, slope, c)))
    return min(fits)[1]


def _inserted(words: list[str], rng: np.random.Generator) -> list[str]:
    """Each word with one and with several characters put between its own."""
    out = []
    for w in words:
        for share in (0.25, 1.0):
            marks = [rng.choice(list(".-*_x'")) if rng.random() < share else "" for _ in w[:-1]] + [""]
            out.append("".join(a + b for a, b in zip(w, marks, strict=True)))
    return out


class _Features:
    """Nyström features of words, each computed once and held in half precision (the folded machine is in full)."""

    def __init__(self, marks: list[str]):
        kll = kernel(marks, marks).astype(float)
        values, vectors = np.linalg.eigh((kll + kll.T) / 2)
        keep = values > 1e-4
        self.marks, self.whiten = marks, (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
        self.row: dict[str, int] = {}
        self.room = np.zeros((1024, self.whiten.shape[1]), np.float16)

    @property
    def held(self) -> np.ndarray:
        return self.room[: len(self.row)]

    def of(self, words: list[str]) -> np.ndarray:
        """Rows of ``held`` of the words."""
        fresh = [w for w in dict.fromkeys(words) if w not in self.row]
        while len(self.row) + len(fresh) > len(self.room):
            self.room = np.concatenate([self.room, np.zeros((len(self.room) // 2, self.room.shape[1]), np.float16)])
        for lo in range(0, len(fresh), 8192):
            some = fresh[lo : lo + 8192]
            at = len(self.row)
            self.room[at : at + len(some)] = kernel(some, self.marks) @ self.whiten
            self.row |= zip(some, range(at, at + len(some)), strict=True)
        return np.array([self.row[w] for w in words], np.int64)

    def folded(self, w: np.ndarray) -> np.ndarray:
        """The machine as one table over triples: a word's decision value is the sum over its own."""
        beta, table = self.whiten @ w[:-1], np.zeros(1 << TABLE_BITS)
        for part, code, weight, norm in triples(self.marks):
            for i, c, q in zip(part, code, norm, strict=True):
                np.add.at(table, c, beta[i] * weight / q)
        return table


def _landmarks(suspects: list[str], family: list[str], witnesses: list[str], common: list[str], rare: list[str], rng: np.random.Generator) -> list[str]:
    """LANDMARKS words at most: likely insults, frequent and arbitrary clean words."""
    third, sixth = LANDMARKS // 3, LANDMARKS // 6
    marks = suspects[:third] + family[:: max(1, len(family) // third)][:third]
    marks = marks or witnesses[:third]
    marks += [w for w in common if len(w) > 2][:sixth]
    marks += [rare[i] for i in rng.choice(len(rare), min(len(rare), sixth), replace=False)]
    return list(dict.fromkeys(marks))


def fit(texts: list[str | None], labels: list[int], seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=int)
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    if len(y) < 20 or y.min() == y.max():
        return Model(np.zeros(1 << TABLE_BITS), 0.0, (0.0, 0.0, float(np.log(share / (1 - share)))))
    one: dict[str, str] = {}  # each word once in memory
    docs = [list(dict.fromkeys(one.setdefault(w, w) for u in units(t or "") for w in _windows(u) if w)) for t in texts]
    del one
    bad, good = Counter(), Counter()
    for d, label in zip(docs, y, strict=True):
        (bad if label else good).update(d)
    bad_docs = [d for d, label in zip(docs, y, strict=True) if label]
    del docs
    n_bad, n_good = int(y.sum()), int(len(y) - y.sum())
    lift = lambda w: np.log((bad[w] + 0.1) / (n_bad + 1)) - np.log((good[w] + 0.5) / (n_good + 1))
    suspects = sorted((w for w in bad if bad[w] >= 3 and good[w] <= 0.02 * bad[w] and lift(w) > 2), key=lambda w: (-bad[w], w))
    # Insults come in families: parts of words that toxic documents share and clean ones do not have.
    parts = Counter(g for d in bad_docs for g in {g for w in d for g in _parts(w)})
    parts = {g: n for g, n in parts.items() if n >= 4}
    clean = Counter(g for w in good for g in _parts(w) & parts.keys())
    parts = {g: n for g, n in parts.items() if clean[g] <= 0.02 * n}
    family = sorted((w for w in bad if not good[w] and bad[w] < 3 and _parts(w) & parts.keys()), key=lambda w: (-max(parts[g] for g in _parts(w) & parts.keys()), w))
    witnesses = dict.fromkeys(suspects + family)
    if not witnesses:  # labels that no word explains by count: those of the highest lift
        best = max(map(lift, bad), default=0.0)
        witnesses = dict.fromkeys(sorted(w for w in bad if lift(w) >= best - 1e-9))
    if not witnesses:  # toxic documents without any word
        return Model(np.zeros(1 << TABLE_BITS), 0.0, (0.0, 0.0, float(np.log(share / (1 - share)))))
    common = sorted(good, key=lambda w: (-good[w], w))
    features = _Features(_landmarks(suspects, family, list(witnesses), common, sorted(good), rng))
    clean_rows, how_often = features.of(common), np.array([good[w] for w in common], float)
    bad_rows = [features.of(d) if d else np.zeros(0, np.int64) for d in bad_docs]
    variants: dict[str, list[str]] = {}

    def trained() -> np.ndarray:
        pos, weigh = [], []
        for w in witnesses:  # a witness counts as often as it bears witness, also with characters inserted
            more = variants.setdefault(w, [x for x in _inserted([w], rng) if x not in good])
            pos += [w, *more]
            weigh += [min(bad[w], 100), *[min(bad[w], 100) / 3] * len(more)]
        own = features.of(pos)
        clean = np.array([w not in witnesses for w in common], bool)
        neg, often = clean_rows[clean], np.sqrt(how_often[clean])  # the more clean documents hold a word, the more it weighs
        t = np.r_[np.ones(len(own)), -np.ones(len(neg))]
        return _svm(features.held, np.r_[own, neg], t, np.r_[np.array(weigh) / sum(weigh), NEGATIVES * often / max(1.0, often.sum())])

    for _ in range(3):
        w = trained()
        value = _values(features.held, w)
        for d, rows in zip(bad_docs, bad_rows, strict=True):
            v = value[rows]
            if len(v) and v.max() < 0.3:  # no witness yet: the worst word that no clean document has
                free = [(x, word) for x, word in zip(v.tolist(), d, strict=True) if not good[word]]
                if free and max(free)[0] > -0.6:
                    witnesses[max(free)[1]] = None
    w = trained()
    model = Model(features.folded(w), float(w[-1]), (4.0, 0.0, 0.0))
    del features, clean_rows, bad_rows
    v = np.array(model.values(texts), dtype=float)
    model.curve = curve(np.c_[v[:, 0], np.log1p(v[:, 1])], y)
    return model


def sampled(bounded: DataFrame, chars: int) -> list:
    """Rows (doc_id, text, y) of ``bounded`` (a row an id, of a bounded number), ``chars`` characters in all, texts above LONG last.

    Sizes are looked at before texts are fetched. A text that does not fit is passed over; a label of which none fits keeps its shortest text.
    """
    held = cut(bounded.withColumn("_n", F.length(F.coalesce("text", F.lit("")))))
    order = sorted(held.select("doc_id", "y", "_n", F.xxhash64("doc_id").alias("h")).collect(), key=lambda r: (r["_n"] > LONG, r["h"], r["doc_id"]))  # numbers only
    chosen, used = {}, 0
    for r in order:
        if used + r["_n"] <= chars:
            chosen[r["doc_id"]] = r["y"]
            used += r["_n"]
    for label in {r["y"] for r in order} - set(chosen.values()):
        chosen[min((r for r in order if r["y"] == label), key=lambda r: r["_n"])["doc_id"]] = label
    ids = held.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")
    return held.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "text", "y").orderBy("doc_id").collect()


def score(docs: DataFrame, labels: DataFrame, learnable: Column, most: int = MOST_LABELLED, chars: int = MOST_CHARS) -> DataFrame:
    """doc_id and score of every document, learnt from at most ``most`` labelled rows of ``chars`` characters that ``learnable`` (over doc_id) admits."""
    sample = sampled(labelled(docs, labels, "toxic", learnable, most), chars)
    shared = docs.sparkSession.sparkContext.broadcast(fit([r["text"] for r in sample], [r["y"] for r in sample]))  # a table of fixed size

    def run(batch: pa.RecordBatch) -> dict:
        model = shared.value
        return {"doc_id": batch.column(0), "score": model.scores(model.values(batch.column(1).to_pylist())).tolist()}

    return map_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), run, schema("doc_id long,score double"))
