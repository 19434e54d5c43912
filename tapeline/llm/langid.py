"""Language identification by a linear-chain conditional random field over words.

Every word of a text is labelled by forward-backward over the chain of all its words, so code-switched text gets a
language a word; a document takes the language with the largest share of the word posteriors. Features of a word are
its affixes, its character n-grams, its membership in the learnt lexicons (the frequent words of the
labelled sample) and the word itself; they are hashed into a table of fixed size. Emission weights and
transitions are trained together on the conditional likelihood.

A chain is a whole text, however long. Texts are stepped through side by side, longest first, so that a step handles
all texts that still have a word there. A word without letters (Unicode category L) has no emission and leaves the
chain to its neighbours.

The fit reads whole labelled texts of every language: a sample bounded in rows (MOST_LABELLED) and characters
(MOST_CHARS), which the languages share evenly. Of a language the rows follow a hash of their id; texts longer than
LONG characters come after the others. So time and memory of the driver do not follow the table.

Beside the language, the share of a text's words that the labelled sample supports (words at least half of whose
character triples it holds) is known. Switching between learnt languages does not lower it, but text of another
language or script and letter salad does; :func:`keep_known` judges by it.

Defined results: null text, or text without a letter, is ``und`` with score 0; texts of any length are read whole;
repeated rows are labelled each, and an id with several labelled texts of a language is learnt from one; without any
labelled row all is ``und``; an empty table gives an empty result; extra columns are left out (:func:`keep_known`
keeps all of them, whatever their names, and lets documents of ``und`` go).
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeline.llm.common import map_arrow, one_text_an_id, schema

#: Labelled documents that are fitted at most, and their characters; every language has an even share of both.
MOST_LABELLED, MOST_CHARS = 2000, 2_400_000
#: Labelled texts of more characters are learnt only where a language has too few others.
LONG = 20_000
TABLE = 1 << 16
SUPPORT = 1 << 20
LEXICON = 300
MEMO_ENTRIES = 300_000
#: Words whose chains are stepped through at a time.
BLOCK_WORDS = 400_000
_EDGE = ".,;:!?\"'()[]{}<>«»„“”…-–—*_#&$%|~0123456789"
UNKNOWN = "und"


def word_features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Hashes of a lower-cased word's features; the last len(word) are those of its character triples."""
    w = f"^{word}$"
    raw = [f"w{word}", f"l{lexicon[word]}"] if word in lexicon else []
    raw += [f"p{w[:k]}" for k in (2, 3, 4)] + [f"s{w[-k:]}" for k in (2, 3, 4)]
    n = len(w)
    raw += [w[i : i + 2] for i in range(n - 1)] + [w[i : i + 3] for i in range(n - 2)]
    return [crc32(x.encode("utf-8", "surrogatepass")) for x in raw]


def normal(word: str) -> str:
    return word.lower().strip(_EDGE)


def lettered(word: str) -> bool:
    """Whether a character of Unicode category L is in the word (str.isalpha holds for exactly these)."""
    return word.isalpha() or any(map(str.isalpha, word))


def forward_backward(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Posteriors (words, labels) of chains that lie end to end in ``emit`` (log weights); with ``pairs`` also the summed posteriors of label pairs.

    ``lengths`` holds the chains' words, none of them 0.
    """
    n, total, labels = len(lengths), int(lengths.sum()), emit.shape[1]
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    longest = int(lengths.max(initial=0))
    alive = n - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")  # chains with a word at step t
    off = np.concatenate([[0], np.cumsum(alive)])
    step = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = off[step] + np.repeat(rank, lengths)  # of each word, step by step
    e = np.empty((total, labels), emit.dtype)
    e[place] = np.exp(emit - emit.max(axis=1, keepdims=True))
    a = np.exp(trans - trans.max())
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((total, 1), e.dtype)
    cur = np.exp(start - start.max()) * e[: alive[0] if longest else 0]
    for t in range(longest):
        lo, hi = off[t], off[t + 1]
        if t:
            cur = (cur[: hi - lo] @ a) * e[lo:hi]
        s = cur.sum(axis=1, keepdims=True)
        cur = cur / s
        alpha[lo:hi], scale[lo:hi] = cur, s
    at = a.T
    for t in range(longest - 1, 0, -1):
        lo, hi = off[t], off[t + 1]
        beta[off[t - 1] : off[t - 1] + hi - lo] = ((e[lo:hi] * beta[lo:hi]) @ at) / scale[lo:hi]
    post = alpha * beta
    post /= post.sum(axis=1, keepdims=True)
    if not pairs:
        return post[place]
    later = np.flatnonzero(step > 0)
    now, before = place[later], place[later - 1]
    xi = a * (alpha[before].T @ (e[now] * beta[now] / scale[now])) if len(later) else np.zeros((labels, labels))
    return post[place], xi


class Crf:
    def __init__(self, languages: list[str], table: np.ndarray, trans: np.ndarray, start: np.ndarray, lexicon: dict[str, int], seen: np.ndarray):
        self.languages, self.table, self.trans, self.start, self.lexicon = languages, table.astype(np.float32), trans.astype(np.float32), start.astype(np.float32), lexicon
        self.seen = seen

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _index(self, words: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Position of each word in a table of emissions, that table, and marks: 0 without letters, 1 with letters, 2 supported as well."""
        memo = self.__dict__.setdefault("_memo", {})
        if len(memo) > MEMO_ENTRIES or "_emit" not in self.__dict__:
            memo.clear()
            self._emit, self._marks, self._used = np.zeros((4096, len(self.languages)), np.float32), np.zeros(4096, np.int8), 0
        fresh = list({w for d in words for w in d if w not in memo})
        while self._used + len(fresh) > len(self._emit):
            self._emit, self._marks = np.concatenate([self._emit, np.zeros_like(self._emit)]), np.concatenate([self._marks, np.zeros_like(self._marks)])
        known, sizes, triples, flat = [], [], [], array("L")
        for w in fresh:
            k = memo[w] = self._used
            self._used += 1
            c = normal(w)
            if lettered(c):
                f = word_features(c, self.lexicon)
                flat.extend(f)
                known.append(k)
                sizes.append(len(f))
                triples.append(len(c))
        if known:
            hashes, sizes, triples = np.array(flat, np.int64), np.array(sizes), np.array(triples)
            ends = np.cumsum(sizes)
            self._emit[known] = np.add.reduceat(self.table[hashes % TABLE], ends - sizes, axis=0) / np.sqrt(sizes.astype(np.float32))[:, None]
            hits = np.concatenate([[0], np.cumsum(self.seen[hashes % SUPPORT])])
            self._marks[known] = 1 + (2 * (hits[ends] - hits[ends - triples]) >= triples)
        get = memo.__getitem__
        return [np.fromiter(map(get, d), np.int64, len(d)) for d in words], self._emit, self._marks

    def label(self, texts: Iterable[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, its share and the share of supported words of each text."""
        pred, score, support = [], [], []
        for p, s in self.posteriors(texts):
            k = -1 if p is None else int(np.argmax(p))
            pred.append(UNKNOWN if p is None else self.languages[k])
            score.append(0.0 if p is None else float(min(1.0, p[k])))
            support.append(s)
        return pred, score, support

    def posteriors(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray | None, float]]:
        """Mean posterior of the languages over each text's words with letters (None without any), and the share of them that is supported."""
        block, size = [], 0
        for t in texts:
            block.append((t or "").split() if self.languages else [])
            size += len(block[-1])
            if size >= BLOCK_WORDS:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, words: list[list[str]]) -> Iterator[tuple[np.ndarray | None, float]]:
        filled = [d for d in words if d]
        if filled:
            index, emit, marks = self._index(filled)
            lengths, flat = np.array([len(d) for d in filled]), np.concatenate(index)
            post = forward_backward(emit[flat], lengths, self.trans, self.start)
            m, first = marks[flat], np.cumsum(lengths) - lengths
            total = np.add.reduceat(post * (m > 0)[:, None], first, axis=0)
            count, backed = np.add.reduceat((m > 0).astype(np.int64), first), np.add.reduceat((m > 1).astype(np.int64), first)
        k = 0
        for d in words:
            if not d:
                yield None, 0.0
                continue
            yield (total[k] / count[k], float(backed[k] / count[k])) if count[k] else (None, 0.0)
            k += 1

    def word_languages(self, text: str) -> list[tuple[str, str]]:
        """Each word with its likeliest language: the labels of code-switched text."""
        words = text.split()
        if not words or not self.languages:
            return [(w, UNKNOWN) for w in words]
        index, emit, marks = self._index([words])
        post = forward_backward(emit[index[0]], np.array([len(words)]), self.trans, self.start)
        return [(w, self.languages[int(np.argmax(p))] if marks[i] else UNKNOWN) for w, p, i in zip(words, post, index[0], strict=True)]


def _lexicon(words: list[list[str]], langs: list[str], languages: list[str]) -> dict[str, int]:
    """Frequent words of each language, where no other language holds them oftener."""
    seen: dict[str, Counter] = {x: Counter() for x in languages}
    for d, lang in zip(words, langs, strict=True):
        seen[lang].update({normal(w) for w in d})
    docs = Counter(langs)
    out: dict[str, int] = {}
    for i, x in enumerate(languages):
        for w, n in sorted(seen[x].items(), key=lambda p: (-p[1], p[0]))[:LEXICON]:
            if lettered(w) and all(n * docs[y] > seen[y][w] * docs[x] or (n * docs[y] == seen[y][w] * docs[x] and i <= j) for j, y in enumerate(languages)):
                out[w] = i
    return out


def fit(texts: list[str], langs: list[str], rounds: int = 30, rate: float = 0.35, ridge: float = 2e-6) -> Crf:
    """The field that whole labelled texts teach, by full-batch adaptive gradient steps; memory is bounded by blocks of texts."""
    languages = sorted(set(langs))
    k = len(languages)
    words, gold = [], []
    for t, x in zip(texts, langs, strict=True):
        if d := t.split():
            words.append(d)
            gold.append(x)
    lexicon = _lexicon(words, gold, languages)
    names: dict[str, int] = {}
    docs = [np.array([names.setdefault(w, len(names)) for w in d], np.int64) for d in words]
    flat, sizes, seen = array("L"), np.zeros(len(names), np.int64), np.zeros(SUPPORT, np.int32)
    in_docs = np.zeros(len(names), np.int64)
    for d in docs:
        in_docs[np.unique(d)] += 1
    for w, at in names.items():
        if lettered(c := normal(w)):
            f = word_features(c, lexicon)
            flat.extend(f)
            sizes[at] = len(f)
            for h in {x % SUPPORT for x in f[-len(c) :]}:
                seen[h] += in_docs[at]
    seen = seen > 1  # triples of one document alone back nothing
    if k < 2:
        return Crf(languages, np.zeros((TABLE, k)), np.zeros((k, k)), np.zeros(k), lexicon, seen)
    del words, names
    cell = (np.array(flat, np.int64) % TABLE).astype(np.int32)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    norm = 1 / np.sqrt(np.maximum(sizes, 1))
    gold_of = np.array([languages.index(x) for x in gold])
    lengths = np.array([len(d) for d in docs])
    at_most = max(1000, 4_000_000 // k)
    blocks = np.split(np.arange(len(docs)), np.flatnonzero(np.diff(np.cumsum(lengths) // at_most)) + 1)
    n_words, n_docs = int(lengths.sum()), len(docs)
    same = np.bincount(gold_of, weights=lengths - 1, minlength=k)
    table, trans, start = np.zeros((TABLE, k)), np.zeros((k, k)), np.zeros(k)
    sq = [np.full((TABLE, k), 1e-8), np.full((k, k), 1e-8), np.full(k, 1e-8)]
    for _ in range(rounds):
        emit = (np.stack([np.bincount(owner, weights=table[cell, j], minlength=len(sizes)) for j in range(k)], axis=1) * norm[:, None]).astype(np.float32)
        g_word, g_trans, g_start = np.zeros((len(sizes), k)), np.diag(same), np.zeros(k)
        for b in blocks:
            own = np.concatenate([docs[i] for i in b])
            post, xi = forward_backward(emit[own], lengths[b], trans.astype(np.float32), start.astype(np.float32), pairs=True)
            miss = -post
            miss[np.arange(len(own)), np.repeat(gold_of[b], lengths[b])] += 1
            for j in range(k):
                g_word[:, j] += np.bincount(own, weights=miss[:, j], minlength=len(sizes))
            g_trans = g_trans - xi
            g_start += miss[np.cumsum(lengths[b]) - lengths[b]].sum(axis=0)
        g_word *= norm[:, None]
        g_table = np.stack([np.bincount(cell, weights=g_word[owner, j], minlength=TABLE) for j in range(k)], axis=1)
        grads = [g_table / n_words - ridge * table, g_trans / n_words - 1e-3 * trans, g_start / n_docs - 1e-3 * start]
        for p, g, s, r in zip((table, trans, start), grads, sq, (rate, rate / 2, rate / 4), strict=True):
            s += g * g
            p += r * g / np.sqrt(s)
    return Crf(languages, table, trans, start, lexicon, seen)


def sample(docs: DataFrame, learnable: Column, most: int = MOST_LABELLED, chars: int = MOST_CHARS) -> list:
    """Rows (text, lang, doc_id) of all languages, ``most`` of them and ``chars`` characters in all, bounded whatever the table holds.

    A language gets an even share of both (one row at least), by a hash of the id.
    """
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang")).filter(learnable & F.col("lang").isNotNull())
    found = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a language
    if not found:
        return []
    rows, size = max(1, most // len(found)), max(1, chars // len(found))
    counts = own.sparkSession.createDataFrame([tuple(r) for r in found], "known string, n long")
    # Twice the share is drawn by the id's hash, so that texts which are too long can be passed over.
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / F.lit(1 << 30)
    picked = own.join(F.broadcast(counts), F.col("lang") == F.col("known")).filter(F.col("text").isNotNull() & (draw * F.col("n") < max(2 * rows, 50)))
    w = W.partitionBy("lang").orderBy(F.length("text") > LONG, F.xxhash64("doc_id", F.lit(11)), "doc_id")  # some 2 * rows rows a language
    held = one_text_an_id(picked, "lang").withColumn("_turn", F.row_number().over(w)).withColumn("_size", F.sum(F.length("text")).over(w))
    rows = held.filter((F.col("_turn") == 1) | ((F.col("_turn") <= rows) & (F.col("_size") <= size))).select("text", "lang", "doc_id").collect()
    return sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["lang"], r["text"]))


def learnt(docs: DataFrame, learnable: Column):
    """The field of a table's labelled documents, broadcast: of fixed size for a number of languages."""
    rows = sample(docs, learnable)
    return docs.sparkSession.sparkContext.broadcast(fit([r["text"] for r in rows], [r["lang"] for r in rows]))


def predict(docs: DataFrame, learnable: Column) -> DataFrame:
    """doc_id, lang_pred, score, support of every document, learnt from the documents that ``learnable`` (over doc_id) admits."""
    shared = learnt(docs, learnable)

    def run(batch: pa.RecordBatch) -> dict:
        pred, score, support = shared.value.label(t.as_py() for t in batch.column(1))
        return {"doc_id": batch.column(0), "lang_pred": pred, "score": score, "support": support}

    return map_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), run, schema("doc_id long,lang_pred string,score double,support double"))


def keep_known(docs: DataFrame, learnable: Column, least_support: float = 0.6) -> DataFrame:
    """The documents in learnt languages, all columns, row by row: those with letters, ``least_support`` of whose words the labelled sample supports.

    Text that switches between languages is clean and stays; text without letters (null included), of a language or
    script that nobody labelled, and letter salad go. Where nothing is labelled, nothing is known and all go.
    """
    shared = learnt(docs, learnable)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            pred, _, support = shared.value.label(t.as_py() for t in batch.column(at))
            ok = [p != UNKNOWN and s >= least_support for p, s in zip(pred, support, strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
