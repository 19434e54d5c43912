"""Quality rules with adaptive thresholds, in DataFrame expressions only.

Each document gets whole-number statistics. Per (lang, source) a mergeable quantile sketch counts every statistic in
buckets of relative width 1/32 (the five bits after the leading one; two sketches merge by adding their counts, a
quantile is off by 1/32 of itself at most). A threshold is the sketch's tail quantile plus a number of times its distance from
the median (both in STATS), so place and width follow what the group itself shows: no value of a statistic is set by hand. Where that distance is
nothing, as most documents have none of what is counted, the fence lies 1 / FLAT of the way to the median of what the language's sketch holds beyond
its own tail quantile. What is set is the share of documents that counts as the tail: statistics that only junk raises (symbols, the length of
words) take an early quantile, those that also vary among good texts (capitals, repeats) a late one.

Small groups are shrunk smoothly: to a group's counts are added those of its language, scaled to PRIOR documents, to the
language's those of the whole table in the same way. Only a language's sketch is spread over all buckets of the table (a fixed number a
statistic): a group's quantile is found among its own buckets, and between two of them by a search in its language's running counts. The
thresholds, one row a group, are then joined to the documents.

Defined results: null text has no words and fails the base rule; null lang or source form groups of their
own; texts of any length are read whole; repeated rows count and are judged each; an empty table gives an
empty result; further columns pass through untouched and may bear any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tapeline.llm.common import cut

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: name, tail quantile in thousandths, distances from the median that the fence lies beyond it, sides.
STATS = (
    ("symbols", 850, 4, "upper"),  # symbols of a million characters in words
    ("capitals", 990, 2, "upper"),  # capital letters of a million characters in words
    ("repeats", 990, 2, "upper"),  # words in repeated windows, of a million words
    ("dup_lines", 990, 2, "upper"),  # repeated lines of a million lines with words
    ("word_length", 850, 4, "both"),  # characters of a thousand words
)
#: Documents that a group's language (a language's table) counts for in the group's (the language's) sketch.
PRIOR = 200
#: Part of the way to what lies beyond a flat tail that its fence is moved.
FLAT = 8
#: Steps of a search among the buckets of a statistic: 64 small ones and 32 for each further doubling of a long are fewer than 2048.
SEARCH = [1 << k for k in range(10, -1, -1)]
#: Thresholds are broadcast up to so many groups; beyond, the join is left to the planner.
MOST_BROADCAST = 50_000


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that are found twice or more in the same text."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.coalesce(F.least(F.lit(8), F.get(starts, i + 1) - p), F.lit(8)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def starts(order: Column) -> Column:
        same = lambda e, i, d: F.coalesce(F.get(order, i + d)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.array_remove(F.transform(order, lambda e, i: F.when(same(e, i, -1) | same(e, i, 1), e["p"]).otherwise(F.lit(-1))), -1))

    def of(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(order, lambda o: _let(starts(o), covered)))

    windows = lambda ids: F.transform(F.sequence(F.lit(1), F.size(ids) - 7), lambda i: F.xxhash64(F.slice(ids, i, 8)))
    ids = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) < 9, F.lit(0).cast("long")).otherwise(_let(ids, lambda w: _let(windows(w), of)))


def base(text: Column) -> Column:
    """The base statistics of a text as one struct."""
    text = F.coalesce(text, F.lit(""))
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)

    def from_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))

    def from_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    return F.struct(
        _let(F.array_remove(F.split(text, SPACE), ""), from_words).alias("w"),
        _let(lines, from_lines).alias("l"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
    )


def measured(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` and a column ``_m`` with the statistics, the group's key and the base verdict."""
    held = docs.select(*keep, docs["lang"].cast("string").alias("_lang"), docs["source"].cast("string").alias("_source"), base(docs["text"].cast("string")).alias("_b"))
    failed = (F.col("_b.w.n_words") < 20) | (100 * F.col("_b.w.n_repeat_words") > 30 * F.col("_b.w.n_words"))
    million = lambda a, b: F.expr(f"1000000 * {a} div greatest({b}, 1)")
    value = {
        "symbols": million("_b.n_symbols", "_b.word_chars"), "capitals": million("_b.n_capitals", "_b.word_chars"), "repeats": million("_b.w.n_repeat_words", "_b.w.n_words"),
        "dup_lines": million("_b.l.n_dup_lines", "_b.l.n_lines"), "word_length": F.expr("1000 * _b.word_chars div greatest(_b.w.n_words, 1)"),
    }
    group = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    m = F.struct(
        F.col("_b.w.n_words").alias("n_words"), F.col("_b.word_chars").alias("word_chars"), F.col("_b.n_symbols").alias("n_symbols"), F.col("_b.l.n_dup_lines").alias("n_dup_lines"),
        F.col("_b.w.n_repeat_words").alias("n_repeat_words"), failed.alias("base_failed"), group("_lang").alias("lang"), group("_source").alias("source"), *[value[name].alias(name) for name, *_ in STATS],
    )
    names = [x for x in held.columns if x not in ("_lang", "_source", "_b")]
    return held.select(*[F.col(f"`{x}`") for x in names], m.alias("_m"))


def _width(value: str) -> str:
    """Width of the bucket that holds a whole number, in SQL: all bits below the leading one and five more."""
    return f"shiftleft(1L, greatest(length(bin({value})) - 6, 0))"


def sketches(m: DataFrame) -> DataFrame:
    """Counts by (lang, source, stat, bucket) of the documents that pass the base rule: the mergeable sketch. A bucket is named by its least value."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), F.col(f"_m.{name}").alias("value")) for k, (name, *_) in enumerate(STATS)]))
    rows = m.filter(~F.col("_m.base_failed")).select(F.col("_m.lang").alias("lang"), F.col("_m.source").alias("source"), each.alias("s"))
    return rows.groupBy("lang", "source", F.col("s.stat").alias("stat"), F.expr(f"s.value - s.value % {_width('s.value')}").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _whole(c: Column) -> Column:
    return c.cast(T.DecimalType(12, 0))  # three factors below 10^12 stay below 10^38


def language_counts(sketch: DataFrame) -> DataFrame:
    """(lang, stat, bucket, upto, all_0, all_1) over all buckets of the table: running weights of each language's sketch, shrunk to the table."""
    every = sketch.groupBy("stat", "bucket").agg(_whole(F.sum("n")).alias("n_0")).withColumn("all_0", _whole(F.sum("n_0").over(W.partitionBy("stat"))))  # a fixed number of buckets a statistic
    own = sketch.groupBy("lang", "stat", "bucket").agg(_whole(F.sum("n")).alias("n_1"))
    sums = own.groupBy("lang", "stat").agg(_whole(F.sum("n_1")).alias("all_1"))
    rows = sums.join(F.broadcast(every), "stat").join(own, ["lang", "stat", "bucket"], "left")
    weight = F.coalesce("n_1", _whole(F.lit(0))) * F.col("all_0") + F.lit(PRIOR) * F.col("n_0")
    upto = F.sum(weight.cast(T.DecimalType(38, 0))).over(W.partitionBy("lang", "stat").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("lang", "stat", "bucket", upto.cast(T.DecimalType(38, 0)).alias("upto"), "all_0", "all_1")


def _of_stat(k: int) -> Column:
    return F.element_at(F.array(*[F.lit(x[k]) for x in STATS]), F.col("stat") + 1)


def beyond(langs: DataFrame) -> DataFrame:
    """(lang, stat, beyond): the median of what a language's sketch holds above its tail quantile; null where that is nothing."""
    w = W.partitionBy("lang", "stat")
    run = langs.withColumn("whole", F.max("upto").over(w))
    run = run.withColumn("tail", F.min(F.when(1000 * F.col("upto") >= _of_stat(1) * F.col("whole"), F.col("upto"))).over(w))
    return run.groupBy("lang", "stat").agg(F.min(F.when((F.col("upto") > F.col("tail")) & (2 * F.col("upto") >= F.col("tail") + F.col("whole")), F.col("bucket"))).alias("beyond"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row a group: lang, source and an array of (stat, low, high) by statistic."""
    keys = ["lang", "source", "stat"]
    langs = cut(language_counts(sketch))
    big = lambda c: c.cast(T.DecimalType(38, 0))
    # A group's weight is own * A + PRIOR * the language's, in whole numbers on a scale of the group's own.
    own = sketch.groupBy(*keys, "bucket").agg(F.sum("n").alias("n_2")).withColumn("held", F.sum("n_2").over(W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)))
    own = own.join(langs, ["lang", "stat", "bucket"])
    scale = big(F.col("all_0") * (F.col("all_1") + F.lit(PRIOR)))
    own = own.withColumn("a", scale).withColumn("own", big(_whole(F.col("held")) * F.col("all_0") * (F.col("all_1") + F.lit(PRIOR)))).withColumn("f", big(F.col("own") + F.lit(PRIOR) * F.col("upto")))
    every = langs.groupBy("lang", "stat").agg(F.max("upto").alias("lang_all"), F.sort_array(F.collect_list(F.struct("bucket", "upto"))).alias("steps"))
    total = own.groupBy(*keys).agg(F.max("own").alias("own_all")).join(every.select("lang", "stat", "lang_all"), ["lang", "stat"]).select(*keys, big(F.col("own_all") + F.lit(PRIOR) * F.col("lang_all")).alias("all"))
    shares = {"lo": 1000 - _of_stat(1), "m": F.lit(500), "hi": _of_stat(1)}
    reached = lambda p: 1000 * F.col("f") >= p * F.col("all")
    found = own.join(total, keys).groupBy(*keys, "all").agg(
        *[F.min(F.when(reached(p), F.col("bucket"))).alias(f"own_{k}") for k, p in shares.items()],
        *[F.coalesce(F.max(F.when(~reached(p), F.col("own"))), big(F.lit(0))).alias(f"past_{k}") for k, p in shares.items()],
    )
    found = found.join(every, ["lang", "stat"])

    def at(k: str, p: Column) -> Column:
        """The least bucket up to which the group's share reaches ``p``: one of its own, or one before it that its language has."""
        short = lambda i: 1000 * (F.col(f"past_{k}") + F.lit(PRIOR) * F.get(F.col("steps"), i - 1)["upto"]) < p * F.col("all")
        last = F.aggregate(F.array(*map(F.lit, SEARCH)), F.lit(0), lambda i, step: F.when((i + step <= F.size("steps")) & short(i + step), i + step).otherwise(i))
        return F.least(f"own_{k}", F.get(F.col("steps"), last)["bucket"])

    q = found.select(*keys, *[at(k, p).alias(k) for k, p in shares.items()]).join(beyond(langs), ["lang", "stat"])
    edge = q.withColumn("top", F.expr(f"hi + {_width('hi')} - 1"))
    low = F.when(_of_stat(3) == "both", F.col("lo") - _of_stat(2) * (F.col("m") - F.col("lo"))).otherwise(F.lit(-1))
    high = F.col("top") + F.when(F.col("top") > F.col("m"), _of_stat(2) * (F.col("top") - F.col("m"))).otherwise(F.coalesce(F.expr(f"greatest(beyond - top, 0L) div {FLAT}"), F.lit(0)))
    fence = F.struct(F.col("stat"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    return edge.groupBy("lang", "source").agg(F.sort_array(F.collect_list(fence)).alias("fences"))


def judged(m: DataFrame, limits: DataFrame, groups: int) -> DataFrame:
    """``m`` with ``_kept``: the base rule and the fences of the document's own group."""
    limits = limits.select(F.col("lang").alias("_g1"), F.col("source").alias("_g2"), F.col("fences").alias("_f"))
    if groups <= MOST_BROADCAST:
        limits = F.broadcast(limits)
    out = m.join(limits, (F.col("_m.lang") == F.col("_g1")) & (F.col("_m.source") == F.col("_g2")), "left")
    inside = F.lit(True)
    for k, (name, *_) in enumerate(STATS):
        inside = inside & F.col(f"_m.{name}").between(F.get(F.col("_f"), F.lit(k))["low"], F.get(F.col("_f"), F.lit(k))["high"])
    return out.withColumn("_kept", ~F.col("_m.base_failed") & F.coalesce(inside, F.lit(True))).drop("_g1", "_g2", "_f")


def apply(docs: DataFrame) -> DataFrame:
    """Statistics and verdict of every document, from one pass over the texts."""
    m = cut(measured(docs, [docs["doc_id"]]))
    limits = cut(thresholds(cut(sketches(m))))
    out = judged(m, limits, limits.count())
    return out.select("doc_id", *[F.col(f"_m.{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, all columns. Each row is judged by its own text: nothing is joined by id.

    Rows are written once with their statistics, as these cost far more than the rows' storage.
    """
    fields = docs.schema.fields
    m = cut(measured(docs.select(F.struct(*[docs[f"`{f.name}`"] for f in fields]).alias("_row"), *[docs[c] for c in ("text", "lang", "source")]), [F.col("_row")]))
    limits = cut(thresholds(cut(sketches(m))))
    return judged(m, limits, limits.count()).filter("_kept").select(*[F.col("_row").getField(f.name).alias(f.name) for f in fields])


#: Columns that :func:`apply` returns.
RESULT = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")])
