"""Mixing sources to target weights by Pareto order sampling, in DataFrame expressions only.

Every source gets a target: its weight's share of all sizes, at most ``most`` times its own size, the excess shared again by weight. A
document is expected ``expected`` times in the mix (target over size, times what ``favour`` gives it): the whole part are certain copies, the rest
its inclusion probability p. Documents are ranked by Pareto's key, the odds u / (1 - u) of a seeded hash divided by the odds p / (1 - p), and
taken in that order as long as they fit into what the certain copies leave of the target: a sample of fixed size in words and of unequal probability.
A document that does not fit is passed over, and sampling ends within ``NEAR`` of the target.

That is done without walking a source: ranks are given by ranges of the whole sort key down to the row, sizes are summed by block of ranks
(of about the square root of the table, so both a block's rows and a source's blocks stay few), and only the block where a source's sum crosses its target is looked at row by row. What fits behind a document that did not is found by
another such round over the rows that are small enough; the state of a source is one interval of ranks a round.

Defined results: a null source is the last source; a null text has size 0; documents of size 0 are never taken; rows that share id and text draw the same
number and are interchangeable; texts are measured whole; a table without words has targets 0; an empty table gives an empty result; extra columns do not count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeline.llm.common import cut, parts_for
from tapeline.llm.sharding import MOST_BROADCAST, ROWS_A_RANGE, numbered

WORD = r"[^\x20\x09-\x0D]+"
#: Sampling of a source ends when so small a share of its target is left.
NEAR = 1e-5
#: Rows of a block at least.
LEAST_BLOCK = 512
ROUND = "struct<after:bigint,upto:bigint,fits:double>"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def with_targets(sources: DataFrame, most: float) -> DataFrame:
    """Sources (total, weight) with ``target``: shares by weight of all totals, none above ``most`` times its total. Only sums reach the driver."""
    if most < 1:
        raise ValueError("most must be 1 at least, or the targets cannot be met")
    cap = F.col("total") * most
    whole, weights = sources.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    share, stopped = whole / weights if weights else 0.0, 0
    while True:
        above = F.col("weight") * F.lit(share) > cap
        n, filled, rest = sources.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if n == stopped or not rest:
            return sources.withColumn("target", F.least(F.col("weight") * F.lit(float(share)), cap).cast("double"))
        share, stopped = (whole - filled) / rest, n


def with_expected(rows: DataFrame, few, most: float) -> DataFrame:
    """Rows (grp, size, total, target, favour) with ``expected`` copies: in proportion to favour, at most ``most``, of the target's size in all."""
    start = rows.groupBy("grp", "target").agg((F.first("target") / F.sum(F.col("size") * F.col("favour"))).alias("scale"))
    scales, moved = cut(start), True
    while moved:
        rated = rows.join(few(scales.select("grp", "scale")), "grp")
        full = F.col("scale") * F.col("favour") >= most
        sums = rated.groupBy("grp", "target", "scale").agg(F.sum(F.when(full, F.col("size") * most).otherwise(0.0)).alias("filled"), F.sum(F.when(~full, F.col("size") * F.col("favour")).otherwise(0.0)).alias("rest"))
        then = F.greatest(F.col("scale"), F.coalesce(F.try_divide(F.col("target") - F.col("filled"), F.col("rest")), F.col("scale")))
        scales = cut(sums.select("grp", "target", F.col("scale").alias("was"), then.alias("scale")))
        moved = scales.filter(F.col("scale") > F.col("was") * (1 + 1e-12)).limit(1).count() > 0
    return rows.join(few(scales.select("grp", "scale")), "grp").withColumn("expected", F.least(F.lit(float(most)), F.col("scale") * F.col("favour"))).drop("scale")


def first_fit(rows: DataFrame, room: DataFrame, few, block_rows: int) -> DataFrame:
    """(grp, rounds): the ranks that fit into each group's ``room`` when rows (grp, place, size) are gone through by place, ``block_rows`` places a block.

    A row is taken where its size is at most what is left and more than ``slack`` is left.
    """
    rows = rows.withColumn("block", F.expr(f"place div {block_rows}"))
    state = cut(room.select("grp", "slack", F.lit(-1).cast("long").alias("upto"), F.col("room").alias("left"), F.array().cast(f"array<{ROUND}>").alias("rounds"), (F.col("room") > F.col("slack")).alias("open")))
    while state.filter("open").limit(1).count():
        open_ = few(state.filter("open").select("grp", "upto", "left", "slack"))
        fit = rows.join(open_, "grp").filter((F.col("place") > F.col("upto")) & (F.col("size") <= F.col("left")))
        sums = fit.groupBy("grp", "block", "upto", "left", "slack").agg(F.sum("size").alias("held"))
        sums = sums.withColumn("before", F.sum("held").over(W.partitionBy("grp").orderBy("block").rowsBetween(W.unboundedPreceding, 0)) - F.col("held"))
        # The first block in which the sum comes near or crosses; without one, all that fits is taken.
        reached = F.col("before") + F.col("held") >= F.col("left") - F.col("slack")
        per = sums.groupBy("grp").agg(F.min(F.when(reached, F.col("block"))).alias("block"), F.min_by("before", F.when(reached, F.col("block"))).alias("before"), F.sum("held").alias("all"))
        per = cut(per)
        own = W.partitionBy("grp").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
        inside = fit.join(few(per.filter("block IS NOT NULL").select("grp", "block", "before")), ["grp", "block"]).withColumn("upon", F.col("before") + F.sum("size").over(own))
        taken = (F.col("upon") <= F.col("left")) & (F.col("upon") - F.col("size") < F.col("left") - F.col("slack"))
        cross = inside.groupBy("grp").agg(F.min(F.when(~taken, F.col("place"))).alias("stop"), F.max(F.when(taken, F.col("upon"))).alias("got"))
        found = state.join(few(per), "grp", "left").join(few(cross), "grp", "left")
        # Without a row that stops inside the block, the block's end does: what is left is within the slack then.
        stop = F.when(F.col("all").isNull() | F.col("block").isNull(), F.lit(2**62)).otherwise(F.coalesce("stop", (F.col("block") + 1) * block_rows))
        got = F.when(F.col("all").isNull(), 0).when(F.col("block").isNull(), F.col("all")).otherwise(F.coalesce("got", "before"))
        rest = F.col("left") - got
        done = F.struct(F.col("upto").alias("after"), stop.alias("upto"), F.col("left").alias("fits"))
        state = cut(found.select(
            "grp", "slack", F.when(F.col("open"), stop).otherwise(F.col("upto")).cast("long").alias("upto"), F.when(F.col("open"), rest).otherwise(F.col("left")).cast("double").alias("left"),
            F.when(F.col("open"), F.concat("rounds", F.array(done).cast(f"array<{ROUND}>"))).otherwise(F.col("rounds")).alias("rounds"), (F.col("open") & F.col("block").isNotNull() & (rest > F.col("slack"))).alias("open"),
        ))
    return state.select("grp", "rounds")


def mix(docs: DataFrame, weight: Column, size: Column | None = None, most: float = 3, favour: Column | None = None, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of every row.

    ``weight`` is an expression over ``source`` and ``rank`` (its place by code point, null last); ``size`` (whole numbers, by default the words of the text) and
    ``favour`` (positive, by default the same for all) are expressions over ``docs``.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit("-")), text).cast("binary"))
    rows = cut(docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.coalesce((n_words(docs["text"]) if size is None else size).cast("long"), F.lit(0)).alias("size"),
        F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit(">")).alias("key"), F.conv(F.substring(drawn, 1, 13), 16, 10).cast("long").alias("draw"),
        F.lit(1.0).alias("favour") if favour is None else favour.cast("double").alias("favour"), F.monotonically_increasing_id().alias("row"),
    ))
    found = cut(rows.groupBy("key").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n")))
    n_sources = found.count()
    found = cut(numbered(found, ["key"], parts_for(n_sources, ROWS_A_RANGE, 1), "rank"))
    few = F.broadcast if n_sources <= MOST_BROADCAST else lambda df: df
    named = found.withColumn("source", F.when(F.col("key") != ">", F.expr("substring(key, 2)")))
    sources = cut(with_targets(named.withColumn("weight", weight), most).select("key", F.col("rank").alias("grp"), "total", "target"))
    rows = rows.join(few(sources), "key").drop("key")
    rows = rows.withColumn("expected", F.coalesce(F.try_divide(F.col("target"), F.col("total")), F.lit(0.0))) if favour is None else with_expected(rows, few, most)
    share = F.col("expected") - F.floor("expected")
    u = (F.col("draw") + 0.5) / F.lit(2.0**52)
    rank = F.when((share > 0) & (F.col("size") > 0), u / (1 - u) * ((1 - share) / share))
    rows = rows.withColumn("copies", F.floor("expected").cast("long")).withColumn("pareto", rank)
    n_rows = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = numbered(rows.select("grp", "doc_id", "size", "total", "target", "copies", "pareto", "row"), ["grp", "pareto", "doc_id", "size", "row"], parts_for(n_rows, ROWS_A_RANGE, 8), "place")
    rows = cut(rows)
    room = rows.groupBy("grp").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("room"), (F.first("target") * NEAR).alias("slack"))
    rounds = first_fit(rows.filter("pareto IS NOT NULL").select("grp", "place", "size"), room, few, max(LEAST_BLOCK, math.isqrt(n_rows)))
    chosen = F.exists("rounds", lambda r: (F.col("place") > r["after"]) & (F.col("place") < r["upto"]) & (F.col("size") <= r["fits"])) & F.col("pareto").isNotNull()
    copies = F.col("copies") + chosen.cast("long")
    return rows.join(few(rounds), "grp").select("doc_id", "size", F.col("total").alias("source_size"), "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
