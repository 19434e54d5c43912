"""Merkle manifest of a dataset: a hash tree of the rows by group, a tree of the groups above it, and each row's proof.

Level by level, a window partitioned by group and parent index collects the ordered digests of a run over its full frame: the list is
the parent's preimage and, without the node itself, its siblings. One row a parent goes on to the next level, so a level holds a third of
the one below and a window's partition never more than ``FAN`` rows, whatever a group holds. Each level is written once. From the top
down, a node's proof is its own step and its parent's proof: joins on (group, parent index), where every key has ``FAN`` rows at most.

Rows are numbered by ranges of the whole sort key (:func:`tapeline.llm.sharding.numbered`), so a group that holds a large share of all rows is
dealt like any other. Proofs of the upper levels are broadcast where a level has at most ``MOST_BROADCAST`` nodes, which is counted first.

Defined results: a null field is hashed as ``-``, an empty one as ``0:``; the null group comes first; a null id comes first in its group and is never
tampered with; rows that share an id ascend by leaf, and rows alike in all five fields are interchangeable; texts are hashed whole;
an empty table gives an empty result; extra columns do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeline.llm.common import cut, parts_for
from tapeline.llm.sharding import ROWS_A_RANGE, numbered

#: Children of a node.
FAN = 3
#: Nodes of a level (groups of a table) whose proofs (numbers) are broadcast: 4096 proofs of 40 levels are 20 MB at most.
MOST_BROADCAST = 4096
STEP = "struct<before:string,after:string>"


def field(value: Column) -> Column:
    """A field as it is hashed: UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def level(nodes: DataFrame) -> DataFrame:
    """Nodes (grp, at, digest, any others) with ``parent``, the digest above, and ``step``, the digests of the run before and after the node."""
    w = W.partitionBy("grp", F.expr(f"at div {FAN}")).orderBy("at").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    place = (F.col("at") % FAN).cast("int")
    joined = lambda a: F.array_join(a, "")
    run = nodes.withColumn("run", F.collect_list("digest").over(w))
    step = F.struct(joined(F.slice("run", F.lit(1), place)).alias("before"), joined(F.slice("run", place + 2, F.lit(FAN))).alias("after"))
    return run.select(*nodes.columns, F.sha2(joined(F.col("run")).cast("binary"), 256).alias("parent"), step.alias("step"))


def tree(nodes: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tops, proofs) of the trees over ``nodes`` (grp, at: 0 to n - 1, n, digest, any others); ``sizes`` has a row (n) a group.

    tops: grp, top. proofs: the nodes with ``proof``, their steps from the node up to its group's top.
    """
    rise = lambda k: F.expr(f"(n + {FAN**k - 1}L) div {FAN**k}L")  # noqa: E731  nodes that a group has k levels up; one: its top
    most, depth = sizes.agg(F.max("n")).first()[0] or 1, 0
    while FAN**depth < most:
        depth += 1
    alive = sizes.agg(*[F.coalesce(F.sum(F.when(rise(k) > 1, rise(k))), F.lit(0)) for k in range(depth + 1)]).first()
    none = F.array().cast(f"array<{STEP}>")
    alone = nodes.filter("n = 1")
    tops, levels, current = alone.select("grp", F.col("digest").alias("top")), [], nodes.filter("n > 1")
    for _ in range(depth):
        levels.append(cut(level(current)))
        up = levels[-1].filter(F.col("at") % FAN == 0).select("grp", F.expr(f"at div {FAN}").alias("at"), rise(1).alias("n"), F.col("parent").alias("digest"))
        tops = tops.unionByName(up.filter("n = 1").select("grp", F.col("digest").alias("top")))
        current = up.filter("n > 1")
    proofs = None
    for k in reversed(range(depth)):
        own = levels[k].withColumn("proof", F.array("step").cast(f"array<{STEP}>")).drop("parent", "step")
        if proofs is not None:
            above = proofs.select("grp", F.col("at").alias("up"), F.col("proof").alias("rest"))
            above = F.broadcast(above) if alive[k + 1] <= MOST_BROADCAST else above.hint("merge")
            own = own.withColumn("up", F.expr(f"at div {FAN}")).join(above, ["grp", "up"], "left").withColumn("proof", F.concat("proof", F.coalesce("rest", none)))
        proofs = own.select(*[c for c in own.columns if c not in ("up", "rest")])
    alone = alone.withColumn("proof", none)
    return tops, alone if proofs is None else alone.unionByName(proofs)


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", order: str = "doc_id", **more: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof and the columns ``more`` of every row: a tree by ``group``, whose tops are the leaves of one above.

    ``proof`` lists steps (before, after) from the leaf to the root: the digests that stand before and after the node in its run.
    """
    rows = cut(docs.select(
        docs[order].cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), docs[group].cast("string")), F.lit("")).alias("key"),
        leaf(*[docs[c] for c in fields]).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
        *[c.alias(n) for n, c in more.items()],
    ))
    rows = cut(numbered(rows, ["key", "doc_id", "digest", "row"], parts_for(rows.count(), ROWS_A_RANGE, 8), "place"))
    found = rows.groupBy("key").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    found = cut(found)
    groups = found.count()
    found = cut(numbered(found, ["key"], parts_for(groups, ROWS_A_RANGE, 1), "grp"))
    few = F.broadcast if groups <= MOST_BROADCAST else lambda df: df
    nodes = rows.join(few(found), "key").select("grp", (F.col("place") - F.col("start")).alias("at"), "n", "digest", "doc_id", *more)
    tops, proofs = tree(nodes, found.select("n"))
    heads = cut(tops.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("at"), F.lit(groups).cast("long").alias("n"), F.col("top").alias("digest")))
    over, above = tree(heads, docs.sparkSession.createDataFrame([(groups,)], "n long"))
    root = (over.first() or [None, None])[1]  # one digest
    above = above.select(F.col("at").alias("grp"), F.col("digest").alias("subroot"), F.col("proof").alias("rest"))
    out = proofs.join(few(above), "grp")
    return out.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), F.concat("proof", "rest").alias("proof"), *more)


def digest(docs: DataFrame, changed: Column) -> DataFrame:
    """The manifest with each proof as one hash, and the roots that the rows' proofs lead to when ``text`` reads as ``changed`` (null: as it is)."""
    again = F.when(changed.isNotNull(), leaf(*[docs[c] for c in ("doc_id", "source", "lang", "n_chars")], changed))
    out = manifest(docs, _changed=again)
    proof = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof.cast("binary"), 256).alias("proof_sha256"), fold(F.coalesce("_changed", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda a, s: F.sha2(F.concat(s["before"], a, s["after"]).cast("binary"), 256))
