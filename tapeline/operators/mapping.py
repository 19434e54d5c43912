"""Companies to securities: tax numbers, primary security, joins, fuzzy names, confounders, the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeline.functions import text
from tapeline.operators.panel import keep_one
from tapeline.sources.scratch import staged

# Security types of common and preferred shares, and the categories that count as confounders.
COMMON, PREFERRED = ["common_share"], ["preferred_share"]
CONFOUNDERS = ["financial_statements", "dividends_recommendation", "dividends_decision"]


def all_shares(traded: DataFrame, other: DataFrame) -> DataFrame:
    """Traded and delisted securities, one row a secid: a traded one first, then the earliest."""
    return keep_one(traded.unionByName(other, allowMissingColumns=True), ["secid"], [F.desc("is_traded"), F.asc("seq")])


def primary_security(securities: DataFrame) -> DataFrame:
    """Securities by tax number with the flag ``primary``: common before preferred before others, traded first, then the shortest and first secid."""
    s = securities.withColumn("inn", text.normalize_inn(F.col("emitent_inn"))).filter("inn IS NOT NULL").withColumn("is_traded", F.coalesce(F.expr("try_cast(is_traded AS bigint)"), F.lit(0)))
    s = s.withColumn("is_common", F.coalesce(F.col("type").isin(COMMON), F.lit(False))).withColumn("is_preferred", F.coalesce(F.col("type").isin(PREFERRED), F.lit(False)))
    rank = F.when(F.col("is_common"), 0).when(F.col("is_preferred"), 1).otherwise(2)
    order = [rank, F.desc("is_traded"), F.length("secid"), F.asc("secid")]
    s = keep_one(s, ["inn", "secid"], [*order, F.asc("seq")] if "seq" in s.columns else order)
    s = s.withColumn("primary", F.row_number().over(W.partitionBy("inn").orderBy(*order)) == 1)
    return s.select("inn", "secid", "shortname", "is_traded", "type", "is_common", "is_preferred", "primary", "emitent_title")


def map_companies(companies: DataFrame, mapping: DataFrame, primary_only: bool = False) -> DataFrame:
    keys = companies.select("company_id", text.normalize_inn(F.col("inn")).alias("inn")).filter("inn IS NOT NULL").distinct()
    m = mapping.filter("primary") if primary_only else mapping
    return keys.join(m, "inn").select("company_id", "inn", "secid", "shortname", "is_traded", "type", "primary")


def unmatched_companies(companies: DataFrame, mapping: DataFrame) -> DataFrame:
    c = companies.select("company_id", "name", text.normalize_inn(F.col("inn")).alias("inn"))
    left = c.join(mapping.select("inn").distinct(), "inn", "left_anti")
    return left.select("company_id", "name", "inn", F.when(F.col("inn").isNull(), "no_inn").otherwise("no_match").alias("reason"))


NAME_FIELDS = ("emitent_title", "name", "shortname")


def name_pairs(queries: DataFrame, forms: DataFrame, top_n: int) -> DataFrame:
    """(query, secid) that can be among a query's best: queries (query, q) and forms (secid, t0, t1, t2) hold distinct words.

    A query's words are taken rarest first. A name whose first common word is the i-th of n shares n - i words at most, so its Jaccard
    cannot pass (n - i) / n, less where the name is short or long. The rarest word's names and, of every word, the ``top_n`` shortest names
    are scored first; the score that ranks ``top_n``-th there rules out most of the frequent words' names. Names that share the last
    word alone are better the shorter they are: the shortest suffice.
    """
    each = F.explode(F.array(*[F.struct(F.array_sort(F.coalesce(F.array_distinct(f"t{k}"), F.array().cast("array<string>"))).alias("words")) for k in range(len(NAME_FIELDS))]))
    names = forms.select("secid", each.alias("f")).filter(F.size("f.words") > 0).distinct()
    index = names.select("secid", F.size("f.words").alias("size"), F.explode("f.words").alias("word"))
    how_often = index.groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    short = index.withColumn("_k", F.row_number().over(W.partitionBy("word").orderBy("size", "secid"))).filter(F.col("_k") <= 3 * top_n).drop("_k")
    asked = queries.select("query", F.size("q").alias("n"), F.explode("q").alias("word")).join(how_often, "word")
    asked = asked.withColumn("i", F.row_number().over(W.partitionBy("query").orderBy("often", "word")) - 1 + F.col("n") - F.count(F.lit(1)).over(W.partitionBy("query")))  # unknown words come before all
    first = asked.withColumn("_first", F.min("i").over(W.partitionBy("query")) == F.col("i"))
    seeds = first.filter("_first").join(index, "word").select("query", "secid").unionByName(first.join(short, "word").select("query", "secid")).distinct()
    scored = score_names(seeds, queries, forms)
    floor = scored.withColumn("_k", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score")))).filter(F.col("_k") == top_n).select("query", F.col("score").alias("floor"))
    rest = first.filter("NOT _first AND i < n - 1").join(floor, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    common = F.least(F.col("n") - F.col("i"), F.col("size"))
    reach = rest.filter((F.col("n") - F.col("i")) / F.col("n") >= F.col("floor")).join(index, "word").filter(common / (F.col("n") + F.col("size") - common) >= F.col("floor"))
    return seeds.unionByName(reach.select("query", "secid")).distinct()


def score_names(pairs: DataFrame, queries: DataFrame, forms: DataFrame) -> DataFrame:
    """``pairs`` with the best Jaccard of the name's fields, where it is not nothing."""
    both = pairs.join(forms, "secid").join(queries, "query")
    return both.withColumn("score", F.greatest(*[text.jaccard(F.col("q"), F.col(f"t{k}")) for k in range(len(NAME_FIELDS))])).filter("score > 0")


def fuzzy_candidates(queries: DataFrame, securities: DataFrame, top_n: int = 5) -> DataFrame:
    """Securities with names like a query's: the best Jaccard of three fields ranks; see :func:`name_pairs` for which pairs are made."""
    q = queries.select("query", text.name_tokens(F.col("query")).alias("q"))
    order = [F.asc("seq")] if "seq" in securities.columns else [F.asc("shortname")]
    s = keep_one(securities, ["secid"], order)
    forms = s.select("secid", "shortname", "emitent_title", "emitent_inn", *[text.name_tokens(F.col(c)).alias(f"t{k}") for k, c in enumerate(NAME_FIELDS)])
    words = q.distinct()
    scored = score_names(name_pairs(words, forms, top_n), words, forms)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "secid"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top_n).select("query", "rank", "secid", "shortname", "emitent_title", "emitent_inn", "score")


def flag_confounders(events: DataFrame, categories: list[str] = CONFOUNDERS, days: int = 5) -> DataFrame:
    """Adds has_confounder: another event of these categories on the security within ``days`` days either way.

    The nearest ones strictly before and after and those of the same moment decide, so running windows do, each row looked at once;
    a frame of ``days`` would be added up anew for every row. No self-join.
    """
    is_conf = F.coalesce(F.col("category").isin(categories), F.lit(False))
    micros = F.unix_micros(F.col("published_at").cast("timestamp"))
    near = days * 86_400_000_000
    known = events.withColumn("_us", micros).withColumn("_c", is_conf.cast("int")).withColumn("_at", F.when(is_conf, F.col("_us")))
    strictly = lambda order: W.partitionBy("secid").orderBy(order).rangeBetween(W.unboundedPreceding, -1)
    known = known.withColumn("_next", F.min("_at").over(strictly(F.desc("_us")))).withColumn("_last", F.max("_at").over(strictly(F.asc("_us"))))
    known = known.withColumn("_same", F.sum("_c").over(W.partitionBy("secid", "_us")) - F.col("_c"))
    found = (F.col("_same") > 0) | F.coalesce(F.col("_next") - F.col("_us") <= near, F.lit(False)) | F.coalesce(F.col("_us") - F.col("_last") <= near, F.lit(False))
    return known.withColumn("has_confounder", found & F.col("_us").isNotNull()).drop("_us", "_c", "_at", "_next", "_last", "_same")


#: Distinct titles, and characters of them, up to which their categories are sent to every task.
MOST_TITLES, MOST_TITLE_CHARS = 50_000, 8_000_000


def classify_messages(messages: DataFrame) -> DataFrame:
    """Adds category and direction. Patterns are tried on distinct titles, whose categories then meet the messages.

    Titles repeat far more often than not, and tasks merge them before any exchange. More of them than MOST_TITLES or MOST_TITLE_CHARS
    are no longer sent to the tasks: there, as in a stream, the patterns are tried on every row, so no row is moved by its title.
    """
    category = text.classify(F.col("event_type"))
    if not messages.isStreaming:
        titles = staged(messages.select("event_type").distinct())
        n, chars = titles.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("event_type")), F.lit(0))).first()
        if n <= MOST_TITLES and chars <= MOST_TITLE_CHARS:
            known = staged(titles.select(F.col("event_type").alias("_title"), category.alias("_category")))
            kept = [F.col(f"`{c}`") for c in messages.columns if c not in ("category", "direction")]
            category = F.col("_category")
            messages = messages.join(F.broadcast(known), F.col("event_type").eqNullSafe(F.col("_title"))).select(*kept, "_category")
    return messages.withColumn("category", category).withColumn("direction", text.static_direction(F.col("category"))).drop("_category")


def insider_trades(pages: DataFrame) -> DataFrame:
    """Stake changes of event pages (event_id, body_text) with the role of the person: event_id and the fields of a stake."""
    told = text.stake_changes(pages.filter(text.is_stake_text(F.col("body_text"))).select("event_id", "body_text")).select("event_id", "stake.*")
    return told.withColumn("role", text.classify_role(F.col("position")))


def events_table(messages: DataFrame, companies: DataFrame, mapping: DataFrame, trades: DataFrame | None = None, categories: list[str] | None = None) -> DataFrame:
    """Classified messages of mapped companies as events; reported stake changes override direction and size; subsidiaries' go."""
    m = classify_messages(messages)
    if categories:
        m = m.filter(F.col("category").isin(categories))
    ids = map_companies(companies, mapping, primary_only=True).select("company_id", "secid")
    ev = m.join(ids, "company_id").withColumn("size", F.lit(None).cast("double"))
    if trades is not None:
        t = trades.select("event_id", F.col("direction").alias("_d"), F.col("delta_pp").alias("_pp"), "is_subsidiary", "role")
        ev = ev.join(t, "event_id", "left")
        stake = F.col("category") == "insider_stake_change"
        ev = ev.withColumn("direction", F.when(stake, F.coalesce("_d", F.lit(0))).otherwise(F.col("direction"))).withColumn("size", F.when(stake, F.abs("_pp"))).filter(~(stake & F.coalesce("is_subsidiary", F.lit(False)))).drop("_d", "_pp", "is_subsidiary")
    ev = ev.filter("published_at IS NOT NULL AND secid IS NOT NULL")
    return flag_confounders(ev).select("event_id", "secid", "published_at", "category", "direction", "size", "company_id", "has_confounder", *(["role"] if trades is not None else []))
