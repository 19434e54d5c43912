"""The registered corpus queries ``opN_<name>`` and the SQL that states them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import bpe, chat, langid, merkle, mixing, neardup, packing, periodic, quality, rules, sharding, topk, toxicity
from tapeline.llm.common import table


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def token_ids() -> packing.Ids:
    return packing.Ids(public("byte_bpe_50k.json"), public("byte_bpe_50k.tiktoken"), pattern())


def fold(parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null without an id."""
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % parts


def _held_out(parts: int, part: int) -> Column:
    return F.coalesce(fold(parts) == part, F.lit(False))


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0, 10)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), bpe.ByteBpe.from_file(public("byte_bpe_50k.tiktoken"), pattern()))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), token_ids())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(3) != 1)
    return scored.select("doc_id", _held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.formatted_digest(rows.unionByName(extra), chat.Formatter(public("byte_bpe_50k.json"), public("byte_bpe_50k.tiktoken"), pattern()))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(5) != 0)
    return scored.select("doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.predict(table(spark, sf_dir, "documents"), fold(3) != 1)
    return found.select("doc_id", _held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second document (by the checksum of its id) is read again without line ends: its proof must not lead to the root unless it has none."""
    docs = table(spark, sf_dir, "documents")
    return merkle.digest(docs, F.when(fold(2) == 0, F.translate("text", "\n", "")))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(table(spark, sf_dir, "documents"), periodic.planted)


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), F.col("rank") % 3 + 1)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_topk, op2_bpe, op3_packing, op4_toxicity, op5_chat, op6_neardup, op7_quality, op8_langid, op9_rules, op10_sharding, op11_merkle, op12_periodic, op13_mixing)
}

#: Unsigned CRC-32 of the decimal id, in DuckDB SQL.
_CRC_OF_ID = """xor(list_reduce(flatten(list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda b: [('0x' || b)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
      lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295), 4294967295)"""

#: What SQL states in whole: exact top-k, conversations read back, near-duplicate groups by all pairs, the adaptive rules with their
#: sketches, the shards' order, the hash trees and the mix. The others are held against brute force or held-out labels in tests/llm.
ORACLE = {
    "op1_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE))::DOUBLE[] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op5_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'
), f AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|###|</turn>')) AS text_chars,
    length(role) + len(regexp_extract_all(role, '\\|###|</turn>|:|\n')) + CASE WHEN regexp_full_match(role, '[\x00-\x7F]*') AND role = lower(role) AND role <> upper(role) THEN 0 ELSE 1 END AS role_chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### : </turn>') + 1 + role_chars + text_chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
""",
    "op6_neardup": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [ws] ELSE list_transform(range(1, len(ws) - 1), lambda i: list_slice(ws, i, i + 2)) END) AS sh FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)
), g AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), reach AS (
  SELECT x, y FROM g UNION SELECT r.x, g.y FROM reach r JOIN g ON r.y = g.x
), c AS (
  SELECT x, min(y) AS y FROM reach GROUP BY 1
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, c.y) AS component_id, w.doc_id = least(w.doc_id, c.y) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.x = w.doc_id
""",
    "op9_rules": f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d
), win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS times FROM (SELECT rid, i, list_slice(ws, i, i + 7) AS g FROM w, unnest(range(1, len(ws) - 6)) t(i))
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM win, unnest(range(0, 8)) t(k) WHERE times > 1 GROUP BY 1
), b AS (
  SELECT w.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[{rules.SYMBOLS}]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_capitals, len(ls) AS n_lines
  FROM w LEFT JOIN rep ON rep.rid = w.rid
), m AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b
), v AS (
  SELECT rid, lang, source, unnest([0, 1, 2, 3, 4]) AS stat,
    unnest([1000000 * n_symbols // greatest(word_chars, 1), 1000000 * n_capitals // greatest(word_chars, 1), 1000000 * n_repeat_words // greatest(n_words, 1),
      1000000 * n_dup_lines // greatest(n_lines, 1), 1000 * word_chars // greatest(n_words, 1)]) AS x
  FROM m WHERE NOT base_failed
), k AS (
  SELECT lang, source, stat, x - x % (1::BIGINT << CAST(greatest(length(bin(x)) - 6, 0) AS INTEGER)) AS bucket, CAST(count(*) AS HUGEINT) AS n FROM v GROUP BY ALL
), k1 AS (SELECT lang, stat, bucket, sum(n)::HUGEINT AS n FROM k GROUP BY ALL), k0 AS (SELECT stat, bucket, sum(n)::HUGEINT AS n FROM k GROUP BY ALL),
a1 AS (SELECT lang, stat, sum(n)::HUGEINT AS n FROM k GROUP BY ALL), a0 AS (SELECT stat, sum(n)::HUGEINT AS n FROM k GROUP BY ALL),
par(stat, p, spreads, low_too) AS (VALUES {", ".join(f"({i}, {p}, {c}, {'true' if side == 'both' else 'false'})" for i, (_, p, c, side) in enumerate(rules.STATS))}),
z AS (
  SELECT g.lang, g.source, g.stat, k0.bucket, coalesce(k.n, 0) * a0.n * (a1.n + {rules.PRIOR}) + {rules.PRIOR} * (coalesce(k1.n, 0) * a0.n + {rules.PRIOR} * k0.n) AS weight
  FROM (SELECT DISTINCT lang, source, stat FROM k) g JOIN a1 USING (lang, stat) JOIN a0 USING (stat) JOIN k0 USING (stat)
    LEFT JOIN k1 ON k1.lang = g.lang AND k1.stat = g.stat AND k1.bucket = k0.bucket LEFT JOIN k ON k.lang = g.lang AND k.source = g.source AND k.stat = g.stat AND k.bucket = k0.bucket
), run AS (
  SELECT *, sum(weight) OVER (PARTITION BY lang, source, stat ORDER BY bucket) AS upto, sum(weight) OVER (PARTITION BY lang, source, stat) AS every FROM z
), q AS (
  SELECT lang, source, stat, any_value(spreads) AS spreads, any_value(low_too) AS low_too, min(bucket) FILTER (1000 * upto >= (1000 - p) * every) AS lo, min(bucket) FILTER (1000 * upto >= 500 * every) AS med,
    min(bucket) FILTER (1000 * upto >= p * every) AS hi FROM run JOIN par USING (stat) GROUP BY ALL
), z1 AS (
  SELECT a1.lang, a1.stat, k0.bucket, sum(coalesce(k1.n, 0) * a0.n + {rules.PRIOR} * k0.n) OVER (PARTITION BY a1.lang, a1.stat ORDER BY k0.bucket) AS upto
  FROM a1 JOIN a0 USING (stat) JOIN k0 USING (stat) LEFT JOIN k1 ON k1.lang = a1.lang AND k1.stat = a1.stat AND k1.bucket = k0.bucket
), z2 AS (
  SELECT lang, stat, max(upto) AS whole, min(upto) FILTER (1000 * upto >= p * whole1) AS tail FROM (SELECT *, max(upto) OVER (PARTITION BY lang, stat) AS whole1 FROM z1) JOIN par USING (stat) GROUP BY ALL
), far AS (
  SELECT lang, stat, min(bucket) FILTER (upto > tail AND 2 * upto >= tail + whole) AS beyond FROM z1 JOIN z2 USING (lang, stat) GROUP BY ALL
), f AS (
  SELECT lang, source, stat, CASE WHEN low_too THEN lo - spreads * (med - lo) ELSE -1 END AS low,
    top + CASE WHEN top > med THEN spreads * (top - med) ELSE coalesce(greatest(beyond - top, 0) // {rules.FLAT}, 0) END AS high
  FROM (SELECT *, hi + (1::BIGINT << CAST(greatest(length(bin(hi)) - 6, 0) AS INTEGER)) - 1 AS top FROM q) JOIN far USING (lang, stat)
), bad AS (
  SELECT DISTINCT rid FROM v JOIN f USING (lang, source, stat) WHERE NOT x BETWEEN low AND high
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept FROM m
""",
    "op10_sharding": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce('=' || source, '') AS source, hex(encode(coalesce(text, ''))) AS bytes FROM documents
), r AS (
  SELECT doc_id, source, CAST(length(bytes) // 2 + 1 AS BIGINT) AS size, substr(md5('1:' || t), 1, 16) AS draw,
    xor(list_reduce(flatten(list_transform(regexp_extract_all(bytes, '..'), lambda b: [('0x' || b)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
      lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295), 4294967295) AS text_crc32
  FROM d
), f AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY draw, doc_id NULLS FIRST, text_crc32, size) - 1) / (2 * count(*) OVER (PARTITION BY source)) AS fraction FROM r
), p AS (
  SELECT *, row_number() OVER (ORDER BY fraction, draw, source, doc_id NULLS FIRST, text_crc32, size) - 1 AS place, count(*) OVER () AS total FROM f
), s AS (
  SELECT *, place * 8 // total AS shard FROM p
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(place - (shard * total + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
""",
    "op11_merkle": """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS key, head, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, replace(text, chr(10), '') AS t,
    CRC % 2 = 0 AS changed
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM documents)
), lv AS (
  SELECT key, 0 AS k, list(leaf ORDER BY doc_id NULLS FIRST, leaf) AS ns FROM d GROUP BY key
  UNION ALL SELECT key, k + 1, list_transform(range(0, len(ns), 3), lambda i: sha256(array_to_string(list_slice(ns, i + 1, i + 3), ''))) FROM lv WHERE len(ns) > 1
), sub AS (
  SELECT key, ns[1] AS subroot, row_number() OVER (ORDER BY key) - 1 AS spot FROM lv WHERE len(ns) = 1
), up AS (
  SELECT 0 AS k, list(subroot ORDER BY key) AS ns FROM sub
  UNION ALL SELECT k + 1, list_transform(range(0, len(ns), 3), lambda i: sha256(array_to_string(list_slice(ns, i + 1, i + 3), ''))) FROM up WHERE len(ns) > 1
), n AS (
  SELECT rid, key, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot FROM d
), s AS (
  SELECT rid, k, ns, spot // CAST(3 ** k AS BIGINT) AS spot FROM n JOIN lv USING (key) WHERE len(ns) > 1
  UNION ALL SELECT rid, 1000 + k, up.ns, sub.spot // CAST(3 ** k AS BIGINT) FROM n JOIN sub USING (key), up WHERE len(up.ns) > 1
), p AS (
  SELECT rid, list(array_to_string(list_slice(ns, spot // 3 * 3 + 1, spot), '') || '|' || array_to_string(list_slice(ns, spot + 2, spot // 3 * 3 + 3), '') ORDER BY k) AS steps FROM s GROUP BY rid
), f AS (
  SELECT d.*, subroot, (SELECT ns[1] FROM up WHERE len(ns) = 1) AS root, coalesce(steps, []) AS steps, CASE WHEN changed AND t IS NOT NULL THEN sha256(head || strlen(t) || ':' || t) ELSE leaf END AS shown
  FROM d JOIN sub USING (key) LEFT JOIN p USING (rid)
), r AS (
  SELECT *, list_reduce(steps, lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2)), shown) AS folded_root FROM f
)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM r
""".replace("CRC", _CRC_OF_ID),
    "op13_mixing": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, coalesce('=' || source, '>') AS key,
    ('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, '')), 1, 13))::BIGINT AS draw
  FROM documents
), s AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS total, (row_number() OVER (ORDER BY key) - 1) % 3 + 1 AS weight FROM d GROUP BY key
), l AS (
  SELECT key, total, weight, (sum(total) OVER () - coalesce(sum(3 * total) OVER (ORDER BY total / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY total / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), t AS (
  SELECT key, total, CAST(least(3 * total, weight * (SELECT level FROM l WHERE weight * level <= 3 * total ORDER BY total / weight, key LIMIT 1)) AS DOUBLE) AS target FROM l
), e AS (
  SELECT d.*, total, target, CAST(floor(x) AS BIGINT) AS copies, x - floor(x) AS p, (draw + 0.5::DOUBLE) / 4503599627370496 AS u
  FROM d JOIN t USING (key), LATERAL (SELECT CASE WHEN total > 0 THEN target / total ELSE 0 END AS x)
), o AS (
  SELECT *, CASE WHEN p > 0 AND size > 0 THEN row_number() OVER (PARTITION BY key, p > 0 AND size > 0 ORDER BY u / (1 - u) * ((1 - p) / p), doc_id NULLS FIRST, size) END AS i FROM e
), fold AS (
  SELECT key, 0::BIGINT AS i, any_value(target) - sum(copies * size)::DOUBLE AS room, any_value(target) * {mixing.NEAR} AS slack, false AS took FROM e GROUP BY key
  UNION ALL SELECT fold.key, o.i, CASE WHEN size <= room AND room > slack THEN room - size ELSE room END, slack, size <= room AND room > slack FROM fold JOIN o ON o.key = fold.key AND o.i = fold.i + 1
)
SELECT doc_id, size, total AS source_size, target, (copies + CASE WHEN took THEN 1 ELSE 0 END) * size AS taken FROM o LEFT JOIN fold ON fold.key = o.key AND fold.i = o.i AND o.i IS NOT NULL
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


__all__ = ["fold", "oracle_sql", "queries", "table", "token_ids"]
