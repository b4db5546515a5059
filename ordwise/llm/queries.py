"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordwise.llm import chat_format, embedding_neardup, language_id, mixing, quality_classifier, quality_rules, sentencepiece_codec, sharding, simhash_neardup, substring_dedup
from ordwise.llm._shared import spread


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


_SPLIT = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again: n_tokens, a digest of the ids, and whether the text came back."""
    model = sentencepiece_codec.load(sentencepiece_codec.MODEL)
    back = sentencepiece_codec.encode_decode(_read(spark, sf_dir, "documents").select("doc_id", "text"), model)
    ids = F.sha2(F.array_join("tokens", " "), 256)
    same = F.replace(F.col("text"), F.lit("\u2581"), F.lit(" ")) == F.col("decoded")
    return back.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), ids.alias("tokens_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_Q = (25, *quality_rules.CLIMB)


def _levels() -> str:
    """Quantiles for (lang, source), for lang and for all, each with its row count."""
    out, metrics = [], (*quality_rules.METRICS, "length")
    for name, keys in (("g", "lang, source"), ("l", "lang"), ("a", "")):
        part = f"PARTITION BY {keys}" if keys else ""
        ranks = ", ".join(f"row_number() OVER ({part} ORDER BY {m}) AS r_{m}" for m in metrics)
        picks = ", ".join(f"min(CASE WHEN r_{m} >= {q / 100}::DOUBLE * n THEN {m} END) AS {name}_{m}_{q}" for m in metrics for q in _Q)
        by = f"GROUP BY {keys}" if keys else ""
        out.append(f"{name} AS (SELECT {keys + ',' if keys else ''} max(n) AS {name}_n, {picks} FROM (SELECT *, count(*) OVER ({part}) AS n, {ranks} FROM ok) {by})")
    return ", ".join(out)


def _pick(m: str, q: int) -> str:
    n = quality_rules.LEAST_ROWS
    return f"(CASE WHEN g_n >= {n} THEN g_{m}_{q} WHEN l_n >= {n} THEN l_{m}_{q} ELSE a_{m}_{q} END)"


def _tops() -> str:
    """The level of each metric, climbing over the quantiles while they rise steadily."""
    out = []
    for m, (_, more, _) in quality_rules.METRICS.items():
        out.append(f"{_pick(m, quality_rules.CLIMB[0])} AS t0_{m}, true AS s0_{m}")
        for i, q in enumerate(quality_rules.CLIMB[1:]):
            out.append(f"s{i}_{m} AND {_pick(m, q)} <= 3 * t{i}_{m} + {more}::DOUBLE AS s{i + 1}_{m}, CASE WHEN s{i + 1}_{m} THEN {_pick(m, q)} ELSE t{i}_{m} END AS t{i + 1}_{m}")
    return ", ".join(out)


def _inside() -> str:
    iqr, thin = quality_rules.WORD_LENGTH
    parts = [f"abs(length - {_pick('length', 50)}) <= {iqr}::DOUBLE * ({_pick('length', 75)} - {_pick('length', 25)}) + {thin}::DOUBLE / sqrt(n_words)"]
    for m, (count, _, items) in quality_rules.METRICS.items():
        parts.append(f"{count} <= {quality_rules.TIMES}::DOUBLE * t{len(quality_rules.CLIMB) - 1}_{m} * n_words + {items}")
    return " AND ".join(f"({p})" for p in parts)


OP2_SQL = rf"""
WITH w AS (SELECT *, {_SPLIT} AS w, coalesce(text, '') AS t FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
  CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [] END AS five FROM w),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (
  SELECT rid, unnest(range(i, i + 5)) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM
    (SELECT rid, unnest(five) AS k, unnest(range(1, len(five) + 1)) AS i FROM (SELECT row_number() OVER () AS rid, * FROM l))) WHERE c > 1) GROUP BY rid),
c AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM (SELECT row_number() OVER () AS rid, * FROM l) x LEFT JOIN rep USING (rid)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols::DOUBLE / n_words AS symbols,
  n_dup_lines::DOUBLE / n_words AS dup_lines, n_repeat_words::DOUBLE / n_words AS repeats, word_chars::DOUBLE / n_words AS length FROM c),
ok AS (SELECT * FROM m WHERE NOT base_failed), {_levels()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE coalesce({_inside()}, true) END AS kept
FROM (SELECT m.*, g.* EXCLUDE (lang, source), l.* EXCLUDE (lang), a.*, {_tops()} FROM m LEFT JOIN g ON m.lang IS NOT DISTINCT FROM g.lang AND m.source IS NOT DISTINCT FROM g.source
LEFT JOIN ql ON m.lang IS NOT DISTINCT FROM ql.lang LEFT JOIN a ON true)
""".replace(", l AS (SELECT lang,", ", ql AS (SELECT lang,").replace("l.* EXCLUDE (lang)", "ql.* EXCLUDE (lang)")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_read(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SPLIT} AS w FROM documents),
s AS (SELECT rid, doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
k AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM s),
f AS (SELECT rid, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS m FROM k) WHERE m < doc_id),
g AS (SELECT rid, list(DISTINCT p) AS gone FROM (SELECT rid, unnest(range(i, i + 13)) AS p FROM f) GROUP BY rid),
u AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
r AS (SELECT u.rid, count(h.i)::BIGINT AS n_removed, string_agg(CASE WHEN h.i IS NULL THEN u.x END, ' ' ORDER BY u.i) AS kept
  FROM u LEFT JOIN (SELECT rid, unnest(gone) AS i FROM g) h ON u.rid = h.rid AND u.i = h.i GROUP BY u.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (rid)
"""


def op4_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_neardup.near_duplicates(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_neardup.near_duplicates(_read(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
c AS (SELECT x, min(y) AS m FROM r GROUP BY x), n AS (SELECT x, count(*)::BIGINT AS n FROM p GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM v LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.x = vec_id
"""


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = spark.sql("SELECT -1L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    return chat_format.digests(chat_format.format_chats(turns))


def _escaped(x: str) -> str:
    for a, b in chat_format.ESCAPES:
        x = f"replace({x}, '{a}', '{b}')"
    return x


OP6_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  sum(length({_escaped("role")}) + length({_escaped("text")}) + {len(chat_format.OPEN) + 1 + len(chat_format.CLOSE)}) OVER o AS upto
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rest = language_id.remainder(F.col("doc_id"))
    model = language_id.fit(docs.where(rest != 2).select("lang", "text"))
    held = F.coalesce(rest == 2, F.lit(False)).alias("held_out")
    return language_id.predict(docs.select("doc_id", "text", held), model, keep=["doc_id", "held_out"])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.learned(docs, _read(spark, sf_dir, "labels"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False)).alias("held_out")
    scored = quality_classifier.score(docs.select("doc_id", "text", held), model, keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= quality_classifier.THRESHOLD).cast("int").alias("predicted"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH k AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
  ('0x' || substr(coalesce(md5(doc_id::VARCHAR), md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
d AS (SELECT h, n_bytes, unnest(range(0, 61)) AS depth FROM k),
s AS (SELECT depth::INT AS depth, h >> (60 - depth) AS p, sum(n_bytes)::BIGINT AS b FROM d GROUP BY ALL),
f AS (SELECT k.doc_id, k.n_bytes, k.h, s.depth, s.b, row_number() OVER (PARTITION BY k.doc_id, k.h ORDER BY s.b > {sharding.BYTE_LIMIT}, CASE WHEN s.b > {sharding.BYTE_LIMIT} THEN -s.depth ELSE s.depth END) AS i
  FROM (SELECT DISTINCT doc_id, n_bytes, h FROM k) k JOIN s ON s.p = k.h >> (60 - s.depth))
SELECT k.doc_id, k.n_bytes, f.depth, left(lpad(bin(k.h), 60, '0'), f.depth) AS shard, f.b AS shard_bytes
FROM k JOIN f ON f.i = 1 AND k.h = f.h AND k.doc_id IS NOT DISTINCT FROM f.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_sentencepiece, op2_quality_rules, op3_substring_dedup, op4_simhash_neardup, op5_embedding_neardup, op6_chat_format, op7_language_id, op8_mixing, op9_quality_classifier, op10_sharding)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op5_embedding_neardup": OP5_SQL, "op6_chat_format": OP6_SQL, "op10_sharding": OP10_SQL}
