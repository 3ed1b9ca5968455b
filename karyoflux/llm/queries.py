"""The registered queries of the operators, thin over them, and their SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karyoflux.llm import audio, bpe, chat, exact_dedup, filter_audit, langid, lattice, mixing, pii, quality, simhash, urls, whitening
from karyoflux.llm.common import remainder, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary file; KARYOFLUX_TOKENIZERS names another folder."""
    folder = os.environ.get("KARYOFLUX_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation; its JSON as length and digest."""
    chats = chat.format_chats(table(spark, sf_dir, "conversations"), chat.TURN_SCHEMAS)
    return chats.select("conv_id", "n_calls", "n_linked", "n_invalid", "n_cyclic", "n_orphans", F.length("chat").cast("long").alias("chat_chars"), F.sha2("chat", 256).alias("chat_sha256"))


def op3_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.telephone(table(spark, sf_dir, "documents"))


def op4_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) == 2, tokenizer_path())


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(mixing.slim_rows(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being good by both views and by their combination, and whether it is kept."""
    kept = quality.features(table(spark, sf_dir, "documents"))
    views = quality.train(kept, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")))
    return quality.score(kept, views).withColumn("kept", F.col("score") >= 0.5)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), keep=("doc_id",))
    return coded.select("doc_id", F.expr("cast(length(ids_le) div 4 as long)").alias("n_tokens"), F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: (host, path, verdict) of the rules that op12_url_filter applies.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by the rules, else by a list of canonical URLs: those of pages whose document (the number in the path) is labelled toxic."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    toxic = labels.where("toxic = 1").select(F.col("doc_id").alias("number")).distinct()
    number = F.try_to_number(F.regexp_extract(urls.path_of(F.col("url")), "/([0-9]{1,18})", 1), F.lit("9" * 18)).cast("long")
    blocked = pages.select("url", number.alias("number")).join(toxic, "number").select("url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(pages, rules, blocked).select("page_id", "host", "path", "rule", "verdict")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"))


OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, CAST(source AS BLOB)) AS source_rank FROM s0),
s2 AS (SELECT *, CAST(CASE (source_rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
         CAST(source_size * 3 AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (SELECT arg_min(level, (cap / weight, source_rank)) AS level FROM s3 WHERE level * weight <= cap),
s AS (SELECT source, source_size, source_rank, coalesce(least(cap, s4.level * weight), cap) AS target FROM s3, s4),
q AS (SELECT d.doc_id, d.size, s.source_size, s.source_rank, s.target, d.key,
        sum(d.size) OVER (PARTITION BY s.source_rank ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS served
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
t AS (SELECT q.*, CAST(e * source_size + served AS DOUBLE) / target AS finish FROM q, (VALUES (0), (1), (2)) v(e) WHERE size > 0 AND target > 0),
r AS (SELECT doc_id, size, source_rank, served, sum(size) OVER (ORDER BY finish, source_rank ROWS UNBOUNDED PRECEDING) AS running FROM t),
k AS (SELECT source_rank, served, CAST(count(*) AS BIGINT) AS times FROM r WHERE running <= (SELECT sum(size) FROM d) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(k.times, 0) AS BIGINT) AS taken
FROM q LEFT JOIN k ON q.source_rank = k.source_rank AND q.served = k.served AND q.size > 0
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS flat FROM documents),
g AS (SELECT *, sha256(flat) AS text_sha256, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY flat) AS group_size,
        row_number() OVER w AS place
      FROM d WINDOW w AS (PARTITION BY flat ORDER BY n DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g
"""

OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, CAST(bool_or(quality = 1) AS INT) AS good, CAST(bool_or(toxic = 1) AS INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT t.doc_id, part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
        len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
        100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
        coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) AS e
      FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
m AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
        || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
      FROM d GROUP BY ALL),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INT) AS step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS before FROM o, range(1, 6) r(step)),
k AS (SELECT part, filter_order, step, x,
        sum(n) FILTER (WHERE translate(fails, before || x, '') = fails) AS kept,
        sum(n) FILTER (WHERE contains(fails, x) AND translate(fails, before, '') = fails) AS removed,
        sum(n) FILTER (WHERE contains(fails, x) AND translate(fails, before, '') <> fails) AS redundant,
        sum(n) FILTER (WHERE fails = x) AS unique_fails,
        sum(good) FILTER (WHERE contains(fails, x) AND translate(fails, before, '') = fails) AS good_lost,
        sum(toxic) FILTER (WHERE contains(fails, x) AND translate(fails, before, '') = fails) AS toxic_lost
      FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, x), 0) AS BIGINT) AS shapley
FROM k
"""

OP12_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
             list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1), '&'),
               lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|gclid|fbclid|ref)(=|\z)'))) AS params
           FROM pages),
c AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)\z', '') || rtrim(path, '/')
             || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical,
             TRY_CAST(regexp_extract(path, '/([0-9]{1,18})', 1) AS BIGINT) AS number FROM p),
b AS (SELECT DISTINCT canonical FROM c WHERE number IN (SELECT doc_id FROM labels WHERE toxic = 1)),
r(h, q, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path,
  (SELECT arg_max(h || q, length(h || q)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)) AS rule,
  coalesce((SELECT arg_max(v, length(h || q)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)),
    CASE WHEN canonical IN (SELECT canonical FROM b WHERE canonical IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict
FROM c
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_chat": op2_chat,
        "op3_audio": op3_audio,
        "op4_lattice": op4_lattice,
        "op5_pii": op5_pii,
        "op6_mixing": op6_mixing,
        "op7_language_id": op7_language_id,
        "op8_quality": op8_quality,
        "op9_bpe": op9_bpe,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_filter_audit": op11_filter_audit,
        "op12_url_filter": op12_url_filter,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": OP6_SQL, "op10_exact_dedup": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_url_filter": OP12_SQL}
