"""Queries opN_<name> over whole tables, and the SQL of those that SQL can express."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import remove_repeats

    return remove_repeats(common.documents(spark, sf_dir), with_text=False)


def op2_simhash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_dedup

    out = line_dedup(common.documents(spark, sf_dir).select("doc_id", "text"), least=1)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(common.text_or_empty(), 256).alias("kept_sha256"))


def op3_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .gif import gif_store

    return gif_store(common.documents(spark, sf_dir), media=False).drop("n_frames")


def op4_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op5_nearest_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import minhash_groups

    return minhash_groups(common.documents(spark, sf_dir), words=3, percent=85)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chat_digests

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_digests(rows.unionByName(planted))


def op8_spherical_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import embedding_near_dedup

    common.ship(spark)
    return embedding_near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import sentencepiece

    return sentencepiece(common.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), digests=True)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import url_filter

    common.ship(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefixes import bpe

    return bpe(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op12_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codes import product_codes

    return product_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_bit_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .middles import fill_in_middle

    return fill_in_middle(common.documents(spark, sf_dir), digests=True)


QUERIES = {f.__name__: f for f in (op1_difference_cover, op2_simhash_lines, op3_gif, op4_karmarkar_karp, op5_nearest_examples, op6_superminhash, op7_chat, op8_spherical_kmeans, op9_sentencepiece, op10_url_filter, op11_prefixes, op12_hamerly, op13_bit_masks)}


def _lloyd_sql(rounds: int = 6) -> str:
    """Product codes written out round by round."""
    out = [r"""
WITH q AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, q[part * (len(q) // 8) + 1:(part + 1) * (len(q) // 8)] AS x FROM q, range(8) AS r(part)),
b0 AS MATERIALIZED (
  SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 16)"""]
    for r in range(rounds + 1):
        out.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, d * 16 + entry) AS entry, min(d) AS d FROM (
    SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN b{r} AS b USING (part))
  GROUP BY vec_id, part)""")
        if r < rounds:
            out.append(f"""
b{r + 1} AS MATERIALIZED (
  SELECT b.part, coalesce(m.x, b.x) AS x, b.entry FROM b{r} AS b LEFT JOIN (
    SELECT part, entry, list(m ORDER BY i) AS x FROM (
      SELECT part, entry, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m
      FROM p JOIN a{r} USING (vec_id, part), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY part, entry, i)
    GROUP BY part, entry) AS m USING (part, entry))""")
    out.append(f"""
e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
c AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM e JOIN q USING (vec_id), c""")
    return ",".join(out[:-1]) + "," + out[-1]


ORACLE_SQL = {
    "op12_hamerly": _lloyd_sql(),
    "op7_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, coalesce(lag(role) OVER w, '') || '>' || role IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') AS fits, row_number() OVER w - 1 AS pos,
    row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AND role <> 'assistant' AS breaks_off, replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS safe FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, bool_and(coalesce(fits, false)) AND NOT bool_or(breaks_off) AS valid, CAST(coalesce(min(pos) FILTER (WHERE NOT fits), max(pos + 1) FILTER (WHERE breaks_off)) AS INTEGER) AS error_turn,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(9 + length(role) + length(safe) + CASE WHEN role = 'assistant' THEN 4 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op10_url_filter": r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://')
    THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM u),
r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, any_value(host) AS host, any_value(path) AS path,
  arg_max(rh || rp, length(rh || rp)) AS rule, coalesce(arg_max(v, length(rh || rp)), 'allow') AS verdict
FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
GROUP BY page_id""",
    "op13_bit_masks": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
h AS (
  SELECT *, len(units) AS n, CAST('0x' || substr(digest, 1, 8) AS BIGINT) % (len(units) + 1) AS a,
    CAST('0x' || substr(digest, 9, 8) AS BIGINT) % (len(units) + 1) AS b, CAST('0x' || substr(digest, 25, 8) AS BIGINT) % 100 AS way,
    text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain FROM d),
p AS (
  SELECT *, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
    array_to_string(units[greatest(a, b) + 1:], '') AS suffix, CASE WHEN plain THEN 'plain' WHEN way < 50 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
    ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p""",
}
