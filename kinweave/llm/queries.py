"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom_lm, html_crf, line_dedup, mixing, quality_rules, scaled_sketch, simhash, suffix_dedup, unigram_pieces, url_filter


#: A public SentencePiece model, where this machine has it.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_crf.extract(_pages(spark, sf_dir).select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_documents(spark, sf_dir).select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(_documents(spark, sf_dir), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_sketch.fingerprint_next(_documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "source", F.col("__tokens").alias("n_tokens"), F.round("__weight", 9).alias("weight"), F.round("__exponent", 9).alias("exponent"), F.col("__met").alias("met"), F.col("__copies").cast("long").alias("copies"), F.col("__order").alias("mix_order"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def op7_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_pieces.encode(_documents(spark, sf_dir), MODEL)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("n_near").cast("long").alias("n_near"), "component_id")


#: (verdict, host, path prefix)
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_pages(spark, sf_dir), URL_RULES)


def op10_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(_documents(spark, sf_dir))


def base_of_op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that do not come from its model."""
    return op6_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_of_op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of op9, and the verdict where a rule gives it."""
    return op9_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("by_rule"))


def base_of_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that come from exact counts."""
    return op10_bloom_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: v for k, v in globals().items() if k.startswith(("op", "base_of_op")) and callable(v)}
    import corpus_pipeline

    return own | {"pipeline": corpus_pipeline.run}


OP2_SQL = r"""
WITH lines AS (
  SELECT d.rowid_ AS r, d.doc_id, u.pos, d.parts[u.pos] AS line
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(range(1, len(d.parts) + 1)) AS pos) u
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
)
SELECT k.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(f.key) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN k.line END, chr(10) ORDER BY k.pos), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON k.key = f.key GROUP BY k.r, k.doc_id
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BASE6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
w AS (SELECT r, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM words),
tri AS (SELECT r, pos, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY pos)),
twice AS (SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT pos + k) AS n FROM twice, range(3) t(k) GROUP BY r),
lines AS (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line),
dup AS (SELECT r, sum(n - 1) AS n FROM lines GROUP BY r),
out AS (SELECT d.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum([length(x) for x in ws]), 0) AS BIGINT) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words FROM d JOIN words USING (r) LEFT JOIN dup USING (r) LEFT JOIN repeated USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM out
"""

BASE9_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, h, p) AS (VALUES {", ".join(map(repr, URL_RULES))}),
fit AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS by_rule FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT s.page_id, host, path, rule, by_rule FROM s LEFT JOIN fit USING (page_id)
"""


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


BASE10_SQL = f"""
WITH t AS (SELECT {_crc_table()} AS crc),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
  xor(list_reduce(list_concat([4294967295], [CAST(ascii(x) AS BIGINT) for x in string_split(CAST(coalesce(CAST(doc_id AS VARCHAR), '') AS VARCHAR), '')]), lambda c, x: xor(crc[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 7 = 2 AS held_out FROM documents, t),
tokens AS (SELECT r, held_out, unnest(list_append(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+'), ' ')) AS token FROM d),
counts AS (SELECT token, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY token),
total AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM counts),
scored AS (SELECT r, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) AS base_score FROM tokens LEFT JOIN counts USING (token), total GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, (SELECT n FROM total) AS train_tokens, round(base_score, 4) AS base_score FROM d JOIN scored USING (r)
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {"op2_line_dedup": OP2_SQL, "base_of_op6": BASE6_SQL, "base_of_op9": BASE9_SQL, "base_of_op10": BASE10_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {k: v for k, v in found.items() if v}
