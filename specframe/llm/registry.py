"""The queries of this subpackage, and SQL for those that SQL can express.

Every query runs its operator over the whole table it is meant for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, line_dedup, lm_scoring, near_dedup, perplexity_rules, quality, secrets, token_counts, token_files
from .common import table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and part), read back from the written files."""
    return token_files.read_token_files(token_files.write_token_files(table(spark, sf_dir, "documents")))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score, selected; losses to the sixth decimal."""
    scored = lm_scoring.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumns({c: F.round(c, 6) for c in ("target_loss", "background_loss", "score")})


def op3_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept (and perplexity)."""
    return perplexity_rules.quality_rules(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.digests(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, class_size."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, item_ids, similarity: every document against every benchmark item."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near, kept_sha256."""
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (and n_added)."""
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (and spliced)."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, probabilities and posteriors of quality and toxicity, kept."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_perplexity_rules": op3_perplexity_rules,
    "op4_bpe": op4_bpe,
    "op5_near_dedup": op5_near_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_line_dedup": op7_line_dedup,
    "op8_secrets": op8_secrets,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
}

#: The bigram models of op2 as joins: pairs of symbols, their counts in all and in target documents, and those of each document.
SQL_LM = f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS ws FROM documents),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
tok AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w),
n AS (SELECT word, count(*) AS n FROM tok GROUP BY 1),
sym AS (SELECT doc_id, pos, CASE WHEN n >= {lm_scoring.LEAST} THEN ' ' || word ELSE '?' END AS s FROM tok JOIN n USING (word)),
p AS (SELECT doc_id, coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY pos), '^') AS a, s AS b FROM sym
      UNION ALL SELECT doc_id, arg_max(s, pos), '^' FROM sym GROUP BY 1),
g AS (SELECT p.*, (good.doc_id IS NOT NULL)::BIGINT AS t FROM p LEFT JOIN good USING (doc_id)),
c AS (SELECT a, b, count(*) AS c0, sum(t) AS c1 FROM g GROUP BY 1, 2), f AS (SELECT a, sum(c0) AS f0, sum(c1) AS f1 FROM c GROUP BY 1), l AS (SELECT b, sum(c0) AS l0, sum(c1) AS l1 FROM c GROUP BY 1),
z AS (SELECT (SELECT sum(c0) FROM c) AS z0, (SELECT sum(c1) FROM c) AS z1, (SELECT count(*) FROM n WHERE n >= {lm_scoring.LEAST}) + 2 AS v),
o AS (SELECT doc_id, a, b, t, count(*) AS k, sum(count(*)) OVER (PARTITION BY doc_id, a) AS ka, sum(count(*)) OVER (PARTITION BY doc_id, b) AS kb, sum(count(*)) OVER (PARTITION BY doc_id) AS kn FROM g GROUP BY 1, 2, 3, 4),
x AS (SELECT doc_id, t, k, kn, c0, f0, l0, z0, v, c1 - t * k AS c1, f1 - t * ka AS f1, l1 - t * kb AS l1, z1 - t * kn AS z1 FROM o JOIN c USING (a, b) JOIN f USING (a) JOIN l USING (b), z),
y AS (SELECT *, pow(greatest(f0, 1), {lm_scoring.HEAPS}) AS m0, pow(greatest(f1, 1), {lm_scoring.HEAPS}) AS m1 FROM x),
s AS (SELECT doc_id, any_value(t) AS t, sum(k * -log2((c1 + m1 * (l1 + 1) / (z1 + v)) / (f1 + m1))) / any_value(kn) AS target_loss, sum(k * -log2((c0 + m0 * (l0 + 1) / (z0 + v)) / (f0 + m0))) / any_value(kn) AS background_loss FROM y GROUP BY 1),
h AS (SELECT quantile_disc(target_loss - background_loss, {lm_scoring.SHARE}) AS h FROM s WHERE t = 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_tokens, round(target_loss, 6) AS target_loss, round(background_loss, 6) AS background_loss, round(target_loss - background_loss, 6) AS score,
    CASE WHEN target_loss IS NOT NULL THEN coalesce(target_loss - background_loss <= h, false) END AS selected FROM w LEFT JOIN s USING (doc_id), h"""

SQL: dict[str, str] = {"op2_lm_scoring": SQL_LM}
