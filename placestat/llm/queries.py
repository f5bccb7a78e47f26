"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placestat.llm.conversations import damage, repair_conversations
from placestat.llm.decontaminate import contaminated_pairs
from placestat.llm.jaccard import jaccard_components
from placestat.llm.langid import label_languages
from placestat.llm.licences import known_licences, scan_licences, scan_sql
from placestat.llm.linededup import drop_repeated_chunks
from placestat.llm.mixing_lm import score_texts
from placestat.llm.mixture import poisson_mixture
from placestat.llm.pseudonyms import pseudonymise
from placestat.llm.quality import adaptive_verdict
from placestat.llm.simhash import simhash_components
from placestat.llm.tokenalign import alignment_statistics
from placestat.llm.toxicity import chain_probabilities


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return adaptive_verdict(docs, keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return label_languages(docs, ~held).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    scored = score_texts(docs, ~held & F.col("doc_id").isNotNull())
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    found = chain_probabilities(table(spark, sf_dir, "documents"), labels, ["low_quality", "toxic"])
    return found.select("doc_id", F.col("p_low_quality"), F.col("p_toxic"), (F.col("p_toxic") >= 0.5).alias("toxic"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"), known_licences(spark))


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, key="placestat demo key").select("doc_id", F.size("found").alias("n_found"), F.array_join("found.kind", ",").alias("kinds"), "text")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_chunks(docs).select("doc_id", "n_chunks_removed", "n_chars_removed", "text")


def op10_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mixture(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "n_copies", "shuffle_key", "text")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair_conversations(damage(rows), rows.select("conv_id"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_statistics(table(spark, sf_dir, "documents"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_id": op4_language_id,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_toxicity_chain": op6_toxicity_chain,
    "op7_licence_scan": op7_licence_scan,
    "op8_line_dedup": op8_line_dedup,
    "op9_pii_pseudonyms": op9_pii_pseudonyms,
    "op10_source_mixture": op10_source_mixture,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_token_alignment": op12_token_alignment,
    "op13_jaccard_join": op13_jaccard_join,
}

#: Features and sketch bins of the quality rules; {docs} is the table they are made from.
QUALITY_CTES = r"""
q_words AS (
  SELECT *, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM {docs}),
q_windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS k
  FROM q_words WHERE len(w) >= 3),
q_hit AS (SELECT doc_id, i FROM q_windows QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
q_rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM q_hit) GROUP BY doc_id),
q_counts AS (
  SELECT d.*, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM q_words d LEFT JOIN q_rep r ON r.doc_id = d.doc_id),
q_feat AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, coalesce('=' || lang, '') AS gl, coalesce('=' || source, '') AS gs,
    [1000 * n_symbols // greatest(word_chars, 1), 1000 * n_dup_lines // greatest(n_lines, 1), 1000 * n_repeat_words // greatest(n_words, 1),
     1000 * word_chars // greatest(n_words, 1), 1000 * n_words // greatest(word_chars, 1)] AS f FROM q_counts),
q_value AS (SELECT gl, gs, unnest([0, 1, 2, 3, 4]) AS feature, unnest(f) AS v FROM q_feat WHERE NOT base_failed),
q_bin AS (
  SELECT gl, gs, feature, CASE WHEN v < 64 THEN v ELSE (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)) END AS b, count(*) AS n FROM q_value GROUP BY ALL),
q_level AS (
  SELECT 0 AS level, gl, gs, feature, b, n FROM q_bin UNION ALL SELECT 1, gl, '', feature, b, sum(n) FROM q_bin GROUP BY gl, feature, b
  UNION ALL SELECT 2, '', '', feature, b, sum(n) FROM q_bin GROUP BY feature, b),
q_seen AS (
  SELECT *, sum(n) OVER (PARTITION BY level, gl, gs, feature ORDER BY b) AS seen, sum(n) OVER (PARTITION BY level, gl, gs, feature) AS texts,
    CASE WHEN b < 64 THEN b ELSE ((b - (b // 32 - 1) * 32 + 1) << (b // 32 - 1)) - 1 END AS top FROM q_level),
q_fence AS (
  SELECT level, gl, gs, feature, max(texts) AS texts,
    max(high) + 3e0 * greatest(max(high) - max(mid), [25, 100, 75, 250, 10][feature + 1]) AS fence
  FROM (SELECT *, min(top) FILTER (10 * seen >= 9 * texts) OVER w AS high, min(top) FILTER (10 * seen >= 5 * texts) OVER w AS mid
    FROM q_seen WINDOW w AS (PARTITION BY level, gl, gs, feature)) GROUP BY level, gl, gs, feature),
q_lang AS (
  SELECT a.gl, a.feature, (a.texts * a.fence + 200 * b.fence) / (a.texts + 200) AS fence
  FROM q_fence a JOIN q_fence b ON b.level = 2 AND b.feature = a.feature WHERE a.level = 1),
q_wide AS (
  SELECT a.gl, a.gs, list((a.texts * a.fence + 200 * b.fence) / (a.texts + 200) ORDER BY a.feature) AS fence
  FROM q_fence a JOIN q_lang b ON b.gl = a.gl AND b.feature = a.feature WHERE a.level = 0 GROUP BY a.gl, a.gs),
q_judged AS (SELECT d.*, w.fence FROM q_feat d LEFT JOIN q_wide w ON w.gl = d.gl AND w.gs = d.gs),
q_kept AS (
  SELECT *, NOT base_failed AND NOT coalesce(f[1] > fence[1] OR f[2] > fence[2] OR f[3] > fence[3] OR f[4] > fence[4] OR f[5] > fence[5], false) AS kept FROM q_judged)
"""

MIXTURE_SQL = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rate AS (SELECT source, sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () / n AS r FROM n),
cdf AS (
  SELECT source, k, sum(exp(-r + k * ln(r) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM rate, range(0, 200) t(k)),
u AS (SELECT *, ('0x' || substr(md5('42|1|' || doc_id), 1, 12))::BIGINT / 281474976710656.0 AS u FROM documents),
drawn AS (SELECT u.doc_id, u.source, u.text, count(*) AS n_copies FROM u JOIN cdf ON cdf.source IS NOT DISTINCT FROM u.source AND cdf.c <= u.u GROUP BY ALL),
spread AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM drawn)
SELECT doc_id, source, copy, n_copies, md5('42:order|' || doc_id || '|' || copy) AS shuffle_key, text FROM spread
"""

ORACLE_SQL: dict[str, str] = {
    "op7_licence_scan": scan_sql(),
    "op10_source_mixture": MIXTURE_SQL,
    "op3_quality_rules": "WITH " + QUALITY_CTES.replace("{docs}", "documents")
    + " SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM q_kept",
}
