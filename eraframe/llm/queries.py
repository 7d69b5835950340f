"""The operators applied to whole tables, with the result columns they are held to."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment,
    fingerprints,
    merkle,
    mixing,
    near_dedup,
    packing,
    phrase_index,
    pii,
    quality,
    secrets,
    sql,
    suffix_dedup,
    toxicity,
    url_filter,
)
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"
# Host, path and verdict of the rules that pages are judged by.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def span_text(spans: Column) -> Column:
    """Spans (kind, start, end) as comma-joined kind:start:end."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def span_columns(spans: Column, base: list[str]) -> list[Column]:
    """Counts per base kind, the digest of the base spans, and all spans as text."""
    own = F.filter(spans, lambda s: s["kind"].isin(base))
    kinds = F.transform(spans, lambda s: s["kind"])
    return [
        *[
            (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}")
            for kind in base
        ],
        F.sha2(span_text(own), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
    ]


def fingerprints_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return fingerprints.fingerprint_edits(docs).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.as_text(F.col("own")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def suffix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), with_kept=False)


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds: the second meets the ledger of the first and finds nothing left to scan."""
    docs = read_table(spark, sf_dir, "documents")
    _, ledger = secrets.scan_versions(docs)
    findings, _ = secrets.scan_versions(docs, ledger)
    base = [rule.kind for rule in secrets.BASE_RULES]
    return findings.select("doc_id", *span_columns(F.col("spans"), base))


def url_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), rules)


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents")).drop("times")


def near_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(
        read_table(spark, sf_dir, "documents"),
        near_dedup.Likeness(shingle=3, percent=85, bands=20, rows=4, extra=48),
    )
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, name) for name in ("documents", "labels"))
    return toxicity.learn_and_score(docs, labels)


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_private(read_table(spark, sf_dir, "documents"), everywhere=True)
    return found.select("doc_id", *span_columns(F.col("spans"), list(pii.PATTERNS)))


def leak_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (read_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return phrase_index.contamination(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def manifest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_manifest(read_table(spark, sf_dir, "documents"))


def alignment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.compare_tokens(
        read_table(spark, sf_dir, "documents"),
        public_tokenizers.path(BYTE_TOKENIZER),
        public_tokenizers.path(PIECE_TOKENIZER),
    )


URL_SQL = """
WITH rest AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
         ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), ways AS (
  SELECT host, path, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY host, path
                            ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS n
  FROM (SELECT DISTINCT host, path FROM parts), rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, parts.host, parts.path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM parts LEFT JOIN ways ON ways.host = parts.host AND ways.path = parts.path AND n = 1
"""


def _importable(query: Query) -> Query:
    """Lets local Python workers find this package, wherever the driver was started."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = str(Path(corpus_pipeline.__file__).resolve().parent)
        spark.sparkContext.environment.setdefault("PYTHONPATH", root)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    registered = {
        "op1_fingerprints": fingerprints_query,
        "op2_quality_rules": quality_query,
        "op3_suffix_array_dedup": suffix_query,
        "op4_best_fit_packing": packing_query,
        "op5_secret_scans": secrets_query,
        "op6_url_filters": url_query,
        "op7_minhash_near_dedup": near_dedup_query,
        "op8_source_mixing": mixing_query,
        "op9_toxicity": toxicity_query,
        "op10_pii": pii_query,
        "op11_benchmark_decontamination": leak_query,
        "op12_merkle_manifest": manifest_query,
        "op13_token_alignment": alignment_query,
        "pipeline": corpus_pipeline.run,
    }
    return {name: _importable(query) for name, query in registered.items()}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    known = {
        "op6_url_filters": URL_SQL,
        "op11_benchmark_decontamination": sql.LEAKS,
        "op12_merkle_manifest": sql.MANIFEST,
        "pipeline": corpus_pipeline.ORACLE_SQL,
    }
    return {name: sql for name, sql in known.items() if sql}
