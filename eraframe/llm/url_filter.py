"""Allow and block rules for URLs, found by hashed host and path expressions.

Each URL is expanded into the host suffixes and path prefixes that a rule could
name. Short hash prefixes are the join key, the full digest confirms a hit, and
the most specific rule decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

_PREFIX_DIGITS = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def hashed_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their digests; rules with a null are left out."""
    text = F.concat("host", "path")
    return rules.dropna(subset=["host", "path", "verdict"]).select(
        text.alias("rule"),
        F.col("verdict").alias("rule_verdict"),
        F.length("host").alias("rule_host_length"),
        F.length("path").alias("rule_path_length"),
        F.size(F.split("host", r"\.")).alias("rule_labels"),
        F.sha2(text, 256).alias("rule_digest"),
        F.substring(F.sha2(text, 256), 1, _PREFIX_DIGITS).alias("hash_prefix"),
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    keep: Sequence[str] = ("page_id",),
    default: str = "allow",
) -> DataFrame:
    """Columns ``keep`` of every page with host, path, rule and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's
    path. The longest rule wins (host and path together, then the longer host);
    of equal rules with both verdicts, block wins. Without a rule the verdict is
    ``default``; null, empty and malformed URLs have an empty host and path and so
    no rule. Repeated pages give repeated rows. No pages give no rows; without
    rules every page gets the default.

    Every distinct host and path is expanded once, into the shapes (number of
    labels, length of path) that the rules have, and hits are few, so the join
    carries short rows only. Rules are a table of any size.
    """
    host, path = url_parts(F.col(url))
    parsed = pages.select(*keep, host.alias("host"), path.alias("path"))
    hashed = hashed_rules(rules)
    shapes = sorted(
        (row.rule_labels, row.rule_path_length)
        for row in hashed.select("rule_labels", "rule_path_length").distinct().collect()
    )
    if not shapes:
        return parsed.withColumns(
            {"rule": F.lit(None).cast("string"), "verdict": F.lit(default)}
        )
    labels = F.size(F.split("host", r"\."))
    expressions = F.array(
        *[
            F.when(
                (labels >= n) & (F.length("path") >= size),
                F.concat(
                    F.substring_index("host", ".", -n),
                    F.substring(F.col("path"), 1, size),
                ),
            )
            for n, size in shapes
        ]
    )
    expanded = (
        parsed.select("host", "path")
        .distinct()
        .select("host", "path", F.explode(F.array_compact(expressions)).alias("expression"))
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("hash_prefix", F.substring("digest", 1, _PREFIX_DIGITS))
    )
    hits = expanded.join(hashed, "hash_prefix").filter(F.col("digest") == F.col("rule_digest"))
    best = hits.groupBy("host", "path").agg(
        F.max(
            F.struct(
                (F.col("rule_host_length") + F.col("rule_path_length")).alias("length"),
                "rule_host_length",
                F.col("rule_verdict").alias("verdict"),
                "rule",
            )
        ).alias("best")
    )
    return parsed.join(best, ["host", "path"], "left").select(
        *keep,
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
