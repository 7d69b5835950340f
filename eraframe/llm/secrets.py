"""Secret scans over every version of every file, with a ledger of scanned blobs.

Versions are addressed by the digest of their content. Only pairs of blob and
rule version that the ledger lacks are scanned, so a new rule scans all blobs with that rule
alone; findings belong to blobs and are joined back to all paths that ever held them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, whole_text


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``group`` is the part that must have ``least`` characters.

    ``hint`` lists texts of which one must occur before the pattern is tried.
    """

    kind: str
    version: int
    pattern: str
    least: int = 1
    group: int = 0
    flags: int = 0
    hint: tuple[str, ...] = ()


# The base kinds in their order, then those that the scan adds.
BASE_RULES = (
    Rule(
        "assign",
        1,
        r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        least=8,
        group=2,
        flags=re.IGNORECASE | re.ASCII,
        hint=(":", "="),
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", least=16, hint=("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
ADDED_RULES = (
    Rule(
        "pem",
        1,
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]+(?:-----END [A-Z ]*PRIVATE KEY-----)?",
        hint=("PRIVATE KEY-----",),
    ),
    Rule("userinfo", 1, r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*+://[^\s/@:]+:[^\s/@]+@", hint=("://",)),
)
RULES = BASE_RULES + ADDED_RULES
_SPAN = "struct<kind:string,start:int,end:int>"
_LEDGER_SPAN = "struct<kind:string,start:int,end:int,version:int>"


def find_secrets(text: str, rules: Sequence[Rule]) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) by start, then in the order of the rules."""
    found = []
    for order, rule in enumerate(rules):
        if rule.hint and not any(h in text for h in rule.hint):
            continue
        for match in re.finditer(rule.pattern, text, rule.flags):
            if len(match[rule.group]) >= rule.least:
                found.append((match.start(), order, rule.kind, match.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def rule_id(rule: Rule) -> str:
    """Name of a rule version in the ledger; a changed rule needs a new version."""
    return f"{rule.kind}:{rule.version}"


def with_blob(versions: DataFrame) -> DataFrame:
    return versions.withColumn("blob", F.sha2(whole_text("text"), 256))


def scan_unseen(
    versions: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """New ledger rows (blob, rules, spans): what the ledger lacks of blobs and rule versions.

    ``versions`` needs a ``text`` column. Every distinct text is scanned once, whole, and only by
    the rule versions that the ledger does not have for it. A blob without a finding gets a row
    without spans, so it is not scanned again. Digests meet the ledger first; only texts with
    something left to scan are moved.
    """
    wanted = F.array(*[F.lit(rule_id(r)) for r in rules])
    by_id = {rule_id(r): r for r in rules}
    blobs = with_blob(versions.select("text")).select("blob", whole_text("text").alias("text"))
    if ledger is None:
        left = blobs.dropDuplicates(["blob"]).withColumn("rest", wanted)
    else:
        # A blob has a row per scan that had something to do with it.
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
        rest = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
        unseen = (
            blobs.select("blob")
            .distinct()
            .join(seen, "blob", "left")
            .select("blob", rest.alias("rest"))
            .filter(F.size("rest") > 0)
        )
        left = blobs.join(stored(unseen, "secret-unseen"), "blob").dropDuplicates(["blob"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [
                [
                    {"kind": k, "start": s, "end": e, "version": version[k]}
                    for k, s, e in find_secrets(text, own)
                ]
                for text, own, version in (
                    (text, [by_id[r] for r in rest], {by_id[r].kind: by_id[r].version for r in rest})
                    for text, rest in zip(batch["text"], batch["rest"], strict=True)
                )
            ]
            yield pd.DataFrame({"blob": batch["blob"], "rules": batch["rest"], "spans": spans})

    return left.mapInPandas(scan, f"blob string, rules array<string>, spans array<{_LEDGER_SPAN}>")


def findings_by_path(
    versions: DataFrame,
    ledger: DataFrame,
    rules: Sequence[Rule] = RULES,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Columns ``keep`` of every version with the spans of its blob that ``rules`` have found.

    Null texts count as empty. Repeated paths and texts give a row each.
    """
    order = F.create_map(*[F.lit(x) for n, r in enumerate(rules) for x in (rule_id(r), n)])
    span = F.col("span")
    place = F.try_element_at(order, F.concat_ws(":", span["kind"], span["version"]))
    current = (
        ledger.filter(F.size("spans") > 0)
        .select("blob", F.explode("spans").alias("span"))
        .select("blob", F.struct(span["start"], place.alias("place"), span["kind"], span["end"]).alias("s"))
        .filter("s.place IS NOT NULL")
        .groupBy("blob")
        .agg(F.array_sort(F.collect_list("s")).alias("found"))
    )
    spans = F.transform(
        "found",
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    named = with_blob(versions).select(*keep, "blob")
    return named.join(current, "blob", "left").select(
        *keep,
        "blob",
        F.coalesce(spans, F.from_json(F.lit("[]"), f"array<{_SPAN}>")).alias("spans"),
    )


def scan_versions(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    rules: Sequence[Rule] = RULES,
    keep: Sequence[str] = ("doc_id",),
) -> tuple[DataFrame, DataFrame]:
    """Findings of all versions, and the ledger with what this scan added.

    Pass the returned ledger (or where it was written) to the next scan. No versions
    give no findings.
    """
    added = stored(scan_unseen(versions, ledger, rules), "secret-ledger")
    grown = added if ledger is None else ledger.unionByName(added)
    return findings_by_path(versions, grown, rules, keep), grown
