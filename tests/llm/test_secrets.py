from __future__ import annotations

import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from eraframe.llm import queries, secrets
from tests.conftest import SMALL
from tests.llm.cases import no_documents, odd_documents, odd_rows

# The base kinds as they are stated: kind, pattern, flags, group, least length.
STATED = [
    (
        "assign",
        r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        re.I | re.A,
        2,
        8,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 16),
    ("hex", r"[0-9a-f]+", 0, 0, 32),
]


def stated_spans(text: str | None) -> list[tuple[str, int, int]]:
    found = []
    for nth, (kind, pattern, flags, group, least) in enumerate(STATED):
        for m in re.finditer(pattern, text or "", flags):
            if len(m[group]) >= least:
                found.append((m.start(), nth, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def check(row, text):
    base = stated_spans(text)
    assert row.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
    for kind in ("assign", "access", "hex"):
        assert row[f"n_{kind}"] == sum(b[0] == kind for b in base)
    listed = row.spans.split(",") if row.spans else []
    assert set(joined(base).split(",")) - {""} <= set(listed)


def test_query_against_stated_patterns(spark):
    folder = SMALL.replace("0.001", "0.01")  # the smaller one holds no secret
    text = dict(duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall())
    rows = queries.queries()["op5_secret_scans"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for row in rows:
        check(row, text[row.doc_id])
    assert any(r.spans for r in rows)


def test_patterns_on_hard_texts():
    texts = [
        "Password: 'abcdefgh' PASSWD=short api_key = \"A1+/_.=-x\" apikey:12345678token=secret=12345678",
        "AKIAAKIAZZZZ AKIA123456789012 xAKIAABCDEFGHIJKLM0",
        "0a" * 16 + "g" + "f" * 31 + " " + "0" * 64,
        "tokeK = abcdefghi ſecret=abcdefghi",
        "token" + " " * 5000 + "= " + "x" * 9,
        "é\U0001f600 secret: 日本 abcdefghij",
    ]
    for text in texts:
        assert secrets.find_secrets(text, secrets.BASE_RULES) == stated_spans(text)


def test_added_kinds():
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIE\n-----END RSA PRIVATE KEY-----"
    text = f"{key} and https://me:pass@host/x"
    kinds = [k for k, _, _ in secrets.find_secrets(text, secrets.RULES)]
    assert kinds == ["pem", "userinfo"]


def test_odd_rows(spark):
    findings, ledger = secrets.scan_versions(odd_documents(spark))
    spans = sorted(
        str([(s.kind, s.start, s.end) for s in r.spans if s.kind in ("assign", "access", "hex")])
        for r in findings.collect()
    )
    assert spans == sorted(str(stated_spans(r[1])) for r in odd_rows())
    assert ledger.count() == len({r[1] or "" for r in odd_rows()})
    assert secrets.scan_versions(no_documents(spark))[0].count() == 0


def test_only_unseen_blobs_and_rules_are_scanned(spark):
    first = spark.createDataFrame(
        [("a.env", 1, "token=abcdefgh1"), ("b.txt", 1, "nothing")], "path string, version int, text string"
    )
    later = first.union(
        spark.createDataFrame(
            [("c.env", 2, "token=abcdefgh1"), ("a.env", 2, "AKIA" + "Q" * 16)], first.schema
        )
    )
    keep = ("path", "version")
    _, ledger = secrets.scan_versions(first, keep=keep)
    fresh = secrets.scan_unseen(later, ledger)
    assert [r.blob for r in fresh.collect()] == [
        hashlib.sha256(b"AKIA" + b"Q" * 16).hexdigest()
    ]
    findings, ledger = secrets.scan_versions(later, ledger, keep=keep)
    kinds = {(r.path, r.version): [s.kind for s in r.spans] for r in findings.collect()}
    assert kinds == {
        ("a.env", 1): ["assign"], ("b.txt", 1): [], ("c.env", 2): ["assign"], ("a.env", 2): ["access"],
    }
    assert ledger.count() == 3 and secrets.scan_unseen(later, ledger).count() == 0
    newer = (*secrets.RULES, secrets.Rule("word", 1, "nothing"))
    assert secrets.scan_unseen(later, ledger, newer).count() == 3
    assert ledger.filter(F.size("spans") == 0).count() == 1


def test_a_new_rule_scans_that_rule_only(spark):
    """Old rules are gone from the second scan: it would fail on them."""
    versions = spark.createDataFrame(
        [("a", "token=abcdefgh1 nothing"), ("b", "AKIA" + "Q" * 16), ("c", None)], "path string, text string"
    )
    _, ledger = secrets.scan_versions(versions, keep=["path"])
    word = secrets.Rule("word", 1, "no[a-z]+")
    rules = (*secrets.RULES, word)
    added = secrets.scan_unseen(versions, ledger, rules).collect()
    assert len(added) == 3 and all(r.rules == ["word:1"] for r in added)
    findings, ledger = secrets.scan_versions(versions, ledger, rules, keep=["path"])
    kinds = {r.path: [(s.kind, s.start) for s in r.spans] for r in findings.collect()}
    assert kinds == {"a": [("assign", 0), ("word", 16)], "b": [("access", 0)], "c": []}
    # A new version of a rule replaces the findings of the old one.
    newer = (*secrets.RULES, secrets.Rule("word", 2, "thing"))
    assert [r.rules for r in secrets.scan_unseen(versions, ledger, newer).collect()] == [["word:2"]] * 3
    findings, ledger = secrets.scan_versions(versions, ledger, newer, keep=["path"])
    kinds = {r.path: [(s.kind, s.start) for s in r.spans] for r in findings.collect()}
    assert kinds["a"] == [("assign", 0), ("word", 18)]
    # Going back needs no scan: its findings are still there.
    assert secrets.scan_unseen(versions, ledger, rules).count() == 0
    back = secrets.findings_by_path(versions, ledger, rules, keep=["path"]).collect()
    assert [(s.kind, s.start) for r in back if r.path == "a" for s in r.spans] == [("assign", 0), ("word", 16)]


def test_nothing_left_moves_no_text(spark):
    docs = odd_documents(spark)
    _, ledger = secrets.scan_versions(docs)
    assert secrets.scan_unseen(docs, ledger).count() == 0
    assert secrets.scan_unseen(no_documents(spark), ledger).count() == 0
