from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from eraframe.llm import fingerprints as fp
from eraframe.llm import queries
from tests.conftest import SMALL
from tests.llm.cases import no_documents, odd_documents, odd_rows, small_documents, words


def edited(text: str, following: str) -> str:
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def shingles(text: str) -> set:
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def likeness(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_query_against_full_sets(spark):
    docs = small_documents()
    got = {r.doc_id: r for r in queries.queries()["op1_fingerprints"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    errors = []
    for (doc_id, text), (_, following) in zip(docs, docs[1:] + docs[:1], strict=True):
        row, edit = got[doc_id], edited(text, following)
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        small = len(shingles(text) | shingles(edit)) < fp.K
        near = likeness(text, edit)
        assert row.near_edited == pytest.approx(near, abs=1e-12 if small else 0.25)
        assert row.near_next == pytest.approx(likeness(text, following), abs=0.25)
        errors.append(abs(row.near_edited - near))
    assert sum(errors) / len(errors) < 0.03
    by_text = {}
    for doc_id, text in docs:
        assert by_text.setdefault(text, got[doc_id].fingerprint) == got[doc_id].fingerprint


def test_blocks_do_not_change_the_next_document(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = fp.with_next(docs, lambda text: F.length(text), per_block=7).collect()
    order = small_documents()
    following = {a[0]: b[1] for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert len(found) == len(order)
    assert all(r.next.text == following[r.doc_id] for r in found)


def test_odd_rows(spark):
    rows = fp.fingerprint_edits(odd_documents(spark)).collect()
    texts = sorted(
        ((r[0] is not None, r[0] or 0, r[1] or "") for r in odd_rows())
    )
    want = sorted(
        hashlib.sha256(edited(a[2], b[2]).encode()).hexdigest()
        for a, b in zip(texts, texts[1:] + texts[:1], strict=True)
    )
    assert sorted(r.edited_sha256 for r in rows) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fp.fingerprint_edits(no_documents(spark)).count() == 0


def test_single_document_is_its_own_next(spark):
    one = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    row = fp.fingerprint_edits(one).first()
    assert row.near_next == 1.0


def test_sketches_merge_and_estimate(spark):
    numbers = [" ".join(f"n{i}" for i in range(a, b)) for a, b in ((0, 3000), (1000, 4000))]
    df = spark.createDataFrame([(0, numbers[0]), (0, numbers[1])], "g int, text string").select(
        "g", fp.sketch(F.col("text")).alias("s")
    )
    merged = fp.merge_groups(df, ["g"], "s")
    parts = [r.s for r in df.collect()]
    assert merged.first().s == sorted(set(parts[0] + parts[1]))[: fp.K]
    count = merged.select(fp.distinct_shingles(F.col("s"))).first()[0]
    assert count == pytest.approx(3996, rel=0.3)
    pair = spark.createDataFrame([tuple(parts)], "a array<long>, b array<long>")
    inside, like = pair.select(
        fp.containment(F.col("a"), F.col("b")), fp.resemblance(F.col("a"), F.col("b"))
    ).first()
    assert inside == pytest.approx(2 / 3, abs=0.15) and like == pytest.approx(0.5, abs=0.15)
    both = pair.select(fp.merge(F.col("a"), F.col("b")).alias("m")).first().m
    assert both == merged.first().s
