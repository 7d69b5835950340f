from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from eraframe.llm import queries, quality
from tests.conftest import SMALL
from tests.llm.cases import no_documents, odd_documents, odd_rows, small_documents, words


def counts(text: str | None) -> tuple:
    w, text = words(text), text or ""
    runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {
        j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)
    }
    seen, again = set(), 0
    for line in text.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    symbols = sum(c in quality.SYMBOLS for c in text)
    return len(w), sum(map(len, w)), symbols, again, len(repeated), failed


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_counts_of_the_query(spark):
    got = {r.doc_id: r for r in queries.queries()["op2_quality_rules"](spark, SMALL).collect()}
    for doc_id, text in small_documents():
        assert tuple(got[doc_id][c] for c in COLUMNS) == counts(text)
        assert not (got[doc_id].base_failed and got[doc_id].kept)


def test_odd_rows(spark):
    got = quality.judge_quality(odd_documents(spark)).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == sorted(
        counts(r[1]) for r in odd_rows()
    )
    assert quality.judge_quality(no_documents(spark)).count() == 0
    docs = odd_documents(spark)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in got)


def _vectors(rng, n, junk):
    """Correlated inliers, and a cluster of outliers that would drag plain moments."""
    spread = np.array([[0.04, 0.01, 0, 0], [0.01, 0.03, 0, 0], [0, 0, 0.01, 0], [0, 0, 0, 0.02]])
    good = rng.multivariate_normal([1.7, 0.3, 0.2, 0.2], spread, n)
    bad = rng.normal([2.6, 1.8, 0.8, 0.7], 0.05, (junk, 4))
    return np.concatenate([good, bad])


def test_robust_moments_against_numpy(spark):
    """The same start and concentration steps, with exact order statistics."""
    rng = np.random.default_rng(3)
    x = _vectors(rng, 400, 80)
    rows = spark.createDataFrame(
        [(*map(float, r), "en", "s") for r in x],
        ", ".join(f"{n} double" for n in quality.NAMES) + ", lang string, source string",
    )
    got = quality.robust_moments(rows).first()
    floor = np.array([quality.SPREAD[n] for n in quality.NAMES])
    d = (((x - np.median(x, axis=0)) / floor) ** 2).sum(axis=1)
    for _ in range(quality.STEPS):
        near = x[np.argsort(d)[: int(np.ceil(quality.SHARE * len(x)))]]
        mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) + np.diag(floor**2)
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    assert [got[f"m_{n}"] for n in quality.NAMES] == pytest.approx(mean, abs=0.02)
    low = np.linalg.cholesky(cov)
    for i in range(4):
        for j in range(i + 1):
            assert got[f"c_{i}_{j}"] == pytest.approx(low[i, j], abs=0.02)


def test_a_cluster_of_junk_is_rejected_and_the_rest_stays(spark):
    rng = np.random.default_rng(5)
    plain = [" ".join(rng.choice(["stone", "river", "cloud", "and", "the", "of"]) + str(rng.integers(10**6)) for _ in range(200)) for _ in range(60)]
    junk = [" ".join(f"{w}#$%&" for w in t.split()) for t in plain[:12]]
    docs = spark.createDataFrame(
        [(i, t, "en", "s") for i, t in enumerate(plain + junk)],
        "doc_id long, text string, lang string, source string",
    )
    kept = {r.doc_id for r in quality.judge_quality(docs).filter("kept").collect()}
    assert kept == set(range(60))


def test_each_statistic_alone_rejects(spark):
    rng = np.random.default_rng(7)
    new = lambda n: [f"word{rng.integers(10**9):09d}" for _ in range(n)]
    lines = lambda w: "\n".join(" ".join(w[i : i + 20]) for i in range(0, len(w), 20))
    plain = [lines(new(2_000)) for _ in range(40)]
    long_words = lines([w * 2 for w in new(2_000)])
    symbols = lines([w + "#" if i % 3 == 0 else w for i, w in enumerate(new(2_000))])
    again = lines(new(2_000)) + "\nsame" * 100
    part = new(490)
    repeats = " ".join([*part, *new(1_020), *part])
    texts = [*plain, long_words, symbols, again, repeats]
    docs = spark.createDataFrame(
        [(i, t, "en", "s") for i, t in enumerate(texts)],
        "doc_id long, text string, lang string, source string",
    )
    rows = quality.judge_quality(docs).collect()
    assert not any(r.base_failed for r in rows)
    assert {r.doc_id for r in rows if r.kept} == set(range(40))
