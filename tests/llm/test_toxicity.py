from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest

from eraframe.llm import queries, toxicity
from tests.conftest import SMALL
from tests.llm.cases import no_documents, odd_documents, small_documents


def test_marginals_against_all_labelings():
    rng = np.random.default_rng(2)
    emission, start, moves = rng.normal(size=(3, 6)), rng.normal(size=2), rng.normal(size=(2, 2))
    got, pairs = toxicity.marginals(emission, start, moves)
    all_pairs = np.zeros((2, 2))
    for n in range(3):
        total, toxic, pair = 0.0, np.zeros(6), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=6):
            score = start[y[0]] + sum(emission[n, t] for t in range(6) if y[t])
            score += sum(moves[a, b] for a, b in zip(y, y[1:], strict=False))
            weight = np.exp(score)
            total += weight
            toxic += weight * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                pair[a, b] += weight
        assert got[n] == pytest.approx(toxic / total)
        all_pairs += pair / total
    assert pairs == pytest.approx(all_pairs)


@pytest.mark.parametrize("steps", [1, 3, 32])
def test_texts_are_chains_over_all_their_words(monkeypatch, steps):
    """Messages cross rows: texts of many rows against the same texts word after word."""
    monkeypatch.setattr(toxicity, "STEPS", steps)
    rng = np.random.default_rng(5)
    sizes = np.array([0, 1, 7, 3, 0, 200, 6, 33])
    emission, start, moves = rng.normal(size=sizes.sum()) * 3, rng.normal(size=2), rng.normal(size=(2, 2)) * 2
    got, pairs = toxicity.text_marginals(emission, np.cumsum(sizes), start, moves)
    move, want, want_pairs, begin = np.exp(moves), [], np.zeros((2, 2)), 0
    for size in sizes:
        lift = np.exp(np.stack([np.zeros(size), emission[begin : begin + size]], axis=1))
        begin += size
        ahead, after = [], [np.ones(2)]
        for t in range(size):
            a = (ahead[-1] @ move if t else np.exp(start)) * lift[t]
            ahead.append(a / a.sum())
        for t in range(size - 1, 0, -1):
            joint = ahead[t - 1][:, None] * move * (lift[t] * after[-1])[None]
            want_pairs += joint / joint.sum()
            b = move @ (lift[t] * after[-1])
            after.append(b / b.sum())
        want += [(a * b)[1] / (a * b).sum() for a, b in zip(ahead, after[::-1], strict=bool(size))]
    assert got == pytest.approx(np.array(want)) and pairs == pytest.approx(want_pairs)


def test_training_rows_are_bounded_in_number_and_size(spark):
    docs = spark.createDataFrame([(i, "x" * (50 + i)) for i in range(100)], "doc_id long, text string")
    docs = docs.unionByName(spark.createDataFrame([(100, "y" * 9_000)], docs.schema))
    labels = spark.createDataFrame([(i, i % 2) for i in range(101)], "doc_id long, toxic int")
    size = lambda rows: sum(len(r.text) for r in rows)
    every = toxicity.training_rows(docs, labels).collect()
    assert len(every) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(101))
    assert len(toxicity.training_rows(docs, labels, sample=20).collect()) == 20
    some = toxicity.training_rows(docs, labels, chars=2_000).collect()
    assert 1_500 < size(some) <= 2_000 and all(r.text[0] == "x" for r in some)


def made_documents(n, seed):
    """Plain texts, some with offending words or words that begin like them."""
    rng = np.random.default_rng(seed)
    plain = [f"{a}{b}" for a in ("ra", "lo", "mi", "ten") for b in ("ven", "sil", "dor", "ka", "po")]
    bad = ["zorgle", "krankhof", "blerg"]
    rows = []
    for i in range(n):
        words = list(rng.choice(plain, rng.integers(20, 120)))
        toxic = int(rng.random() < 0.25)
        for _ in range(3 * toxic):
            word = str(rng.choice(bad)) + str(rng.choice(["", "en", "isch", "."]))
            words.insert(int(rng.integers(len(words))), word)
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_documents_and_their_places(spark):
    rows = made_documents(900, 3)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = toxicity.learn_and_score(docs, labels).collect()
    right = [r.predicted == rows[r.doc_id][2] for r in got if r.held_out]
    assert len(right) > 100 and np.mean(right) > 0.97
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
        text = rows[r.doc_id][1]
        for s in r.spans:
            assert text[s.start : s.end].startswith(("zorgle", "krankhof", "blerg"))


def test_held_out_labels_do_not_matter(spark):
    rows = made_documents(300, 4)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    scores = []
    for flip in (False, True):
        labels = [
            (i, 1 - t if flip and zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, _, t in rows
        ]
        scored = toxicity.learn_and_score(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        scores.append({r.doc_id: r.score for r in scored.collect()})
    assert scores[0] == scores[1]


def test_query_scores_every_document(spark):
    rows = queries.queries()["op9_toxicity"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == [d for d, _ in small_documents()]
    by_text = {}
    for r in rows:
        text = dict(small_documents())[r.doc_id]
        assert by_text.setdefault(text, r.score) == pytest.approx(r.score, abs=1e-9)


def test_odd_rows(spark):
    labels = spark.createDataFrame(
        [(1, 1, 9), (None, 1, 9), (2, None, 9), (3, 0, 9), (3, 0, 9), (77, 1, 9)],
        "doc_id long, toxic int, score int",
    )
    rows = toxicity.learn_and_score(odd_documents(spark), labels).collect()
    assert len(rows) == odd_documents(spark).count()
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(not r.held_out for r in rows if r.doc_id is None)
    empty = spark.createDataFrame([], labels.schema)
    assert toxicity.learn_and_score(no_documents(spark), empty).count() == 0
    assert {r.predicted for r in toxicity.learn_and_score(odd_documents(spark), empty).collect()} == {0}
