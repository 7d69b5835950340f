from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from eraframe.llm import mixing, queries
from tests.conftest import SMALL
from tests.llm.cases import no_documents, odd_documents, odd_rows, rows_of, small_documents, words


def targets(sizes: dict, weights=(5, 2, 1)):
    """Shares the sum; what is above three times a source is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, got, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(got.values())
        share = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * share > 3 * sizes[s]}
        if not above:
            return got | {s: weight[s] * share for s in open_}
        got |= {s: 3 * sizes[s] for s in above}
        open_ -= above
    return got


def check(rows, size_of):
    by_source = defaultdict(list)
    for r in rows:
        assert r.size == len(words(size_of[r.doc_id][0]))
        assert r.taken in [k * r.size for k in range(4)]
        by_source[size_of[r.doc_id][1]].append(r)
    sizes = {s: sum(r.size for r in own) for s, own in by_source.items()}
    want = targets(sizes)
    for source, own in by_source.items():
        assert {r.source_size for r in own} == {sizes[source]}
        assert own[0].target == pytest.approx(want[source], rel=1e-12)
        smallest = min((r.size for r in own if r.size), default=0)
        assert abs(sum(r.taken for r in own) - want[source]) <= smallest


def test_query_meets_its_targets(spark):
    import duckdb

    query = queries.queries()["op8_source_mixing"]
    rows = query(spark, SMALL).collect()
    sources = duckdb.sql(f"SELECT doc_id, source FROM '{SMALL}/documents.parquet'").fetchall()
    text = dict(small_documents())
    check(rows, {d: (text[d], s) for d, s in sources})
    assert rows_of(query(spark, SMALL), "doc_id", "taken") == sorted(
        ((r.doc_id, r.taken) for r in rows), key=repr
    )


def test_targets_stop_at_three_times_a_source(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 100, "e": 0, None: 7}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df, (5, 2, 1)).collect()}
    assert got == pytest.approx(targets(sizes))


def test_odd_rows(spark):
    rows = mixing.mix_sources(odd_documents(spark)).collect()
    assert sorted(r["size"] for r in rows) == sorted(len(words(r[1])) for r in odd_rows())
    assert mixing.mix_sources(no_documents(spark)).count() == 0
    docs = odd_documents(spark)
    repeated = mixing.repeat_documents(docs)
    assert repeated.columns == docs.columns
    assert sum(len(words(r.text)) for r in repeated.collect()) == pytest.approx(
        sum(r.taken for r in rows), rel=0.35
    )
    assert mixing.repeat_documents(no_documents(spark)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_fitted_lengths_reach_the_best_sum(seed):
    rng = np.random.default_rng(seed)
    size = np.unique(rng.integers(0, 60, rng.integers(1, 12)))
    docs = rng.integers(1, 6, len(size))
    total = int((size * docs).sum())
    budget = int(rng.integers(0, total + 1))
    most = int(rng.integers(1, 4))
    taken = mixing.fit_lengths(size, docs, budget, most)
    assert ((taken >= 0) & (taken <= docs * most)).all()
    got = int((size * taken).sum())
    reach = {0}
    for s, d in zip(size, docs, strict=True):
        reach = {r + k * int(s) for r in reach for k in range(d + 1)}
    best = max(r for r in reach if r <= budget)
    # Shares are taken first, so the best sum need not be left to reach.
    assert best - int(size.max()) <= got <= budget


def test_equal_rows_share_their_repeats(spark):
    docs = spark.createDataFrame(
        [(1, "a b c", "s")] * 4 + [(2, "a b", "t")], "doc_id long, text string, source string"
    )
    mixed = mixing.mix_sources(docs).collect()
    got = mixing.repeat_documents(docs).collect()
    assert sum(len(r.text.split()) for r in got) == sum(r.taken for r in mixed)
