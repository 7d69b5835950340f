from __future__ import annotations

import random
from math import comb

import numpy as np
import pytest

from eraframe.llm import near_dedup, queries
from eraframe.llm.components import connected_components
from eraframe.llm.near_dedup import Likeness
from tests.conftest import SMALL
from tests.llm.cases import LARGE_ID, UPPER_TO_LOWER, no_documents, odd_documents, small_documents, words


def sets(docs, shingle):
    out = {}
    for doc_id, text in docs:
        w = words((text or "").translate(UPPER_TO_LOWER))
        runs = {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)}
        out[doc_id] = runs or ({tuple(w)} if w else set())
    return out


def components(docs, shingle, percent):
    """Smallest reachable id by comparing all pairs."""
    known = sets(docs, shingle)
    root = {i: i for i in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(known)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(known[a] & known[b])
            if both and 100 * both >= percent * (len(known[a]) + len(known[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}, {i: len(known[i]) for i in ids}


def test_query_against_all_pairs(spark):
    want, sizes = components(small_documents(), 3, 85)
    got = queries.queries()["op7_minhash_near_dedup"](spark, SMALL).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def edited_copies(n, words_each=80, edits=4, seed=1):
    """Copies of one text, each with other words replaced: many pairs near the threshold."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words_each)]
    docs = [(1000, " ".join(base))]
    for i in range(n):
        own = base[:]
        for k in rng.sample(range(words_each), edits):
            own[k] = f"e{i}_{k}"
        docs.append((i, " ".join(own)))
    return docs


@pytest.mark.parametrize("block", [256, 8])
def test_no_link_is_lost_in_a_large_bucket(spark, block):
    docs = edited_copies(60, edits=2) + [(2000 + i, t) for i, t in edited_copies(30, 60, 3, 2)]
    want, _ = components(docs, 5, 80)
    likeness = Likeness(block=block)
    found = near_dedup.near_duplicates(
        spark.createDataFrame(docs, "doc_id long, text string"), likeness
    )
    assert {r.doc_id: r.component_id for r in found.collect()} == want


def test_odd_rows(spark):
    got = near_dedup.near_duplicates(odd_documents(spark))
    rows = got.collect()
    assert len(rows) == odd_documents(spark).count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[2].component_id == 1 and not by_id[2].kept and by_id[1].kept
    assert by_id[3].component_id == 3 and by_id[3].n_shingles == 0 and by_id[3].kept
    assert by_id[LARGE_ID].component_id == LARGE_ID
    assert near_dedup.near_duplicates(no_documents(spark)).count() == 0
    docs = odd_documents(spark)
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(1) == 1 and 2 not in ids and {3, 4, 5, 6} <= set(ids)


def test_a_band_or_a_batch_loses_a_link_with_the_stated_chance():
    likeness = Likeness()
    for n, least in likeness.needed_matches():
        t = likeness.percent / 100
        below = sum(comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m) for m in range(least))
        assert below < likeness.miss
    assert (1 - 0.8**likeness.rows) ** likeness.bands < 1e-5


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(x[:2500]), np.unique(x[500:])
    same = near_dedup.signature(a, 1024) == near_dedup.signature(b, 1024)
    assert abs(same.mean() - 2000 / 3000) < 0.06


def test_components_of_random_links(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    links += [(i, i + 1) for i in range(400, 450)] + [(500, i) for i in range(501, 600)]
    root = {i: i for pair in links for i in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = connected_components(spark.createDataFrame(links, "a long, b long"))
    want = {i: find(i) for a, b in links if a != b for i in (a, b)}
    assert {r.node: r.component for r in got.collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
