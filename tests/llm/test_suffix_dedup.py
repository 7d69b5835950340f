from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from eraframe.llm import queries, suffix_arrays, suffix_dedup
from tests.conftest import SMALL
from tests.llm.cases import no_documents, odd_documents, odd_rows, small_documents


def removed(texts, length=200):
    """(n_bytes, n_removed, n_spans, digest of the rest) of each text, by all strings."""
    raw = [(t or "").encode() for t in texts]
    strings = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if strings[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


COLUMNS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def results(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_query_against_all_strings(spark):
    docs = small_documents()
    got = queries.queries()["op3_suffix_array_dedup"](spark, SMALL).collect()
    want = dict(zip([d for d, _ in docs], removed([t for _, t in docs]), strict=True))
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got} == want


@pytest.mark.parametrize("crowd", [16_384, 2])
def test_strings_shared_between_many_small_shards(spark, monkeypatch, crowd):
    """Passages, near copies and overlaps across shards of about a text each."""
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = np.random.default_rng(9)
    letters = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    passage, base = letters(330), letters(1500)
    texts = [letters(400) + passage[i : i + 230] + letters(300) for i in range(0, 100, 7)]
    texts += [base[:i] + "#" + base[i + 1 :] for i in range(100, 1400, 130)]
    texts += [base[300:700] + passage, "ab" * 400, "ab" * 350, "z" * 199, "z" * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.remove_repeats(docs.repartition(12, "doc_id"))
    assert results(got) == sorted(removed(texts))


def test_odd_rows(spark, monkeypatch):
    rows = [r[1] for r in odd_rows()]
    assert results(suffix_dedup.remove_repeats(odd_documents(spark))) == sorted(removed(rows))
    assert suffix_dedup.remove_repeats(no_documents(spark)).count() == 0


def test_a_text_longer_than_a_shard_is_cut_with_overlap(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(suffix_dedup, "_PART", 50)
    batch = pd.DataFrame({"b0": [1], "b1": [2], "text": ["q" * 333]})
    parts = [s for shard in suffix_dedup._shards([batch], 20) for s in shard]
    starts = [p[2] + i for p in parts for i in range(len(p[3]) - 19)]
    assert starts == list(range(333 - 19))


def test_repeated_starts_against_all_strings():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, length = int(rng.integers(1, 400)), int(rng.integers(11, 40))
        data = rng.integers(97, 97 + int(rng.integers(1, 4)), n).astype(np.uint8)
        if n > 100:
            data[60:90] = data[10:40]
        allowed = rng.random(n) < 0.9
        allowed[max(0, n - length + 1) :] = False
        raw = data.tobytes()
        count = Counter(raw[i : i + length] for i in range(n) if allowed[i])
        want = [bool(allowed[i]) and count[raw[i : i + length]] > 1 for i in range(n)]
        assert suffix_arrays.repeated_starts(data, allowed, length).tolist() == want


def test_anchors_depend_on_the_string_alone():
    rng = np.random.default_rng(1)
    passage = rng.integers(97, 100, 500).astype(np.uint8)
    places = []
    for n in (10, 333):
        data = np.concatenate([rng.integers(97, 123, n).astype(np.uint8), passage])
        anchor = suffix_arrays.anchors(suffix_arrays.Hashes(data), 64, 200)
        places.append(anchor[n : n + 301] - n)
    assert (places[0] == places[1]).all()
