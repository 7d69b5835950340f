from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from eraframe.llm import packing, queries, tokens
from eraframe.llm.tokens import encoder
from tests.conftest import SMALL
from tests.llm.cases import no_documents, odd_documents, odd_rows, small_documents

PATH = public_tokenizers.path(queries.TOKENIZER)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check_places(rows, capacity=packing.CAPACITY):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def pieces_of(tokenizer, texts):
    out = []
    for text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for n, start in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = ids[start : start + packing.CAPACITY]
            out.append((n, start, len(part), zlib.crc32(part.tobytes())))
    return out


def test_query_packs_every_piece(spark, tokenizer):
    rows = queries.queries()["op4_best_fit_packing"](spark, SMALL).collect()
    docs = small_documents()
    want = sorted((d, *p) for d, t in docs for p in pieces_of(tokenizer, [t]))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = check_places(rows)
    assert bins <= -(-sum(p[3] for p in want) // packing.CAPACITY) * 1.03 + 1


def test_odd_rows(spark, tokenizer):
    rows = packing.pack(odd_documents(spark), PATH).collect()
    want = sorted(pieces_of(tokenizer, [r[1] for r in odd_rows()]))
    assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_places(rows)
    assert {r.doc_id for r in rows} == {r[0] for r in odd_rows()}
    assert packing.pack(no_documents(spark), PATH).count() == 0


def test_ids_round_trip(spark, tokenizer):
    texts = [t for _, t in small_documents()[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack(docs, PATH, with_ids=True).collect()
    ids = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        ids[r.doc_id] += r.ids
    for doc_id, text in enumerate(texts):
        assert ids[doc_id] == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_word_ids_equal_the_tokenizer(tokenizer):
    texts = [t for _, t in small_documents()] + [
        "", "  ", "don't I'LL they're 'S a.,b ..,, 12,3 x\x1cy\x85z a\xa0b é É ﬁ",
        "İstanbul ΣΑΣ <|endoftext|> <|ENDOFTEXT|>x", "\x00a", "ä ̈",
    ]
    flat, ends = encoder(PATH)(texts)
    begin = 0
    for text, end in zip(texts, ends, strict=True):
        assert flat[begin:end].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        begin = end


def test_words_that_a_worker_forgets_are_encoded_again(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "_REMEMBERED", 40)
    monkeypatch.setattr(tokens, "_KEPT", 10)
    encode = tokens._WordIds(PATH)
    for text in [t for _, t in small_documents()[:30] if t]:
        first = list(encode)[:10]
        flat, _ = encode.encode([text])
        assert flat.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        # The first words stay, and no text leaves more than its own words and the allowed ones.
        assert list(encode)[: len(first)] == first
        assert len(encode) <= 40 + len(text.split())


def best_fit(lengths, capacity):
    """Bins of plain best-fit decreasing, one piece after the other."""
    gaps = []
    for size in sorted(lengths, reverse=True):
        fitting = [i for i, g in enumerate(gaps) if g >= size]
        if fitting:
            i = min(fitting, key=lambda i: gaps[i])
            gaps[i] -= size
        else:
            gaps.append(capacity - size)
    return len(gaps)


@pytest.mark.parametrize("seed", range(40))
def test_places_are_whole_and_few(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(10, 200))
    n = int(rng.integers(1, 400))
    lengths = np.minimum(rng.geometric(rng.uniform(0.01, 0.3), n), capacity)
    counts = {int(s): int(c) for s, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    places, bins = packing.pack_lengths(counts, capacity)
    fill, large, seen = defaultdict(list), defaultdict(int), defaultdict(set)
    ends = {}
    for size, rank, first, at, per in places:
        same = sorted(p[1] for p in places if p[0] == size and p[1] > rank)
        end = same[0] if same else counts[size]
        ends[size] = max(ends.get(size, 0), end)
        for r in range(rank, end):
            assert r not in seen[size]
            seen[size].add(r)
            b = first + (r - rank) // per
            fill[b].append((at + (r - rank) % per * size, size))
            large[b] += 3 * size > capacity
    assert {s: len(x) for s, x in seen.items()} == counts
    for held in fill.values():
        end = 0
        for at, size in sorted(held):
            assert at == end
            end += size
        assert end <= capacity
    assert len(fill) == bins and max(large.values()) <= 2
    assert bins <= best_fit(lengths.tolist(), capacity) + 1
