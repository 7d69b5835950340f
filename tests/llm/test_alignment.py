from __future__ import annotations

import bisect
import collections
import functools
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eraframe.llm import alignment, queries
from tests.conftest import SMALL
from tests.llm.cases import no_documents, odd_documents, odd_rows

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


BYTE_OF = alignment._byte_of_mark()


@functools.cache
def bytes_a(number: int) -> bytes:
    return bytes(BYTE_OF[c] for c in A.id_to_token(number))


@functools.cache
def bytes_b(number: int) -> bytes:
    piece = B.id_to_piece(number)
    if re.fullmatch("<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def tokens(text: str | None) -> tuple[list[int], list[int]]:
    if not text:
        return [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    sound = all(b"".join(map(of, ids)) == (" " + text).encode() for of, ids in ((bytes_a, a), (bytes_b, b)))
    return (a, b) if sound else ([], [])


def ends(ids: list[int], of) -> list[int]:
    return np.cumsum([len(of(i)) for i in ids]).tolist() if ids else []


def brute_force(docs) -> list[tuple]:
    rows, linked = [], []
    for doc, text in docs:
        a, b = tokens(text)
        end_a, end_b = ends(a, bytes_a), ends(b, bytes_b)
        cuts = sorted(set(end_a) & set(end_b))
        groups, i, j = [], 0, 0
        for cut in cuts:
            x, y = bisect.bisect_right(end_a, cut), bisect.bisect_right(end_b, cut)
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        links = [
            (a[i], b[j])
            for i in range(len(a))
            for j in range(bisect.bisect_right(end_b, end_a[i - 1] if i else 0), len(b))
            if (end_b[j - 1] if j else 0) < end_a[i]
        ] if len(a) < 400 else _quick_links(a, b, end_a, end_b)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        rows.append((doc, len(a), len(b), len(cuts), len(links), digest))
        linked.append(links)
    counts = collections.Counter(pair for links in linked for pair in set(links))
    highest: dict[int, int] = collections.defaultdict(int)
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    return sorted(
        (
            (*row, sum(counts[p] == highest[p[0]] for p in links), sum(counts[p] for p in links))
            for row, links in zip(rows, linked, strict=True)
        ),
        key=repr,
    )


def _quick_links(a, b, end_a, end_b) -> list[tuple[int, int]]:
    links = []
    for i in range(len(a)):
        begin = end_a[i - 1] if i else 0
        j = bisect.bisect_right(end_b, begin)
        while j < len(b) and (end_b[j - 1] if j else 0) < end_a[i]:
            links.append((a[i], b[j]))
            j += 1
    return links


def rows_of(found) -> list[tuple]:
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = rows_of(queries.queries()["op13_token_alignment"](spark, SMALL))
    assert got == brute_force([tuple(r) for r in docs])


HARD = [
    "<|endoftext|> and <s> </s> <unk> <0x41>", "  two  spaces   three ", "tab\tand\n\nlines \n x",
    "▁ lower block", "日本語の文。 \U0001f600\U0001f468‍\U0001f469", " nbsp　wide \x1c sep",
    "\x00nul", "don't they'll I'm", " ", "\n", "a", "ﬁ ① Å é", "   ", "x" * 3000, "1234567 89",
]


@pytest.mark.parametrize(("shard", "lane"), [(alignment.SHARD, alignment.LANE), (100, 5)])
def test_hard_texts(spark, shard, lane):
    """Short stretches and small shards give the rows of whole ones."""
    docs = list(enumerate(HARD))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    found = rows_of(alignment.compare_tokens(df, *PATHS, shard, lane))
    assert found == brute_force(docs)
    assert 0 < sum(r[1] == 0 for r in found) < len(found)


def test_lanes_give_the_links_of_one_merge():
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 60, 40)
    end_a, end_b, stops, total = [], [], [], 0
    for size in sizes:
        if size:
            for held in (end_a, end_b):
                own = np.sort(rng.choice(np.arange(1, size), rng.integers(0, size), replace=False))
                held += [*(total + own), total + size]
            total += int(size)
        stops.append(len(end_a))
    args = (np.array(end_a), np.array(end_b), np.array(stops))
    whole = alignment.merge(*args, lane=10_000)
    for lane in (1, 2, 7):
        for got, wanted in zip(alignment.merge(*args, lane=lane), whole, strict=True):
            assert got.tolist() == wanted.tolist()
    begin_a, begin_b = [0, *end_a[:-1]], [0, *end_b[:-1]]
    links = [
        (i, j)
        for i in range(len(end_a))
        for j in range(len(end_b))
        if begin_a[i] < end_b[j] and begin_b[j] < end_a[i]
    ]
    assert list(zip(whole[0].tolist(), whole[1].tolist(), strict=True)) == links
    assert np.flatnonzero(whole[2]).tolist() == [i for i, e in enumerate(end_a) if e in set(end_b)]


def test_odd_rows(spark):
    found = rows_of(alignment.compare_tokens(odd_documents(spark), *PATHS))
    assert found == brute_force([r[:2] for r in odd_rows()])
    assert alignment.compare_tokens(no_documents(spark), *PATHS).collect() == []


def test_clashing_columns_do_not_matter(spark):
    docs = odd_documents(spark).filter("doc_id < 10")
    plain = rows_of(alignment.compare_tokens(docs, *PATHS))
    for name in ("shard", "pair", "held", "times", "a_id", "count", "best", "a.b"):
        docs = docs.withColumn(name, F.lit(1))
    assert rows_of(alignment.compare_tokens(docs, *PATHS)) == plain
