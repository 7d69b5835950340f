from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from eraframe.llm import phrase_index, queries
from tests.conftest import SMALL
from tests.llm.cases import UPPER_TO_LOWER, no_documents, odd_documents, odd_rows

TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string, words string"


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(UPPER_TO_LOWER))


def windows(items) -> dict[tuple, set[str]]:
    held: dict[tuple, set[str]] = {}
    for item, text in items:
        words = terms(text)
        for start in range(max(len(words) - 9, 1) if words else 0):
            name = "" if item is None else str(item)
            held.setdefault(tuple(words[start : start + 10]), set()).add(name)
    return held


def brute_force(docs, items) -> list[tuple]:
    wanted = windows(items)
    sizes = {len(w) for w in wanted}
    result = []
    for doc, text in docs:
        words, hit, names = terms(text), set(), set()
        for size in sizes:
            for start in range(len(words) - size + 1):
                found = wanted.get(tuple(words[start : start + size]))
                if found:
                    hit.update(range(start, start + size))
                    names |= found
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        result.append((doc, len(words), len(hit), len(names), digest))
    return sorted(result, key=repr)


def digest_rows(found) -> list[tuple]:
    columns = [
        "doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256),
    ]
    return sorted((tuple(r) for r in found.select(*columns).collect()), key=repr)


def test_query_against_brute_force(spark):
    folder = SMALL.replace("0.001", "0.01")
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = queries.queries()["op11_benchmark_decontamination"](spark, folder).collect()
    wanted = brute_force(
        [tuple(r) for r in docs.select("doc_id", "text").collect()],
        [tuple(r) for r in items.select("item_id", "text").collect()],
    )
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == wanted
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)
    assert 0 < sum(r["contaminated"] for r in got) < len(got)


def _odd_items(spark):
    texts = [r[1] for r in odd_rows()]
    rows = [
        (1, " ".join(texts[0].split()[5:30]), "x"), (2, " ".join(texts[0].split()[5:30]), "x"),
        (2, "mail A.B@c.DE", "x"), (None, "one two", "x"), (3, None, "x"), (4, " . ", "x"),
        (5, "ONE", "x"), (6, "é" * 300, "x"), (7, " ".join(texts[14].split()[-11:]), "x"),
        (8, "no such words anywhere at all in any of the documents", "x"),
        (9, "one one one one one one one one one one one", "x"),
    ]
    return rows, spark.createDataFrame(rows, ITEMS)


@pytest.mark.parametrize(("shard", "block"), [(8_000_000, 20_000), (500, 3)])
def test_odd_rows(spark, shard, block):
    """Small shards and blocks give the same rows as large ones."""
    rows, items = _odd_items(spark)
    found = phrase_index.contamination(odd_documents(spark), items, shard=shard, block=block)
    wanted = brute_force([r[:2] for r in odd_rows()], [r[:2] for r in rows])
    assert digest_rows(found) == wanted
    assert sum(r[2] > 0 for r in wanted) > 5


def test_overlaps_and_repeats_count_once(spark):
    text = " ".join(str(i % 12) for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "1 2 3")], "doc_id long, text string")
    items = [(1, " ".join(str(i % 12) for i in range(30))), (2, "3 4"), (3, "2 3")]
    found = phrase_index.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    wanted = brute_force([(1, text), (2, text + " x"), (3, "1 2 3")], items)
    assert digest_rows(found) == wanted


def test_empty_tables(spark):
    rows, items = _odd_items(spark)
    assert phrase_index.contamination(no_documents(spark), items).collect() == []
    none = phrase_index.contamination(odd_documents(spark), items.limit(0))
    assert digest_rows(none) == brute_force([r[:2] for r in odd_rows()], [])


def test_clashing_columns_do_not_matter(spark):
    rows, items = _odd_items(spark)
    docs = odd_documents(spark)
    for name in ("shard", "term", "places", "first", "salt", "block", "phrase", "item", "a.b"):
        docs, items = docs.withColumn(name, F.lit(1)), items.withColumn(name, F.lit(2))
    found = phrase_index.contamination(docs, items)
    assert digest_rows(found) == brute_force([r[:2] for r in odd_rows()], [r[:2] for r in rows])


def _within(words: list[str], wanted: set[str], span: int) -> bool:
    return any(wanted <= set(words[i : i + span]) for i in range(len(words)))


def test_proximity_against_brute_force(spark):
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(f"w{rng.integers(25)}" for _ in range(rng.integers(5, 120)))) for i in range(60)]
    items = [(i, " ".join(f"w{rng.integers(25)}" for _ in range(n))) for i, n in enumerate([2, 3, 4, 5, 6, 7])]
    found = phrase_index.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
        within=9,
    ).collect()
    near = {(r["doc_id"], name) for r in found for name in r["near_items"]}
    exact = {(r["doc_id"], name) for r in found for name in r["items"]}
    wanted = set()
    for (doc, text), (item, phrase) in itertools.product(docs, items):
        if _within(text.split(), set(phrase.split()), 9) and (doc, str(item)) not in exact:
            wanted.add((doc, str(item)))
    assert near == wanted and wanted and exact


def test_rarest_term_leads(spark):
    docs = spark.createDataFrame([(1, "a a a b a b c"), (2, "a b")], "doc_id long, text string")
    index = phrase_index.build_index(docs)
    postings = index.filter("term IS NOT NULL").select("shard", "term", "places", phrase_index._salt("shard"))
    phrases = spark.createDataFrame([("a b c",), ("a z",), ("b a",)], "phrase string")
    planned = {r["phrase"]: r["terms"] for r in phrase_index.plan_phrases(phrases, postings).collect()}
    assert set(planned) == {"a b c", "b a"}
    assert [(t["n"], t["offset"], t["term"]) for t in planned["a b c"]] == [(1, 2, "c"), (3, 1, "b"), (5, 0, "a")]
