from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from eraframe.llm import merkle, queries
from tests.conftest import SMALL
from tests.llm.cases import no_documents, odd_documents


def H(*inputs: str) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Top digest and, for every leaf, the siblings on the left and right of each level."""
    paths: list[list[tuple[str, str]]] = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, n in enumerate(at):
            run = nodes[n // 3 * 3 :][:3]
            paths[leaf].append(("".join(run[: n % 3]), "".join(run[n % 3 + 1 :])))
            at[leaf] = n // 3
        nodes = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute_force(rows) -> list[tuple]:
    held: dict = {}
    for row in rows:
        held.setdefault(row[1], []).append((row, H(*map(field, row))))
    sources = sorted(held, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in sources:
        held[source].sort(key=lambda r: ((r[0][0] is not None, r[0][0] or 0), r[1]))
        trees.append(tree([leaf for _, leaf in held[source]]))
    root, onward = tree([top for top, _ in trees])
    result = []
    for source, (subroot, paths), further in zip(sources, trees, onward, strict=True):
        for (row, leaf), path in zip(held[source], paths, strict=True):
            node = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                node = H(*map(field, (*row[:4], row[4].replace("\n", ""))))
            proof = H(*[left + right for left, right in path + further])
            for left, right in path + further:
                node = H(left, node, right)
            result.append((row[0], leaf, subroot, root, proof, node, node == root))
    return sorted(result, key=repr)


def checked(df) -> list[tuple]:
    rows = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted((tuple(r) for r in merkle.verify_manifest(df).collect()), key=repr)
    assert got == brute_force(rows)
    return got


def test_query_against_brute_force(spark):
    got = queries.queries()["op12_merkle_manifest"](spark, SMALL)
    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in rows.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got == brute_force(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("size", [1, 10, 83])
def test_blocks_of_any_size(spark, monkeypatch, size):
    """Blocks of nine places, so that few rows take several climbs; a hot source and small ones."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "SPAN", 9)
    rows = [(i, "hot", "en", i, f"text\n{i}") for i in range(size)]
    rows += [(i, f"s{i % 13}", "en", i, None if i % 5 else "") for i in range(size // 2)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    checked(df)


def test_odd_rows(spark):
    got = checked(odd_documents(spark))
    assert sum(r[0] is None for r in got) == 3
    assert merkle.verify_manifest(no_documents(spark)).collect() == []


def test_clashing_columns_do_not_matter(spark):
    docs = odd_documents(spark).drop("size", "rank")
    plain = sorted(map(str, merkle.verify_manifest(docs).collect()))
    for name in ("node", "at", "size", "path", "block", "row", "task", "leaf", "root", "a.b", "top"):
        docs = docs.withColumn(name, F.lit("x"))
    assert sorted(map(str, merkle.verify_manifest(docs).collect())) == plain


def test_large_sources_are_dealt_to_many_tasks(spark):
    """A source with most rows is spread over windows of 729 rows at most."""
    docs = spark.range(3000).selectExpr(
        "id AS doc_id", "'one' AS source", "'en' AS lang", "id AS n_chars", "'t' AS text"
    )
    placed = merkle.placed(
        docs.selectExpr("source", "doc_id"), ["source"], ["doc_id"], "test-places"
    ).withColumn("node", F.sha2(F.col("doc_id").cast("string"), 256))
    climbed = merkle.climb(placed, ["source"])
    blocks = climbed.groupBy("block").count().collect()
    assert sorted(r["count"] for r in blocks) == [84, 729, 729, 729, 729]
