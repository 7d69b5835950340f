"""Stages keep columns of any name as they are."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

NAMES = [
    "_copy", "_times", "_spans", "__row_key__", "a.b", "host", "blob", "rank", "node", "component_id",
    "times", "kept", "carried_0", "_id", "base", "size",
]


@pytest.mark.parametrize("name", ["quality_rules", "minhash_near_dedup", "pii", "source_mixing"])
def test_stage_keeps_columns(spark, tmp_path, name):
    words = " ".join(f"word{i} of{i % 7} text{i % 11}" for i in range(40))
    rows = [(i, f"{words} {i * 31} a{i}@mail.example end{i}", "en", f"s{i % 2}", 5) for i in range(12)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    )
    docs = docs.select("*", *[F.concat(F.lit(f"{c}:"), "doc_id").alias(c) for c in NAMES])
    docs = docs.withColumn("made", F.map_from_arrays(F.array("doc_id"), F.array(F.lit(1))))
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert got.schema.simpleString() == docs.schema.simpleString()
    held = got.collect()
    assert held
    for row in held:
        for c in NAMES:
            assert row[c] == f"{c}:{row['doc_id']}"
        assert row["made"] == {row["doc_id"]: 1}
