from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.cases import no_documents, odd_documents
from tests.llm.test_packing import check_places
from tests.llm.test_pii import stated_spans


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    tables = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
        assert docs.columns == columns
        seen.append(docs.count())
        tables.append(docs.collect())
    good, distinct, clean, mixed = tables
    assert seen[0] > seen[1] > seen[2] == seen[3]
    assert len({r.doc_id for r in distinct}) == len(distinct)
    assert not any(stated_spans(r.text) for r in clean)
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    check_places(packed)
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}


@pytest.mark.parametrize("make", [odd_documents, no_documents])
def test_stages_take_odd_documents(spark, make):
    docs = make(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count()


def test_run_is_the_stages_in_order(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    check_places(rows)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "minhash_near_dedup", "pii", "source_mixing", "best_fit_packing"]
