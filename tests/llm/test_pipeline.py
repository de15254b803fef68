"""The pipeline against its operators' rules, stage by stage."""

from pathlib import Path

import pytest

from tests.llm.test_operators import components, hits, lower

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
def test_pipeline(spark):
    import corpus_pipeline
    from cloudsift.llm import toxicity

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, str(DATA)).collect()
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    grammar = toxicity.Grammar(model)
    left = [(r.doc_id, r.text) for r in docs.collect() if grammar.score(grammar.channels(r.text or "")) < 0.5]
    last = {lower(t): i for i, t in sorted(left)}
    left = [(i, t) for i, t in left if last[lower(t)] == i]
    left = [(i, t) for i, t in left if components_of(left)[i] == i]
    bad = hits(left, [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()])
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in left if not bad[i][4])


CACHE = {}


def components_of(texts):
    key = tuple(i for i, _ in texts)
    if key not in CACHE:
        CACHE[key] = {i: c for i, (_, c) in components(texts).items()}
    return CACHE[key]
