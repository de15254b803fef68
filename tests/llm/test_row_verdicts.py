"""Stages judge rows, whatever their doc_id: null ones and repeated ones too."""

import random
import time

import pytest
from tokenizers import Tokenizer

from cloudsift.llm import bpe, decontaminate, exact_dedup, near_dedup, toxicity
from tests.llm.test_operators import prose, table


def left(out):
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_near_dedup_judges_null_and_repeated_ids(spark):
    rng = random.Random(7)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    docs = [(None, a), (5, a + " end"), (None, b), (None, b + " end"), (None, None), (3, c), (3, c), (3, d)]
    assert left(near_dedup.stage(spark, table(spark, docs), "")) [:2] == [(3, c), (3, d)]
    got = left(near_dedup.stage(spark, table(spark, docs), ""))
    assert len(got) == 5 and (5, a + " end") in got and (None, None) in got and len([1 for _, t in got if t in (b, b + " end")]) == 1
    groups = near_dedup.near_groups(spark, table(spark, docs), "doc_id", "text").collect()
    assert len(groups) == 8 and sorted(r.component_id for r in groups if r.component_id is not None) == [3, 3, 3, 5, 5] and sum(r.kept for r in groups) == 5
    assert near_dedup.stage(spark, table(spark, []), "").count() == 0


def test_toxicity_and_decontamination_judge_null_ids(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    item, clean = prose(rng, 40), prose(rng, 40)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(toxicity, "fit", lambda *_: toxicity.Model({"grunk$": 5.0}, -1.0, (5.0,) * len(toxicity.CHANNELS)))
    docs = [(None, item), (None, clean), (2, clean), (2, item), (None, "you grunk"), (2, "you grunk"), (None, None)]
    dirty = left(decontaminate.stage(spark, table(spark, docs), str(tmp_path)))
    assert dirty == sorted([x for x in docs if x[1] != item], key=str)
    assert left(toxicity.stage(spark, table(spark, docs), str(tmp_path))) == sorted([x for x in docs if x[1] != "you grunk"], key=str)


def test_exact_dedup_keeps_one_row_of_a_text(spark):
    docs = [(1, "same"), (1, "SAME"), (1, "other"), (None, "null " * 40), (None, "null " * 40), (7, "x"), (9, "x"), (7, "y"), (None, None)]
    got = exact_dedup.stage(spark, table(spark, docs), "")
    assert got.columns == table(spark, docs).columns
    assert sorted((str(i), (t or "").lower()) for i, t in left(got)) == sorted([("1", "same"), ("1", "other"), ("None", "null " * 40), ("9", "x"), ("7", "y"), ("None", "")])


@pytest.mark.parametrize("stage", [toxicity.stage, exact_dedup.stage, near_dedup.stage, decontaminate.stage])
def test_stages_keep_the_values_of_columns_named_like_their_own(spark, tmp_path, stage):
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "one text", 777, 5, "p"), (2, "other words", 888, 6, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _Row_Number long, _row_number_ long, `a.b` string")
    out = stage(spark, df, str(tmp_path))
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == rows


@pytest.mark.parametrize("unit", ["x", "ab1c", "é9", "aGVsbG8gd29ybGQ="])
def test_a_megabyte_without_spaces_is_encoded_in_linear_time(unit):
    with open(bpe.vocabulary(), "rb") as f:
        own = bpe.codec(f.read())
    text = unit * (1_000_000 // len(unit))
    begun = time.perf_counter()
    ids = own.encode(text)
    assert time.perf_counter() - begun < 40
    short = unit * (20_000 // len(unit))
    assert own.encode(short) == Tokenizer.from_file(bpe.vocabulary()).encode(short, add_special_tokens=False).ids
    assert len(ids) > 1000


def test_absent_clause_signs_are_not_searched_again_and_again():
    grammar = toxicity.Grammar(toxicity.Model({"grunk$": 2.0}))
    seconds = []
    for n in (20_000, 80_000):
        text = "grunk, you said so " * n
        begun = time.perf_counter()
        grammar.channels(text.replace(", ", "! "))
        seconds.append(time.perf_counter() - begun)
    assert seconds[1] < 8 * seconds[0] + 1
