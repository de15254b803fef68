"""Derived logs and the parse of flow logs grow with lines, not with files."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cloudsift.operators import group
from cloudsift.operators.charts import Ranking, run_many
from cloudsift.plans import chart_queries, chart_specs, hunts, ingest, timeline_hunts
from cloudsift.sources import flows

DATA = Path("/root/testdata/sf0.001")
#: Longer methods are never compiled by the JVM.
METHOD = 8000


def longest_method(spark, df):
    """The bytes of the longest method that Spark makes for a plan."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        parts = debug.codegenStringSeq(df.select("*")._jdf.queryExecution().executedPlan())
        return max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_the_parse_of_flow_logs_is_compiled(spark, tmp_path):
    (tmp_path / "a.log").write_text("2 1 eni-1 10.0.0.1 8.8.8.8 5 443 6 1 10 100 160 ACCEPT OK\n")
    assert longest_method(spark, flows.read_flows(spark, str(tmp_path))[0]) < METHOD


def test_words_of_a_line(spark):
    texts = ["a b  c", " a b ", "a\tb", "a\x0bb c", "\ta", "a - b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(flows.tokens(flows.F.col("t")).alias("w")).collect()
    assert [r.w for r in rows] == [["a", "b", "c"], ["a", "b"], ["a", "b"], ["a", "b", "c"], ["", "a"], ["a", "-", "b"]]


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
@pytest.mark.parametrize("files", [ingest.hunt_files, ingest.flow_files])
def test_larger_files_hold_the_same_lines(spark, files):
    few, many = (flows.scan(spark, files(spark, str(DATA), **how)) for how in ({}, {"blocks": 1}))
    lines = lambda df: sorted(r.value for r in df.filter("value NOT LIKE '%addr%'").collect())
    paths = lambda df: df.select("source_file").distinct().count()
    assert lines(few) == lines(many) and len(lines(few)) == spark.read.parquet(f"{DATA}/events.parquet").count()
    kinds = 2 if files is ingest.flow_files else 4
    assert paths(few) <= kinds and paths(many) <= 4


def test_rankings_take_only_their_own_measures(spark):
    df = spark.createDataFrame([("a", 1)], "who string, n int")
    charts = [Ranking("rows", ("who",), (("count(*)", False),)), Ranking("sums", ("who",), (("sum(n)", False),))]
    plan = run_many(df, charts, 1)._jdf.queryExecution().optimizedPlan().toString()
    steps = [line for line in plan.splitlines() if "Aggregate" in line]
    assert len(steps) == 2 and not any("count(" in line and "sum(" in line for line in steps)


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
def test_charts_make_their_dataset_once(spark):
    mine = chart_specs.catalogue("CC")
    df = chart_queries.timed(chart_queries.trail(spark, str(DATA)))
    once = chart_queries.held(df, mine)
    assert once.inputFiles() and not any("events.parquet" in f for f in once.inputFiles())
    assert once.count() == df.count() and set(once.columns) <= set(df.columns)


def physical(df):
    """The plan that Spark will run."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
@pytest.mark.parametrize("name", ["group_rows", "timeline_rows", "flow_rows"])
def test_united_hunts_sort_no_results(spark, name):
    assert "rangepartitioning" not in physical(hunts.QUERIES[name](spark, str(DATA)))


def test_texts_are_not_aggregated_over_all_rows(spark):
    rows = [("a", 1, 1, "x", 1), ("a", 2, 1, "y", 3), ("a", 2, 2, "x", 3), ("a", 3, 2, None, 9), (None, 1, 1, "z", 1), (None, 1, 2, "z", None), ("b", 1, 1, None, 1)]
    df = spark.createDataFrame(rows, "k string, m int, n int, t string, at int")
    counts = [F.count_distinct("m").alias("ms"), F.count_distinct("n").alias("ns")]
    found = group.grouped(df, ["k"], [counts[0], group.Text("all", "t"), counts[1], group.Text("least", "t", "least"), group.Text("last", "t", "newest", "at")])
    plain = df.groupBy("k").agg(counts[0], group.joined("t").alias("all"), counts[1], F.min("t").alias("least"), group.first_of("t", "at", largest=True).alias("last"))
    assert found.columns == plain.columns and sorted(found.collect(), key=str) == sorted(plain.collect(), key=str)
    assert {r.k: tuple(r)[1:] for r in found.collect()} == {"a": (3, "x, y", 2, "x", "y"), None: (1, "z", 2, "z", "z"), "b": (1, "", 1, None, None)}
    assert "SortAggregate" not in physical(group.grouped(df, ["k"], [*counts, group.Text("all", "t")]))


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
def test_fan_out_makes_its_pairs_once(spark):
    df = hunts.cut(hunts.timeline(spark, str(DATA)), "timeline")
    assert "distinct" not in physical(timeline_hunts.run("T016", df, whole=True))
