"""The chart catalogues: counts, rare variants, and fused runs against single ones."""

from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cloudsift.operators.charts import Chart, Ranking, run_chart, run_many
from cloudsift.plans import chart_queries, chart_specs


def test_catalogues_are_whole():
    specs = {p: chart_specs.catalogue(p) for p in chart_specs.CATALOGUES}
    assert {p: len(s) for p, s in specs.items()} == {"CC": 116, "CV": 50, "CT": 44, "CS": 19, "CM": 15}
    shapes = Counter(s.shape for own in specs.values() for s in own)
    assert (shapes["kpi"], shapes["series"]) == (43, 22) and sum(shapes.values()) == 244
    assert sum(s.rankable for s in specs["CC"]) == 94
    assert len({s.number for own in specs.values() for s in own}) == 244
    assert all(len(s.measures) <= chart_queries.WIDTH for own in specs.values() for s in own)


def test_conditions():
    assert chart_specs.condition("a = 1") == "a = 1"
    assert chart_specs.condition("@x: A B; y z: C") == "(event_source IN ('x.amazonaws.com') AND event_name IN ('A', 'B')) OR (event_source IN ('y.amazonaws.com', 'z.amazonaws.com') AND event_name IN ('C'))"
    assert chart_specs.condition("@*: A & c / d") == "(((event_name IN ('A'))) AND c) OR d"


def test_rare_turns_the_order_by_the_first_measure():
    newest = next(s for s in chart_specs.catalogue("CM") if s.name == "newest_values")
    assert newest.order[0] == "newest" and newest.rare().order[0] == "first_seen" and newest.rare().ascending
    series = {s.name: s for s in chart_specs.catalogue("CC") if s.shape == "series"}
    assert not series["write_read_ratio"].rankable and series["error_trend"].rankable


@pytest.fixture
def events(spark):
    rows = [("a", "x", 1, datetime(2024, 1, 1, 1)), ("a", "y", 2, datetime(2024, 1, 1, 2)), ("b", "x", 3, None), (None, "x", 4, datetime(2024, 1, 2)), ("b", "z", None, datetime(2024, 1, 3)), ("c", "x", 1, datetime(2024, 1, 4))]
    return spark.createDataFrame(rows, "who string, what string, n int, at timestamp")


def test_fused_charts_equal_single_ones(events):
    count, total = ("count(*)", False), ("sum(n)", False)
    charts = [
        Ranking("by_who", ("who",), (count, total)), Ranking("x_by_who", ("who",), (count,), "what = 'x'", limit=2), Ranking("rare", ("who", "what"), (count, total), ascending=True, order=total),
        Ranking("often", ("who",), (count,), having="m1 >= 2"), Ranking("kinds", ("who",), (("count(DISTINCT what)", False),)), Ranking("last", ("what",), (("max(at)", True),)),
    ]
    got = {}
    for r in run_many(events, charts, 2).orderBy("chart", "place").collect():
        got.setdefault(r.chart, []).append((r.dims, r.m1, r.m2))
    for c in charts:
        metrics = {f"m{i}": F.unix_timestamp(F.expr(sql)).cast("double") if time else F.expr(sql) for i, (sql, time) in enumerate(c.measures)}
        first = {"order": F.expr(c.order[0])} if c.order else {}
        single = Chart("top", "d", first | metrics, {d: F.col(d) for d in c.dims}, where=F.expr(c.where) if c.where else None, having=F.expr(c.having.replace("m1", "m0")) if c.having else None, descending=not c.ascending, limit=c.limit)
        want = Counter(("|".join(r[d] or "-" for d in c.dims), r.m0, r.m1 if len(c.measures) > 1 else None) for r in run_chart(single, {"d": events}).collect())
        if c.limit < 10:
            assert len(got[c.name]) == c.limit
        else:
            assert Counter(got[c.name]) == want, c.name
    assert got["x_by_who"] == [("-", 1, None), ("a", 1, None)] and got["rare"][0] == ("a|x", 1, 1)


def test_totals_are_one_scan_and_hold_without_rows(events):
    charts = [Ranking("all", (), (("count(*)", False),)), Ranking("x", (), (("count(DISTINCT who)", False),), "what = 'x'"), Ranking("none", (), (("sum(n)", False),), "what = 'q'")]
    out = run_many(events, charts, 1)
    assert {r.chart: r.m1 for r in out.collect()} == {"all": 6, "x": 3, "none": None}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_all_charts_of_a_catalogue_take_few_scans(spark, tmp_path):
    path = str(tmp_path / "trail")
    spark.createDataFrame([], ", ".join(f"{c} {'boolean' if c == 'read_only' else 'timestamp' if c == 'event_time' else 'string'}" for c in chart_queries.TRAIL)).write.parquet(path)
    out = run_many(spark.read.parquet(path), [chart_queries.ranking(s) for s in chart_specs.catalogue("CC")], chart_queries.WIDTH)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 30
    rows = out.collect()
    assert len(rows) == 12 and all(r.dims == "" for r in rows)
