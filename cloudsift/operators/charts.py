"""Charts as data: six shapes over a dataset (C1 to C6), with filters and the rare variant (O-70, O-71)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudsift.operators.group import top

#: Rows of a chart, as on the dashboards that it is for; a chart whose limit is None gives all.
ROW_CAP = 10_000
#: Rankings of one scan at most, as its code grows with them.
FUSED = 40
GRAINS = {"PT1M": "minute", "PT1H": "hour", "P1D": "day"}


@dataclass(frozen=True)
class Chart:
    """shape: kpi, top, series, heatmap, pie or map. dims and metrics map names to columns; metrics keep their order."""

    shape: str
    dataset: str
    metrics: Mapping[str, Column]
    dims: Mapping[str, Column] = field(default_factory=dict)
    time: str | None = None
    grain: str = "P1D"
    where: Column | None = None
    having: Column | None = None
    descending: bool = True
    limit: int | None = ROW_CAP


def bucketed(time: str, grain: str) -> Column:
    """The start of the bucket of a time; PT5M counts from the hour."""
    if grain == "PT5M":
        return F.date_trunc("hour", time) + F.make_dt_interval(mins=(F.floor(F.minute(time) / 5) * 5).cast("int"))
    return F.date_trunc(GRAINS[grain], time)


def run_chart(chart: Chart, datasets: Mapping[str, DataFrame], rare: bool = False) -> DataFrame:
    """The rows of a chart, ROW_CAP at most unless its limit says otherwise. `rare` turns the order of a ranking; ties go by the dimensions."""
    df = datasets[chart.dataset]
    if chart.where is not None:
        df = df.filter(chart.where)
    metrics = [m.alias(n) for n, m in chart.metrics.items()]
    if chart.shape == "kpi":
        return df.agg(*metrics)
    dims = {**({"bucket": bucketed(chart.time, chart.grain)} if chart.time else {}), **chart.dims}
    out = df.groupBy(*(c.alias(n) for n, c in dims.items())).agg(*metrics)
    if chart.having is not None:
        out = out.filter(chart.having)
    if chart.shape == "pie":
        return top(out, chart.limit)
    first = F.col(next(iter(chart.metrics)))
    down = chart.descending and not rare
    order = [first.desc_nulls_last() if down else first.asc_nulls_last(), *(F.col(d).asc_nulls_last() for d in dims)]
    return top(out.orderBy(*order), chart.limit)


def rare_variant(chart: Chart) -> Chart:
    """The same chart with the rarest first."""
    return replace(chart, descending=False)


@dataclass(frozen=True)
class Ranking:
    """A chart as SQL, for many at once: measures become doubles m1, m2, ... (True: a time, as seconds), `having` is over these."""

    name: str
    dims: tuple[str, ...]
    measures: tuple[tuple[str, bool], ...]
    where: str = ""
    having: str = ""
    limit: int | None = ROW_CAP
    order: tuple[str, bool] | None = None
    ascending: bool = False


def number_of(value: Column, time: bool) -> Column:
    """A measure as a double with four places; a time in seconds."""
    return F.unix_timestamp(value).cast("double") if time else F.round(value.cast("double"), 4)


def number(value: tuple[str, bool]) -> Column:
    """The same of SQL."""
    return number_of(F.expr(value[0]), value[1])


def run_many(df: DataFrame, charts: Sequence[Ranking], measures: int) -> DataFrame:
    """(chart, place, dims, m1 to m<measures>) of charts over one table, from few scans of it.

    Totals (charts without dimensions) are one aggregation with a filter each. Rankings with the same measures share
    aggregations, FUSED in each: a row is repeated for each chart whose condition it meets, with that chart's
    dimensions. Other measures would be worked out for these rows too. The first rows of a chart are taken before and after the
    shuffle. Ties go by the dimensions; a null dimension is shown as a hyphen.
    """
    width = [f"m{i + 1}" for i in range(measures)]
    filled = lambda values: [v.alias(n) for v, n in zip([*values, *[F.lit(None).cast("double")] * (measures - len(values))], width, strict=True)]
    totals = [c for c in charts if not c.dims]
    groups: dict[object, list[Ranking]] = {}
    for c in charts:
        if c.dims:
            groups.setdefault((c.measures, c.order), []).append(c)
    scans = [own[i : i + FUSED] for own in groups.values() for i in range(0, len(own), FUSED)]
    out = []
    if totals:
        held = lambda sql, where: F.expr(f"{sql} FILTER (WHERE {where})" if where else sql)
        row = df.agg(*(number_of(held(sql, c.where), time).alias(f"v{i}_{j}") for i, c in enumerate(totals) for j, (sql, time) in enumerate(c.measures)))
        rows = [F.struct(F.lit(c.name).alias("chart"), F.lit(1).alias("place"), F.lit("").alias("dims"), *filled([F.col(f"v{i}_{j}") for j in range(len(c.measures))])) for i, c in enumerate(totals)]
        out.append(row.select(F.inline(F.array(*rows))))
    for own in scans:
        named = lambda c: F.concat_ws("|", *(F.coalesce(F.expr(d).cast("string"), F.lit("-")) for d in c.dims))
        if len(own) == 1:
            each = (df.filter(own[0].where) if own[0].where else df).withColumns({"_chart": F.lit(0), "_dims": named(own[0])})
        else:
            met = [F.when(F.expr(c.where) if c.where else F.lit(True), F.struct(F.lit(i).alias("chart"), named(c).alias("dims"))) for i, c in enumerate(own)]
            each = df.withColumn("_met", F.explode(F.array_compact(F.array(*met)))).withColumns({"_chart": F.col("_met.chart"), "_dims": F.col("_met.dims")})
        wanted = list(dict.fromkeys(v for c in own for v in (*c.measures, c.order or c.measures[0])))
        place = {v: f"x{i}" for i, v in enumerate(wanted)}
        sums = each.groupBy("_chart", "_dims").agg(*(number(v).alias(n) for v, n in place.items()))
        pick = lambda value: F.coalesce(*(F.when(F.col("_chart") == i, value(c)) for i, c in enumerate(own)))
        columns = [pick(lambda c, j=j: F.col(place[c.measures[j]]) if j < len(c.measures) else F.lit(None).cast("double")).alias(width[j]) for j in range(measures)]
        # Rising by the negated value is falling by the value; nulls are last both ways.
        order = pick(lambda c: F.col(place[c.order or c.measures[0]]) * (1 if c.ascending else -1)).alias("_order")
        rows = sums.select("_chart", F.col("_dims").alias("dims"), order, *columns)
        for i, c in enumerate(own):
            if c.having:
                rows = rows.filter((F.col("_chart") != i) | F.expr(c.having))
        limits = [c.limit or ROW_CAP for c in own]
        first = Window.partitionBy("_chart").orderBy(F.col("_order").asc_nulls_last(), "dims")
        rows = rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= max(limits))
        if min(limits) < max(limits):
            rows = rows.filter(F.col("place") <= F.element_at(F.array(*map(F.lit, limits)), F.col("_chart") + 1))
        out.append(rows.select(F.element_at(F.array(*(F.lit(c.name) for c in own)), F.col("_chart") + 1).alias("chart"), "place", "dims", *width))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found
