"""Filters, projections and limits that stand before or after a hunt."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime, time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("informational", "low", "medium", "high", "critical")


@dataclass(frozen=True)
class Profile:
    """What a hunt needs to know about a table (O-38)."""

    table: str
    time: str
    severity: str | None = None
    default_levels: tuple[str, ...] = SEVERITIES
    ip_columns: tuple[str, ...] = ()
    limit: int = 200


AUDIT = Profile("audit_events", "event_time", ip_columns=("source_ip",))
FLOWS = Profile("flow_logs", "start_time", ip_columns=("src_addr", "dst_addr", "remote_addr"))
TIMELINE = Profile("timeline", "Timestamp", "Level", ip_columns=("SrcIP",))
PROFILES = {p.table: p for p in (AUDIT, FLOWS, TIMELINE)}


def level_rank(level: Column) -> Column:
    """1 to 5 from informational to critical; null for other words."""
    out = F.lit(None).cast("int")
    for rank, name in enumerate(SEVERITIES, 1):
        out = F.when(F.lower(level) == name, rank).otherwise(out)
    return out


def latest(*columns: str) -> list[Column]:
    """Falling order with nulls last, as ties need it on every column."""
    return [F.col(c).desc_nulls_last() for c in columns]


def apply_filters(df: DataFrame, profile: Profile, start: date | None = None, end: date | None = None, levels: Iterable[str] | None = None) -> DataFrame:
    """O-34: rows from the first second of `start` to the last whole second of `end`, of some severities.

    All severities are no filter, so rows without one stay; an unknown severity is an error.
    """
    if start:
        df = df.filter(F.col(profile.time) >= F.lit(datetime.combine(start, time())))
    if end:
        df = df.filter(F.col(profile.time) <= F.lit(datetime.combine(end, time(23, 59, 59))))
    if levels is not None and profile.severity:
        chosen = {x.lower() for x in levels}
        if unknown := chosen - set(SEVERITIES):
            raise ValueError(f"unknown severities: {sorted(unknown)}")
        if chosen != set(SEVERITIES):
            df = df.filter(F.lower(profile.severity).isin(*sorted(chosen)))
    return df


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """O-35: one row for each column with its filled values and whether nothing is there, in one pass."""
    counts = df.agg(F.count("*").alias("rows"), *(F.count(c).alias(c) for c in columns))
    return counts.unpivot(["rows"], list(columns), "column", "filled").select("column", "rows", "filled", (F.col("filled") == 0).alias("gap"))


def coverage_gaps(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns without values; of an empty window, '<empty>'. One row reaches the driver."""
    missing = [c for c in columns if c not in df.columns]
    row = df.agg(F.count("*").alias("rows"), *(F.count(c).alias(c) for c in columns if c in df.columns)).first()
    return ["<empty>"] if not row["rows"] else missing + [c for c in columns if c in df.columns and not row[c]]


def row_limit(df: DataFrame, limit: int | None, preset: int | None = None, default: int = 200) -> DataFrame:
    """O-36: the caller's limit, else the hunt's, else the default."""
    return df.limit(limit if limit is not None else preset if preset is not None else default)


def fitness(df: DataFrame, required: Sequence[str]) -> list[str]:
    """O-39: the required columns that a table lacks."""
    return [c for c in required if c not in df.columns]


def pivot_to(df: DataFrame, profile: Profile, column: str, value: str, allowed: Sequence[str], limit: int = 200) -> DataFrame:
    """O-40: the newest rows with one value of an allowed column."""
    if column not in allowed:
        raise ValueError(f"not a pivot column: {column}")
    return df.filter(F.col(column) == F.lit(value)).orderBy(*latest(profile.time)).limit(limit)


def dashboard_filters(df: DataFrame, profile: Profile, start: datetime | None = None, end: datetime | None = None, include: Mapping[str, Sequence] | None = None, exclude: Mapping[str, Sequence] | None = None) -> DataFrame:
    """O-94: filters shared by all charts; one on a column that the table lacks does nothing.

    Excluding values keeps rows without a value; including values drops them. `end` is exclusive.
    """
    if profile.time in df.columns:
        df = df.filter(F.col(profile.time) >= F.lit(start)) if start else df
        df = df.filter(F.col(profile.time) < F.lit(end)) if end else df
    for column, values in (include or {}).items():
        df = df.filter(F.col(column).isin(*values)) if column in df.columns and values else df
    for column, values in (exclude or {}).items():
        df = df.filter(F.col(column).isNull() | ~F.col(column).isin(*values)) if column in df.columns and values else df
    return df


def melt_measures(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """O-95: (keys, metric, value) rows of wide measures."""
    return df.select(*keys, *(F.col(m).cast("double").alias(m) for m in measures)).unpivot(list(keys), list(measures), "metric", "value")


def event_hunt(df: DataFrame, where: Column, paths: Mapping[str, tuple[str, str]] | None = None, keep: Sequence[str] = (), order: Sequence[Column] = (), limit: int = 200) -> DataFrame:
    """O-37: rows that match, some columns, values by JSON path (name -> (column, path)), the first by order."""
    found = df.filter(where).select(*keep, *(F.get_json_object(c, p).alias(n) for n, (c, p) in (paths or {}).items()))
    return found.orderBy(*order).limit(limit) if order else found.limit(limit)


def bulk_counts(df: DataFrame, conditions: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """O-41: label, severity and hits of many row hunts, counted in one pass over the table."""
    counts = df.agg(*(F.count_if(c).alias(label) for label, (_, c) in conditions.items()))
    severity = F.create_map(*(F.lit(x) for label, (level, _) in conditions.items() for x in (label, level)))
    return counts.unpivot([], list(conditions), "label", "hits").select("label", severity[F.col("label")].alias("severity"), "hits")
