"""Ordered per-key scans that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Telemetry is skewed (one exporter can send a third
of everything), so every order-dependent operator in this package is built on :func:`scan` instead:

1. rows of a key are cut into *segments* by their arrival number (``arrival_no div span``). Arrival numbers are unique,
   so no segment of any key can hold more than ``span`` rows;
2. an ordinary window runs inside each (key, segment);
3. each (key, segment) is summarised to one row with partial aggregation, the summaries are scanned per key, and the
   value that enters each segment is joined back on (key, segment).

Step 2 and the join of step 3 use the same (key, segment) partitioning, so the wide rows are shuffled once however many
scans are chained. The summaries are smaller than the input by up to a factor of ``span``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most rows one (key, segment) group may hold.
SEGMENT_SPAN = 1 << 21

SEGMENT = "_segment"


def with_segment(df: DataFrame, arrival: str, span: int = SEGMENT_SPAN) -> DataFrame:
    """Add the segment number, unless an earlier scan of the same rows already did."""
    if SEGMENT in df.columns:
        return df
    return df.withColumn(SEGMENT, F.expr(f"`{arrival}` div {span}"))


def scan(
    df: DataFrame,
    keys: Sequence[str],
    arrival: str,
    *,
    prev: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    last_before: Mapping[str, Column] | None = None,
    running_max: Mapping[str, Column] | None = None,
    max_before: Mapping[str, Column] | None = None,
    running_sum: Mapping[str, Column] | None = None,
    span: int = SEGMENT_SPAN,
) -> DataFrame:
    """Add order-dependent columns, evaluated per key in arrival order.

    ``prev``: value of the previous row. ``last``: latest non-null value up to and including this row;
    ``last_before``: the same, this row excluded. ``running_max`` / ``max_before``: largest value so far with and
    without this row. ``running_sum``: sum so far, this row included, nulls as 0.

    The segment column stays on the result so that chained scans share one shuffle; drop it with :func:`finish`.
    """
    prev, last, last_before = dict(prev or {}), dict(last or {}), dict(last_before or {})
    running_max, max_before, running_sum = dict(running_max or {}), dict(max_before or {}), dict(running_sum or {})
    keys = list(keys)
    rows = with_segment(df, arrival, span)
    group = [*keys, SEGMENT]

    # plain values, not structs, so that numbers and times are aggregated by hash
    order = F.col(arrival)
    summaries: list[Column] = []
    for name, value in prev.items():
        summaries.append(F.max_by(value, order).alias("_s_" + name))
    for name, value in {**last, **last_before}.items():
        # max_by skips rows whose ordering value is null
        summaries.append(F.max_by(value, F.when(value.isNotNull(), order)).alias("_s_" + name))
    for name, value in {**running_max, **max_before}.items():
        summaries.append(F.max(value).alias("_s_" + name))
    for name, value in running_sum.items():
        summaries.append(F.sum(value).alias("_s_" + name))

    by_segment = across(keys)
    earlier = by_segment.rowsBetween(Window.unboundedPreceding, -1)
    carried: list[Column] = []
    for name in prev:
        carried.append(F.lag("_s_" + name).over(by_segment).alias("_c_" + name))
    for name in [*last, *last_before]:
        carried.append(F.last("_s_" + name, ignorenulls=True).over(earlier).alias("_c_" + name))
    for name in [*running_max, *max_before]:
        carried.append(F.max("_s_" + name).over(earlier).alias("_c_" + name))
    for name in running_sum:
        carried.append(F.sum("_s_" + name).over(earlier).alias("_c_" + name))
    carry = rows.groupBy(*group).agg(*summaries).select(*group, *carried)

    local = inside(keys, arrival)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    joined = carried_in(rows, carry, keys)

    out: dict[str, Column] = {}
    for name, value in prev.items():
        first = F.lag(F.lit(1)).over(local).isNull()
        out[name] = F.when(first, F.col("_c_" + name)).otherwise(F.lag(value).over(local))
    for name, value in last.items():
        out[name] = F.coalesce(F.last(value, ignorenulls=True).over(upto), F.col("_c_" + name))
    for name, value in last_before.items():
        out[name] = F.coalesce(F.last(value, ignorenulls=True).over(before), F.col("_c_" + name))
    for name, value in running_max.items():
        out[name] = F.greatest(F.max(value).over(upto), F.col("_c_" + name))
    for name, value in max_before.items():
        out[name] = F.greatest(F.max(value).over(before), F.col("_c_" + name))
    for name, value in running_sum.items():
        zero = F.lit(0)
        out[name] = F.coalesce(F.sum(value).over(upto), zero) + F.coalesce(F.col("_c_" + name), zero)
    return joined.select(*rows.columns, *[value.alias(name) for name, value in out.items()])


def finish(df: DataFrame) -> DataFrame:
    """Drop the helper column of the scans."""
    return df.drop(SEGMENT)


def two_level(
    df: DataFrame,
    keys: Sequence[str],
    arrival: str,
    *,
    local: Mapping[str, Column],
    summary: Mapping[str, Column],
    carry: Sequence[Mapping[str, Column]],
    span: int = SEGMENT_SPAN,
) -> DataFrame:
    """A scan whose carried value is itself derived from several summaries.

    ``local`` columns are windows over :func:`inside`; ``summary`` aggregates them per (key, segment); each mapping of
    ``carry`` adds columns over :func:`across` to the summaries, later ones reading earlier ones. Rows come back with the
    local and the last mapping's columns. One scan instead of two chained ones halves the reads of the input.
    """
    rows = with_segment(df, arrival, span).withColumns(dict(local))
    group = [*keys, SEGMENT]
    summaries = rows.groupBy(*group).agg(*[value.alias(name) for name, value in summary.items()])
    for step in carry:
        summaries = summaries.withColumns(dict(step))
    return carried_in(rows, summaries.select(*group, *carry[-1]), keys)


def carried_in(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the columns of their (key, segment) in ``carry``. Nulls in a key are equal to each other, as in grouping."""
    renamed = {k: f"_g_{k}" for k in [*keys, SEGMENT]}
    told = carry.withColumnsRenamed(renamed)
    same = F.col(SEGMENT) == F.col(renamed[SEGMENT])
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(renamed[key]))
    return rows.join(told, same, "left").drop(*renamed.values())


def inside(keys: Sequence[str], arrival: str):
    """Window over one (key, segment) in arrival order."""
    return Window.partitionBy(*keys, SEGMENT).orderBy(arrival)


def across(keys: Sequence[str]):
    """Window over the segment summaries of one key, in order."""
    return Window.partitionBy(*keys).orderBy(SEGMENT)
