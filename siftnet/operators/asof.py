"""As-of lookup of slowly changing facts.

Facts such as templates or sampling rates are announced over and over but rarely change. The times for which each value holds form
an index of intervals, cut at the borders of cells of the arrival order: a row finds its value by equality on (key, cell) and a
comparison with the few intervals there. The value that enters a cell is carried into it, so no row looks further back.

* A cell holds at most ``span`` rows and facts of all keys together, since arrival numbers are unique. Work is therefore bounded per
  cell, and grows in proportion to rows and facts, also for one key that has most of both.
* The index has an interval per change and one per (key, cell) that has rows. Spark sends it to all tasks while it is small and
  splits skewed keys otherwise; payloads of the rows are shuffled only in the second case.
* Everything is one plan: nothing is counted, written or run while it is built.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftnet.operators import segments

#: Most arrival numbers of one cell of the index.
INDEX_SPAN = 1 << 16
#: Cells of a key that are scanned together for the value carried into each.
CARRY_CELLS = 1 << 8

CELL = "_cell"


def intervals(places: DataFrame, facts: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """The index: ``keys``, cell, ``_from`` (null: from before the cell), ``_to`` (null: beyond it) and ``value``.

    Both inputs carry their cell. Facts and one marker per (key, cell) of ``places`` make one timeline, which is shuffled once; markers
    come first in their cell and stand for the value carried into it. Cells without a marker are of no use to any row.
    """
    place = [*keys, CELL]
    told = facts.select(*place, order, F.struct(F.col(value).alias("v")).alias("_held"))
    marker = [F.lit(None).cast(told.schema[c].dataType).alias(c) for c in (order, "_held")]
    timeline = told.unionByName(places.select(*place).distinct().select(*place, *marker))
    timeline = timeline.withColumn(segments.SEGMENT, F.expr(f"{CELL} div {CARRY_CELLS}")).repartition(*keys, segments.SEGMENT)
    placed = timeline.withColumn("_at", F.struct(CELL, order))
    known = segments.scan(placed, keys, "_at", last={"_known": F.col("_held")})

    in_cell = Window.partitionBy(*keys, segments.SEGMENT, CELL)
    ordered = in_cell.orderBy("_at")
    first = F.lag(F.lit(1)).over(ordered).isNull()
    changed = F.col("_known").isNotNull() & (first | ~F.col("_known").eqNullSafe(F.lag("_known").over(ordered)))
    told_apart = known.withColumns({"_changed": changed, "_asked": F.bool_or(F.col(order).isNull()).over(in_cell)})
    kept = told_apart.where("_changed and _asked").withColumn("_to", F.lead(order).over(ordered))
    return kept.select(*place, F.col(order).alias("_from"), "_to", F.col("_known.v").alias(value))


def changes(
    facts: DataFrame,
    *,
    keys: Sequence[str],
    order: str,
    value: str,
    arrival: str | None = None,
    span: int = INDEX_SPAN,
    kept: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """``facts`` without repeats that tell nothing new: an :func:`index` of the same span is the same without them.

    Where the facts of a (key, cell) have one value each in a time of its own, the first of each value is enough, and aggregates that start
    in the scan find it. Only cells whose values alternate keep all their facts. ``kept`` may write the aggregates, which are read twice:
    Spark then sees how few cells alternate before it would shuffle the facts to them.
    """
    place = [*keys, CELL]
    placed = facts.withColumn(CELL, F.expr(f"`{arrival or order}` div {span}"))
    runs = placed.groupBy(*place, value).agg(F.min(order).alias(order), F.max(order).alias("_last"))
    before = F.max("_last").over(Window.partitionBy(*place).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    judged = runs.withColumn("_meets", F.coalesce(F.col(order) <= before, F.lit(False)))
    judged = kept(judged.withColumn("_meets", F.bool_or("_meets").over(Window.partitionBy(*place))))
    mixed = judged.where("_meets").select(*[F.col(c).alias(f"_m_{c}") for c in place]).distinct()
    match = F.lit(True)
    for c in place:
        match = match & F.col(c).eqNullSafe(F.col(f"_m_{c}"))
    names = [*keys, order, value]
    return judged.where("not _meets").select(*names).unionByName(placed.join(mixed, match, "left_semi").select(*names))


def index(
    facts: DataFrame, places: DataFrame, *, keys: Sequence[str], order: str, value: str, arrival: str | None = None, span: int = INDEX_SPAN
) -> DataFrame:
    """The intervals for rows in ``places`` (rows with ``keys`` and ``arrival``); see :func:`latest`. It is small, and may serve several lookups."""
    cell = F.expr(f"`{arrival or order}` div {span}")
    return intervals(places.withColumn(CELL, cell), facts.withColumn(CELL, cell), keys, order, value)


def looked_up(
    rows: DataFrame, intervals_: DataFrame, *, keys: Sequence[str], order: str, value: str, arrival: str | None = None, span: int = INDEX_SPAN
) -> DataFrame:
    """``rows`` with the ``value`` that an :func:`index` of the same span holds for them."""
    theirs = {c: f"_i_{c}" for c in [*keys, CELL]}
    known = intervals_.withColumnsRenamed(theirs).withColumnRenamed(value, "_i_value")
    match = F.col(CELL) == F.col(theirs[CELL])
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(theirs[key]))
    match = match & (F.col("_from").isNull() | (F.col(order) >= F.col("_from"))) & (F.col("_to").isNull() | (F.col(order) < F.col("_to")))
    asked = rows.withColumn(CELL, F.expr(f"`{arrival or order}` div {span}"))
    return asked.join(known, match, "left").select(*rows.columns, F.col("_i_value").alias(value))


def latest(
    rows: DataFrame,
    facts: DataFrame,
    *,
    keys: Sequence[str],
    order: str,
    value: str,
    arrival: str | None = None,
    places: DataFrame | None = None,
    span: int = INDEX_SPAN,
) -> DataFrame:
    """Add ``value``: that of the key's newest fact whose order is not after the row's; null without one.

    ``facts`` hold ``keys``, ``order`` and ``value``; nulls in a key are equal to each other. ``arrival`` is the number whose runs of
    ``span`` make the cells and that grows with ``order`` (``order`` itself if not given); all inputs have it. ``places`` are rows with
    ``keys`` and ``arrival`` that cover those of ``rows``, for callers that have them without computing all of ``rows`` again.
    """
    how = {"keys": keys, "order": order, "value": value, "arrival": arrival, "span": span}
    return looked_up(rows, index(facts, rows if places is None else places, **how), **how)
