"""Running totals and neighbours that survive a very large partition.

A plain window sorts each partition in one task, which fails once one key holds a large share of all
rows.  Here a key with more rows than a task's share is cut into blocks along the order.  Its borders are
sampled order values, all columns of the order compared, so equal values of the first are cut by the next,
and any values are cut evenly, however far apart.  A window works inside each block, and what lies before a
block comes from the blocks' own sums, of which there are no more than tasks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.filters import with_keys
from tablewright.sources.intermediates import stored, stored_and_counted

# No key of up to so many rows is cut.
BLOCK_ROWS = 65_536
# Sampled rows per block.
SAMPLES = 64


@dataclass(frozen=True)
class Keyed:
    """Rows by key, and the keys to be cut with the number of their blocks (``large``, if there are any).

    ``known`` are the same rows, perhaps with fewer columns, from which borders and blocks' sums are read.
    """

    rows: DataFrame
    known: DataFrame
    keys: tuple[str, ...]
    total: int
    tasks: int
    large: DataFrame | None

    def with_rows(self, rows: DataFrame) -> Keyed:
        """The same rows with more columns."""
        return replace(self, rows=rows)


def keyed(frame: DataFrame, keys: Sequence[str], store: bool = True) -> Keyed:
    """Count the rows of each key, which is what decides on its blocks.

    A share is what each of ``spark.sql.shuffle.partitions`` tasks would have of all rows, ``BLOCK_ROWS`` at
    least, so no more keys than tasks have more, and only these come to the driver.  ``store`` writes
    the rows first, so that a join behind them runs once; a bare table needs no copy.  Rows with
    a NULL key belong to no entity and are left out.
    """
    spark = frame.sparkSession
    rows = with_keys(frame, keys)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if store:
        rows, total = stored_and_counted(rows, "keyed-rows")
        counts = rows.groupBy(*keys).agg(F.count("*").alias("__rows"))
    else:
        counts = stored(rows.groupBy(*keys).agg(F.count("*").alias("__rows")), "key-counts")
        total = counts.agg(F.sum("__rows")).first()[0] or 0
    share = max(BLOCK_ROWS, math.ceil(total / tasks))
    over = counts.filter(F.col("__rows") > share).withColumn("__blocks", F.ceil(F.col("__rows") / share).cast("int"))
    found = over.drop("__rows").collect() if total > share else []
    large = spark.createDataFrame(found, over.drop("__rows").schema) if found else None
    return Keyed(rows, rows, tuple(keys), total, tasks, large)


def _ascending(order: Sequence[str]) -> list[Column]:
    return [F.col(name).asc_nulls_last() for name in order]


def _order_key(order: Sequence[str]) -> Column:
    """The order as one comparable value that is never NULL and has missing values last."""
    fields = [part for name in order for part in (F.col(name).isNull(), F.col(name))]
    return F.struct(*[field.alias(f"f{i}") for i, field in enumerate(fields)])


def _borders(of: Keyed, order: Sequence[str]) -> DataFrame:
    """Per large key the sampled order values at which its blocks begin, but for the first."""
    rate = min(1.0, SAMPLES * of.tasks / of.total)
    place = lambda i: (i * F.size("__sample") / F.col("__blocks")).cast("int")
    sampled = of.known.filter(F.rand(7) < rate) if rate < 1 else of.known
    return stored(
        sampled.join(F.broadcast(of.large), list(of.keys))
        .groupBy(*of.keys, "__blocks")
        .agg(F.sort_array(F.collect_list(_order_key(order))).alias("__sample"))
        .select(*of.keys, F.transform(F.sequence(F.lit(1), F.col("__blocks") - 1), lambda i: F.get("__sample", place(i))).alias("__borders")),
        "block-borders",
    )


def _in_blocks(of: Keyed, rows: DataFrame, borders: DataFrame, order: Sequence[str], how: str) -> DataFrame:
    """Rows with ``__block``: how many borders of their key lie at or before them, by binary search."""
    at = F.col("__borders")
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(of.tasks.bit_length()))])
    past = lambda low, step: F.get(at, low + step - 1) <= F.col("__key")
    block = F.reduce(halves, F.lit(0), lambda low, step: F.when(past(low, step), low + step).otherwise(low))
    return (
        rows.join(F.broadcast(borders), list(of.keys), how)
        .withColumn("__key", _order_key(order))
        .withColumn("__block", F.when(at.isNull(), 0).otherwise(block))
        .drop("__borders", "__key")
    )


def running_totals(of: Keyed, order: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Add, for each entry of ``totals``, its running sum in ``order`` within each key.

    ``order`` must be total.  Whole numbers are exact.  Doubles of a key that is cut are added block
    by block, so they can differ from a sum in row order by its rounding: at most the number of rows times
    2**-53, relative to the sum of absolute values.
    """
    columns = of.rows.columns

    def summed(*path: str) -> dict[str, Column]:
        upto = Window.partitionBy(*path).orderBy(*_ascending(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return {f"__in_{name}": F.sum(what).over(upto) for name, what in totals.items()}

    if of.large is None:
        within = of.rows.withColumns(summed(*of.keys))
        return within.select(*columns, *[F.col(f"__in_{name}").alias(name) for name in totals])
    borders, path = _borders(of, order), [*of.keys, "__block"]
    sums = _in_blocks(of, of.known, borders, order, "inner").groupBy(*path)
    earlier = Window.partitionBy(*of.keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.agg(*[F.sum(what).alias(f"__{name}") for name, what in totals.items()]).select(
        *path, *[F.sum(f"__{name}").over(earlier).alias(f"__{name}") for name in totals]
    )
    within = _in_blocks(of, of.rows, borders, order, "left").withColumns(summed(*path))
    return within.join(F.broadcast(before), path, "left").select(
        *columns, *[_add(F.col(f"__in_{name}"), F.col(f"__{name}")).alias(name) for name in totals]
    )


def _add(left: Column, right: Column) -> Column:
    """Sum that skips a NULL side, as SUM over both sets of rows would."""
    return F.coalesce(left + right, left, right)


def previous_value(of: Keyed, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add ``name``: ``value`` of the row before, in ``order`` within each key.

    The first row of a block takes the last value of the block before it.
    """
    columns = of.rows.columns
    if of.large is None:
        before = F.lag(value).over(Window.partitionBy(*of.keys).orderBy(*_ascending(order)))
        return of.rows.select(*columns, before.alias(name))
    borders, path = _borders(of, order), [*of.keys, "__block"]
    ends = _in_blocks(of, of.known, borders, order, "inner").groupBy(*path).agg(F.max_by(value, _order_key(order)).alias("__last"))
    carried = ends.select(*path, F.lag("__last").over(Window.partitionBy(*of.keys).orderBy("__block")).alias("__carry"))
    inside = Window.partitionBy(*path).orderBy(*_ascending(order))
    marked = _in_blocks(of, of.rows, borders, order, "left").withColumns(
        {"__first": F.row_number().over(inside) == 1, "__before": F.lag(value).over(inside)}
    )
    return marked.join(F.broadcast(carried), path, "left").select(
        *columns, F.when(F.col("__first"), F.col("__carry")).otherwise(F.col("__before")).alias(name)
    )


def cyclic_successor(values: DataFrame, column: str, name: str) -> DataFrame:
    """For a small set of distinct values: the next one, the last wrapping to the first.

    The window has no partition key, so ``values`` must be a bounded set such as years.
    """
    everything = Window.orderBy(column)
    first = F.min(column).over(Window.partitionBy())
    return values.withColumn(name, F.coalesce(F.lead(column).over(everything), first))
