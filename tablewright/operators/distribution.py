"""Exact quantiles, histograms and density curves per group.

One pass over the rows counts each group in cells by the magnitude of the value.  From the cells come the group's
count, bounds and deviation, and for each wanted rank the cell that holds it, whose least and greatest value
bracket the quantile; no estimate is involved.  Where a bracket is too wide, further passes count its
sub-ranges and narrow it, until it is a single value or the result no longer depends on it.

Facts of a group are one row per group.  They meet the raw rows where these lie: few groups are broadcast, and
many take a plain join, which adaptive execution splits where one group dominates.  What is then grouped, by
sub-range, bin or box, is combined before it is shuffled, so a fact never crosses the network row by row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.joins import GROUPS, join_groups
from tablewright.sources.intermediates import stored

GRID_POINTS = 200
QUARTILES = (0.25, 0.75)
# Cells per factor of e, and sub-ranges of a bracket in one round.
CELLS = 1024
PIECES = 1024
# Boxes of the density have this half-width, in bandwidths; further than the reach nothing is added.
HALF_BOX = 1 / 16
REACH = 24.0
ERROR = 1e-9


def present(frame: DataFrame, group: str, value: str) -> DataFrame:
    """``(group, value)`` of the rows in which neither is missing."""
    rows = frame.select(F.col(f"`{group}`").alias("group"), F.col(f"`{value}`").cast("double").alias("value"))
    return rows.filter(F.col("group").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))


def _cell(value: Column) -> Column:
    """A number that rises with the value, by its sign and the logarithm of its magnitude."""
    magnitude = F.floor(F.log(F.greatest(F.abs(value), F.lit(1e-300))) * CELLS) + 1000 * CELLS
    return F.when(value > 0, magnitude).when(value < 0, -magnitude).otherwise(0)


def summary(values: DataFrame, probabilities: Sequence[float] = QUARTILES) -> DataFrame:
    """Per group, from one pass: row count, bounds, sample deviation, and a bracket per wanted rank.

    A quantile lies between the values of two ranks (``share`` of the way), so ``brackets`` has two for each
    probability: the least and the greatest value of the cell that holds the rank.  The result is
    written, as several later steps read it.
    """
    cells = values.groupBy("group", _cell(F.col("value")).alias("cell")).agg(
        F.count("*").alias("n"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count("*")).alias("squares"),
    )
    whole = Window.partitionBy("group")
    placed = cells.withColumns(
        {
            "upto": F.sum("n").over(whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "total": F.sum("n").over(whole),
            "middle": F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole),
        }
    )
    ranks = [(p, step) for p in probabilities for step in (0, 1)]
    rank = "least(total - 1, cast(floor(total * {0}D - {0}D) AS bigint) + {1})"
    found = [
        F.max(F.expr(f"CASE WHEN upto - n <= {rank.format(p, step)} AND {rank.format(p, step)} < upto THEN struct(low, high) END"))
        for p, step in ranks
    ]
    spread = F.sum(F.expr("squares + n * (mean - middle) * (mean - middle)"))
    grouped = placed.groupBy("group", "total").agg(
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        spread.alias("_squares"),
        *[cell.alias(f"_at{i}") for i, cell in enumerate(found)],
    )
    brackets = [
        f"struct({i} AS at, {float(p)!r}D AS probability, {rank.format(p, step)} AS rank, _at{i}.low AS `from`, _at{i}.high AS `to`)"
        for i, (p, step) in enumerate(ranks)
    ]
    return stored(
        grouped.selectExpr(
            "group",
            "total",
            "low",
            "high",
            "sqrt(try_divide(_squares, total - 1)) AS deviation",
            f"array({', '.join(brackets)}) AS brackets",
        ),
        "group-summary",
    )


def few_groups(stats: DataFrame) -> bool:
    """Whether a summary has few enough groups to be broadcast."""
    return stats.count() <= GROUPS


def narrowed(values: DataFrame, stats: DataFrame, few: bool) -> DataFrame:
    """The summary after one more pass, which counts ``PIECES`` sub-ranges of every bracket wider than a value.

    Values below and above a bracket are counted too, so a rank is found wherever it lies, also outside a
    bracket that was wrong.  The sub-range that holds the rank, from its least to its greatest value, is the
    new bracket; least and greatest value of a bracket part, so every round narrows it.
    """
    open_ones = stats.select("group", F.expr("filter(brackets, b -> b.`from` < b.`to`)").alias("asked")).filter("size(asked) > 0")
    share = "(value / 2 - `from` / 2) / (`to` / 2 - `from` / 2)"
    piece = f"CASE WHEN value < `from` THEN -1 WHEN value > `to` THEN {PIECES} ELSE int(least({PIECES - 1}, {share} * {PIECES})) END"
    counted = (
        join_groups(values, open_ones, "group", few)
        .select("group", "value", F.inline("asked"))
        .groupBy("group", "at", "rank", F.expr(piece).alias("piece"))
        .agg(F.count("*").alias("n"), F.min("value").alias("from"), F.max("value").alias("to"))
    )
    before = Window.partitionBy("group", "at").orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        counted.withColumn("upto", F.sum("n").over(before))
        .filter("upto - n <= rank AND rank < upto")
        .groupBy("group")
        .agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("from", "to")))).alias("found"))
    )
    better = "transform(brackets, b -> struct(b.at, b.probability, b.rank, coalesce(found[b.at].`from`, b.`from`) AS `from`, coalesce(found[b.at].`to`, b.`to`) AS `to`))"
    joined = stats.join(F.broadcast(found) if few else found, "group", "left")
    return stored(joined.withColumn("brackets", F.expr(better)).select(*stats.columns), "group-summary")


def group_quantiles(values: DataFrame, stats: DataFrame, few: bool) -> DataFrame:
    """Exact, linearly interpolated quantiles: one row per group and probability of ``summary``.

    Brackets are narrowed until each is one value.
    """
    while not stats.filter("exists(brackets, b -> b.`from` < b.`to`)").isEmpty():
        stats = narrowed(values, stats, few)
    pairs = stats.select("*", F.inline(F.expr("transform(filter(brackets, b -> b.at % 2 = 0), b -> struct(b.at, b.probability))")))
    return pairs.selectExpr("group", "total", "low", "high", "deviation", "probability", f"{_between('at', 'from')} AS quantile")


def _between(at: str, end: str) -> str:
    """The quantile behind the brackets ``at`` and ``at + 1`` if both ranks had the values at this end."""
    first, second = f"brackets[{at}].`{end}`", f"brackets[{at} + 1].`{end}`"
    part = f"pmod(total * brackets[{at}].probability - brackets[{at}].probability, 1D)"
    return f"({first} * (1 - {part}) + {second} * {part})"


def automatic_bins(values: DataFrame, stats: DataFrame, few: bool) -> DataFrame:
    """Number, first edge and width of bins: the finer of the Sturges and Freedman-Diaconis rules.

    With no spread between the quartiles Sturges decides alone; with no spread at all there is
    one bin of width 1 around the value.  The number of bins falls as the quartiles part, so it is certain
    once both ends of their brackets give the same; only groups where they differ need another pass.
    ``stats`` is a summary with the quartiles.
    """
    while True:
        ends = stats.selectExpr(
            "*",
            f"greatest({_between('2', 'from')} - {_between('0', 'to')}, 0D) AS least_iqr",
            f"{_between('2', 'to')} - {_between('0', 'from')} AS most_iqr",
        )
        bins = ends.selectExpr("*", f"{_bins('least_iqr')} AS bins", f"{_bins('most_iqr')} AS fewest")
        certain = "bins = fewest AND (least_iqr > 0 OR most_iqr = 0)"
        if bins.filter(f"NOT ({certain})").isEmpty():
            return _edges(bins.drop("least_iqr", "most_iqr", "fewest"))
        stats = narrowed(values, stats, few)


def _bins(iqr: str) -> str:
    sturges = "ceil(log2(cast(total AS double)) + 1)"
    freedman = f"ceil(try_divide(high - low, 2 * {iqr} * pow(cast(total AS double), -1D / 3)))"
    return f"CASE WHEN low = high THEN 1L ELSE greatest({sturges}, {freedman}) END"


def _edges(bins: DataFrame) -> DataFrame:
    return bins.selectExpr(
        "*",
        "CASE WHEN low = high THEN low - 0.5D ELSE low END AS start",
        "CASE WHEN low = high THEN 1D ELSE high - low END / bins AS width",
    )


def fixed_bins(stats: DataFrame, bins: int) -> DataFrame:
    """The same columns for a chosen number of bins."""
    return _edges(stats.withColumn("bins", F.lit(bins).cast("bigint")))


def histogram(values: DataFrame, binned: DataFrame, few: bool) -> DataFrame:
    """Rows per group and bin; bins without rows are left out.

    Bins are closed on the left and open on the right, the last one closed on both sides.
    """
    number = """CASE WHEN value < start + guess * width THEN guess - 1
                     WHEN value >= start + (guess + 1) * width AND guess < bins - 1 THEN guess + 1
                     ELSE guess END"""
    return (
        join_groups(values, binned.select("group", "bins", "start", "width"), "group", few)
        .withColumn("guess", F.expr("least(bins - 1, floor((value - start) / width))"))
        .groupBy("group", "bins", "start", "width", F.expr(number).alias("bin"))
        .agg(F.count("*").alias("count"))
        .selectExpr(
            "group",
            "bins",
            "bin",
            "start + bin * width AS bin_start",
            "start + (bin + 1) * width AS bin_end",
            "count",
        )
    )


def terms(error: float = ERROR) -> int:
    """How many moments keep the relative error of every contribution within ``error``.

    At a distance of y bandwidths, what the moments from p on would add is at most (y r)**p / p! * exp(2 y r) of
    the contribution itself, r being the half-width of a box; y is at most the reach.
    """
    reach, p = REACH * HALF_BOX, 1
    while reach**p / math.factorial(p) * math.exp(2 * reach) > error:
        p += 1
    return p


def density(
    values: DataFrame,
    stats: DataFrame,
    binned: DataFrame,
    few: bool,
    points: int = GRID_POINTS,
    bandwidth: float | None = None,
    reach: float = REACH,
    error: float = ERROR,
) -> DataFrame:
    """Gaussian density per group on an even grid from lowest to highest value.

    Bandwidth is Scott's rule (sample deviation times n ** -1/5) unless given as a factor of the
    deviation.  The curve is scaled to the area of the histogram, so both share one axis.  Groups
    with fewer than two rows or without spread have no curve.

    A fast Gauss transform: values fall into boxes an eighth of a bandwidth wide, and a box keeps the
    moments of its values, weighted by their kernel at the middle of the box, which are summed in the stage that reads
    the values.  From the moments follows what the box adds to each grid point.  Every contribution is
    exact to the relative ``error``.  Boxes further than ``reach`` bandwidths from a point add nothing to
    it; at the default of 24 that is less than 1e-125 of a value's own peak.
    """
    if not 0 < reach <= REACH:
        raise ValueError(f"reach must be above 0 and at most {REACH}")
    factor = repr(float(bandwidth)) + "D" if bandwidth else "pow(cast(total AS double), -0.2D)"
    shape = ("group", "low", f"deviation * {factor} AS h", f"(high - low) / {points - 1} AS step")
    spread = "total > 1 AND deviation > 0"
    box, count = 2 * HALF_BOX, terms(error)
    powers = ["exp(-0.5D * t * t)"]
    for k in range(1, count):
        powers.append(f"m{k - 1} * t / {k}")
    moments = (
        join_groups(values, stats.filter(spread).selectExpr(*shape), "group", few)
        .selectExpr("group", "low", "step", "h", "(value - low) / h AS place", f"floor((value - low) / h / {box}D) AS box")
        .selectExpr("group", "low", "step", "h", "box", f"place - (box + 0.5D) * {box}D AS t")
    )
    for k, power in enumerate(powers):
        moments = moments.withColumn(f"m{k}", F.expr(power))
    summed = moments.groupBy("group", "step", "h", "box").agg(*[F.sum(f"m{k}").alias(f"m{k}") for k in range(count)])
    middle, far = f"(box + 0.5D) * {box}D", f"{float(reach)!r}D"
    first = f"cast(greatest(0, ceil(({middle} - {far}) * h / step)) AS bigint)"
    last = f"cast(least({points - 1}, floor(({middle} + {far}) * h / step)) AS bigint)"
    series = f"m{count - 1}"
    for k in reversed(range(count - 1)):
        series = f"({series} * y + m{k})"
    sums = (
        summed.filter(f"{first} <= {last}")
        .selectExpr("*", f"explode(sequence({first}, {last})) AS point")
        .withColumn("y", F.expr(f"point * step / h - {middle}"))
        .groupBy("group", "point")
        .agg(F.sum(F.expr(f"exp(-0.5D * y * y) * {series}")).alias("mass"))
    )
    grid = binned.filter(spread).selectExpr(*shape, "width").selectExpr("*", f"explode(sequence(0L, {points - 1}L)) AS point")
    return grid.join(sums, ["group", "point"], "left").selectExpr(
        "group",
        "cast(point AS int) AS point",
        "low + point * step AS x",
        f"coalesce(mass, 0D) * width / (h * {math.sqrt(2 * math.pi)!r}D) AS density",
    )
