"""Creature statistics: type counts, chosen types, distributions, radar rings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.numbers import ratio
from tablewright.operators import distribution as dist
from tablewright.operators.filters import as_list, optional_in
from tablewright.operators.reshape import ring, stacked

# The radar's spokes, and the attribute choices with the column(s) behind them.
SPOKES = ("HP", "Attack", "Defense", "Sp. Atk", "Sp. Def", "Speed")
ATTRIBUTES = {
    "HP": ("HP",),
    "Speed": ("Speed",),
    "Attack": ("Attack",),
    "Defense": ("Defense",),
    "Attack / Defense": ("Attack", "Defense"),
    "Sp. Attack": ("Sp. Atk",),
    "Sp. Defense": ("Sp. Def",),
    "Sp. Attack / Sp. Defense": ("Sp. Atk", "Sp. Def"),
}
DROPPED = ("Legendary", "Generation")
ALL = "All"


def cleaned(creatures: DataFrame) -> DataFrame:
    """The table without the columns no analysis uses."""
    return creatures.drop(*DROPPED)


def type_counts(creatures: DataFrame) -> DataFrame:
    """Creatures per type with a known number, sorted by type."""
    return (
        creatures.filter(F.col("`Type 1`").isNotNull())
        .groupBy(F.col("`Type 1`").alias("type"))
        .agg(F.count("`#`").alias("count"))
        .orderBy("type")
    )


def of_types(creatures: DataFrame, types: str | Iterable[str]) -> DataFrame:
    """Rows of the chosen types, one copy per choice: "All" adds the whole table."""
    chosen = list(dict.fromkeys(as_list(types)))
    named = [value for value in chosen if value != ALL]
    parts = [optional_in(creatures, "Type 1", named, on_empty="none")]
    if ALL in chosen:
        parts.append(creatures)
    return stacked(parts)


def with_attribute(creatures: DataFrame, attribute: str, name: str = "attribute") -> DataFrame:
    """Add the chosen attribute; a ratio choice divides its two columns."""
    columns = [F.col(f"`{column}`").cast("double") for column in ATTRIBUTES[attribute]]
    return creatures.withColumn(name, ratio(*columns) if len(columns) == 2 else columns[0])


def _binned(frame: DataFrame, group: str, value: str, bins: int | None):
    values = dist.present(frame, group, value)
    stats = dist.summary(values)
    few = dist.few_groups(stats)
    binned = dist.automatic_bins(values, stats, few) if bins is None else dist.fixed_bins(stats, bins)
    return values, stats, binned, few


def attribute_histogram(
    creatures: DataFrame, attribute: str, types: Iterable[str] | None = None, bins: int | None = None
) -> DataFrame:
    """Histogram of an attribute per type, each with its own automatic bins.

    Building the plan runs the pass that summarises the types, and further ones where bins are not certain.
    """
    rows = with_attribute(optional_in(creatures, "Type 1", types), attribute)
    values, _, binned, few = _binned(rows, "Type 1", "attribute", bins)
    return dist.histogram(values, binned, few)


def attribute_density(
    creatures: DataFrame,
    attribute: str,
    types: Iterable[str] | None = None,
    bins: int | None = None,
    points: int = dist.GRID_POINTS,
    bandwidth: float | None = None,
) -> DataFrame:
    """Density curve of an attribute per type, on the scale of its histogram.

    Runs the same passes as ``attribute_histogram`` while the plan is built.
    """
    rows = with_attribute(optional_in(creatures, "Type 1", types), attribute)
    return dist.density(*_binned(rows, "Type 1", "attribute", bins), points, bandwidth)


def radar(creatures: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Closed radar ring per creature."""
    return ring(optional_in(creatures, "Name", names), ["#", "Name"], SPOKES)
