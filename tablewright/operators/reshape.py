"""Wide-to-long shapes and unions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.text import card_label


def labelled_counts(
    frame: DataFrame, ids: Sequence[str], labels: Mapping[str, str], label: str, value: str
) -> DataFrame:
    """One row per (id, measure) with a display label and the measure's place in the list."""
    entries = [
        F.struct(F.lit(place).alias("place"), F.lit(text).alias(label), F.col(name).alias(value))
        for place, (name, text) in enumerate(labels.items(), start=1)
    ]
    return frame.select(*ids, F.inline(F.array(*entries)))


def cards(frame: DataFrame) -> DataFrame:
    """Each column of a one-row result as ``(place, label, value)``."""
    entries = [
        F.struct(
            F.lit(place).alias("place"),
            card_label(F.lit(name)).alias("label"),
            F.col(f"`{name}`").cast("double").alias("value"),
        )
        for place, name in enumerate(frame.columns, start=1)
    ]
    return frame.select(F.inline(F.array(*entries)))


def ring(frame: DataFrame, ids: Sequence[str], spokes: Sequence[str]) -> DataFrame:
    """Closed ring: every spoke in turn and the first once more, each with its angle.

    The angles divide the circle by the number of points, the repeated one included.
    """
    points = [*spokes, spokes[0]]
    entries = [
        F.struct(F.lit(name).alias("spoke"), F.col(f"`{name}`").cast("double").alias("value"))
        for name in points
    ]
    return (
        frame.select(*ids, F.posexplode(F.array(*entries)).alias("position", "entry"))
        .select(
            *ids,
            "position",
            F.col("entry.spoke").alias("spoke"),
            F.col("entry.value").alias("value"),
            (F.lit(2 * math.pi) * F.col("position") / F.lit(len(points))).alias("angle"),
        )
    )


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union of frames with the same columns."""
    return reduce(DataFrame.unionByName, frames)
