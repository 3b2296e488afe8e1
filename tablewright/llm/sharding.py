"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual`` points of a 64-bit ring, and a document belongs to the arc that ends
at the next point clockwise.  A shard takes what its arcs offer until it is full; what it cannot take
goes on clockwise, point by point, to the next shard with room.

Spark counts the documents per arc (shards x virtual numbers, whatever the corpus); the driver deals
those counts, round by round: in round r every arc offers what it has left to the r-th point from its
own, arcs in ring order, earlier positions first.  An arc only goes on past a shard that became full, so
the result has at most one piece per arc and one per shard.  That list, bounded in the same way, is
broadcast, and a document's rank within its arc says which piece it is in.  Ranks are running counts;
an arc with more than a task's share, as where equal rows without id share a position, is ranked in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import stored, text_or_empty
from tablewright.operators.windows import keyed, running_totals

OVERHEAD = 16


def ring(shards: int, virtual: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions of all points and the shard that owns each."""
    points = [
        (xxhash.xxh64_intdigest(f"{shard}/{copy}", seed) - (1 << 63), shard) for shard in range(shards) for copy in range(virtual)
    ]
    points.sort()
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int64)


def arc_of(position: Column, points: np.ndarray) -> Column:
    """Which point comes next clockwise, at the position itself or after."""

    @F.pandas_udf("int")
    def next_point(at: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(points, at.to_numpy(np.int64)) % len(points)).astype(np.int32))

    return next_point(position)


def capacities(total: int, shards: int, load_factor: float) -> list[int]:
    """At factor 1 full shards hold counts that are at most one apart; above it all get the same bound."""
    if load_factor == 1:
        return [total // shards + (shard < total % shards) for shard in range(shards)]
    return [int(np.ceil(load_factor * total / shards))] * shards


def deal(counts: dict[int, int], owners: np.ndarray, room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``arc, from_rank, to_rank, shard, first_slot`` of all arcs' documents."""
    room, used, pieces = list(room), [0] * len(room), []
    waiting = [(arc, 0, n) for arc, n in sorted(counts.items()) if n]
    step = 0
    while waiting:
        after = []
        for arc, begin, end in waiting:
            shard = int(owners[(arc + step) % len(owners)])
            taken = min(end - begin, room[shard])
            if taken:
                pieces.append((arc, begin, begin + taken, shard, used[shard]))
                room[shard] -= taken
                used[shard] += taken
            if begin + taken < end:
                after.append((arc, begin + taken, end))
        waiting, step = after, step + 1
    return pieces


def assign(docs: DataFrame, shards: int = 40, virtual: int = 256, load_factor: float = 1.0, seed: int = 5) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, shard, slot``.

    ``size`` is the text's bytes plus 16 (NULL: 16), ``slot`` counts the documents of a shard from 0
    without gaps.  At ``load_factor`` 1 shards differ by one document at most; a larger factor bounds
    every shard by that multiple of the mean and moves fewer documents when shards are added.  Rows
    with equal id and text share a position and take neighbouring ranks; NULL ids are placed by their
    text.  Very long texts count with all their bytes.  Other columns are ignored whatever their names.  An empty
    table gives an empty result.
    """
    if load_factor < 1:
        raise ValueError("shards together have to hold all documents: load_factor >= 1")
    points, owners = ring(shards, virtual, seed)
    body = text_or_empty("text")
    rows = docs.select(
        "doc_id",
        (F.octet_length(body) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("_at", F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32"))
    rows = rows.withColumns({"_arc": arc_of(F.col("_at"), points), "_number": F.monotonically_increasing_id()})
    rows = stored(rows, "ring-positions")
    counts = {row["_arc"]: row["n"] for row in rows.groupBy("_arc").agg(F.count("*").alias("n")).collect()}
    pieces = deal(counts, owners, capacities(sum(counts.values()), shards, load_factor))
    schema = "_arc int, _begin bigint, _end bigint, shard int, _slot bigint"
    table = docs.sparkSession.createDataFrame(pieces, schema)
    order = ["_at", "doc_id", "size", "text_crc32", "_number"]
    ranked = running_totals(keyed(rows, ["_arc"], store=False), order, {"_upto": F.lit(1)})
    ranked = ranked.withColumn("_rank", F.col("_upto").cast("bigint") - 1)
    placed = ranked.join(
        F.broadcast(table),
        (ranked["_arc"] == table["_arc"]) & (F.col("_rank") >= F.col("_begin")) & (F.col("_rank") < F.col("_end")),
    )
    slot = F.col("_slot") + F.col("_rank") - F.col("_begin")
    return placed.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))
