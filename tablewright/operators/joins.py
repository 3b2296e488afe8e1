"""Join shapes shared by the analyses.

A side is broadcast on request only where the plan itself bounds its rows.  Everywhere else the
choice is left to measured sizes: file statistics before the run, stage sizes during it.  What
those cannot help with is a key that owns a large share of one side, hence the shapes below.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.filters import with_keys

GROUPS = 10_000
CODES = 1000
# A Bloom filter has so many bits per id and hashes, and at most so many 64-bit words (8 MB).
ID_BITS = 16
ID_HASHES = 4
ID_WORDS = 1 << 20


def keep_existing(frame: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``frame`` with a match among the many copies in ``keys`` (an EXISTS subquery).

    ``keys`` is reduced to distinct values first, which Spark combines on the map side, so a key
    with very many copies costs one row per task in the shuffle.  ``frame`` should itself have
    few rows per key.
    """
    return frame.join(keys.select(on).distinct(), on, "left_semi")


def keep_known(frame: DataFrame, dimension: DataFrame, on: str) -> DataFrame:
    """Rows of ``frame`` whose key is in a dimension that lists each key once.

    Both sides meet straight from their shuffles, the form in which adaptive execution can split
    a key that owns much of ``frame``.
    """
    return frame.join(dimension.select(on), on, "left_semi")


def id_filter(ids: DataFrame, key: str, rows: int) -> Callable[[Column], Column] | None:
    """A test that every id of ``ids`` passes and about one in 400 others: a Bloom filter for ``rows`` ids.

    It is a scalar subquery, so it runs where a fact is scanned, before its shuffle; an exact join has to follow.
    The filter is one array, sized by the count.  More ids than ``ID_WORDS`` can hold get none, as nearly all
    rows would pass.
    """
    words = 1
    while words * 64 < rows * ID_BITS:
        words *= 2
    if words > ID_WORDS:
        return None
    kind = ids.schema[key].dataType

    def places(column: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(column.cast(kind), F.lit(i)), F.lit(words * 64)) for i in range(ID_HASHES)]

    word = lambda place: F.shiftright(place, 6)
    bit = lambda place: place.bitwiseAND(F.lit(63)).cast("int")
    set_bits = (
        ids.select(F.explode(F.array(*places(F.col(key)))).alias("place"))
        .groupBy(word(F.col("place")).alias("id"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(F.col("place")))).alias("bits"))
    )
    every = ids.sparkSession.range(words).join(F.broadcast(set_bits), "id", "left")
    rows_of = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))))
    whole = every.agg(rows_of.alias("words")).select(F.col("words.bits").alias("words"))

    def might_hold(column: Column) -> Column:
        test = F.lit(True)
        for place in places(column):
            test = test & (F.getbit(F.get(whole.scalar(), word(place).cast("int")), bit(place)) == 1)
        return test

    return might_hold


def fits_broadcast(frame: DataFrame) -> bool:
    """Whether the planner's own estimate of ``frame`` is within ``spark.sql.autoBroadcastJoinThreshold``.

    A join to such a side cuts the other where it is read, without a shuffle.  The estimate runs no job.
    """
    limit = frame.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit


def with_codes(frame: DataFrame, dimension: DataFrame, on: str, key: str, chosen: Sequence) -> DataFrame:
    """Rows of ``frame`` whose code ``on`` is in ``dimension[key]`` and, if any is chosen, among ``chosen``.

    A chosen list bounds the codes to its own length, so that case broadcasts them and the fact is
    not shuffled by code, of which there are few.
    """
    codes = dimension.select(F.col(key).alias(on))
    if not chosen:
        return keep_known(frame, codes, on)
    known = codes.filter(F.col(on).isin(list(chosen))).distinct()
    return frame.join(F.broadcast(known) if len(chosen) <= CODES else known, on, "left_semi")


def band_lookup(frame: DataFrame, bands: DataFrame, key: str) -> DataFrame:
    """Inner equi-join to a band table that has one row per integer value."""
    return frame.join(bands, key, "inner")


def few_values(rows: DataFrame, key: str) -> bool:
    """Whether ``key`` has at most ``GROUPS`` different values, by a sketch over ``rows``."""
    return rows.agg(F.approx_count_distinct(key)).first()[0] <= GROUPS


def join_groups(rows: DataFrame, facts: DataFrame, key: str, few: bool) -> DataFrame:
    """Inner join of ``rows`` to one row of ``facts`` per value of ``key``.

    ``few`` comes from ``few_values``: the facts are then broadcast and no row moves.  Otherwise both
    sides are shuffled.
    """
    return rows.join(F.broadcast(facts), key) if few else join_splittable(rows, facts, [key])


def join_splittable(rows: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join to ``facts``, few rows per key, where one key may own a large share of ``rows``.

    Needed where ``facts`` comes out of an aggregate or join by the same keys.  Being partitioned
    already, it would meet ``rows`` without a shuffle of its own, and adaptive execution splits a
    dominant key only between two shuffles.  Comparing the keys as a struct gives ``facts``, the
    small side, that shuffle.
    """
    other = {key: f"__{key}" for key in keys}
    known = with_keys(rows, keys)
    match = F.struct(*keys) == F.struct(*[F.col(other[key]).alias(key) for key in keys])
    return known.join(facts.withColumnsRenamed(other), match).drop(*other.values())
