"""Exact deduplication by sorting contents.

Rows are dealt out by splitters that Spark samples from the normalised texts (their first
characters, then a hash of the whole), sorted with spilling in each partition so that equal texts
are neighbours, and cut into groups by comparing neighbouring whole texts.  The hash only orders and
deals out; equality is decided on whole texts.

A text with very many copies would fill one partition.  Counting rows per hash beforehand finds the hashes
of more than ``hot_rows`` rows; they are a stored table that is joined back, so there may be any number of
them.  Their rows are split by a salt made of the row's number, which splits rows of one id or of none as
well.  What each split found is written, and the totals of a split text come from those rows: one per split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import lower_ascii, stored, text_or_empty

HOT_ROWS = 250
PREFIX = 48


def exact_dedup(docs: DataFrame, keep: str = "smallest", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document with ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after lower-casing A-Z; NULL counts as empty.  ``keep``
    says whether the smallest or the largest doc_id of a group stays.  NULL ids stay only where a
    group has no other, and then ``keep_id`` is NULL.  Of rows that share both text and kept id
    exactly one is ``kept``.  Very long texts are compared whole.  Other columns of ``docs`` are ignored
    whatever their names.  An empty table gives an empty result.
    """
    return _judged(docs, keep, (), hot_rows)


def drop_copies(docs: DataFrame, keep: str = "smallest", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The documents that stay, with the columns and texts they came with; rules and cases as in ``exact_dedup``."""
    judged = _judged(docs, keep, tuple(docs.columns), hot_rows).filter("kept")
    return judged.select(*[F.col(f"_c_{name}").alias(name) for name in docs.columns])


def _judged(docs: DataFrame, keep: str, carry: tuple[str, ...], hot_rows: int) -> DataFrame:
    """The decisions, and the columns to carry along under names of their own."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    normal = lower_ascii(text_or_empty("text"))
    carried = [f"_c_{name}" for name in carry]
    rows = docs.select(
        "doc_id",
        normal.alias("_norm"),
        F.monotonically_increasing_id().alias("_row"),
        *[F.col(name).alias(other) for name, other in zip(carry, carried)],
    ).withColumn("_hash", F.xxhash64("_norm"))
    counts = rows.groupBy("_hash").agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows)
    hot = stored(counts.select("_hash", F.ceil(F.col("n") / hot_rows).alias("_pieces")), "hot-texts")
    salt = F.when(F.col("_pieces").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("_row"), F.col("_pieces")))

    key = ["_prefix", "_hash", "_salt"]
    sorted_rows = rows.join(hot, "_hash", "left").withColumns(
        {"_prefix": F.substring("_norm", 1, PREFIX), "_salt": salt.cast("bigint")}
    )
    if "text" in carry:  # of the two forms only the one that is carried moves
        sorted_rows = sorted_rows.drop("_norm").repartitionByRange(*key)
        sorted_rows = sorted_rows.withColumn("_norm", lower_ascii(text_or_empty("_c_text")))
    else:
        sorted_rows = sorted_rows.repartitionByRange(*key)
    group = Window.partitionBy(*key, "_norm")
    largest = keep == "largest"
    best = F.max if largest else F.min
    order = F.desc_nulls_last("doc_id") if largest else F.asc_nulls_last("doc_id")
    split = sorted_rows.select(
        "doc_id",
        "_salt",
        F.col("_pieces").isNotNull().alias("_split"),
        best("doc_id").over(group).alias("keep_id"),
        F.count("*").over(group).alias("group_size"),
        (F.row_number().over(group.orderBy(order)) == 1).alias("_first"),
        F.sha2("_norm", 256).alias("text_sha256"),
        *carried,
    )
    split = stored(split.filter("_first") if carry else split, "judged-texts")

    # A split's row of the best id, ids before NULL and the first split of those that have it.
    known = F.col("keep_id").isNotNull() if largest else F.col("keep_id").isNull()
    turn = -F.col("_salt") if largest else F.col("_salt")
    totals = (
        split.filter("_split AND _first")
        .groupBy("text_sha256")
        .agg(best(F.struct(known.alias("known"), "keep_id", turn.alias("turn"))).alias("_best"), F.sum("group_size").alias("_size"))
    )
    judged = split.join(stored(totals, "split-totals"), "text_sha256", "left")
    whole = F.col("_best").isNull()
    chosen = F.when(whole, F.lit(True)).otherwise(F.abs("_best.turn") == F.col("_salt"))
    return judged.select(
        "doc_id",
        F.when(whole, F.col("keep_id")).otherwise(F.col("_best.keep_id")).alias("keep_id"),
        F.coalesce("_size", "group_size").alias("group_size"),
        (F.col("_first") & chosen).alias("kept"),
        "text_sha256",
        *carried,
    )
