"""Training rows for the classifiers: the labelled documents, or a bounded, seeded sample of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import stored
from tablewright.operators.joins import id_filter


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; such labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _known(labels: DataFrame, label: str) -> DataFrame:
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna()
    return known.filter(~held_out(F.col("doc_id"))).distinct()


def described_rows(docs: DataFrame, labels: DataFrame, label: str, describe: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``label`` and what ``describe`` adds to ``doc_id, hash``, of the same rows as ``training_rows`` without a sample.

    ``describe`` turns ``doc_id, hash, text`` into ``doc_id, hash`` and columns in place of the text, row by row.  It works
    where the texts are read, so no text is shuffled to its label.  A Bloom filter of the labelled ids leaves few other
    texts to describe; with more ids than it can hold, all that are not held out are described and the join drops the rest.
    """
    known = stored(_known(labels, label), "training-labels")
    texts = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").filter(~held_out(F.col("doc_id")))
    alike = docs.schema["doc_id"].dataType == known.schema["doc_id"].dataType
    might_train = id_filter(known, "doc_id", known.count()) if alike else None
    if might_train is not None:
        texts = texts.filter(might_train(F.col("doc_id")))
    rows = describe(texts.filter("doc_id IS NOT NULL")).join(known, "doc_id")
    return rows.dropDuplicates(["doc_id", "label", "hash"]).drop("doc_id", "hash")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int | None = None) -> DataFrame:
    """``key, label, text`` of all labelled documents outside the held-out third, or of at most ``sample`` of them.

    Rows without id or label are left out.  An id counts once for each different text and label that it has.
    ``key`` puts the rows in the same order in every run.

    A sample's ids are drawn by smallest hash, so every run draws the same, and the same order cuts what the ids have
    in all: no more than ``sample`` rows come back however often an id is repeated.  Only the drawn ids and text
    hashes, bounded lists, are broadcast.
    """
    known = _known(labels, label)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    if sample is None:
        rows = texts.filter(~held_out(F.col("doc_id"))).join(known, "doc_id").dropDuplicates(["doc_id", "label", "hash"])
        return rows.select(F.xxhash64("doc_id", "hash").alias("key"), "label", "text")
    order = [F.xxhash64("doc_id"), "doc_id", "label"]
    drawn = known.orderBy(*order).limit(sample)
    found = texts.select("doc_id", "hash").join(F.broadcast(drawn), "doc_id").distinct().orderBy(*order, "hash").limit(sample)
    rows = texts.join(F.broadcast(found), ["doc_id", "hash"]).dropDuplicates(["doc_id", "label", "hash"])
    return rows.select(F.xxhash64("doc_id", "hash").alias("key"), "label", "text")
