"""Near-duplicates by SimHash: a positional byte index with count filtering.

A fingerprint has eight bytes.  Two fingerprints that differ in at most ``max_bits`` bits differ in at
most that many bytes, so they share at least ``8 - max_bits`` bytes at the same positions.  That is
the guaranteed minimum.  The posting list of a single (position, byte) would hold a 256th of all
fingerprints, so postings have a second key: the eight positions are cut into ``max_bits + 2`` parts, of which
at least two are equal, and a posting is (position, byte) within (two parts, their bytes).  For two bits these
are 6 second keys of four bytes with 4 positions each.

The lists of these postings give each pair one count per positional byte that it shares beyond the second key;
the counts are summed, pairs below the minimum go, and the rest are verified by their differing bits.  A pair
that shares several second keys is counted under the first of them only.

A list with more than ``LONG`` members is not paired as it is.  Its members are listed anew by two of
``max_bits + 2`` interleaved parts of the bits that they need not share; a pair within ``max_bits`` bits is equal
in two, and so is found in one of these lists, which for two bits hold at most 4096 of the members, whatever the
corpus, and is verified there.

Only different fingerprints enter the index, one row each however many documents have it; links per
fingerprint are bounded (2,080 for two bits).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import numbered, stored, without_rows
from tablewright.llm.components import components

SEED = 42
BYTES = 8
CHUNK = 1 << 16
# Posting lists with more members are cut by further bits.
LONG = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit i is 1 if set in over half of the hashes of the text's word shingles; 0 without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(shingle, len(tokens))
    first, last = starts[: len(tokens) - span + 1].tolist(), ends[span - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), CHUNK):
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(first[at : at + CHUNK], last[at : at + CHUNK])], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * ones > len(first), bitorder="little")
    return int(majority.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, number: str | None = None) -> DataFrame:
    """``doc_id, row, fp`` with the fingerprint as a signed long.

    ``row`` is the column ``number``; without one, rows are numbered as this scan finds them.
    """

    def in_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(text.as_py(), shingle) for text in batch.column("text")]
            arrays = [batch.column("doc_id"), batch.column("row"), pa.array(values, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    row = F.monotonically_increasing_id() if number is None else F.col(number)
    rows = docs.select("doc_id", row.alias("row"), "text")
    return rows.mapInArrow(in_batches, f"doc_id {kind}, row bigint, fp bigint")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _parts(items: list[int], count: int) -> list[list[int]]:
    return [items[at::count] for at in range(count)]


def _mask(positions: list[int]) -> int:
    return sum(0xFF << (8 * p) for p in positions)


def second_keys(max_bits: int) -> list[list[int]]:
    """Sets of positions, one of which any pair within the distance shares, all smaller than the guaranteed minimum."""
    minimum, positions = BYTES - max_bits, list(range(BYTES))
    for equal in (2, 1):
        parts = _parts(positions, min(BYTES, max_bits + equal))
        keys = [sum(some, []) for some in combinations(parts, equal)]
        if max(map(len, keys)) < minimum:
            return keys
    return [[]]


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs ``a < b`` of the different fingerprints ``fp`` that differ in at most ``max_bits`` bits."""
    keys = second_keys(max_bits)
    slots = [(i, p) for i, key in enumerate(keys) for p in range(BYTES) if p not in key]
    masks = [_mask([*keys[i], p]) for i, p in slots]
    long_of = lambda values: F.array(*[F.lit(_signed(value)).cast("bigint") for value in values])
    # Per slot: its key, the second keys before its own, and how many positional bytes are still wanting.
    earlier = F.array(*[F.array(*[F.lit(_signed(_mask(key))).cast("bigint") for key in keys[:i]]).cast("array<bigint>") for i, _ in slots])
    wanting = F.array(*[F.lit(BYTES - max_bits - len(keys[i])) for i, _ in slots])
    every = F.array(*[F.lit(slot) for slot in range(len(slots))])
    postings = fps.select("fp", F.explode(every).alias("slot")).withColumn("key", F.col("fp").bitwiseAND(F.get(long_of(masks), "slot")))
    sizes = postings.groupBy("slot", "key").agg(F.count("*").alias("n")).filter(F.col("n") > LONG)
    lengthy = stored(sizes.select("slot", "key"), "long-lists")

    def paired(lists: DataFrame, *more: str, holds: Callable[[Column], Column]) -> DataFrame:
        """Pairs of a list's members whose difference ``holds``, under the first second key that they share."""
        first = lambda gap: ~F.exists("earlier", lambda mask: gap.bitwiseAND(mask) == 0)
        one = lists.withColumn("earlier", F.get(earlier, "slot")).select("slot", "earlier", "held", *more, F.explode("held").alias("a"))
        fits = lambda b: (b > F.col("a")) & first(F.col("a").bitwiseXOR(b)) & holds(F.col("a").bitwiseXOR(b))
        return one.select("slot", "a", F.explode(F.filter("held", fits)).alias("b"))

    near = lambda gap: F.bit_count(gap) <= max_bits
    held = F.collect_list("fp").alias("held")
    short = postings.join(lengthy, ["slot", "key"], "left_anti").groupBy("slot", "key").agg(held).filter(F.size("held") > 1)
    counted = (
        paired(short, holds=lambda gap: F.lit(True))
        .groupBy("a", "b", F.get(wanting, "slot").alias("wanting"))
        .agg(F.count("*").alias("shared"))
        .filter(F.col("shared") >= F.col("wanting"))
        .filter(near(F.col("a").bitwiseXOR(F.col("b"))))
    )
    # Long lists: two of some interleaved parts of the other bits, and of several such only the first.
    cuts = []
    for mask in masks:
        parts = _parts([bit for bit in range(64) if not mask >> bit & 1], max_bits + 2)
        cuts.append([sum(1 << bit for bit in one + other) for one, other in combinations(parts, 2)])
    cut = F.array(*[long_of(some) for some in cuts])
    again = (
        postings.join(lengthy, ["slot", "key"], "left_semi")
        .select("fp", "slot", F.posexplode(F.get(cut, "slot")).alias("cut", "bits"))
        .withColumn("key", F.col("fp").bitwiseAND(F.get(long_of(masks), "slot").bitwiseOR(F.col("bits"))))
        .groupBy("slot", "cut", "key")
        .agg(held)
        .filter(F.size("held") > 1)
        .withColumn("before", F.slice(F.get(cut, "slot"), F.lit(1), F.col("cut")))
    )
    other = lambda gap: ~F.exists("before", lambda bits: gap.bitwiseAND(bits) == 0)
    dense = paired(again, "before", holds=lambda gap: near(gap) & other(gap))
    return counted.select("a", "b").unionByName(dense.select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, number: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, row, fingerprint, component_id, stays``.

    Documents whose fingerprints differ in at most ``max_bits`` bits are linked; ``component_id`` is
    the smallest doc_id that links reach.  A NULL or empty text has fingerprint 0 and is linked like
    any other.  NULL ids are not compared; a component of NULL ids only has a NULL component.
    ``stays`` marks one row per component, of the smallest id, and of repeated rows the first.
    Columns other than ``doc_id`` and ``text`` are ignored whatever their names.  An empty table
    gives an empty result.
    """
    rows = stored(fingerprints(docs, shingle, number), "fingerprints")
    fps = stored(
        rows.groupBy("fp").agg(
            F.min("doc_id").alias("first_id"),
            F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("first"),
        ),
        "distinct-fingerprints",
    )
    found = components(links(fps.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    linked = stored(found.join(fps, "fp"), "linked-fingerprints")
    whole = linked.groupBy("root").agg(F.min("first_id").alias("whole_id"), F.min("first").alias("whole_first"))
    classes = linked.join(stored(whole, "components"), "root").select("fp", "whole_id", "whole_first")
    of_fp = fps.join(classes, "fp", "left").select(
        "fp",
        F.when(F.col("whole_first").isNull(), F.col("first_id")).otherwise(F.col("whole_id")).alias("component_id"),
        F.coalesce("whole_first", "first").getField("row").alias("first_row"),
    )
    return rows.join(stored(of_fp, "classes"), "fp").select(
        "doc_id",
        "row",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        (F.col("row") == F.col("first_row")).alias("stays"),
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One document of each component, with the columns it came with.

    Decisions are found again by row number, so the documents are written once with their numbers.
    """
    rows, number = numbered(docs, "numbered-documents")
    found = near_duplicates(rows, shingle, max_bits, number)
    return without_rows(rows, number, found.filter(~F.col("stays")), "near-duplicate-rows")
