"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Word counts per source give targets: a share of all words by weight, no source above
   ``max_epochs`` times its size, what is above dealt again by weight.
2. Each source is cut into shards by a hash of the document, its text included, so that a source with a
   third of all rows is as many shards as it needs, whether or not its ids differ.  Of rows equal in id
   and text every ``TWINS`` go to a shard of their own choice.  The documents of a shard stand in a seeded order, end to end, and are cut into blocks of equal length, as near to
   ``block_words`` as fits.  Documents without words are in no shard.
3. Blocks go to sources by highest quotients target / (2k + 1), then in the same way from a source to
   groups of shards and from a group to shards, which gives each shard a whole number of blocks.  One
   ranking sees the sources, the groups of one source, or the shards of one group.
4. In a shard of n blocks with quota q every block is taken q div n times, and the q mod n blocks
   with the smallest seeded hashes once more.  What a document gives is the overlap of its words with
   those blocks, a calculation within the row.

Word counts are stored, so the texts are read once.  No step depends on row order, partitions or
time: reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import GAP_CHARACTERS, stored, word_count
from tablewright.operators.windows import keyed, running_totals

GROUP = 1024
TWINS = 1024
EMPTY_PARTS = 1 << 16
WORD_AND_GAP = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources in code point order, NULL last, weigh ``weights``, repeating.  This table has one row per
    source and is ranked as a whole.
    """
    everything = Window.partitionBy(F.lit(0))
    pattern = F.array(*[F.lit(float(weight)) for weight in weights])
    place = F.row_number().over(everything.orderBy(F.asc_nulls_last("source")))
    rows = sizes.withColumn("_w", F.get(pattern, (place - 1) % len(weights)))
    rows = rows.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    rows = rows.withColumn("_wanted", F.sum("source_size").over(everything) * F.lit(float(share)))
    fill = everything.orderBy(F.col("_cap") / F.col("_w"), F.asc_nulls_last("source"))
    before = F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    from_here = F.sum("_w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("_full", (F.col("_wanted") - before) * F.col("_w") >= F.col("_cap") * from_here)
    taken = F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(everything)
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.try_divide((F.col("_wanted") - taken) * F.col("_w"), open_weight))
    return rows.select("source", "source_size", target.alias("target"))


def apportion(parts: DataFrame, parent: list[str], child: list[str], weight: str, cap: str, seats: str) -> DataFrame:
    """Adds ``quota``: the ``seats`` of each parent dealt to its children by highest ``weight / (2k + 1)``.

    A divisor slightly too large gives every child seats it has for sure and one slightly too small
    bounds what it can get, so only about three quotients per child are ranked.  No child gets
    more than ``cap``; seats that all caps together leave over are not dealt.  Ties go to the first child.
    """
    within = Window.partitionBy(*(parent or [F.lit(0)]))
    count, total = F.count("*").over(within), F.sum(weight).over(within)
    per_weight = lambda shift: F.try_divide(F.greatest(F.col(seats) + shift * F.col("_n"), F.lit(0)), "_total")
    rows = parts.withColumns({"_n": count, "_total": total})
    rounded = lambda shift: F.floor(F.col(weight) * per_weight(shift) + 0.5)
    sure = F.greatest(F.lit(0), F.least(F.col(cap), rounded(-0.5) - 1))
    most = F.least(F.col(cap), rounded(0.5) + 1)
    rows = rows.withColumns(
        {"_sure": F.coalesce(sure, F.lit(0)).cast("bigint"), "_most": F.coalesce(most, F.lit(0)).cast("bigint")}
    )
    rows = rows.withColumn("_rest", F.col(seats) - F.sum("_sure").over(within))
    next_seats = F.when(F.col("_most") > F.col("_sure"), F.sequence("_sure", F.col("_most") - 1))
    offers = rows.withColumn("_k", F.explode_outer(next_seats))
    quotient = F.when(F.col("_k").isNotNull(), F.col(weight) / (2 * F.col("_k") + 1))
    order = [F.desc_nulls_last(quotient), *[F.asc_nulls_last(name) for name in child], F.asc("_k")]
    offers = offers.withColumn("_won", F.col("_k").isNotNull() & (F.row_number().over(within.orderBy(*order)) <= F.col("_rest")))
    keys = [name for name in parts.columns]
    dealt = offers.groupBy(*keys, "_sure").agg(F.sum(F.col("_won").cast("bigint")).alias("_more"))
    return dealt.select(*keys, (F.col("_sure") + F.col("_more")).alias("quota"))


def _seeded(seed: int, *parts: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


def plan(
    counted: DataFrame,
    weights: Sequence[float],
    share: float,
    max_epochs: int,
    block_words: int,
    shard_words: int,
    seed: int,
) -> tuple[DataFrame, DataFrame]:
    """Targets per source, and per shard its words, blocks and quota; both stored."""
    sizes = stored(counted.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    sources = source_targets(sizes, weights, share, max_epochs)
    n_shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("bigint")
    sources = stored(sources.withColumns({"n_shards": n_shards, "source_key": F.xxhash64("source")}), "source-targets")
    totals = placed(counted.filter("size > 0"), sources, seed).groupBy("source_key", "shard").agg(F.sum("size").alias("shard_words"))
    blocks = F.when(F.col("shard_words") > 0, F.greatest(F.lit(1), F.round(F.col("shard_words") / block_words)))
    shards = totals.withColumn("blocks", F.coalesce(blocks, F.lit(0)).cast("bigint"))
    shards = stored(shards.withColumn("group", F.floor(F.col("shard") / GROUP)), "shards")

    groups = shards.groupBy("source_key", "group").agg(F.sum("blocks").alias("group_blocks"))
    of_source = groups.groupBy("source_key").agg(F.sum("group_blocks").alias("source_blocks"))
    tops = sources.select("source_key", "target").join(of_source, "source_key")
    everything = Window.partitionBy(F.lit(0))
    tops = tops.withColumns(
        {
            "cap": F.col("source_blocks") * max_epochs,
            "seats": F.round(F.sum("target").over(everything) / block_words).cast("bigint"),
        }
    )
    tops = stored(apportion(tops, [], ["source_key"], "target", "cap", "seats"), "source-quotas")

    parts = groups.join(tops.select("source_key", F.col("quota").alias("seats")), "source_key")
    parts = parts.withColumn("cap", F.col("group_blocks") * max_epochs)
    parts = stored(apportion(parts, ["source_key"], ["group"], "group_blocks", "cap", "seats"), "group-quotas")

    leaves = shards.join(parts.select("source_key", "group", F.col("quota").alias("seats")), ["source_key", "group"])
    leaves = leaves.withColumn("cap", F.col("blocks") * max_epochs)
    leaves = apportion(leaves, ["source_key", "group"], ["shard"], "blocks", "cap", "seats")
    extra = F.col("quota") % F.col("blocks")
    ranked = F.sort_array(
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1),
            lambda i: F.struct(_seeded(seed, "source_key", "shard", i).alias("h"), i.alias("i")),
        )
    )
    leaves = leaves.filter("blocks > 0").select(
        "source_key",
        "shard",
        "shard_words",
        "blocks",
        F.floor(F.col("quota") / F.col("blocks")).alias("passes"),
        F.when(extra > 0, F.get(ranked, extra - 1)).alias("last"),
    )
    return sources, stored(leaves, "shard-quotas")


def counted_words(docs: DataFrame, *carry: str) -> DataFrame:
    """``doc_id, source, size``, the text's hash, by which rows of one id or of none are told apart, and ``_copy`` 0."""
    made = [word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_text"), F.lit(0).cast("bigint").alias("_copy")]
    return docs.select("doc_id", "source", *made, *carry)


def with_copies(counted: DataFrame, crowded: DataFrame) -> DataFrame:
    """``_copy``: which ``TWINS`` of the rows equal in id and text a row belongs to; 0 for rows that are not ``crowded``.

    Equal rows are told apart by ``_number``.  How many get which copy does not depend on those numbers.
    """
    twin = ["doc_id", "size", "_text"]
    marked = counted.withColumn("_twin", F.xxhash64(*twin)).join(
        crowded.select(F.xxhash64(*twin).alias("_twin")).distinct().withColumn("_crowded", F.lit(True)), "_twin", "left"
    )
    marked = stored(marked, "marked-rows")
    ranked = running_totals(keyed(marked.filter("_crowded"), ["_twin"], store=False), [*twin, "_number"], {"_upto": F.lit(1)})
    copies = ranked.withColumn("_copy", F.floor((F.col("_upto") - 1) / TWINS)).drop("_upto")
    return marked.filter("_crowded IS NULL").unionByName(copies).drop("_twin", "_crowded", "_number")


def placed(counted: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """The counted documents with their source's totals and their shard.

    Documents without words, which give nothing, get negative numbers that only spread them over tasks.
    """
    rows = counted.withColumn("source_key", F.xxhash64("source"))
    totals = sources.select("source_key", "source_size", "target", "n_shards")
    shard = F.pmod(_seeded(seed, "doc_id", "size", "_text", "_copy"), F.col("n_shards"))
    apart = F.lit(-1) - F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(EMPTY_PARTS))
    rows = rows.withColumn("_apart", F.when(F.col("size") == 0, apart))
    return rows.join(totals, "source_key").withColumn("shard", F.coalesce("_apart", shard)).drop("_apart")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: int = 2,
    block_words: int = 16,
    shard_words: int = 1 << 16,
    seed: int = 11,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: ``doc_id, size, source, source_size, target, taken``.

    ``size`` counts the text's words (0 for NULL), ``taken`` the words the mix takes of it, repeats
    counted, at most ``max_epochs`` times ``size``.  Documents without words give nothing.  NULL is a
    source of its own.  Repeated rows count each by itself.  Other columns are ignored whatever their
    names.  An empty table gives an empty result.  Very long texts are cut into blocks like any other.  Columns
    in ``carry`` come along; with ``text`` among them there are also ``passes`` (whole copies taken) and
    ``part`` (the words of the blocks taken once more, each but the last with the gap that follows it in the
    text, so line ends stay; NULL if none).
    """
    number = F.monotonically_increasing_id().alias("_number")
    counted = stored(counted_words(docs).select("*", number), "word-counts")
    equal = counted.filter("size > 0").groupBy("doc_id", "size", "_text").agg(F.count("*").alias("n"))
    crowded = stored(equal.filter(F.col("n") > TWINS), "crowded-rows")
    if crowded.isEmpty():
        texts = counted_words(docs, *carry) if carry else counted
    else:
        texts = stored(counted_words(docs, *carry).select("*", number), "words-and-texts") if carry else counted
        counted = texts = with_copies(texts, crowded)
    sources, shards = plan(counted, weights, share, max_epochs, block_words, shard_words, seed)
    rows = placed(texts, sources, seed)
    order = Window.partitionBy("source_key", "shard").orderBy(_seeded(seed + 1, "doc_id", "size", "_text"), "doc_id", "size", "_text")
    rows = rows.withColumn("_to", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(shards, ["source_key", "shard"], "left").withColumn("_from", F.col("_to") - F.col("size"))
    rows = rows.withColumns(
        {
            "_first": F.expr("((_from + 1) * blocks - 1) div shard_words"),
            "_last": F.expr("(_to * blocks - 1) div shard_words"),
        }
    )
    chosen = f"""IF(last IS NULL OR size = 0, array(), filter(sequence(_first, _last),
        i -> struct(xxhash64({seed}, source_key, shard, i) AS h, i AS i) <= last))"""
    rows = rows.withColumn(
        "_runs",
        F.expr(
            f"""transform({chosen}, i -> struct(
                greatest(_from, (i * shard_words) div blocks) - _from AS start,
                least(_to, ((i + 1) * shard_words) div blocks) - _from AS stop))"""
        ),
    )
    more = F.expr("aggregate(_runs, 0L, (n, r) -> n + r.stop - r.start)")
    passes = F.coalesce("passes", F.lit(0))
    rows = rows.withColumns({"_more": more, "taken": passes * F.col("size") + more})
    kept = ["doc_id", "size", "source", "source_size", "target", "taken"]
    if "text" not in carry:
        return rows.select(*kept, *carry)
    pieces = F.expr("array_join(flatten(transform(_runs, r -> slice(_words, int(r.start + 1), int(r.stop - r.start)))), '')")
    pieces = F.rtrim(pieces, F.lit(GAP_CHARACTERS))
    part = F.when(F.col("_more") == 0, F.lit(None)).when(F.col("_more") == F.col("size"), F.col("text")).otherwise(pieces)
    rows = rows.withColumn("_words", F.regexp_extract_all("text", F.lit(WORD_AND_GAP), F.lit(0)))
    return rows.select(*kept, *carry, passes.alias("passes"), part.alias("part"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself in the columns of ``documents``: a row for each whole copy and for a part.

    Whole copies keep their text; a part keeps its words and the gaps between them, line ends included.  Documents
    that the mix takes no word of, NULL and empty texts among them, are not in it.
    """
    rows = mix(docs, carry=("text", "lang"), **settings)
    copies = F.array_compact(F.concat(F.array_repeat("text", F.col("passes").cast("int")), F.array("part")))
    rows = rows.filter("taken > 0").select("doc_id", "lang", "source", F.explode(copies).alias("text"))
    return rows.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))
