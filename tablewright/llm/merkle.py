"""A Merkle tree over a dataset, with a version of it for every row that was tampered with.

Each row is a leaf: the SHA-256 of its fields.  Per group the leaves are put in order, and every ``FANOUT``
consecutive nodes become their parent until one is left; the groups' roots, in the order of the groups, make
the upper tree.

The order is one distributed sort, so a group of any size is spread over tasks; a leaf's place in its group
is its place in its partition and the counts of the partitions before.  ``FANOUT ** LEVELS`` leaves at
aligned places form a block, which is one row and the whole work of one task at a time: it holds the
nodes below the block's root.  The blocks' roots are the leaves of the next tree up, built the same way, until
each group has one node, so there are as many rounds as the logarithm of the group to the base of a
block.

The tree is persistent.  A tampered leaf makes a version: it shares every untouched node and copies only the
leaf's ancestors, inside the aligned block first; the copy of the block's root then continues through
the upper blocks, whose siblings came to the block with its path, up to the version's own root.

Defined results: NULL ids come first and ties in the id are ordered by the leaf, so equal rows may change
places without changing a result.  The NULL group comes first.  An empty table gives no rows.  Empty and very
long texts are hashed whole, and only digests leave the rows.  Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import lower_ascii, stored

FANOUT = 8
LEVELS = 4
BLOCK = FANOUT**LEVELS
# Equal rows of one key are spread over so many ranges of the sort.
SPREAD = 64

STEP = pa.struct([("before", pa.string()), ("after", pa.string())])
STEPS = "array<struct<before: string, after: string>>"


def digest_of(*fields: Column) -> Column:
    """SHA-256 of fields that cannot run into each other: ``-`` for NULL, else byte count, ``:``, value."""
    values = [field.cast("string") for field in fields]
    told = [F.coalesce(F.concat(F.octet_length(value), F.lit(":"), value), F.lit("-")) for value in values]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """``doc_id, lang, leaf, changed``: the leaf of each row, and of tampered rows that of the lower-cased text."""
    fields = [F.col(name) for name in ("doc_id", "source", "lang", "n_chars")]
    changed = F.when(tampered, digest_of(*fields, lower_ascii(F.col("text"))))
    return docs.select("doc_id", "lang", digest_of(*fields, F.col("text")).alias("leaf"), changed.alias("changed"))


def placed(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """Stored rows with ``family``, a number that rises with their group, ``place`` in it, and ``total``, its size.

    Sorted by ranges of (group, order, a salt): no range is forced to hold all of a group or of equal rows.
    Only one row per group and range takes part in windows.
    """
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))
    by = [F.col(group).asc_nulls_first(), *[F.col(column).asc_nulls_first() for column in order], F.col("_salt").asc()]
    ordered = rows.withColumn("_salt", salt).repartitionByRange(*by).sortWithinPartitions(*by).drop("_salt")
    numbered = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    parts = stored(
        numbered.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(
            F.min("_at").alias("_first"), F.count("*").alias("_n")
        ),
        f"{name}-parts",
    )
    whole = Window.partitionBy("_group")
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    known = parts.select(
        "_group",
        "_part",
        "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        F.min("_first").over(whole).alias("family"),
        F.sum("_n").over(whole).alias("total"),
    )
    same = F.col(group).eqNullSafe(F.col("_group")) & (part == F.col("_part"))
    place = F.col("_offset") + F.col("_at") - F.col("_first")
    return numbered.join(known, same).withColumn("place", place).drop("_group", "_part", "_first", "_offset", "_at")


def climbed(nodes: Sequence[str], total: int) -> list[list[str]]:
    """The levels of one block, its nodes first; ``total`` is the number of nodes in the whole group.

    A group that fits one block ends with its one root, any other block after ``LEVELS`` levels.
    """
    levels = [list(nodes)]
    for _ in range(LEVELS):
        if total <= 1:
            break
        below = levels[-1]
        levels.append([_hash(*below[at : at + FANOUT]) for at in range(0, len(below), FANOUT)])
        total = -(-total // FANOUT)
    return levels


def _hash(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def path(levels: Sequence[Sequence[str]], at: int) -> list[tuple[str, str]]:
    """Per level up to the block's root the siblings before and after a node's ancestor, concatenated."""
    out = []
    for level in levels[:-1]:
        run = at - at % FANOUT
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + FANOUT])))
        at //= FANOUT
    return out


def version(node: str, steps: Sequence[tuple[str, str]]) -> list[str]:
    """The nodes of the version in which ``node`` stands at the foot of the path: itself, then one copy per ancestor.

    The last is the version's root.  All other nodes are those of the tree it was made from.
    """
    copies = [node]
    for before, after in steps:
        copies.append(_hash(before, copies[-1], after))
    return copies


def _folded(table: pa.Table) -> tuple[list[int], list[list[str]]]:
    """The rows of one block in order of place, and its levels."""
    places = table.column("place").to_pylist()
    order = sorted(range(len(places)), key=places.__getitem__)
    nodes = table.column("node").to_pylist()
    return order, climbed([nodes[i] for i in order], table.column("total")[0].as_py())


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / BLOCK))


def _roots(blocks: DataFrame) -> DataFrame:
    """The blocks' roots as the nodes of the next tree up."""

    def run(table: pa.Table) -> pa.Table:
        _, levels = _folded(table)
        first = table.slice(0, 1)
        total = -(-first.column("total")[0].as_py() // BLOCK)
        columns = [first.column("family"), first.column("block"), pa.array([levels[-1][0]]), pa.array([total], pa.int64())]
        return pa.table(columns, names=["family", "place", "node", "total"])

    return blocks.groupBy("family", "block").applyInArrow(run, "family bigint, place bigint, node string, total bigint")


def paths(nodes: DataFrame, name: str) -> DataFrame:
    """``family, place, steps, top``: of each of ``nodes(family, place, node, total)`` the path to its family's root.

    One round handles all blocks of one height; rounds end when every family has one node.
    """
    kept = stored(nodes.select("family", "place", "node", "total"), name)
    tallest = kept.agg(F.max("total")).first()[0] or 0
    if tallest <= 1:
        return kept.select("family", "place", F.array().cast(STEPS).alias("steps"), F.col("node").alias("top"))

    def run(table: pa.Table) -> pa.Table:
        order, levels = _folded(table)
        own = table.take(order)
        steps = [[{"before": b, "after": a} for b, a in path(levels, at)] for at in range(len(order))]
        columns = [own.column("family"), own.column("place"), own.column("block"), pa.array(steps, pa.list_(STEP))]
        return pa.table(columns, names=["family", "place", "block", "steps"])

    blocks = _blocks(kept)
    above = paths(_roots(blocks), f"{name}-up").select("family", F.col("place").alias("block"), F.col("steps").alias("_more"), "top")
    inside = blocks.groupBy("family", "block").applyInArrow(run, f"family bigint, place bigint, block bigint, steps {STEPS}")
    return inside.join(above, ["family", "block"]).select("family", "place", F.concat("steps", "_more").alias("steps"), "top")


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """Per row of ``docs`` its leaf, its group's and the dataset's root, the digest of its proof, and its version.

    ``doc_id, leaf, subroot, root, proof_sha256, copies, folded_root, verified``.  ``tampered`` says which
    rows to tamper with, by lower-casing the A-Z of their text.  ``copies`` are the nodes that the version of a
    tampered row does not share, leaf first; other rows make no version, and ``folded_root`` follows
    their path from the leaf as it is.
    """
    rows = placed(stored(leaves(docs, tampered), "leaves"), "lang", ["doc_id", "leaf"], "ordered-leaves")
    blocks = stored(_blocks(rows.withColumnRenamed("leaf", "node").drop("lang")), "leaf-blocks")
    # From the block's root to its group's root, and from there to the dataset's.
    near = stored(paths(_roots(blocks), "block-roots"), "block-paths")
    subroots = near.filter("place = 0").select(F.lit(True).alias("_all"), F.col("family").alias("_lang"), F.col("top").alias("node"))
    upmost = stored(placed(subroots, "_all", ["_lang"], "ordered-subroots"), "subroots")
    far = paths(upmost, "subroot-paths").join(upmost.select("family", "place", "_lang"), ["family", "place"])
    upper = near.join(far.select(F.col("_lang").alias("family"), F.col("steps").alias("_far"), F.col("top").alias("root")), "family")
    upper = upper.select(
        "family", F.col("place").alias("block"), F.concat("steps", "_far").alias("upper"), F.col("top").alias("subroot"), "root"
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, copies array<string>, "
        "folded_root string, verified boolean"
    )
    return blocks.groupBy("family", "block").cogroup(upper.groupBy("family", "block")).applyInArrow(_versions, schema)


def _versions(block: pa.Table, upper: pa.Table) -> pa.Table:
    order, levels = _folded(block)
    own = block.take(order)
    steps = [(step["before"], step["after"]) for step in upper.column("upper")[0].as_py()]
    subroot, root = upper.column("subroot")[0].as_py(), upper.column("root")[0].as_py()
    proofs, copies, roots = [], [], []
    for at, (leaf, changed) in enumerate(zip(levels[0], own.column("changed").to_pylist())):
        whole = path(levels, at) + steps
        proofs.append(_hash(*[side for step in whole for side in step]))
        made = version(leaf if changed is None else changed, whole)
        copies.append(None if changed is None else made)
        roots.append(made[-1])
    n = len(order)
    return pa.table(
        {
            "doc_id": own.column("doc_id"),
            "leaf": own.column("node"),
            "subroot": pa.array([subroot] * n, pa.string()),
            "root": pa.array([root] * n, pa.string()),
            "proof_sha256": pa.array(proofs, pa.string()),
            "copies": pa.array(copies, pa.list_(pa.string())),
            "folded_root": pa.array(roots, pa.string()),
            "verified": pa.array([folded == root for folded in roots], pa.bool_()),
        }
    )
