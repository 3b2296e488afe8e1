from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from cases import DOCS, documents, ordered, plain

from tablewright.llm import sharding
from tablewright.operators import windows

MANY = [(i, f"text {i}", "en", "a", 1) for i in range(3000)]


def by_key(arcs, owners, room):
    """Each document for itself: round by round, arcs in ring order, ranks in order."""
    room, place = list(room), {}
    waiting = [(arc, rank) for arc, n in sorted(arcs.items()) for rank in range(n)]
    step = 0
    while waiting:
        after = []
        for arc, rank in waiting:
            shard = int(owners[(arc + step) % len(owners)])
            if room[shard]:
                room[shard] -= 1
                place[arc, rank] = shard
            else:
                after.append((arc, rank))
        waiting, step = after, step + 1
    return place


@pytest.mark.parametrize("factor", [1.0, 1.25])
def test_pieces_against_dealing_each_document(factor):
    random = np.random.default_rng(0)
    owners = sharding.ring(5, 8, 1)[1]
    counts = {arc: int(n) for arc, n in enumerate(random.integers(0, 30, len(owners)))}
    room = sharding.capacities(sum(counts.values()), 5, factor)
    pieces = sharding.deal(counts, owners, room)
    assert len(pieces) <= len(owners) + 5
    assert {(a, r): s for a, b, e, s, _ in pieces for r in range(b, e)} == by_key(counts, owners, room)


def test_balance_slots_and_columns(spark):
    found = sharding.assign(documents(spark, MANY + DOCS), shards=40, virtual=16).collect()
    counts = Counter(row.shard for row in found)
    assert len(counts) == 40 and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(row.slot for row in found if row.shard == shard) == list(range(n))
    expected = [(r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in MANY + DOCS]
    assert ordered((r.doc_id, r.size, r.text_crc32) for r in found) == ordered(expected)


def test_few_move_when_a_shard_is_added(spark):
    docs = documents(spark, MANY)
    moved = {}
    for factor in (1.0, 1.25):
        before, after = (
            {row.doc_id: row.shard for row in sharding.assign(docs, shards=n, virtual=64, load_factor=factor).collect()} for n in (20, 21)
        )
        moved[factor] = sum(before[i] != after[i] for i in before) / len(before)
    assert moved[1.25] < 0.15 and moved[1.0] < 0.5


def test_an_arc_of_equal_rows_is_ranked_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK_ROWS", 100)
    blocks = []
    cut = windows._in_blocks
    monkeypatch.setattr(windows, "_in_blocks", lambda *args: blocks.append(cut(*args)) or blocks[-1])
    rows = MANY + [(None, "same", "en", "a", 1)] * 2000
    found = sharding.assign(documents(spark, rows), shards=40, virtual=16).collect()
    counts = Counter(row.shard for row in found)
    assert len(found) == 5000 and set(counts.values()) == {125}
    for shard in counts:
        assert sorted(row.slot for row in found if row.shard == shard) == list(range(125))
    hot = max(blocks[-1].groupBy("_arc", "__block").count().collect(), key=lambda row: row["count"])
    assert hot["count"] < 2 * 5000 / int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_reruns_agree_and_empty_table(spark):
    columns = ("doc_id", "shard", "slot")
    once = plain(sharding.assign(documents(spark, MANY)), *columns)
    assert plain(sharding.assign(documents(spark, MANY[::-1]).repartition(5)), *columns) == once
    assert sharding.assign(documents(spark, [])).count() == 0
