from __future__ import annotations

import heapq
import re
from collections import defaultdict

import pytest
from cases import DOCS, documents, plain, tokens

from tablewright.llm import mixing

SOURCES = [(1000 + i, " ".join(f"t{i}x{k}" for k in range(5 + i * 7 % 90)), "en", f"s{i % 5}", 1) for i in range(120)]
SOURCES += [(2000 + i, "tiny text", "en", "u", 1) for i in range(3)]


def targets(sizes, weights, share, cap):
    """Deals by weight, and what is above a cap again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {name: weights[i % len(weights)] for i, name in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    excess, open_names = share * sum(sizes.values()), list(names)
    while excess > 1e-9 and open_names:
        total = sum(weight[n] for n in open_names)
        for n in open_names:
            target[n] += excess * weight[n] / total
        excess = sum(max(0.0, target[n] - cap * sizes[n]) for n in open_names)
        target = {n: min(t, float(cap * sizes[n])) for n, t in target.items()}
        open_names = [n for n in open_names if target[n] < cap * sizes[n] - 1e-12]
    return target


def highest_quotients(weights, caps, seats):
    given = [0] * len(weights)
    heap = [(-w, i) for i, w in enumerate(weights) if caps[i] > 0]
    heapq.heapify(heap)
    while seats and heap:
        _, i = heapq.heappop(heap)
        given[i] += 1
        seats -= 1
        if given[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * given[i] + 1), i))
    return given


@pytest.mark.parametrize("rows", [SOURCES, DOCS + SOURCES, DOCS])
def test_targets_and_taken_words(spark, rows):
    found = mixing.mix(documents(spark, rows), block_words=8, shard_words=400).collect()
    sizes = defaultdict(int)
    for row in rows:
        sizes[row[3]] += len(tokens(row[1]))
    expected, taken = targets(sizes, (5, 2, 1), 1.5, 2), defaultdict(int)
    assert len(found) == len(rows)
    for row in found:
        assert row.source_size == sizes[row.source]
        assert row.target == pytest.approx(expected[row.source], rel=1e-9, abs=1e-6)
        assert 0 <= row.taken <= 2 * row.size
        taken[row.source] += row.taken
    for source, target in expected.items():
        shards = sizes[source] // 400 + 1
        assert abs(taken[source] - target) <= 8 * (shards + 2) + 0.02 * target


def test_quotients(spark):
    for case, (weights, seats, cap) in enumerate([([53, 24, 23], 7, 99), ([1.0] * 9, 4, 99), ([90, 5, 5, 0], 40, 12), ([3, 2], 0, 5)]):
        rows = [(case, i, float(w), cap, seats) for i, w in enumerate(weights)]
        parts = spark.createDataFrame(rows, "p int, c int, w double, cap bigint, seats bigint")
        dealt = mixing.apportion(parts, ["p"], ["c"], "w", "cap", "seats").orderBy("c").collect()
        expected = highest_quotients([w for w in weights], [cap if w else 0 for w in weights], seats)
        if sum(expected) == seats and max(expected) < cap:
            assert [row.quota for row in dealt] == expected
        assert all(row.quota <= cap for row in dealt) and sum(row.quota for row in dealt) <= seats


TWIN_ROWS = [(None, "the same few words in every row", "en", "s1", 1)] * 900 + [(7, "another text", "en", None, 1)] * 301


def shards_seen(monkeypatch, seen):
    plan = mixing.plan

    def watched(counted, weights, share, max_epochs, block_words, shard_words, seed):
        sources, shards = plan(counted, weights, share, max_epochs, block_words, shard_words, seed)
        seen.append([row.shard_words for row in shards.filter("shard >= 0").collect()])
        return sources, shards

    monkeypatch.setattr(mixing, "plan", watched)


def test_rows_of_one_id_and_text_are_spread_over_shards(spark, monkeypatch):
    columns = ("doc_id", "size", "source", "source_size", "target", "taken")
    rows, seen = SOURCES + TWIN_ROWS, []
    shards_seen(monkeypatch, seen)
    monkeypatch.setattr(mixing, "TWINS", 10)
    once = plain(mixing.mix(documents(spark, rows), block_words=8, shard_words=400), *columns)
    assert len(once) == len(rows) and max(seen[0]) < 4 * 400
    again = plain(mixing.mix(documents(spark, rows[::-1]).repartition(7), block_words=8, shard_words=400), *columns)
    assert again == once
    sizes, taken = defaultdict(int), defaultdict(int)
    for row in rows:
        sizes[row[3]] += len(tokens(row[1]))
    for _, size, source, _, _, words in once:
        assert 0 <= words <= 2 * size
        taken[source] += words
    for source, target in targets(sizes, (5, 2, 1), 1.5, 2).items():
        assert abs(taken[source] - target) <= 8 * (sizes[source] // 400 + 3) + 0.02 * target
    mixed = mixing.mixed_documents(documents(spark, rows), block_words=8, shard_words=400).collect()
    words = defaultdict(int)
    for row in mixed:
        words[row.source] += len(tokens(row.text))
    assert words == {source: n for source, n in taken.items() if n}


def test_reruns_and_order_do_not_matter(spark):
    columns = ("doc_id", "size", "source", "source_size", "target", "taken")
    once = plain(mixing.mix(documents(spark, SOURCES), block_words=8, shard_words=300), *columns)
    shuffled = documents(spark, SOURCES[::-1]).repartition(7)
    assert plain(mixing.mix(shuffled, block_words=8, shard_words=300), *columns) == once


def test_texts_of_the_mix(spark):
    docs = documents(spark, SOURCES)
    taken = {row.doc_id: row.taken for row in mixing.mix(docs, block_words=8, shard_words=300).collect()}
    words, found = defaultdict(int), mixing.mixed_documents(docs, block_words=8, shard_words=300)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = {row[0]: tokens(row[1]) for row in SOURCES}
    for row in found.collect():
        part = tokens(row.text)
        words[row.doc_id] += len(part)
        assert set(part) <= set(texts[row.doc_id]) and row.n_chars == len(row.text)
    assert words == {doc_id: n for doc_id, n in taken.items() if n}


def test_parts_keep_their_line_ends(spark):
    rows = [(i, "\n".join(f"line {i} of\tmany  {k}" for k in range(20)), "en", "s", 1) for i in range(40)]
    found = mixing.mixed_documents(documents(spark, rows), share=0.5, block_words=30, shard_words=400).collect()
    parts = [row for row in found if len(tokens(row.text)) < 100]
    assert parts
    for row in parts:
        left = iter(re.findall(r"\S+\s*", rows[row.doc_id][1]))
        *pieces, last = re.findall(r"\S+\s*", row.text)
        assert all(piece in left for piece in pieces) and any(piece.rstrip() == last for piece in left)


def test_rows_without_id_or_words_are_spread(spark):
    rows = [(None, f"w{i} word", "en", "s", 1) for i in range(3000)] + [(None, None, "en", "s", 1)] * 3000
    counted = mixing.counted_words(documents(spark, rows))
    sources = mixing.source_targets(counted.groupBy("source").agg({"size": "sum"}).toDF("source", "source_size"), (5, 2, 1), 1.5, 2)
    extra = {"n_shards": mixing.F.lit(10), "source_key": mixing.F.xxhash64("source")}
    shards = mixing.placed(counted, sources.withColumns(extra), 11).groupBy("shard").count().collect()
    assert max(row["count"] for row in shards if row.shard >= 0) < 2 * 300 and sum(row["count"] for row in shards) == 6000
    assert max(row["count"] for row in shards if row.shard < 0) < 20
    found = mixing.mix(documents(spark, rows), shard_words=600).collect()
    assert len(found) == 6000 and sum(row.taken for row in found) == pytest.approx(9000, abs=64)


def test_empty_table(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.mix(documents(spark, [(1, None, None, None, 0)])).first().taken == 0
