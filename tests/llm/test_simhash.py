from __future__ import annotations

import random
import time
from collections import Counter
from itertools import combinations

import pytest
import xxhash
from cases import DOCS, documents, lower_ascii, ordered, plain, tokens

from tablewright.llm import simhash
from tablewright.llm.components import components

WORDS = [f"w{i}" for i in range(400)]
NEAR = [(500 + k, " ".join([*WORDS[:k], "changed", *WORDS[k + 1 :]]), "en", "n", 1) for k in range(0, 60, 2)]


def fingerprint(text, shingle=3):
    words = tokens(lower_ascii(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, max_bits):
    prints = [fingerprint(row[1]) for row in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                parent[find(i)] = find(j)
    smallest = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            smallest[find(i)] = min(smallest.get(find(i), row[0]), row[0])
    return [(row[0], f"{prints[i]:016x}", smallest.get(find(i))) for i, row in enumerate(rows)]


def test_against_brute_force(spark):
    rows = DOCS + NEAR
    for max_bits in (1, 2, 4):
        found = simhash.near_duplicates(documents(spark, rows), 3, max_bits)
        assert plain(found, "doc_id", "fingerprint", "component_id") == ordered(brute(rows, max_bits))


def test_links_are_all_pairs_within_the_distance(spark):
    values = [0, 1, 3, 7, 1 << 63, (1 << 63) | 1, 0xFF00FF00FF00FF00, 0xFF00FF00FF00FF01, 0x7F00FF00FF00FF00]
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), 2)
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert {tuple(row) for row in found.collect()} == expected


def pairs_within(values, max_bits):
    return {(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= max_bits}


@pytest.mark.parametrize("max_bits", [0, 1, 2, 3, 4, 5, 6])
@pytest.mark.parametrize("long", [2, 64])
def test_links_of_clusters(spark, monkeypatch, max_bits, long):
    """Random fingerprints, and clusters a few bits wide whose lists are long or, by the limit, short."""
    monkeypatch.setattr(simhash, "LONG", long)
    rng = random.Random(max_bits)
    values = {rng.getrandbits(64) for _ in range(30)}
    for _ in range(4):
        middle = rng.getrandbits(64)
        values |= {middle ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(max_bits + 2))) for _ in range(25)}
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), max_bits)
    assert {tuple(row) for row in found.collect()} == pairs_within(signed, max_bits)


def test_pairs_below_the_minimum_are_counted_and_go():
    for max_bits in range(1, 8):
        keys = simhash.second_keys(max_bits)
        # Whichever bytes differ, one second key is equal, and bytes are still wanting beyond it.
        for differ in combinations(range(8), max_bits):
            assert any(not set(key) & set(differ) for key in keys)
        assert all(len(key) < 8 - max_bits for key in keys)


def test_a_full_block_of_fingerprints(spark):
    """65,536 fingerprints that share six bytes."""
    frame = spark.range(1 << 16).selectExpr("(id & 255) << 8 | (id >> 8) << 40 | shiftleft(7L, 56) AS fp")
    began = time.monotonic()
    assert simhash.links(frame, 2).count() == (1 << 16) * (16 + 120) // 2
    assert time.monotonic() - began < 120


def test_one_of_each_group_stays(spark):
    rows = DOCS + NEAR
    docs = documents(spark, rows)
    left = simhash.drop_near_duplicates(docs, 3, 2)
    assert left.columns == docs.columns
    groups = {component for _, _, component in brute(rows, 2)}
    assert Counter(row.doc_id for row in left.collect()) == Counter(groups)


def test_long_chains_are_one_component(spark):
    chain = [(i, i + 1) for i in range(0, 199)] + [(300, 301), (301, 300), (400, 400)]
    found = components(spark.createDataFrame(chain, "a bigint, b bigint"))
    roots = {row.node: row.root for row in found.collect()}
    assert set(roots) == {*range(200), 300, 301} and {roots[i] for i in range(200)} == {0} and roots[301] == 300


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
