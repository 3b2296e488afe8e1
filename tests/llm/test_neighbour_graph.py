"""Nearest neighbours by graph against brute force, and the defined results."""

from __future__ import annotations

import numpy as np
import pytest

from tablewright.llm import neighbour_graph as graphs

FOLDER = "/root/testdata/sf0.001"


def nearest(rows, query_id, target, k):
    """The exact answer: nearest first, ties by id."""
    far = [(float(np.sqrt(((np.array(v) - np.array(target)) ** 2).sum())), i) for i, v in rows if i != query_id]
    return sorted(far)[:k]


def frame_of(spark, rows, more=""):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    return frame.selectExpr("*", "1 AS dim", "2 AS shard", "3 AS id", "4 AS vec", "5 AS ids", "6 AS block", "7 AS rank")


def answers(frame):
    out = {}
    for row in frame.collect():
        out.setdefault(row["query_id"], []).append((row["rank"], row["score"], row["vec_id"]))
    return {key: [(score, other) for _, score, other in sorted(found)] for key, found in out.items()}


def test_recall_on_the_table(spark):
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(row["vec_id"], row["embedding"]) for row in vectors.collect()]
    found = answers(graphs.neighbours(vectors, every=100, k=10))
    asked = [(i, v) for i, v in rows if i % 100 == 0]
    assert sorted(found) == [i for i, _ in asked]
    met = 0
    for i, v in asked:
        assert len(found[i]) == 10
        want = nearest(rows, i, v, 10)
        met += len({other for _, other in want} & {other for _, other in found[i]})
        exact = {other: score for score, other in nearest(rows, i, v, len(rows))}
        for score, other in found[i]:
            assert score == pytest.approx(exact[other], rel=1e-14)
    assert met >= 0.9 * 10 * len(asked)


def test_recall_over_several_shards(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    index = graphs.build(frame, k=5, shard_rows=700)
    assert index.count() == 5
    found = answers(graphs.search(index, frame.filter("vec_id % 100 = 0"), k=5))
    met = sum(len(set(nearest(rows, i, rows[i][1], 5)) & set(found[i])) for i in found)
    assert len(found) == 30 and met >= 0.9 * 5 * 30


def test_rows_that_take_no_part_ties_and_repeated_rows(spark):
    rows = [
        (0, [1.0, 0.0]),
        (0, [1.0, 0.0]),
        (3, [1.0, 0.0]),
        (2, [1.0, 0.0]),
        (4, [1.0, 2.0]),
        (1, [1.0, 2.0]),
        (5, None),
        (6, []),
        (7, [0.0, 0.0]),
        (8, [None, 1.0]),
        (9, [float("nan"), 1.0]),
        (10, [float("inf"), 1.0]),
        (11, [1.0, 0.0, 0.0]),
        (None, [1.0, 0.0]),
        (100, [0.0, 0.0]),
        (200, None),
        (300, [-1e200, 1e200, 5.0]),
    ]
    found = answers(graphs.neighbours(frame_of(spark, rows), every=100, k=3))
    assert found[0] == [(0.0, 2), (0.0, 3), (2.0, 1)]
    assert sorted(found) == [0, 300]
    assert [other for _, other in found[300]] == [11]
    everything = answers(graphs.neighbours(frame_of(spark, rows), every=100, k=10))
    assert everything[0] == [(0.0, 2), (0.0, 3), (2.0, 1), (2.0, 4)]


def test_one_vector_with_a_third_of_the_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [0.5, 0.5, 0.25] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(900)]
    found = answers(graphs.neighbours(frame_of(spark, rows), every=300, k=4))
    assert found[0] == [(0.0, 3), (0.0, 6), (0.0, 9), (0.0, 12)]
    assert found[300] == [(0.0, 0), (0.0, 3), (0.0, 6), (0.0, 9)]


def test_an_id_with_two_vectors_is_as_near_as_its_nearest(spark):
    rows = [(0, [1.0, 1.0]), (1, [1.0, 2.0]), (1, [1.0, 9.0]), (2, [1.0, 4.0])]
    assert answers(graphs.neighbours(frame_of(spark, rows), k=2))[0] == [(1.0, 1), (3.0, 2)]


def test_empty(spark):
    assert graphs.neighbours(frame_of(spark, []), k=3).collect() == []
    assert graphs.neighbours(frame_of(spark, [(0, [1.0])]), k=3).collect() == []


def test_pruning_keeps_diverse_candidates():
    points = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2], [5, 0]], dtype=np.float32)
    pool = np.array([[1, 2, 3, 4, 1, 0]], dtype=np.int32)
    assert graphs.pruned(points, np.array([0]), pool, 4, 1.0).tolist() == [[1, 3, -1, -1]]
    # A relaxed rule removes less: node 4 is nearer to node 1 than to node 0, but not by the factor.
    assert graphs.pruned(points, np.array([0]), pool, 4, 1.3).tolist() == [[1, 3, 4, -1]]
