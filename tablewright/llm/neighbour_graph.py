"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Equal vectors form one class.  Classes are dealt to shards by hash, about ``SHARD_ROWS`` in each.  A shard
becomes a graph: from random links, every node is searched for greedily, the nodes that the search met
and the node's own links are its candidates, and relaxed distance pruning keeps the diverse ones: the nearest
candidate becomes a link and removes all that are nearer to it, by the factor ``alpha``, than to the node.
Links are made both ways and pruned where a node has more than ``DEGREE``.  That is done twice, with
``alpha`` 1 and 1.2.

Queries are packed into blocks of ``BLOCK_QUERIES``.  Each block meets each shard in one task, where a beam
search runs for all queries of the block in step; the results of all shards meet in one top-k.  A task holds
one shard and one block, whatever the size of the table.  The work on queries is queries times
shards: raise ``shard_rows`` with the table where tasks have the memory.

Distances inside the search are single precision on vectors scaled by their largest component; what a beam
ends with is ranked again by exact distances on the vectors as they came, in double precision.

Defined results: vectors that are NULL, empty, zero or hold a NULL or non-finite component take no part,
nor do rows without an id.  Vectors of different length never meet.  Equal distances rank by the smaller
id.  Repeated rows count once; an id with several vectors is as near as its nearest one.  A table with fewer
candidates than ``k`` gives all of them, an empty one gives no rows.  Other columns are not used.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import stored

SHARD_ROWS = 4096
BLOCK_QUERIES = 2048
DEGREE = 24
BUILD_BEAM = 48
SEARCH_BEAM = 96
RELAXED = (1.0, 1.2)
# Searches start from the most central node and so many others.
STARTS = 16
# Candidates whose links are followed in one step, and nodes linked in one round.
STRIDE = 4
ROUND = 256

INDEX = "dim int, shard long, ids array<array<bigint>>, vectors binary, links binary, starts binary"


def usable(vector: Column) -> Column:
    """Whether a vector takes part: finite components only, and one that is not zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _rows(frame: DataFrame, key: str, vector: str) -> DataFrame:
    """The distinct ``(id, vec)`` that take part."""
    rows = frame.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    return rows.filter(F.col("id").isNotNull() & usable(F.col("vec"))).distinct()


def build(frame: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The stored index: a row per shard with its vectors, their links and the ids behind each vector.

    No query needs more than the ``k + 1`` smallest ids of equal vectors, its own being one, so
    a class carries no more; the window keeps them before it shuffles.
    """
    first = Window.partitionBy("vec").orderBy("id")
    classes = stored(
        _rows(frame, key, vector)
        .withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= k + 1)
        .groupBy("vec")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.size("vec").alias("dim"), "vec", "ids"),
        "vector-classes",
    )
    shards = classes.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).alias("shards"))
    dealt = classes.join(F.broadcast(shards), "dim").select(
        "dim", F.pmod(F.xxhash64("vec"), F.col("shards")).alias("shard"), "vec", "ids"
    )
    return stored(dealt.groupBy("dim", "shard").applyInPandas(_shard_index, INDEX), "vector-index")


def search(index: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest that the beam found, other than the query's own id."""
    asked = stored(_rows(queries, key, vector).withColumn("dim", F.size("vec")), "vector-queries")
    blocks = asked.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("blocks"))
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))
    packed = (
        asked.join(F.broadcast(blocks), "dim")
        .select("dim", F.pmod(F.xxhash64("id", "vec"), F.col("blocks")).alias("block"), "id", "vec")
        .groupBy("dim", "block")
        .applyInPandas(_packed, "dim int, block long, queries array<bigint>, asked binary")
    )
    # Packed rows only: a block meets a shard once, and both are bounded.
    left = index.join(F.broadcast(blocks), "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = packed.join(F.broadcast(shards), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("last"))))
    keys = ["dim", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _searcher(k), "query_id bigint, vec_id bigint, score double"
    )
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(nearest))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(vector, dtype=np.float64) for vector in vectors])


def _scaled(vectors: np.ndarray, scale: float) -> np.ndarray:
    return (vectors / scale).astype(np.float32)


def _shard_index(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.assign(_first=[ids[0] for ids in rows["ids"]]).sort_values("_first", ignore_index=True)
    vectors = _matrix(rows["vec"])
    points = _scaled(vectors, np.abs(vectors).max())
    links, starts = linked(points)
    return pd.DataFrame(
        {
            "dim": [int(rows["dim"].iloc[0])],
            "shard": [int(rows["shard"].iloc[0])],
            "ids": [[list(map(int, ids)) for ids in rows["ids"]]],
            "vectors": [vectors.tobytes()],
            "links": [links.tobytes()],
            "starts": [starts.tobytes()],
        }
    )


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("id", ignore_index=True)
    return pd.DataFrame(
        {
            "dim": [int(rows["dim"].iloc[0])],
            "block": [int(rows["block"].iloc[0])],
            "queries": [rows["id"].astype(int).tolist()],
            "asked": [_matrix(rows["vec"]).tobytes()],
        }
    )


def _searcher(k: int):
    def run(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(shard) and len(block):
            index, asked = shard.iloc[0], block.iloc[0]
            dim = int(index["dim"])
            vectors = np.frombuffer(index["vectors"]).reshape(-1, dim)
            links = np.frombuffer(index["links"], dtype=np.int32).reshape(len(vectors), -1)
            starts = np.frombuffer(index["starts"], dtype=np.int32)
            targets = np.frombuffer(asked["asked"]).reshape(-1, dim)
            scale = np.abs(vectors).max()
            points = _scaled(vectors, scale)
            ids = index["ids"]
            for at in range(0, len(targets), ROUND):
                part = targets[at : at + ROUND]
                beams, _ = beam_search(points, links, starts, _scaled(part, scale), SEARCH_BEAM)
                for own, target, beam in zip(asked["queries"][at : at + ROUND], part, beams):
                    for far, other in _nearest(vectors, ids, target, beam[beam >= 0], int(own), k):
                        out["query_id"].append(int(own))
                        out["vec_id"].append(other)
                        out["score"].append(far)
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def _nearest(vectors: np.ndarray, ids, target: np.ndarray, beam: np.ndarray, own: int, k: int) -> list[tuple[float, int]]:
    """The ``k`` nearest ids behind the nodes of a beam, by exact distance, then id."""
    exact = np.sqrt(((vectors[beam] - target) ** 2).sum(axis=1))
    best: dict[int, float] = {}
    order = np.argsort(exact, kind="stable")
    for node, far in zip(beam[order], exact[order]):
        if len(best) >= k and far > max(best.values()):
            break
        for other in ids[node]:
            if other != own:
                best.setdefault(int(other), float(far))
        if len(best) > k:
            best = {other: at for at, other in sorted((at, other) for other, at in best.items())[:k]}
    return sorted((far, other) for other, far in best.items())


def linked(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node (rows filled up with -1) and the nodes where searches start."""
    n = len(points)
    rng = np.random.default_rng(n)
    centre = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    others = rng.permutation(np.delete(np.arange(n), centre))[: STARTS - 1]
    starts = np.concatenate([[centre], others]).astype(np.int32)
    width = min(degree, n - 1)
    links = np.full((n, degree), -1, dtype=np.int32)
    if width:
        drawn = rng.integers(0, n - 1, size=(n, width))
        links[:, :width] = drawn + (drawn >= np.arange(n)[:, None])
        for alpha in RELAXED:
            order = rng.permutation(n)
            for at in range(0, n, ROUND):
                nodes = order[at : at + ROUND]
                met, _ = beam_search(points, links, starts, points[nodes], beam)
                links[nodes] = pruned(points, nodes, np.concatenate([met, links[nodes]], axis=1), degree, alpha)
                _link_back(points, links, nodes, degree, alpha)
    return links, starts


def _link_back(points: np.ndarray, links: np.ndarray, nodes: np.ndarray, degree: int, alpha: float) -> None:
    """For each new link p to q, q gets p as a candidate; rows over the degree are pruned again."""
    to = links[nodes].ravel()
    come = np.repeat(nodes, links.shape[1])[to >= 0]
    to = to[to >= 0]
    order = np.argsort(to, kind="stable")
    to, come = to[order], come[order]
    heads = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    sizes = np.diff(np.r_[heads, len(to)])
    new = np.full((len(heads), sizes.max(initial=0)), -1, dtype=np.int32)
    new[np.repeat(np.arange(len(heads)), sizes), np.arange(len(to)) - np.repeat(heads, sizes)] = come
    targets = to[heads]
    for at in range(0, len(targets), ROUND):
        some = slice(at, at + ROUND)
        wide = new[some][:, : max(1, sizes[some].max())]
        pool = np.concatenate([links[targets[some]], wide], axis=1)
        links[targets[some]] = pruned(points, targets[some], pool, degree, alpha)


def pruned(points: np.ndarray, nodes: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of each node's candidates: up to ``degree`` of them, nearest first.

    A candidate goes once a kept one is nearer to it, by the factor ``alpha``, than the node is.
    """
    pool = np.where(pool == nodes[:, None], -1, pool)
    pool = np.sort(pool, axis=1)
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
    near = ((points[pool] - points[nodes][:, None]) ** 2).sum(axis=2)
    near[pool < 0] = np.inf
    order = np.argsort(near, axis=1, kind="stable")
    pool, near = np.take_along_axis(pool, order, 1), np.take_along_axis(near, order, 1)
    used = max(1, int((pool >= 0).sum(axis=1).max()))
    pool, near = pool[:, :used], near[:, :used]
    vectors = points[pool]
    squares = (vectors**2).sum(axis=2)
    between = squares[:, :, None] + squares[:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    alive = pool >= 0
    kept = np.full((len(nodes), degree), -1, dtype=np.int32)
    every = np.arange(len(nodes))
    for place in range(min(degree, used)):
        pick = alive.argmax(axis=1)
        some = alive[every, pick]
        if not some.any():
            break
        kept[some, place] = pool[every, pick][some]
        covered = alpha**2 * between[every, pick] <= near
        alive &= ~(covered & some[:, None])
        alive[every, pick] = False
    return kept


def beam_search(
    points: np.ndarray, links: np.ndarray, starts: np.ndarray, targets: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """For each target the ``width`` nearest nodes met, nearest first, and their squared distances.

    All targets advance in step: each follows the links of its nearest nodes not yet followed, until a
    beam has none left.
    """
    m, n = len(targets), len(points)
    out = np.full((m, width), -1, dtype=np.int32)
    out_far = np.full((m, width), np.inf, dtype=np.float32)
    seen = np.zeros((m, n + 1), dtype=bool)
    seen[:, starts] = True
    seen[:, n] = True
    nodes = np.full((m, width + len(starts)), -1, dtype=np.int32)
    far = np.full(nodes.shape, np.inf, dtype=np.float32)
    nodes[:, : len(starts)] = starts
    far[:, : len(starts)] = ((points[starts][None] - targets[:, None]) ** 2).sum(axis=2)
    order = np.argsort(far, axis=1, kind="stable")[:, :width]
    nodes, far = np.take_along_axis(nodes, order, 1), np.take_along_axis(far, order, 1)
    followed = nodes < 0
    live = np.arange(m)
    while len(live):
        pick = np.argsort(followed, axis=1, kind="stable")[:, :STRIDE]
        rows = np.arange(len(live))[:, None]
        heads = np.where(followed[rows, pick], -1, nodes[rows, pick])
        followed[rows, pick] = True
        fresh = np.full((len(live), heads.shape[1] * links.shape[1]), n, dtype=np.int32)
        for place in range(heads.shape[1]):
            some = links[heads[:, place]]
            some = np.where((heads[:, place] < 0)[:, None] | (some < 0), n, some)
            some[seen[live[:, None], some]] = n
            seen[live[:, None], some] = True
            fresh[:, place * links.shape[1] : (place + 1) * links.shape[1]] = some
        at, column = np.nonzero(fresh < n)
        gap = np.full(fresh.shape, np.inf, dtype=np.float32)
        step = points[fresh[at, column]] - targets[live[at]]
        gap[at, column] = np.einsum("ij,ij->i", step, step)
        nodes = np.concatenate([nodes, np.where(fresh < n, fresh, -1)], axis=1)
        far = np.concatenate([far, gap], axis=1)
        followed = np.concatenate([followed, fresh == n], axis=1)
        order = np.argsort(far, axis=1, kind="stable")[:, :width]
        nodes, far, followed = (np.take_along_axis(x, order, 1) for x in (nodes, far, followed))
        done = followed.all(axis=1)
        if done.any():
            out[live[done]], out_far[live[done]] = nodes[done], far[done]
            live, nodes, far, followed = live[~done], nodes[~done], far[~done], followed[~done]
    return out, out_far


def neighbours(frame: DataFrame, every: int = 100, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest of each row whose id is divisible by ``every``, among all other rows."""
    index = build(frame, k, key, vector)
    return search(index, frame.filter(F.col(key) % every == 0), k, key, vector)

