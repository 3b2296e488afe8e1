"""Stretches of words that repeat with a period, found by an enhanced suffix array.

The words of a batch of texts become numbers, and the suffixes of all its texts are sorted by prefix
doubling; a suffix ends with its text, so texts don't mix.  Each LCP interval, a stretch of the suffix array
whose suffixes share exactly ``depth`` words, is taken with its children.  For the suffixes ``i`` of all
children but the largest, the inverse suffix array says whether ``i + depth`` or ``i - depth`` lies in the
interval too: then a square of that period stands there.  It is branching if the word after it breaks the
period, so it is the last square of a run; rotating it to the left as far as the period holds gives the
whole run.  Squares of several times the period of a run end and start where it does and merge into
it.  Intervals are pairs of bounds in flat arrays, found with the LCP values alone; there are no tree nodes.
Rotation and LCP values look at the ranks that the doubling kept of every round, in the logarithm of
the length.

A run of ``exponent`` times its period has at least that many suffixes in its interval, and intervals with
fewer are passed over.  A batch holds ``BATCH_WORDS`` words or one longer text, so memory follows the longest
text and work is n log n in its length.

Defined results: NULL and empty texts have no run and collapse to an empty text.  Very long texts are
taken whole.  Repeated rows give repeated rows.  An empty table gives no rows, and columns whose names clash
with new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tablewright.llm.common import let, words

BATCH_WORDS = 200_000
SHORTEST = 6
EXPONENT = 4

RUN = StructType([StructField(name, LongType()) for name in ("start", "length", "period")])
FOUND = StructType([StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])
ARROW = (pa.list_(pa.struct([(name, pa.int64()) for name in RUN.names])), pa.string())


def planted(text: Column, doc_id: Column) -> Column:
    """The text, of which every tenth document repeats itself from some word on, by a hash of its id.

    With h the CRC-32 of the id and g = h div 10: where h ends in 0, words from a = g mod n on repeat with
    period p = 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(ws: Column) -> Column:
        n = F.size(ws)
        a = F.pmod(g, n)
        p = F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ws, place(i).cast("int"))))

    some = (F.pmod(h, F.lit(10)) == 0) & text.rlike(r"[^\x20\x09-\x0D]")
    return F.when(some, let(words(text), repeated)).otherwise(text)


def detect(docs: DataFrame, text: str = "text", shortest: int = SHORTEST, exponent: int = EXPONENT) -> DataFrame:
    """The rows with ``runs``, by start, then period, and ``collapsed``, the words left, in place of the text.

    A run is a maximal stretch of at least ``shortest`` words and ``exponent`` times its smallest period.
    Of each run the words after the first period go.
    """
    plain = docs.drop(*[name for name in docs.columns if name.lower() in FOUND.names])
    others = [name for name in plain.columns if name != text]
    schema = StructType([*plain.select(*others).schema.fields, *FOUND.fields])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows, texts in _batches(part, text):
                found = collapse(texts, shortest, exponent)
                new = [pa.array([row[at] for row in found], kind) for at, kind in enumerate(ARROW)]
                columns = [rows.column(name) for name in others]
                yield pa.RecordBatch.from_arrays([*columns, *new], names=[*others, *FOUND.names])

    return plain.mapInArrow(run, schema)


def _batches(part: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    texts, size, since = [], 0, 0
    for at, value in enumerate(part.column(text)):
        # bytes.split() parts at exactly the space and U+0009 to U+000D.
        ws = (value.as_py() or "").encode().split()
        if texts and size + len(ws) > BATCH_WORDS:
            yield part.slice(since, at - since), texts
            texts, size, since = [], 0, at
        texts.append(ws)
        size += len(ws)
    if texts:
        yield part.slice(since), texts


def collapse(texts: Sequence[list[bytes]], shortest: int = SHORTEST, exponent: int = EXPONENT) -> list[tuple[list[dict], str]]:
    """Per text its runs and the words that they leave."""
    sizes = np.array([len(ws) for ws in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)
    numbers, _ = pd.factorize(np.array([w for ws in texts for w in ws], dtype=object)) if len(doc) else (doc, None)
    begin, end, period = find_runs(numbers.astype(np.int64), doc, ends, shortest, exponent)
    gone = np.zeros(len(doc) + 1, dtype=np.int64)
    np.add.at(gone, begin + period, 1)
    np.add.at(gone, end, -1)
    kept = np.cumsum(gone[:-1]) == 0
    first = np.searchsorted(begin, starts)
    last = np.searchsorted(begin, ends)
    out = []
    for i, ws in enumerate(texts):
        here = slice(first[i], last[i])
        if first[i] == last[i]:
            left = ws
            runs = []
        else:
            left = [w for w, keep in zip(ws, kept[starts[i] : ends[i]]) if keep]
            spans = zip((begin[here] - starts[i]).tolist(), (end[here] - begin[here]).tolist(), period[here].tolist())
            runs = [{"start": s, "length": n, "period": p} for s, n, p in spans]
        out.append((runs, b" ".join(left).decode()))
    return out


def find_runs(
    numbers: np.ndarray, doc: np.ndarray, ends: np.ndarray, shortest: int = SHORTEST, exponent: int = EXPONENT
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and period of every run, sorted, over texts that lie one after the other.

    ``doc`` is the text of each word, ``ends`` where each text ends.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(numbers) < shortest:
        return none, none, none
    order, rank, levels = suffix_array(numbers, doc)
    shared = common_prefixes(order, levels)
    i, depth = branching_squares(numbers, doc, ends, order, rank, shared, exponent)
    begin = i - rotations(i, depth, levels, doc)
    end = i + 2 * depth
    wide = end - begin >= np.maximum(shortest, exponent * depth)
    begin, end, depth = begin[wide], end[wide], depth[wide]
    by = np.lexsort((depth, end, begin))
    begin, end, depth = begin[by], end[by], depth[by]
    new = np.ones(len(begin), dtype=bool)
    new[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    begin, end, depth = begin[new], end[new], depth[new]
    by = np.lexsort((depth, begin))
    return begin[by], end[by], depth[by]


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted order, and where in it the group of equal keys of each place begins."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    head = np.ones(len(key), dtype=bool)
    head[1:] = ordered[1:] != ordered[:-1]
    return order, np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))


def suffix_array(numbers: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffixes in order, the place of each, and its rank by 1, 2, 4, ... words.

    Equal ranks in round k mean the same text and the same 2**k words; both may be cut short by the end of the
    text only if they are the same suffix.  A round sorts only the suffixes that are still tied.
    """
    n = len(numbers)
    order, group = _dense(doc * (int(numbers.max()) + 1) + numbers)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = group
    levels = [rank.astype(np.int32)]
    step = 1
    tied = _tied(group, np.arange(n))
    while len(tied):
        at = order[tied]
        after = at + step
        inside = after < n
        inside[inside] = doc[after[inside]] == doc[at[inside]]
        second = np.zeros(len(at), dtype=np.int64)
        second[inside] = rank[after[inside]] + 1
        sub, head = _dense(rank[at] * (n + 1) + second)
        order[tied] = at[sub]
        rank[at[sub]] = tied[head]
        levels.append(rank.astype(np.int32))
        step *= 2
        tied = _tied(tied[head], tied)
    return order, rank, levels


def _tied(group: np.ndarray, places: np.ndarray) -> np.ndarray:
    same = group[1:] == group[:-1]
    tied = np.zeros(len(group), dtype=bool)
    tied[1:] |= same
    tied[:-1] |= same
    return places[tied]


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many words each suffix shares with the one before it in order; 0 for the first."""
    n = len(order)
    shared = np.zeros(n, dtype=np.int64)
    live = 1 + np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b = order[live - 1].copy(), order[live].copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = np.maximum(a, b) < n
        same = np.zeros(len(a), dtype=bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        a[same] += 1 << k
        b[same] += 1 << k
        shared[live[same]] += 1 << k
    return shared


def _pyramid(values: np.ndarray) -> list[np.ndarray]:
    """Minima of 1, 2, 4, ... values side by side."""
    out = [values]
    while len(out[-1]) > 1:
        below = out[-1]
        if len(below) % 2:
            below = np.append(below, np.iinfo(below.dtype).max)
        out.append(below.reshape(-1, 2).min(axis=1))
    return out


def _next_at_most(pyramid: list[np.ndarray], places: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The first place after each with a value of at most ``bound``; the length where there is none.

    From block to block upwards until one holds such a value, then down to it.
    """
    at = places + 1
    found = np.full(len(places), -1, dtype=np.int64)
    live = np.arange(len(places))
    for k, minima in enumerate(pyramid):
        live = live[at[live] < len(minima)]
        holds = minima[at[live]] <= bound[live]
        found[live[holds]] = k
        live = live[~holds]
        at[live] = (at[live] + 1) // 2
    for k in range(len(pyramid) - 1, 0, -1):
        some = np.flatnonzero(found == k)
        left = 2 * at[some]
        at[some] = np.where(pyramid[k - 1][left] <= bound[some], left, left + 1)
        found[some] = k - 1
    return np.where(found == 0, at, len(pyramid[0]))


def branching_squares(
    numbers: np.ndarray,
    doc: np.ndarray,
    ends: np.ndarray,
    order: np.ndarray,
    rank: np.ndarray,
    shared: np.ndarray,
    exponent: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Begin and period of every square whose next word breaks the period, in intervals of enough suffixes."""
    n = len(numbers)
    sizes = np.diff(ends, prepend=0)
    cut = np.flatnonzero((shared > 0) & (exponent * shared <= sizes[doc[order]]))
    below = shared[cut] - 1
    right = _next_at_most(_pyramid(shared), cut, below)
    left = n - 1 - _next_at_most(_pyramid(shared[::-1]), n - 1 - cut, below)
    enough = right - left >= exponent
    cut, left, right = cut[enough], left[enough], right[enough]
    # The cuts of one interval, in order, and between them its children.
    by = np.lexsort((cut, right, left))
    cut, left, right = cut[by], left[by], right[by]
    head = np.ones(len(cut), dtype=bool)
    head[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    tail = np.roll(head, -1)
    interval = np.cumsum(head) - 1
    child_from = np.concatenate([np.where(head, left, np.roll(cut, 1)), cut[tail]])
    child_to = np.concatenate([cut, right[tail]])
    child_of = np.concatenate([interval, interval[tail]])
    size = child_to - child_from
    by = np.lexsort((-size, child_of))
    largest = np.ones(len(by), dtype=bool)
    largest[1:] = child_of[by][1:] != child_of[by][:-1]
    small = by[~largest]
    size = size[small]
    place = np.repeat(child_from[small] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    of = np.repeat(child_of[small], size)
    low, high, depth = left[head][of], right[head][of], shared[cut[head]][of]
    i = order[place]
    squares = []
    for begin, other in ((i, i + depth), (i - depth, i - depth)):
        inside = (other >= 0) & (other < n)
        inside[inside] = doc[other[inside]] == doc[i[inside]]
        at = rank[other[inside]]
        member = np.flatnonzero(inside)[(at >= low[inside]) & (at < high[inside])]
        squares.append(np.stack([begin[member], depth[member]]))
    begin, depth = np.unique(np.concatenate(squares, axis=1), axis=1)
    after = begin + 2 * depth
    breaks = after >= ends[doc[begin]]
    breaks[~breaks] = numbers[after[~breaks]] != numbers[after[~breaks] - depth[~breaks]]
    return begin[breaks], depth[breaks]


def rotations(begin: np.ndarray, depth: np.ndarray, levels: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """How far each square can be rotated to the left within its text."""
    at = begin.copy()
    for k in range(len(levels) - 1, -1, -1):
        back = at - (1 << k)
        inside = back >= 0
        same = np.zeros(len(at), dtype=bool)
        same[inside] = levels[k][back[inside]] == levels[k][back[inside] + depth[inside]]
        at[same] = back[same]
    return begin - at


def strongest(runs: Column) -> Column:
    """The run with the greatest length by period; of equal ones the first by start, then period."""
    better = lambda best, run: run["length"] * best["period"] > best["length"] * run["period"]
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, run: F.when(better(best, run), run).otherwise(best))


def digests(found: DataFrame) -> DataFrame:
    """``doc_id``, the number of runs, the strongest run, and SHA-256 of all runs and of the words left."""
    line = lambda run: F.concat(run["start"], F.lit(","), run["length"], F.lit(","), run["period"], F.lit("\n"))
    best = F.col("best")
    return found.withColumn("best", strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[best[name].alias(name) for name in RUN.names],
        F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
