"""Quality scores from Bradley-Terry pairwise ranking.

Every pair of a good and a bad training document is a preference.  The chance that one document is
preferred over another is the logistic function of the difference of their scores, and a
score is a weighted sum of features of the text: shares of characters, words and lines of some kinds, and
the frequencies of hashed words, word pairs and runs of three bytes.  The weights minimise the mean logistic loss on
standardised feature differences over all pairs.  The threshold is that quantile of the training scores which tells
the labels apart best.

Every labelled row takes part, and their features stay in Spark: tasks add up what a Newton step needs.  A row's
part in the slope is its features times a smooth function of its score, the sum over all rows of the other label.
That function is tabled at steps of ``STEP`` and read by cubic interpolation on both sides, so a step costs the
rows and not the pairs; a pair's chance is off by less than 1e-7.  The curvature, which only guides the steps, joins
scores in bins of ``COARSE`` steps.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import stored
from tablewright.llm.labelled import described_rows, held_out

STEP = 1 / 32
COARSE = 8
BINS = 256
ADDERS = 16
BUCKETS = 128
# Hashed features are many and each says little: their weights are held back so much more.
HELD_BACK = 1000.0
SLICE = 1 << 18
PART = 10_000
_BASE = 0x9E3779B97F4A7C15
_GAP = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))
_SYMBOL = re.compile(r"[#*$%&|<>]")
_TAIL = re.compile(r"[#*$%&|<>]{2,}(?:\s|$)")
_SHOUT = re.compile(r"!!")
FEATURES = (
    "symbols per character",
    "words ending in symbols",
    "bars per word",
    "double exclamations per word",
    "upper case per character",
    "digits per character",
    "repeated lines",
    "short lines",
    "different words",
    "logarithm of words",
    "mean word length",
    "commas and stops per word",
)


WIDTH = len(FEATURES) + 2 * BUCKETS


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base modulo 2**64 and their inverses, for the places of a slice."""
    with_base = lambda base: np.cumprod(np.r_[1, np.full(SLICE, base)].astype(np.uint64))
    return with_base(np.uint64(_BASE)), with_base(np.uint64(pow(_BASE, -1, 1 << 64)))


def _bucket_counts(grams: np.ndarray) -> np.ndarray:
    mixed = (grams ^ grams >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return np.bincount((mixed >> np.uint64(57)).astype(np.int64), minlength=BUCKETS)


def n_grams(text: str) -> np.ndarray:
    """Root frequencies of words and word pairs by hash, then of runs of three bytes; A-Z count as a-z.

    Taken slice by slice, so memory is bounded however long the text; nothing is counted across two slices.
    """
    data = text.encode("utf-8", "replace").lower()
    powers, inverse = _powers()
    words, runs = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for at in range(0, len(data), SLICE):
        values = np.frombuffer(data, np.uint8, min(SLICE, len(data) - at), at)
        ends = np.flatnonzero(np.diff(np.r_[True, _GAP[values], True]))
        first, last = ends[0::2], ends[1::2]
        wide = values.astype(np.uint64) + np.uint64(1)
        sums = np.r_[np.uint64(0), np.cumsum(wide * powers[: len(wide)])]
        word = (sums[last] - sums[first]) * inverse[first]
        words += _bucket_counts(np.r_[word, word[:-1] * np.uint64(_BASE) + word[1:]])
        runs += _bucket_counts((wide[:-2] << np.uint64(18) | wide[1:-1] << np.uint64(9) | wide[2:]) * np.uint64(_BASE))
    return np.sqrt(np.r_[words / max(1, words.sum()), runs / max(1, runs.sum())])


def features(text: str | None) -> list[float]:
    """The features of a whole text; all zero for an empty or NULL one."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * WIDTH
    n, size = len(words), len(text)
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    return [
        min(1.0, 10 * len(_SYMBOL.findall(text)) / size),
        len(_TAIL.findall(text)) / n,
        min(1.0, 2 * text.count("|") / n),
        min(1.0, len(_SHOUT.findall(text)) / n),
        sum(map(str.isupper, words)) / n,
        min(1.0, 5 * sum(map(text.count, "0123456789")) / size),
        1 - len(set(lines)) / len(lines),
        sum(line.count(" ") < 4 for line in lines) / len(lines),
        len(set(words)) / n,
        np.log1p(n) / 10,
        min(20.0, size / n) / 20,
        min(1.0, (text.count(",") + text.count(".")) / n),
        *n_grams(text).tolist(),
    ]


@dataclass
class Ranking:
    """``scale`` and ``weights`` make a score of features; 0.5 is the threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.mean) / self.scale @ self.weights

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows) - self.threshold, -30, 30)))


Part = Callable[[np.ndarray, np.ndarray], np.ndarray]
Total = Callable[..., np.ndarray]


def _chance(values: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(values, -700, 700)))


def _placed(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the four steps around each score, and the weights of cubic interpolation from them."""
    whole = np.floor(scores / STEP)
    t = scores / STEP - whole
    weights = (-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6)
    return whole - 1, np.stack(weights, axis=1)


def _masses(scores: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Rows of a step, its share of the good and of the bad scores, and the counts of those whose first step it is."""
    first, weights = _placed(scores)
    kinds = [(labels == 1)[:, None], (labels == 0)[:, None]]
    leads = np.arange(4) == 0
    parts = [first[:, None] + np.arange(4), *(weights * of for of in kinds), *(leads * of for of in kinds)]
    return _merged(np.stack([part.ravel() for part in parts], axis=1))


def _merged(*tables: np.ndarray) -> np.ndarray:
    """Tables led by a step as one, with the sums of equal steps."""
    rows = np.concatenate(tables)
    steps, at = np.unique(rows[:, 0], return_inverse=True)
    return np.stack([steps, *(np.bincount(at, column, len(steps)) for column in rows[:, 1:].T)], axis=1)


@dataclass
class _Spread:
    """The scores of all rows under some weights, as ``_masses`` tell them, and what follows from them for a row."""

    masses: np.ndarray

    def __post_init__(self) -> None:
        steps, good, bad = self.masses[:, :3].T
        self.steps = np.unique(np.concatenate([steps - 1, steps, steps + 1]))
        self.over, self.under, self.loss = np.empty(len(self.steps)), np.empty(len(self.steps)), 0.0
        place = np.searchsorted(self.steps, steps)
        some = max(1, (1 << 21) // len(steps))
        for at in range(0, len(self.steps), some):
            to = slice(at, at + some)
            apart = (steps - self.steps[to, None]) * STEP
            lost = _chance(apart)
            self.over[to], self.under[to] = lost @ bad, (1 - lost) @ good
            here = (place >= at) & (place < at + some)
            self.loss += good[here] @ np.logaddexp(0, apart[place[here] - at]) @ bad
        bins = _bins(steps)
        counts = [np.bincount(bins, column, BINS) for column in self.masses[:, 3:].T]
        centre = np.arange(BINS) * COARSE * STEP
        lost = _chance(centre - centre[:, None])
        self.bend = lost * (1 - lost)
        self.bends = np.stack([self.bend @ counts[1], self.bend @ counts[0]])

    def parts(self, rows: np.ndarray, scores: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """What the rows add to slope, weighted squares, and the sums of features per bin of good and of bad scores."""
        good, bad = labels == 1, labels == 0
        first, weights = _placed(scores)
        at = np.searchsorted(self.steps, first)[:, None] + np.arange(4)
        missed = np.where(good, -(weights * self.over[at]).sum(axis=1), np.where(bad, (weights * self.under[at]).sum(axis=1), 0.0))
        bins = _bins(first)
        bent = rows * np.sqrt(np.where(good, self.bends[0, bins], np.where(bad, self.bends[1, bins], 0.0)))[:, None]
        sums = np.zeros((2, BINS, rows.shape[1]))
        for kind, of in enumerate((good, bad)):
            order = np.flatnonzero(of)[np.argsort(bins[of], kind="stable")]
            if len(order):
                found, starts = np.unique(bins[order], return_index=True)
                sums[kind, found] = np.add.reduceat(rows[order], starts)
        return np.concatenate([missed @ rows, (bent.T @ bent).ravel(), sums.ravel()])

    def slope_and_curve(self, total: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """From the sum of all ``parts``."""
        slope, squares, sums = np.split(total, [width, width + width**2])
        good, bad = sums.reshape(2, BINS, width)
        across = good.T @ self.bend @ bad
        return slope, squares.reshape(width, width) - across - across.T


def _bins(steps: np.ndarray) -> np.ndarray:
    return np.clip(steps // COARSE + BINS // 2, 0, BINS - 1).astype(np.int64)


def _minimum(total: Total, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and the weights of least loss over all pairs; ``total`` adds up a part over all rows."""
    n, n_good, n_bad, *sums = total(lambda rows, labels: np.r_[len(rows), (labels == 1).sum(), (labels == 0).sum(), rows.sum(axis=0)])
    width, mean = len(sums), np.array(sums) / n
    if not n_good or not n_bad:
        return np.zeros(width), np.ones(width), np.zeros(width)
    scale = np.sqrt(total(lambda rows, labels: ((rows - mean) ** 2).sum(axis=0)) / n) + 1e-9
    penalty = ridge * np.where(np.arange(width) < len(FEATURES), 1.0, HELD_BACK)

    def spread(weights: np.ndarray) -> tuple[_Spread, float]:
        found = _Spread(total(lambda rows, labels: _masses((rows - mean) / scale @ weights, labels), _merged))
        return found, found.loss / n_good / n_bad + penalty @ weights**2 / 2

    def parts(rows: np.ndarray, labels: np.ndarray, at: _Spread, weights: np.ndarray) -> np.ndarray:
        scaled = (rows - mean) / scale
        return at.parts(scaled, scaled @ weights, labels)

    weights = np.zeros(width)
    here, loss = spread(weights)
    for _ in range(50):
        slope, curve = here.slope_and_curve(total(lambda rows, labels: parts(rows, labels, here, weights)), width)
        step = np.linalg.solve(curve / n_good / n_bad + np.diag(penalty), slope / n_good / n_bad + penalty * weights)
        if np.abs(step).max() < 1e-6:
            return mean, scale, weights - step
        there, after = spread(weights - step)
        while after > loss + 1e-7 and np.abs(step).max() > 1e-6:
            step = step / 2
            there, after = spread(weights - step)
        weights, here, loss = weights - step, there, after
    return mean, scale, weights


def fit(rows: np.ndarray, labels: np.ndarray, pairs: int | None = None, seed: int = 3, ridge: float = 1e-3) -> Ranking:
    """The ranking of rows in memory, by all pairs unless a number of ``pairs`` to draw is given; see ``fit_all``.

    With one label only every score is 0.5.  The threshold lies between the score quantile, of all, that tells the
    labels apart best and the next lower score; of equally good ones the highest.
    """
    width = rows.shape[1] if rows.size else WIDTH
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    if pairs is None:
        mean, scale, weights = _minimum(lambda part, merge=np.add: part(rows, labels), ridge)
    else:
        mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
        weights = _of_drawn_pairs((rows - mean) / scale, good, bad, pairs, seed, ridge)
    ranking = Ranking(mean, scale, weights, 0.0)
    values, at = np.unique(ranking.raw(rows).round(9), return_inverse=True)
    here = [np.bincount(at[of], minlength=len(values)) for of in (good, bad)]
    below = [np.cumsum(counts) - counts for counts in here]
    right = (len(good) - below[0]) / len(good) + below[1] / len(bad)
    best = len(values) - 1 - int(right[::-1].argmax())
    ranking.threshold = float(values[max(0, best - 1) : best + 1].mean())
    return ranking


def _of_drawn_pairs(scaled: np.ndarray, good: np.ndarray, bad: np.ndarray, pairs: int, seed: int, ridge: float) -> np.ndarray:
    """Newton steps on the loss of a seeded draw of pairs, taken in parts."""
    random = np.random.default_rng(seed)
    n = min(pairs, len(good) * len(bad))
    better, worse = random.choice(good, n), random.choice(bad, n)
    weights = np.zeros(scaled.shape[1])
    penalty = ridge * np.where(np.arange(len(weights)) < len(FEATURES), 1.0, HELD_BACK)
    for _ in range(25):
        slope, curve = penalty * weights, np.diag(penalty)
        for at in range(0, n, PART):
            difference = scaled[better[at : at + PART]] - scaled[worse[at : at + PART]]
            missed = 1 / (1 + np.exp(np.clip(difference @ weights, -30, 30)))
            slope -= difference.T @ missed / n
            curve += (difference * (missed * (1 - missed))[:, None]).T @ difference / n
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    values = batch.column("features").flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1).astype(float), batch.column("label").to_numpy(zero_copy_only=False)


def _total(described: DataFrame) -> Total:
    """Adds up parts over all rows of ``label, features``: batch by batch in the tasks, then in ``ADDERS`` tasks."""

    def total(part: Part, merge: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add) -> np.ndarray:
        def added(found: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            first = next(found, None)
            if first is not None:
                yield pa.RecordBatch.from_pydict({"part": [pickle.dumps(reduce(merge, found, first))]})

        def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return added(part(*_arrays(batch)) for batch in batches if batch.num_rows)

        def of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return added(pickle.loads(value) for batch in batches for value in batch.column("part").to_pylist())

        parts = described.mapInArrow(of_rows, "part binary").repartition(ADDERS).mapInArrow(of_parts, "part binary")
        return reduce(merge, [pickle.loads(row.part) for row in parts.collect()])

    return total


def _threshold(described: DataFrame, ranking: Ranking, n_good: int, n_bad: int) -> float:
    """As ``fit`` puts it, over every different training score; counts go up bucket by bucket of near scores."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels = _arrays(batch)
            yield pa.RecordBatch.from_pydict({"raw": ranking.raw(rows).round(9), "good": (labels == 1) * 1, "bad": (labels == 0) * 1})

    raws = stored(described.mapInArrow(scored, "raw double, good bigint, bad bigint"), "ranking-scores")
    counts = [F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    bucketed = raws.withColumn("bucket", F.floor(F.col("raw") * 256))
    lower = bucketed.groupBy("bucket").agg(*counts).toPandas().sort_values("bucket")
    for name in ("good", "bad"):
        lower[f"{name}_below"] = lower.pop(name).cumsum().shift(fill_value=0)
    before = described.sparkSession.createDataFrame(lower, "bucket bigint, good_below bigint, bad_below bigint")
    inside = Window.partitionBy("bucket").orderBy("raw").rowsBetween(Window.unboundedPreceding, -1)
    below = {name: F.col(f"{name}_below") + F.coalesce(F.sum(name).over(inside), F.lit(0)) for name in ("good", "bad")}
    right = (F.lit(n_good) - below["good"]) / n_good + below["bad"] / n_bad
    cuts = bucketed.groupBy("bucket", "raw").agg(*counts).join(F.broadcast(before), "bucket").select(right.alias("right"), "raw")
    cut = cuts.agg(F.max(F.struct("right", "raw")).alias("best")).first().best.raw
    under = raws.filter(F.col("raw") < cut).agg(F.max("raw").alias("raw")).first().raw
    return cut if under is None else (cut + under) / 2


def fit_all(described: DataFrame, ridge: float = 1e-3) -> Ranking:
    """The ranking ``fit`` gives by all pairs of ``label, features``, of which only sums reach the driver.

    ``described`` is read several times and should be stored.
    """
    known = {row.label: row["count"] for row in described.groupBy("label").count().collect()}
    if not known.get(1) or not known.get(0):
        return Ranking(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0)
    ranking = Ranking(*_minimum(_total(described), ridge), 0.0)
    ranking.threshold = _threshold(described, ranking, known[1], known[0])
    return ranking


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Ranking:
    """A ranking from every labelled document that is not held out, described where it is read and stored."""

    kind = docs.schema["doc_id"].dataType.simpleString()

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(features(text.as_py()), np.float32) for text in batch.column("text")]
            arrays = [batch.column("doc_id"), batch.column("hash"), pa.array(rows, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "hash", "features"])

    def describe(texts: DataFrame) -> DataFrame:
        return texts.mapInArrow(described, f"doc_id {kind}, hash bigint, features array<float>")

    return fit_all(stored(described_rows(docs, labels, label, describe).select("label", "features"), "ranking-features"))


def score(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    A NULL text counts as empty and is scored by its zero features; a very long one is described whole.  Rows of NULL id are not
    held out.  Repeated rows score alike.  Only the text enters a score; other columns are
    ignored whatever their names.  An empty table gives an empty result.
    """

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        rows = np.array([features(text) for text in texts], float).reshape(len(texts), WIDTH)
        return pd.Series(ranking.scores(rows))

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
