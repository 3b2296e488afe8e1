"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the document has a label.  A sentence's chance of being
toxic is the logistic function of the weights of its different words; a document is toxic if any
sentence is, so its chance is the noisy-or of its sentences: 1 - prod(1 - p).  Weights are fitted to
the documents' labels through the noisy-or, and the sentence chances then say which sentences offend.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.labelled import held_out, training_rows

SAMPLE = 8000
SLOTS = 1 << 18
LIMIT = 0.7
MIN_DOCUMENTS = 8
MIN_EXCESS = 4.0
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> list[str]:
    return [part for part in _SENTENCE.findall(text or "") if _WORD.search(part)]


class Slots:
    """Numbers of words by hash, kept while a task lasts, at most ``kept`` of them."""

    def __init__(self, kept: int = 500_000) -> None:
        self.known: dict[str, int] = {}
        self.kept = kept

    def __call__(self, word: str) -> int:
        slot = self.known.get(word)
        if slot is None:
            if len(self.known) >= self.kept:
                self.known.clear()
            slot = self.known[word] = xxhash.xxh32_intdigest(word) % SLOTS
        return slot

    def of(self, text: str | None) -> tuple[list[int], list[int]]:
        """The slots of all sentences' different words, and how many belong to each sentence."""
        slots, sizes = [], []
        for sentence in sentences(text):
            words = {self(word) for word in _WORD.findall(sentence.lower())}
            slots.extend(sorted(words))
            sizes.append(len(words))
        return slots, sizes


@dataclass
class Model:
    weights: np.ndarray
    base: float
    shift: float

    def sentence_logits(self, slots: list[int], sizes: list[int]) -> np.ndarray:
        if not sizes:
            return np.zeros(0)
        starts = np.cumsum([0, *sizes[:-1]])
        return np.add.reduceat(self.weights[np.array(slots, np.int64)], starts) + self.base

    def score(self, slots: list[int], sizes: list[int]) -> float:
        return self.of_sentences(self.sentence_logits(slots, sizes))

    def of_sentences(self, logits: np.ndarray) -> float:
        """The noisy-or of the sentences, moved so that ``LIMIT`` tells the labels apart best."""
        return float(_moved(_not_any(_none(logits).sum()), self.shift))


def _none(logits: np.ndarray) -> np.ndarray:
    """log(1 - p) of each sentence."""
    return -np.logaddexp(0, np.clip(logits, -30, 30))


def _not_any(log_none: np.ndarray | float) -> np.ndarray | float:
    return -np.expm1(np.minimum(log_none, -1e-12))


def _moved(chance: np.ndarray | float, shift: float) -> np.ndarray | float:
    chance = np.clip(chance, 1e-12, 1 - 1e-12)
    return 1 / (1 + np.exp(-np.clip(np.log(chance / (1 - chance)) + shift, -30, 30)))


def fit(bags: Sequence[tuple[Sequence[int], Sequence[int]]], labels: np.ndarray, steps: int = 150, decay: float = 1e-3) -> Model:
    """Weights from documents as bags of sentences; with one label only every score is below ``LIMIT``.

    Only words of at least ``MIN_DOCUMENTS`` documents that toxic ones hold ``MIN_EXCESS`` standard
    deviations more often than chance carry weight; a wrong label otherwise is learnt by heart from
    rare words.  Starts from their smoothed log odds and follows the noisy-or's gradient.
    """
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(SLOTS), -12.0, 0.0)
    slots, sizes = (np.concatenate([np.asarray(bag[part], np.int64) for bag in bags]) for part in (0, 1))
    used, column = np.unique(slots, return_inverse=True)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    doc = np.repeat(np.arange(len(bags)), [len(per) for _, per in bags])
    n = len(labels)
    seen = np.unique(doc[sentence] * len(used) + column)
    toxic = labels[seen // len(used)] == 1
    inside = np.bincount(seen[toxic] % len(used), minlength=len(used))
    outside = np.bincount(seen[~toxic] % len(used), minlength=len(used))
    odds = np.log((inside + 0.5) / (labels.sum() + 1)) - np.log((outside + 0.5) / (n - labels.sum() + 1))
    evidence, share = inside + outside, labels.mean()
    excess = (inside - evidence * share) / np.sqrt(np.maximum(evidence, 1) * share * (1 - share))
    telling = (evidence >= MIN_DOCUMENTS) & (excess >= MIN_EXCESS)
    weights = np.where(telling, odds, 0.0)
    base, mean = -7.0, np.zeros(len(used) + 1)
    square = np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        logits = np.bincount(sentence, weights[column], len(sizes)) + base
        none = np.bincount(doc, _none(logits), n)
        any_ = np.clip(_not_any(none), 1e-9, 1 - 1e-9)
        outer = np.where(labels == 1, -(1 - any_) / any_, 1.0)
        inner = outer[doc] / (1 + np.exp(-np.clip(logits, -30, 30)))
        slope = np.bincount(column, inner[sentence], len(used))
        full = np.append(slope, inner.sum()) / n
        mean = 0.9 * mean + 0.1 * full
        square = 0.99 * square + 0.01 * full**2
        move = 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-5)
        weights = np.where(telling, np.maximum(weights - move[:-1] - decay, 0), 0.0)
        base = float(np.clip(base - move[-1], -12, -3))
    logits = np.bincount(sentence, weights[column], len(sizes)) + base
    chance = np.clip(_not_any(np.bincount(doc, _none(logits), n)), 1e-12, 1 - 1e-12)
    raw = np.log(chance / (1 - chance))
    cuts = np.unique(np.quantile(raw, np.linspace(0, 1, 1001)))
    right = [np.mean((raw >= cut) == (labels == 1)) for cut in cuts]
    best = [cut for cut, value in zip(cuts, right) if value >= max(right) - 1e-12]
    everything = np.zeros(SLOTS)
    everything[used] = weights
    return Model(everything, base, float(np.log(LIMIT / (1 - LIMIT)) - (best[0] + best[-1]) / 2))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "toxic") -> Model:
    """A model from at most ``sample`` labelled documents, whose word numbers alone reach the driver."""

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = Slots()
        for batch in batches:
            bags = [slots.of(text) for text in batch["text"]]
            yield pd.DataFrame(
                {"key": batch["key"], "label": batch["label"], "slots": [b[0] for b in bags], "sizes": [b[1] for b in bags]}
            )

    rows = training_rows(docs, labels, label, sample)
    found = rows.mapInPandas(described, "key bigint, label int, slots array<int>, sizes array<int>").toArrow()
    found = found.sort_by([("key", "ascending"), ("label", "ascending")])
    bags = [tuple(found[name][i].values.to_numpy(zero_copy_only=False) for name in ("slots", "sizes")) for i in range(len(found))]
    return fit(bags, found["label"].to_numpy().astype(int))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, worst_place, worst_chance``.

    The last two are the number, from 0, and the own chance of the sentence most likely to be toxic, the first of
    equal ones.  Texts without words, NULL ones too, have no sentence and score near 0.  Very long texts are read
    whole.  Rows of NULL id are not held out.  Repeated rows score alike.  Only the text enters a score; other
    columns are ignored whatever their names.  An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.base, model.shift))

    @F.pandas_udf("score double, place int, chance double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        slots, known = Slots(), Model(*sent.value)
        for batch in texts:
            logits = [known.sentence_logits(*slots.of(text)) for text in batch]
            worst = [int(found.argmax()) if len(found) else None for found in logits]
            yield pd.DataFrame(
                {
                    "score": pd.Series([known.of_sentences(found) for found in logits], dtype="float64"),
                    "place": pd.array(worst, dtype="Int32"),
                    "chance": pd.Series(
                        [1 / (1 + np.exp(-found[at])) if at is not None else None for found, at in zip(logits, worst)], dtype="float64"
                    ),
                }
            )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored("text").alias("s"))
    return rows.select(
        "doc_id",
        "held_out",
        F.col("s.score").alias("score"),
        (F.col("s.score") >= LIMIT).cast("int").alias("predicted"),
        F.col("s.place").alias("worst_place"),
        F.col("s.chance").alias("worst_chance"),
    )


def offending(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``doc_id, place, sentence, chance`` of every sentence whose own chance is at least ``least``."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.base, model.shift))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def located(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, known = Slots(), Model(*sent.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                chances = 1 / (1 + np.exp(-known.sentence_logits(*slots.of(text))))
                for place in np.flatnonzero(chances >= least).tolist():
                    rows.append((doc_id, place, sentences(text)[place].strip(), float(chances[place])))
            yield pd.DataFrame(rows, columns=["doc_id", "place", "sentence", "chance"])

    return docs.select("doc_id", "text").mapInPandas(located, f"doc_id {kind}, place int, sentence string, chance double")
