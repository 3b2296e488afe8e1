"""Each stage against a brute-force version over what its predecessor kept."""

from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import sentencepiece
import test_mixing
import test_quality_rules
import test_simhash
from cases import DOCS, SCHEMA, documents, lower_ascii, ordered, tokens

from tablewright.llm import mixing
from tablewright.llm.common import stored
from tablewright.llm.queries import tokenizer_path

BASE = [" ".join(f"d{i}w{k}" for k in range(60 + i)) for i in range(24)]
ROWS = DOCS + [(1000 + i, text, "en", f"s{i % 4}", len(text)) for i, text in enumerate(BASE)]
ROWS += [(4000 + i, BASE[i] + " more" * 5 + f" {i}\nSubscribe  to our NEWS", "en", "news", 1) for i in range(8)]
ROWS += [(2000 + i, BASE[i].upper(), "en", "s1", 1) for i in range(6)]
ROWS += [(3000 + i, " ".join(["v%d" % (k if k != i else -1) for k in range(300)]), None, None, 1) for i in range(8)]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The input of every stage, and the last one's output."""
    frames = [stored(documents(spark, ROWS, clashing=False), "pipeline-input")]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], "unused"), f"pipeline-{name}"))
    return frames


def rows_of(frame):
    return [tuple(row) for row in frame.select(*COLUMNS).collect()]


def test_order_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash", "mixing", "sentencepiece"]
    assert all(frame.columns == COLUMNS for frame in stages[:-1])


def test_rejected_documents_go(stages):
    verdicts = test_quality_rules.brute(ROWS, 100, 0.02, 0.3)
    assert Counter(row[0] for row in rows_of(stages[1])) == Counter(row[0] for row in verdicts if row[-1])
    frequent = test_quality_rules.frequent_of(ROWS, 100, 0.02)
    strip = lambda row: (row[0], test_quality_rules.stripped(row[1] or "", row[3], frequent))
    assert {row[:2] for row in rows_of(stages[1])} <= {strip(row) for row in ROWS}
    lost = {row[0] for row in ROWS if strip(row)[1] != (row[1] or "")}
    assert lost and all(row[4] == len(row[1]) for row in rows_of(stages[1]) if row[0] in lost)


def test_the_largest_id_of_equal_texts_stays(stages):
    expected = {}
    for row in rows_of(stages[1]):
        text = lower_ascii(row[1])
        if text not in expected or (row[0] is not None and (expected[text][0] is None or row[0] > expected[text][0])):
            expected[text] = row
    assert ordered(rows_of(stages[2])) == ordered(expected.values())


def test_one_of_each_near_duplicate_group_stays(stages):
    before = rows_of(stages[2])
    groups = {component for _, _, component in test_simhash.brute(before, 2)}
    assert Counter(row[0] for row in rows_of(stages[3])) == Counter(groups) and len(groups) < len(before)
    assert set(rows_of(stages[3])) <= set(before)


def test_sources_come_near_their_targets(spark, stages):
    sizes = Counter()
    for row in rows_of(stages[3]):
        sizes[row[3]] += len(tokens(row[1]))
    mixed = rows_of(stages[4])
    taken = Counter()
    for row in mixed:
        taken[row[3]] += len(tokens(row[1]))
    for source, target in test_mixing.targets(sizes, (5, 2, 1), 1.5, 2).items():
        assert abs(taken[source] - target) <= 96
    again = mixing.mixed_documents(spark.createDataFrame(rows_of(stages[3])[::-1], SCHEMA))
    assert ordered(rows_of(again)) == ordered(mixed)


def test_tokens_are_the_library_s(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    expected = []
    for doc_id, text, *_ in rows_of(stages[4]):
        ids = library.encode(text, add_bos=True, add_eos=True)
        decoded = hashlib.sha256(library.decode(ids).encode()).hexdigest()
        expected.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), decoded))
    found = stages[5].select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert ordered(found) == ordered(expected)


def test_run_gives_the_last_stage_s_rows(spark, stages, tmp_path):
    stages[0].write.parquet(str(tmp_path / "documents.parquet"))
    columns = ("doc_id", "n_tokens", "ids_sha256")
    assert ordered(corpus_pipeline.run(spark, str(tmp_path)).select(*columns).collect()) == ordered(stages[5].select(*columns).collect())


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
