"""Runs against a plain search for every period, and the defined results."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

from cases import documents, tokens

from tablewright.llm import periodic_runs, queries


def runs_of(ws, shortest=6, exponent=4):
    """Every maximal stretch of each period, the smallest period of equal stretches."""
    found = {}
    for period in range(1, len(ws) // exponent + 1):
        at = 0
        while at + period < len(ws):
            end = at
            while end + period < len(ws) and ws[end] == ws[end + period]:
                end += 1
            length = end - at + period
            if end > at and length >= max(shortest, exponent * period):
                found.setdefault((at, length), period)
            at = max(end, at + 1)
    return sorted((start, length, period) for (start, length), period in found.items())


def left_of(ws, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def planted_words(doc_id, text):
    ws = tokens(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not ws:
        return ws
    g, n = h // 10, len(ws)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    ws = planted_words(doc_id, text)
    runs = runs_of(ws)
    best = max(runs, key=lambda run: (run[1] / run[2], -run[0], -run[2])) if runs else (None, None, None)
    lines = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
    return (
        doc_id,
        len(runs),
        *best,
        1000 * best[1] // best[2] if runs else None,
        sha256(lines.encode()).hexdigest(),
        sha256(left_of(ws, runs).encode()).hexdigest(),
    )


def random_words(rng):
    letters = "abcde"[: rng.choice([1, 2, 3, 5])]
    ws = [rng.choice(letters) for _ in range(rng.randrange(60))]
    if rng.random() < 0.5:
        block = [rng.choice(letters) for _ in range(rng.randrange(1, 7))]
        ws[10:10] = (block * 12)[: rng.randrange(1, 50)]
    return ws


def test_all_runs_of_random_texts():
    rng = random.Random(3)
    for _ in range(200):
        texts = [random_words(rng) for _ in range(rng.randrange(1, 6))]
        found = periodic_runs.collapse([[w.encode() for w in ws] for ws in texts])
        for ws, (runs, left) in zip(texts, found):
            plain = [tuple(run.values()) for run in runs]
            assert plain == runs_of(ws)
            assert left == left_of(ws, plain)


def test_other_limits():
    ws = [w.encode() for w in "a b a b x y y z z z".split()]
    ((runs, left),) = periodic_runs.collapse([ws], shortest=2, exponent=2)
    assert [tuple(run.values()) for run in runs] == [(0, 4, 2), (5, 2, 1), (7, 3, 1)]
    assert left == "a b x y z"


def test_a_very_long_text_of_one_word():
    ((runs, left),) = periodic_runs.collapse([[b"a"] * 300_000])
    assert runs == [{"start": 0, "length": 300_000, "period": 1}] and left == "a"


def test_query_digests(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(random_words(rng)) if i % 7 else " \t".join(random_words(rng) * 3), None, None, None) for i in range(150)]
    rows += [(None, "a " * 9, None, None, None), (151, None, None, None, None), (152, "", None, None, None), (152, " \n", "x", "y", 1)]
    rows += [rows[3], rows[3], (153, "é é é é é é ok", None, None, None), (154, "a a " * 7, None, None, None)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(row) for row in queries.op12_periodic_runs(spark, str(tmp_path)).collect()]
    key = lambda row: [(value is None, str(value)) for value in row]
    assert sorted(got, key=key) == sorted([digest(row[0], row[1]) for row in rows], key=key)


def test_columns_that_clash_and_batches(spark, monkeypatch):
    frame = documents(spark).selectExpr("*", "'x' AS runs", "'y' AS collapsed")
    found = periodic_runs.detect(frame)
    assert found.columns == [name for name in frame.columns if name not in ("text", "runs", "collapsed")] + ["runs", "collapsed"]
    rows = {row["doc_id"]: row for row in found.collect()}
    assert [tuple(run) for run in rows[10]["runs"]] == [(0, 120, 3)] and rows[10]["collapsed"] == "x y z"
    assert [tuple(run) for run in rows[5]["runs"]] == [(0, 32500, 13)]
    assert rows[3]["runs"] == [] and rows[3]["collapsed"] == "" and rows[2]["collapsed"] == ""
    assert rows[None] is not None


def test_empty(spark):
    assert periodic_runs.digests(periodic_runs.detect(documents(spark, []))).collect() == []
