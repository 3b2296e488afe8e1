from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from cases import DOCS, documents, lower_ascii, ordered, plain, tokens

from tablewright.llm import quality_rules

COLUMNS = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words removed_words base_failed kept".split()


def normal(line):
    return " ".join(tokens(lower_ascii(line)))


def frequent_of(rows, min_documents, share, least=5):
    held, texts = defaultdict(set), defaultdict(set)
    for _, text, _, host, _ in rows:
        texts[host].add(text or "")
        for line in (text or "").split("\n"):
            if tokens(line):
                held[host, normal(line)].add(text or "")
    above = lambda n, all_texts: n > min_documents or (n > least and n > share * all_texts)
    return {key for key, of in held.items() if above(len(of), len(texts[key[0]]))}


def stripped(text, host, frequent):
    return "\n".join(line for line in text.split("\n") if not tokens(line) or (host, normal(line)) not in frequent)


def brute(rows, min_documents, share, min_left):
    frequent = frequent_of(rows, min_documents, share)
    out = []
    for doc_id, text, _, host, _ in rows:
        words = tokens(text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
        lines = [line for line in (text or "").split("\n") if tokens(line)]
        removed = sum(len(tokens(line)) for line in lines if (host, normal(line)) in frequent)
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        kept = not failed and len(words) - removed >= min_left * len(words)
        symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
        out.append((doc_id, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), removed, failed, kept))
    return ordered(out)


def shared_lines():
    rows = []
    for i in range(30):
        own = " ".join(f"own{i}x{k}" for k in range(60))
        rows.append((200 + i, f"{own}\nAll  Rights reserved {'here ' * 3}", "en", "h", 1))
        rows.append((300 + i, f"w{i}\n" + "\n".join(" ".join(f"menu{k}n{j}" for j in range(20)) for k in range(4)), "en", "h", 1))
    return rows + [(400, "repeat the same words " * 30 + "#*$%&|<>", "en", "h", 1)]


def test_against_brute_force(spark):
    rows = DOCS + shared_lines()
    for limits in ((20, 0.02, 0.3), (100, 0.02, 0.3), (20, 0.9, 0.3)):
        found = quality_rules.judge(documents(spark, rows), *limits)
        assert plain(found, *COLUMNS) == brute(rows, *limits)


def test_copies_of_one_text_count_once(spark):
    rows = [(i, "\n".join(" ".join(f"l{k}w{j}" for j in range(30)) for k in range(3)), "en", "h", 1) for i in range(50)]
    assert quality_rules.judge(documents(spark, rows), 5, 0.0).filter("kept").count() == 50


def test_rejected_documents_go_and_texts_stay(spark):
    rows = DOCS + shared_lines()
    docs = documents(spark, rows)
    limits = {"min_documents": 20, "share": 0.02, "min_left": 0.3}
    kept = Counter(row[0] for row in brute(rows, *limits.values()) if row[-1])
    left = quality_rules.drop_rejected(docs, **limits)
    assert left.columns == docs.columns
    texts = {(row[0], row[1]) for row in rows}
    found = left.select("doc_id", "text").collect()
    assert Counter(row.doc_id for row in found) == kept
    assert {tuple(row) for row in found} <= texts


def test_lines_are_stripped(spark):
    rows = shared_lines()
    out = quality_rules.strip_lines(documents(spark, rows), 20, 0.02).filter("doc_id = 205").first()
    assert out.text == " ".join(f"own5x{k}" for k in range(60))


def test_either_limit_is_enough(spark):
    rows = shared_lines()
    footer = ("h", normal("All  Rights reserved " + "here " * 3))
    for limits, found in (((29, 0.9), True), ((30, 0.9), False), ((1000, 0.4), True), ((1000, 0.5), False), ((1000, 0.4, 30), False)):
        assert (footer in frequent_of(rows, *limits)) == found
        names = ("min_documents", "share", "least")
        kept = quality_rules.judge(documents(spark, rows), **dict(zip(names, limits))).filter("doc_id = 205").first()
        assert kept["removed_words"] == (6 if found else 0)


@pytest.mark.parametrize("host_lines", [0, 4096])
def test_clean_drops_and_strips(spark, monkeypatch, host_lines):
    monkeypatch.setattr(quality_rules, "HOST_LINES", host_lines)
    rows = DOCS + shared_lines()
    limits = (20, 0.02, 0.3)
    frequent = frequent_of(rows, *limits[:2])
    verdicts = brute(rows, *limits)
    ids = {row[0] for row in verdicts if row[-1]}
    docs = documents(spark, rows)
    left = quality_rules.clean(docs, length="n_chars", min_documents=20, share=0.02, min_left=0.3)
    assert left.columns == docs.columns
    expected = []
    for row in rows:
        if row[0] in ids and row[1] and not any(v[0] == row[0] and not v[-1] for v in verdicts):
            text = stripped(row[1], row[3], frequent)
            expected.append((row[0], text, len(text) if text != row[1] else row[4]))
    assert plain(left.filter("doc_id IS NOT NULL"), "doc_id", "text", "n_chars") == ordered([row for row in expected if row[0] is not None])


def test_digests_of_stripped_texts(spark):
    rows = DOCS + shared_lines()
    frequent = frequent_of(rows, 20, 0.02)
    found = quality_rules.with_stripped_digest(documents(spark, rows), min_documents=20)
    digest = lambda row: hashlib.sha256(stripped(row[1] or "", row[3], frequent).encode()).hexdigest()
    assert plain(found, "doc_id", "stripped_sha256") == ordered([(row[0], digest(row)) for row in rows])


def test_null_and_empty_texts_are_stripped_of_nothing(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "h", 0), (3, " \n ", "en", "h", 3)]
    assert plain(quality_rules.strip_lines(documents(spark, rows)), "doc_id", "text") == ordered([row[:2] for row in rows])


def test_lines_go_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = quality_rules.judge(docs).filter("removed_words > 0")
    assert found.count() > 50


def test_empty_table(spark):
    assert quality_rules.judge(documents(spark, [])).count() == 0
