"""The tree and its versions against a tree built in memory, and the defined results."""

from __future__ import annotations

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from cases import documents, lower_ascii
from pyspark.sql import functions as F

from tablewright.llm import merkle, queries


def hashed(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return hashed(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def levels_of(nodes):
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        levels.append([hashed(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def steps_of(levels, at):
    for level in levels[:-1]:
        run = at - at % 8
        yield level[run:at], level[at + 1 : run + 8]
        at //= 8


def expected(rows):
    families = defaultdict(list)
    for row in rows:
        families[row[2]].append((row[0] is not None, row[0] or 0, leaf_of(*row), row))
    langs = sorted(families, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {lang: levels_of([leaf for _, _, leaf, _ in sorted(families[lang], key=lambda x: x[:3])]) for lang in langs}
    upper = levels_of([trees[lang][-1][0] for lang in langs])
    out = []
    for place, lang in enumerate(langs):
        for at, (_, _, leaf, row) in enumerate(sorted(families[lang], key=lambda x: x[:3])):
            steps = [*steps_of(trees[lang], at), *steps_of(upper, place)]
            node = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                node = leaf_of(row[0], None if row[1] is None else lower_ascii(row[1]), *row[2:])
            for before, after in steps:
                node = hashed(*before, node, *after)
            proof = hashed(*[side for before, after in steps for side in (*before, *after)])
            out.append((row[0], leaf, trees[lang][-1][0], upper[-1][0], proof, node, node == upper[-1][0]))
    return out


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=lambda row: [(value is None, str(value)) for value in row])


def run(spark, rows, tmp_path):
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    return sorted_rows(queries.op13_merkle(spark, str(tmp_path)).collect())


def test_awkward_rows(spark, tmp_path):
    from cases import DOCS

    assert run(spark, DOCS, tmp_path) == sorted_rows(expected(DOCS))


@pytest.mark.parametrize("fanout_levels", [1, 4])
def test_groups_of_many_blocks(spark, tmp_path, monkeypatch, fanout_levels):
    monkeypatch.setattr(merkle, "LEVELS", fanout_levels)
    monkeypatch.setattr(merkle, "BLOCK", 8**fanout_levels)
    sizes = {None: 1, "a": 8, "b": 9, "é": 65, "z": 600, "zz": 64, "y": 2, "x": 1, "w": 3, "v": 4}
    rows = [(len(lang or "") * 1000 + 3 * i, f"Text {i % 7}", lang, "S", i % 5) for lang, n in sizes.items() for i in range(n)]
    rows += [rows[50]] * 3 + [(None, None, "z", None, None)] * 20
    assert run(spark, rows, tmp_path) == sorted_rows(expected(rows))


def test_one_row_and_none(spark, tmp_path):
    rows = [(3, "Only", "en", None, 4)]
    assert run(spark, rows, tmp_path) == sorted_rows(expected(rows))
    assert merkle.manifest(documents(spark, []), F.lit(True)).collect() == []


def test_versions_share_all_but_their_path(spark):
    rows = [(i, f"Row {i}", "en" if i % 3 else "de", "s", i) for i in range(100)]
    found = merkle.manifest(documents(spark, rows), F.col("doc_id") == 7).collect()
    (seven,) = [row for row in found if row["copies"] is not None]
    # 67 leaves make levels of 9, 2 and 1 nodes, and two groups one root.
    assert seven["doc_id"] == 7 and len(seven["copies"]) == 5
    assert seven["copies"][0] == leaf_of(7, "row 7", "en", "s", 7) and seven["copies"][-1] == seven["folded_root"]
    assert not seven["verified"] and all(row["verified"] for row in found if row["doc_id"] != 7)
    again = merkle.manifest(documents(spark, [(i, "row 7" if i == 7 else text, *rest) for i, text, *rest in rows]), F.lit(False))
    assert {row["root"] for row in again.collect()} == {seven["folded_root"]}
