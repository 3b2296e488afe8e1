from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from cases import DOCS, documents, lower_ascii, ordered, plain

from tablewright.llm import exact_dedup
from tablewright.llm.common import stored


def brute(rows, best):
    groups = defaultdict(list)
    for row in rows:
        groups[lower_ascii(row[1])].append(row[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = best(known) if known else None
        stay = ids.index(keep)
        for at, i in enumerate(ids):
            out.append((i, keep, len(ids), at == stay, hashlib.sha256(text.encode()).hexdigest()))
    return ordered(out)


@pytest.mark.parametrize("keep, best", [("largest", max), ("smallest", min)])
@pytest.mark.parametrize("hot_rows", [1000, 1])
def test_against_brute_force(spark, keep, best, hot_rows):
    rows = DOCS + [(100 + i, "Copy", "en", "z", 1) for i in range(40)]
    rows += [(None, "Nameless", "en", "z", 1)] * 30 + [(7, "Again", "en", "z", 1)] * 30 + [(None, "again", "en", "z", 1)] * 5
    found = exact_dedup.exact_dedup(documents(spark, rows), keep, hot_rows=hot_rows)
    assert plain(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute(rows, best)


def test_copies_go(spark):
    docs = documents(spark)
    left = exact_dedup.drop_copies(docs, "largest")
    assert left.columns == docs.columns
    texts = [lower_ascii(row.text) for row in left.collect()]
    assert len(texts) == len(set(texts)) == len({lower_ascii(row[1]) for row in DOCS})


@pytest.mark.parametrize("ids", [[None], [5], [5, None, 6]])
def test_one_of_split_copies_stays(spark, ids):
    rows = [(ids[i % len(ids)], "Same TEXT", "en", "z", i) for i in range(200)]
    left = exact_dedup.drop_copies(documents(spark, rows), "largest", hot_rows=10).collect()
    assert [row.doc_id for row in left] == [max((i for i in ids if i), default=None)]


def test_rows_of_one_id_are_split_evenly(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(exact_dedup, "stored", lambda frame, name: written.setdefault(name, stored(frame, name)))
    rows = [(None, "same", "en", "z", 1)] * 2000
    exact_dedup.exact_dedup(documents(spark, rows), hot_rows=100)
    sizes = [row["count"] for row in written["judged-texts"].groupBy("_salt").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


def test_a_carried_text_moves_once(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(exact_dedup, "stored", lambda frame, name: written.setdefault(name, frame) and stored(frame, name))
    docs = documents(spark, clashing=False)
    for call, forms in ((exact_dedup.drop_copies, {"_c_text"}), (exact_dedup.exact_dedup, {"_norm"})):
        written.clear()
        call(docs).count()
        todo, moved = [written["judged-texts"]._jdf.queryExecution().sparkPlan()], []
        while todo:
            node = todo.pop()
            todo += [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() == "Exchange" and "rangepartitioning" in node.toString().split("\n")[0]:
                moved.append({name.split("#")[0] for name in node.output().mkString(" ").split()})
        assert moved and all(columns & {"_norm", "_c_text"} == forms for columns in moved)


def test_empty_table(spark):
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(documents(spark, []), keep="newest")
