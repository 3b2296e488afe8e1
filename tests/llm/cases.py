"""Awkward documents and pages, and plain readings of the common rules."""

from __future__ import annotations

import re

LONG = "The cat sat on the mat and looked at the dog again today. " * 2500
PROSE = " ".join(f"word{i} stays here" for i in range(40))

DOCS = [
    (0, PROSE, "en", "a", 1),
    (1, PROSE.upper(), "en", "a", 2),
    (2, None, "en", "a", None),
    (3, "", "en", None, 0),
    (4, " \t\n ", None, "b", 4),
    (5, LONG, "en", "a", 5),
    (6, "Été à la plage ÉTÉ", "fr", "c", 6),
    (7, "été à la plage ÉtÉ", "fr", "c", 7),
    (7, "été à la plage ÉtÉ", "fr", "c", 7),
    (None, PROSE, "en", None, 8),
    (8, PROSE + " tail", "en", "b", 9),
    (9, "one two", "en", "b", 10),
    (10, "x y z " * 40, "en", "a", 11),
    (11, "line\nline\nother\n\n" + PROSE, "en", "a", 12),
    (None, None, None, None, None),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = (
    "size kept row host line words fp shard slot key keep_id group_size component_id ids decoded score predicted "
    "held_out label target taken quota _norm _hash _salt _text _tokens _row _arc _at _rank first bits rule verdict n"
).split()


def documents(spark, rows=DOCS, clashing=True):
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.selectExpr("*", *[f"'other' AS {name}" for name in CLASHING]) if clashing else frame


def tokens(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_ascii(text: str | None) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def plain(frame, *columns):
    rows = [tuple(row) for row in frame.select(*columns).collect()]
    return sorted(rows, key=lambda row: [(value is None, str(value)) for value in row])


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda row: [(value is None, str(value)) for value in row])
