"""Quality rules: counts within a document, and lines that many documents of a host share.

Every line is normalised (A-Z lower-cased, runs of blanks made one space, ends trimmed) and hashed.
A line is frequent when more than ``min_documents`` different texts of its host hold it, or more than
``share`` of the host's different texts, ``least`` of them at least: the first limit is the one that counts on
large hosts, the second on small ones.  Copies of one text count once.  Frequent lines are taken out; a
document of which less than ``min_left`` of the words remain is depleted and rejected.

The text is read once: what the rules need of it (counts, one hash and word count per line) is
stored, and all later steps work on that.  Line counts combine before they shuffle, first per
(host, line, text), so a line that a third of all documents hold is spread over all tasks.
The frequent lines are stored too; if they are small by measure the join that finds them again is a
broadcast, else both sides shuffle and adaptive execution splits a dominant line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import GAP, GAP_CHARACTERS, SMALL, let, lower_ascii, numbered, stored, text_or_empty, unused, without_rows, words
from tablewright.operators.joins import id_filter

SYMBOLS = r"[#*$%&|<>]"
MIN_DOCUMENTS = 100
SHARE = 0.02
LEAST = 5
MIN_LEFT = 0.3
FEW = 64
HOST_LINES = 4096


def _window_columns(rows: DataFrame) -> DataFrame:
    """Adds ``_hashes`` (64 bits) of all 3-word windows in order, and ``_twice``, those that occur again, sorted."""
    tokens = F.col("_tokens")
    window = lambda i: F.xxhash64(F.get(tokens, i - 1), F.get(tokens, i), F.get(tokens, i + 1))
    hashes = F.when(F.size(tokens) >= 3, F.transform(F.sequence(F.lit(1), F.size(tokens) - 2), window))
    rows = rows.withColumn("_hashes", F.coalesce(hashes, F.array().cast("array<bigint>")))
    rows = rows.withColumn("_sorted", F.sort_array("_hashes"))
    return rows.withColumn("_twice", F.filter("_sorted", lambda x, i: x == F.get(F.col("_sorted"), i - 1)))


def _repeated_words() -> Column:
    """How many words lie in a 3-word window that occurs at least twice in the text.

    The places of repeated windows, in order, cover three words each less what the next one covers.
    Few repeated windows are looked up one by one; many are found by sorting all windows with their
    places and marking equal neighbours.
    """

    def marked(ordered: Column) -> Column:
        hash_at = lambda i: F.get(ordered, i)["h"]
        repeats = F.filter(
            ordered, lambda x, i: x["h"].eqNullSafe(hash_at(i - 1)) | x["h"].eqNullSafe(hash_at(i + 1))
        )
        return F.sort_array(F.transform(repeats, lambda x: x["at"]))

    def covered(places: Column) -> Column:
        nearer = lambda at, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - at, F.lit(3)))
        return F.aggregate(F.transform(places, nearer), F.lit(0).cast("bigint"), lambda n, x: n + x)

    hashes, twice = F.col("_hashes"), F.col("_twice")
    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    looked_up = F.filter(
        F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda at: at.isNotNull()
    )
    places = F.when(F.size(twice) <= FEW, looked_up).otherwise(let(F.sort_array(placed), marked))
    return F.when(F.size(twice) > 0, let(places, covered)).otherwise(F.lit(0).cast("bigint"))


def measures(docs: DataFrame, number: str | None = None) -> DataFrame:
    """Per document: its counts, and for each line with a word the line's hash and number of words.

    ``row`` is the column ``number``; without one, rows are numbered as this scan finds them.
    """
    text = text_or_empty("text")
    row = F.monotonically_increasing_id() if number is None else F.col(number)
    rows = docs.select("doc_id", text.alias("_text"), F.xxhash64("source").alias("host"), *([number] if number else []))
    with_word = F.filter(F.split("_text", "\n"), lambda line: F.length(F.btrim(line, F.lit(GAP_CHARACTERS))) > 0)

    def described(line: Column) -> Column:
        def hashed(normal: Column) -> Column:
            blanks = F.length(normal) - F.length(F.replace(normal, F.lit(" "), F.lit("")))
            return F.struct(F.xxhash64(normal).alias("line"), (blanks + 1).cast("bigint").alias("words"))

        return let(F.btrim(F.regexp_replace(let(line, lower_ascii), GAP, " ")), hashed)

    in_lines = lambda lines: F.struct(
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.transform(lines, described).alias("lines"),
    )
    rows = _window_columns(rows.withColumn("_tokens", words(F.col("_text"))))
    return rows.select(
        "doc_id",
        "host",
        row.alias("row"),
        F.xxhash64("_text").alias("text_hash"),
        F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"),
        F.length(F.regexp_replace("_text", GAP, "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.size("_tokens").cast("bigint").alias("n_words"),
        _repeated_words().alias("n_repeat_words"),
        let(with_word, in_lines).alias("_l"),
    ).select("doc_id", "host", "row", "text_hash", "text_sha256", "word_chars", "n_words", "n_symbols", "n_repeat_words", "_l.*")


def frequent_lines(
    measured: DataFrame, min_documents: int = MIN_DOCUMENTS, share: float = SHARE, least: int = LEAST
) -> DataFrame:
    """``host, line`` (both hashed) of the lines above either limit."""
    held = measured.select("host", "text_hash", F.explode("lines.line").alias("line"))
    texts_of_line = (
        held.distinct()
        .groupBy("host", "line")
        .agg(F.count("*").alias("texts"))
        .filter(F.col("texts") > min(least, min_documents))
    )
    texts_of_host = measured.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("all_texts"))
    above = (F.col("texts") > min_documents) | ((F.col("texts") > least) & (F.col("texts") > share * F.col("all_texts")))
    return texts_of_line.join(texts_of_host, "host").filter(above).select("host", "line")


def judge(
    docs: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    share: float = SHARE,
    min_left: float = MIN_LEFT,
    least: int = LEAST,
    number: str | None = None,
) -> DataFrame:
    """One row per document: counts, ``removed_words``, ``base_failed``, ``kept``, and ``gone``, the frequent lines' hashes.

    A NULL text counts as empty; documents of fewer than 50 words, so empty ones too, fail the base
    rule.  NULL is a host of its own.  Very long texts are read whole.  Repeated rows are judged alike and count as
    one text, and lines that tie at a limit are treated alike.  Other columns of ``docs`` are ignored whatever their
    names.  An empty table gives an empty result.
    """
    measured = stored(measures(docs, number), "line-measures")
    frequent = stored(frequent_lines(measured, min_documents, share, least), "frequent-lines")
    return _verdicts(measured, frequent, min_left)


def _verdicts(measured: DataFrame, frequent: DataFrame, min_left: float) -> DataFrame:
    lines = measured.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.*")
    removed = lines.join(frequent, ["host", "line"]).groupBy("row").agg(
        F.sum("words").alias("removed_words"), F.collect_set("line").alias("gone")
    )
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return (
        measured.drop("lines")
        .join(removed, "row", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("bigint")))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (left >= min_left * F.col("n_words")))
    )


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines whose normal form hashes to one of ``gone``; as it came where that is NULL."""

    def stays(line: Column) -> Column:
        return ~F.array_contains(gone, F.xxhash64(F.btrim(F.regexp_replace(lower_ascii(line), GAP, " "))))

    return F.when(gone.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), stays), "\n"))


def with_stripped_digest(
    docs: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    share: float = SHARE,
    min_left: float = MIN_LEFT,
    least: int = LEAST,
) -> DataFrame:
    """What ``judge`` gives and ``stripped_sha256``, of the text without its frequent lines.

    Texts that lose lines are read a second time: a filter of their hashes leaves few others, and the frequent lines, one
    row per host, come to the texts.  Host and text hash say all that decides on a text, so its digest is found by them.
    """
    measured = stored(measures(docs), "line-measures")
    frequent = stored(frequent_lines(measured, min_documents, share, least), "frequent-lines")
    judged = stored(_verdicts(measured, frequent, min_left).drop("gone"), "line-verdicts")
    key = ["host", "text_hash"]
    lose = stored(judged.filter("removed_words > 0").select("text_hash").distinct(), "texts-to-strip")
    of_host = stored(frequent.groupBy("host").agg(F.collect_list("line").alias("gone")), "lines-of-hosts")
    text = text_or_empty("text")
    again = docs.select(F.xxhash64("source").alias("host"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    might_lose = id_filter(lose, "text_hash", lose.count())
    if might_lose is not None:
        again = again.filter(might_lose(F.col("text_hash")))
    digest = F.sha2(without_lines(F.col("text"), F.col("gone")).cast("binary"), 256)
    stripped = again.join(of_host, "host").select(*key, digest.alias("digest")).groupBy(*key).agg(F.first("digest").alias("digest"))
    whole = F.col("text_sha256")
    return judged.join(stored(stripped, "stripped-digests"), key, "left").withColumn("stripped_sha256", F.coalesce("digest", whole))


def drop_rejected(docs: DataFrame, **limits: float) -> DataFrame:
    """The documents that pass, with the columns and whole texts they came with.

    Judgements are found again by row number, so the documents are written once with their numbers.
    """
    rows, number = numbered(docs, "numbered-documents")
    return without_rows(rows, number, judge(rows, **limits, number=number).filter(~F.col("kept")), "rejected-rows")


def clean(
    docs: DataFrame,
    length: str | None = None,
    min_documents: int = MIN_DOCUMENTS,
    share: float = SHARE,
    min_left: float = MIN_LEFT,
    least: int = LEAST,
) -> DataFrame:
    """The documents that pass, without their frequent lines; ``length``, if named, is the text's length in characters anew.

    The documents are written once with what the rules need of them, so each carries its own base verdict.  The
    frequent lines come to them, one row per host, and no text is looked up by a number; where a host has over
    ``HOST_LINES`` of them, lines meet documents one by one, and what was found is joined by row number.  A document
    that loses every line was depleted and goes; NULL and empty texts fail the base rule and go.
    """
    whole = unused(docs, "_document")
    needed = ["row", "host", "text_hash", "n_words", "n_repeat_words", "lines"]
    rows = measures(docs.withColumn(whole, F.struct(*docs.columns)), whole).select(*needed)
    rows = stored(rows.withColumn("number", F.monotonically_increasing_id()), "measured-documents", **SMALL)
    frequent = stored(frequent_lines(rows, min_documents, share, least), "frequent-lines")
    most = frequent.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    if most <= HOST_LINES:
        of_host = frequent.groupBy("host").agg(F.collect_list("line").alias("known"))
        hit = F.filter("lines", lambda line: F.array_contains("known", line["line"]))
        found = rows.join(of_host, "host", "left").withColumn("hit", hit)
    else:
        lines = rows.select("number", "host", F.explode("lines").alias("l")).withColumn("line", F.col("l.line"))
        hits = lines.join(frequent, ["host", "line"]).groupBy("number").agg(F.collect_list("l").alias("hit"))
        found = rows.join(stored(hits, "frequent-lines-of-rows"), "number", "left")
    removed = F.coalesce(F.aggregate("hit", F.lit(0).cast("bigint"), lambda n, line: n + line["words"]), F.lit(0))
    passed = (F.col("n_words") >= 50) & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words"))
    found = found.filter(passed & (F.col("n_words") - removed >= min_left * F.col("n_words")))
    gone = F.when(F.size("hit") > 0, F.transform("hit", lambda line: line["line"]))
    found = found.withColumn("gone", gone).withColumn("stripped", without_lines(F.col("row")["text"], F.col("gone")))
    new = {name: F.col("row")[name] for name in docs.columns} | {"text": F.col("stripped")}
    if length is not None:
        counted = F.length("stripped").cast(docs.schema[length].dataType)
        new[length] = F.when(F.col("gone").isNotNull(), counted).otherwise(new[length])
    return found.select(*[column.alias(name) for name, column in new.items()])


def strip_lines(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, share: float = SHARE, least: int = LEAST
) -> DataFrame:
    """All documents, with their frequent lines taken out of ``text``; other columns as they came.

    Writes the documents once with their numbers, as ``drop_rejected`` does.  NULL and empty texts stay as they are, and so
    do lines without a word.
    """
    rows, number = numbered(docs, "numbered-documents")
    gone = unused(rows, "_gone")
    marked = judge(rows, min_documents, share, least=least, number=number).filter("gone IS NOT NULL")
    found = rows.join(stored(marked.select(F.col("row").alias(number), F.col("gone").alias(gone)), "lines-to-strip"), number, "left")
    return found.withColumn("text", without_lines(F.col("text"), F.col(gone))).select(*docs.columns)
