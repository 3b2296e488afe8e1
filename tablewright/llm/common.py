"""What several operators share: words, letter case, stored intermediates, stored row numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.session import shared_folder

GAP = r"[\x20\x09-\x0D]+"
GAP_CHARACTERS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SMALL = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}


def text_or_empty(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """The runs of characters other than space and U+0009 to U+000D, in order; none for NULL."""
    inner = F.btrim(text, F.lit(GAP_CHARACTERS))
    return F.when(F.length(inner) > 0, F.split(inner, GAP)).otherwise(F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of single-byte characters take the faster built-in."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def stored(frame: DataFrame, name: str, **options: str) -> DataFrame:
    """The frame written once to the folder all executors share, and read from there.

    Cuts the lineage; what was written outlives the executors that wrote it.  Sizes of stored
    frames are known to the planner, so joins with small ones become broadcasts by measured size.
    """
    path = shared_folder(frame.sparkSession, name)
    frame.write.options(**options).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows written once together with a number each, and the name of the number's column.

    ``monotonically_increasing_id`` holds the partition's index, and which rows a partition has depends on
    the cores registered when its scan is planned.  A second scan, of a stored table too, may number
    rows otherwise, so a number that later jobs look up is written with its row.  The copy holds whole
    texts and is compressed more than other stored frames.
    """
    number = unused(docs, "_row")
    return stored(docs.withColumn(number, F.monotonically_increasing_id()), name, **SMALL), number


def without_rows(docs: DataFrame, number: str, rows: DataFrame, name: str) -> DataFrame:
    """``docs`` as ``numbered`` gives it, less the rows in ``rows(row)`` and without the number."""
    gone = stored(rows.select(F.col("row").alias(number)), name)
    return docs.join(gone, number, "left_anti").drop(number)


def unused(frame: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of the frame has it."""
    taken = {column.lower() for column in frame.columns}
    while name in taken:
        name += "_"
    return name
