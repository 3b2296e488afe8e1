"""Looking at a few rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def random_rows(frame: DataFrame, key: str, n: int = 5, seed: int = 0) -> DataFrame:
    """``n`` rows picked at random, the same ones for the same seed however tasks are retried.

    Rows are ranked by a digest of seed and key, and each task keeps its ``n`` smallest.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(f"`{key}`").cast("string")))
    return frame.orderBy(digest, F.col(f"`{key}`")).limit(n)


def page(frame: DataFrame, keys: Sequence[str], offset: int = 0, size: int = 10) -> DataFrame:
    """One page of a table in key order."""
    return frame.orderBy(*[F.col(f"`{key}`").asc_nulls_last() for key in keys]).offset(offset).limit(size)


def page_after(frame: DataFrame, keys: Sequence[str], last: Sequence | None = None, size: int = 10) -> DataFrame:
    """The page after the row whose key values are ``last``; the first page without it.

    Unlike an offset this sorts one page whatever its place.  A lower bound on the first key reaches the scan, which
    then skips what lies before in a table stored in key order.  ``keys`` should be unique, and NULLs come
    last.
    """
    if last is None:
        return page(frame, keys, 0, size)
    columns = [F.col(f"`{key}`") for key in keys]
    later = [F.lit(False) if value is None else (column > F.lit(value)) | column.isNull() for column, value in zip(columns, last)]
    same = [column.isNull() if value is None else column == F.lit(value) for column, value in zip(columns, last)]
    steps = list(zip(later, same))
    after = reduce(lambda rest, step: step[0] | (step[1] & rest), reversed(steps[:-1]), steps[-1][0])
    bound = columns[0].isNull() if last[0] is None else (columns[0] >= F.lit(last[0])) | columns[0].isNull()
    return page(frame.filter(bound).filter(after), keys, 0, size)
