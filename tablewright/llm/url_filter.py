"""URL rules looked up in Bloom filter cascades.

A url's host and path make one key per shape of rule: the last k labels of the host and the first n
characters of the path, for each (k, n) that some rule has.  Rules of one verdict are the listed keys
of a cascade; the universe is every different key of the whole corpus.  Level 1 is a Bloom filter of
the listed keys, level 2 of the universe's other keys that pass level 1, level 3 of the listed keys that
pass level 2, and so on until a level passes nothing it should not.  A key is listed if it passes an
odd number of levels in a row, exactly, for every key of the universe; no list is joined to look it up.

A level is an array of 64-bit words made by aggregates, read into expressions as a scalar subquery of one
row.  Level 1 lets about as many other keys through as there are listed ones, so all levels are of the
order of the list times the logarithm of the universe; ``MAX_LISTED`` bounds the list and is checked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import UPPER, stored

MAX_LISTED = 1_000_000
LATER_HASHES = 3
UPPER_TO_LOWER = (UPPER, UPPER.lower())


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up
    to ``?``, ``#`` or the end.  Both empty for NULL and for urls without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), *UPPER_TO_LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


class Cascade:
    """The levels of one list; ``holds`` tells whether a key of the universe is listed."""

    def __init__(self, listed: DataFrame, universe: DataFrame, name: str) -> None:
        """``listed`` and ``universe`` have one column ``key`` of different values."""
        self.levels: list[tuple[DataFrame, int, int]] = []
        n_listed = listed.count()
        inside, count = listed, n_listed
        outside = universe.join(F.broadcast(listed), "key", "left_anti")
        hashes = math.ceil(math.log2(max(4, universe.count() / max(1, n_listed))))
        while count:
            self._add(inside, count, hashes, name)
            passing = outside.filter(self._passes(_hashes(F.col("key")), len(self.levels) - 1))
            inside, outside = stored(passing, f"{name}-level-{len(self.levels)}"), inside
            count, hashes = inside.count(), LATER_HASHES

    def _add(self, keys: DataFrame, count: int, hashes: int, name: str) -> None:
        words = -(-math.ceil(count * hashes * 1.45) // 64)
        level = len(self.levels)
        bits = F.array(*_bits(_hashes(F.col("key")), level, hashes, 64 * words))
        at = keys.select(F.explode(bits).alias("bit"))
        set_bits = F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))")
        filled = at.groupBy(F.floor(F.col("bit") / 64).alias("id")).agg(set_bits.alias("value"))
        value = F.coalesce("value", F.lit(0).cast("bigint")).alias("value")
        pairs = keys.sparkSession.range(words).join(filled, "id", "left").select(F.struct("id", value).alias("pair"))
        whole = pairs.agg(F.sort_array(F.collect_list("pair")).alias("pairs")).select(F.col("pairs.value").alias("bits"))
        self.levels.append((stored(whole, f"{name}-bits-{level}"), hashes, 64 * words))

    def _passes(self, hashed: tuple[Column, Column], level: int) -> Column:
        frame, hashes, size = self.levels[level]
        held = frame.select("bits").scalar()
        passed = F.lit(True)
        for bit in _bits(hashed, level, hashes, size):
            word = F.get(held, F.floor(bit / 64).cast("int"))
            passed = passed & (F.call_function("getbit", word, (bit % 64).cast("int")) == 1)
        return passed

    def holds(self, hashed: tuple[Column, Column]) -> Column:
        """Whether the key with these hashes passes level 1 and the levels after it do not object."""
        answer = F.lit(False)
        for level in reversed(range(len(self.levels))):
            answer = self._passes(hashed, level) & ~answer
        return answer


class Cascades:
    """A list of any length: keys are dealt by hash to cascades of about ``MAX_LISTED`` listed keys at most."""

    def __init__(self, listed: DataFrame, universe: DataFrame, name: str) -> None:
        self.count = max(1, math.ceil(listed.count() / MAX_LISTED))
        mine = lambda frame, i: frame.filter(self._part(_hashes(F.col("key"))) == i)
        self.parts = [Cascade(mine(listed, i), mine(universe, i), f"{name}-{i}") for i in range(self.count)]

    def _part(self, hashed: tuple[Column, Column]) -> Column:
        return F.pmod(F.xxhash64(F.lit(2), hashed[0]), F.lit(self.count))

    def holds(self, hashed: tuple[Column, Column]) -> Column:
        answer = self.parts[0].holds(hashed)
        for i, part in enumerate(self.parts[1:], start=1):
            answer = F.when(self._part(hashed) == i, part.holds(hashed)).otherwise(answer)
        return answer


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


def _bits(hashed: tuple[Column, Column], level: int, hashes: int, size: int) -> list[Column]:
    """Bit numbers by double hashing, other ones in each level."""
    first, second = (F.xxhash64(F.lit(level), part) if level else part for part in hashed)
    start, step = F.pmod(first, F.lit(size)), F.pmod(second, F.lit(size - 1)) + 1
    return [(start + step * number) % size for number in range(hashes)]


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    ``rules(host, path, verdict)`` holds verdicts ``block`` and ``allow``.  A rule fits its host and all
    subdomains of it if the page's path starts with the rule's; the longest rule (host and path
    together, then the host) wins, ``block`` if the same rule is listed twice.  ``rule`` is its host and
    path, NULL if none fits, and then the page is on no list and allowed.  NULL urls and urls
    without ``://`` have an empty host and path and fit no rule.  Repeated rows are judged alike.
    Other columns of ``pages`` are ignored whatever their names.  An empty table gives an empty result.
    """
    listed = rules.select(
        F.translate("host", *UPPER_TO_LOWER).alias("host"), "path", "verdict"
    ).withColumn("key", F.concat("host", "path")).dropna()
    shape = listed.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("n")).distinct()
    shapes = sorted((row.labels, row.n) for row in shape.collect())
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1

    def suffix(k: int) -> Column:
        return F.substring_index("host", ".", -k)

    def key(k: int, n: int) -> Column:
        fits = (F.length("host") > 0) & (labels >= k) & (F.length("path") >= n)
        return F.when(fits, F.concat(suffix(k), F.substring("path", 1, n)))

    keys = {f"_key{i}": key(k, n) for i, (k, n) in enumerate(shapes)}
    keyed = split.withColumns(keys)
    found = [F.col(name) for name in keys] or [F.lit(None).cast("string")]
    universe = keyed.select(F.explode(F.array_distinct(F.array(*found))).alias("key")).filter("key IS NOT NULL").distinct()
    universe = stored(universe, "url-keys")
    cascades = {
        verdict: Cascades(listed.filter(F.col("verdict") == verdict).select("key").distinct(), universe, f"urls-{verdict}")
        for verdict in ("block", "allow")
    }
    hits = []
    for i, (k, _) in enumerate(shapes):
        hashed = _hashes(F.col(f"_key{i}"))
        verdict = F.when(cascades["block"].holds(hashed), "block").when(cascades["allow"].holds(hashed), "allow")
        known = F.col(f"_key{i}").isNotNull() & verdict.isNotNull()
        rank = [F.length(f"_key{i}").alias("length"), F.length(suffix(k)).alias("host_length")]
        hits.append(F.when(known, F.struct(*rank, F.col(f"_key{i}").alias("rule"), verdict.alias("verdict"))))
    none = F.lit(None).cast("struct<length:int,host_length:int,rule:string,verdict:string>")
    best = keyed.withColumn("_best", F.array_max(F.array(*(hits or [none]))))
    return best.select(
        "page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit("allow")).alias("verdict")
    )
