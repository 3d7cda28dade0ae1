"""Host and path rules judged with cascades of Bloom filters.

A rule such as ``net/es/`` fits its host and all subdomains where the path starts with the
rule's path, so a url can only meet the rules among its own (host suffix, path prefix) keys.
The keys of all urls are the complete key universe. Level 1 of a cascade encodes the listed
keys; level 2 encodes the keys of the universe that level 1 takes for listed; level 3 the
listed keys that level 2 takes for those; and so on until a level errs on nothing. The first
level that denies a key then tells whether it is listed, without error for every key of the
universe, so urls are judged without a join.

Level 1 errs on about one key per listed key, whatever the size of the universe, so the
cascade has some bits per listed key times the logarithm of (universe / list). It reaches the
urls as an array inside the expression (a scalar subquery), never as a joined table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most words of 64 bits in one level (16 MB); a longer list needs several cascades.
MAX_WORDS = 2_000_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, lengths: list[tuple[int, int]]) -> list[Column]:
    """Keys of a url whose (host, path) lengths occur among the rules, the longest first; null where it has none."""
    def key(h: int, p: int) -> Column:
        whole = F.length(host) == h
        below = F.substring(host, F.length(host) - F.lit(h), F.lit(1)) == "."
        fits = (F.length(path) >= p) & (whole | (F.length(host) > h) & below)
        return F.when(fits, F.concat(F.right(host, F.lit(h)), F.substring(path, 1, p)))

    return [key(h, p) for h, p in sorted(lengths, key=lambda x: (-x[0] - x[1], -x[0]))]


@dataclass
class Level:
    words: int
    hashes: int
    salt: int
    bits: DataFrame

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.salt), F.lit(i)), F.lit(self.words * 64)) for i in range(self.hashes)]

    def admits(self, key: Column) -> Column:
        """Whether every bit of the key is set."""
        found = F.lit(True)
        for at in self.places(key):
            word = F.get(self.bits.scalar(), F.shiftright(at, 6).cast("int"))
            bit = F.call_function("shiftright", word, (at % 64).cast("int"))
            found = found & (bit.bitwiseAND(F.lit(1)) == 1)
        return found


def _level(keys: DataFrame, count: int, error: float, salt: int) -> Level:
    """Encodes the column ``key``: about ``error`` of all other keys are admitted as well."""
    error = min(0.5, max(error, 1e-12))
    words = max(1, math.ceil(max(1, count) * -math.log(error) / math.log(2) ** 2 / 64))
    if words > MAX_WORDS:
        raise ValueError(f"{count} keys need {words} words of filter, more than {MAX_WORDS}")
    level = Level(words, max(1, round(-math.log2(error))), salt, keys)
    at = F.explode(F.array(*level.places(F.col("key"))))
    set_words = (keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("word"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")))
    # one row of at most MAX_WORDS numbers; words without a bit are zero
    entries = set_words.agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    level.bits = cut_lineage(entries.select(
        F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0)))
        .alias("bits")))
    return level


class Cascade:
    """Exact membership in a list, for the keys of a universe."""

    def __init__(self, listed: DataFrame, universe: DataFrame, max_levels: int = 64):
        """``listed`` and ``universe`` have a column ``key``; the universe need not be distinct."""
        mine = cut_lineage(listed.select("key").where(F.col("key").isNotNull()).distinct())
        count = mine.count()
        self.levels: list[Level] = []
        if not count:
            return
        size = universe.select(F.approx_count_distinct("key")).first()[0]
        level = _level(mine, count, count / (math.sqrt(2) * max(size, 1)), 1)
        self.levels.append(level)
        wrong = cut_lineage(universe.select("key").where(level.admits(F.col("key"))).distinct()
                            .join(mine, "key", "left_anti"))
        inside, outside = wrong, mine  # encoded next; must not be admitted by it
        while (count := inside.count()) and len(self.levels) < max_levels:
            level = _level(inside, count, 0.5, len(self.levels) + 1)
            self.levels.append(level)
            inside, outside = cut_lineage(outside.where(level.admits(F.col("key")))), inside
        if count:
            raise RuntimeError("the cascade did not end")

    def contains(self, key: Column) -> Column:
        """The first level that denies a key decides: an odd one says it is not listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            out = F.when(~level.admits(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to every row; existing columns of these names go.

    ``rules`` has host, path and verdict (``allow`` or ``block``; where the same host and
    path have both, ``block`` holds). The longest fitting rule decides, of equally long ones
    that with the longer host; a url without a fitting rule is in no list and allowed. Null
    urls and urls without ``://`` have an empty host and path and are allowed. No rules: all
    are allowed. The work is a pass over the urls for the size of the universe, one for the
    wrongly admitted keys, and the verdict itself, each without a shuffle of urls.
    """
    rules = cut_lineage(rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict").distinct())
    sizes = rules.select(F.length("h"), F.length("p")).distinct().collect()  # pairs of lengths, not rules
    lengths = [(h, p) for h, p in sizes if h]
    keyed = pages.drop("host", "path", "rule", "verdict")
    keyed = keyed.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not lengths:
        return keyed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    mine = keys_of(F.col("host"), F.col("path"), lengths)
    universe = keyed.select(F.explode(F.array_compact(F.array(*mine))).alias("key"))
    key = F.concat("h", "p").alias("key")
    block = rules.where("verdict = 'block'").select(key).distinct()
    allow = rules.where("verdict = 'allow'").select(key).distinct().join(block, "key", "left_anti")
    blocked, allowed = Cascade(block, universe), Cascade(allow, universe)
    verdict = [F.when(blocked.contains(k), F.struct(k.alias("key"), F.lit("block").alias("verdict")))
               .when(allowed.contains(k), F.struct(k.alias("key"), F.lit("allow").alias("verdict"))) for k in mine]
    hit = free_name(keyed, "_hit")
    return keyed.withColumn(hit, F.coalesce(*verdict)).withColumns({
        "rule": F.col(f"{hit}.key"), "verdict": F.coalesce(f"{hit}.verdict", F.lit("allow"))}).drop(hit)
