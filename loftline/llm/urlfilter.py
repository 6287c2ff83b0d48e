"""URL filter: host rules, and a Bloom filter cascade for long lists.  DataFrame functions only.

The cascade (as in CRLite: Larisch et al., 2017) holds a list of host names exactly for the hosts of one corpus.  Its
key universe is every host of the corpus with every parent domain.  Level 1 encodes the listed keys; level 2 the keys
of the universe that level 1 takes for listed ones; level 3 the listed keys that level 2 takes for those; and so on
until no key is mistaken.  The first level that lacks a key tells: at an even level the key is listed, at an odd one it isn't.
A level is a string of bits in the expression itself, so URLs are judged without a join.  Its size follows the list.
"""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

#: (kind, host, path): fixed values of the query's contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Hosts that the query blocks where no rule fits.
LISTED = ("ads-track.example.com", "adult-x.example.com", "casino-win.example.net", "cheap-pills.example.net", "free-bets.example.net", "spam-farm.example.org")
#: Bits to a key and hash functions of level 1, and of the levels after it.
FIRST, LATER = (6, 4), (3, 2)
#: Bits to a byte of the string: it stays ASCII.
PER_BYTE = 7


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and its parent domains; none for an empty host."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), ".")))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its kind; null if none fits.  Of equally long ones the first listed wins."""
    rule, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, h, p in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):  # the last one that fits wins
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, kind = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(k)).otherwise(kind)
    return rule, kind


def _places(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(hashes)]


def _bit(place: Column) -> Column:
    return F.pow(F.lit(2), F.pmod(place, F.lit(PER_BYTE))).cast("int")


def _has(key: Column, level: int, hashes: int, bits: int, encoded: str) -> Column:
    filled = F.unbase64(F.lit(encoded))
    found = F.lit(True)
    for place in _places(key, level, hashes, bits):
        byte = F.ascii(F.substring(filled, (F.floor(place / PER_BYTE) + 1).cast("int"), F.lit(1)).cast("string"))
        found &= byte.bitwiseAND(_bit(place)) != 0
    return found


class Cascade:
    """Levels (level, hashes, bits, base64 of the bits)."""

    def __init__(self, levels: list[tuple[int, int, int, str]]):
        self.levels = levels

    @classmethod
    def build(cls, universe: DataFrame, listed: DataFrame) -> Cascade:
        """universe, listed: keys in a column `key`; listed may hold keys outside the universe.  Nulls are ignored."""
        keys = universe.select("key", F.lit(0).alias("listed")).unionByName(listed.select("key", F.lit(1).alias("listed")))
        keys = staged(keys.where("key IS NOT NULL").groupBy("key").agg(F.max("listed").alias("listed")), "keys")
        inside, outside, levels = keys.where("listed = 1"), keys.where("listed = 0"), []
        while n := inside.count():
            per, hashes = FIRST if not levels else LATER
            level, bits = len(levels), max(64, per * n)
            place = F.explode(F.array(*_places(F.col("key"), level, hashes, bits))).alias("place")
            byte = inside.select(place).groupBy(F.floor(F.col("place") / PER_BYTE).alias("at")).agg(F.bit_or(_bit(F.col("place"))).alias("byte"))
            data = bytearray(-(-bits // PER_BYTE))
            for r in byte.toLocalIterator():  # as many rows as the level has bytes: that follows the list, not the corpus
                data[r["at"]] = r["byte"]
            levels.append((level, hashes, bits, base64.b64encode(data).decode()))
            inside, outside = outside.where(_has(F.col("key"), *levels[-1])), inside
            inside = staged(inside, "mistaken")
        return cls(levels)

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe, or a listed one, is listed."""
        found = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            found = F.when(_has(key, *self.levels[k]), found).otherwise(F.lit(k % 2 == 1))
        return found


def judge(pages: DataFrame, listed: DataFrame, rules: tuple = RULES) -> DataFrame:
    """One row for each row of pages (page_id, url): page_id, host, path, rule, verdict, in_list.

    The host runs from the first :// to / ? # or the end, A-Z lower-cased; the path from there to ? or # or the end.
    A null url and one without :// have neither, fit no rule and are allowed.  The longest fitting rule decides, else
    the cascade: block if the host or a parent domain is in `listed` (key).  An empty list blocks nothing.  Repeated
    pages give repeated rows; other columns are ignored.  An empty table gives no row.
    """
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    universe = seen.select("host").distinct().select(F.explode(suffixes(F.col("host"))).alias("key")).distinct()
    cascade = Cascade.build(universe, listed)
    rule, kind = rule_of(F.col("host"), F.col("path"), rules)
    in_list = F.exists(suffixes(F.col("host")), cascade.contains)
    verdict = F.coalesce(kind, F.when(in_list, F.lit("block")).otherwise(F.lit("allow")))
    return seen.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), in_list.alias("in_list"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.sql("SELECT explode(split('" + " ".join(LISTED) + "', ' ')) AS key")
    return judge(table(spark, sf_dir, "pages"), listed)


SQL = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
     r AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                          WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                          WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                          WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule,
                  regexp_matches(host, '(^|\.)(ads-track\.example\.com|adult-x\.example\.com|casino-win\.example\.net|cheap-pills\.example\.net|free-bets\.example\.net|spam-farm\.example\.org)$') AS in_list FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR in_list THEN 'block' ELSE 'allow' END AS verdict, in_list FROM r
"""
