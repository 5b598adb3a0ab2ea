"""Operator 5: URL filter by a Bloom filter cascade.  DataFrame functions only.

The listed hosts are held exactly, without a join, for a known universe: all
hosts of the corpus.  Level 0 is a Bloom filter of the listed hosts; level 1
encodes the unlisted hosts that pass level 0, level 2 the listed ones that pass
level 1, and so on until no host of the universe passes wrongly.  A host is
looked up level by level: the first filter that does not hold it tells its
side; if all hold it, the last one's side is right.

A filter is an array of longs, built by ``bit_or`` over the keys' bit numbers
and read as a scalar subquery, so looking up is a projection of the scan.  Only
distinct hosts are shuffled.  Filters take about 10 bits per listed host and
are refused beyond ``max_filter_bytes``.

Rules come before the list: a rule ``host/path`` fits its host and all
subdomains if the url's path starts with its path; the longest rule wins.

Rows: a null url, or one without ``://``, has an empty host and path, fits no
rule and is never listed; repeated rows each give a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.llm.common import write_table
from transitlake.sources.tables import read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# fixed values: the rules of the production query
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/")]
# fixed values: words of a host name that put it on the production list
LISTED_WORDS = ["ads", "adult", "bets", "casino", "pills", "spam"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    part = lambda i: F.regexp_extract(F.coalesce(rest, F.lit("")), "^([^/?#]*)([^?#]*)", i)
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(action)).otherwise(verdict)
    return name, verdict


class BloomLevel:
    """One filter: ``n_hashes`` bits per key of ``keys`` (column key)."""

    def __init__(self, keys: DataFrame, level: int, n_hashes: int, max_filter_bytes: int):
        n = keys.count()
        self.level, self.n_hashes = level, n_hashes
        n_words = max(1, math.ceil(n * n_hashes / math.log(2) / 64))
        if 8 * n_words > max_filter_bytes:
            raise ValueError(f"filter of {8 * n_words} bytes for {n} keys; the bound is {max_filter_bytes}")
        self.n_bits = 64 * n_words
        places = keys.select(F.explode(F.array(*self._places(F.col("key")))).alias("p"))
        words = places.select(F.shiftright("p", 6).alias("word"), F.call_function(
            "shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int")).alias("bits"))
        empty = keys.sparkSession.range(n_words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
        full = words.union(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        self.words = write_table(full.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))),
                                                      lambda x: x["bits"]).alias("words")), f"bloom-{level}")

    def _places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.level), F.lit(i)), F.lit(self.n_bits)) for i in range(self.n_hashes)]

    def holds(self, key: Column) -> Column:
        out = F.lit(True)
        for p in self._places(key):
            word = F.get(self.words.scalar(), F.shiftright(p, 6).cast("int"))
            out &= F.call_function("shiftright", word, p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
        return out


def build_cascade(universe: DataFrame, first_hashes: int = 6, next_hashes: int = 2,
                  max_filter_bytes: int = 256 << 20) -> list[BloomLevel]:
    """``universe``: distinct key, listed (boolean)."""
    universe = write_table(universe, "url-universe")
    inside, outside = universe.where("listed").select("key"), universe.where("not listed").select("key")
    levels: list[BloomLevel] = []
    while not inside.isEmpty():
        levels.append(BloomLevel(inside, len(levels), first_hashes if not levels else next_hashes, max_filter_bytes))
        wrong = write_table(outside.where(levels[-1].holds(F.col("key"))), "bloom-wrong")
        inside, outside = wrong, inside
    return levels


def member(key: Column, levels: list[BloomLevel]) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(len(levels) % 2 == 1)  # held by all: on the last level's side
    for i in reversed(range(len(levels))):
        out = F.when(levels[i].holds(key), out).otherwise(F.lit(i % 2 == 1))
    return out


def judge(df: DataFrame, listed: DataFrame, url_col: str = "url", rules: list[tuple[str, str]] | None = None,
          **options) -> DataFrame:
    """``df`` with __host, __path, __rule, __verdict, __listed.  ``listed``:
    a column host, lower-case."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = df.withColumn("__host", host).withColumn("__path", path)
    keys = rows.select(F.col("__host").alias("key"), F.lit(False).alias("listed"))
    entries = listed.select(F.col("host").alias("key"), F.lit(True).alias("listed"))
    universe = keys.union(entries).where("key <> ''").groupBy("key").agg(F.max("listed").alias("listed"))
    levels = build_cascade(universe, **options)
    rule, verdict = rule_of(F.col("__host"), F.col("__path"), RULES if rules is None else rules)
    rows = rows.withColumn("__listed", (F.col("__host") != "") & member(F.col("__host"), levels))
    return rows.withColumn("__rule", rule).withColumn(
        "__verdict", F.coalesce(verdict, F.when(F.col("__listed"), F.lit("block")).otherwise(F.lit("allow"))))


def listed_hosts(pages: DataFrame, words: list[str]) -> DataFrame:
    """The corpus's hosts with a label that has one of ``words`` as a part."""
    host, _ = host_and_path(F.col("url"))
    pattern = f"(^|[.-])({'|'.join(words)})([.-]|$)"
    return pages.select(host.alias("host")).where(F.col("host").rlike(pattern)).distinct()


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    rows = judge(pages, listed_hosts(pages, LISTED_WORDS))
    return rows.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"),
                       F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"))


def _fits(rule: str) -> str:
    domain, slash, rest = rule.partition("/")
    return f"((host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash}{rest}'))"


_LONGEST_FIRST = sorted(RULES, key=lambda r: -len(r[1]))
QUERIES = {"op5_url_filter": op5_url_filter}
ORACLE = {"op5_url_filter": f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 2) AS path FROM r),
j AS (SELECT *, CASE {" ".join(f"WHEN {_fits(r)} THEN '{r}'" for _, r in _LONGEST_FIRST)} END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE {" ".join(f"WHEN rule = '{r}' THEN '{a}'" for a, r in _LONGEST_FIRST)}
            WHEN regexp_matches(host, '(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM j"""}
