"""Operator 5: URL verdicts by rules, a blocked Bloom filter and an exact join."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import map_rows
from geoloom.plans.materialize import materialize

# Fixed values: (verdict, host, path) of the host rules, and the blocklist of the registered query (domains and addresses).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BLOCKLIST = ("casino-win.example.com", "cheap-pills.example.com", "adult-x.example.net", "adult-x.example.com", "http://www.free-downloads.example.org/setup/index.html")
LISTED_WORDS = ("casino", "pills", "adult")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: 64-bit words of a block (512 bits, one cache line), bits set for a key, bits for a key in the whole filter.
BLOCK_WORDS, SET_BITS, BITS_PER_KEY = 8, 6, 12


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, A-Z lower-cased; empty without a ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """One spelling of a page's address: no scheme, query or fragment, no leading www. or m., no slash or index page at the end."""
    return F.concat(F.regexp_replace(host, r"^(?:www|m)\.", ""), F.regexp_replace(path, r"(?:/index)?(?:\.html?)?/*$", ""))


def address_keys(host: Column, path: Column) -> Column:
    """What a list may hold of a page: its canonical address, and its domain and
    every parent domain of two or more labels."""
    bare = F.regexp_replace(host, r"^(?:www|m)\.", "")
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.array_distinct(F.concat(domains, F.array(canonical(host, path))))


def listed_key(entry: Column) -> Column:
    """A list's entry, a domain or an address with or without scheme, spelt as :func:`address_keys` spells it."""
    url = F.when(F.contains(entry, F.lit("://")), entry).otherwise(F.concat(F.lit("x://"), entry))
    return canonical(host_of(url), path_of(url))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null."""
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _masks(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash and its bits there, as BLOCK_WORDS 64-bit words."""
    h = hashes.view(np.uint64)
    block = (h >> np.uint64(32)) % np.uint64(blocks)
    words = np.zeros((len(h), BLOCK_WORDS), np.uint64)
    rows, x = np.arange(len(h)), h.copy()
    for _ in range(SET_BITS):
        x = x * np.uint64(6364136223846793005) + np.uint64(1442695040888963407)  # the steps of a linear congruence
        bit = (x >> np.uint64(55)).astype(np.int64)
        words[rows, bit // 64] |= np.uint64(1) << (bit % 64).astype(np.uint64)
    return block.astype(np.int64), words


def build_filter(listed: DataFrame, max_bytes: int = 32 << 20) -> np.ndarray:
    """A blocked Bloom filter of ``listed(h)``: each task ors its keys' bits by
    block, the partial blocks are merged by bit_or, and the filter is collected.
    It never exceeds ``max_bytes``: a longer list gets fewer bits a key and so
    more possible hits, which the exact join settles all the same."""
    keys = listed.count()
    size = min(max_bytes, max(keys, 1) * BITS_PER_KEY // 8)
    blocks = max(1, math.ceil(size / (8 * BLOCK_WORDS)))

    def fn(h: list) -> dict:
        block, words = _masks(np.array(h, np.int64), blocks)
        order = np.argsort(block, kind="stable")
        own, at = np.unique(block[order], return_index=True)
        merged = np.bitwise_or.reduceat(words[order], at, axis=0).view(np.int64) if len(h) else np.zeros((0, BLOCK_WORDS), np.int64)
        return {"block": own, **{f"w{i}": merged[:, i] for i in range(BLOCK_WORDS)}}

    schema = "block long, " + ", ".join(f"w{i} long" for i in range(BLOCK_WORDS))
    parts = map_rows(listed, ["h"], fn, schema).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK_WORDS)))
    made = parts.toPandas()
    table = np.zeros((blocks, BLOCK_WORDS), np.int64)
    table[made["block"].to_numpy(np.int64)] = made[[f"w{i}" for i in range(BLOCK_WORDS)]].to_numpy(np.int64)
    return table.view(np.uint64)


def possible_hits(table: np.ndarray, spark):
    """A pandas UDF that tests arrays of hashes against the broadcast filter."""
    held = spark.sparkContext.broadcast(table)

    def test(hashes: pd.Series) -> pd.Series:
        sizes = hashes.map(len).to_numpy(np.int64)
        h = np.concatenate([*hashes, np.empty(0, np.int64)]).astype(np.int64)
        block, words = _masks(h, len(held.value))
        own = held.value[block]
        ok = ((own & words) == words).all(axis=1)
        return pd.Series(np.split(ok, np.cumsum(sizes)[:-1]) if len(sizes) else [], index=hashes.index, dtype=object)

    return F.pandas_udf(test, "array<boolean>")


def listed_urls(pages: DataFrame, words: tuple[str, ...] = LISTED_WORDS) -> DataFrame:
    """(url): a list made of a crawl: the canonical addresses of the pages whose host name holds one of the words."""
    host = host_of(F.col("url"))
    return pages.filter(host.rlike("|".join(words))).select(canonical(host, path_of(F.col("url"))).alias("url")).distinct()


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES, max_bytes: int = 32 << 20, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of ``pages``: id, host, path, rule, verdict, and listed.

    The longest fitting rule decides; without one a page is blocked if its
    canonical address, its domain or a parent domain is in ``listed(url)``. The
    Bloom filter lets only possible hits through to the exact hash join with the
    list, which removes the false positives; other pages never reach the join. A
    null url or one without :// has empty host and path, fits no rule and is
    allowed. Repeated rows repeat, null ids stay; null or repeated list entries
    count once; a very long url is judged whole; an empty list or table is fine;
    other columns, whatever their names, are not read.
    """
    spark = pages.sparkSession
    keys = materialize(listed.filter("url is not null").select(listed_key(F.col("url")).alias("listed_key")).filter("listed_key <> ''").distinct(), "listed")
    table = build_filter(keys.select(F.xxhash64("listed_key").alias("h")), max_bytes)
    url = F.col(url_col)
    df = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    df = df.withColumn("rule", rule_of(F.col("host"), F.col("path")))
    probes = F.when(F.col("host") != "", address_keys(F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("keys", probes)
    df = df.withColumn("maybe", possible_hits(table, spark)(F.transform("keys", lambda k: F.xxhash64(k))))
    df = df.withColumn("keys", F.filter("keys", lambda k, i: F.get("maybe", i))).drop("maybe")
    # The possible hits, by one row a key; a row's number tells repeated rows apart within this one job.
    some = df.filter(F.size("keys") > 0).withColumn("row", F.monotonically_increasing_id())
    met = some.withColumn("key", F.explode("keys")).join(keys.withColumn("listed", F.lit(True)), F.col("key") == F.col("listed_key"), "left")
    own = [F.first(c).alias(c) for c in ("page_id", "host", "path", "rule")]
    hit = met.groupBy("row").agg(*own, F.coalesce(F.max("listed"), F.lit(False)).alias("listed")).drop("row")
    rest = df.filter(F.size("keys") == 0).drop("keys").withColumn("listed", F.lit(False))
    verdict = F.coalesce("rule.verdict", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return hit.unionByName(rest).select("page_id", "host", "path", F.col("rule.rule").alias("rule"), verdict.alias("verdict"), "listed")


_LISTED = ", ".join(f"('{k}')" for k in ("casino-win.example.com", "cheap-pills.example.com", "adult-x.example.net", "adult-x.example.com", "free-downloads.example.org/setup"))

ORACLE = rf"""
with p as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
l(entry) as (values {_LISTED}),
k as (
  select *, regexp_replace(host, '^(?:www|m)\.', '') as bare, regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(path, '(?:/index)?(?:\.html?)?/*$', '') as address,
    case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
         when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
         when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
         when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule
  from p),
j as (select *, host <> '' and exists (select 1 from l where entry = address or entry = bare or ends_with(bare, '.' || entry)) as listed from k)
select page_id, host, path, rule,
  case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null or listed then 'block' else 'allow' end as verdict, listed
from j
"""
