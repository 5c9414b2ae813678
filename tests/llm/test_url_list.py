"""The listed addresses: parent domains, false positives of the filter, and a list that isn't made of the judged hosts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from geoloom.llm.url_filter import address_keys, build_filter, judge_urls, possible_hits


def test_domains_parents_and_addresses_of_a_list(spark):
    listed = spark.createDataFrame([("bad.example.info",), ("HTTPS://WWW.Mixed.example.info/a/index.html",), ("plain.example.info/only/",), (None,), ("",), ("info",)], "url string")
    pages = [
        (1, "http://bad.example.info/x", "block"), (2, "http://deep.sub.bad.example.info/", "block"), (3, "http://notbad.example.info/", "allow"), (4, "http://mixed.example.info/a?x=1", "block"),
        (5, "http://mixed.example.info/b", "allow"), (6, "http://plain.example.info/only.html#x", "block"), (7, "http://plain.example.info/", "allow"), (8, "http://other.info/", "allow"),
        (9, None, "allow"), (10, "http://info/", "block"), (1, "http://bad.example.info/x", "block"), (None, "http://www.bad.example.info", "block"), (11, "http://" + "a." * 3_000 + "bad.example.info/", "block"),
    ]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u, _ in pages], "page_id long, url string, keys string, listed string")
    got = sorted((str(r["page_id"]), r["verdict"]) for r in judge_urls(df, listed, rules=()).collect())
    assert got == sorted((str(i), v) for i, _, v in pages)


def test_false_positives_of_the_filter_are_removed_by_the_join(spark):
    listed = spark.createDataFrame([(f"site{i}.example.info",) for i in range(3_000)], "url string")
    pages = spark.createDataFrame([(i, f"http://page{i}.example.info/p") for i in range(4_000)] + [(9_000 + i, f"http://site{i}.example.info/p") for i in range(0, 3_000, 100)], "page_id long, url string")
    small = 512  # bytes: far too few for the list
    filled = build_filter(listed.select(F.xxhash64("url").alias("h")), small)
    host = F.regexp_extract("url", "://([^/]*)", 1)
    maybe = pages.filter("page_id < 9000").select(F.exists(possible_hits(filled, spark)(F.transform(address_keys(host, F.lit("/p")), lambda k: F.xxhash64(k))), lambda x: x).alias("m"))
    assert maybe.filter("m").count() > 100
    blocked = {r["page_id"] for r in judge_urls(pages, listed, rules=(), max_bytes=small).filter("verdict = 'block'").collect()}
    assert blocked == {9_000 + i for i in range(0, 3_000, 100)}
    assert np.count_nonzero(filled) > 0
