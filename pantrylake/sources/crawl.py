"""Crawling by levels: each level's pages are fetched in parallel, their links are the next level's addresses."""

from __future__ import annotations

import urllib.robotparser
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pantrylake.functions.html import page_parts
from pantrylake.sources.readers import follow

Fetch = Callable[[str], str | None]


@dataclass(frozen=True)
class Limits:
    depth: int = 2
    pages: int = 200  #: of the whole crawl; a limit is the feature here
    items: int = 100
    per_host: int = 1  #: tasks that fetch from one host at once
    delay: float = 1.0  #: seconds between two pages of a host
    agent: str = "pantrylake"


def fetched(urls: DataFrame, fetch: Fetch, limits: Limits, sleep: Callable[[float], None] | None = None) -> DataFrame:
    """url and html of addresses; a host's pages are fetched by one task, one after the other, as its robots.txt allows.

    What can't be fetched has null html; one failure doesn't end the crawl.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        wait, rules = sleep or time.sleep, {}
        for pdf in it:
            out = []
            for url in pdf["url"]:
                host = urlsplit(url)
                root = f"{host.scheme}://{host.netloc}"
                if root not in rules:
                    rules[root] = urllib.robotparser.RobotFileParser()
                    try:
                        rules[root].parse((fetch(f"{root}/robots.txt") or "").splitlines())
                    except Exception:  # noqa: BLE001 - no rules means all is allowed
                        rules[root].parse([])
                elif limits.delay:
                    wait(limits.delay)
                try:
                    out.append(fetch(url) if rules[root].can_fetch(limits.agent, url) else None)
                except Exception:  # noqa: BLE001 - a page that fails is left out
                    out.append(None)
            yield pd.DataFrame({"url": pdf["url"], "html": out})

    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    return urls.repartition(max(1, urls.sparkSession.sparkContext.defaultParallelism), host).mapInPandas(run, "url string, html string")


@F.pandas_udf(T.StringType())
def _joined(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([urljoin(a, b).split("#")[0] for a, b in zip(base, link, strict=True)])


def links_of(pages: DataFrame) -> DataFrame:
    """Addresses of the same host that pages link to and that may be followed."""
    found = pages.select("url", page_parts(F.col("html")).alias("p")).select("url", F.explode("p.links").alias("link")).filter(follow(F.col("link")))
    host = lambda c: F.regexp_extract(c, r"^[a-z]+://([^/]+)", 1)
    return found.select("url", _joined("url", "link").alias("to")).filter(host("to") == host("url")).select(F.col("to").alias("url")).distinct()


def crawl(spark: SparkSession, starts: list[str], fetch: Fetch, path: str, limits: Limits = Limits(), sleep: Callable[[float], None] | None = None) -> DataFrame:
    """Pages (url, html, depth) from the starts, level by level, written to path after each level.

    A crawl run again goes on from what is written: pages that are there are not fetched twice.
    """
    schema = "url string, html string, depth int"
    try:
        seen = spark.read.schema(schema).parquet(path)
        seen.isEmpty()
    except Exception:  # noqa: BLE001 - nothing written yet
        seen = spark.createDataFrame([], schema)
    level = spark.createDataFrame([(u,) for u in starts], "url string").distinct()
    for depth in range(limits.depth + 1):
        room = limits.pages - seen.count()
        todo = level.join(seen.select("url"), "url", "left_anti").orderBy("url").limit(max(0, room))
        fetched(todo, fetch, limits, sleep).withColumn("depth", F.lit(depth)).write.mode("append").parquet(path)
        seen = spark.read.schema(schema).parquet(path)
        here = seen.join(level, "url", "left_semi").filter("html IS NOT NULL")
        level = links_of(here)
        if level.isEmpty():
            break
    return seen


def recipes(pages: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """JSON-LD records of crawled pages, at most `items` of them by address."""
    found = pages.select("url", page_parts(F.col("html")).alias("p")).select("url", F.explode("p.recipes").alias("recipe"))
    return found.select("url", "recipe.*").orderBy("url", "name").limit(limits.items)
