"""Crawl steps over a frontier, a page cache and replies, as joins and filters.

Fetching is a source of its own (`sources.web`); here is what surrounds it: which links of a reply to
follow, which of them to download, revalidate or skip, and what to store and to pass on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import urls
from lexmill.functions.html import link_set
from lexmill.functions.text import exploded

OK, NOT_MODIFIED = 200, 304
#: What becomes of a link.
DOWNLOAD, REVALIDATE, SKIP = "download", "revalidate", "skip"
#: What a processed page is.
NEW, CACHED = "new", "cache"

Filter = Callable[[Column, Column, Column], Column]
#: The links that a parser finds in a body, as an array.
Parser = Callable[[Column], Column]


def domain_filter(base_url_host: str) -> Filter:
    return lambda page, link, resolved: urls.in_domain(base_url_host, resolved)


def port_filter(ports: Sequence[int]) -> Filter:
    """By default of the link as the page has it, so only absolute links can fail."""
    return lambda page, link, resolved: urls.allowed_port(link, ports)


def words_filter(words: Sequence[str]) -> Filter:
    return lambda page, link, resolved: urls.without_words(link, words)


def usable(replies: DataFrame) -> DataFrame:
    """Replies without an error; failed ones are neither stored nor tried again."""
    return replies.where("error IS NULL")


def with_cached_bodies(replies: DataFrame, cache: DataFrame) -> DataFrame:
    """Replies in which a not-modified one has the body of the cache."""
    held = cache.select(F.col("key").alias("_key"), F.col("data").alias("_data"))
    both = replies.join(held, replies["request_url"] == held["_key"], "left")
    body = F.when(F.col("code") == NOT_MODIFIED, F.col("_data")).otherwise(F.col("body"))
    return both.select(*[body.alias("body") if c == "body" else F.col(c) for c in replies.columns])


def stored(replies: DataFrame) -> DataFrame:
    """(key, data): each reply under its final URL, and also under the requested one where that differs."""
    return replies.select(F.explode(F.array_distinct(F.array("url", "request_url"))).alias("key"), F.col("body").alias("data"))


def routed(replies: DataFrame, accepts: Sequence[Column]) -> DataFrame:
    """replies with the route of each: processed, only its links followed (not modified), or fallback (rejected)."""
    accepted = reduce(lambda a, b: a & b, accepts, F.lit(True))
    return replies.withColumn("route", F.when(~accepted, "fallback").when(F.col("code") == NOT_MODIFIED, "links only").otherwise("process"))


def outgoing(replies: DataFrame, filters: Sequence[Filter] = (), schemes: Sequence[str] = ("http", "https"), parsers: Sequence[Parser] = ()) -> DataFrame:
    """(page, url): the distinct links to follow, resolved; not those to other schemes, no host, or the page itself.

    Links are what the parsers find in a body; without any, the hrefs of anchors.
    """
    found = [p(F.col("body")) for p in parsers] or [link_set(F.col("body"))]
    links = exploded(replies, [F.col("url").alias("page")], F.array_distinct(F.concat(*found)), "link")
    links = links.withColumn("url", urls.resolve(F.col("page"), F.col("link"))).where(F.col("url").isNotNull() & urls.allowed_scheme(F.col("url"), schemes) & (urls.host(F.col("url")) != "") & (F.col("url") != F.col("page")))
    for f in filters:
        links = links.where(f(F.col("page"), F.col("link"), F.col("url")))
    return links.select("page", "url").distinct()


def frontier(links: DataFrame, visited: DataFrame) -> DataFrame:
    """(url): each link once, but for those visited or under way."""
    return links.select("url").distinct().join(visited.select("url"), "url", "left_anti")


def plan(frontier_urls: DataFrame, cache: DataFrame, generation: Column) -> DataFrame:
    """(url, action, since): download what the cache lacks, revalidate what is older than this generation, skip the rest."""
    held = cache.select(F.col("key").alias("url"), F.col("ts").alias("_ts"))
    action = F.when(F.col("_ts").isNull(), DOWNLOAD).when(F.col("_ts") < generation, REVALIDATE).otherwise(SKIP)
    return frontier_urls.join(held, "url", "left").select("url", action.alias("action"), F.when(action == REVALIDATE, F.col("_ts")).alias("since"))


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], cache: DataFrame, generation: Column, keep: Callable[[DataFrame], DataFrame], filters: Sequence[Filter] = (), depth: int = 3, parsers: Sequence[Parser] = ()) -> DataFrame:
    """(url, level): breadth first from the seeds; `keep` writes a table and gives it back, cutting the lineage at each level."""
    visited = keep(seeds.select("url", F.lit(0).alias("level")))
    todo = plan(seeds, cache, generation)
    for level in range(1, depth + 1):
        replies = keep(with_cached_bodies(usable(fetch(todo.where(F.col("action") != SKIP))), cache))
        found = frontier(outgoing(replies, filters, parsers=parsers), visited)
        fresh = keep(found.withColumn("level", F.lit(level)))
        if fresh.isEmpty():
            break
        visited = visited.unionByName(fresh)  # each level is written once
        todo = plan(fresh.select("url"), cache, generation)
    return visited
