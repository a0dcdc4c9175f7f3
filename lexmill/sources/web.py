"""Fetching pages: a function of a frontier, so a crawl runs against the network or a table alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.schemas import REPLY
from lexmill.session import ship

#: Connections that a task keeps busy.
ACTIVE = 10


def table_fetcher(pages: DataFrame, url: str = "url", body: str = "html", ts: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """A fetcher that finds pages in a table; a page that a conditional request knows gives 304."""
    held = pages.select(F.col(url).alias("url"), F.col(body).alias("body"), (F.col(ts) if ts else F.lit(None).cast("timestamp")).alias("_ts"))

    def fetch(frontier: DataFrame) -> DataFrame:
        both = frontier.join(held, "url", "left")
        known = F.col("since").isNotNull() & (F.col("_ts").isNull() | (F.col("_ts") <= F.col("since")))
        code = F.when(F.col("body").isNull(), 404).when(known, 304).otherwise(200)
        return both.select(
            F.col("url").alias("request_url"), "url", code.alias("code"), F.when(code == 200, "text/html").alias("content_type"),
            F.when(code == 200, F.col("body")).alias("body"), F.when(code == 404, "not found").alias("error"),
        )

    return fetch


def http_fetcher(timeout: float = 30.0, headers: dict[str, str] | None = None, tasks: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """A fetcher over HTTP with a bounded number of connections in each task; redirects are followed."""

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor
        from email.utils import formatdate
        from urllib.error import HTTPError, URLError
        from urllib.request import Request, urlopen

        import pandas as pd

        def one(row):
            url, since = row
            request = Request(url, headers=dict(headers or {}))
            if not pd.isna(since):
                request.add_header("If-Modified-Since", formatdate(since.timestamp(), usegmt=True))
            try:
                with urlopen(request, timeout=timeout) as r:
                    return url, r.url, r.status, r.headers.get("Content-Type"), r.read().decode("utf-8", "replace"), None
            except HTTPError as e:
                return url, e.url or url, e.code, None, None, None if e.code == 304 else str(e)
            except (URLError, OSError, ValueError) as e:
                return url, url, None, None, None, str(e)

        with ThreadPoolExecutor(ACTIVE) as pool:
            for pdf in batches:
                yield pd.DataFrame(list(pool.map(one, zip(pdf["url"], pdf["since"], strict=True))), columns=REPLY.fieldNames())

    def fetch(frontier: DataFrame) -> DataFrame:
        ship(frontier.sparkSession)
        rows = frontier.select("url", "since")
        return (rows.repartition(tasks) if tasks else rows).mapInPandas(run, REPLY)

    return fetch
