"""The search engine as one object: upload, read, search, list, crawl, top words."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import schemas
from lexmill.functions.html import plain_text
from lexmill.functions.urls import accepts_text, host
from lexmill.operators import crawl, index, search, tfidf

Processor = Callable[[DataFrame], None]


class SearchEngine:
    """Documents and their index under a folder, and the rules by which pages come in.

    Content filters are boolean columns over (content_type, body) of replies; URL filters take the
    page, the link as written and the link resolved; processors get the accepted replies of a crawl
    level, fallback processors the rejected ones; parsers find the links of a body. A processor that fails gets its
    pages again, `retries` times; `total` counts the pages that were processed.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = index.BUCKETS, retries: int = 1):
        self.spark, self.store = spark, index.IndexStore(spark, path, buckets)
        self.filters: list[Column] = []
        self.url_filters: list[crawl.Filter] = []
        self.processors: list[Processor] = []
        self.fallbacks: list[Processor] = []
        self.parsers: list[crawl.Parser] = []
        self.retries, self.total = retries, 0

    def add_parser(self, parse: crawl.Parser) -> None:
        self.parsers.append(parse)

    def add_filter(self, accepts: Column) -> None:
        self.filters.append(accepts)

    def add_url_filter(self, accepts: crawl.Filter) -> None:
        self.url_filters.append(accepts)

    def add_processor(self, process: Processor) -> None:
        self.processors.append(process)

    def add_fallback_processor(self, process: Processor) -> None:
        self.fallbacks.append(process)

    def upload(self, docs: DataFrame, collection: str, key: str = "key", data: str = "data", ts: Column | None = None) -> None:
        self.store.upload(docs, collection, key, data, ts)

    def get(self, name: str, since=None) -> tuple[int, str | None, object]:
        """(status, body, time) of a document: 404 if there is none, 304 if it is no newer than `since` (to the second)."""
        row = self.store.find_key(name).first()
        if row is None:
            return 404, None, None
        if since is not None and row["ts"].replace(microsecond=0) <= since:
            return 304, None, row["ts"]
        return 200, row["data"], row["ts"]

    def find(self, text: str) -> DataFrame:
        """(key, matches) of the documents that match; of the index only the buckets of the query's words are read."""
        query = search.parse(text)
        return search.search(self.store.postings(query.all_words), query)

    def find_documents(self, text: str, ns: str = "") -> DataFrame:
        return index.bulk_read(self.store.documents(ns), self.find(text).select("key"))

    def find_ids(self, text: str, bits: int = 512) -> Iterator[str]:
        """The reply that lists the ids of all hits, in pieces."""
        return search.ids_json(self.find(text), bits=bits)

    def iterate(self, collection: str, ns: str = "") -> DataFrame:
        return self.store.contents(collection, ns)

    def in_cache(self, url: str) -> bool:
        return not self.store.find_key(url).isEmpty()

    def top_words(self, num: int, ns: str = "") -> DataFrame:
        tf = tfidf.term_freq(self.store.documents(ns), "key", "data")
        return tfidf.top_words(tf, tfidf.doc_freq(tf), "key", num)

    def index_pages(self, replies: DataFrame) -> None:
        """Index accepted pages by the words of their text, in the collection of their host, with a copy of the text.

        Rejected pages are members of the collection, without words.
        """
        accepted = self._accepted(replies)
        rows = replies.select("url", F.when(accepted, plain_text(F.col("body"))).otherwise("").alias("data"))
        self.store.upload(rows, F.concat(host(F.col("url")), F.lit(".collection")), "url", "data", text_copy=True, size=index.sizes(replies, "url", "body"))

    def _accepted(self, replies: DataFrame) -> Column:
        out = F.coalesce(accepts_text(F.col("content_type"), F.col("body")), F.lit(False))
        for f in self.filters:
            out = out & f
        return out

    def _process(self, process: Processor, rows: DataFrame) -> None:
        """Hand rows to a processor, again if it fails; what it writes is safe to repeat, as the last write of a key counts."""
        for left in range(self.retries, -1, -1):
            try:
                return process(rows)
            except Exception:
                if not left:
                    raise

    def crawl(self, seeds: Sequence[str], fetch: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame], depth: int = 3) -> DataFrame:
        """Crawl breadth first: store each reply, hand it to the processors, follow its links. (url, level) of all seen."""
        generation = F.lit(self.spark.sql("SELECT current_timestamp()").first()[0])

        def fetched(frontier: DataFrame) -> DataFrame:
            replies = keep(fetch(frontier))
            good = crawl.usable(replies)
            pages = crawl.stored(crawl.with_cached_bodies(good, self.store.documents()))
            self.store.write_documents(schemas.documents(pages, F.col("key"), F.col("data")))
            accepted = self._accepted(good)
            for p in self.processors:
                self._process(p, good.where(accepted & (F.col("code") != crawl.NOT_MODIFIED)))
            for p in self.fallbacks:
                self._process(p, good.where(~accepted))
            self.total += good.count()
            return replies

        seed = self.spark.createDataFrame([(s,) for s in seeds], "url string")
        return crawl.crawl(seed, fetched, self.store.documents(), generation, keep, self.url_filters, depth, self.parsers)
