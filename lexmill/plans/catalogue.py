"""All queries over the library's own operators, each with the SQL that states the same result.

Every query reads whole tables. Where a query needs inputs that the tables don't have (a cache, replies,
versions of documents), it derives them from whole tables by arithmetic on ids, alike in the SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import schemas
from lexmill.functions import charset, html, normalize, text, urls
from lexmill.operators import crawl, index, model, ordered, score, search, similarity, tfidf
from lexmill.session import scratch, ship, spread
from lexmill.sources import readers
from lexmill.streaming import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def postings_of(spark: SparkSession, sf_dir: str, asked: str | None = None) -> DataFrame:
    """All postings, or those of a query's words."""
    return index.build_postings(docs_of(spark, sf_dir), "doc_id", "text", words=None if asked is None else search.parse(asked).all_words)


# --- pieces of SQL --------------------------------------------------------------------------------

# The SQL states results by patterns of its own, none of which is the library's.
R = "[\\pL\\pM\\pN_]+(?:[.''’][\\pL\\pM\\pN_]+)*"
TOK = f"""toks AS (SELECT doc_id, regexp_extract_all(lower(text), '{R}') AS a FROM documents),
tok AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, a[i] AS token FROM toks, unnest(generate_series(1, len(a))) AS u(i))"""
TF = f"{TOK}, tf AS (SELECT doc_id, token, count(*) AS cnt FROM tok GROUP BY doc_id, token)"
GRAMS = """grams AS (SELECT doc_id, list_sort(list_distinct([substr(text, CAST(i AS INTEGER), 4) FOR i IN generate_series(1, length(text) - 3)])) AS g FROM documents)"""


def _sql(x: str) -> str:
    return x.replace("'", "''")


def _nodes(source: str = "pages", key: str = "page_id", body: str = "html") -> str:
    """Text nodes: what stands behind the first > of each piece between two <, of a page without what scripts, styles and comments hold."""
    bare = body
    for begin, end in (("<!--", "-->"), ("<script", "</script>"), ("<style", "</style>")):
        bare = f"regexp_replace({bare}, '{begin}(?s:.*?){end}', ' ', 'g')"
    tags = f"regexp_replace({bare}, '<([/!a-zA-Z])', chr(2) || '\\1', 'g')"
    piece = "CASE WHEN i = 1 THEN x ELSE substr(x, instr(x, '>') + 1) END"
    plain = piece
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        plain = f"replace({plain}, '{name}', '{char}')"
    return f"nodes AS (SELECT {key}, list_filter(list_transform(string_split({tags}, chr(2)), lambda x, i: trim(regexp_replace({plain}, '[ \\t\\r\\n\\f\\v]+', ' ', 'g'))), lambda t: t <> '') AS n FROM {source})"


HREFS = """hrefs AS (SELECT page_id, url, list_transform(list_filter(string_split(regexp_replace(html, '<!--(?s:.*?)-->', ' ', 'g'), '<a ')[2:], lambda x: contains(split_part(x, '>', 1), 'href=')),
  lambda x: replace(split_part(split_part(split_part(x, '>', 1), 'href="', 2), '"', 1), '&amp;', '&')) AS h FROM pages)"""
HOST = "lower(regexp_replace(split_part(regexp_replace(url, '[?#].*', ''), '/', 3), ':[0-9]*$', ''))"
RESOLVED = """links AS (SELECT DISTINCT page_id, url AS page, x AS link,
  CASE WHEN contains(x, '://') THEN x WHEN x[1:1] = '/' THEN split_part(url, '/', 1) || '//' || split_part(regexp_replace(url, '[?#].*', ''), '/', 3) || x END AS resolved
  FROM hrefs, unnest(h) AS u(x))"""


# --- words, postings and stored documents ---------------------------------------------------------


@query(f"WITH {TOK} SELECT doc_id, pos, token FROM tok")
def tokenize(spark, sf_dir):
    return index.token_positions(docs_of(spark, sf_dir), "doc_id", "text")


@query(f"WITH {TOK}, firsts AS (SELECT doc_id, token, min(pos) AS p FROM tok GROUP BY doc_id, token) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS INTEGER) AS ord, token FROM firsts")
def distinct_tokens(spark, sf_dir):
    return text.exploded(docs_of(spark, sf_dir), ["doc_id"], text.distinct_tokens(F.col("text")), "token", "ord")


@query(f"WITH {TOK} SELECT doc_id, token, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions, count(*) AS n FROM tok GROUP BY doc_id, token")
def build_postings(spark, sf_dir):
    return postings_of(spark, sf_dir).select("doc_id", "token", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"), F.size("positions").cast("long").alias("n"))


@query(f"WITH {TOK} SELECT doc_id, token || ', positions in document: ' || string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS line FROM tok GROUP BY doc_id, token")
def render_postings(spark, sf_dir):
    return postings_of(spark, sf_dir).select("doc_id", index.render_posting(F.col("token"), F.col("positions")).alias("line"))


@query("SELECT page_id, '2024-01-02 03:04:05: key: ''' || url || ''', doc-size: ' || CAST(strlen(html) AS VARCHAR) AS line FROM pages")
def render_documents(spark, sf_dir):
    ts = F.lit("2024-01-02 03:04:05").cast("timestamp")
    return pages_of(spark, sf_dir).select("page_id", index.render_document(F.col("url"), ts, F.col("html")).alias("line"))


def _store(spark: SparkSession, buckets: int = 16) -> index.IndexStore:
    return index.IndexStore(spark, f"{scratch(spark)}/store-{uuid.uuid4().hex}", buckets)


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("key"), F.col("text").alias("data"))


def _stored(spark: SparkSession, sf_dir: str) -> index.IndexStore:
    store = _store(spark)
    store.write_documents(schemas.documents(_keyed(spark, sf_dir), F.col("key"), F.col("data")))
    return store


@query("SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS key, text AS data FROM documents WHERE doc_id = 7")
def doc_by_key(spark, sf_dir):
    """Through the document store, of which one bucket is read."""
    return _stored(spark, sf_dir).find_key("doc/7").select("key", "data")


@query("SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS key, text AS data FROM documents WHERE doc_id = 8")
def doc_by_id(spark, sf_dir):
    """The same by the id of the key."""
    import hashlib

    return _stored(spark, sf_dir).find_id(hashlib.sha512(b"doc/8").hexdigest()).select("key", "data")


@query(f"WITH {TOK}, found AS ({{phrase}} INTERSECT {{word}}) SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS key FROM found".format(phrase="SELECT a.doc_id FROM tok AS a JOIN tok AS b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.token = 'of' AND b.token = 'the'", word="SELECT doc_id FROM tok WHERE token = 'and'"))
def store_upload_find(spark, sf_dir):
    """Documents uploaded to an index on disk, and found by a phrase and a word."""
    store = _store(spark)
    store.upload(_keyed(spark, sf_dir), "all")
    asked = search.parse('"of the" and')
    return search.search(store.postings(asked.all_words), asked).select("key")


@query(f"WITH {TOK} SELECT DISTINCT 'doc/' || CAST(doc_id AS VARCHAR) AS key FROM tok WHERE token = 'the' AND doc_id % 3 <> 0 UNION ALL SELECT 'doc/' || CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 3 = 0")
def store_replace_find(spark, sf_dir):
    """A second upload replaces the words of every third document."""
    store, rows = _store(spark), _keyed(spark, sf_dir)
    store.upload(rows, "all", ts=F.lit("2024-01-01").cast("timestamp"))
    third = docs_of(spark, sf_dir).where("doc_id % 3 = 0").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("key"), F.lit("just the new").alias("data"))
    store.upload(third, "all", ts=F.lit("2024-01-02").cast("timestamp"))
    return search.search(store.postings(["the"]), "the").select("key")


@query(f"SELECT url AS key, strlen(html) AS size FROM (SELECT url, max(html) AS html FROM pages WHERE {HOST} = (SELECT min({HOST}) FROM pages) GROUP BY url)")
def store_collection(spark, sf_dir):
    """Pages uploaded by the collections of their hosts in one job, and the contents of one collection."""
    store, pages = _store(spark), pages_of(spark, sf_dir)
    once = pages.groupBy("url").agg(F.max("html").alias("html"))
    store.upload(once, urls.host(F.col("url")), "url", "html", size=index.sizes(pages, "url", "html"))
    first = pages.agg(F.min(urls.host(F.col("url")))).first()[0]
    return store.contents(first).select("key", F.octet_length("data").cast("long").alias("size"))


@query("SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def bulk_read(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return index.bulk_read(docs_of(spark, sf_dir), wanted, "doc_id")


@query(f"SELECT {HOST} || '.collection' AS collection, page_id AS key FROM pages")
def collection_scan(spark, sf_dir):
    return index.memberships(pages_of(spark, sf_dir), "page_id", "url")


@query(f"WITH {_nodes()} SELECT {HOST} || '.collection' AS collection, page_id, concat(array_to_string(n, ' '), CASE WHEN len(n) > 0 THEN ' ' ELSE '' END) AS text FROM nodes JOIN pages USING (page_id)")
def collection_contents(spark, sf_dir):
    pages = pages_of(spark, sf_dir)
    texts = pages.select("page_id", html.plain_text(F.col("html")).alias("text"))
    members = index.memberships(pages, "page_id", "url")
    return members.join(texts, members["key"] == texts["page_id"]).select("collection", "page_id", "text")


VERSIONS = """versions AS (SELECT doc_id AS key, TIMESTAMP '2024-01-01 00:00:00' AS ts, text AS data FROM documents
UNION ALL SELECT doc_id, TIMESTAMP '2024-01-02 00:00:00', reverse(text) FROM documents WHERE doc_id % 3 = 0)"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    old = docs.select(F.col("doc_id").alias("key"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.col("text").alias("data"))
    return old.unionByName(docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("key"), F.lit("2024-01-02").cast("timestamp").alias("ts"), F.reverse("text").alias("data")))


@query(f"WITH {VERSIONS} SELECT key, data FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS r FROM versions) WHERE r = 1")
def latest_document(spark, sf_dir):
    return index.latest_documents(_versions(spark, sf_dir), ["key"]).select("key", "data")


@query(f"WITH {VERSIONS}, last AS (SELECT key, data FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS r FROM versions) WHERE r = 1), words AS (SELECT key, unnest(regexp_extract_all(lower(data), '{R}')) AS token FROM last) SELECT key, token, count(*) AS n FROM words GROUP BY key, token")
def replaced_postings(spark, sf_dir):
    rows = _versions(spark, sf_dir)
    return index.live_postings(index.build_postings(rows, ["key", "ts"], "data", size=index.sizes(rows, "key", "data").postings), rows).select("key", "token", F.size("positions").cast("long").alias("n"))


@query("WITH r AS (SELECT url, CASE WHEN page_id % 4 = 0 THEN url || '#moved' ELSE url END AS request_url, html FROM pages) SELECT key, strlen(html) AS size FROM (SELECT url AS key, html FROM r UNION ALL SELECT request_url, html FROM r WHERE request_url <> url)")
def store_with_redirects(spark, sf_dir):
    moved = F.when(F.col("page_id") % 4 == 0, F.concat("url", F.lit("#moved"))).otherwise(F.col("url"))
    replies = pages_of(spark, sf_dir).select("url", moved.alias("request_url"), F.col("html").alias("body"))
    return crawl.stored(replies).select("key", F.octet_length("data").cast("long").alias("size"))


# --- search ---------------------------------------------------------------------------------------


def _and(words: list[str]) -> str:
    names = ", ".join(f"'{w}'" for w in words)
    return f"SELECT doc_id FROM tok WHERE token IN ({names}) GROUP BY doc_id HAVING count(DISTINCT token) = {len(words)}"


def _phrase(words: list[str]) -> str:
    joins = " ".join(f"JOIN tok AS t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.pos = t0.pos + {i} AND t{i}.token = '{w}'" for i, w in enumerate(words) if i)
    return f"SELECT DISTINCT t0.doc_id FROM tok AS t0 {joins} WHERE t0.token = '{words[0]}'"


def _found(text_: str):
    def run(spark, sf_dir):
        return search.search(postings_of(spark, sf_dir, text_), text_, "doc_id").select("doc_id")

    return run


for _name, _text, _query in (
    ("search_and", "the and of", _and(["the", "and", "of"])),
    ("search_phrase", '"of the"', _phrase(["of", "the"])),
    ("search_mixed", '"of the" and "in the"', f"{_phrase(['of', 'the'])} INTERSECT {_phrase(['in', 'the'])} INTERSECT {_and(['and'])}"),
    ("search_phrase_dedup", '"the of the"', _phrase(["the", "of"])),
    ("search_dash", "the -of", _and(["the", "of"])),
    ("search_unmatched_quote", 'the "of', _and(["the", "of"])),
    ("search_empty_phrase", '"" the', _and(["the"])),
    ("search_nothing", "", "SELECT doc_id FROM documents WHERE false"),
):
    QUERIES[_name] = _found(_text)
    ORACLE_SQL[_name] = f"WITH {TOK} {_query}"


@query(f"WITH {TOK} SELECT count(*) AS n FROM ({_and(['the', 'and', 'of'])})")
def search_count(spark, sf_dir):
    return search.search(postings_of(spark, sf_dir, "the and of"), "the and of", "doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TOK} SELECT doc_id, token, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions FROM tok WHERE token IN ('of', 'the') AND doc_id IN ({_phrase(['of', 'the'])}) GROUP BY doc_id, token")
def search_positions(spark, sf_dir):
    hits = search.search(postings_of(spark, sf_dir, '"of the"'), '"of the"', "doc_id")
    return search.positions(hits, "doc_id").select("doc_id", "token", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


@query(f"""WITH {TOK}, p AS (SELECT doc_id, token, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions FROM tok WHERE token IN ('of', 'the') AND doc_id IN ({_phrase(['of', 'the'])}) GROUP BY doc_id, token)
SELECT doc_id, '{{"key":"' || CAST(doc_id AS VARCHAR) || '","tokens":[' || string_agg('{{"token":"' || token || '","positions":"' || positions || '"}}', ',' ORDER BY token) || ']}}' AS json FROM p GROUP BY doc_id""")
def search_json(spark, sf_dir):
    return search.as_json(search.search(postings_of(spark, sf_dir, '"of the"'), '"of the"', "doc_id"), "doc_id")


@query(f"WITH {TOK} SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS id FROM ({_and(['the', 'and', 'of'])})")
def search_ids(spark, sf_dir):
    return search.search(postings_of(spark, sf_dir, "the and of"), "the and of", "doc_id").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("id"))


@query(f"WITH {TOK} SELECT doc_id, text FROM documents WHERE doc_id IN ({_phrase(['of', 'the'])})")
def search_documents(spark, sf_dir):
    hits = search.search(postings_of(spark, sf_dir, '"of the"'), '"of the"', "doc_id").select("doc_id")
    return index.bulk_read(docs_of(spark, sf_dir), hits, "doc_id")


# --- frequencies ----------------------------------------------------------------------------------


def _tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.term_freq(docs_of(spark, sf_dir), "doc_id", "text")


@query(f"WITH {TF} SELECT doc_id, token, cnt FROM tf")
def term_freq(spark, sf_dir):
    return _tf(spark, sf_dir)


@query(f"WITH {TF} SELECT doc_id, CAST(sum(cnt) AS BIGINT) AS total_words, count(*) AS distinct_words FROM tf GROUP BY doc_id")
def doc_word_stats(spark, sf_dir):
    return tfidf.doc_word_stats(_tf(spark, sf_dir), "doc_id")


@query(f"WITH {TF} SELECT d.doc_id, coalesce(t.cnt, 0) AS cnt FROM documents AS d LEFT JOIN tf AS t ON t.doc_id = d.doc_id AND t.token = 'the'")
def word_count(spark, sf_dir):
    return tfidf.count_of(_tf(spark, sf_dir), docs_of(spark, sf_dir), "doc_id", "the")


@query(f"WITH {TF}, s AS (SELECT doc_id, sum(cnt) AS total, count(*) AS words FROM tf GROUP BY doc_id) SELECT doc_id, token, round(CAST(cnt AS DOUBLE) / total, 9) AS freq, round(CAST(cnt + 1 AS DOUBLE) / (total + words), 9) AS smoothed FROM tf JOIN s USING (doc_id)")
def term_freq_laplace(spark, sf_dir):
    return tfidf.frequencies(_tf(spark, sf_dir), "doc_id").select("doc_id", "token", F.round("freq", 9).alias("freq"), F.round("smoothed", 9).alias("smoothed"))


DF = f"WITH {TF} SELECT token, count(*) AS n_docs FROM tf GROUP BY token"


@query(DF)
def doc_freq(spark, sf_dir):
    return tfidf.doc_freq(_tf(spark, sf_dir))


@query(DF)
def doc_freq_merge(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    return tfidf.merge_doc_freq(*[tfidf.doc_freq(tfidf.term_freq(docs.where(F.col("doc_id") % 4 == k), "doc_id", "text")) for k in range(4)])


@query(f"WITH {TF}, df AS (SELECT token, count(*) AS n FROM tf GROUP BY token), s AS (SELECT doc_id, token, CAST(cnt AS DOUBLE) / n AS score FROM tf JOIN df USING (token)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, token) AS rank FROM s) SELECT doc_id, token, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def tfidf_top(spark, sf_dir):
    tf = _tf(spark, sf_dir)
    return tfidf.top_words(tf, tfidf.doc_freq(tf), "doc_id", 5).select("doc_id", "token", F.round("score", 9).alias("score"), "rank")


# --- n-grams, pairs and scores --------------------------------------------------------------------


@query(f"WITH {GRAMS} SELECT doc_id, CAST(len(g) AS BIGINT) AS n, md5(array_to_string(g, '|')) AS digest FROM grams")
def ngrams4(spark, sf_dir):
    grams = similarity.with_grams(docs_of(spark, sf_dir), "doc_id", "text")
    return grams.select("doc_id", F.size("grams").cast("long").alias("n"), F.md5(F.encode(F.array_join("grams", "|"), "UTF-8")).alias("digest"))


NEXT = "pairs AS (SELECT * FROM (SELECT doc_id AS first, lead(doc_id) OVER (ORDER BY doc_id) AS second FROM documents) WHERE second IS NOT NULL)"
OVERLAP = f"{GRAMS}, {NEXT}, met AS (SELECT first, second, len(f.g) AS nf, len(s.g) AS ns, CAST(len(list_intersect(f.g, s.g)) AS BIGINT) AS shared FROM pairs JOIN grams AS f ON f.doc_id = first JOIN grams AS s ON s.doc_id = second)"


@query(f"WITH {OVERLAP} SELECT first, second, shared FROM met")
def ngram_intersect(spark, sf_dir):
    return similarity.consecutive_overlap(docs_of(spark, sf_dir), "doc_id", "text").select("first", "second", "shared")


@query(f"WITH {OVERLAP} SELECT first, second, shared * 100 // nullif(least(nf, ns), 0) AS percent, shared * 100 // nullif(least(nf, ns), 0) > 50 AS matched FROM met")
def pair_overlap(spark, sf_dir):
    return similarity.consecutive_overlap(docs_of(spark, sf_dir), "doc_id", "text").select("first", "second", "percent", "matched")


LINES = """lines AS (SELECT l.doc_id AS line_no, CAST(l.doc_id AS VARCHAR) || chr(9) || CAST(l.doc_id + 1 AS VARCHAR) || chr(9) || CAST(l.quality AS VARCHAR) || chr(9) || coalesce(b.text, '') AS line
FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) AS l LEFT JOIN (SELECT item_id, any_value(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark GROUP BY item_id) AS b ON b.item_id = l.doc_id % (SELECT max(item_id) + 2 FROM benchmark))"""
PAIRS = f"""{LINES}, learn AS (SELECT line_no, CAST(split_part(line, chr(9), 1) AS BIGINT) AS doc1, CAST(split_part(line, chr(9), 2) AS BIGINT) AS doc2,
CASE WHEN split_part(line, chr(9), 3) <> '0' THEN 1 ELSE -1 END AS label, split_part(line, chr(9), 4) AS request FROM lines WHERE split_part(line, chr(9), 4) <> '')"""


def _learn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    items = table(spark, sf_dir, "benchmark").groupBy("item_id").agg(F.first(F.regexp_replace("text", r"\s+", " ")).alias("request"))
    n = items.agg(F.max("item_id") + 2).first()[0] or 2  # one more than there are, so that some lines have no request
    both = labels.join(items, F.col("doc_id") % n == F.col("item_id"), "left")
    line = F.concat_ws("\t", "doc_id", F.col("doc_id") + 1, "quality", F.coalesce("request", F.lit("")))
    return similarity.learn_pairs(both.select(F.col("doc_id").alias("line_no"), line.alias("line")))


@query(f"WITH {PAIRS} SELECT * FROM learn")
def learn_pairs(spark, sf_dir):
    return _learn_pairs(spark, sf_dir)


@query(f"WITH {PAIRS} SELECT DISTINCT unnest([doc1, doc2]) AS doc_id FROM learn")
def pair_documents(spark, sf_dir):
    return similarity.pair_documents(_learn_pairs(spark, sf_dir))


@query(f"""WITH {PAIRS}, {GRAMS}, req AS (SELECT line_no, list_distinct([substr(request, CAST(i AS INTEGER), 4) FOR i IN generate_series(1, length(request) - 3)]) AS r FROM learn)
SELECT l.*, CAST(len(f.g) AS BIGINT) AS n_first, CAST(len(s.g) AS BIGINT) AS n_second, CAST(len(list_intersect(f.g, s.g)) AS BIGINT) AS n_shared, CAST(len(r) AS BIGINT) AS n_request,
CAST(len(list_intersect(list_intersect(f.g, s.g), r)) AS BIGINT) AS n_shared_request, len(f.g) > 0 AND len(s.g) > 0 AS valid
FROM learn AS l JOIN req USING (line_no) JOIN grams AS f ON f.doc_id = doc1 JOIN grams AS s ON s.doc_id = doc2""")
def pair_features(spark, sf_dir):
    return similarity.pair_features(_learn_pairs(spark, sf_dir), docs_of(spark, sf_dir), "doc_id", "text")


def _pair_store(spark: SparkSession, sf_dir: str) -> similarity.PairStore:
    store = similarity.PairStore(spark, f"{scratch(spark)}/pairs-{uuid.uuid4().hex}")
    store.write_documents(docs_of(spark, sf_dir), "doc_id", "text")
    store.write_elements(_learn_pairs(spark, sf_dir))
    return store


@query(f"WITH {GRAMS} SELECT doc_id AS id, text, CAST(len(g) AS BIGINT) AS n, md5(array_to_string(g, '|')) AS digest FROM grams JOIN documents USING (doc_id)")
def pair_store_documents(spark, sf_dir):
    return _pair_store(spark, sf_dir).documents().select("id", "text", F.size("ngrams").cast("long").alias("n"), F.md5(F.encode(F.array_join("ngrams", "|"), "UTF-8")).alias("digest"))


@query(f"WITH {PAIRS} SELECT doc1, doc2, label, request, CAST(len(list_distinct([substr(request, CAST(i AS INTEGER), 4) FOR i IN generate_series(1, length(request) - 3)])) AS BIGINT) AS n_request FROM learn")
def pair_store_elements(spark, sf_dir):
    found = _pair_store(spark, sf_dir).elements()
    return found.select(F.col("doc_ids")[0].alias("doc1"), F.col("doc_ids")[1].alias("doc2"), "label", "request", F.size("req_ngrams").cast("long").alias("n_request"))


@query(f"""WITH {PAIRS}, {GRAMS}, req AS (SELECT line_no, list_distinct([substr(request, CAST(i AS INTEGER), 4) FOR i IN generate_series(1, length(request) - 3)]) AS r FROM learn)
SELECT doc1, doc2, label, CAST(len(list_intersect(f.g, s.g)) AS BIGINT) AS n_shared, CAST(len(list_intersect(list_intersect(f.g, s.g), r)) AS BIGINT) AS n_shared_request
FROM learn AS l JOIN req USING (line_no) JOIN grams AS f ON f.doc_id = doc1 JOIN grams AS s ON s.doc_id = doc2""")
def pair_store_features(spark, sf_dir):
    return _pair_store(spark, sf_dir).features().select("doc1", "doc2", "label", "n_shared", "n_shared_request")


@query("""WITH l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
n AS (SELECT doc_id, toxic, sum(toxic) OVER w AS p, sum(1 - toxic) OVER w AS n FROM l WINDOW w AS (ORDER BY doc_id)),
g AS (SELECT *, n + least(0, min(2 * p - n) OVER (ORDER BY doc_id)) AS acc FROM n WHERE toxic = 0),
k AS (SELECT *, acc > lag(acc, 1, 0) OVER (ORDER BY doc_id) AS keep FROM g)
SELECT doc_id, toxic FROM l WHERE toxic = 1 UNION ALL SELECT doc_id, toxic FROM k WHERE keep""")
def class_balance(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return ordered.balance_classes(labels, "doc_id", F.col("toxic") == 1)


@query(f"WITH {PAIRS}, {GRAMS} SELECT count(*) FILTER (v AND label > 0) AS positive, count(*) FILTER (v AND label <= 0) AS negative, count(*) FILTER (NOT v) AS invalid FROM (SELECT label, len(f.g) > 0 AND len(s.g) > 0 AS v FROM learn JOIN grams AS f ON f.doc_id = doc1 JOIN grams AS s ON s.doc_id = doc2)")
def class_counts(spark, sf_dir):
    features = similarity.pair_features(_learn_pairs(spark, sf_dir), docs_of(spark, sf_dir), "doc_id", "text")
    return score.class_counts(features, F.col("label"), F.col("valid"))


COUNTS = "c AS (SELECT count(*) FILTER (a AND p) AS tp, count(*) FILTER (NOT a AND p) AS fp, count(*) FILTER (NOT a AND NOT p) AS tn, count(*) FILTER (a AND NOT p) AS fn FROM (SELECT quality = 1 AS a, n_chars > 500 AS p FROM labels JOIN documents USING (doc_id)))"


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return score.confusion(both, F.col("quality") == 1, F.col("n_chars") > 500)


@query(f"WITH {COUNTS} SELECT tp, fp, tn, fn FROM c")
def score_confusion(spark, sf_dir):
    return _confusion(spark, sf_dir)


@query(f"WITH {COUNTS} SELECT round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 9) AS precision, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 9) AS recall, round(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM c")
def score_prf(spark, sf_dir):
    return score.precision_recall(_confusion(spark, sf_dir)).select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {COUNTS} SELECT (tp + tn) * 100 // nullif(tp + tn + fp + fn, 0) AS percent FROM c")
def success_percent(spark, sf_dir):
    return score.success_percent(_confusion(spark, sf_dir))


# --- pages and links ------------------------------------------------------------------------------


@query(f"WITH {HREFS} SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, h[i] AS link FROM hrefs, unnest(generate_series(1, len(h))) AS u(i)")
def html_links(spark, sf_dir):
    return text.exploded(pages_of(spark, sf_dir), ["page_id"], html.links(F.col("html")), "link", "pos")


@query(f"WITH {HREFS} SELECT page_id, array_to_string(list_sort(list_distinct(h)), ' ') AS links FROM hrefs")
def html_link_set(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", F.array_join(html.link_set(F.col("html")), " ").alias("links"))


@query(f"WITH {_nodes()} SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, n[i] AS node FROM nodes, unnest(generate_series(1, len(n))) AS u(i)")
def html_text_nodes(spark, sf_dir):
    return text.exploded(pages_of(spark, sf_dir), ["page_id"], html.text_nodes(F.col("html")), "node", "pos")


@query(f"WITH {_nodes()}, w AS (SELECT page_id, flatten([regexp_extract_all(lower(x), '{R}') FOR x IN n]) AS w FROM nodes) SELECT page_id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w, ' ')) AS digest FROM w")
def html_word_tokens(spark, sf_dir):
    words = pages_of(spark, sf_dir).select("page_id", html.word_tokens(F.col("html")).alias("w"))
    return words.select("page_id", F.size("w").cast("long").alias("n"), F.md5(F.encode(F.array_join("w", " "), "UTF-8")).alias("digest"))


@query(f"WITH {_nodes()} SELECT page_id, concat(array_to_string(n, ' '), CASE WHEN len(n) > 0 THEN ' ' ELSE '' END) AS text FROM nodes")
def html_plain_text(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", html.plain_text(F.col("html")).alias("text"))


@query(f"SELECT page_id, lower(split_part(url, ':', 1)) AS scheme, {HOST} AS host, CASE WHEN contains(split_part(url, '/', 3), ':') THEN split_part(split_part(url, '/', 3), ':', 2) ELSE '' END AS port, substr(regexp_replace(url, '[?#].*', ''), length(split_part(url, '/', 1)) + length(split_part(regexp_replace(url, '[?#].*', ''), '/', 3)) + 3) AS path FROM pages")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.port(u).alias("port"), F.regexp_extract(u, urls.PATH, 1).alias("path"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.exploded(pages_of(spark, sf_dir), ["page_id", F.col("url").alias("page")], F.array_distinct(html.links(F.col("html"))), "link")
    return rows.withColumn("resolved", urls.resolve(F.col("page"), F.col("link")))


@query(f"WITH {HREFS}, {RESOLVED} SELECT page_id, link, resolved FROM links")
def resolve_links(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "link", "resolved")


@query(f"WITH {HREFS}, {RESOLVED} SELECT page_id, resolved FROM links WHERE lower(split_part(resolved, ':', 1)) IN ('http', 'https') AND lower(regexp_replace(split_part(regexp_replace(resolved, '[?#].*', ''), '/', 3), ':[0-9]*$', '')) <> '' AND resolved <> page")
def filter_scheme_self(spark, sf_dir):
    r = F.col("resolved")
    return _links(spark, sf_dir).where(urls.allowed_scheme(r) & (urls.host(r) != "") & (r != F.col("page"))).select("page_id", "resolved")


@query(f"WITH {HREFS}, {RESOLVED} SELECT page_id, resolved FROM links WHERE lower(regexp_replace(split_part(regexp_replace(resolved, '[?#].*', ''), '/', 3), ':[0-9]*$', '')) = lower(regexp_replace(split_part(regexp_replace(page, '[?#].*', ''), '/', 3), ':[0-9]*$', ''))")
def filter_domain(spark, sf_dir):
    return _links(spark, sf_dir).where(urls.in_domain(urls.host(F.col("page")), F.col("resolved"))).select("page_id", "resolved")


ORIGIN = "split_part(url, '/', 1) || '//' || split_part(regexp_replace(url, '[?#].*', ''), '/', 3)"
PORTED = f"ported AS (SELECT page_id, {ORIGIN} || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN ':80' WHEN 2 THEN ':8080' ELSE ':81' END || '/x' AS u FROM pages)"


@query(f"WITH {PORTED} SELECT page_id, u FROM ported WHERE NOT contains(split_part(u, '/', 3), ':') OR split_part(split_part(u, '/', 3), ':', 2) IN ('80', '8080')")
def filter_port(spark, sf_dir):
    at = F.col("page_id") % 4
    u = F.concat(F.regexp_extract("url", urls.ORIGIN, 1), F.when(at == 0, "").when(at == 1, ":80").when(at == 2, ":8080").otherwise(":81"), F.lit("/x"))
    return table(spark, sf_dir, "pages").select("page_id", u.alias("u")).where(urls.allowed_port(F.col("u"), [80, 8080]))


@query("SELECT page_id, url FROM pages WHERE url NOT LIKE '%blog%' AND (instr(url, '#') = 0 OR instr(url, '#') = length(url))")
def filter_words(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url").where(urls.without_words(F.col("url"), ["blog", "#"]))


TYPED = "typed AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'image/png' END AS content_type, CASE WHEN page_id % 6 = 5 THEN chr(1) || chr(2) ELSE html END AS body FROM pages)"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 3 == 0, "text/html").when(F.col("page_id") % 3 == 1, "image/png")
    return pages_of(spark, sf_dir).select("page_id", "url", kind.alias("content_type"), F.when(F.col("page_id") % 6 == 5, F.lit("\x01\x02")).otherwise(F.col("html")).alias("body"))


@query(f"WITH {TYPED} SELECT page_id, CASE WHEN content_type IS NOT NULL THEN starts_with(content_type, 'text/') ELSE (length(body[:1024]) - length(regexp_replace(body[:1024], '[\\x01-\\x08\\x0E-\\x1F\\x7F]', '', 'g'))) * 10 <= length(body[:1024]) AND body <> '' END AS accepted FROM typed")
def text_filter(spark, sf_dir):
    return _typed(spark, sf_dir).select("page_id", urls.accepts_text(F.col("content_type"), F.col("body")).alias("accepted"))


@query(f"WITH {TYPED} SELECT page_id, CASE WHEN NOT coalesce(starts_with(content_type, 'text/'), true) THEN 'fallback' WHEN page_id % 5 = 0 THEN 'links only' ELSE 'process' END AS route FROM typed WHERE page_id % 7 <> 0")
def reply_routing(spark, sf_dir):
    replies = _typed(spark, sf_dir).withColumns({"code": F.when(F.col("page_id") % 5 == 0, 304).otherwise(200), "error": F.when(F.col("page_id") % 7 == 0, "failed")})
    accepts = [F.coalesce(F.col("content_type").startswith("text/"), F.lit(True))]
    return crawl.routed(crawl.usable(replies), accepts).select("page_id", "route")


# --- crawl ----------------------------------------------------------------------------------------

CACHE = f"cache AS (SELECT {ORIGIN} || '/The' AS url, min(TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(page_id % 3 AS INTEGER))) AS ts FROM pages GROUP BY 1)"
OUT = f"{HREFS}, {RESOLVED}, out AS (SELECT DISTINCT resolved AS url FROM links WHERE lower(split_part(resolved, ':', 1)) IN ('http', 'https') AND lower(regexp_replace(split_part(regexp_replace(resolved, '[?#].*', ''), '/', 3), ':[0-9]*$', '')) <> '' AND resolved <> page)"


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.concat(F.regexp_extract("url", urls.ORIGIN, 1), F.lit("/The")).alias("key"), F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(page_id % 3 as int))").alias("ts"))
    return pages.groupBy("key").agg(F.min("ts").alias("ts"))


def _frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = pages_of(spark, sf_dir).select("url", F.col("html").alias("body"))
    return crawl.frontier(crawl.outgoing(replies), table(spark, sf_dir, "pages").select("url"))


@query(f"WITH {OUT} SELECT url FROM out WHERE url NOT IN (SELECT url FROM pages)")
def frontier_dedupe(spark, sf_dir):
    return _frontier(spark, sf_dir)


@query(f"WITH {OUT}, {CACHE} SELECT o.url, CASE WHEN ts IS NULL THEN 'download' WHEN ts < TIMESTAMP '2024-01-02 00:00:00' THEN 'revalidate' ELSE 'skip' END AS action FROM out AS o LEFT JOIN cache USING (url) WHERE o.url NOT IN (SELECT url FROM pages)")
def crawl_plan(spark, sf_dir):
    return crawl.plan(_frontier(spark, sf_dir), _cache(spark, sf_dir), F.lit("2024-01-02").cast("timestamp")).select("url", "action")


@query(f"WITH {CACHE} SELECT url FROM cache WHERE ts < TIMESTAMP '2024-01-02 00:00:00'")
def crawl_freshness(spark, sf_dir):
    cache = _cache(spark, sf_dir)
    due = crawl.plan(cache.select(F.col("key").alias("url")), cache, F.lit("2024-01-02").cast("timestamp"))
    return due.where("action = 'revalidate'").select("url")


@query("WITH u AS (SELECT url, min(page_id) AS page_id, min(html) AS html FROM pages GROUP BY url) SELECT url, strlen(CASE WHEN page_id % 2 = 0 THEN html ELSE 'new' END) AS size FROM u")
def not_modified_body(spark, sf_dir):
    pages = pages_of(spark, sf_dir).groupBy("url").agg(F.min("page_id").alias("page_id"), F.min("html").alias("html"))
    replies = pages.select("url", F.col("url").alias("request_url"), F.when(F.col("page_id") % 2 == 0, 304).otherwise(200).alias("code"), F.when(F.col("page_id") % 2 == 1, "new").alias("body"))
    cache = pages.select(F.col("url").alias("key"), F.col("html").alias("data"))
    return crawl.with_cached_bodies(replies, cache).select("url", F.octet_length("body").cast("long").alias("size"))


@query("SELECT count(*) AS total FROM (SELECT DISTINCT url FROM pages) WHERE true")
def processed_total(spark, sf_dir):
    """How many replies a level of the crawl has, as the engine counts them."""
    replies = pages_of(spark, sf_dir).select("url", F.col("html").alias("body"), F.lit(None).cast("string").alias("error")).dropDuplicates(["url"])
    return crawl.usable(replies).agg(F.count(F.lit(1)).alias("total"))


# --- services -------------------------------------------------------------------------------------


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 404 WHEN page_id % 4 = 1 THEN 304 ELSE 200 END AS status FROM pages")
def http_get_status(spark, sf_dir):
    k = F.col("page_id") % 4
    ts, since = F.lit("2024-01-02").cast("timestamp"), F.when(k == 1, F.lit("2024-01-02").cast("timestamp")).when(k == 2, F.lit("2024-01-01").cast("timestamp"))
    return table(spark, sf_dir, "pages").select("page_id", readers.get_status(k != 0, ts, since).cast("int").alias("status"))


ASKED = "asked AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'http://h/upload?name=a&base_index=b' WHEN 1 THEN 'http://h/upload?name=a' ELSE 'http://h/upload?url=c' END AS u FROM pages)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 3
    return table(spark, sf_dir, "pages").select("page_id", F.when(k == 0, "http://h/upload?name=a&base_index=b").when(k == 1, "http://h/upload?name=a").otherwise("http://h/upload?url=c").alias("u"))


@query(f"WITH {ASKED} SELECT page_id, CASE WHEN NOT contains(u, 'name=') OR NOT contains(u, 'base_index=') THEN 400 WHEN page_id % 6 = 0 THEN 503 ELSE 200 END AS status FROM asked")
def http_upload_status(spark, sf_dir):
    return _asked(spark, sf_dir).select("page_id", readers.upload_status(F.col("u"), F.col("page_id") % 6 == 0).cast("int").alias("status"))


@query(f"WITH {ASKED} SELECT page_id, CASE WHEN NOT contains(u, 'url=') THEN 400 WHEN page_id % 2 = 0 THEN 505 ELSE 200 END AS status FROM asked")
def http_push_status(spark, sf_dir):
    return _asked(spark, sf_dir).select("page_id", readers.push_status(F.col("u"), F.col("page_id") % 2 == 0).cast("int").alias("status"))


@query(f"WITH {ASKED} SELECT page_id, CASE WHEN NOT contains(u, 'base_index=') THEN 'base_index' WHEN NOT contains(u, 'name=') THEN 'name' END AS missing FROM asked")
def required_parameters(spark, sf_dir):
    return _asked(spark, sf_dir).select("page_id", readers.required(F.col("u"), "base_index", "name").alias("missing"))


@query("""SELECT page_id, CASE WHEN page_id % 10 = 0 THEN url WHEN page_id % 4 = 0 THEN 'one' WHEN page_id % 4 = 1 THEN 'two' ELSE url END AS text FROM pages""")
def normalized_text(spark, sf_dir):
    k = F.col("page_id") % 4
    reply = F.when(k == 0, '{"reply":{"normalize":"one"}}').when(k == 1, '{"reply":[{"normalize":"one"},{"normalize":"two"}]}').when(k == 2, "no json").otherwise('{"reply":{}}')
    failed = F.col("page_id") % 10 == 0
    found = normalize.answered(F.col("url"), reply, F.when(failed, 500).otherwise(200), failed)
    return table(spark, sf_dir, "pages").select("page_id", found.alias("text"))


@query("""SELECT page_id, '{"request":{"data":"' || url || '","normalize":"yes"}}' AS message FROM pages""")
def normalize_request(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", normalize.request(F.col("url")).alias("message"))


# --- pipeline -------------------------------------------------------------------------------------


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_of(spark, sf_dir).select("page_id", "url", F.col("html").alias("body"))


@query(f"WITH {_nodes()} SELECT page_id, word, count(*) AS n FROM (SELECT page_id, unnest(n) AS word FROM nodes) GROUP BY page_id, word")
def pipeline_term_freq(spark, sf_dir):
    done = pipeline.run_batch(_messages(spark, sf_dir), [pipeline.html_stage, pipeline.feature_stage])
    return text.exploded(done, ["page_id"], F.col("terms_frequencies"), "t").select("page_id", "t.word", "t.n")


@query(f"WITH {_nodes()} SELECT page_id, word, count(*) AS n FROM (SELECT page_id, unnest(flatten([regexp_extract_all(lower(x), '{R}') FOR x IN n])) AS word FROM nodes) GROUP BY page_id, word")
def pipeline_word_freq(spark, sf_dir):
    done = pipeline.run_batch(_messages(spark, sf_dir), [pipeline.html_stage, lambda df: pipeline.feature_stage(df, words=True)])
    return text.exploded(done, ["page_id"], F.col("terms_frequencies"), "t").select("page_id", "t.word", "t.n")


@query("SELECT page_id, url, 'stub-info' AS stub FROM pages")
def pipeline_stub(spark, sf_dir):
    return pipeline.stub_stage(_messages(spark, sf_dir)).select("page_id", "url", "stub")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'first' ELSE 'second' END AS k, '' AS absent FROM pages")
def meta_first_write_wins(spark, sf_dir):
    once = pipeline.set_first(_messages(spark, sf_dir).select("page_id"), "k", F.when(F.col("page_id") % 2 == 0, "first"))
    twice = pipeline.set_first(once, "k", F.lit("second"))
    return twice.select("page_id", "k", pipeline.value_or(twice, "absent", F.lit("")).alias("absent"))


@query("SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def recovery_backlog(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pipeline.backlog(pages, pages.where("page_id % 3 = 0"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 's' ELSE 'f' END AS status FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def recovery_status(spark, sf_dir):
    pages = _messages(spark, sf_dir).withColumn("body", F.when(F.col("page_id") % 2 == 0, F.col("body")))
    return pipeline.recover(pages, pages.where("page_id % 3 = 0")).select("page_id", "status")


@query(f"WITH {_nodes()} SELECT page_id, word, count(*) AS n FROM (SELECT page_id, unnest(n) AS word FROM nodes) GROUP BY page_id, word")
def stream_pipeline(spark, sf_dir):
    """The pipeline over the pages as a stream of files into Parquet, read back when all that was there is done."""
    out = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "pages").schema
    source = pipeline.messages(spark, f"{sf_dir}/pages.parquet*", schema).withColumn("body", F.col("html"))
    pipeline.run_stream(source, f"{out}/rows", f"{out}/checkpoint", [pipeline.html_stage, pipeline.feature_stage]).awaitTermination()
    return text.exploded(spark.read.parquet(f"{out}/rows"), ["page_id"], F.col("terms_frequencies"), "t").select("page_id", "t.word", "t.n")


@query("SELECT doc_id, CAST(doc_id * 3 AS VARCHAR) AS word FROM documents")
def number_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.to_text(F.col("doc_id") * 3).alias("word"))


# --- what SQL has no words for --------------------------------------------------------------------


@query()
def charset_convert(spark, sf_dir):
    """Texts encoded in windows-1252, detected and converted back."""
    ship(spark)
    sample = "Les élèves français étaient très âgés; die Bäume größer, über süßes Öl; el niño comió jamón y piña, también".encode
    profiles = charset.train_profiles({"utf-8": sample("utf-8"), "windows-1252": sample("windows-1252")})

    @F.pandas_udf("binary")
    def encoded(batch):
        return batch.map(lambda t: t.encode("windows-1252", "replace"), na_action="ignore")

    data = docs_of(spark, sf_dir).select("doc_id", encoded("text").alias("data"))
    found = data.withColumn("charset", charset.detect_charset(F.col("data"), profiles))
    return found.select("doc_id", "charset", charset.convert_charset("data", "charset").alias("text"))


@query()
def murmur_hash(spark, sf_dir):
    ship(spark)
    return docs_of(spark, sf_dir).select("doc_id", charset.murmur("text", F.lit(0)).alias("hash"))


@query(f"WITH {GRAMS} SELECT DISTINCT doc_id, hex(encode(x)[:8]) AS gram FROM grams, unnest(g) AS u(x)")
def gram_keys(spark, sf_dir):
    ship(spark)
    return text.exploded(docs_of(spark, sf_dir), ["doc_id"], text.ngram_keys(F.col("text")), "gram")


@query()
def strict_tokens(spark, sf_dir):
    return index.token_positions(docs_of(spark, sf_dir), "doc_id", "text", text.STRICT_TOKEN)


@query()
def similarity_model(spark, sf_dir):
    """A model trained on nine tenths of the pairs, judged on the others."""
    features = similarity.pair_features(_learn_pairs(spark, sf_dir), docs_of(spark, sf_dir), "doc_id", "text").cache()
    trained = model.train(features.where(model.in_training(F.col("line_no"))))
    return model.evaluate(trained, features.where(~model.in_training(F.col("line_no"))))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase search: documents with a phrase and a word, and where they are."""
    hits = search.search(postings_of(spark, sf_dir, 'the "of the"'), 'the "of the"', "doc_id")
    return search.positions(hits, "doc_id").select("doc_id", "token", F.size("positions").cast("long").alias("n"))
