"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of consecutive words. To be contained whole, a window must
have each of its tokens in the document, so by the prefix-filter argument its rarest token alone is a
necessary prefix. Rarity is the token's document frequency over the whole corpus, counted first
(only for tokens that the benchmark has). A document's tokens join the windows' prefixes; a
candidate must then fit by length and position (the window may not start before the document nor end
after it), and at last its words are compared exactly. Tokens are one-word shingles: a window of ten
words is its own exact check, so wider shingles would prune nothing more.

Windows are made from the benchmark by tasks, combined per distinct window, and dealt by hash into
blocks of about `max_windows` windows. A block's index is held by the tasks while all documents stream
past; what it hits is written to the checkpoint folder by the documents' own keys and its broadcast is
released before the next block, so memory is bounded for a benchmark of any size and no text is ever
shuffled. Where one block holds the whole benchmark, hits go straight to the result.

Defined results: a null or empty text has no words and no hits; an item without words has no windows;
an item of fewer words than a window is one window; windows that items share count for each; an item
with a null id marks hits but is listed nowhere; repeated rows return as often as they come; an
empty documents table gives an empty result, an empty benchmark one without hits; columns of other
names pass through `decontaminate` unread.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import cut, fresh, join_groups, keys, spread, table
from lexmill.llm.exact_dedup import flag_repeats, n_blocks, repeated_cells
from lexmill.session import ship

WINDOW = 10
#: Windows of one block; with their words, some 300 MB at most in a worker.
MAX_WINDOWS = 500_000
#: The filter of documents with hits is broadcast, at most so large.
FILTER_MB = 64
#: Lower-cases A-Z and blanks every byte that no word has; bytes of 0x80 and above stay.
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def windows_of(words: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


class Index:
    """Windows by their rarest word, with its place in the window and the items that have the window."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]], frequency: dict[bytes, int]):
        self.by_word: dict[bytes, list] = defaultdict(list)
        for window, items in windows.items():
            at = min(range(len(window)), key=lambda i: (frequency.get(window[i], 0), window[i], i))
            self.by_word[window[at]].append((at, window, sorted(items)))
        self.by_word = dict(self.by_word)
        self.words = frozenset(self.by_word)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The merged spans of hit words and the items of all windows that occur."""
        if self.words.isdisjoint(words):
            return [], set()
        n, spans, items, by_word = len(words), [], set(), self.by_word
        for i, word in enumerate(words):
            for at, window, of in by_word.get(word, ()):
                start = i - at
                end = start + len(window)
                if start >= 0 and end <= n and all(map(bytes.__eq__, window, words[start:end])):
                    spans.append((start, end))
                    items.update(of)
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(window, items): the distinct windows, words joined by a space, with the ids of the items that have them."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = {(b" ".join(w), item) for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for w in windows_of(words_of(text.as_py()), width)}
            yield pa.RecordBatch.from_pydict({"window": pa.array([w for w, _ in rows], pa.binary()), "item": pa.array([i for _, i in rows], pa.string())})

    rows = spread(benchmark).select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")).mapInArrow(run, "window binary, item string")
    return rows.groupBy("window").agg(F.collect_set("item").alias("items"))


def benchmark_blocks(windows: DataFrame, blocks: int) -> Iterator[dict[tuple[bytes, ...], list[str]]]:
    """The windows in so many blocks, dealt by hash; the driver holds one block at a time."""
    for k in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k).collect()
        yield {tuple(bytes(r["window"]).split(b" ")): r["items"] for r in rows}


def document_frequency(docs: DataFrame, text_col: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each word of the vocabulary occurs, over the whole corpus."""
    held = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def run(batches):
        import pyarrow as pa

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(held.value.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    counts = docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counts.collect()}  # a row per word of the block


def searched(docs: DataFrame, text_col: str, names: list[str], index, blank: bool = False, hits_only: bool = False) -> DataFrame:
    """docs with what the index finds added to the columns `names`: words, spans and items.

    blank: texts come back null; hits_only: only rows in which something was found.
    """
    text_at, n_at, s_at, i_at = map(docs.columns.index, (text_col, *names))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, spans, items = [], [], []
            for text, had, of in zip(batch.column(text_at), batch.column(s_at).to_pylist(), batch.column(i_at).to_pylist(), strict=True):
                words = words_of(text.as_py())
                new, found = index.value.find(words)
                n.append(len(words))
                spans.append([x for ab in merged([*zip(had[::2], had[1::2], strict=True), *new]) for x in ab])
                items.append(sorted(found.union(of)))
            columns = batch.columns
            if blank:
                columns[text_at] = pa.nulls(batch.num_rows, columns[text_at].type)
            columns[n_at], columns[s_at], columns[i_at] = pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))
            out = pa.RecordBatch.from_arrays(columns, batch.schema.names)
            yield out.filter(pa.array([bool(x) for x in spans], pa.bool_())) if hits_only else out

    return docs.mapInArrow(run, schema)


def with_earlier(docs: DataFrame, key: Column, parts: list[DataFrame], names: list[str]) -> DataFrame:
    """docs with the spans and items that earlier blocks found; only rows that a filter of hit documents can't rule out shuffle."""
    k, n, flag = fresh(docs.columns, "k", "n", "maybe")
    spans, items = names[1:]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    found = cut(every.groupBy("k").agg(F.max("n").alias(n), F.flatten(F.collect_list("spans")).alias("had"), F.flatten(F.collect_list("items")).alias("of")))  # a row per block
    blocks = n_blocks(found.count(), 16, FILTER_MB)
    flagged = flag_repeats(docs.withColumn(k, key), k, repeated_cells(found, "k", blocks, 1), blocks, flag)
    joined = join_groups(flagged.where(F.col(flag)), found.withColumnRenamed("k", k), k, n, docs.count(), "left")
    own = [c for c in docs.columns if c not in names]
    hit = joined.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{names[0]}`"), F.coalesce("had", F.col(f"`{spans}`")).alias(spans), F.coalesce("of", F.col(f"`{items}`")).alias(items))
    return flagged.where(~F.col(flag)).select([f"`{c}`" for c in docs.columns]).unionByName(hit)


def mark(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, width: int, most: int, blank: bool = False) -> tuple[DataFrame, list[str]]:
    """docs with three more columns: the number of words, the merged spans (start, end, ...) of hit words, and the items; and their names.

    blank: texts come back null, for callers that don't need them.
    """
    spark = docs.sparkSession
    ship(spark)
    names = fresh(docs.columns, "words", "spans", "items")

    def blanks(df):
        return df.select("*", F.lit(0).cast("long").alias(names[0]), F.array().cast("array<long>").alias(names[1]), F.array().cast("array<string>").alias(names[2]))

    windows = cut(benchmark_windows(benchmark, item_col, item_text_col, width))
    blocks = max(1, -(-windows.count() // most))
    key, parts, out = F.struct(*keys(id_col, text_col)), [], blanks(docs)
    for at, block in enumerate(benchmark_blocks(windows, blocks), 1):
        frequency = document_frequency(docs, text_col, {w for window in block for w in window}) if block else {}
        held = spark.sparkContext.broadcast(Index(block, frequency))
        del block, frequency
        if at < blocks:
            rows = searched(blanks(docs.select(key.alias("k"), F.col(f"`{text_col}`").alias("text"))), "text", names, held, blank=True, hits_only=True)
            parts.append(cut(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.first(names[1]).alias("spans"), F.first(names[2]).alias("items"))))
            held.destroy()
    return searched(with_earlier(out, key, parts, names) if parts else out, text_col, names, held, blank), names


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The digest of all rows: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the spans of hit words."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    marked, (n_words, held, items) = mark(rows, benchmark, "doc_id", "text", item_col, item_text_col, width, max_windows, blank=True)
    spans = F.col(held)
    n_hit = F.aggregate(F.sequence(F.lit(1), F.size(spans)), F.lit(0).cast("long"), lambda t, i: t + F.when(i % 2 == 0, F.element_at(spans, i)).otherwise(-F.element_at(spans, i)))
    hit = F.when(F.size(spans) > 0, n_hit).otherwise(F.lit(0)).cast("long")
    return marked.select(
        "doc_id", F.col(n_words).alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(F.array_sort(items), ","), "UTF-8"), 256).alias("items_sha256"), (F.size(spans) > 0).alias("contaminated"), spans.alias("spans"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The rows without any occurrence of a window, with all their columns."""
    marked, (_, spans, _) = mark(docs, benchmark, id_col, text_col, item_col, item_text_col, width, max_windows)
    return marked.where(F.size(spans) == 0).select([f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return contamination(docs, table(spark, sf_dir, "benchmark")).drop("spans")


SQL = r"""
WITH fold AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + 9], ' ') AS words FROM item, unnest(generate_series(1, greatest(1, len(w) - 9))) AS u(i) WHERE len(w) > 0),
places AS (SELECT DISTINCT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS words
           FROM fold, (SELECT DISTINCT k FROM windows) AS ks, unnest(generate_series(1, len(w) - k + 1)) AS u(i) WHERE len(w) >= k),
found AS (SELECT p.doc_id, p.i, p.k, x.item_id FROM places AS p JOIN windows AS x ON x.k = p.k AND x.words = p.words),
hits AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM found, unnest(generate_series(0, k - 1)) AS u(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY doc_id)
SELECT f.doc_id, CAST(len(f.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM fold AS f LEFT JOIN hits AS h USING (doc_id) LEFT JOIN items AS t USING (doc_id)
"""
