"""Line dedup by a log-template tree, in DataFrame functions alone.

A line's place in the tree is of fixed depth: its number of tokens, then its leading tokens, tokens
with digits or an @ being variable from the start. Only lines whose leaf may recur (a Bloom filter
over the leaves, of bounded size, says so) go on; the others are never shuffled. In a leaf, a line's
tokens are ordered by how many lines have them at the same place; the rarest are variable fields, too,
so lines that differ in such fields share a template. No fixed number tells rare from common: a line
is tried with each set of rarest tokens that leaves it constant enough, so a template is found whatever
the size of its leaf, the other templates there, or how often the values of its fields recur. A
template recurs if lines of at least `min_docs` documents have it. A line is a template of its own, with its digits masked, or as it is if it says next to
nothing beside them; a template with fields for words must be at least `similarity` constant beside
its fields of digits, and have `depth` constant tokens, so that prose with a common opening isn't one.
All lines of recurring templates are dropped, in every document.

Counts combine before each shuffle; templates of many lines join by a bounded broadcast, so a line
that a third of all documents have lands in no single task. Documents that lose nothing pass through.

Defined results: a null text stays null, an empty one empty, both with no line dropped; blank lines
and lines of under `min_bytes` bytes and `min_tokens` tokens are never dropped; lines end at \\n, and what stays is joined
by \\n; rows that agree in id and text are one document when documents are counted, and are treated
alike; an empty table gives an empty result; other columns pass through whatever their names, and the two
counts take the next free name where the table has theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import cut, free_names, fresh, join_groups, keys, spread, table
from lexmill.llm.exact_dedup import flag_repeats, n_blocks, repeated_cells

MIN_DOCS, MIN_TOKENS, MIN_BYTES, DEPTH, SIMILARITY = 3, 3, 4, 3, 0.8
FIELD = "<*>"
#: The filter of recurring leaves is broadcast, at most so large; beyond it more lines shuffle.
FILTER_MB = 64
_VARIABLE = r"(?<!\S)[^\s0-9@]*[0-9@]\S*"
_CONSTANT = r"(?<!\S)[^\s0-9@]++(?!\S)"
_WORD = r"(?<!\S)[^\s0-9@\p{L}]*+\p{L}[^\s0-9@]*+(?!\S)"


def masked(line: Column) -> Column:
    """A line in which tokens with a digit or an @ are fields."""
    return F.when(line.rlike("[0-9@]"), F.regexp_replace(line, _VARIABLE, FIELD)).otherwise(line)


def verbatim(line: Column, depth: int) -> Column:
    """Whether a line says too little beside its digits for them to be fields: no word, and under `depth` constant tokens."""
    return line.rlike("[0-9@]") & ~line.rlike(_WORD) & (F.regexp_count(line, F.lit(_CONSTANT)) < depth)


def form(line: Column, depth: int) -> Column:
    """What lines have to share to be repeats."""
    return F.when(verbatim(line, depth), line).otherwise(masked(line))


def tidy(text: Column) -> Column:
    """A text with single spaces inside its lines; the pattern runs only where bytes call for it."""
    odd = F.contains(text, F.lit("  "))
    for c in "\t\r\x0b\x0c":
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.regexp_replace(text, r"[\x09\x0B-\x0D\x20]+", " ")).otherwise(text)


def lines_of(docs: DataFrame, id_col: str, text_col: str, depth: int, min_tokens: int, min_bytes: int) -> DataFrame:
    """(k1, k2, at, line, leaf): all lines that may have a template; at counts from 0.

    The place in the tree needs a line's spaces and its leading tokens only, so the rest is masked later.
    """
    k1, k2 = keys(id_col, text_col)
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), tidy(F.col(f"`{text_col}`")).alias("text"))  # once a document, below the split
    lines = keyed.select("k1", "k2", F.posexplode(F.split("text", "\n", -1)).alias("at", "raw"))
    line = F.trim("raw")
    n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    long = lines.where((line != "") & ((n >= min_tokens) | (F.octet_length(line) >= min_bytes)))
    head = F.substring_index(line, " ", depth)
    place = F.when(verbatim(line, depth), line).otherwise(masked(head))
    return long.select("k1", "k2", "at", line.alias("line"), F.xxhash64(n, place).alias("leaf"))


def templates(lines: DataFrame, min_docs: int, similarity: float, depth: int) -> DataFrame:
    """(m1, m2, ts, n): for each distinct line by hash the templates it may have, by hash, and the rows it has; those with fields for words only if constant enough."""
    variants = cut(lines.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n")))
    leaves = variants.groupBy("leaf").agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("rows"))
    several = leaves.where((F.col("variants") > 1) & (F.col("rows") >= min_docs)).select("leaf", "variants")
    tokens, m1, m2 = F.split("line", " "), F.xxhash64(F.lit(1), "line"), F.xxhash64(F.lit(2), "line")
    words = F.size(F.filter(tokens, lambda t: t != FIELD))
    # a line is a template of its own, however short
    same = variants.where(F.col("n") >= min_docs).select(m1.alias("m1"), m2.alias("m2"), "n", F.array(F.struct(m1.alias("t1"), m2.alias("t2"))).alias("ts"))
    n_lines = variants.count()
    spoken = join_groups(variants, several, "leaf", "variants", n_lines)
    spoken = spoken.select("leaf", m1.alias("m1"), m2.alias("m2"), "n", words.alias("words"), tokens.alias("tokens"))  # once a line, below the split
    parts = spoken.select("leaf", "m1", "m2", "n", "words", F.posexplode("tokens").alias("place", "token")).where(F.col("token") != FIELD)
    often = parts.groupBy("leaf", "place", "token").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("uses")).where(F.col("total") >= min_docs)
    often = often.select(F.xxhash64("leaf", "place", "token").alias("part"), "uses", "total")
    parts = parts.select("m1", "m2", "n", "words", F.xxhash64("leaf", "place", "token").alias("part"))
    kept = join_groups(parts, often, "part", "uses", n_lines)
    # from each frequency on that leaves enough of them, the tokens are constant; a window holds one line's tokens
    upto = Window.partitionBy("m1", "m2").orderBy(F.desc("total"))
    kept = kept.withColumn("held", F.count(F.lit(1)).over(upto)).withColumn("x", F.bit_xor("part").over(upto)).withColumn("y", F.bit_xor(F.xxhash64("part")).over(upto))
    least = F.greatest(F.ceil(F.lit(similarity) * F.col("words") - 1e-9), F.lit(depth))
    each = kept.where(F.col("held") >= least).select("m1", "m2", "n", F.xxhash64(F.lit(3), "held", "x").alias("t1"), F.xxhash64(F.lit(4), "held", "y").alias("t2"))
    each = cut(each.dropDuplicates(["m1", "m2", "t1", "t2"]))
    # what only one line has, it has as itself
    shared = each.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("uses"), F.sum("n").alias("rows")).where((F.col("uses") > 1) & (F.col("rows") >= min_docs))
    shared = join_groups(each, shared.select("t1", F.col("t2").alias("other"), "uses"), "t1", "uses", n_lines).where("t2 = other")
    many = shared.select("m1", "m2", "n", F.array(F.struct("t1", "t2")).alias("ts"))
    return same.unionByName(many).groupBy("m1", "m2").agg(F.flatten(F.collect_list("ts")).alias("ts"), F.max("n").alias("n"))  # fewer than a line's tokens


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_docs: int, similarity: float, depth: int, min_tokens: int, min_bytes: int) -> DataFrame:
    """(k1, k2, drops): for each document that loses lines, which."""
    lines = lines_of(docs, id_col, text_col, depth, min_tokens, min_bytes)
    n = (docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`"))).alias("n")).first()["n"] or 0) // 100
    blocks = n_blocks(n, 8, FILTER_MB)
    maybe = flag_repeats(lines, "leaf", repeated_cells(lines, "leaf", blocks, min_docs), blocks, "maybe").where("maybe")
    maybe = cut(maybe.select("k1", "k2", "at", "leaf", form(F.col("line"), depth).alias("line")))
    known = cut(templates(maybe.select("leaf", "line"), min_docs, similarity, depth))
    narrow = maybe.select("k1", "k2", "at", F.xxhash64(F.lit(1), "line").alias("m1"), F.xxhash64(F.lit(2), "line").alias("m2"))
    of = known.withColumnRenamed("m2", "other")
    placed = join_groups(narrow, of, "m1", "n", narrow.count()).where("m2 = other").select("k1", "k2", "at", F.explode("ts").alias("t"))
    placed = cut(placed.select("k1", "k2", "at", "t.t1", "t.t2"))
    recurring = placed.groupBy("t1", "t2").agg(F.count_distinct("k1", "k2").alias("docs"), F.count(F.lit(1)).alias("n")).where(F.col("docs") >= min_docs)
    recurring = recurring.select("t1", F.col("t2").alias("other"), "n")
    gone = join_groups(placed, recurring, "t1", "n", narrow.count()).where("t2 = other")
    return gone.groupBy("k1", "k2").agg(F.collect_set("at").alias("drops"))  # at most a document's lines


def without(lines: Column, gone: str) -> Column:
    """The elements of an array but those at the places that another one lists: the stretches between these, in one walk."""
    at = F.sort_array(gone)
    before, after = F.concat(F.array(F.lit(-1)), at), F.concat(at, F.array(F.size(lines)))
    # a lambda of one array holds the lines, which so are split once
    return F.transform(F.array(lines), lambda xs: F.flatten(F.zip_with(before, after, lambda a, b: F.slice(xs, a + 2, b - a - 1))))[0]


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """docs with the text that stays, and n_lines and n_dropped (n_lines_2 and so on where docs has such columns)."""
    a, b, flag, gone = fresh(docs.columns, "k1", "k2", "maybe", "drops")
    drops = cut(dropped_lines(docs, id_col, text_col, min_docs, similarity, depth, min_tokens, min_bytes))
    blocks = n_blocks(drops.count(), 16, FILTER_MB)
    k1, k2 = keys(id_col, text_col)
    keyed = docs.withColumns({a: k1, b: k2})
    flagged = flag_repeats(keyed, a, repeated_cells(drops, "k1", blocks, 1), blocks, flag)
    lost = flagged.where(F.col(flag)).join(drops.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("drops").alias(gone)), [a, b], "left").drop(flag)
    same = flagged.where(~F.col(flag)).drop(flag).withColumn(gone, F.lit(None).cast("array<int>"))
    text, lines = F.col(f"`{text_col}`"), F.split(F.col(f"`{text_col}`"), "\n", -1)
    stays = F.array_join(without(lines, gone), "\n")
    out = same.unionByName(lost.select(same.columns))
    columns = [F.when(F.col(gone).isNull(), text).otherwise(stays).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    n = F.when(text.isNull(), 0).otherwise(F.size(lines))
    n_lines, n_dropped = free_names(docs.columns, "n_lines", "n_dropped")
    return out.select(*columns, n.cast("long").alias(n_lines), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_dropped))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "n_lines", "n_dropped", "text")
