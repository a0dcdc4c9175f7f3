import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import exact_dedup, line_dedup, registry, simhash
from tests.llm.conftest import LONG, native
from tests.oracle import check

# --- exact ----------------------------------------------------------------------------------------


def test_exact_equals_sql(spark, sf_dir):
    check(spark, "op6", registry.QUERIES["op6_exact_dedup"], registry.ORACLE_SQL["op6_exact_dedup"], sf_dir)


def test_exact_groups_of_edges(edge_docs):
    rows = exact_dedup.exact_groups(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    sha = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    size = Counter(sha(r.text) for r in edge_docs.collect())
    assert all(r.group_size == size[r.text_sha256] for r in rows)
    by = {(r.doc_id, r.text_sha256): r for r in rows}
    assert by[5, sha("alpha beta gamma delta")].keep_id == 1 and not by[5, sha("alpha beta gamma delta")].kept
    assert by[None, sha("")].keep_id == 2 and not by[None, sha("")].kept  # a null text is an empty one, a null id comes last
    assert by[4, sha(" ")].kept and by[None, sha("no id here")].kept


def test_exact_keeps_one_of_each_text(edge_docs, no_docs):
    kept = exact_dedup.exact_dedup(edge_docs)
    assert kept.columns == edge_docs.columns and native(kept)
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in edge_docs.collect()}
    assert exact_dedup.exact_dedup(no_docs).count() == 0 and exact_dedup.exact_groups(no_docs).count() == 0


@pytest.mark.parametrize("cells", [1, 8])
def test_exact_with_a_full_filter(spark, cells):
    """A filter far too small only sends more rows through the shuffle."""
    r = random.Random(2)
    rows = [(i, f"text {r.randint(0, 3000)}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert {r.doc_id for r in exact_dedup.exact_dedup(df, cells_per_row=cells).collect()} == set(first.values())


def test_exact_hot_group(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"own {i}") for i in range(6000)], "doc_id long, text string")
    rows = exact_dedup.exact_groups(df).where("group_size > 1").collect()
    assert len(rows) == 2000 and {r.keep_id for r in rows} == {0} and {r.group_size for r in rows} == {2000}


# --- lines ----------------------------------------------------------------------------------------


def lines(spark, *texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in line_dedup.line_dedup(df, **options).orderBy("doc_id").collect()]


def test_templates_with_fields_recur(spark):
    texts = ["server alpha says hello to bob at 10:22\nmine one here", "server alpha says hello to joe at 11:59\nmine two there", "server alpha says hello to ann at 7:00\nmine three elsewhere"]
    assert lines(spark, *texts) == ["mine one here", "mine two there", "mine three elsewhere"]


@pytest.mark.parametrize("n", [30, 300, 3000])
def test_templates_whose_word_fields_recur(spark, n):
    """The values of two word fields recur, alone and together, at every size; another template shares the leaf."""
    r = random.Random(n)
    names, cities = (["".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(4)) for _ in range(40)] for _ in range(2))
    told = [f"this story was sent in by reader {r.choice(names)} from {r.choice(cities)} for the weekly mail" for _ in range(n)]
    other = [f"this story was told to us by {r.choice(names)} and edited by {r.choice(cities)} last night" for _ in range(n // 3)]
    assert not any(lines(spark, *told, *other))


def test_prose_with_a_common_opening_stays(spark):
    texts = [f"on the other {w} nothing else is like this {w} at {w}" for w in ("hand", "side", "day", "shore")]
    assert lines(spark, *texts) == texts


def test_blank_and_short_lines_stay(spark):
    assert lines(spark, "a b\n\nx", "a b\n\ny", "a b\n\nz") == ["a b\n\nx", "a b\n\ny", "a b\n\nz"]


@pytest.mark.parametrize("line", ["Read more", "Copyright 2024 Acme", "Page 3 of 10", "Published: 12 May 2024", "版权所有", "続きを読む", "12 345 678", "Home"])
def test_repeats_word_for_word_go(spark, line):
    assert lines(spark, *[f"{line}\nown{w}" for w in "abc"]) == ["owna", "ownb", "ownc"]


def test_masked_repeats_go_unless_they_are_numbers_alone(spark):
    assert not any(lines(spark, "Page 1 of 10", "Page 2 of 10", "Page 3 of 12"))
    numbers = ["1 2 | 3", "4 5 | 6", "7 8 | 9", "2024", "2025", "2026"]
    assert lines(spark, *numbers) == numbers


def test_repeats_within_a_document_are_no_recurrence(spark):
    assert lines(spark, "this line again\n" * 5, "other words here") == ["this line again\n" * 5, "other words here"]


def test_long_passages_that_documents_share(spark):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    texts = [f"own start {chr(97 + k)} line\n{passage}\nown end {chr(97 + k)} line too" for k in range(4)]
    assert all(passage not in t and "own start" in t for t in lines(spark, *texts))


def test_line_counts_against_brute_force(spark, sf_dir):
    """Every line that three documents have goes; what else goes shares its template's constant words."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    of = defaultdict(set)
    for i, t in docs.items():
        for x in t.split("\n"):
            of[x].add(i)
    must = {x for x, ids in of.items() if len(ids) >= 3 and len(x.split()) >= 3}
    for r in registry.QUERIES["op1_line_dedup"](spark, sf_dir).collect():
        kept = r.text.split("\n") if r.n_dropped < r.n_lines else []
        assert not must.intersection(kept) and r.n_lines == len(docs[r.doc_id].split("\n")) == len(kept) + r.n_dropped


def brute_templates(texts, min_docs=3, similarity=0.8, depth=3):
    """The places of the lines that go, by document: each leaf's templates, tried one by one."""
    field = lambda t: bool(re.search("[0-9@]", t))
    placed = []  # (document, place, leaf, tokens)
    for doc, text in enumerate(texts):
        for at, raw in enumerate((text or "").split("\n")):
            tokens = [t for t in re.split(r"[\x09\x0b-\x0d ]+", raw) if t]
            if not tokens or (len(tokens) < 3 and len(" ".join(tokens).encode()) < 4):
                continue
            constant = [t for t in tokens if not field(t)]
            plain = any(map(field, tokens)) and len(constant) < depth and not any(c.isalpha() for t in constant for c in t)
            shape = tuple(tokens) if plain else tuple("<*>" if field(t) else t for t in tokens)
            placed.append((doc, at, (len(tokens), shape if plain else shape[:depth]), shape))
    leaves, docs_of = defaultdict(Counter), defaultdict(set)
    for _, _, leaf, shape in placed:
        leaves[leaf][shape] += 1
    of = defaultdict(set)
    for leaf, shapes in leaves.items():
        often = Counter()
        for shape, n in shapes.items():
            for part in enumerate(shape):
                often[part] += n
        for shape, n in shapes.items():
            of[leaf, shape].add(shape)
            parts = [p for p in enumerate(shape) if p[1] != "<*>"]
            for least in {often[p] for p in parts if often[p] >= min_docs} if len(shapes) > 1 else ():
                held = frozenset(p for p in parts if often[p] >= least)
                if len(held) >= max(depth, similarity * len(parts) - 1e-9):
                    of[leaf, shape].add(held)
    uses = Counter(t for ts in of.values() for t in ts if isinstance(t, frozenset))
    for doc, _, leaf, shape in placed:
        for t in of[leaf, shape]:
            docs_of[leaf, t].add(doc)
    gone = defaultdict(set)
    for doc, at, leaf, shape in placed:
        if any(len(docs_of[leaf, t]) >= min_docs and uses.get(t, 2) > 1 for t in of[leaf, shape]):
            gone[doc].add(at)
    return gone


def test_templates_against_brute_force(spark, sf_dir):
    """Exactly the lines of recurring templates go, on the given documents and on made-up ones."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(2))
    made = []
    for k in range(60):
        rows = [f"the {word()} of {word()} was seen by {r.choice('xyz')} near the {word()} at {r.randint(1, 9)}" for _ in range(2)]
        rows += [f"{r.randint(0, 3)} {r.randint(0, 3)}", r.choice(["Home", "Read more", "a b", f"Page {k}", f"| {k % 4} |"]), " ".join(r.choice("abc") for _ in range(r.randint(3, 12)))]
        rows += [f"from here on all lines say {word()} and {word()} but end alike as they were made for it by {r.choice('pq')}\t{k}"]
        made.append("\n".join(rows))
    given = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    for texts in (made, given):
        gone = brute_templates(texts)
        want = ["\n".join(x for at, x in enumerate(t.split("\n")) if at not in gone[i]) for i, t in enumerate(texts)]
        assert any(gone.values()) and lines(spark, *texts) == want


def test_long_lines_and_many_lines_in_bounded_time(spark):
    """A line of a million words in three documents, twice with fields of its own; and documents whose 100,000 lines all go."""
    import time

    began = time.monotonic()
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(1_000_000)]
    long = [" ".join(words[:k] + [f"own{w}"] + words[k + 1 :]) for k, w in ((500, "a"), (600, "b"), (700, "c"))]
    assert lines(spark, *(f"{x}\nmine {w}" for x, w in zip(long, "abc", strict=True))) == ["mine a", "mine b", "mine c"]
    many = "\n".join(f"{words[i]} line {words[-i - 1]} {words[i // 676]}" for i in range(100_000))
    assert lines(spark, *(f"{many}\nmine {w}" for w in "abc")) == ["mine a", "mine b", "mine c"]
    assert time.monotonic() - began < 150


def test_result_columns_that_the_table_has(spark):
    df = spark.createDataFrame([(1, "a", 7, 8)], "doc_id long, text string, n_lines int, N_DROPPED int")
    out = line_dedup.line_dedup(df)
    assert out.columns == ["doc_id", "text", "n_lines", "N_DROPPED", "n_lines_2", "n_dropped_2"] and out.first()[2:] == (7, 8, 1, 0)


def test_lines_of_edges(edge_docs, no_docs):
    found = line_dedup.line_dedup(edge_docs)
    assert native(found) and found.columns == [*edge_docs.columns, "n_lines", "n_dropped"]
    rows = found.collect()
    assert len(rows) == edge_docs.count()
    assert {(r.text, r.n_lines, r.n_dropped) for r in rows if r.doc_id in (2, 3)} == {(None, 0, 0), ("", 1, 0)}
    assert {r.text for r in rows if r.doc_id in (6, 7)} == {LONG}
    assert line_dedup.line_dedup(no_docs).count() == 0


def test_hot_line(spark):
    df = spark.createDataFrame([(i, f"the very same line\nonly {chr(97 + i % 26)} {i}") for i in range(3000)], "doc_id long, text string")
    assert not any("very same" in r.text for r in line_dedup.line_dedup(df).collect())


# --- SimHash --------------------------------------------------------------------------------------


def brute_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    parent = {i: i for i in prints}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("text", ["", None, "one", "One TWO", "a b c d e f", " x \u0085 y\x1cz É", "w " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_print(text)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_simhash_against_brute_force(spark, sf_dir, sf):
    sf_dir = sf_dir.replace("sf0.001", sf)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: brute_print(t) for i, t in docs.items()}
    groups = brute_groups(prints)
    rows = registry.QUERIES["op8_simhash_near_dedup"](spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", groups[i]) for i in docs}


@pytest.mark.parametrize("limit", [512, 60, 25])
def test_links_of_dense_and_sparse_prints(spark, limit):
    """Fingerprints around a few centres, at distances of 0 to 6; small limits split their shards again and again."""
    r = random.Random(limit)
    centres = [r.getrandbits(64) for _ in range(8)]
    prints = {}
    for i in range(260):
        v = r.choice(centres)
        for b in r.sample(range(64), r.randint(0, 6)):
            v ^= 1 << b
        prints[i] = v
    first = {}
    for i, v in prints.items():
        first.setdefault(v, i)
    nodes = spark.createDataFrame([(simhash.signed(v), i) for v, i in first.items()], "fp long, node long")
    found = {x.node: x.component for x in simhash.components(simhash.links(nodes, limit)).collect()}
    want = brute_groups({i: v for v, i in first.items()})
    assert {i: found.get(i, i) for i in want} == want


def test_masks_cover_every_near_pair():
    r = random.Random(1)
    masks = simhash.first_masks()
    assert len(masks) == 10
    for _ in range(300):
        d = sum(1 << b for b in r.sample(range(64), 3))
        agreed = [m for m in masks if not d & m]
        assert agreed and all(any(not d & f for f in simhash.finer_masks(m)) for m in agreed)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 501)], "hi long, lo long")
    found = {r.node: r.component for r in simhash.components(edges).collect()}
    assert found == {i: 0 for i in range(1, 201)} | {501: 500}


def test_simhash_of_edges(edge_docs, no_docs):
    rows = simhash.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    of = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert of[5] == 1 and of[7] == 6 and of[2] == of[3] == of[4] == 2
    assert {r.component_id for r in rows if r.doc_id is None} == {None, 2}
    kept = simhash.near_dedup(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(r.doc_id for r in rows if r.doc_id is not None and r.doc_id == r.component_id)
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.near_dedup(no_docs).count() == 0


NEAR = " ".join(f"word{i}" for i in range(300))


@pytest.mark.parametrize("kind", ["int", "long", "string", "decimal(20,0)"])
def test_near_dedup_by_ids_of_any_type(spark, kind):
    rows = [("3", NEAR), ("5", NEAR + " end"), ("7", "something else entirely is here"), ("9", NEAR), ("9", "an unrelated text with the same id"), (None, NEAR)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").select(F.col("doc_id").cast(kind).alias("doc_id"), "text")
    digest = simhash.near_duplicates(docs)
    assert dict(digest.dtypes)["component_id"] == dict(digest.dtypes)["doc_id"] == dict(docs.dtypes)["doc_id"]
    kept = simhash.near_dedup(docs)
    assert kept.dtypes == docs.dtypes
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("3", NEAR), ("7", rows[2][1]), ("9", rows[4][1])]


def test_near_dedup_keeps_one_of_equal_ids(spark):
    """Two texts of a group share its smallest id, and one of them comes twice."""
    docs = spark.createDataFrame([(1, NEAR), (1, NEAR), (1, NEAR + " end"), (2, NEAR)], "doc_id long, text string")
    assert simhash.near_dedup(docs).count() == 1
    assert simhash.near_duplicates(docs).select("component_id").distinct().collect()[0][0] == 1


def near_chain():
    """Three texts of which only neighbours are near."""
    r, value = random.Random(3), simhash.fingerprint(NEAR)
    at = {value: NEAR}
    while True:
        words = NEAR.split()
        for _ in range(r.randint(1, 12)):
            words[r.randrange(300)] = f"other{r.randrange(10**6)}"
        v = simhash.fingerprint(text := " ".join(words))
        for a in at:
            for b in at:
                if (a ^ v).bit_count() <= 3 and (b ^ v).bit_count() <= 3 and (a ^ b).bit_count() > 3:
                    return at[a], text, at[b]
        at[v] = text


def test_a_document_without_id_links_others(spark):
    one, between, two = near_chain()
    docs = spark.createDataFrame([(1, one), (None, between), (2, two), (None, "no id and alone")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()} == {(1, 1), (None, 1), (2, 1), (None, None)}
    assert sorted(r.text for r in simhash.near_dedup(docs).collect()) == sorted([one, "no id and alone"])


@pytest.mark.parametrize("hub", [100, 10**6])
def test_components_of_a_star_with_a_large_hub(spark, monkeypatch, hub):
    monkeypatch.setattr(simhash, "HUB", hub)
    edges = spark.range(1, 20_001).select(F.col("id").alias("hi"), F.lit(0).cast("long").alias("lo")).union(spark.range(1).select(F.lit(30_000), F.lit(20_000)))
    rows = simhash.components(edges).collect()
    assert len(rows) == 20_001 and {r.component for r in rows} == {0}


def test_few_rows_go_to_few_files_however_many_partitions_shuffle(spark, monkeypatch):
    """Every file that a checkpoint or the result has costs the executors calls to the file system, empty ones, too."""
    texts = [NEAR + f" end{i % 40}" for i in range(120)] + [f"own{i} text of{i} no other{i}" for i in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {tuple(r) for r in simhash.near_duplicates(docs, limit=8).collect()}
    files, cut = [], simhash.cut

    def counted(*args):
        out = cut(*args)
        files.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(simhash, "cut", counted)
    for k, v in (("spark.sql.shuffle.partitions", "32"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(k, v)
    try:
        rows = simhash.near_duplicates(docs.repartition(32), limit=8)
        files.append(rows.rdd.getNumPartitions())
        assert {tuple(r) for r in rows.collect()} == want and len(want) == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) > 6 and max(files) <= spark.sparkContext.defaultParallelism, files


def test_files_grow_with_the_rows(spark, monkeypatch):
    from lexmill import session

    monkeypatch.setattr(session, "ROWS", 10)
    rows = session.cut(spark.range(200).repartition(50), 200)
    assert rows.rdd.getNumPartitions() == 21 and sorted(r.id for r in rows.collect()) == list(range(200))
    assert session.cut(rows, 5).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and session.cut(rows).count() == 200
