import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lexmill.llm import packing, pretokens, quality, registry
from tests.llm.test_dedup import brute_groups, brute_print
from tests.llm.test_text import brute_hits


def hold(rows, texts, capacity=2048):
    """An exact round trip: pieces give the ids back, sequences are gapless and fit."""
    tool = pretokens.tokenizer()
    by_doc, by_sequence, total = defaultdict(list), defaultdict(list), 0
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for doc, parts in by_doc.items():
        ids = tool.encode(texts[doc] or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        parts.sort(key=lambda r: r.piece)
        assert [r.start for r in parts] == list(range(0, len(ids), capacity)) and [r.piece for r in parts] == list(range(len(parts)))
        for r in parts:
            own = ids[r.start : r.start + r.length]
            assert len(own) == r.length and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence), -(-total // capacity)


def test_packing_round_trip(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    used, least = hold(registry.QUERIES["op9_best_fit_packing"](spark, sf_dir).collect(), texts)
    assert used <= least * 1.01 + 1


def test_packing_edges(spark, edge_docs, no_docs):
    df = edge_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    hold(packing.pack(df).collect(), {r.doc_id: r.text for r in df.collect()})
    assert packing.pack(edge_docs).where("doc_id IS NULL").count() == 2
    assert packing.pack(edge_docs).where("doc_id = 5").count() == 2
    assert packing.pack(no_docs).count() == 0


def test_packing_at_another_capacity(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hold(packing.pack(df, capacity=100).collect(), {r.doc_id: r.text for r in df.collect()}, 100)


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_the_histogram(seed):
    rng = np.random.default_rng(seed)
    hist = np.zeros(257, np.int64)
    np.add.at(hist, rng.integers(1, 257, 5000) if seed % 2 else np.minimum(256, 1 + rng.geometric(0.02, 5000)), 1)
    patterns, got = packing.plan(hist, 256), np.zeros_like(hist)
    for pattern, n in patterns:
        assert n > 0 and sum(k * c for k, c in pattern) <= 256
        for k, c in pattern:
            got[k] += c * n
    assert (got == hist).all()
    least = -(-int((hist * np.arange(257)).sum()) // 256)
    assert sum(n for _, n in patterns) <= 1.02 * max(least, int(hist[129:].sum())) + 1


def test_plan_of_the_classic_instance():
    """Three sizes of which only the right mix fills a sequence."""
    hist = np.zeros(101, np.int64)
    hist[[50, 30, 20]] = 60
    assert sum(n for _, n in packing.plan(hist, 100)) <= 62


def test_configurations_cover_the_counts():
    counts = np.array([0, 40, 30, 20, 10, 5, 0, 3, 0, 0, 0])
    lp = packing.configurations(counts, 10)
    assert all(sum(k * n for k, n in c.items()) <= 10 for c, _ in lp)
    cover = sum(x * np.bincount(list(c), list(c.values()), 11) for c, x in lp)
    assert (cover >= counts - 1e-6).all() and sum(x for _, x in lp) <= 1.25 * (counts * np.arange(11)).sum() / 10


def test_knapsack_is_best():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 13, 4))
        prices = rng.random(len(lengths))
        best = np.zeros(14)
        for c in range(1, 14):
            best[c] = max([best[c - 1], *(best[c - k] + p for k, p in zip(lengths, prices, strict=True) if k <= c)])
        found = packing.knapsack(prices, lengths, 13)
        assert sum(lengths[j] * n for j, n in found.items()) <= 13 and sum(prices[j] * n for j, n in found.items()) == pytest.approx(best[13])


# --- the pipeline ---------------------------------------------------------------------------------


def test_stages_are_the_named_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]


def test_pipeline_against_brute_force(spark, sf_dir):
    import re

    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(documents, labels)
    docs = {r.doc_id: r.text for r in documents.collect()}
    docs = {i: t for i, t in sorted(docs.items()) if model.score(t) >= 0.5}
    first = {}
    for i, t in docs.items():
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    docs = {i: docs[i] for i in first.values()}
    groups = brute_groups({i: brute_print(t) for i, t in docs.items()})
    docs = {i: t for i, t in docs.items() if groups[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = {i: t for i, t in docs.items() if not brute_hits(t, items)[1]}
    used, least = hold(corpus_pipeline.run(spark, sf_dir).collect(), docs)
    assert used <= least * 1.01 + 1


def test_stages_keep_the_columns(spark, sf_dir, edge_docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, edge_docs, sf_dir).columns == edge_docs.columns


def test_registry_has_ten_and_the_pipeline():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert __spark_entry__.oracle_sql().keys() <= names.keys()
