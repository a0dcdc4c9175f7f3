"""Character n-grams of whole texts in numpy, on Arrow batches: distinct, sorted, and counted between texts.

A gram is n code points, held as one number whose order is that of its UTF-8 bytes. Nothing is hashed, so
counts are exact.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.session import ship

_HEX = np.frombuffer("".join(f"{b:02X}" for b in range(256)).encode(), np.uint16)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def numbered(texts: list[np.ndarray], n: int) -> tuple[list[np.ndarray], int]:
    """The grams of each text as numbers that agree between the texts, and the bits of a code point; 0 bits if numbers are mere ranks."""
    bits = max(1, *[int(p.max()).bit_length() for p in texts if len(p)], 1)
    held, used, ranked = [np.zeros(max(0, len(p) - n + 1), np.uint64) for p in texts], 0, False
    for k in range(n):
        if used + bits > 64:
            values, ranked = np.unique(np.concatenate(held)), True
            held, used = [np.searchsorted(values, c).astype(np.uint64) for c in held], len(values).bit_length()
        held = [c << np.uint64(bits) | p[k : k + len(c)] for c, p in zip(held, texts, strict=True)]
        used += bits
    return held, 0 if ranked else bits


def once(codes: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    s = np.sort(codes)
    return s if len(s) < 2 else s[np.concatenate([[True], s[1:] != s[:-1]])]


def distinct(text: str, n: int) -> np.ndarray:
    """The distinct grams in order, a row of code points each."""
    p = points(text)
    (codes,), bits = numbered([p], n)
    if bits:
        return ((once(codes)[:, None] >> np.arange((n - 1) * bits, -1, -bits, dtype=np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)
    at = np.unique(codes, return_index=True)[1]
    return p[at[:, None] + np.arange(n)]


def utf8(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all grams, and the number of bytes of each."""
    data = np.frombuffer(grams.tobytes().decode("utf-32-le").encode(), np.uint8)
    if len(data) == grams.size:
        return data, np.full(len(grams), grams.shape[1], np.int64)
    return data, (1 + (grams >= 0x80) + (grams >= 0x800) + (grams >= 0x10000)).sum(axis=1)


def keyed(data: np.ndarray, sizes: np.ndarray, most: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The same of the hexadecimal digits of each gram's first bytes, once each; equal ones are neighbours."""
    if len(sizes) and sizes.max() > most:
        starts = np.cumsum(sizes) - sizes
        within = np.arange(len(data)) - np.repeat(starts, sizes)
        heads = np.zeros((len(sizes), most), np.uint8)
        short = within < most
        heads[np.repeat(np.arange(len(sizes)), sizes)[short], within[short]] = data[short]
        sizes = np.minimum(sizes, most)
        new = np.concatenate([[True], (heads[1:] != heads[:-1]).any(axis=1) | (sizes[1:] != sizes[:-1])])
        heads, sizes = heads[new], sizes[new]
        data = heads[np.arange(most) < sizes[:, None]]
    return _HEX[data].view(np.uint8), sizes * 2


def lists(texts, n: int, keys: bool):
    """An Arrow array of a list of strings for each text; null of null."""
    import pyarrow as pa

    data, sizes, counts = [], [np.zeros(1, np.int64)], []
    for text in texts:
        t = text.as_py()
        d, s = utf8(distinct(t or "", n))
        if keys:
            d, s = keyed(d, s)
        data.append(d)
        sizes.append(s)
        counts.append(len(s))
    ends = np.cumsum(np.concatenate(sizes))
    strings = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.concatenate(data) if data else np.zeros(0, np.uint8))).cast(pa.string())
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(counts)], pa.int32()), strings, mask=texts.is_null())


def gram_lists(text: Column, n: int, keys: bool = False) -> Column:
    """The distinct grams of a text, or their keys, sorted."""

    def run(texts):
        return lists(texts, n, keys)

    return F.arrow_udf(run, T.ArrayType(T.StringType()))(text)


def with_counts(rows: DataFrame, columns: list[str], first: str, second: str, request: str | None = None, n: int = 4) -> DataFrame:
    """The columns, and how many distinct grams both texts have, the request, and what they share; null where a text is."""
    ship(rows.sparkSession)
    texts = [first, second] if request is None else [first, second, request]
    names = ["n_first", "n_second", "n_shared", "n_request", "n_shared_request"][: 3 if request is None else 5]
    schema = T.StructType([*rows.select(*columns).schema.fields, *[T.StructField(c, T.LongType()) for c in names]])

    def counted(held: list[str | None]) -> list[int | None]:
        sets, _ = numbered([points(t or "") for t in held], n)
        sets = [None if t is None else once(s) for t, s in zip(held, sets, strict=True)]

        def met(a, b):
            return None if a is None or b is None else np.intersect1d(a, b, assume_unique=True)

        both = met(sets[0], sets[1])
        found = [sets[0], sets[1], both] if request is None else [sets[0], sets[1], both, sets[2], met(both, sets[2])]
        return [None if s is None else len(s) for s in found]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            k = len(columns)
            counts = [counted([t.as_py() for t in row]) for row in zip(*batch.columns[k:], strict=True)]
            made = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *made], schema.fieldNames())

    return rows.select(*columns, *[F.col(c).alias(f"_text{i}") for i, c in enumerate(texts)]).mapInArrow(run, schema)
