"""Charset detection and conversion, and a 64-bit string hash: the functions that need Python.

They work on whole Arrow batches. A charset profile holds the relative frequency of byte pairs in
sample texts; a text belongs to the profile it is most likely under.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes counted at once; counting takes some twenty times as much memory.
PIECE = 1 << 18


def pair_counts(data: bytes) -> np.ndarray:
    b, counts = np.frombuffer(data, np.uint8), np.zeros(65536, np.int64)
    for at in range(0, len(b) - 1, PIECE):
        piece = b[at : at + PIECE + 1]
        counts += np.bincount(piece[:-1].astype(np.uint16) << 8 | piece[1:], minlength=65536)
    return counts


def train_profiles(samples: Mapping[str, bytes]) -> dict[str, np.ndarray]:
    """Log-likelihoods of byte pairs for each charset, from a sample of text in it."""
    out = {}
    for name, data in samples.items():
        counts = pair_counts(data) + 0.05
        out[name] = np.log(counts / counts.sum()).astype(np.float32)
    return out


def detect(data: bytes | None, profiles: Mapping[str, np.ndarray]) -> str | None:
    """The charset under whose profile the bytes are most likely; None for fewer than two bytes."""
    if not data or len(data) < 2 or not profiles:
        return None
    counts = pair_counts(bytes(data))
    at = np.flatnonzero(counts)
    return max(sorted(profiles), key=lambda n: float(profiles[n][at] @ counts[at]))


def convert(data: bytes | None, charset: str | None) -> str | None:
    """UTF-8 text of bytes in a charset: malformed bytes are skipped one by one, a cut last character is left out.

    The conversion counts only if it keeps more than a third of the bytes, else the bytes are taken as UTF-8.
    """
    if data is None:
        return None
    raw = bytes(data)
    if charset and charset.lower().replace("-", "") != "utf8":
        try:
            out = raw.decode(charset, "ignore")
            if len(out.encode()) > len(raw) // 3:
                return out
        except LookupError:
            pass
    return raw.decode("utf-8", "ignore")


def detect_charset(data: Column, profiles: Mapping[str, np.ndarray]) -> Column:
    held = dict(profiles)

    @F.pandas_udf(T.StringType())
    def run(batch):
        return batch.map(lambda b: detect(b, held), na_action="ignore")

    return run(data)


@F.pandas_udf(T.StringType())
def convert_charset(data, charset):
    import pandas as pd

    return pd.Series([convert(d, c) for d, c in zip(data, charset, strict=True)])


_M64 = (1 << 64) - 1
_MUL, _SHIFT = 0xC6A4A7935BD1E995, 47


def _signed(x: int) -> int:
    x &= _M64
    return x - (1 << 64) if x >> 63 else x


def murmur64(data: bytes, seed: int = 0) -> int:
    """MurmurHash64A of bytes as a signed number; unlike the published one its last shifts keep the sign."""
    h = _signed(seed ^ (len(data) * _MUL))
    words = np.frombuffer(data[: len(data) & ~7], "<u8").tolist()
    for k in words:
        k = k * _MUL & _M64
        h = _signed((h ^ ((k ^ (k >> _SHIFT)) * _MUL)) * _MUL)
    if rest := data[8 * len(words) :]:
        h = _signed((h ^ int.from_bytes(rest, "little")) * _MUL)
    h = _signed((h ^ (h >> _SHIFT)) * _MUL)
    return _signed(h ^ (h >> _SHIFT))


@F.pandas_udf(T.LongType())
def murmur(text, seed):
    import pandas as pd

    return pd.Series([None if t is None else murmur64(t.encode(), int(s)) for t, s in zip(text, seed, strict=True)], dtype="Int64")
