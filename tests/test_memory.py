import tracemalloc

import numpy as np

from lexmill.functions import charset


def test_counting_pairs_takes_little_memory_and_counts_all():
    data = np.random.default_rng(3).integers(0, 256, 3_000_001, np.uint8).tobytes()
    tracemalloc.start()
    counts = charset.pair_counts(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10_000_000
    wide = np.frombuffer(data, np.uint8).astype(np.int64)
    assert (counts == np.bincount(wide[:-1] * 256 + wide[1:], minlength=65536)).all()
    assert charset.pair_counts(b"").sum() == charset.pair_counts(b"a").sum() == 0 and charset.pair_counts(b"ab")[ord("a") * 256 + ord("b")] == 1
