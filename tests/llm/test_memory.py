"""What kernels of the corpus operators hold at a time, and signatures of sets."""

import tracemalloc

import numpy as np
import pyarrow as pa

from shoalmark.llm import jaccard_join as J, quality
from shoalmark.llm.text import shingles


def _peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_shingles_hold_little():
    column = pa.array(["".join(f"w{i % 977}x{k} " for i in range(400)) for k in range(1500)])  # some 4 MB
    assert _peak(lambda: [None for s in shingles(column, 5) if not len(s)]) < 40


def test_word_cache_is_small():
    features = quality.Features()

    def work():
        for k in range(40):
            features.of([" ".join(f"word{k}x{i}" for i in range(10_000))], [1])
    assert _peak(work) < 40


def test_signatures_drop_unlinked_pairs_alone(spark):
    rng = np.random.default_rng(2)
    sets, pairs = {}, []
    for k in range(300):
        n = int(rng.integers(1, 600))
        s = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        other = s.copy()
        change = rng.random(n) < rng.choice([0.0, 0.05, 0.1, 0.12, 0.5, 0.9])
        other[change] = rng.integers(0, 1 << 63, int(change.sum()), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        sets[2 * k], sets[2 * k + 1] = np.unique(s), np.unique(other)
        pairs.append((2 * k, 2 * k + 1))
    signs = spark.createDataFrame([(k, len(s), J.signature(s).tolist()) for k, s in sets.items()], "rep long, n long, sign array<long>")
    kept = {tuple(r) for r in J._sign_check(spark.createDataFrame(pairs, "a long, b long"), signs, 8, 10).collect()}
    share = {}
    for a, b in pairs:
        i = len(np.intersect1d(sets[a], sets[b]))
        share[a, b] = i / (len(sets[a]) + len(sets[b]) - i)
    assert kept >= {p for p, x in share.items() if x >= 0.8}
    assert not [p for p in kept if share[p] < 0.6 and len(sets[p[0]]) > 20]
