import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from cartoflux.llm.jaccard_join import _tile_pairs, signature

N, SIZE = 512, 4000


@pytest.mark.parametrize("forest", [True, False])
def test_a_tile_of_near_copies_takes_little_memory(forest):
    """Signatures are compared some bytes at a time, and of the pairs no more are held than join the components."""
    rng = np.random.default_rng(1)
    base, marks = rng.integers(0, 2**63, SIZE, dtype=np.uint64), []
    for _ in range(N):
        own = base.copy()
        own[rng.integers(0, SIZE, 50)] = rng.integers(0, 2**63, 50, dtype=np.uint64)
        marks.append(signature(np.unique(own)))
    ids = rng.permutation(10_000)[:N].astype(np.int64)
    columns = {"tile": np.ones(N, np.int64), "i": np.zeros(N, np.int32), "j": np.ones(N, np.int32), "m": ids, "own": np.arange(N, dtype=np.int32) % 2}
    table = pa.table(columns | {"c_m": ids, "n": np.full(N, SIZE), "mark": pa.array(marks, pa.binary())})
    tracemalloc.start()
    try:
        found = _tile_pairs(80, forest)(table)
        peak = tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()
    pairs = set(zip(found.column("a").to_pylist(), found.column("b").to_pylist(), strict=True))
    assert len(pairs) == len(found) == (N - 1 if forest else (N // 2) ** 2)
    assert all(a > b for a, b in pairs)
    assert peak < 20
