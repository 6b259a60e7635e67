import tracemalloc

import numpy as np
import pyarrow as pa

from mailspan.llm import jaccard


def test_a_bucket_of_keys_meets_in_bounded_memory():
    rng = np.random.default_rng(5)
    n = 1_000_000
    names, counts = np.arange(n // 10, dtype=np.int64), np.full(n // 10, 10, np.uint32)
    keys = rng.integers(0, n, n).astype(np.uint64) << np.uint64(1)
    five = keys.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    cells = pa.table({"bucket": [0], "keys": pa.array([five], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()), "names": pa.array([names.tobytes()], pa.binary())})
    tracemalloc.start()
    got = jaccard.meet(cells)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    wide = jaccard.stars(keys | np.uint64(1 << 60), np.repeat(names.astype(np.int32), 10), len(names))
    assert list(zip(got["src"].to_pylist(), got["dst"].to_pylist(), strict=True)) == list(zip(*(w.tolist() for w in wide), strict=True))
    assert peak < 60 * n
