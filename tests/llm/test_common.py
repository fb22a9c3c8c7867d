import numpy as np
import pyarrow as pa
import pytest

from quillon.llm.common import by_bytes, joined, parts_of


def test_slices_of_bounded_bytes():
    texts = [None, "a" * 10, "b" * 95, "", "c" * 300, "d" * 50, "e" * 50, "f", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], names=["k", "t"])
    parts = list(parts_of(batch, 1, most=100))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [2, 3], [4], [5, 6], [7, 8]]
    assert [len(p) for p in parts_of(batch, 1)] == [9]
    assert [len(p) for p in parts_of(batch.slice(0, 0), 1, most=1)] == [0]
    seen = by_bytes(1, 100)(lambda batches: (b.num_rows for b in batches))
    assert list(seen([batch, batch])) == [2, 2, 1, 2, 2] * 2


@pytest.mark.parametrize("seed", range(20))
def test_joined(seed):
    """The pairs join what the links join, and nothing else."""
    rng = np.random.default_rng(seed)
    left, right = rng.integers(0, 30, 12), rng.integers(0, 30, 17)
    linked = rng.random((12, 17)) < rng.choice([0, 0.03, 0.1, 0.5])

    def components(pairs):
        of = {int(v): {int(v)} for v in [*left, *right]}
        for a, b in pairs:
            both = of[int(a)] | of[int(b)]
            for v in both:
                of[v] = both
        return of

    got = list(zip(*joined(linked, left, right)))
    assert components(got) == components((left[i], right[j]) for i, j in zip(*np.nonzero(linked))) and len(got) <= 29


def test_joined_chain():
    n = 600  # a chain takes few passes, and a clique's links aren't walked
    chain = np.eye(n, k=1, dtype=bool)
    ids = np.arange(n)
    a, b = joined(chain, ids, ids)
    assert len(a) == n - 1 and (b == 0).all() and len(joined(np.ones((2000, 2000), bool), np.arange(2000), np.arange(2000))[0]) == 1999
