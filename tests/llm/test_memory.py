"""What a task of the training-data operators holds at a time."""

import tracemalloc

import numpy as np

from loomtext.llm.embedding_dedup import Codes, connect


def test_open_pairs_of_a_bucket_are_multiplied_in_parts():
    rng = np.random.default_rng(1)
    x = rng.normal(size=64) + rng.normal(size=(3000, 64)) * 0.23  # cosines of about 0.95, so that bounds decide little
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    bits, factor = Codes.of(x)
    tracemalloc.start()
    moved, to, seen = connect(x.astype("<f4"), bits, factor, 0.95)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen["exact"] > 500_000 and peak < 250 << 20  # their vectors together are 256 MB and more, twice
    label = np.arange(3000)
    label[moved] = to
    near = x.astype("<f4") @ x.astype("<f4").T >= 0.95
    assert all(len({*label[np.flatnonzero(row)]}) == 1 for row in near[::50])
