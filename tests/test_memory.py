"""Memory of the kernels, which a worker needs once per core."""

import tracemalloc

import numpy as np

from nearfield.operators.blocks import L2, TopK


def test_copies_take_no_more_memory_than_a_distance_matrix():
    """Where all rows are as near, all of them are preselected."""
    x = np.ones((9000, 4))
    tracemalloc.start()
    top = TopK(L2(), np.arange(1024), x[:1024], 3)
    top.add(np.arange(9000), x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 << 20
    assert (top.ids == [0, 1, 2]).all()
