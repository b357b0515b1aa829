import numpy as np
import pytest

from lodemap.operators import graph


@pytest.mark.parametrize("size", [750, 751])
def test_unconnected_groups_within_the_least_share_stay_together(size):
    """Four groups without an edge between them, in 3,000 and in 3,004 points: the first cut leaves parts of at most 90 %."""
    w = np.kron(np.eye(4), np.ones((size, size)))
    labels = graph.recursive_cut(w, 0.075, least_share=0.9)
    assert len(set(labels.tolist())) == 2
    assert all(len(set(labels[g * size : (g + 1) * size].tolist())) == 1 for g in range(4))
