"""Merging sorted n-gram lists by one number each."""

import numpy as np
import pytest

from regmesh.llm import lm_scoring


@pytest.mark.parametrize("ids", [50, 1 << 40])          # the second: three ids do not fit 63 bits
@pytest.mark.parametrize("width", [2, 3])
def test_union_equals_a_plain_set(ids, width):
    rng = np.random.default_rng(ids % 97 + width)
    lists = []
    for _ in range(5):
        grams = sorted({tuple(int(x) for x in rng.integers(ids - 6, ids, width)) for _ in range(60)})
        lists.append([np.array(c, np.int64) for c in zip(*grams)])
    cols, at = lm_scoring.union(lists)
    want = sorted({g for x in lists for g in zip(*(c.tolist() for c in x))})
    assert list(zip(*(c.tolist() for c in cols))) == want
    assert all([want[i] for i in a] == list(zip(*(c.tolist() for c in x))) for a, x in zip(at, lists))
    assert np.all(np.diff(lm_scoring.sort_key(cols)) > 0)
