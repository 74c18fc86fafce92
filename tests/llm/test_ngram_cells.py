"""The bound on the intersection holds for sets of millions of shingles."""

import numpy as np

from tidemark.llm import common, ngram_join


def test_cells_bound_the_intersection_of_large_sets():
    h = np.sort(common.mix(np.arange(4_300_000, dtype=np.uint64)))
    other = h[:4_170_000]
    most = int(np.minimum(ngram_join.histogram(h), ngram_join.histogram(other)).sum(dtype=np.int64))
    assert most >= len(other) and ngram_join.linked(most, len(h), len(other), 85)
