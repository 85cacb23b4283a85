"""What a task sends of a part's n-grams goes in slices, so that none of it is held whole beside the n-grams."""

import numpy as np
import pandas as pd

from attest.llm import jaccard
from attest.llm.shared import block_hashes


class _Frames:
    """Stands for a table: gives the function that a task runs."""

    def mapInPandas(self, run, schema):
        return run


def test_counts_are_asked_for_in_slices(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64)) for _ in range(20)]
    sets += sets[:5]
    monkeypatch.setattr(jaccard, "_chosen_sets", lambda frames, folder, words: ((7, i, g) for i, g in enumerate(sets)))
    got = list(jaccard.asked_counts(_Frames(), "", jaccard.Settings(), 8)(iter(())))
    size = [sum(map(len, f["keys"])) for f in got]
    assert max(size) * 8 < sum(size)
    every = pd.concat(got)
    u, n = np.unique(np.concatenate(sets), return_counts=True)
    assert (every["part"] == 7).all() and every["bucket"].is_unique
    assert np.array_equal(np.concatenate([np.frombuffer(x, np.uint16) for x in every["n"]]), n)
    assert np.array_equal(block_hashes(every["bucket"].to_numpy(), every["keys"]), u >> np.uint64(24))
