"""Units are cut and told apart by numpy, each is sent once a part, and a worker holds hashes of them, not strings."""

import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from attest.llm import pieces


@pytest.mark.parametrize("units", [pieces.FINE, pieces.COARSE])
@pytest.mark.parametrize("most", [7, 1_000_000])
def test_units_are_those_of_the_pattern(units, most, monkeypatch):
    monkeypatch.setattr(pieces, "_RUN", most)
    r = random.Random(3)
    texts = ["".join(r.choice("aZ  ▁é÷×ɏɐḀỿἀ1.\n\t\0\U0001f600") for _ in range(r.randrange(40))) for _ in range(400)] + ["", None, " ", "   ", "b" * 5000]
    got, hashes = [[] for _ in texts], {}
    for run in pieces._runs(texts, pieces.kinds_of(units)):
        spelled = run.spelled(np.arange(len(run.starts)))
        for i, a, z in zip(run.of, [0, *run.ends], run.ends):
            got[i] += spelled[a:z]
        for u, h in zip(spelled, run.hashes.tolist()):
            assert hashes.setdefault(u, h) == h
    assert len(set(hashes.values())) == len(hashes)
    assert got == [re.findall(units, "▁" + t.replace(" ", "▁")) if t else [] for t in texts]


def test_units_are_sent_once_and_not_held():
    n = 400_000
    words = [f"{x:x}".translate(str.maketrans("0123456789", "ghijklmnop")) for x in range(n, 2 * n)]
    frames = [pd.DataFrame({"__part": np.full(8, 5), "t": [" ".join(words[i + j : i + j + 1000]) for j in range(0, 8000, 1000)]}) for _ in range(2) for i in range(0, n, 8000)]
    sent = held = 0
    tracemalloc.start()
    for frame in pieces.gathered(iter(frames), pieces.FINE):
        sent += len(frame)
        del frame
        held = max(held, tracemalloc.get_traced_memory()[0])
    tracemalloc.stop()
    assert sent == n  # the sets of strings were sent and begun anew at 300,000
    assert held < 25e6
