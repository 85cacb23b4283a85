"""A large group of near copies beside sets that just miss it: pairs don't grow with its square."""

import random

from attest.llm import jaccard


def shingles(text: str, n: int) -> set:
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_pairs_of_a_group(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]

    def edited(edits: int) -> str:
        w = list(base)
        for i in rng.sample(range(2, 148), edits):
            w[i] = f"x{rng.randrange(30)}"
        return " ".join(w)

    texts = [edited(1 + i % 2) for i in range(150)] + [edited(5) for _ in range(100)]
    docs, s = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), jaccard.Settings(5, 80)
    counts, plain = [], jaccard._filtered
    monkeypatch.setattr(jaccard, "_filtered", lambda pairs, *rest: (counts.append(pairs.count()), plain(pairs, *rest))[1])
    got = {r.doc_id: r.component_id for r in jaccard.link_components(docs, s).collect()}

    sets, root = [shingles(t, 5) for t in texts], list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common) and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    assert got == dict(enumerate(root)) and len(set(root)) > 20
    assert len(counts) == 2 and counts[1] < 200, counts
