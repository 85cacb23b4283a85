"""Items under 13 words against brute force."""

from itertools import combinations

from attest.llm import contamination


def test_every_allowed_pattern(spark):
    items = {m: [f"i{m}w{j}" for j in range(m)] for m in range(1, 13)}
    texts = []
    for m, x in items.items():
        for k in range(m // 5 + 2):
            for off in list(combinations(range(m), k))[:: 1 if k <= m // 5 else 7]:
                texts.append(["a", "b", *["X" if j in off else w for j, w in enumerate(x)], "c"])
        texts += [x, x[1:], x[:-1], x[2:], []]
    want = set()
    for d, t in enumerate(texts):
        for m, x in items.items():
            if any(100 * sum(t[p + j] == x[j] for j in range(m) if 0 <= p + j < len(t)) >= 80 * m for p in range(-m, len(t))):
                want.add((d, m))
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)] + [(-1, None)], "doc_id long, text string")
    test = spark.createDataFrame([(m, " ".join(x)) for m, x in items.items()] + [(0, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contamination.overlaps(docs, test).collect()} == want
