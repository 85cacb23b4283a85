"""The pipeline's stages, each against brute force over whole small tables."""

import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline as cp  # noqa: E402
from attest.llm import contamination, pieces, pii  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(900001, None, None, "s", None), (900002, "", "en", "s", 0), (None, "words without an id stay in here for good", "en", "s", 41), (900003, "12 34 !!", None, "s", 8)], d.schema)
    return d.unionByName(odd).persist()


def words(t):
    return (t or "").encode().lower().split()


def test_names_and_columns(spark, docs):
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_copies", "decontamination", "pii", "sentencepiece"]
    none = docs.limit(0)
    for _, stage in cp.STAGES[:-1]:
        got = stage(spark, none, DATA)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes and got.count() == 0
    assert cp.encoded(spark, none, DATA).count() == 0


def test_language(spark, docs):
    got = {r.doc_id for r in cp.known_language(spark, docs, DATA).collect()}
    assert not got & {900001, 900002, 900003}
    named = {r.doc_id for r in docs.where("lang is not null and length(text) > 200").collect()}
    assert len(named - got) <= 0.02 * len(named)


def test_near_copies(spark, docs):
    rows = docs.collect()
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(r.text)) else set() for r in rows if r.doc_id is not None}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    got = [r.doc_id for r in cp.one_of_near_copies(spark, docs, DATA).collect()]
    assert sorted(x for x in got if x is not None) == sorted(k for k in sets if find(k) == k)
    assert got.count(None) == 1


def test_decontamination(spark, docs):
    items = [words(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    size = contamination.WINDOW
    index = {}
    for x in items:
        for s in range(len(x) - size + 1):
            for j in range(size):
                index.setdefault(x[s + j], set()).add((id(x), s, j))
    by_id = {id(x): x for x in items}
    want = set()
    for r in docs.collect():
        d, hits = words(r.text), {}
        for p, w in enumerate(d):
            for i, s, j in index.get(w, ()):
                hits[i, s, p - j] = hits.get((i, s, p - j), 0) + 1
        if any(n * 100 >= 80 * size for n in hits.values()) or any(len(x) < size for x in by_id.values()):
            want.add(r.doc_id)
    got = {r.doc_id for r in cp.without_benchmark(spark, docs, DATA).collect()}
    assert got == {r.doc_id for r in docs.collect()} - want


def test_personal_data(spark, docs):
    before = {r.doc_id: r for r in docs.collect()}
    for r in cp.without_personal_data(spark, docs, DATA).collect():
        t = before[r.doc_id].text
        if t is None:
            assert r.text is None and r.n_chars is None
            continue
        base, spans = pii.all_spans([t])[0]
        assert r.n_chars == len(r.text) and (r.text == t) == (not spans)
        assert not pii.base_spans(r.text)
        assert len(re.findall(r"\[(?:EMAIL|IP|CARD|PHONE|SECRET)\]", r.text)) >= len(spans) - len(re.findall(r"\[(?:EMAIL|IP|CARD|PHONE|SECRET)\]", t)) - 1 or not spans


def test_encoded(spark, docs):
    v = pieces.Vocabulary.of(public_tokenizers.path("piece_bpe_32k.model"))
    ids = {r.doc_id: list(r.ids) for r in pieces.encode(docs, v).collect()}
    for r in cp.encoded(spark, docs, DATA).collect():
        assert r.n_pieces == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()) and r.round_trip


def test_whole_run(spark):
    got = cp.run(spark, DATA)
    assert got.count() > 0 and got.where("not round_trip").count() == 0
