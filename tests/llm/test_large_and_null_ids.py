"""Ids beyond 2**53, beside rows without one, through every operator that carries them."""

import hashlib
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from attest.llm import contamination, jaccard, language, pieces, pii, quality, suffix_index, suffix_tree, tokens, warc  # noqa: E402
from attest.llm.shared import shared_folder  # noqa: E402

BIG = 1_152_921_504_606_846_976
IDS = [BIG + 1, BIG + 3, None, BIG + 5, None, BIG + 9, BIG + 2]
COPY = "one two three four five six seven eight nine ten eleven twelve thirteen"
TEXTS = [COPY, "mail a.b@c.example now", COPY, COPY, None, "other words with nothing of the kind in them", ""]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", n) for i, t, n in zip(IDS, TEXTS, [None, *range(6)], strict=True)], "doc_id long, text string, lang string, other long").coalesce(1)


def order(x):
    return (x is not None, x or 0)


def test_ids_come_back(spark, docs):
    want = sorted(IDS, key=order)
    v = pieces.Vocabulary.of(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = pieces.encode(docs, v)
    results = {
        "pieces": encoded,
        "decoded": pieces.decode(encoded, v),
        "digest": pieces.encoded_digest(docs, v),
        "pii": pii.find_spans(docs),
        "masked": pii.mask(docs),
        "language": language.identify(docs, language.fit(docs, "text", "lang", "doc_id")),
        "suffix_tree": suffix_tree.score(docs, docs["doc_id"] % 2 == 1),
        "tokens": tokens.read(tokens.write(docs, shared_folder(spark), public_tokenizers.path("word_bpe_49k.json"))),
        "jaccard": jaccard.link_components(docs),
        "quality": quality.clean(docs),
    }
    for name, got in results.items():
        assert sorted((r.doc_id for r in got.collect()), key=order) == want, name
    assert sorted((r.doc for r in suffix_index.deduplicate(docs).collect()), key=order) == want
    for name in ("pieces", "masked", "language"):  # carried columns too
        assert sorted((r.other for r in results[name].collect()), key=order) == [None, *range(6)], name


def test_copies_of_large_ids(spark, docs):
    got = {(r.doc_id, r.component_id) for r in jaccard.link_components(docs).collect() if r.doc_id is not None}
    assert got == {(i, BIG + 1 if i == BIG + 5 else i) for i in IDS if i is not None}
    kept = sorted((r.doc_id for r in jaccard.without_near_copies(docs).collect()), key=order)
    assert kept == sorted((i for i in IDS if i != BIG + 5), key=order)
    items = spark.createDataFrame([(BIG + 7, COPY), (None, "none of these words")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contamination.overlaps(docs, items).collect()} >= {(BIG + 1, BIG + 7), (BIG + 5, BIG + 7)}


def test_token_file_order(spark, docs):
    from tokenizers import Tokenizer

    path, start = public_tokenizers.path("word_bpe_49k.json"), 0
    t = Tokenizer.from_file(path)
    got = sorted((order(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in tokens.read(tokens.write(docs, shared_folder(spark), path)).collect())
    for (i, text), x in zip(sorted(zip(IDS, TEXTS, strict=True), key=lambda p: (order(p[0]), p[1] is not None, p[1] or "")), got, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert x == (order(i), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_warc_without_ids(spark):
    big, bigger = "<p>" + "x" * 1200, "<p>" + "y" * 1200
    pages = [(BIG + 1, big), (BIG + 3, big), (None, big), (None, bigger), (None, None), (BIG + 2, "short")]
    folder = shared_folder(spark)
    d = spark.createDataFrame([(i, "http://a/", h) for i, h in pages], "page_id long, url string, html string")
    got = sorted((order(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.read_records(warc.normalise(warc.write_archives(d, f"{folder}/raw"), f"{folder}/members")).collect())
    want = []
    for i, h in pages:
        b = (h or "").encode()
        again = h == big and i != BIG + 3
        want.append((order(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", BIG + 3 if again else 0))
    assert got == sorted(want)


def plain_vector(text, m):
    """The n-gram weights of one text, byte by byte."""
    s, b = m.settings, [int(language._FOLD[x]) for x in text.encode() + b"\n"]
    counts = np.zeros(s.dimensions)
    for size in s.sizes:
        for i in range(len(b) - size + 1):
            code = 0
            for x in b[i : i + size]:
                code = code * 257 + x
            code = (code + size) * 2654435761 % (1 << 32)
            counts[(code >> 15) % s.dimensions] += 1
    v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * m.weights
    return v / max(np.sqrt((v * v).sum()), 1e-12)


def test_language_text_by_text(spark):
    """Scores are those of each text alone, whatever texts are in its batch."""
    r = random.Random(5)
    stems = {"en": ["the", "and", "ing"], "de": ["der", "ung", "sch"]}
    rows = [(i, " ".join("".join(r.choice(stems[x]) for _ in range(2)) for _ in range(r.randrange(1, 9))), x) for i in range(60) for x in [("en", "de")[i % 2]]]
    rows += [(100, "ho", None), (101, "a", None), (102, "Xé", None), (103, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language.fit(d, "text", "lang", "doc_id")
    for shuffled in (d, d.orderBy(d["doc_id"].desc()), d.repartition(5)):
        for x in language.identify(shuffled, m).collect():
            cosine = m.centroids @ plain_vector(x.text, m)
            if any(map(str.isalpha, x.text)):
                assert x.score == pytest.approx(min(1, max(0, cosine.max())), abs=1e-5)
                assert np.isclose(cosine[[i for i, n in enumerate(m.languages) if n == x.lang_pred]].max(), cosine.max(), atol=1e-6)
            else:
                assert (x.lang_pred, x.score) == ("und", 0.0)
