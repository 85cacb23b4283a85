"""Each operator against brute force, with null, empty, long, repeated and tied rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from attest.llm import contamination, jaccard, language, pieces, pii, quality, suffix_index, suffix_tree, tokens, warc  # noqa: E402
from attest.llm.shared import parts_of, shared_folder  # noqa: E402

WORDS = [a + b for a in ("th", "an", "on", "er", "re", "in") for b in ("ea", "o", "isk", "ou", "ten", "al")]
SCHEMA = "doc_id long, text string, lang string, n_windows int"


def texts():
    r = random.Random(11)
    make = lambda n: " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", "\n"]) for _ in range(n))
    base = [make(r.randrange(5, 160)) for _ in range(25)]
    near = [b.replace(b.split()[0], "Changed", 1) for b in base[:6]]
    long = make(4000)
    odd = ["", "one", "two words", " \t\n", "é中🙂 naïve  café", "line here.\nline here.\n" + base[0], "x" * 3000]
    return [*base, *base[:3], *near, *odd, long, long + " tail", None, None]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i * 3 + 1, t, ("en", "de", None)[i % 3], i) for i, t in enumerate(texts())], SCHEMA)


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def words(t):
    return (t or "").encode().lower().split()


def test_jaccard(docs, rows):
    for n, percent in ((3, 90), (5, 80)):
        sets = {k: {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if (w := words(t)) else set() for k, t in rows.items()}
        root = {k: k for k in sets}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    u, v = find(a), find(b)
                    root[max(u, v)] = min(u, v)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(docs, jaccard.Settings(n, percent)).collect()}
        assert got == {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize(("batches", "common"), [(1, 16_384), (5, 2)])
def test_suffix_index(docs, rows, batches, common):
    first, want = {}, {}
    for k in sorted(rows):
        b = (rows[k] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first.setdefault(b[i : i + 50], k) < k:
                gone[i : i + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want[k] = (len(b), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    got = {r.doc: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_index.deduplicate(docs, suffix_index.Settings(batches, 1000, common)).collect()}
    assert got == want


def test_quality(docs, rows):
    for r in quality.clean(docs).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", rows[r.doc_id] or "")
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        c = Counter(windows)
        repeated = {j for i, x in enumerate(windows) if c[x] > 1 for j in range(i, i + 8)}
        lines = [x for x in (rows[r.doc_id] or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(repeated), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 20 or 100 * len(repeated) > 30 * len(w))


def test_contamination(spark, docs, rows):
    texts_ = [t for t in rows.values() if t and len(t.split()) > 40]
    items = spark.createDataFrame([(0, " ".join(texts_[0].split()[5:30])), (1, " ".join("X" if i in (4, 17) else w for i, w in enumerate(texts_[1].split()[:26]))), (2, "none of these words is in there at all as you can see now my dear"), (3, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contamination.overlaps(docs, items).collect()}
    want = set()
    for k, t in rows.items():
        d = words(t)
        for i, x in ((r.item_id, words(r.text)) for r in items.collect()):
            size = min(13, len(x))
            if x and any(100 * sum(d[p + j] == x[s + j] for j in range(size) if 0 <= p + j < len(d)) >= 80 * size for s in range(len(x) - size + 1) for p in range(-size, len(d))):
                want.add((k, i))
    assert got == want and {i for _, i in got} == {0, 1}
    assert contamination.without_overlaps(docs, items).count() == len(rows) - len({k for k, _ in got})


def test_suffix_tree(docs, rows):
    from pyspark.sql import functions as F

    train = F.col("doc_id") % 2 == 1
    s = suffix_tree.Settings(2, 2.0, 3, 1)
    got = {r.doc_id: r for r in suffix_tree.score(docs, train, s).collect()}
    mine = [[*words(t), None] for k, t in rows.items() if k % 2 == 1]
    c = Counter(x for w in mine for x in w)
    n, v = sum(c.values()), len(c)
    follow = {}
    for w in mine:
        w = ["<s>", *w]
        for i in range(1, len(w)):
            for k in (1, 2):
                if i >= k:
                    follow.setdefault(tuple(w[i - k : i]), Counter())[w[i]] += 1
    kept = {}

    def p(context, x):
        if not context:
            return (c[x] + 1) / (n + v + 1)
        below = p(context[1:], x)
        if context not in kept:
            return below
        return (follow[context][x] + kept[context] * below) / (sum(follow[context].values()) + kept[context])

    for context, f in sorted(follow.items(), key=lambda y: len(y[0])):
        t = sum(f.values())
        rough = {x: 2 ** (-int(-np.log2(p(context[1:], x)) * 8) / 8) for x in f}
        bits = {w: sum(m * np.log2((m - 1 + w * rough[x]) / rough[x]) for x, m in f.items()) - t * np.log2(t - 1 + w) for w in suffix_tree.WEIGHTS}
        if t >= 3 and max(bits.values()) >= 2:
            kept[context] = max(bits, key=bits.get)
    assert {len(x) for x in kept} == {1, 2}
    for k, t in rows.items():
        w = ["<s>", *words(t), None]
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(w) - 1, sum(x in c for x in w[1:]), n)
        assert got[k].base_score == pytest.approx(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w[1:]))
        assert got[k].score == pytest.approx(sum(np.log10(p(tuple(w[max(0, i - 2) : i]), w[i])) for i in range(1, len(w))))


def test_suffix_tree_beats_its_base(spark):
    got = suffix_tree.op5_suffix_tree(spark, "/root/testdata/sf0.01").where("held_out").groupBy().sum("score", "base_score").first()
    assert got[0] > got[1]


def test_pieces(spark, docs, rows):
    v = pieces.Vocabulary.of(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = pieces.encode(docs, v)
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    known = {p: (i, s) for p, i, s in v.pieces}
    unknown = min(s for _, s in known.values()) - pieces.PENALTY

    def best(t):
        t = "▁" + t.replace(" ", "▁")
        at = [(0.0, 0, [])] + [None] * len(t)
        for z in range(1, len(t) + 1):
            for a in range(max(0, z - 16), z):
                p = t[a:z]
                if p in known or z - a == 1:
                    i, s = known.get(p, (None, unknown))
                    if at[z] is None or at[a][0] + s > at[z][0]:
                        at[z] = (at[a][0] + s, a, [i] if i is not None else [v.byte_ids[b] for b in p.encode()])
        out, z = [], len(t)
        while z:
            out, z = at[z][2] + out, at[z][1]
        return out

    for k, t in rows.items():
        assert got[k] == (best(t) if t else [])
    back = {r.doc_id: r.text for r in pieces.decode(encoded, v).collect()}
    assert back == {k: t or "" for k, t in rows.items()}


def test_token_files(spark, docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, start = Tokenizer.from_file(path), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.read(tokens.write(docs, shared_folder(spark), path)).collect()}
    for k in sorted(rows):
        ids = [*t.encode(rows[k] or "", add_special_tokens=False).ids, 1]
        assert got[k] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_blocks():
    r = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 4096):
        for top in (1, 2, 1000, 1 << 31):
            x = r.integers(0, top, n).astype(np.uint32)
            assert (tokens.block_ids(tokens.block_bytes(x))[0] == x).all()


def test_warc(spark):
    big = "<p>é" + "x" * 1200
    pages = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, None), (4, "http://a/4", "short"), (5, "u", "short"), (6, "http://a b/", big + "\r\n\r\nWARC/1.1\r\n")]
    folder = shared_folder(spark)
    d = spark.createDataFrame([(i, u, h, "x") for i, u, h in pages], "page_id long, url string, html string, digest string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(warc.normalise(warc.write_archives(d, f"{folder}/raw"), f"{folder}/members")).collect()}
    for i, _, h in pages:
        b = (h or "").encode()
        assert got[i] == (len(b), hashlib.sha1(b).hexdigest(), "revisit" if i == 1 else "response", 2 if i == 1 else None)


def test_pii_base():
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    r = random.Random(3)
    for _ in range(20000):
        t = "".join(r.choice("ab@@..-+ 0123456()%é\n") for _ in range(r.randrange(60)))
        want = []
        for k, p in enumerate(patterns):
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m.group())
                if (k == 0, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), k == 2 and 14 <= len(d) <= 19 and pii.luhn(d), k == 3 and 10 <= len(d) <= 15)[k]:
                    want.append((m.start(), m.end(), k))
        assert pii.base_spans(t) == sorted(want, key=lambda s: (s[0], s[2]))


def test_pii_field(spark):
    d = spark.createDataFrame([(1, "call (212) 555-0188 or mail a.b@c.example."), (2, None), (3, ""), (4, "plain text"), (5, "4111 1111 1111 1112 no card")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.mask(d).collect()}
    assert got == {1: "call [PHONE] or mail [EMAIL].", 2: None, 3: "", 4: "plain text", 5: "4111 1111 1111 1112 no card"}


def test_language(spark):
    r = random.Random(1)
    stems = {"en": ["the", "and", "ing", "tion"], "de": ["der", "ung", "sch", "und"], "fr": ["eau", "les", "ment", "que"]}
    rows_ = [(i, " ".join("".join(r.choice(stems[l]) for _ in range(2)) for _ in range(30)), l) for i in range(150) for l in [("en", "de", "fr")[i % 3]]]
    d = spark.createDataFrame([*rows_, (1000, None, None), (1001, "12 !!", None)], "doc_id long, text string, lang string")
    m = language.fit(d.where("doc_id % 2 = 0"), "text", "lang", "doc_id")
    got = {x.doc_id: x for x in language.identify(d, m).collect()}
    assert all(got[i].lang_pred == l and not got[i].rejected for i, _, l in rows_)
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (1000, 1001))


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert jaccard.link_components(none).count() == 0
    assert suffix_index.deduplicate(none).count() == 0
    assert quality.clean(none).count() == 0
    assert pii.find_spans(none).count() == 0
    assert suffix_tree.score(none, none["doc_id"] > 0).count() == 0
    assert language.identify(none, language.fit(none, "text", "lang", "doc_id")).count() == 0
    assert pieces.encode(none, pieces.Vocabulary.of(public_tokenizers.path("piece_bpe_32k.model"))).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert contamination.overlaps(none, items).count() == 0 and contamination.overlaps(docs, items).count() == 0
    assert contamination.without_overlaps(docs, items).count() == docs.count()
    folder = shared_folder(spark)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.normalise(warc.write_archives(pages, f"{folder}/raw"), f"{folder}/members")).count() == 0
    assert tokens.read(tokens.write(none, f"{folder}/ids", public_tokenizers.path("word_bpe_49k.json"))).count() == 0


def test_parts_do_not_depend_on_splits(spark, docs):
    folder = shared_folder(spark)
    docs.repartition(3).write.parquet(f"{folder}/t")
    read = lambda: {(r.doc_id, r["__part"]) for r in parts_of(spark.read.parquet(f"{folder}/t"), 4).select("doc_id", "__part").collect()}
    before = read()
    assert len({p for _, p in before}) > 6
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert read() == before
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    joined = spark.read.parquet(f"{folder}/t").join(spark.read.parquet(f"{folder}/t").select("doc_id"), "doc_id")
    assert parts_of(joined, 4).count() == before.__len__()
    assert parts_of(spark.read.parquet(f"{folder}/t").dropDuplicates(["doc_id"]), 4).select("__part").distinct().count() > 1


def test_missing_part_is_an_error(spark):
    folder = shared_folder(spark)
    spark.range(1).write.parquet(f"{folder}/level0")
    for read in (lambda: suffix_tree._Words(folder.removeprefix("file://"), 5), lambda: jaccard._Levels(f"{folder}/level0", 5, 8)):
        with pytest.raises(ValueError, match="came back"):
            read()


def test_joined_and_repeated_tables(spark, docs):
    """Operators that keep parts, over a table that is no plain scan."""
    joined = docs.join(docs.select("doc_id").distinct(), "doc_id")
    v = pieces.Vocabulary.of(public_tokenizers.path("piece_bpe_32k.model"))
    assert pieces.encode(joined, v).count() == docs.count()
    assert suffix_tree.score(joined.dropDuplicates(["doc_id"]), joined["doc_id"] > 0).count() == docs.count()


def test_clashing_names(spark):
    """Columns of the operators' own names in the input."""
    d = spark.createDataFrame([(1, "some words of a text here", "en", 5, 6, "x", 7, 8), (2, "some words of a text here", "en", 5, 6, "x", 7, 8)], "doc_id long, text string, lang string, part int, ids int, unit string, score int, n int")
    v = pieces.Vocabulary.of(public_tokenizers.path("piece_bpe_32k.model"))
    assert {(r.part, r.unit) for r in pieces.encode(d, v).collect()} == {(5, "x")}
    assert {r.component_id for r in jaccard.link_components(d).collect()} == {1}
    assert [r.doc_id for r in jaccard.without_near_copies(d).collect()] == [1]
    assert suffix_tree.score(d, d["doc_id"] > 0).count() == 2
    assert suffix_index.deduplicate(d).count() == 2
    assert language.identify(d, language.fit(d, "text", "lang", "doc_id")).columns.count("score") == 1
    assert contamination.overlaps(d, spark.createDataFrame([(9, "some words of a text here", 1)], "item_id long, text string, h int")).count() == 2


def test_null_and_repeated_ids(spark):
    """Near copies: rows without an id stay; differing texts of one id stay; equal rows are one."""
    t = "a b c d e f g h i j k l m n o p"
    d = spark.createDataFrame([(1, t), (2, t), (None, t), (None, t + " q"), (3, "x y z w v u"), (3, "other words are in this one"), (3, "x y z w v u")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.text) for r in jaccard.without_near_copies(d).collect()))
    assert got == sorted([(1, t), (0, t), (0, t + " q"), (3, "x y z w v u"), (3, "other words are in this one")])


def test_components(spark):
    from attest.llm.components import components

    edges = spark.createDataFrame([(5, 3), (3, 9), (9, 3), (4, 4), (7, 8), (1, 9)], "a long, b long")
    assert {r.node: r.component for r in components(edges).collect()} == {5: 1, 3: 1, 9: 1, 1: 1, 7: 7, 8: 7}
    assert components(edges.limit(0)).count() == 0


def test_long_zeros_in_an_address():
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(0, 5006, 1)]


def test_added_spans_are_recalled():
    """Held-out sentences of the forms that the patterns miss: local numbers and secrets."""
    r, found, wrong, total = random.Random(4), 0, 0, 0
    digit = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    for _ in range(300):
        kind = r.choice(["phone", "secret", "none"])
        middle = {"phone": f"({digit(3)}) {digit(3)}-{digit(4)}", "secret": '"' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"', "none": f"{digit(2)} and {digit(3)}"}[kind]
        text = f"{r.choice(['call', 'then', 'with', 'see'])} {middle} {r.choice(['today', 'please', 'or later'])} and go on"
        base, spans = pii.all_spans([text])[0]
        added = [s for s in spans if s not in base]
        if kind == "none":
            wrong += bool(added)
        else:
            total += 1
            found += any(pii.ALL_KINDS[k] == kind and text[a:z].strip('"') == middle.strip('"') for a, z, k in added)
    assert found >= 0.9 * total and wrong == 0


def test_many_short_texts_and_other_letters(spark):
    d = spark.createDataFrame([(i, None if i % 2 else "the thing", "en") for i in range(3000)] + [(5000, "½ ² 12", "en")], "doc_id long, text string, lang string")
    m = language.fit(d, "text", "lang", "doc_id")
    got = {r.doc_id: r.lang_pred for r in language.identify(d, m).collect()}
    assert got[5000] == "und" and got[1] == "und" and got[0] == "en"
    with pytest.raises(ValueError, match="no languages"):
        language.fit(d.withColumn("lang", d["doc_id"].cast("string")), "text", "lang", "doc_id", language.Settings(most_labels=100))


def test_needed_pieces_give_the_same_paths():
    """Leaving pieces out that no best path uses changes no path."""
    r = random.Random(6)
    pieces_ = [(c, i, -1.0 - i) for i, c in enumerate("abc")] + [(w, 10 + i, -r.random() * 6) for i, w in enumerate({"".join(r.choice("abc") for _ in range(r.randrange(2, 5))) for _ in range(30)})]

    def best(text, table):
        scores, at = {p: x for p, _, x in table}, [0.0] + [None] * len(text)
        for z in range(1, len(text) + 1):
            at[z] = max(at[a] + scores[text[a:z]] for a in range(z) if text[a:z] in scores)
        return at[-1]

    fewer = pieces._needed(pieces_)
    assert len(fewer) < len(pieces_)
    for _ in range(300):
        t = "".join(r.choice("abc") for _ in range(r.randrange(1, 12)))
        assert best(t, fewer) == pytest.approx(best(t, pieces_))


def test_symbols_and_verdicts(spark):
    good = "This is a good sentence with some words in it.\nHere is another one that ends well.\nAnd a third line of real text goes here."
    nav = "\n".join(["Home", "About", "Menu", "Contact", "Search here", "Log in"] * 4)
    d = spark.createDataFrame([(1, good), (2, good + "\n" + nav), (3, "a # b * c $ % & | < > d"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.clean(d).collect()}
    assert (got[1].n_symbols, got[3].n_symbols, got[4].n_symbols) == (0, 8, 0)
    assert (got[1].kept, got[2].kept, got[4].kept) == (True, False, False)
    assert got[2].clean_text == good
