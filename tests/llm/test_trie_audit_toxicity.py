"""The trie of conversations, the audit of filters and the toxicity model, against brute force."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest

from attest.llm import conversation_trie, filter_audit, toxicity

BIG = 1_152_921_504_606_846_977
SQL_DATA = "/root/testdata/sf0.001"


def conversations():
    r = random.Random(8)
    said = ["hi", "hello", "how are you", "", None, "é🙂 more", "bye", "x" * 5000]
    rows = []
    for c in [*range(0, 12), *range(95, 130), 250, 377, -7, BIG, BIG + 1, BIG + 2]:
        for t in range(r.randrange(1, 9)):
            rows.append((c, t if t else None, r.choice(["user", "assistant", None]) if t > 1 else "user", r.choice(said[:3] if t < 2 else said), "x"))
    rows += [rows[4], rows[4], (3, 2, "user", "tied"), (3, 2, "user", "also tied")]  # repeated and tied turns
    rows += [(None, 1, "user", "nobody's", "x"[:1])]
    return [(*x[:4], 7) for x in rows]


def brute_trie(turns, order):
    """order: how turns of one conversation are sorted."""
    convs = {}
    for c, t, role, text, _ in turns:
        if c is not None:
            convs.setdefault(c, []).append((t, role or "", text or ""))
    convs = {c: [x[1:] for x in sorted(v, key=order)] for c, v in convs.items()}
    paths = {}
    for c, own in convs.items():
        base = c - int(np.fmod(c, 100)) if abs(c) < 1 << 53 else c - c % 100
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = own if base == c else convs.get(base, [])[:h] + own[h:]
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(tuple(p[:d]), []).append(c)
    out = {}
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        leaves = [q for q in below if all(len(paths[c]) == len(q) for c in nodes[q])]
        ends = ",".join(map(str, sorted(c for c in members if len(paths[c]) == len(p))))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        out[min(members), len(p)] = (min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


@pytest.mark.parametrize("settings", [conversation_trie.Settings(), conversation_trie.Settings(13, (5, 7))])
def test_conversation_trie(spark, settings):
    from pyspark.sql import functions as F

    schema = "conv_id long, turn long, role string, text string, fp int"
    turns = spark.createDataFrame(conversations(), schema).repartition(3)
    if settings.prime < 100:  # colliding fingerprints take some rounds: fewer conversations
        turns = turns.where("conv_id < 12 or conv_id > 1000 or conv_id is null")
    rows = turns.collect()
    hashes = {tuple(r): r.h for r in turns.dropDuplicates().withColumn("h", F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))).select(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), "h").collect()}
    hashes = {k[:2]: h for k, h in hashes.items()}
    want = brute_trie([tuple(r) for r in rows], lambda x: (x[0] is not None, x[0] or 0, hashes[x[1:]]))
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in conversation_trie.prefix_trie(turns, conversation_trie.rebuilt(spark, turns), settings).collect()}
    assert got == want
    assert conversation_trie.prefix_trie(turns.limit(0)).count() == 0


def test_long_conversation_over_many_ranges(spark):
    """A conversation that goes over several ranges, and blocks, as one path."""
    n = 20_000
    turns = spark.createDataFrame([(1, i, "u", f"t{i}") for i in range(n)] + [(2, i, "u", f"t{i}") for i in range(9000)], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.depth): r for r in conversation_trie.prefix_trie(turns).collect()}
    assert len(got) == n + 1 and {c for c, _ in got} == {1}
    lengths = [len(f"t{i}") for i in range(9000)]
    for d in (0, 1, 4096, 8192, 8999, 9000, 9001, n):
        assert (got[1, d].n_convs, got[1, d].n_leaves, got[1, d].saved_tokens) == (2 if d <= 9000 else 1, 1, sum(lengths[max(0, d - 1) :]))


def brute_audit(docs, labels):
    first, marks = {}, {}
    for i, q, t in labels:
        g = marks.setdefault(i, [False, False])
        g[0] |= q == 1
        g[1] |= t == 1
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    out = {}
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {k for k, f in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t]), strict=True) if f}
        good, toxic = marks.get(i, (False, False)) if i is not None else (False, False)
        for p in permutations("ABCDE"):
            for k, f in enumerate(p):
                x = out.setdefault((lang or "", "".join(p), k + 1), [0] * 6)
                gone = bool(fails & set(p[:k]))
                hit = f in fails
                for at, c in enumerate((not hit and not gone, hit and not gone, hit and gone, fails == {f}, hit and not gone and good, hit and not gone and toxic)):
                    x[at] += c
    shapley = {}
    for (part, p, k), x in out.items():
        shapley[part, p[k - 1]] = shapley.get((part, p[k - 1]), 0) + x[1]
    return {key: (*x, shapley[key[0], key[1][key[2] - 1]]) for key, x in out.items()}


def test_filter_audit(spark):
    r = random.Random(2)
    many = " ".join(r.choice("abcdefgh") + str(r.randrange(150)) for _ in range(300))
    texts = ["", None, "short", many, many, many + " #", many.upper(), "a " * 250, "A " * 250, " \t\n", "é" * 100 + "ABC", "short"]
    docs = [(BIG + i if i % 2 else i, t, (None, "en", "de")[i % 3], i) for i, t in enumerate(texts)] + [(None, "short", "en", 1), (3, many, "en", 1), (3, many, "en", 1), (40, "x" * 100_000, "fr", 0)]
    labels = [(0, 1, 0), (3, None, 1), (3, 1, 0), (BIG + 5, 0, 1), (None, 1, 1), (99, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, fails int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in filter_audit.audit(d, lab).collect()}
    assert got == brute_audit([x[:3] for x in docs], labels)
    assert filter_audit.audit(d.limit(0), lab).count() == 0
    assert filter_audit.audit(d, lab.limit(0)).count() == 4 * 600
    assert len(filter_audit.orders()) == 600 and len({x[2:] for x in filter_audit.orders()}) == 80


@pytest.mark.parametrize("m", [conversation_trie, filter_audit])
def test_same_as_sql(spark, m):
    from pathlib import Path

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(SQL_DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    query = {conversation_trie: conversation_trie.op11_conversation_trie, filter_audit: filter_audit.op12_filter_audit}[m]
    got, want = query(spark, SQL_DATA), con.sql(m.SQL)
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(x[c] for c in columns) for x in got.collect()), key=str) == sorted((tuple(x[i] for i in at) for x in want.fetchall()), key=str)


def toxic_texts(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ta", "ne", "ri", "so", "mu", "lo"]) for _ in range(r.randrange(1, 4)))
    out = []
    for i in range(n):
        w = [word() for _ in range(r.randrange(20, 200))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(["Vile,", "grobben" + word(), "scorn."]))
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_toxicity(spark):
    rows = toxic_texts(1600, 1)
    d = spark.createDataFrame([(i, t, 5) for i, t, _ in rows] + [(9001, None, 5), (9002, "", 5), (9003, "12 !!", 5), (None, rows[0][1], 5), (9004, " ".join(t for _, t, x in rows if not x), 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows if i % 2] + [(i, x) for i, _, x in rows if i % 16 == 0] + [(None, 1), (0, 0), (77777, 1)], "doc_id long, toxic int")
    m = toxicity.fit(d.where("doc_id % 5 <> 0"), labels.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in toxicity.score(d, m).collect()}
    held = [(x, got[i].predicted) for i, _, x in rows if i % 5 == 0]
    assert sum(p for x, p in held if x) >= 0.95 * sum(x for x, _ in held)
    assert sum(p for x, p in held if not x) <= 0.02 * len(held)
    assert got[9001].score == got[9002].score == got[9003].score < 0.5 and got[9004].predicted == 0
    assert got[None].score == got[0].score and all(0 <= r.score <= 1 for r in got.values())
    for i, t, _ in rows[:40]:  # one by one as in any batch
        assert toxicity.predict([t], m)[0] == pytest.approx(got[i].score)
    none = toxicity.fit(d, labels.where("toxic = 0"))
    assert {(r.score, r.predicted) for r in toxicity.score(d, none).collect()} == {(0.0, 0)}
    assert toxicity.score(d.limit(0), m).count() == 0 and toxicity.fit(d.limit(0), labels).bias is None
    assert toxicity.score(d.withColumnRenamed("score", "predicted"), m).columns == ["doc_id", "text", "score", "predicted"]


def test_risk_does_not_go_below_zero():
    """With a prior that is too high the unlabelled texts' risk would be negative: weights stay bounded."""
    s = toxicity.Settings()
    p = (np.arange(10), np.zeros(10, np.int64), 10)
    u = (np.arange(2), np.zeros(2, np.int64), 100)
    w, b = toxicity._train(p, u, 1, 0.5, s)
    assert np.isfinite(w).all() and abs(b) < 30
