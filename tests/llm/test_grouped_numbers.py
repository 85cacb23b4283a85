"""Numbers are grouped and looked up without argsorts, and lookups of longer contexts are found once for each part."""

import numpy as np
import pytest

from attest.llm.shared import grouped, near_order, places


@pytest.mark.parametrize("top", [1, 2, 1 << 20, 1 << 53, 1 << 64])
@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_as_numpy_groups_them(top, n):
    x = np.random.default_rng(n).integers(0, top, n, np.uint64, endpoint=False) if n else np.zeros(0, np.uint64)
    x[n // 2 :] = x[: n - n // 2]
    u, inverse = np.unique(x, return_inverse=True)
    one, of = grouped(x)
    assert np.array_equal(x[one], u) and np.array_equal(of, inverse)
    assert np.array_equal(np.sort(near_order(x)), np.arange(n))


def test_numbers_that_differ_in_their_last_bits_are_grouped():
    """As pairs of a context's number and a word: near_order() leaves some out of order."""
    r = np.random.default_rng(6)
    x = (r.integers(0, 1 << 20, 300_000).astype(np.uint64) // np.uint64(1000) << np.uint64(44)) | r.integers(0, 1 << 18, 300_000).astype(np.uint64)
    x[5000:9000] = x[:4000]
    near = x[near_order(x)]
    assert (near[1:] < near[:-1]).any()
    u, inverse = np.unique(x, return_inverse=True)
    last = np.zeros(len(u), np.int64)
    np.maximum.at(last, inverse, np.arange(len(x)))
    one, of = grouped(x)
    assert np.array_equal(one, last) and np.array_equal(of, inverse)


def test_few_lookups_where_few_numbers_are_out_of_order(monkeypatch):
    x = np.random.default_rng(7).integers(0, 1 << 63, 100_000).astype(np.uint64)
    x[1], x[3], x[0] = x[0] + np.uint64(1), x[2], x[0] | np.uint64(1)
    u, inverse = np.unique(x, return_inverse=True)
    looked, real = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *z, **k: (looked.append(np.size(v)), real(a, v, *z, **k))[1])
    one, of = grouped(x)
    assert np.array_equal(x[one], u) and np.array_equal(of, inverse)
    assert sum(looked) < 100  # each number was looked up


@pytest.mark.parametrize("kind", [np.uint64, np.int64, np.int32])
def test_places_of_any_kind_of_number(kind):
    known = np.unique(np.random.default_rng(3).integers(-1000 if kind != np.uint64 else 0, 9000, 4000).astype(kind))
    wanted = np.random.default_rng(4).integers(0, 9000, 3000).astype(kind)
    of = {v: i for i, v in enumerate(known.tolist())}
    assert places(known, wanted).tolist() == [of.get(v, -1) for v in wanted.tolist()]


def test_pairs_know_the_contexts_of_the_next_level(monkeypatch):
    from attest.llm import suffix_tree as st
    from attest.llm.shared import packed, planes

    word = np.array([5, 9], np.uint32)
    longer = st._hashed(np.array([77], np.uint64), np.array([9], np.uint64) << np.uint64(32))
    tables = {
        "f/level1": [[packed(np.array([77], np.uint64))], [bytes([1])], [planes(np.array([2], np.uint32))], [planes(word)], [planes(np.array([3, 40], np.uint64))]],
        "f/level2": [[packed(longer)], [bytes([2])], [planes(np.array([0], np.uint32))], [b""], [b""]],
    }
    monkeypatch.setattr(st, "part_rows", lambda path, part, columns: tables[path])
    one, two = st._levels("f", 0, 2, st.Settings(), 100)
    n, at = one.count(np.array([0, 0, 0, -1]), np.array([9, 5, 6, 9], np.uint64) << np.uint64(32), np.array([True, True, True, False]))
    assert n.tolist() == [40, 3, 1, 0]
    assert one.next[at].tolist() == [0, -1, -1, -1] and two.context.tolist() == longer.tolist()


@pytest.mark.parametrize("bits", [8, 25, 32])
def test_numbers_of_words(bits):
    """Frequent words of a bucket have the smallest numbers; words without one are told apart by their hashes."""
    from attest.llm import suffix_tree as st

    r = np.random.default_rng(8)
    word = np.unique((np.uint64(3) << np.uint64(64 - bits)) | (r.integers(0, 1 << 63, 5000).astype(np.uint64) >> np.uint64(bits - 1)))
    n = r.zipf(1.5, len(word)).clip(0, 10**6) - 1
    got = st._numbers(word, n, bits)
    some = got < 1 << 31
    assert some.sum() == len(np.unique(got[some])) == min((n > 1).sum(), 1 << max(0, 31 - bits))
    assert ((got[some] & np.uint32((1 << min(bits, 31)) - 1)) == 3).all()
    assert (got[~some] == st._rare(word[~some])).all() and (np.diff(n[some][np.argsort(got[some])]) <= 0).all()
    assert not some.any() or n[some].min() >= n[~some & (n > 1)].max(initial=0)
