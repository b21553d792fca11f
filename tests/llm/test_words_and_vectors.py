"""Word hashes, shingles and windows against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import linear
from quarry.llm import words as w
from quarry.llm.common import free_name, text_buffers
from quarry.llm.vectors import matrix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_shingles(text, n):
    ws = WORD.findall((text or "").translate(LOWER))
    if len(ws) < n:
        return [tuple(ws)] if ws else []
    return [tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\t x", max_size=40)), max_size=6))
def test_shingles_follow_the_plain_rule(texts):
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    words, _ = w.hash_words(data, offsets)
    assert words.per_doc.tolist() == [len(WORD.findall(t or "")) for t in texts]
    h, counts = w.shingle_hashes(words, 3)
    plain = [plain_shingles(t, 3) for t in texts]
    assert counts.tolist() == [len(p) for p in plain]
    seen = {}
    for value, shingle in zip(h.tolist(), (s for p in plain for s in p)):
        assert seen.setdefault(shingle, value) == value          # equal shingles, equal hashes
    assert len(set(seen.values())) == len(seen)                  # others differ
    u, n = w.distinct_per_doc(h, counts)
    assert n.tolist() == [len(set(p)) for p in plain] and len(u) == n.sum()


def test_words_across_pieces_and_prefixes(monkeypatch):
    text = " ".join(["alpha", "b" * 500, "alpha", "c" * 7, "B" * 500] * 40)
    data, offsets = text_buffers(pa.array([text, "alpha alphabet"], pa.string()))
    whole, pre = w.hash_words(data, offsets, (4, 5))
    monkeypatch.setattr(w, "PIECE", 64)                          # words longer than a piece
    cut, cut_pre = w.hash_words(data, offsets, (4, 5))
    names = (text + " alpha alphabet").lower().split()
    for got, prefixes in ((whole, pre), (cut, cut_pre)):
        by = {}
        for name, h in zip(names, got.hash.tolist()):
            assert by.setdefault(name, h) == h
        assert len(set(by.values())) == len(by)
        assert (prefixes[1][-1] != 0) and (prefixes[1][-2] == 0)  # "alphabet" is longer than 5, "alpha" is not
        assert prefixes[0][-1] == prefixes[0][-2] == prefixes[0][0]


def test_sliced_arrays_and_windows():
    arr = pa.array(["x y", None, "a b c", "d"], pa.string()).slice(1, 3)
    data, offsets = text_buffers(arr)
    assert bytes(data) == b"a b cd" and offsets.tolist() == [0, 0, 5, 6]
    words, n = linear.windows(np.array([0, 1, 64, 65, 200]))
    assert n.tolist() == [1, 1, 1, 2, 4] and words.tolist() == [0, 1, 64, 64, 1, 64, 64, 64, 8]
    assert linear.segment_sum(np.arange(5.0), np.array([2, 0, 3])).tolist() == [1.0, 0.0, 9.0]


def test_matrix_pads_and_free_name():
    m = matrix(pa.array([[1.0], [2.0, 3.0], []], pa.list_(pa.float64())))
    assert m.tolist() == [[1.0, 0.0], [2.0, 3.0], [0.0, 0.0]]
    assert free_name(["a", "A_", "_a"], "A") == "__A"


def test_fit_separates():
    rng = np.random.default_rng(0)
    slots = rng.integers(10, 500, (4000, 1))
    lengths = np.full(400, 10)
    y = np.arange(400) % 2
    slots[np.arange(0, 4000, 10)[y == 1], 0] = 3
    weights, bias, _ = linear.fit(slots.astype(np.int32), lengths, y.astype(float))
    z = linear.margins(weights, bias, slots, lengths)
    assert ((z > 0) == (y == 1)).mean() > 0.97
    weights, bias, _ = linear.fit(np.empty((0, 1), np.int32), np.empty(0, np.int64), np.empty(0))
    assert not weights.any() and bias == 0


def test_too_long_pieces_are_stable():
    long = "z" * (w.PIECE + 10)
    data, offsets = text_buffers(pa.array([long + " q", long], pa.string()))
    words, _ = w.hash_words(data, offsets)
    assert words.hash[0] == words.hash[2] != words.hash[1]


@pytest.mark.parametrize("n", [1, 5])
def test_other_shingle_lengths(n):
    texts = ["a b c d e f", "a b", ""]
    data, offsets = text_buffers(pa.array(texts))
    _, counts = w.shingle_hashes(w.hash_words(data, offsets)[0], n)
    assert counts.tolist() == [len(plain_shingles(t, n)) for t in texts]
