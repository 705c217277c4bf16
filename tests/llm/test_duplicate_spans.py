import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import duplicate_spans as D
from corpusmill.llm import suffix_arrays as S
from helpers import documents


@given(st.lists(st.integers(1, 4), max_size=60))
@settings(max_examples=400, deadline=None)
def test_suffix_array_and_common_prefixes(symbols):
    s = np.array([*symbols, 0], dtype=np.uint16)
    sa = S.suffix_array(s, 1000)
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    plcp = S.common_prefixes(s, sa, np.array([0]), len(s) + 4)
    for a, b in zip(sa[1:].tolist(), sa.tolist()):
        n = 0
        while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
            n += 1
        assert plcp[a] == n


def brute(docs, length):
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    for (d, _), t in zip(docs, texts):
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        rest = bytes(b for b, g in zip(t, gone) if not g)
        yield d, len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(rest).hexdigest(), rest


PASSAGE = "the same passage, word for word, in several places; "
DOCS = [(1, None), (2, ""), (2, ""), (3, "ab" * 60), (4, "q" * 200), (5, "q" * 39), (6, "start " + PASSAGE + "middle " + PASSAGE * 2), (7, PASSAGE + "é" * 30),
        (8, PASSAGE + "é" * 30), (9, "unlike " + PASSAGE[:39]), (10, "x" + PASSAGE[:40] + "y"), (None, "no id " * 30), (11, "short"), (11, "\0\1\0" * 40),
        *((100 + i, f"{i * 7919} lead " + PASSAGE[:44] + f" tail {i * 104729}") for i in range(12))]


@pytest.mark.parametrize("shard_bytes, crowd", [(2_000_000, 3000), (1, 3000), (2_000_000, 0), (500, 4)])
def test_against_brute_force(spark, shard_bytes, crowd):
    got = D.without_repeats(documents(spark, DOCS).repartition(3), length=40, gram=12, shard_bytes=shard_bytes, crowd=crowd, keep_bytes=True)
    rows = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(brute(DOCS, 40), key=str)


@given(st.lists(st.text("ab", max_size=40), max_size=5), st.integers(2, 9), st.integers(0, 3))
@settings(max_examples=150, deadline=None)
def test_equal_windows_have_equal_anchors(texts, length, less):
    gram, roller = max(1, length - less), D.Roller(size=4096)
    owner = {}
    for x, whole, where in D._pieces([t.encode() for t in texts], length):
        for lo, hi, at, h in zip(*(v.tolist() for v in roller.anchors(x, whole, length, gram))):
            for p in range(lo, hi + 1):
                assert owner.setdefault(x[p:p + length].tobytes(), (at - p, h)) == (at - p, h)
    assert set(owner) == {t.encode()[i:i + length] for t in texts for i in range(len(t) - length + 1)}


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(D, "PIECE", 64)
    text = bytes(np.random.default_rng(0).integers(97, 100, 1000, dtype=np.uint8))
    places = [offset + int(p) - at for x, whole, where in D._pieces([text], 30) for p in np.flatnonzero(whole) for _, at, offset in [where[-1]] if p >= at]
    assert sorted(places) == list(range(1000 - 30 + 1))


def test_empty(spark):
    assert D.without_repeats(documents(spark).limit(0)).count() == 0
