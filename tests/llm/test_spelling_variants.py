"""Operator 13 against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from corpusmill.llm import spelling_variants as V
from helpers import documents


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_vocabulary(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def brute(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def result(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made_up(seed, n, letters="abÀé"):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(n)}
    return {w: rng.choice([3, 4, 6, 7, 12, 25, 50, 99]) for w in words}


@pytest.mark.parametrize("limit", [20_000, 8])
def test_variants_equal_all_pairs(spark, limit):
    words = made_up(1, 500) | {"colour": 40, "color": 90, "colours": 3, "aaaaa": 9, "aaaaaa": 4, "aaaaaaa": 8, "x" * 300: 3, "x" * 301: 7, "x" * 300 + "y": 3}
    docs = [(None, " ".join([w] * n)) for w, n in words.items()]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(brute_vocabulary(docs))
    assert len([r for r in want if r[1]]) > 50 and any(r[1] != r[2] for r in want if r[1])
    assert result(V.spelling_variants(table, limit=limit)) == want


def test_pairs_of_an_acceptor_are_all_pairs():
    for seed in range(30):
        sets = [sorted(made_up(seed * 3 + k, 60, "abc")) + [""] * (k == 1) for k in range(3)]
        acceptor = V.Acceptor()
        starts = [acceptor.add(sorted(s)) for s in sets]
        for s, start in zip(sets, starts):
            got = list(acceptor.near(start))
            assert len(got) == len(set(got)) and all(len(a) >= len(b) for a, b in got)
            assert {frozenset(p) for p in got} == {frozenset((a, b)) for a in s for b in s if one_edit(a, b)}


def test_equal_ends_share_states():
    acceptor = V.Acceptor()
    a, b = acceptor.add(["aing", "bing"]), acceptor.add(["cing", "ding"])
    assert len(acceptor.arcs) == 6 and a != b


def test_hash_deletes_a_character():
    word = next(w for w in (f"walk{chr(97 + i)}{chr(97 + j)}{chr(97 + k)}" for i in range(26) for j in range(26) for k in range(26))
                if zlib.crc32(f"5:{w}".encode()) % 97 == 0)
    h = zlib.crc32(f"5:{word}".encode())
    assert list(V.counted_runs(f"{word.upper()} {word}!", 5)) == [(word[:h % 7] + word[h % 7 + 1:], 2)]


def test_hostile_rows_and_empty_table(spark):
    docs = documents(spark)
    assert result(V.spelling_variants(docs)) == brute(brute_vocabulary([(r.doc_id, r.text) for r in docs.collect()]))
    assert V.spelling_variants(docs.limit(0)).collect() == []


def test_query_equals_all_pairs(spark, testdata="/root/testdata/sf0.001"):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{testdata}/documents.parquet").collect()]
    assert result(V.op13_spelling_variants(spark, testdata)) == brute(brute_vocabulary(docs))
