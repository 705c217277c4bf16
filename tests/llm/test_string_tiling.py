import random

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import string_tiling as S
from helpers import LONG, documents

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def brute_tiles(doc, item, k):
    """Greedy string tiling by its definition."""
    in_doc, in_item, tiles = set(), set(), []
    while True:
        best = None
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while (p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n]
                       and p + n not in in_doc and q + n not in in_item):
                    n += 1
                if n >= k and (best is None or n > best[2]):
                    best = (p, q, n)
        if best is None:
            return tiles
        p, q, n = best
        in_doc.update(range(p, p + n))
        in_item.update(range(q, q + n))
        tiles.append(best)


@given(st.lists(st.sampled_from("abc"), max_size=24), st.lists(st.sampled_from("abc"), max_size=14), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_tiles_against_the_definition(doc, item, k):
    index = S.ItemIndex([(1, " ".join(item))], k)
    got = dict(index.tiles(" ".join(doc)))
    if len(item) < k:  # a run of all its words, or the whole text if it is but one word
        at = [p for p in range(len(doc) - len(item) + 1) if doc[p:p + len(item)] == item] if len(item) > 1 or doc == item else []
        assert got.get(0, []) == [(p, 0, len(item)) for p in at[:1] if item]
    else:
        assert got.get(0, []) == brute_tiles(doc, item, k)


def test_finds_reordered_and_leaves_clean(spark):
    w = ITEM.split()
    moved = " ".join(["intro", *w[12:], "between", "words", *w[:12], "end"])
    half = " ".join(w[:7]) + " then other things entirely " + " ".join(w[16:])
    rows = [(1, f"Before. {ITEM.upper()}! After"), (2, moved), (3, half), (4, " ".join(random.Random(1).sample(w, len(w)))), (5, None), (6, ""),
            (7, LONG + " " + ITEM), (None, ITEM), (8, ITEM), (8, ITEM)]
    docs = documents(spark, rows)
    items = spark.createDataFrame([(10, ITEM, 1), (11, "short item here", 1), (12, None, 1), (13, "", 1)], "item_id long, text string, doc_id int")
    got = S.benchmark_leaks(docs, items).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 10), (1, 10), (2, 10), (7, 10), (8, 10), (8, 10)]
    assert next(r for r in got if r.doc_id == 2).n_tiles == 2
    kept = S.without_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    many = S.benchmark_leaks(docs, items, slice_words=5).collect()  # several passes, same result
    assert sorted(map(str, many)) == sorted(map(str, got))


def test_empty(spark):
    docs, items = documents(spark), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert S.benchmark_leaks(docs.limit(0), items).count() == 0
    assert S.benchmark_leaks(docs, items.limit(0)).count() == 0
    assert S.without_leaks(docs, items.limit(0)).count() == docs.count()


def test_short_and_unspaced_items(spark):
    items = spark.createDataFrame([(1, "Quis custodiet ipsos custodes?"), (2, "Paris"), (3, "日本の首都は東京です"), (4, "กรุงเทพมหานคร")], "item_id long, text string")
    rows = [(1, "They asked: quis custodiet, ipsos custodes!"), (2, "custodes quis custodiet ipsos"), (3, "Paris"), (4, "in Paris there"), (5, "問題:日本の首都は東京です。答え"),
            (6, "東京は日本の都市です"), (7, "ที่กรุงเทพมหานครวันนี้"), (8, "日本の首都")]
    docs = documents(spark, rows)
    got = sorted((r.doc_id, r.item_id) for r in S.benchmark_leaks(docs, items).collect())
    assert got == [(1, 1), (3, 2), (5, 3), (7, 4), (8, 3)]
    assert sorted(r.doc_id for r in S.without_leaks(docs, items, slice_words=3).collect()) == [2, 4, 6]
