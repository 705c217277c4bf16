import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusmill.llm import token_blocks as T
from helpers import TEXTS, documents

PATH = public_tokenizers.path(T.TOKENIZER)


@given(st.lists(st.integers(0, 2 ** 32 - 1), min_size=1, max_size=300), st.integers(0, 100))
@settings(max_examples=200, deadline=None)
def test_block_round_trip(ids, percentile):
    x = np.array(ids, dtype="<u4")
    assert T.unpack_block(b"??" + T.pack_block(x, percentile), 2, len(x)).tolist() == ids


def test_outliers_become_exceptions():
    x = np.r_[np.full(4000, 5), 4_000_000_000].astype("<u4")
    assert len(T.pack_block(x)) < 40


@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-2 ** 63, 2 ** 63 - 1)), st.lists(st.integers(0, 70_000), max_size=40)), max_size=8))
@settings(max_examples=80, deadline=None)
def test_segment_round_trip(docs):
    data = T.pack_segment([d for d, _ in docs], [np.array(i, dtype="<u4") for _, i in docs], block=16)
    assert [(d, i.tolist()) for d, i in T.unpack_segment(data)] == docs


def test_not_a_segment():
    with pytest.raises(ValueError):
        list(T.unpack_segment(b"\0" * 40))


def plain(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


@given(st.lists(st.text(st.sampled_from("aAbZz'’.,!<|>09 \n\t\u00a0éÉ\u0301ßİΣ中😀-_%"), max_size=30), max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_give_the_ids_of_texts(texts):
    got = T.WordTokenizer(PATH)([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [plain(t)[:-1] for t in texts]


def test_special_tokens_in_texts():
    texts = ["a<|endoftext|>b", "<|ENDOFTEXT|> x", "it's we'll DON'T", "x<|startoftext|>", "a<b|c>d"]
    assert [g.tolist() for g in T.WordTokenizer(PATH)([t.encode() for t in texts])] == [plain(t)[:-1] for t in texts]


@pytest.mark.parametrize("segment", [1, 50, 1 << 20])
def test_files_hold_all_documents_in_order(spark, scratch, segment):
    path = f"{scratch}/t"
    T.write_token_files(documents(spark).repartition(4), path, PATH, segment=segment)
    got = T.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in TEXTS), key=lambda i: -1 if i is None else i)
    texts, start = {}, 0
    for i, t in TEXTS:
        texts.setdefault(i, []).append(plain(t))
    for r in got:
        crcs = {(len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for x in texts[r.doc_id]}
        assert r.start == start and (r.n_tokens, r.ids_crc32) in crcs
        start += r.n_tokens


def test_empty(spark):
    assert T.token_output(documents(spark).limit(0)).count() == 0
