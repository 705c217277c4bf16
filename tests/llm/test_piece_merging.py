"""Operator 12 against the library, and its rounds against a queue of pairs on made-up vocabularies."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from corpusmill.llm import piece_merging as M
from helpers import documents

MODEL = public_tokenizers.path(M.MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def hostile(n):
    rng = random.Random(5)
    letters = "ab ▁\n\teinstthéü中日ing  <0x0A>\U0001f600\x00ﬁ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    texts += [" " * k for k in range(40)] + ["ab" * k for k in range(1, 30)] + ["<s>", "</s>", "<unk>", "▁", "▁▁a", " ▁ a", "\u0000", "�"]
    return texts + ["x" * 5000, " " * 3000, "the " * 3000, "".join(rng.choice("abcdefghinst") for _ in range(4000))]


def test_ids_and_texts_equal_the_library(library):
    codec, texts = M.PieceCodec(MODEL), hostile(3000)
    ids = codec.encode(texts)
    assert [x.tolist() for x in ids] == library.encode(texts, add_bos=True, add_eos=True)
    assert [codec.decode(x) for x in ids] == [library.decode(x.tolist()) for x in ids]


def test_words_known_from_earlier_texts_are_forgotten_in_time(library, monkeypatch):
    monkeypatch.setattr(M, "CACHE_WORDS", 50)
    codec, texts = M.PieceCodec(MODEL), hostile(300)
    got = [x.tolist() for i in range(0, len(texts), 20) for x in codec.encode(texts[i:i + 20])]
    assert got == library.encode(texts, add_bos=True, add_eos=True)


def slow(merger, symbols):
    """The best pair at a time, the leftmost of several."""
    s = list(symbols)
    while len(s) > 1:
        rank, new = merger.pairs(np.array(s[:-1]), np.array(s[1:]))
        i = int(rank.argmin())
        if rank[i] == np.iinfo(np.int32).max:
            break
        s[i:i + 2] = [int(new[i])]
    return s


@pytest.mark.parametrize("seed", range(40))
def test_rounds_equal_single_merges_for_any_vocabulary(seed):
    # Scores at random, ties too: merges can make pairs that are better than the one just merged.
    rng = random.Random(seed)
    pieces = list({"a", "b", "c"} | {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(30)})
    merger = M.PieceMerger([(p, float(rng.randint(-8, 0))) for p in sorted(pieces)], np.arange(1000, 1256, dtype=np.int32))
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 25))) for _ in range(60)]
    ids, size = merger.encode_words(words)
    cut = np.split(ids, np.cumsum(size)[:-1])
    for w, x in zip(words, cut):
        want = slow(merger, merger.symbol[[ord(c) for c in w]].tolist())
        assert x.tolist() == [1000 + ord("d") if s < 0 else s for s in want]
        assert merger.one_by_one(merger.symbol[[ord(c) for c in w]]).tolist() == want


def test_table_with_hostile_rows(spark, library):
    docs = documents(spark)
    got = M.encode_texts(docs, MODEL, outputs=("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")).collect()
    texts = [r.text or "" for r in docs.collect()]
    want = library.encode(texts, add_bos=True, add_eos=True)
    assert sorted((r.doc_id or -1, r.ids) for r in got) == sorted((r.doc_id or -1, x) for r, x in zip(docs.collect(), want))
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded == library.decode(r.ids) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert M.encode_texts(docs.limit(0), MODEL).collect() == []
    back = M.decode_ids(M.encode_texts(docs, MODEL), MODEL).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((r.doc_id or -1, r.decoded) for r in got)
    assert [r.text for r in M.decode_ids(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), MODEL).collect()] == [None]


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        M.PieceCodec(str(tmp_path / "m.model"))


def test_query_equals_the_library(spark, library, testdata="/root/testdata/sf0.001"):
    got = {r.doc_id: r for r in M.op12_piece_merging(spark, testdata).collect()}
    rows = spark.read.parquet(f"{testdata}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
