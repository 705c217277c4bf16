import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from corpusmill.llm import pfair_mix, token_blocks
from corpusmill.llm.common import written
from helpers import TEXTS, documents

SF = "/root/testdata/sf0.001"


def test_stages_on_hard_rows(spark):
    docs = written(documents(spark), "t")
    for name, stage in P.STAGES[:-1]:
        out = written(stage(spark, docs, SF), "t")
        assert out.columns == docs.columns, name
        assert written(stage(spark, docs.limit(0), SF), "t").count() == 0, name
        docs = out
    assert {r.doc_id for r in docs.collect()} == {1, 4, 6, 8, 9, None}
    assert P.token_output(spark, docs.limit(0), SF).count() == 0


def test_token_files_follow_the_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = written(P.source_mix(spark, docs, SF), "t")
    got = [tuple(r) for r in P.token_output(spark, mixed, SF).orderBy("start").collect()]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_blocks.TOKENIZER))
    want, start = [], 0
    for r in pfair_mix.mix(docs).orderBy("cycle", "slot", "nr").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_without_files_the_order_is_by_id(spark):
    got = P.token_output(spark, documents(spark), SF).orderBy("start").collect()
    ids = [i for i, _ in TEXTS]
    assert [r.doc_id for r in got] == sorted(ids, key=lambda i: -1 if i is None else i)
