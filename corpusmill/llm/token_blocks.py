"""Operator 3, token-ID output: patched frame-of-reference blocks.

Texts are tokenised with a public tokenizer, an end id follows each document, and the ids of the
documents in ascending ``doc_id`` order are written as segments of compressed blocks:

* a block holds up to ``BLOCK`` ids: the smallest id is subtracted, the differences are packed at the
  width that fits ``PERCENTILE`` percent of them, and the rest stand in an exception list;
* a segment holds whole documents (it closes at the first document end after ``SEGMENT`` ids), so
  documents never cross segments and segments decode independently.  It starts with a table of its
  documents and an index of its blocks' first bytes.

Files are Parquet with one row per segment, ``part, seg, first_id, n_docs, n_tokens, segment``; ordered by
``(part, seg)`` they hold the stream.  Spark's committer makes the write safe to repeat.  A segment's
layout (little endian): magic, documents, ids, blocks, block size (5 x u32); per document i64 id, u8 null
flag, u32 ids; blocks + 1 u32 byte starts, relative to the first block; then the blocks: u32 smallest id, u32 exceptions,
u8 width, exceptions' u16 places and u32 differences, packed bits.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections.abc import Callable, Iterator
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import scratch_path, table

BLOCK, SEGMENT, PERCENTILE = 4096, 1 << 20, 95
MAGIC = 0x31524650  # "PFR1"
END_ID = 1
CACHE_WORDS, SHARED_WORDS = 600_000, 350_000
TOKENIZER = "word_bpe_49k.json"

#: ASCII punctuation that always parts from a letter or digit before it (no apostrophe: contractions; no < | >: special tokens).
_TAIL = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


# --- block format ---------------------------------------------------------------------------------

def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of u32 ids."""
    low = int(ids.min())
    rest = (ids - low).astype("<u4")
    fit = int(np.partition(rest, k := min(len(rest) - 1, int(len(rest) * percentile / 100)))[k])
    width = fit.bit_length()
    out = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, dtype=np.int64)
    patch = rest[out]
    rest[out] = 0
    rows = rest.astype("<u2") if width <= 16 else rest  # fewer bits to unpack
    bits = np.unpackbits(rows.view(np.uint8), bitorder="little").reshape(len(rows), -1)[:, :width]
    return b"".join((np.array([low, len(out)], dtype="<u4").tobytes(), bytes([width]), out.astype("<u2").tobytes(),
                     patch.tobytes(), np.packbits(bits, bitorder="little").tobytes()))


def unpack_block(data: bytes, at: int, n: int) -> np.ndarray:
    """The ``n`` ids of the block that starts at byte ``at``."""
    low, odd = np.frombuffer(data, "<u4", 2, at).tolist()
    width, at = data[at + 8], at + 9
    where, patch = np.frombuffer(data, "<u2", odd, at), np.frombuffer(data, "<u4", odd, at + 2 * odd)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, (n * width + 7) // 8, at + 6 * odd), count=n * width, bitorder="little")
    full = np.zeros((n, 16 if width <= 16 else 32), dtype=np.uint8)
    full[:, :width] = bits.reshape(n, width)
    rest = np.packbits(full.ravel(), bitorder="little").view("<u2" if width <= 16 else "<u4").astype("<u4")
    rest[where] = patch
    return rest + np.uint32(low)


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray], block: int = BLOCK) -> bytes:
    """Documents and their u32 ids as one segment."""
    stream = np.concatenate(ids) if ids else np.empty(0, dtype="<u4")
    blocks = [pack_block(stream[i:i + block]) for i in range(0, len(stream), block)]
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks], dtype=np.int64)])
    head = np.array([MAGIC, len(doc_ids), len(stream), len(blocks), block], dtype="<u4")
    return b"".join((head.tobytes(), np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
                     np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(),
                     np.array([len(i) for i in ids], dtype="<u4").tobytes(), starts.astype("<u4").tobytes(), *blocks))


def unpack_segment(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a segment with their ids."""
    magic, docs, total, blocks, block = np.frombuffer(data, "<u4", 5).tolist()
    if magic != MAGIC:
        raise ValueError("not a segment of token blocks")
    at = 20
    keys = np.frombuffer(data, "<i8", docs, at).tolist()
    null = np.frombuffer(data, np.uint8, docs, at + 8 * docs).tolist()
    sizes = np.frombuffer(data, "<u4", docs, at + 9 * docs).tolist()
    starts = np.frombuffer(data, "<u4", blocks + 1, at + 13 * docs).tolist()
    at += 13 * docs + 4 * (blocks + 1)
    stream = np.empty(total, dtype="<u4")
    for b in range(blocks):
        i = b * block
        stream[i:i + block] = unpack_block(data, at + starts[b], min(block, total - i))
    i = 0
    for k, no, n in zip(keys, null, sizes):
        yield (None if no else k), stream[i:i + n]
        i += n


# --- tokenising -----------------------------------------------------------------------------------

def _per_process(name: str, make: Callable):
    """An object that tasks of one Python worker share."""
    held = sys.modules.setdefault("_corpusmill_process", types.ModuleType("_corpusmill_process")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


class WordTokenizer:
    """Ids of whole texts, with the ids of words kept.

    The tokenizer folds case and splits at white space and between letters and punctuation, so a text's
    ids are those of its words; ASCII case is folded here, and a word that ends in ASCII punctuation is
    looked up as word and tail.  Texts that hold ``<|`` (special tokens) are encoded as they stand.  The
    store starts from up to ``SHARED_WORDS`` words that earlier tasks of the process have met, and goes back to
    them when it holds ``CACHE_WORDS``, which bounds its memory.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.shared = _per_process(f"words:{path}", dict)
        self.words = dict(self.shared)
        self.part = "<|startoftext|>"
        self.part_id = self.tokenizer.token_to_id(self.part)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)  # the ids that end a word
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _encode(self, words: list[bytes], alone: bool) -> None:
        """Encode many words at once.

        Words of letters only (``alone``) are one run of merges each, whose last id ends a word; others are
        parted by a special token.
        """
        groups = [words[i:i + 128] for i in range(0, len(words), 128)]
        joined = [(" " if alone else self.part).join(w.decode() for w in g) for g in groups]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            data = ids.tobytes()
            if alone:
                stop = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
                start = [0, *stop[:-1]]
                if len(stop) != len(group):
                    self._encode(group, False)
                    continue
            else:
                cuts = np.flatnonzero(ids == self.part_id) * 4
                start, stop = [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(data)]
            self.words.update(zip(group, (data[a:b] for a, b in zip(start, stop))))

    def _learn(self, unknown: set[bytes]) -> None:
        """Put the ids of new words into the store."""
        known, both, new = self.words, [], set()
        for w in unknown:
            core = w.rstrip(_TAIL)
            if len(core) < len(w) and core[-1:].isalnum():
                both.append((w, core, w[len(core):]))
            else:
                new.add(w)
        for _, core, tail in both:
            new.add(core)
            new.add(tail)
        new = new.difference(known)
        letters = [w for w in new if w.isalpha() or w.decode().isalpha()]
        self._encode(letters, True)
        self._encode(list(new.difference(letters)), False)
        known.update([(w, known[a] + known[b]) for w, a, b in both])
        if len(self.shared) < SHARED_WORDS:
            self.shared.update((w, known[w]) for w in unknown)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        split, odd = [], {}
        for t in texts:
            if b"<|" in t:
                odd[len(split)] = t
                split.append([])
            else:
                split.append(t.lower().replace(b"\n", b" ").split(b" "))
        if len(self.words) > CACHE_WORDS:
            self.words = dict(self.shared)
        known = self.words
        found = [list(map(known.get, w)) for w in split]
        gaps = [list(compress(range(len(v)), map(is_, v, repeat(None)))) for v in found]
        self._learn({w[i] for w, gap in zip(split, gaps) for i in gap})
        for w, v, gap in zip(split, found, gaps):
            for i in gap:
                v[i] = known[w[i]]
        out = [np.frombuffer(b"".join(v), dtype="<u4") for v in found]
        for i, t in odd.items():
            out[i] = np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, dtype="<u4")
        return out


def _segments(path: str, end_id: int, segment: int):
    schema = pa.schema([("part", pa.int32()), ("seg", pa.int64()), ("first_id", pa.int64()), ("n_docs", pa.int64()),
                        ("n_tokens", pa.int64()), ("segment", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seg = WordTokenizer(path), TaskContext.get().partitionId(), 0
        end, docs, ids, size = np.array([end_id], dtype="<u4"), [], [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": part, "seg": seg, "first_id": docs[0], "n_docs": len(docs),
                                                "n_tokens": size, "segment": pack_segment(docs, ids)}], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = [t or b"" for t in some.column("text").cast(pa.binary()).to_pylist()]
                for d, x in zip(some.column("doc_id").to_pylist(), encode(texts)):
                    docs.append(d)
                    ids.append(np.concatenate([x, end]))
                    size += len(x) + 1
                    if size >= segment:
                        yield close()
                        docs, ids, size, seg = [], [], 0, seg + 1
        if docs:
            yield close()
    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, segment: int = SEGMENT,
                      order: list[Column] | None = None) -> None:
    """Tokenise ``docs (doc_id, text)`` and write the segments as Parquet under ``path``.

    ``tokenizer``: path of a tokenizer file, the same on every executor.  ``order``: stream order, by default
    ascending ``doc_id`` (nulls first), then a hash of the text; its columns are sampled, so they are narrow.  A null text is an empty one; every document gets the
    end id.  Repeated ids are written as often as they occur; an empty table writes no segment.
    """
    order = order or [F.col("doc_id"), F.xxhash64("text")]
    some = docs.withColumns({f"__o{i}": c for i, c in enumerate(order)}).select("doc_id", "text", *[f"__o{i}" for i in range(len(order))])
    keys = [c for c in some.columns if c.startswith("__o")]
    (some.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
     .mapInArrow(_segments(tokenizer, end_id, segment),
                 "part int, seg long, first_id long, n_docs long, n_tokens long, segment binary")
     .write.option("compression", "none").parquet(path))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "seg", "doc_id", "at", "n_tokens", "ids_crc32"]
    for batch in batches:
        for part, seg, data in zip(batch.column("part").to_pylist(), batch.column("seg").to_pylist(), batch.column("segment")):
            rows, at = [], 0
            for d, ids in unpack_segment(data.as_py()):
                rows.append((part, seg, d, at, len(ids), zlib.crc32(ids.tobytes())))
                at += len(ids)
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "part" else pa.int64()) for n, c in zip(names, cols)], names)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files."""
    f = spark.read.schema("part int, seg long, first_id long, n_docs long, n_tokens long, segment binary").parquet(path)
    sizes = f.select("part", "seg", "n_tokens")
    # Offsets in two levels: parts (one row per write task), then segments within a part.
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = (sizes.withColumn("at", within).join(parts.withColumn("before", before).select("part", "before"), "part")
              .select("part", "seg", (F.col("before") + F.col("at")).alias("start")))
    return (f.select("part", "seg", "segment").mapInArrow(_decoded, "part int, seg long, doc_id long, at long, n_tokens long, ids_crc32 long")
            .join(starts, ["part", "seg"])
            .select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


def token_output(docs: DataFrame, tokenizer: str | None = None, order: list[Column] | None = None) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read them back."""
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path(TOKENIZER)
    path = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, order=order)
    return read_token_files(docs.sparkSession, path)


def op3_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the token files."""
    return token_output(table(spark, sf_dir, "documents"))
