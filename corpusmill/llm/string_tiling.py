"""Operator 4, benchmark decontamination by greedy string tiling.

Texts are lower-cased runs of letters and digits; in scripts written without spaces every character is a word.  Seeds are word runs of ``MIN_MATCH`` words that a
document shares with a benchmark item, found by Karp-Rabin hashes and checked word by word.  Per
document and item the seeds grow into maximal matches; the longest match that overlaps no earlier one is
marked as a tile, again and again, until no match of ``MIN_MATCH`` unmarked words is left.  Tiles may lie in any
order, so rearranged passages are found.  A document leaks an item when its tiles cover at least
``MIN_COVER`` of the item's words.  Items shorter than a seed are matched as one run; an item of a single word leaks only where it is the whole text.

The benchmark is read in slices of at most about ``SLICE_WORDS`` words, each a broadcast of bounded size, one
at a time; a benchmark of any size takes as many passes over the documents as it has slices.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import table, written

MIN_MATCH, MIN_COVER, SLICE_WORDS = 5, 0.5, 500_000
ROWS = 512  # texts in Python at a time

# Thai and Lao, Myanmar, Khmer, kana, Han.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{UNSPACED}]|[^\W_{UNSPACED}]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``k`` ids, modulo 2 ** 64."""
    h = np.zeros(max(0, len(ids) - k + 1), dtype=np.uint64)
    for j in range(k):
        h = h * _BASE + ids[j:j + len(h)]
    return h ^ (h >> np.uint64(29))


class ItemIndex:
    """Word ids, seed hashes and places of the items of one slice."""

    def __init__(self, items: list[tuple[int | None, str | None]], k: int = MIN_MATCH):
        self.k, self.vocab = k, {}
        self.items, self.ids = [i for i, _ in items], []
        hashes, which, places = [], [], []
        for n, (_, text) in enumerate(items):
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)], dtype=np.uint64)
            self.ids.append(ids)
            h = _rolling(ids, k)
            hashes.append(h)
            which.append(np.full(len(h), n))
            places.append(np.arange(len(h)))
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, dtype=t)
        h = join(hashes, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash, self.which, self.place = h[order], join(which, np.int64)[order], join(places, np.int64)[order]
        self.short: dict[int, list[int]] = {}  # items shorter than a seed by their length
        for n, ids in enumerate(self.ids):
            if 0 < len(ids) < k:
                self.short.setdefault(len(ids), []).append(n)
        self.short_hash = {n: np.array([_rolling(self.ids[i], n)[0] for i in items]) for n, items in self.short.items()}

    def short_runs(self, ids: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Items shorter than a seed that stand in the document as one run, the first of their runs as tile."""
        for n, items in self.short.items():
            if len(ids) < n or n == 1 and len(ids) > 1:
                continue
            h = _rolling(ids, n)
            for at in np.flatnonzero(np.isin(self.short_hash[n], h)).tolist():
                item = items[at]
                for p in np.flatnonzero(h == self.short_hash[n][at]).tolist():
                    if (ids[p:p + n] == self.ids[item]).all():
                        yield item, [(p, 0, n)]
                        break

    def seeds(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(place in the document, item, place in the item)`` of all seeds, checked word by word."""
        none = (np.empty(0, dtype=np.int64),) * 3
        if len(ids) < self.k or not len(self.hash):
            return none
        known = np.convolve(ids > 0, np.ones(self.k, dtype=np.int64), "valid") == self.k
        at = np.flatnonzero(known)
        if not len(at):
            return none
        h = _rolling(ids, self.k)[at]
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        n = hi - lo
        if not n.any():
            return none
        p = np.repeat(at, n)
        e = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        item, q = self.which[e], self.place[e]
        good = np.ones(len(p), dtype=bool)
        for i in np.unique(item):
            m = item == i
            for j in range(self.k):
                good[m] &= ids[p[m] + j] == self.ids[i][q[m] + j]
        return p[good], item[good], q[good]

    def tiles(self, text: str | None) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """``(item, tiles)``, each tile ``(place in the document, place in the item, words)``."""
        ids = np.array([self.vocab.get(w, 0) for w in words_of(text)], dtype=np.uint64)
        p, item, q = self.seeds(ids)
        for i in np.unique(item).tolist():
            m = item == i
            yield i, greedy_tiles(p[m], q[m], len(ids), len(self.ids[i]), self.k)
        yield from self.short_runs(ids)

    def leaks(self, text: str | None, cover: float) -> Iterator[tuple[int, float, list[tuple[int, int, int]]]]:
        for i, tiles in self.tiles(text):
            c = sum(t[2] for t in tiles) / len(self.ids[i])
            if c >= cover:
                yield i, c, tiles


def greedy_tiles(p: np.ndarray, q: np.ndarray, n: int, m: int, k: int) -> list[tuple[int, int, int]]:
    """Tiles of one document (``n`` words) and item (``m`` words) from their seeds ``(p, q)``.

    Ties go to the match that comes first in the document, then in the item.
    """
    order = np.lexsort((p, p - q))
    p, q = p[order], q[order]
    new = np.flatnonzero(np.r_[True, (np.diff(p - q) != 0) | (np.diff(p) != 1)])
    length = np.diff(np.r_[new, len(p)]) + k - 1
    heap = list(zip((-length).tolist(), p[new].tolist(), q[new].tolist()))
    heapq.heapify(heap)
    in_doc, in_item, tiles = np.zeros(n, dtype=bool), np.zeros(m, dtype=bool), []
    while heap:
        size, a, b = heapq.heappop(heap)
        size = -size
        taken = in_doc[a:a + size] | in_item[b:b + size]
        if not taken.any():
            in_doc[a:a + size] = in_item[b:b + size] = True
            tiles.append((a, b, size))
            continue
        if in_item.all():
            break
        free = np.flatnonzero(np.diff(np.r_[True, taken, True]))  # starts and ends of free runs, in turn
        for s, e in zip(free[::2].tolist(), free[1::2].tolist()):
            if e - s >= k:
                heapq.heappush(heap, (s - e, a + s, b + s))
    return tiles


def item_slices(items: DataFrame, slice_words: int = SLICE_WORDS) -> Iterator[tuple[bool, list[tuple]]]:
    """All items as lists of ``(item_id, text)``, in slices of bounded size, each with whether there are others.

    Sizes are summed first; only one slice at a time is on the driver.  Null texts are left out.
    """
    sized = items.select("item_id", "text").where("text is not null").withColumn("n", F.length("text"))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slices = max(1, -(-total // (4 * slice_words)))
    for s in range(slices):
        part = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == s)
        yield slices > 1, [(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()]


def benchmark_leaks(docs: DataFrame, items: DataFrame, k: int = MIN_MATCH, cover: float = MIN_COVER,
                    slice_words: int = SLICE_WORDS) -> DataFrame:
    """Leaked items of ``docs (doc_id, text)``: one row per document row and item.

    Returns ``doc_id, item_id, coverage, n_tiles, longest, tiles`` with ``tiles`` an array of ``(doc_pos, item_pos,
    words)`` in reading order.  Null and empty texts leak nothing; repeated rows give repeated results; empty tables
    give an empty result.
    """
    sc, found = docs.sparkSession.sparkContext, None
    for several, part in item_slices(items, slice_words):
        held = sc.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(held.value, k)
            kind = pa.list_(pa.struct([("doc_pos", pa.int64()), ("item_pos", pa.int64()), ("words", pa.int64())]))
            schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()),
                                ("n_tiles", pa.int64()), ("longest", pa.int64()), ("tiles", kind)])
            for b in (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)):
                rows = [{"doc_id": d, "item_id": index.items[i], "coverage": c, "n_tiles": len(t), "longest": max(x[2] for x in t),
                         "tiles": [dict(zip(("doc_pos", "item_pos", "words"), x)) for x in sorted(t)]}
                        for d, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())
                        for i, c, t in index.leaks(text, cover)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

        part = docs.select("doc_id", "text").mapInArrow(
            run, "doc_id long, item_id long, coverage double, n_tiles long, longest long, "
                 "tiles array<struct<doc_pos: long, item_pos: long, words: long>>")
        if several:  # done with this slice before the next one is broadcast
            part = written(part, "tiling-leaks")
            held.unpersist()
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(docs: DataFrame, items: DataFrame, k: int = MIN_MATCH, cover: float = MIN_COVER,
                  slice_words: int = SLICE_WORDS) -> DataFrame:
    """The rows of ``docs`` that leak no item, all columns unchanged."""
    for several, part in item_slices(items, slice_words):
        held = docs.sparkSession.sparkContext.broadcast(part)
        docs = docs.where(_clean(held, k, cover)(F.col("text")))
        if several:
            docs = written(docs, "tiling-clean")
            held.unpersist()
    return docs


def _clean(held, k: int, cover: float):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = ItemIndex(held.value, k)
        for texts in batches:
            yield pd.Series([next(index.leaks(t, cover), None) is None for t in texts], dtype=bool)

    return clean


def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least half the words of a benchmark item as tiles of 5 words or more."""
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tiles")
