"""Operator 9, toxicity from the nearest labelled examples.

Labelled texts are examples, clean ones too: TF-IDF vectors over all their terms (words, and beginnings of 4 and
5 letters).  A term's weight grows with the root of the log-likelihood ratio between it and the label; no term is
left out.  A text's vote is that of its ``NEIGHBOURS`` nearest examples by exact cosine, weighted by
squared similarity and shrunk towards the share of toxic labels, with the nearest examples as evidence.  Its score is the vote on
a logistic scale, fitted to the votes that examples get from the other examples.

Neighbours come from a block-max inverted index: examples stand in blocks, a term's largest weight in
each block bounds what the block can score.  The ``COMMON`` most frequent terms are scored for many texts at once by a
matrix product; a block's bound is the largest of these parts with the largest weights of the other terms.  Examples of the best
block give a cosine that the last neighbour reaches; the postings from the first to the last block whose bound reaches it are added.  This is done in
single precision; the cosines of all that come near the last place are then added up in double precision.

The classifier is fitted on at most about ``MAX_EXAMPLES`` labelled rows, drawn by a hash of their ids, and its scale on
about ``SCALE_EXAMPLES`` of them; these bounds are what the index's size rests on.  The index lies in the shared folder as files that
the tasks map into memory.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import scratch_path, share, shared, table, written

MAX_EXAMPLES, SCALE_EXAMPLES = 10_000, 2_000
NEIGHBOURS, PRIOR_WEIGHT, THRESHOLD, BLOCK = 15, 0.5, 0.7, 512
ROWS, PART_CHARS = 512, 1 << 21  # texts and characters in Python at a time
COUNTED = 64  # texts whose terms are counted at a time
PART = 1 << 20  # postings at a time when the index is built
COMMON = 2000  # terms scored by matrix product
ROUNDING = 1e-4  # above any error of a cosine in single precision
_ARRAYS = ["names", "name_ends", "idf", "top", "common", "matrix", "rare", "rare_count", "hashes", "by_hash", "own_term", "own_weight", "own_start", "unit", "toxic", "doc_id"]

_POSTING = [("example", "<u4"), ("weight", "<f4")]
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in (4, 5) if len(word) >= n)]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts ``(doc_id, toxic, row)`` with their terms and how often each occurs."""
    for b in (b.slice(a, COUNTED) for b in batches for a in range(0, b.num_rows, COUNTED)):
        tfs = []
        for text in b.column("text").to_pylist():
            tf = Counter()
            for w, n in Counter(_WORD.findall((text or "").lower())).items():
                for x in terms_of(w):
                    tf[x] += n
            tfs.append(tf)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "toxic", "row")), pa.array([list(x) for x in tfs], pa.list_(pa.string())),
                                          pa.array([list(x.values()) for x in tfs], pa.list_(pa.int32()))], ["doc_id", "toxic", "row", "terms", "tf"])


def is_held_out(doc_id: Column) -> Column:
    """True for the ids that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _ratio(a: np.ndarray, n: np.ndarray, toxic: int, total: int) -> np.ndarray:
    """Log-likelihood ratio of terms in ``n`` of ``total`` texts, ``a`` of them toxic."""
    def part(k: np.ndarray, size: int, p: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.where(k > 0, k, 1) / np.where(k > 0, size * p, 1)), 0.0)

    p, rest, clean = n / total, (total - n) / total, total - toxic
    return np.maximum(0.0, 2 * (part(a, toxic, p) + part(n - a, clean, p) + part(toxic - a, toxic, rest) + part(clean - (n - a), clean, rest)))


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, block: int = BLOCK) -> dict:
    """The index of the labelled texts: the folder that its arrays lie in, the share of toxic labels and the scale of scores.

    ``docs``: ``doc_id, text``; ``labels``: ``doc_id, toxic``.  Held-out ids, null ids and null labels are left
    out; an id with several labels takes the largest.  Without labelled texts that have words
    the index is empty and every text scores the share of toxic labels (0.5 without labels).
    """
    marks = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    n = marks.count()
    if n > max_examples:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * max_examples / n))
    rows = (docs.select("doc_id", "text").join(marks, "doc_id")
            .withColumn("row", F.xxhash64("doc_id", "text")).select("doc_id", "toxic", "row", "text").dropDuplicates(["doc_id", "row"]))
    found = written(rows.mapInArrow(_terms, "doc_id long, toxic int, row long, terms array<string>, tf array<int>"), "toxic-terms")
    total, toxic = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    found = found.where(F.size("terms") > 0)
    spark = docs.sparkSession
    # One task builds the index of the bounded sample and leaves it in the shared folder; a second attempt writes a folder of its own.
    ordered = found.select("doc_id", "toxic", "row", "terms", "tf").repartition(1).sortWithinPartitions("doc_id", "row")
    path = scratch_path(spark, "toxic-index")
    built = ordered.mapInArrow(_build(path, block), "path string").first()
    if built is None:  # no examples, no task
        share(_arrays(iter(()), block), path)
    index = {"path": built["path"] if built else path, "base": toxic / total if total else 0.5, "block": block, "slope": 1.0, "shift": 0.0}
    if 0 < toxic < total:
        index["slope"], index["shift"] = _scale(found, index, min(1.0, SCALE_EXAMPLES / total))
    return index


def _build(path: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = f"{path}-{TaskContext.get().taskAttemptId()}"
        share(_arrays((b.slice(a, 256) for b in batches for a in range(0, b.num_rows, 256)), block), folder)
        yield pa.RecordBatch.from_arrays([pa.array([folder])], ["path"])
    return run


def opened(index: dict) -> dict:
    """A fitted index with its arrays."""
    return index | shared(index["path"], _ARRAYS)


def _arrays(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[str, np.ndarray]]:
    """The arrays of an index of examples (about ``max_examples`` rows, by ``doc_id`` and ``row``) with their terms.

    Terms are numbered batch by batch, so that their texts are held once.
    """
    sizes, marks, ids, tfs, codes = [], [], [], [], []
    number: dict[str, int] = {}
    for b in batches:
        sizes.append(pc.list_value_length(b.column("terms")).to_numpy())
        marks.append(b.column("toxic").to_numpy())
        ids.append(b.column("doc_id").to_numpy())
        tfs.append(_small(b.column("tf").flatten().to_numpy()))
        coded = b.column("terms").flatten().dictionary_encode()
        own = np.fromiter((number.setdefault(x, len(number)) for x in coded.dictionary.to_pylist()), dtype=np.int32, count=len(coded.dictionary))
        codes.append(own[coded.indices.to_numpy()])
    size, mark, doc_id, tf, code = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (sizes, marks, ids, tfs, codes))
    del tfs, codes
    names = sorted(number)
    place = np.empty(len(names), dtype=np.int32)
    place[[number[x] for x in names]] = np.arange(len(names), dtype=np.int32)
    del number
    t = place[code]
    del code, place
    texts = np.bincount(t, minlength=len(names))
    idf = np.log((1 + len(size)) / (1 + texts)) + 1
    order = np.arange(len(size))
    if len(size):
        idf *= 1 + np.sqrt(_ratio(np.bincount(t, np.repeat(mark, size), len(names)), texts, int(mark.sum()), len(size)))
        # Examples whose most frequent term is the same stand together: mostly those of a language.
        key = tf.astype(np.int32) * np.int32(len(size) + 1) + texts.astype(np.int32)[t] if int(tf.max()) < (1 << 31) // (len(size) + 2) else tf.astype(np.int64) * (len(size) + 1) + texts[t]
        starts = np.cumsum(size) - size
        most = np.flatnonzero(key == np.repeat(np.maximum.reduceat(key, starts), size))
        order = np.argsort(t[most[np.searchsorted(most, starts)]], kind="stable")
        del key, most
    e = np.repeat(np.argsort(order).astype(np.int32), size)
    by = np.lexsort((e, t)).astype(np.int32)
    t = t[by]
    e = e[by]
    tf = tf[by]
    del by
    return layout(names, idf, t, e, tf, mark[order].astype(float), doc_id[order], block)


def layout(names: list[str], idf: np.ndarray, t: np.ndarray, e: np.ndarray, tf: np.ndarray, toxic: np.ndarray, doc_id: np.ndarray, block: int,
           common: int = COMMON) -> Iterator[tuple[str, np.ndarray]]:
    """Arrays of an index of postings ``(term, example, tf)`` in order of term and example, one after another.

    ``top``: a term's largest weight in each block in 255ths of the largest of all (``unit``), rounded up.  ``common``, ``matrix``: the most
    frequent terms and their weights by example.  ``rare``, ``rare_count``: postings of the other terms, and their number
    by term and block.  ``own_*``: terms by example.  ``hashes``, ``by_hash``: terms by their hash.
    """
    size, count, blocks = len(names), len(toxic), -(-len(toxic) // block)
    yield "name_ends", np.cumsum([0, *(len(x.encode()) for x in names)]).astype(np.int32)
    yield "names", np.frombuffer("".join(names).encode(), dtype=np.uint8)
    hashes = _hashes_of(pa.array(names, pa.string()))
    by_hash = np.argsort(hashes, kind="stable").astype(np.int32)
    yield "hashes", hashes[by_hash]
    yield "by_hash", by_hash
    del hashes, by_hash, names
    yield from (("idf", idf), ("toxic", toxic), ("doc_id", doc_id))

    tf = _small(tf)
    w = (1 + np.log(np.maximum(1, np.arange(int(tf.max()) + 1 if len(tf) else 1)))).astype(np.float32)[tf]
    w *= idf.astype(np.float32)[t]
    norm, own_size, texts = np.zeros(count), np.zeros(count, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for a in range(0, len(w), PART):  # in parts: the postings are held once
        p = slice(a, a + PART)
        norm += np.bincount(e[p], w[p].astype(float) ** 2, count)
        own_size += np.bincount(e[p], minlength=count)
        texts += np.bincount(t[p], minlength=size)
    w /= np.sqrt(norm).astype(np.float32)[e]
    own = np.argsort(e, kind="stable").astype(np.int32)
    yield "own_start", np.r_[0, np.cumsum(own_size)]
    yield "own_term", t[own].astype(np.int32, copy=False)
    yield "own_weight", w[own]
    del own

    inside = e // block
    first = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (inside[1:] != inside[:-1])]) if len(t) else np.empty(0, dtype=np.int64)
    part = t[first].astype(np.int64) * blocks + inside[first]
    del inside
    often = np.sort(np.argsort(-texts, kind="stable")[:common])
    column = np.full(size, -1, dtype=np.int32)
    column[often] = np.arange(len(often))
    yield "common", column
    top, unit = np.zeros(size * blocks, dtype=np.uint8), np.float32(w.max() / 255) if len(w) else np.float32(1)
    top[part] = np.minimum(255, np.ceil((np.maximum.reduceat(w, first) if len(first) else w) / unit))
    yield "unit", np.array([unit])
    yield "top", top.reshape(size, blocks)
    del top
    counts = np.zeros(size * blocks, dtype=np.uint16)
    counts[part] = np.diff(np.r_[first, len(t)])
    counts = counts.reshape(size, blocks)
    counts[often] = 0
    yield "rare_count", counts
    del counts, first, part
    matrix = np.zeros((len(often), blocks * block), dtype=np.float32)
    for a in range(0, len(w), PART):
        p = slice(a, a + PART)
        dense = np.flatnonzero(column[t[p]] >= 0)
        matrix[column[t[p][dense]], e[p][dense]] = w[p][dense]
    yield "matrix", matrix
    del matrix
    other = np.flatnonzero(column[t] < 0)
    rare = np.empty(len(other), dtype=_POSTING)
    rare["example"], rare["weight"] = e[other], w[other]
    yield "rare", rare.view(np.uint64)


def _small(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the narrowest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


class Vectors:
    """Vectors of several texts, each of length one: ``row, term, weight`` in order of text and term."""

    def __init__(self, rows: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.rows, self.row, self.term = rows, row, term
        self.start = np.searchsorted(row, np.arange(rows + 1))
        length = np.sqrt(np.bincount(row, weight * weight, rows))
        self.weight = weight / length[row]


@cache
def _letters() -> np.ndarray:
    """For every code point whether it is part of a word."""
    out = np.zeros(0x110000, dtype=bool)
    for m in _WORD.finditer("".join(map(chr, range(len(out))))):
        out[m.start():m.end()] = True
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _hashes(codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of ``size`` code points, one after another in ``codes``: sums of code points times a factor of their place."""
    factor = np.arange(1, int(size.max(initial=0)) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        factor = (factor ^ (factor >> np.uint64(shift))) * np.uint64(by)
    start = np.cumsum(size) - size
    parts = (factor | np.uint64(1))[np.arange(len(codes)) - np.repeat(start, size)]
    parts *= codes
    out, some = np.zeros(len(size), dtype=np.uint64), size > 0
    if len(codes):
        out[some] = np.add.reduceat(parts, start[some])
    return out


def _hashes_of(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    words = words.cast(pa.string())
    begin, end = np.frombuffer(words.buffers()[1], dtype=np.int32)[[words.offset, words.offset + len(words)]].tolist()
    return _hashes(_codes(words.buffers()[2][begin:end].to_pybytes().decode()), pc.utf8_length(words).to_numpy().astype(np.int64))


class NearestExamples:
    """Exact nearest examples of texts under the fitted index."""

    def __init__(self, index: dict):
        self.__dict__.update({k: np.asarray(v) if isinstance(v, np.ndarray) else v for k, v in index.items()})
        self.size, self.count, self.unit = len(self.idf), len(self.toxic), float(index["unit"][0])
        self.blocks = self.top.shape[1]
        self.terms = pa.StringArray.from_buffers(self.size, pa.py_buffer(self.name_ends), pa.py_buffer(self.names))
        self.rare_start = np.r_[0, np.cumsum(self.rare_count.sum(axis=1, dtype=np.int64))]

    def _counted(self, rows: int, row: np.ndarray, term: np.ndarray, n: np.ndarray) -> Vectors:
        """Vectors of ``n`` occurrences of terms (-1: unknown) in texts."""
        known = term >= 0
        key = row[known] * np.int64(max(1, self.size)) + term[known]
        by = np.argsort(key)
        key, n = key[by], n[known][by]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=np.int64)
        row, term = key[first] // max(1, self.size), key[first] % max(1, self.size)
        tf = np.add.reduceat(n, first) if len(first) else n
        return Vectors(rows, row, term, (1 + np.log(tf.astype(float))) * self.idf[term])

    def _ids(self, names: pa.Array) -> np.ndarray:
        """Numbers of terms, -1 where unknown: looked up by hash, then compared."""
        if not (self.size and len(names)):
            return np.full(len(names), -1)
        h = _hashes_of(names)
        by = np.argsort(h)  # looked up in order: neighbouring places of the index
        at = np.empty(len(h), dtype=np.int64)
        at[by] = np.minimum(np.searchsorted(self.hashes, h[by]), self.size - 1)
        ids = np.where(self.hashes[at] == h, self.by_hash[at], -1)
        known = np.flatnonzero(ids >= 0)
        same = pc.equal(names.take(pa.array(known)), self.terms.take(pa.array(ids[known]))).to_numpy(zero_copy_only=False)
        ids[known[~same]] = -1
        return ids

    def vectors(self, texts: list[str | None]) -> Vectors:
        """Vectors of texts; empty for a text without known terms.  Words of a batch are told apart by their 64-bit hashes."""
        low = [(t or "").lower() for t in texts]
        ends = np.cumsum([len(t) + 1 for t in low])
        whole = "\n".join(low)
        del low
        codes = _codes(whole)
        inside = _letters()[codes]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        begin, end = edges[::2], edges[1::2]
        h = _hashes(codes[inside], end - begin)
        del codes, inside, edges
        by = np.argsort(h)
        first = np.diff(h[by], prepend=~h[by[:1]]) != 0
        word = np.empty(len(h), dtype=np.int64)
        word[by] = np.cumsum(first) - 1
        by = by[first]
        words = pa.array([whole[a:b] for a, b in zip(begin[by].tolist(), end[by].tolist())], pa.string())
        key, n = np.unique(np.searchsorted(ends, begin, side="right") * max(1, len(words)) + word, return_counts=True)
        row, word = key // max(1, len(words)), key % max(1, len(words))
        long = pc.utf8_length(words)
        ids = [self._ids(words)]
        for k in (4, 5):
            starts = pc.utf8_slice_codeunits(words, 0, k).dictionary_encode()  # far fewer than words
            x = self._ids(pc.binary_join_element_wise(starts.dictionary, "*", ""))[starts.indices.to_numpy()] if len(words) else ids[0]
            ids.append(np.where(pc.less(long, k).to_numpy(zero_copy_only=False), -1, x))
        ids = np.stack(ids)
        return self._counted(len(texts), np.tile(row, 3), ids[:, word].ravel(), np.tile(n, 3))

    def vectors_of_terms(self, terms: pa.ListArray, tf: pa.ListArray) -> Vectors:
        """Vectors of counted terms, as ``_terms`` gives them."""
        row = np.repeat(np.arange(len(terms)), pc.list_value_length(terms).to_numpy())
        return self._counted(len(terms), row, self._ids(terms.flatten()), tf.flatten().to_numpy().astype(np.int64))

    def _add_rare(self, c: np.ndarray, weight: np.ndarray, terms: np.ndarray, opens: np.ndarray) -> None:
        """Add to ``c``, a text's cosines, what its rare ``terms`` bring from the first to the last block of ``opens``."""
        blocks = np.flatnonzero(opens)
        if not (len(blocks) and len(terms)):
            return
        begin, end = self.rare_start[terms], self.rare_start[terms + 1]
        if blocks[0] > 0:
            begin = begin + self.rare_count[terms, :blocks[0]].sum(axis=1, dtype=np.int64)
        if blocks[-1] + 1 < self.blocks:
            end = end - self.rare_count[terms, blocks[-1] + 1:].sum(axis=1, dtype=np.int64)
        n = end - begin
        at = np.repeat(begin - np.cumsum(n) + n, n)
        at += np.arange(len(at))
        found = self.rare.take(at)
        parts = found.view(_POSTING)["weight"] * np.repeat(weight, n)
        found &= np.uint64(0xFFFFFFFF)  # the examples
        c += np.bincount(found.view(np.int64), parts, len(c))

    def _exact(self, place: np.ndarray, slot: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Cosines of examples with a text, in double precision; ``slot``: by term, the place in ``weight``, 0 where the text has it not."""
        ranges = list(map(slice, self.own_start[place].tolist(), self.own_start[place + 1].tolist()))
        n = self.own_start[place + 1] - self.own_start[place]
        parts = weight.take(slot.take(np.concatenate([self.own_term[x] for x in ranges])))
        parts *= np.concatenate([self.own_weight[x] for x in ranges])
        return np.add.reduceat(parts, np.cumsum(n) - n)

    def nearest(self, v: Vectors, k: int, skip: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and cosines of each text's ``k`` nearest examples with a common term, without the example ``skip``; ties go to the first place."""
        if not (self.blocks and len(v.row)):
            return [(np.empty(0, dtype=np.int64), np.empty(0))] * v.rows
        column = self.common[v.term]
        dense = np.zeros((v.rows, len(self.matrix)), dtype=np.float32)
        dense[v.row[column >= 0], column[column >= 0]] = v.weight[column >= 0]
        cosines, out = dense @ self.matrix, []
        slot = np.zeros(self.size, dtype=np.min_scalar_type(int(np.diff(v.start).max())))
        for c, lo, hi, own in zip(cosines, v.start[:-1].tolist(), v.start[1:].tolist(), [-1] * v.rows if skip is None else skip.tolist()):
            t, w, rare = v.term[lo:hi], v.weight[lo:hi], column[lo:hi] < 0
            rare_terms, weight = t[rare], w[rare].astype(np.float32)
            # What the common terms bring is known; a block's largest rare weights bound the rest.
            by_block = c.reshape(self.blocks, self.block)
            bound = by_block.max(axis=1) + self.unit * (weight @ self.top[rare_terms].astype(np.float32))
            first, last = int(bound.argmax()), 0.0
            start = first * self.block
            best = by_block[first, :self.count - start].copy()
            if 0 <= own - start < len(best):
                best[own - start] = -1
            if len(best) > k:  # a part of the cosines of k examples; the nearest reach the least of them
                last = float(np.partition(best, -k)[-k])
            opens = (bound > 0) & (bound >= last - ROUNDING)
            self._add_rare(c, weight, rare_terms, opens)
            place = np.flatnonzero((c > 0) & (c >= last - ROUNDING))
            place = place[place != own]
            if len(place) > k:
                place = place[c[place] >= np.partition(c[place], -k)[-k] - ROUNDING]
            slot[t] = np.arange(1, len(t) + 1)
            exact = self._exact(place, slot, np.r_[0.0, w]) if len(place) else np.empty(0)
            slot[t] = 0
            order = np.lexsort((place, -exact))[:k]
            out.append((place[order], exact[order]))
        return out

    def vote(self, place: np.ndarray, cos: np.ndarray) -> float:
        """Share of toxic among the neighbours by squared similarity, shrunk towards that of all labels."""
        votes = cos * cos
        return float((votes @ self.toxic[place] + PRIOR_WEIGHT * self.base) / (votes.sum() + PRIOR_WEIGHT)) if len(place) else self.base

    def score(self, text: str | None, k: int = NEIGHBOURS) -> tuple[float, list[dict]]:
        return self.scores([text], k)[0]

    def scores(self, texts: list[str | None], k: int = NEIGHBOURS) -> list[tuple[float, list[dict]]]:
        """Score and evidence of each text."""
        return [(scaled(self.vote(place, cos), self.slope, self.shift),
                 [{"doc_id": int(self.doc_id[p]), "similarity": round(float(c), 6), "toxic": int(self.toxic[p])} for p, c in zip(place[:3].tolist(), cos[:3].tolist())])
                for place, cos in self.nearest(self.vectors(texts), k)]


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def scaled(vote: float, slope: float, shift: float) -> float:
    """A vote on the logistic scale; the scale ``1, 0`` leaves it as it is."""
    return vote if (slope, shift) == (1.0, 0.0) else float(1 / (1 + np.exp(-(slope * _log_odds(np.array(vote)) + shift))))


def logistic(votes: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the scale by maximum likelihood, with targets just inside 0 and 1; ``1, 0`` if that does not rise with the vote."""
    x, high = _log_odds(votes), toxic > 0
    y = np.where(high, (high.sum() + 1) / (high.sum() + 2), 1 / ((~high).sum() + 2))
    a = np.array([1.0, 0.0])
    design = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-6 * np.eye(2), design.T @ (y - p))
        a = a + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(a[0]), float(a[1])) if a[0] > 0 else (1.0, 0.0)


def _votes(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(held)
        for b in (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)):
            places = {(i, s): p for p, (i, s) in enumerate(zip(search.doc_id.tolist(), np.diff(search.own_start).tolist()))}
            own = np.array([places.get((i, len(t)), -1) for i, t in zip(b.column("doc_id").to_pylist(), b.column("terms"))])
            got = search.nearest(search.vectors_of_terms(b.column("terms"), b.column("tf")), NEIGHBOURS, own)
            yield pa.RecordBatch.from_arrays([pa.array([search.vote(*x) for x in got], pa.float64()), b.column("toxic")], ["vote", "toxic"])
    return run


def _scale(found: DataFrame, index: dict, part: float) -> tuple[float, float]:
    """The scale of scores, from the votes of some examples among all others."""
    held = _held(found.sparkSession, index)
    some = found.where(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(1 << 40)) < int((1 << 40) * part))
    rows = some.select("doc_id", "toxic", "terms", "tf").mapInArrow(_votes(held), "vote double, toxic int").toArrow()  # about SCALE_EXAMPLES rows
    votes, toxic = rows["vote"].to_numpy(), rows["toxic"].to_numpy()
    return logistic(votes, toxic) if 0 < (toxic > 0).sum() < len(toxic) else (1.0, 0.0)


def _held(spark: SparkSession, index: dict):
    return spark.sparkContext.broadcast(dict(index))


def _search(held) -> NearestExamples:
    """One per Python process."""
    return held.value.get("search") or held.value.setdefault("search", NearestExamples(opened(held.value)))


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Slices of at most ``ROWS`` texts and about ``PART_CHARS`` characters, at least one text each."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and (size + len(t or "") > PART_CHARS or i - a == ROWS):
            yield a, i
            a, size = i, 0
        size += len(t or "")
    if texts:
        yield a, len(texts)


def _scored(held, schema: pa.Schema, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(held)
        for whole in (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)):
            texts = whole.column("text").to_pylist()
            for lo, hi in _parts(texts):
                b, out = whole.slice(lo, hi - lo), search.scores(texts[lo:hi])
                cols = [b.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([round(s, 6) for s, _ in out], pa.float64()),
                                                  pa.array([e for _, e in out], schema.field("evidence").type)], [*keep, "score", "evidence"])
    return run


def score_texts(docs: DataFrame, index: dict, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``score`` and ``evidence`` (the three nearest examples).

    Null and empty texts, and texts without known terms, score as the share of toxic labels does.
    """
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
    types = dict(docs.dtypes)
    schema = pa.schema([("score", pa.float64()), ("evidence", kind)])
    spec = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "score double", "evidence array<struct<doc_id: long, similarity: double, toxic: int>>"])
    held = _held(docs.sparkSession, index)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_scored(held, schema, keep), spec)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` of every row of ``docs (doc_id, text)``.

    Repeated rows give repeated results; a null id is not held out; an empty table gives an empty result.
    """
    scored = score_texts(docs.select("doc_id", "text"), fit(docs, labels), ["doc_id"])
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns unchanged."""
    cols = docs.columns
    renamed = docs.select(*[F.col(f"`{c}`").alias(c if c == "text" else f"__{c}") for c in cols])
    kept = score_texts(renamed, fit(docs, labels), renamed.columns).where(F.col("score") < threshold)
    return kept.select(*[F.col(f"`{x}`").alias(c) for x, c in zip(renamed.columns, cols)])


def op9_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by its nearest labelled examples."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
