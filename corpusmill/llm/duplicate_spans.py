"""Operator 6, exact substring dedup with suffix arrays built by induced sorting.

Every byte covered by a ``LENGTH``-byte string (a window) that starts at another place of the corpus too goes.

1. Candidates.  Each window is owned by an anchor: the ``GRAM`` bytes in it with the smallest rolling hash, the
   leftmost if several.  Equal windows have equal anchors at the same distance, so windows whose anchor's hash
   stands at one place only are unique; nothing else is left out.
2. Segments.  For each other anchor the bytes of the windows it owns are cut out.  Equal segments become one class
   with its number of places.
3. Shards.  The classes of a hash meet in one task, many hashes per task.  The task builds the suffix array of its
   classes by induced sorting and their permuted common prefixes: a window is a repeat when it shares ``LENGTH`` bytes
   with a neighbour, or its class has several places.
4. The repeated windows of all places are united per text, and the bytes that are left are joined.

Texts are told apart by digest: equal texts are read once, and their windows all repeat.  A hash with more than
``CROWD`` classes (one line in many different surroundings) would fill a task; its windows are counted by their
128-bit BLAKE2 digest instead, spread over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import table, written
from corpusmill.llm.suffix_arrays import common_prefixes, suffix_array

LENGTH, GRAM, PIECE, SHARD_BYTES, CROWD = 400, 128, 1 << 19, 2_000_000, 3000
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD
_PLACE = np.uint64((1 << 20) - 1)


class Roller:
    """Rolling hashes modulo 2 ** 64 of pieces of up to ``2 * PIECE`` bytes."""

    def __init__(self, base: int = _BASE, size: int = 2 * PIECE):
        self.powers = np.cumprod(np.r_[1, np.full(size, base, dtype=np.uint64)].astype(np.uint64))
        self.inverse = np.cumprod(np.r_[1, np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)].astype(np.uint64))

    def grams(self, x: np.ndarray, k: int) -> np.ndarray:
        """Hash of the ``k`` bytes at each place."""
        n = len(x)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * self.inverse[:n - k + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(_MIX)
        return h ^ (h >> np.uint64(32))

    def anchors(self, x: np.ndarray, whole: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
        """``(first window, last window, anchor, hash)`` of the windows marked in ``whole``, by owner."""
        h = self.grams(x, gram)
        key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        w = length - gram + 1
        pad = np.full(-(-len(key) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        pad[:len(key)] = key
        rows = pad.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(x) - length + 1
        at = (np.minimum(back[:n], ahead[w - 1:w - 1 + n]) & _PLACE).astype(np.int64)
        first = np.flatnonzero(whole & np.r_[True, (at[1:] != at[:-1]) | ~whole[:-1]])
        last = np.flatnonzero(whole & np.r_[(at[1:] != at[:-1]) | ~whole[1:], True])
        return first, last, at[first], h[at[first]]


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
    """Bytes of many texts, or of part of a long one: ``(bytes, whole windows, [(text, place in bytes, offset in text)])``."""
    def piece(part: list[tuple[int, int, bytes]]):
        x = np.frombuffer(b"".join(p[2] for p in part), dtype=np.uint8)
        whole, where, at = np.zeros(max(0, len(x) - length + 1), dtype=bool), [], 0
        for i, offset, b in part:
            whole[at:at + len(b) - length + 1] = True
            where.append((i, at, offset))
            at += len(b)
        return x, whole, where

    part, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(0, len(t) - length + 1), PIECE):
            b = t[a:a + PIECE + length - 1]
            if part and size + len(b) > PIECE:
                yield piece(part)
                part, size = [], 0
            part.append((i, a, b))
            size += len(b)
    if part:
        yield piece(part)


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _anchors(length: int, gram: int):
    names = ["key", "lo", "hi", "at", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, seen = Roller(), set()
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                digests = {hashlib.md5(t).digest(): t for t in _bytes(batch.column("text").slice(a, 1024))}
                fresh = [d for d in digests if d not in seen]  # a task reads each text once, however many copies it has
                seen.update(fresh)
                texts, keys = [digests[d] for d in fresh], pa.array(fresh, pa.binary())
                for x, whole, where in _pieces(texts, length):
                    lo, hi, at, h = roller.anchors(x, whole, length, gram)
                    which, place, offset = (np.array(c) for c in zip(*where))
                    i = np.searchsorted(place, lo, "right") - 1
                    move = offset[i] - place[i]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(which[i])), *(pa.array(v + move) for v in (lo, hi, at)),
                                                      pa.array(h.view(np.int64))], names)
    return run


def _segments(length: int):
    names = ["h", "digest", "key", "lo", "windows", "segment"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, hits in zip(batch.column("key").to_pylist(), _bytes(batch.column("text")), batch.column("hits")):
                hits = hits.as_py()
                for a in range(0, len(hits), 4096):
                    rows = []
                    for x in hits[a:a + 4096]:
                        seg = text[x["lo"]:x["hi"] + length]
                        digest = hashlib.md5(seg + (x["at"] - x["lo"]).to_bytes(4, "little")).digest()
                        rows.append((x["h"], digest, key, x["lo"], x["hi"] - x["lo"] + 1, seg))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    return run


def repeated_windows(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each of several different segments, the places of windows that also stand elsewhere among them."""
    size = np.array([len(x) for x in segments])
    ends = np.cumsum(size + 1)  # a separator follows each segment
    starts = ends - size - 1
    s = np.zeros(int(ends[-1]) + 1, dtype=np.uint16)
    s[:-1] = np.frombuffer(b"\0".join([*segments, b""]), dtype=np.uint8)
    s[:-1] += 2
    s[ends - 1] = 1
    sa = suffix_array(s, length)
    long = common_prefixes(s, sa, starts, int(size.max()) + 8) >= length
    shared = long.copy()
    before = np.r_[-1, sa[:-1]]
    pairs = long[sa]
    shared[before[pairs]] = True
    # A common prefix may run on behind the end of a segment; only windows inside one count.
    return [np.flatnonzero(shared[a:a + max(0, n - length + 1)]) for a, n in zip(starts.tolist(), size.tolist())]


def _runs(places: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.r_[0, cut + 1]].tolist(), places[np.r_[cut, len(places) - 1]].tolist())) if len(places) else []


def _repeats(length: int, shard_bytes: int):
    schema = pa.schema([("h", pa.int64()), ("digest", pa.binary()), ("lo", pa.int64()), ("hi", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, shard, size, last = [], [], 0, None  # classes of the present hash; classes of the present shard

        def close_group() -> list[tuple]:
            nonlocal size
            out = [(h, d, 0, w - 1) for h, d, w, n, _ in group if n > 1]
            if len(group) > 1:
                shard.extend(group)
                size += sum(len(g[4]) for g in group)
            group.clear()
            return out

        def close_shard() -> list[tuple]:
            nonlocal size
            found = repeated_windows([g[4] for g in shard], length) if shard else []
            out = [(g[0], g[1], a, b) for g, x in zip(shard, found) if g[3] == 1 for a, b in _runs(x)]
            shard.clear()
            size = 0
            return out

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in ("h", "digest", "windows", "places", "segment"))):
                if row[0] != last:
                    out += close_group()
                    last = row[0]
                    if size >= shard_bytes:
                        out += close_shard()
                group.append(row)
            if out:
                yield batch(out)
        if out := close_group() + close_shard():
            yield batch(out)
    return run


def _window_digests(length: int):
    names = ["h", "digest", "lo", "window"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, digest, seg in zip(*(batch.column(c).to_pylist() for c in ("h", "digest", "segment"))):
                found = [hashlib.blake2b(seg[i:i + length], digest_size=16).digest() for i in range(len(seg) - length + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(found), pa.int64()), pa.array([digest] * len(found), pa.binary()),
                                                  pa.array(np.arange(len(found))), pa.array(found, pa.binary())], names)
    return run


def _cut(length: int, keep_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, spans in zip(batch.column("key").to_pylist(), _bytes(batch.column("text")), batch.column("spans")):
                merged: list[list[int]] = []
                for x in sorted((x["lo"], x["hi"]) for x in spans.as_py()):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1] + length)
                    else:
                        merged.append([x[0], x[1] + length])
                at, kept = 0, []
                for a, b in merged:
                    kept.append(text[at:a])
                    at = b
                rest = b"".join([*kept, text[at:]])
                rows.append((key, len(text) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest if keep_bytes else None))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()))],
                                             ["key", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, crowd: int = CROWD,
                    keep_bytes: bool = False) -> DataFrame:
    """Remove all repeated ``length``-byte strings from ``docs (doc_id, text)``.

    Returns per row ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``keep_bytes``, ``kept``.  Texts are
    taken as UTF-8 bytes; null counts as empty; nothing shorter than ``length`` repeats.  Rows with equal texts lose all
    of them, whatever their ids (null or repeated).  An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = docs.select("doc_id", text.alias("text"))
    key = F.unhex(F.md5("text")).alias("key")
    rows = written(docs.select("doc_id", key, F.length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "span-texts")
    long = docs.where(F.length("text") >= length)

    anchors = written(long.select("text").mapInArrow(_anchors(length, gram), "key binary, lo long, hi long, at long, h long"), "span-anchors")
    place = F.xxhash64("key", "lo")
    again = anchors.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a < b").select("h")
    hits = anchors.join(again, "h", "left_semi").groupBy("key").agg(F.collect_set(F.struct("lo", "hi", "at", "h")).alias("hits"))
    texts = written(long.select(key, "text").dropDuplicates(["key"]).join(hits, "key"), "span-hits")

    places = written(texts.mapInArrow(_segments(length), "h long, digest binary, key binary, lo long, windows long, segment binary"), "span-segments")
    classes = written(places.groupBy("h", "digest").agg(F.count(F.lit(1)).alias("places"), F.first("windows").alias("windows"),
                                                        F.first("segment").alias("segment")), "span-classes")
    crowded = classes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("h")
    found = (classes.join(crowded, "h", "left_anti").repartition("h").sortWithinPartitions("h", "digest")
             .mapInArrow(_repeats(length, shard_bytes), "h long, digest binary, lo long, hi long"))
    windows = classes.join(crowded, "h", "left_semi").mapInArrow(_window_digests(length), "h long, digest binary, lo long, window binary")
    windows = written(windows.join(classes.select("h", "digest", "places"), ["h", "digest"]), "span-windows")
    twice = windows.groupBy("window").agg(F.sum("places").alias("n")).where("n > 1")
    found = found.unionByName(windows.join(twice, "window", "left_semi").select("h", "digest", "lo", F.col("lo").alias("hi")))

    spans = (places.select("h", "digest", "key", F.col("lo").alias("at")).join(found, ["h", "digest"])
             .groupBy("key").agg(F.collect_set(F.struct((F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))).alias("spans")))
    cut = texts.select("key", "text").join(spans, "key").mapInArrow(
        _cut(length, keep_bytes), "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary")
    copies = rows.where(F.col("n_bytes") >= length).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = copies.select("key", F.lit(True).alias("gone"))
    nothing = hashlib.sha256(b"").hexdigest()
    out = rows.join(cut, "key", "left").join(gone, "key", "left").select(
        "doc_id", "key", "n_bytes", F.when(F.col("gone"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("gone"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("gone"), nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"), "kept")
    if not keep_bytes:
        return out.drop("key", "kept")
    whole = docs.select(key, "text").dropDuplicates(["key"])
    return out.join(whole, "key").withColumn("kept", F.when(F.col("n_removed") == F.col("n_bytes"), F.lit(b"")).otherwise(
        F.coalesce("kept", "text"))).drop("key", "text")


def op6_duplicate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in no 400-byte string found elsewhere: counts and digest."""
    return without_repeats(table(spark, sf_dir, "documents"))
