"""Operator 10, SimHash near-dedup with deletion-variant signatures.

A text's 64-bit fingerprint takes the majority of each bit over the XXH64 values of its word shingles.
To find fingerprints at most ``max_bits`` apart, the 64 bits are cut into so few segments that of any
such pair one segment differs by at most one bit: ``max_bits // 2 + 1`` segments.  Every fingerprint is
indexed under each of its segments with one bit struck out (64 variants).  Fingerprints that agree in a
segment but for one bit share a variant; an equality join on the variants finds them, and the full
fingerprints verify the distance.

Rows with equal fingerprints form one class, so copies cost nothing beyond the first; the index holds
classes only.  Of the links found in a task only a spanning forest leaves it, which is all that the
groups need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import components, table, written

SHINGLE_WORDS, MAX_BITS, SEED = 4, 4, 42
SMALL_RUN, TILE = 64, 2048
ROWS = 256  # texts in Python at a time


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash; a null text, or one without words, gives 0."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):  # a slice of a very long text
        part = h[at:at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(texts: pa.Array, words: int = SHINGLE_WORDS) -> pa.Array:
    return pa.array([fingerprint(t, words) for a in range(0, len(texts), ROWS) for t in texts.slice(a, ROWS).to_pylist()], pa.int64())


def with_fingerprint(docs: DataFrame, words: int = SHINGLE_WORDS, name: str = "fp") -> DataFrame:
    """Add the signed fingerprint of ``text``."""
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return fingerprints(texts, words)

    return docs.withColumn(name, of(F.col("text")))


def segments(max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """``(first bit, bits)`` of the segments."""
    n = max_bits // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows ``(bit, rest, fp)``: for every bit, the other bits of its segment."""
    out = []
    for first, n in segments(max_bits):
        mask = (1 << n) - 1
        seg = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit(mask).cast("long")) if n < 64 else F.col("fp")
        for j in range(n):
            keep = np.int64(np.uint64(mask & ~(1 << j))).item()
            out.append(F.struct(F.lit(first + j).alias("bit"), seg.bitwiseAND(F.lit(keep).cast("long")).alias("rest")))
    return fps.select("fp", F.explode(F.array(*out)).alias("v")).select("v.bit", "v.rest", "fp")


class _Forest:
    """Union-find over the links seen by one task."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (y := self.up.get(root, root)) != root:
            root = y
        while (y := self.up.get(x, x)) != root:
            self.up[x], x = root, y
        return root

    def add(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """The pairs that join two trees."""
        new = []
        for x, y in zip(a.tolist(), b.tolist()):
            r, s = self.find(x), self.find(y)
            if r != s:
                self.up[max(r, s)] = min(r, s)
                new.append((x, y))
        return new


def _close_pairs(starts: np.ndarray, lengths: np.ndarray, fp: np.ndarray, max_bits: int):
    """Index pairs within runs of equal keys whose fingerprints are close, as arrays."""
    small = lengths <= SMALL_RUN
    s, n = starts[small], lengths[small]
    if len(s):
        left = np.zeros(len(fp), dtype=np.int64)  # rows that follow in the same run
        at = np.concatenate([np.arange(a, a + k) for a, k in zip(s.tolist(), n.tolist())])
        left[at] = np.repeat(s + n, n) - at - 1
        for d in range(1, SMALL_RUN):
            i = at[left[at] >= d]
            if not len(i):
                break
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= max_bits]
            if len(i):
                yield i, i + d
    for a, k in zip(starts[~small].tolist(), lengths[~small].tolist()):
        for x in range(a, a + k, TILE):
            for y in range(x, a + k, TILE):
                p, q = fp[x:min(x + TILE, a + k)], fp[y:min(y + TILE, a + k)]
                i, j = np.nonzero(np.bitwise_count(p[:, None] ^ q[None, :]) <= max_bits)
                if x == y:
                    i, j = i[i < j], j[i < j]
                yield i + x, j + y


def _links(max_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, kept = _Forest(), None

        def close(df: pd.DataFrame) -> pd.DataFrame:
            bit, rest, fp = (df[c].to_numpy() for c in ("bit", "rest", "fp"))
            new = np.flatnonzero(np.r_[True, (bit[1:] != bit[:-1]) | (rest[1:] != rest[:-1])])
            n = np.diff(np.r_[new, len(fp)])
            u = fp.view(np.uint64)
            found = [p for i, j in _close_pairs(new[n > 1], n[n > 1], u, max_bits) for p in forest.add(fp[i], fp[j])]
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

        for df in batches:
            df = df if kept is None else pd.concat([kept, df], ignore_index=True)
            bit, rest = df["bit"].to_numpy(), df["rest"].to_numpy()
            last = np.flatnonzero((bit != bit[-1]) | (rest != rest[-1])) if len(df) else []
            cut = last[-1] + 1 if len(last) else 0  # the last run may go on in the next batch
            kept = df.iloc[cut:]
            if cut:
                yield close(df.iloc[:cut])
        if kept is not None and len(kept):
            yield close(kept)
    return run


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp``, enough to connect all that are close."""
    v = variants(fps, max_bits)
    return (v.repartition("bit", "rest").sortWithinPartitions("bit", "rest", "fp")
            .mapInPandas(_links(max_bits), "a long, b long").distinct())


def fingerprint_groups(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Groups of ``docs (doc_id, fp)``: rows ``fp, first_doc, group_fp, component_id`` per distinct fingerprint.

    ``first_doc`` is the smallest id with this fingerprint, ``component_id`` the smallest of the group
    (null where the group has only null ids).
    """
    classes = written(docs.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-classes")
    comp = components(fingerprint_links(classes.select("fp"), max_bits))
    g = (classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
         .select("fp", "first_doc", F.coalesce("component", "fp").alias("group_fp")))
    first = g.groupBy("group_fp").agg(F.min("first_doc").alias("component_id"))
    return g.join(first, "group_fp")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Fingerprint and component of every row of ``docs`` (``doc_id, text``; other columns are ignored).

    Returns ``doc_id, fingerprint`` (16 hex digits)``, component_id``.  Null and empty texts have
    fingerprint zero and are linked like any other.  Rows with a null id take part and get their group's
    smallest id; repeated ids give as many rows.  An empty table gives an empty result.
    """
    f = written(with_fingerprint(docs.select("doc_id", "text"), words).select("doc_id", "fp"), "simhash")
    g = fingerprint_groups(f, max_bits).select("fp", "component_id")
    return f.join(g, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest id, all columns unchanged.

    Rows that repeat this id with the same fingerprint collapse to one; a group of null ids keeps one row.
    """
    names = docs.columns
    docs = docs.toDF(*[c if c in ("doc_id", "text") else f"__c{i}" for i, c in enumerate(names)])  # no name of theirs meets one of ours
    row = F.xxhash64("doc_id", "text").alias("__row")
    f = written(with_fingerprint(docs.select("doc_id", "text", row), words).select("doc_id", "__row", "fp"), "simhash")
    g = fingerprint_groups(f.select("doc_id", "fp"), max_bits).select("fp", "group_fp", "component_id")
    first = f.join(g, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = first.groupBy("group_fp").agg(F.min("__row").alias("__row")).select("__row")
    # The row's hash stands for its text, so no fingerprint is computed twice; ids and hashes are nearly unique.
    return (docs.withColumn("__row", row).join(stay, "__row", "left_semi").dropDuplicates(["__row"])
            .select(*docs.columns).toDF(*names))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document (4-word shingles, 4 bits)."""
    return near_duplicates(table(spark, sf_dir, "documents"))
