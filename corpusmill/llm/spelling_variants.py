"""Operator 13, spelling variants by composing the vocabulary's acceptor with a one-edit transducer.

Words that differ by one inserted, deleted or replaced character agree on their first or on their last half, so the
vocabulary is dealt by half words: a bucket holds the words of length ``m`` and ``m + 1`` that share ``m // 2`` first or the
other last characters, and its start state stands behind the shared half.  A bucket of more than ``LIMIT`` words
is split again the same way over the half that is left.  Buckets are dealt over tasks.

A task builds one minimised acceptor over the rests of many buckets, each bucket with its initial state.  It composes
acceptor, one-edit transducer and acceptor without building the product: before the edit both copies are in the
same state, an edit parts them into two states, and behind it the words' ends are those that both states accept.  State
pairs that accept no common end are remembered.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import table, written

MIN_LENGTH, MIN_COUNT, DROP_EVERY, FACTOR = 5, 3, 97, 2
FLUSH, LIMIT, BATCH = 200_000, 20_000, 50_000

#: Letters A-Z and U+00C0 to U+00FF, after A-Z are lower-cased.
_LETTERS = "a-zÀ-ÿ"


def counted_runs(text: str | None, doc_id: int | None, min_length: int = MIN_LENGTH, drop_every: int = DROP_EVERY) -> Iterator[tuple[str, int]]:
    """Runs of letters of a text, some with a character deleted by their hash, and how often each occurs."""
    runs = Counter(re.findall(f"[{_LETTERS}]{{{min_length},}}", (text or "").encode().lower().decode()))
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for w, n in runs.items():
        h = zlib.crc32(w.encode(), seed)
        if h % drop_every == 0:
            w = w[:(i := h % len(w))] + w[i + 1:]
            if len(w) < min_length:
                continue
        yield w, n


def _counts(min_length: int, drop_every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                for w, n in counted_runs(text.as_py(), doc_id, min_length, drop_every):
                    held[w] += n
                if len(held) >= FLUSH:
                    yield batch()
                    held.clear()
        if held:
            yield batch()
    return run


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """``word, n`` of the words of ``docs (doc_id, text)`` that occur often enough."""
    found = docs.select("doc_id", "text").mapInArrow(_counts(min_length, drop_every), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# --- buckets --------------------------------------------------------------------------------------

def _halved(rows: DataFrame) -> DataFrame:
    """Buckets ``(key, m, rest, word, n)`` dealt again by the first and by the last half of their rests."""
    m, rest = F.col("m"), F.col("rest")
    half, size = F.floor(m / 2).cast("int"), F.length("rest")
    behind = m - half  # characters of the last half

    def bucket(side: str, m: Column, shared: Column, left: Column) -> Column:
        return F.struct(F.concat("key", F.lit(side), shared).alias("key"), m.cast("int").alias("m"), left.alias("rest"))

    first = bucket("<", behind, F.substr(rest, F.lit(1), half), F.substr(rest, half + 1))
    last = bucket(">", half, F.substr(rest, size - behind + 1), F.substr(rest, F.lit(1), size - behind))
    return rows.select(F.explode(F.array(first, last)).alias("b"), "word", "n").select("b.*", "word", "n")


def buckets(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``words (word, n)`` dealt into buckets ``(key, m, rest, word, n)``, none of many more than ``limit`` words.

    Two words one edit apart share a bucket, and their rests are one edit apart.  When a rest has but one character
    there are no more words in a bucket than pairs of characters, so splitting ends there.
    """
    size = F.length("word")
    rows = words.select(F.explode(F.array(size, size - 1)).alias("m"), F.col("word").alias("rest"), "word", "n")
    rows = _halved(rows.select(F.concat(F.col("m").cast("string"), F.lit(":")).alias("key"), "m", "rest", "word", "n"))
    while True:
        rows = written(rows, "variant-buckets")
        large = written(rows.where("m > 1").groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > limit).select("key"), "variant-large")
        if large.isEmpty():
            return rows
        rows = rows.join(large, "key", "left_anti").unionByName(_halved(rows.join(large, "key", "left_semi")))


# --- composition ----------------------------------------------------------------------------------

class Acceptor:
    """A minimised acyclic automaton over many sets of words; equal states of different sets are one."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.register: dict[tuple, int] = {}
        self.empty: set[tuple[int, int]] = set()  # state pairs without a common end

    def add(self, words: list[str]) -> int:
        """The initial state of a set of different words in ascending order."""
        open_: list[tuple[dict[str, int], list[bool]]] = [({}, [False])]  # states on the way to the last word
        last = ""

        def close(depth: int) -> None:
            while len(open_) > depth + 1:
                state = self._state(*open_.pop())
                open_[-1][0][last[len(open_) - 1]] = state

        for w in words:
            shared = 0
            for a, b in zip(w, last):
                if a != b:
                    break
                shared += 1
            close(shared)
            open_.extend(({}, [False]) for _ in range(len(w) - shared))
            open_[-1][1][0] = True
            last = w
        close(0)
        return self._state(*open_.pop())

    def _state(self, arcs: dict[str, int], final: list[bool]) -> int:
        signature = (final[0], *arcs.items())
        if (state := self.register.get(signature)) is None:
            state = self.register[signature] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final[0])
        return state

    def common(self, p: int, q: int, without: str = "") -> Iterator[str]:
        """The words that both states accept, but those that begin with ``without``."""
        if (p, q) in self.empty:
            return
        arcs, final = self.arcs, self.final
        hit = final[p] and final[q]
        if hit:
            yield ""
        whole = not without  # only then does finding nothing say that there is nothing
        frames = [(p, q, "", iter([c for c in arcs[p] if c in arcs[q] and c != without]), [hit])]
        while frames:
            p, q, w, way, found = frames[-1]
            for c in way:
                a, b = arcs[p][c], arcs[q][c]
                if (a, b) in self.empty:
                    continue
                hit = final[a] and final[b]
                if hit:
                    yield w + c
                frames.append((a, b, w + c, iter([x for x in arcs[a] if x in arcs[b]]), [hit]))
                break
            else:
                frames.pop()
                if found[0]:
                    if frames:
                        frames[-1][4][0] = True
                elif frames or whole:
                    self.empty.add((p, q))

    def near(self, start: int) -> Iterator[tuple[str, str]]:
        """Accepted pairs of words from a common start state that are one edit apart, each once, the longer one first."""
        stack = [(start, "")]
        while stack:
            s, before = stack.pop()
            arcs = self.arcs[s]
            ways = list(arcs.items())
            for i, (a, p) in enumerate(ways):
                for b, q in ways[i + 1:]:  # replaced
                    for end in self.common(p, q):
                        yield before + a + end, before + b + end
                for end in self.common(p, s, without=a):  # inserted, behind equal characters
                    yield before + a + end, before + end
                stack.append((p, before + a))


def _compose(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, dict[str, tuple[str, int]]]] = []  # buckets of two words or more
        size, key = 0, None

        def pairs() -> Iterator[pa.RecordBatch]:
            acceptor, rows = Acceptor(), []
            for _, m, words in held:
                start = acceptor.add(list(words))
                for u, v in acceptor.near(start):
                    if min(len(u), len(v)) == m:  # others meet in their own bucket
                        (a, x), (b, y) = words[u], words[v]
                        rows += ((a, b, y), (b, a, x))
                        if len(rows) >= BATCH:
                            yield batch(rows)
                            rows = []
            if rows:
                yield batch(rows)

        def batch(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], ["word", "near", "near_n"])

        for b in batches:
            for k, m, rest, word, n in zip(*(b.column(c).to_pylist() for c in ("key", "m", "rest", "word", "n"))):
                if k != key:
                    if held and len(held[-1][2]) == 1:
                        held.pop()
                        size -= 1
                    if size >= limit:
                        yield from pairs()
                        held, size = [], 0
                    key = k
                    held.append((k, m, {}))
                held[-1][2][rest] = (word, n)
                size += 1
        if held:
            yield from pairs()
    return run


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``word, near, near_n``: both directions of every pair of different ``words (word, n)`` one edit apart."""
    dealt = buckets(words, limit).repartition("key").sortWithinPartitions("key", "rest")
    found = dealt.mapInArrow(_compose(limit), "word string, near string, near_n long")
    return found.groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms (word, form)``: the last form, found by doubling steps."""
    rows = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = rows.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if rows.join(ahead, "root", "left_semi").isEmpty():
            return rows
        rows = written(rows.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variant-roots")


def spelling_variants(docs: DataFrame, min_count: int = MIN_COUNT, factor: int = FACTOR, limit: int = LIMIT) -> DataFrame:
    """Words of ``docs (doc_id, text)`` with the frequent spelling that each is a variant of.

    Returns ``word, form, root, n, n_near, form_n``.  Null and empty texts hold no words; a null id counts as an empty one in the
    hash; repeated rows count again; an empty table gives an empty result.
    """
    words = written(vocabulary(docs, min_count=min_count), "variant-words")
    near = near_words(words, limit)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("low"), "near")).alias("best"))
    far = -F.col("best.low")
    rows = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(far >= factor * F.col("n"), F.col("best.near")).alias("form"), F.when(far >= factor * F.col("n"), far).alias("form_n")), "variant-forms")
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling_variants(table(spark, sf_dir, "documents"))
