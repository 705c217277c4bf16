"""Operator 12, SentencePiece encoding and decoding by vectorised merge rounds.

A text is cut into words at places that no piece of the vocabulary crosses (before a space mark that follows anything
else); the different words of many texts are then encoded at once.  Their symbols lie in one flat array.  In each round every
word finds the smallest rank among its pairs (a segmented minimum), merges that pair's occurrences from the left, and the
array is compacted; words without a pair leave it, and the rounds end when none is left.

The result is that of merging one best pair at a time: an occurrence waits for a later round when an earlier merge of
this round made a pair that is as good or better.  Words of more than ``LONG`` symbols, which would take
a round for nearly every symbol, go through a queue of pairs instead.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.common import table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
LONG = 1000  # symbols
CACHE_WORDS, ROWS, PART_CHARS = 300_000, 256, 1 << 22
_NONE = np.iinfo(np.int32).max


class PieceMerger:
    """The merges of a SentencePiece BPE model.

    Symbols are numbered: pieces by their id, then the characters that occur only inside pieces.  A character that no piece
    holds is ``-1 - code point``.
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: np.ndarray, first: int = 0):
        """``pieces``: text and score of the pieces with ids from ``first`` on; ``byte_ids``: the ids of the 256 bytes."""
        self.first, self.byte_ids = first, byte_ids
        names = [p for p, _ in pieces]
        self.size = len(names)
        number = {p: i for i, p in enumerate(names)}
        for c in sorted({c for p in names for c in p} - number.keys()):
            number[c] = len(number)
        level = {s: i for i, s in enumerate(sorted({s for _, s in pieces}, reverse=True))}
        found = sorted((number[p[:k]] * len(number) + number[p[k:]], level[s], number[p])
                       for p, s in pieces for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
        self.count = len(number)
        self.key = np.array([k for k, _, _ in found] + [np.iinfo(np.int64).max], dtype=np.int64)
        self.level = np.array([r for _, r, _ in found] + [0], dtype=np.int32)
        self.merged = np.array([m for _, _, m in found] + [0], dtype=np.int32)
        self.symbol = -1 - np.arange(0x110000, dtype=np.int32)
        self.char = np.zeros(self.count, dtype=np.int32)
        for p, i in number.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
                self.char[i] = ord(p)
        self.cut = not any(SPACE in p[1:].replace(SPACE, "") or re.search(f"[^{SPACE}]{SPACE}", p) for p in names)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of symbol pairs; the rank is the largest number where they do not merge."""
        key = np.where((a < 0) | (b < 0), -1, a.astype(np.int64) * self.count + b)
        at = np.searchsorted(self.key, key)
        return np.where(self.key[at] == key, self.level[at], _NONE), self.merged[at]

    def rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of each word, in order, and their words."""
        done = []
        last = np.r_[word[1:] != word[:-1], True] if len(word) else np.empty(0, dtype=bool)
        rank, new = self.pairs(symbols, np.r_[symbols[1:], -1][:len(symbols)])
        rank[last] = _NONE
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            open_ = least < _NONE
            if not open_.all():
                done.append((symbols[~open_], word[~open_]))
                symbols, word, rank, new, least = symbols[open_], word[open_], rank[open_], new[open_], least[open_]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == least)
            at = at[_every_other(at)]
            at = at[self._in_time(symbols, word, least, new, at)]
            symbols[at] = new[at]
            kept = np.ones(len(symbols), dtype=bool)
            kept[at + 1] = False
            place = at - np.arange(len(at))
            symbols, word, rank, new = symbols[kept], word[kept], rank[kept], new[kept]
            fresh = np.unique(np.r_[place, place[place > 0] - 1])
            inside = fresh[(fresh + 1 < len(word))]
            inside = inside[word[inside] == word[inside + 1]]
            rank[fresh] = _NONE
            rank[inside], new[inside] = self.pairs(symbols[inside], symbols[inside + 1])
        if not done:
            return symbols, word
        symbols, word = (np.concatenate(x) for x in zip(*done))
        by = np.argsort(word, kind="stable")
        return symbols[by], word[by]

    def _in_time(self, symbols: np.ndarray, word: np.ndarray, least: np.ndarray, new: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which merges of a round come before any pair that an earlier one of the same word makes."""
        end = len(symbols)
        before, after = at - 1, at + 2
        left = symbols[before]  # of a first symbol: not used
        follows = np.r_[False, at[1:] == at[:-1] + 2]
        left = np.where(follows, new[at - 2], left)
        has_left, has_right = (before >= 0) & (word[before] == word[at]), after < end
        right = symbols[np.minimum(after, end - 1)]
        has_right &= word[np.minimum(after, end - 1)] == word[at]
        breaks = (has_left & (self.pairs(left, new[at])[0] <= least[at])) | (has_right & (self.pairs(new[at], right)[0] <= least[at]))
        if not breaks.any():
            return np.ones(len(at), dtype=bool)
        firsts = np.r_[True, word[at][1:] != word[at][:-1]]
        gone = np.cumsum(breaks) - breaks  # breaks before a merge, over all words
        return gone == np.repeat(gone[firsts], np.diff(np.r_[np.flatnonzero(firsts), len(at)]))

    def one_by_one(self, symbols: np.ndarray) -> np.ndarray:
        """The symbols left of one word, merging the best pair at a time."""
        s, n = symbols.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[int, int, int, int, int]] = []

        def push(lefts: list[int]) -> None:
            rank, new = self.pairs(np.array([s[i] for i in lefts]), np.array([s[after[i]] for i in lefts]))
            for i, r, m in zip(lefts, rank.tolist(), new.tolist()):
                if r < _NONE:
                    heapq.heappush(queue, (r, i, m, s[i], s[after[i]]))

        push(list(range(n - 1)))
        while queue:
            _, i, m, a, b = heapq.heappop(queue)
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j], after[i] = m, None, after[j]
            if after[j] < n:
                before[after[j]] = i
            push([x for x in (before[i], i) if x >= 0 and after[x] < n])
        return np.array([x for x in s if x is not None], dtype=np.int32)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and the number of ids of each."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbols, word = self.symbol[code], np.repeat(np.arange(len(words)), size)
        long = np.flatnonzero(size > LONG)
        if len(long):
            short = ~np.isin(word, long)
            starts = np.cumsum(size) - size
            parts = [self.rounds(symbols[short], word[short])]
            for i in long.tolist():
                x = self.one_by_one(symbols[starts[i]:starts[i] + size[i]])
                parts.append((x, np.full(len(x), i)))
            symbols, word = (np.concatenate(x) for x in zip(*parts))
            by = np.argsort(word, kind="stable")
            symbols, word = symbols[by], word[by]
        else:
            symbols, word = self.rounds(symbols, word)
        return self._ids(symbols, word, len(words))

    def _ids(self, symbols: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces by their ids, other characters as the ids of their UTF-8 bytes."""
        raw = (symbols < 0) | (symbols >= self.size)
        size = np.ones(len(symbols), dtype=np.int64)
        if not raw.any():
            return symbols + self.first, np.bincount(word, minlength=words)
        code = np.where(symbols < 0, -1 - symbols, self.char[np.maximum(symbols, 0)])[raw].astype(np.int64)
        size[raw] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        out = np.repeat(symbols, size) + self.first
        data = np.frombuffer("".join(map(chr, code.tolist())).encode(), dtype=np.uint8)
        out[np.repeat(raw, size)] = self.byte_ids[data]
        return out, np.bincount(word, weights=size, minlength=words).astype(np.int64)


def _every_other(at: np.ndarray) -> np.ndarray:
    """Of rising places, those that do not overlap the chosen one just before them, from the left."""
    starts = np.flatnonzero(np.r_[True, np.diff(at) != 1])
    return (np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))) % 2 == 0


class PieceCodec:
    """Encodes and decodes texts with a SentencePiece BPE model with byte fallback and no normalisation but the space mark."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm, kind = model.normalizer_spec, model.trainer_spec
        types = sentencepiece_model_pb2.ModelProto.SentencePiece
        if (kind.model_type != 2 or not kind.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix
                or not norm.escape_whitespaces or kind.treat_whitespace_as_suffix or any(p.type in (types.USER_DEFINED, types.UNUSED) for p in model.pieces)):
            raise ValueError(f"{model_file}: not a BPE model with byte fallback, a leading space mark and no other normalisation")
        place = {p.piece: i for i, p in enumerate(model.pieces)}
        normal = [i for i, p in enumerate(model.pieces) if p.type == types.NORMAL]
        if normal != list(range(normal[0], len(model.pieces))):
            raise ValueError(f"{model_file}: pieces do not follow the special ones")
        self.begin, self.end = kind.bos_id, kind.eos_id
        self.merger = PieceMerger([(model.pieces[i].piece, model.pieces[i].score) for i in normal],
                                  np.array([place[f"<0x{b:02X}>"] for b in range(256)], dtype=np.int32), normal[0])
        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.words = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if self.merger.cut else r"(?s).+")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.start = np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text with the begin and the end id; null counts as empty."""
        if len(self.known) > CACHE_WORDS:
            self._forget()
        cut = [self.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        known = self.known
        fresh = list(dict.fromkeys(w for words in cut for w in words if w not in known))
        if fresh:
            ids, size = self.merger.encode_words(fresh)
            known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
            self.start = np.r_[self.start, self.start[-1] + np.cumsum(size)]
            self.ids = np.r_[self.ids, ids]
        out = []
        for words in cut:
            w = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
            lo, n = self.start[w], self.start[w + 1] - self.start[w]
            x = np.empty(int(n.sum()) + 2, dtype="<u4")
            x[0], x[-1] = self.begin, self.end
            x[1:-1] = self.ids[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(x) - 2)]
            out.append(x)
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.processor.decode(ids.tolist())


@cache
def codec(model_file: str) -> PieceCodec:
    """One per Python process."""
    return PieceCodec(model_file)


def _parts(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices of a column of texts of about ``PART_CHARS`` characters, at least one text each."""
    texts = column.to_pylist()
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and (size + len(t or "") > PART_CHARS or i - a == ROWS):
            yield a, i
            a, size = i, 0
        size += len(t or "")
    if texts:
        yield a, len(texts)


def _encode(model_file: str, keep: list[str], outputs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec_ = codec(model_file)
        for whole in batches:
            for a, b in _parts(whole.column("text")):
                part = whole.slice(a, b - a)
                ids = codec_.encode(part.column("text").to_pylist())
                text = [codec_.decode(x) for x in ids] if {"decoded", "decoded_sha256"} & set(outputs) else []
                made = {"ids": lambda: pa.array(ids, pa.list_(pa.int32())), "n_tokens": lambda: pa.array(map(len, ids), pa.int64()),
                        "ids_sha256": lambda: pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                        "decoded": lambda: pa.array(text, pa.string()),
                        "decoded_sha256": lambda: pa.array([hashlib.sha256(t.encode()).hexdigest() for t in text], pa.string())}
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(made[c]() for c in outputs)], [*keep, *outputs])
    return run


_TYPES = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def encode_texts(docs: DataFrame, model_file: str, keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("ids", "n_tokens")) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``outputs``: ``ids`` (begin and end id included), ``n_tokens``, ``ids_sha256``
    (of little-endian unsigned 32-bit integers), ``decoded`` (the text that the ids decode to) or ``decoded_sha256``.

    Null and empty texts have the begin and the end id only and decode to the empty text.  Repeated rows and null ids give
    rows like any other; an empty table gives an empty result.
    """
    types = dict(docs.dtypes)
    spec = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"{c} {_TYPES[c]}" for c in outputs)])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_encode(model_file, list(keep), list(outputs)), spec)


def _decode(model_file: str, ids: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = codec(model_file).processor
        for b in batches:
            text = [None if x is None else processor.decode(x) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(text, pa.string())], [*keep, "text"])
    return run


def decode_ids(rows: DataFrame, model_file: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``rows`` with ``text``, what its ids decode to; null ids give a null text."""
    types = dict(rows.dtypes)
    spec = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "text string"])
    return rows.select(*dict.fromkeys([*keep, ids])).mapInArrow(_decode(model_file, ids, list(keep)), spec)


def op12_piece_merging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and the text they decode to: counts and digests."""
    import public_tokenizers

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
