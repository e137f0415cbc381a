"""Substring dedup by recompression: Spark rounds name runs and pairs; shared symbols reveal long repeats.

The corpus is a table of blocks, each with the symbols of some documents, words at first. A name is
64 bits of a hash, of a word or of the round and the parts, so equal runs and pairs have one name
everywhere. The first rounds make all runs and pairs there are. From then on, each block lists the
names of those that it would make in a round; Spark groups these over all blocks and sends back which
of them two documents have at least. The others are given up: no window over one can repeat, so it and
the windows that need it drop out, and soon only text with a counterpart elsewhere is left to be
compressed. Windows then meet by their
highest symbol, and are compared by 93 bits of two polynomials of all their words (:mod:`.repeats`), so a name that two things share harms nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import PART, PRIME, RangeHash, cut, mixed, numbered, ranges, spans_of, windows_matched, with_spans
from .store import bucketed, frozen, long_texts, release, tasks

WINDOW = 50
ROUNDS = ("pair", "run", "pair", "pair", "pair", "pair", "pair", "pair")
FREE = 4  #: of the rounds, the first, which make all they find: few words together have a counterpart nearly always
BLOCK = 1 << 18  #: words of a block, less where its last document ends
_FAR = 1 << 30
_META = "rows array<long>, docs array<long>, parts array<int>, n array<int>"
_STATE = f"block long, {_META}, word binary, name binary, low binary, high binary, live binary, first binary, count binary, anchor binary, source binary"
_ASKS = "block long, idx int, name long, several boolean"
_ARRAYS = {"word": np.int64, "name": np.int64, "low": np.int32, "high": np.int32, "live": np.uint8, "first": np.int32, "count": np.int32, "anchor": np.int64, "source": np.int32}


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64 bits of each word, by a keyed hash."""
    if not words:
        return np.empty(0, np.uint64)
    held = np.empty(len(words), object)
    held[:] = words
    return pd.util.hash_array(held, hash_key="0123456789abcdef", categorize=False)


def _grouped(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct names, an order that brings equal ones together, and where each begins in it."""
    order = np.argsort(names, kind="stable")
    begin = np.flatnonzero(np.diff(names[order], prepend=names[order][:1] - 1)) if len(names) else np.empty(0, np.int64)
    return names[order][begin], begin, order


def _packed(names: np.ndarray) -> bytes:
    """Names as a sorted list of the distinct ones, and the number of each place in it."""
    distinct, codes = np.unique(names, return_inverse=True)
    parts = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in (np.diff(distinct, prepend=0), codes.astype(np.int32))]
    return np.array([len(distinct), len(names), len(parts[0])], np.int64).tobytes() + parts[0] + parts[1]


def _unpacked(data: pa.Buffer) -> np.ndarray:
    n, m, cut = np.frombuffer(data, np.int64, 3).tolist()
    steps = np.frombuffer(pa.decompress(data.slice(24, cut), 8 * n, codec="zstd"), np.int64)
    return np.cumsum(steps)[np.frombuffer(pa.decompress(data.slice(24 + cut), 4 * m, codec="zstd"), np.int32)] if m else np.empty(0, np.int64)


class Block:
    """Symbols of one block with the range [low, high) of words that settles each, and its windows' anchors.

    ``word`` has the names of the words, by position, as long as a live window holds them. Positions count the words of all parts in order with one place between parts, which no symbol
    holds. Two places with equal words over a symbol's range have the same symbol there: every look at
    a neighbour widens the range by the neighbour's. Name 0 stands where text has dropped out.

    ``live`` marks the starts of windows that may still repeat. A live window's anchor is the first of
    the highest symbols whose range it holds: (anchor, source) for the windows ``first`` to
    ``first + count - 1``; live windows not listed there have their first word.
    """

    def __init__(self, docs: np.ndarray, n: np.ndarray, window: int, **arrays: np.ndarray):
        self.docs, self.n, self.window, self.fresh = docs, n, window, False
        self.start = np.cumsum(n + 1) - (n + 1)
        self.size = int((n + 1).sum())
        for key, value in arrays.items():
            setattr(self, key, value)

    @classmethod
    def of_words(cls, docs: np.ndarray, n: np.ndarray, window: int, named: np.ndarray) -> Block:
        """``named``: a name above 0 for each word."""
        block = cls(docs, n, window)
        block.word = np.zeros(block.size, np.int64)
        block.word[ranges(block.start, n)] = named
        gone = np.concatenate(([0], np.cumsum(block.word == 0)))
        block.live = np.zeros(block.size, bool)
        block.live[: max(block.size - window + 1, 0)] = gone[window:] == gone[:-window]
        none = np.empty(0, np.int32)
        block.first, block.count, block.anchor, block.source = none, none, np.empty(0, np.int64), none
        block._symbols_of_words()
        return block

    def _symbols_of_words(self) -> None:
        at, empty = np.arange(self.size), self.word == 0
        self.name, self.low, self.high, self.fresh = self.word, np.where(empty, -_FAR, at), np.where(empty, _FAR, at + 1), True
        self._drop()

    def _held(self) -> np.ndarray:
        """Positions in some live window."""
        total = np.concatenate(([0], np.cumsum(self.live)))
        at = np.arange(self.size)
        return total[at + 1] > total[np.maximum(at - self.window + 1, 0)]

    def places(self, kind: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What round k would make: first and last symbol of each place, and its name."""
        name = self.name
        if kind == "run":
            same = (name[1:] == name[:-1]) & (name[1:] != 0)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], same.astype(np.int8), [0]))))
            first, last = edge[::2], edge[1::2]
            more = (last - first + 1).astype(np.uint64)
        else:
            bit = self._bits(k)
            first = np.flatnonzero(~bit[:-1] & bit[1:] & (name[:-1] != 0) & (name[1:] != 0))
            last = first + 1
            more = name[last].view(np.uint64)
        made = mixed(mixed(name[first].view(np.uint64) + np.uint64(k)) * np.uint64(0xE7037ED1A0B428DB) + more)
        return first, last, (made | np.uint64(1 << 63)).view(np.int64)  # names of words have no such bit

    def _bits(self, k: int) -> np.ndarray:
        return (mixed(self.name.view(np.uint64) + np.uint64((k + 1) * 0xA0761D6478BD642F % (1 << 64))) >> np.uint64(63)).astype(bool)

    def asks(self, kind: str, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct names, and whether several documents of the block have each."""
        first, _, made = self.places(kind, k)
        names, begin, order = _grouped(made)
        if not len(first):
            return names, np.empty(0, bool)
        doc = self.docs[np.searchsorted(self.start, self.low[first], "right") - 1][order]
        return names, np.minimum.reduceat(doc, begin) < np.maximum.reduceat(doc, begin)

    def replace(self, kind: str, k: int, shared: np.ndarray | None = None) -> None:
        """Make what has a name among the distinct ones numbered ``shared`` (default: all); all else that was asked for drops out."""
        first, last, made = self.places(kind, k)
        given = made
        if shared is not None:
            names, _, order = _grouped(made)
            kept = np.zeros(len(names), bool)
            kept[shared] = True
            given = np.empty(len(made), np.int64)
            given[order] = np.where(kept[np.cumsum(np.diff(made[order], prepend=made[order][:1]) != 0)], made[order], 0)
        low, high, n, self.fresh = self.low, self.high, len(self.name), False
        if kind == "run":  # a symbol has seen both its neighbours
            low, high = np.minimum(low, np.append(-_FAR, low[:-1])), np.maximum(high, np.append(high[1:], _FAR))
        else:
            look = np.arange(n) + np.where(self._bits(k), -1, 1)
            outside = (look < 0) | (look >= n)
            look = np.clip(look, 0, n - 1)
            low, high = np.where(outside, -_FAR, np.minimum(low, low[look])), np.where(outside, _FAR, np.maximum(high, high[look]))
        name, new, stay = self.name.copy(), np.zeros(n, bool), np.ones(n, bool)
        name[first], new[first], high[first] = given, True, high[last]
        stay[ranges(first + 1, last - first)] = False
        self.name, self.low, self.high, new = name[stay], low[stay], high[stay], new[stay]
        settled = new & (self.low > -_FAR) & (self.high < _FAR)
        self._kill(np.flatnonzero(settled & (self.name == 0)))
        self._choose(np.flatnonzero(settled & (self.name != 0)))
        self._drop()

    def _kill(self, dead: np.ndarray) -> None:
        """Windows that hold the range of a symbol of one document alone do not repeat."""
        change = np.zeros(self.size + 1, np.int64)
        begin, end = np.maximum(self.high[dead] - self.window, 0), self.low[dead] + 1
        some = begin < end
        np.add.at(change, begin[some], 1)
        np.add.at(change, end[some], -1)
        self.live = self.live & (np.cumsum(change[:-1]) == 0)

    def _choose(self, new: np.ndarray) -> None:
        """Anchor live windows at the new symbols; neither end of their ranges ever goes back from one to the next."""
        name, low, high = self.name[new], self.low[new], self.high[new]
        anchor, source = np.zeros(self.size, np.int64), np.zeros(self.size, np.int32)
        listed = ranges(self.first, self.count)
        anchor[listed], source[listed] = np.repeat(self.anchor, self.count), np.repeat(self.source, self.count)
        if len(new):
            s = np.flatnonzero(self.live)
            at = np.minimum(np.searchsorted(low, s), len(low) - 1)
            ok = (low[at] >= s) & (high[at] <= s + self.window)
            anchor[s[ok]], source[s[ok]] = name[at[ok]], low[at[ok]]
        s = np.flatnonzero(self.live & (anchor != 0))
        begin = np.ones(len(s), bool)
        begin[1:] = (s[1:] != s[:-1] + 1) | (anchor[s][1:] != anchor[s][:-1]) | (source[s][1:] != source[s][:-1])
        at = np.flatnonzero(begin)
        self.first, self.count = s[at].astype(np.int32), np.diff(np.append(at, len(s))).astype(np.int32)
        self.anchor, self.source = anchor[self.first], source[self.first]

    def _drop(self) -> None:
        """Symbols that no live window holds are of no further use; one empty place stands for each stretch of them."""
        before = np.concatenate(([0], np.cumsum(self.live)))
        settled = (self.name != 0) & (self.low > -_FAR) & (self.high < _FAR)
        begin, end = np.maximum(self.high - self.window, 0), np.minimum(self.low + 1, self.size)
        useful = settled & (begin < end)
        useful[useful] = before[end[useful]] > before[begin[useful]]
        keep = useful.copy()
        keep[1:] |= useful[:-1]
        keep[:1] = True
        useful = useful[keep]
        self.name = np.where(useful, self.name[keep], 0)
        self.low = np.where(useful, self.low[keep], -_FAR).astype(np.int32)
        self.high = np.where(useful, self.high[keep], _FAR).astype(np.int32)

    def packed(self) -> dict[str, bytes]:
        """The arrays as bytes; before the first round the symbols are the words, and left out."""
        arrays = {k: getattr(self, k) for k in _ARRAYS} | {"live": np.packbits(self.live), "word": self.word[self._held()]}
        if self.fresh:
            arrays |= {k: self.name[:0] for k in ("name", "low", "high")}
        return {k: _packed(arrays[k]) if t is np.int64 else arrays[k].astype(t).tobytes() for k, t in _ARRAYS.items()}

    @classmethod
    def of_row(cls, frame: pa.RecordBatch, i: int, window: int) -> Block:
        docs, n = (frame.column(c)[i].values.to_numpy() for c in ("docs", "n"))
        block = cls(docs, n, window, **{k: _unpacked(frame.column(k)[i].as_buffer()) if t is np.int64 else np.frombuffer(frame.column(k)[i].as_buffer(), t) for k, t in _ARRAYS.items() if k in frame.schema.names})
        if "live" in frame.schema.names:
            block.live = np.unpackbits(block.live, count=block.size).astype(bool)
        if "word" in frame.schema.names:
            held, block.word = block.word, np.zeros(block.size, np.int64)
            block.word[block._held()] = held
            if "name" in frame.schema.names and not len(block.name) and len(held):
                block._symbols_of_words()
        return block


_META_COLUMNS = ("rows", "docs", "parts", "n")


def _blocks(window: int):
    """Texts to blocks of words."""

    def block(held: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
        rows, docs, parts, names = zip(*held)
        n = np.array([len(x) for x in names])
        made = Block.of_words(np.array(docs, np.int64), n, window, np.concatenate(names))
        lists = [pa.array([list(v)], pa.list_(t)) for v, t in zip((rows, docs, parts, n.tolist()), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
        arrays = {k: pa.array([v], pa.binary()) for k, v in made.packed().items()}
        return pa.RecordBatch.from_arrays([*lists, *arrays.values()], [*_META_COLUMNS, *arrays])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for frame in frames:
            for row, doc, text in zip(frame.column("row").to_pylist(), frame.column("doc").to_pylist(), frame.column("text").to_pylist()):
                words = words_of(text)
                if len(words) < window:
                    continue
                names = (word_hashes(words) % np.uint64(PRIME - 1) + np.uint64(1)).view(np.int64)
                for part in range(-(-(len(words) - window + 1) // PART)):
                    held.append((row, doc, part, names[part * PART : (part + 1) * PART + window - 1]))
                    total += len(held[-1][3])
                    if total >= BLOCK:
                        yield block(held)
                        held, total = [], 0
        if held:
            yield block(held)

    return run


def _given(asks: DataFrame) -> DataFrame:
    """``(block, got)``: which of the names that a block asks for may be in two documents."""
    names = asks.groupBy("name").agg(F.count("*").alias("askers"), F.max("several").alias("several")).where("askers > 1 or several").select("name")
    answers = asks.select("block", "idx", "name").join(names.hint("merge"), "name", "left_semi")
    return answers.groupBy("block").agg(F.collect_list("idx").alias("got"))


def _begun(block: Block) -> Block:
    """The block after the free rounds; they are not written, as words alone take less room."""
    if block.fresh:
        for k, kind in enumerate(ROUNDS[:FREE], 1):
            block.replace(kind, k)
    return block


def compressed(held: DataFrame, window: int) -> DataFrame:
    """The block table after the last round."""
    blocks = held.where("text is not null").select("row", "doc", "text").mapInArrow(_blocks(window), _STATE.split(", ", 1)[1])
    blocks = blocks.withColumn("block", F.monotonically_increasing_id()).repartition(tasks(held.sparkSession), "block")
    state = bucketed(blocks, "block", "words")  # in buckets, as the words are too many to be moved again in a join
    for k, kind in list(enumerate(ROUNDS, 1))[FREE:]:

        def ask(frames: Iterator[pa.RecordBatch], kind: str = kind, k: int = k) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                for i, block in enumerate(frame.column("block").to_pylist()):
                    names, several = _begun(Block.of_row(frame, i, window)).asks(kind, k)
                    yield pa.RecordBatch.from_pydict({"block": np.full(len(names), block, np.int64), "idx": np.arange(len(names), dtype=np.int32), "name": names, "several": several})

        def step(frames: Iterator[pa.RecordBatch], kind: str = kind, k: int = k) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                for i in range(frame.num_rows):
                    got = frame.column("got")[i]
                    block = _begun(Block.of_row(frame, i, window))
                    block.replace(kind, k, got.values.to_numpy() if got.is_valid else np.empty(0, np.int64))
                    values = {c: frame.column(c).slice(i, 1) for c in ("block", *_META_COLUMNS)} | {c: pa.array([v], pa.binary()) for c, v in block.packed().items()}
                    yield pa.RecordBatch.from_arrays(list(values.values()), list(values))

        asks = state.select("block", "docs", "n", "word", "live", "name", "low", "high", "first", "count", "anchor", "source").mapInArrow(ask, _ASKS)
        after = frozen(state.join(_given(asks).hint("merge"), "block", "left").mapInArrow(step, _STATE), "round")
        release(state)
        state = after
    return state


_ANCHORS = "row long, doc long, key long, s1 long, s2 int, at int, n int"


def _anchors(state: DataFrame, window: int) -> DataFrame:
    """The segments of all windows that may repeat, with the hash pair of their words' names."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for i in range(frame.num_rows):
                block = Block.of_row(frame, i, window)
                rest = block.live.copy()
                rest[ranges(block.first, block.count)] = False
                alone = np.flatnonzero(rest)
                first = np.concatenate((block.first, alone)).astype(np.int64)
                n = np.concatenate((block.count, np.ones(len(alone), np.int32)))
                key = np.concatenate((block.anchor, block.word[alone]))
                s1, s2 = RangeHash(block.word.view(np.uint64))(first, first + n + window - 1)
                part = np.searchsorted(block.start, first, "right") - 1
                rows, parts = (frame.column(c)[i].values.to_numpy() for c in ("rows", "parts"))
                at = parts[part].astype(np.int64) * PART + first - block.start[part]
                yield pa.RecordBatch.from_pydict({"row": rows[part], "doc": block.docs[part], "key": key, "s1": s1, "s2": s2.astype(np.int32), "at": at.astype(np.int32), "n": n.astype(np.int32)})

    return state.mapInArrow(run, _ANCHORS)


def _parts(state: DataFrame, window: int) -> DataFrame:
    """``(row, part, data)``: the names of the words of each part, 0 where no window that may repeat lies."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for i in range(frame.num_rows):
                block = Block.of_row(frame, i, window)
                rows, parts = (frame.column(c)[i].values for c in ("rows", "parts"))
                data = [block.word[s : s + n].tobytes() for s, n in zip(block.start.tolist(), block.n.tolist())]
                yield pa.RecordBatch.from_arrays([rows, parts, pa.array(data, pa.binary())], ["row", "part", "data"])

    return state.select("rows", "docs", "parts", "n", "word", "live").mapInArrow(run, "row long, part int, data binary")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``(doc_id, text, spans)`` for all rows: spans, a flat list [from, to, from, to, ...] of word numbers, null where none.

    Covered is each word in a window of ``window`` words whose word sequence also starts in a document
    of a smaller id. Words are runs of characters other than ASCII white space, unchanged. A null or
    short text has no windows. A null id counts as the largest number there is, and is given back as
    null; rows of one id never remove from one another. An empty table gives an empty result.
    """
    held = numbered(docs, id_col, text_col)
    state = compressed(held, window)
    anchors = frozen(_anchors(state, window), "anchors")
    shared = anchors.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("key")
    matched = windows_matched(anchors, frozen(shared, "shared"), _parts(state, window), window, lambda data: np.frombuffer(data, np.uint64), elsewhere=False)
    spans = frozen(spans_of(matched, window), "spans")
    release(matched, state)
    return with_spans(held, spans)


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept (the words left, joined by one space)."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            words = [words_of(t) for t in frame.column("text").to_pylist()]
            kept = [[w for part in cut(x, s) for w in part] for x, s in zip(words, frame.column("spans").to_pylist())]
            n = np.array([len(x) for x in words], np.int64)
            gone = n - np.array([len(x) for x in kept], np.int64)
            texts = pa.array([b" ".join(x) for x in kept], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([frame.column("doc_id"), pa.array(n), pa.array(gone), texts], ["doc_id", "n_words", "n_removed", "kept"])

    return long_texts(repeated_spans(docs, id_col, text_col, window)).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


__all__ = ["Block", "compressed", "removed", "repeated_spans"]
