"""Suffix-array dedup: a logarithmic family of sorted suffix tables, merge-scanned by each new batch."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import MOST, PART, RangeHash, cut, mixed, numbered, ranges, spans_of, windows_matched, with_spans
from .store import bucketed, frozen, long_texts, release, tasks

WINDOW = 200
SPREAD = 144  #: of this many neighbouring suffixes one is indexed at least
FINE = 60  #: the same for the windows of suffixes that have met, which are looked at more closely
HEAD = 16  #: bytes by which suffixes are sorted; further ones count by a fingerprint
GRAM = 24  #: bytes whose hash decides which
BATCHES = 4
BATCH = 1 << 18  #: bytes whose suffixes are chosen at once
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ODD = 0x9E3779B97F4A7C15
_held: dict[int, np.ndarray] = {}
SUFFIXES = "row long, batch int, at int, n int, suffix binary"
ANCHORS = "row long, key long, s1 long, s2 int, at int, n int"


def units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8).astype(np.uint64) + np.uint64(1)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _ODD and of its inverse modulo 2**64."""
    if len(_held.get(_ODD, ())) < n:
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            steps = np.full(max(n, PART + 1024), base, np.uint64)
            steps[0] = 1
            _held[base] = np.multiply.accumulate(steps)
    return _held[_ODD], _held[pow(_ODD, -1, 1 << 64)]


def grams_of(raw: np.ndarray, length: int) -> np.ndarray:
    """A cheap 64-bit hash of every ``length`` bytes; it only picks suffixes, what they bring together is compared again."""
    power, inverse = _tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=sums[1:])
    n = len(sums) - length
    return mixed((sums[length:] - sums[:n]) * inverse[:n])


def segments(raw: np.ndarray, start: np.ndarray, part: np.ndarray, window: int, spread: int) -> tuple[np.ndarray, ...]:
    """Windows that start at ``start``, by the suffix that each picks: the leftmost least gram among its first ``spread``.

    ``part`` tells texts that lie end to end in ``raw`` apart. Returns the place in ``start`` of the first
    window of each run with one suffix, the number of windows of the run, and where the suffix starts.
    """
    gram = min(GRAM, window - spread + 1)
    grams = grams_of(raw, gram)
    best = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while reach < spread:
        step = min(reach, spread - reach)
        best = np.minimum(best[:-step], best[step:])
        reach += step
    chosen = (best[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = (chosen[1:] != chosen[:-1]) | (part[1:] != part[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(np.concatenate(([True], new)))
    return at, np.diff(np.append(at, len(start))), chosen[at]


def _prints(raw: np.ndarray, suffix: np.ndarray, depth: int) -> np.ndarray:
    """64 bits of the first ``depth`` bytes of each suffix."""
    bytes_ = np.lib.stride_tricks.sliding_window_view(raw, depth)[suffix]
    words = np.ascontiguousarray(np.pad(bytes_, ((0, 0), (0, -depth % 8)))).view(np.uint64)
    return mixed(words * _PLACE[: words.shape[1]]).sum(axis=1, dtype=np.uint64)


def _pieces(row: np.ndarray, data: list[bytes], lists: list[tuple[np.ndarray, np.ndarray]] | None, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Texts end to end, BATCH bytes or one piece of a longer text at a time: (raw, rows, first starts in the texts, offsets, starts, part of each start).

    ``lists`` (default: all) gives for each text the windows to look at, as first starts and numbers.
    """
    held, total = [], 0

    def end_to_end() -> tuple[np.ndarray, ...]:
        rows, begin, pieces, starts = zip(*held)
        length = np.array([len(p) for p in pieces], np.int64)
        offset = np.cumsum(length) - length
        part = np.repeat(np.arange(len(held)), [len(s) for s in starts])
        return np.frombuffer(b"".join(pieces), np.uint8), np.array(rows, np.int64), np.array(begin, np.int64), offset, np.concatenate(starts) + offset[part], part

    for i, text in enumerate(data):
        every = len(text) - window + 1
        for begin in range(0, every, PART):
            n = min(PART, every - begin)
            if lists is None:
                some = [(0, n, np.arange(n))]
            else:
                at, count = lists[i]
                low, high = np.maximum(at, begin) - begin, np.minimum(at + count, begin + n) - begin
                low, high = low[low < high], high[low < high]
                cuts = [0, *(np.flatnonzero(low[1:] > high[:-1] + window) + 1).tolist(), len(low)]  # text between far ranges is left out
                some = [(int(low[j]), int(high[k - 1]), ranges(low[j:k] - low[j], high[j:k] - low[j:k])) for j, k in zip(cuts, cuts[1:]) if j < k]
            for first, end, starts in some:
                held.append((row[i], begin + first, text[begin + first : begin + end + window - 1], starts))
                total += len(held[-1][2])
            if total >= BATCH:
                yield end_to_end()
                held, total = [], 0
    if held:
        yield end_to_end()


def _suffixes(window: int, spread: int, batches: int):
    """Texts to the suffixes that are indexed: their first HEAD bytes, then 64 bits of all bytes to the index's depth."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for raw, rows, begin, offset, start, part in _pieces(frame.column("row").to_numpy(), frame.column("text").cast(pa.binary()).to_pylist(), None, window):
                at, n, suffix = segments(raw, start, part, window, spread)
                part = part[at]
                bytes_ = np.hstack([np.lib.stride_tricks.sliding_window_view(raw, HEAD)[suffix], _prints(raw, suffix, window - spread + 1).astype(">u8").view(np.uint8).reshape(-1, 8)])
                ends = pa.py_buffer(np.arange(0, bytes_.size + 1, HEAD + 8, dtype=np.int32))
                batch = (mixed(rows.view(np.uint64)) % np.uint64(batches)).astype(np.int32)[part]
                values = {"row": rows[part], "batch": batch, "at": (start[at] - offset[part] + begin[part]).astype(np.int32), "n": n.astype(np.int32), "suffix": pa.Array.from_buffers(pa.binary(), len(at), [None, ends, pa.py_buffer(bytes_.tobytes())])}
                yield pa.RecordBatch.from_pydict(values)

    return run


def _anchors(window: int, spread: int):
    """Texts with their windows of matched suffixes to finer segments, with the hash pair of all bytes that a segment's windows hold."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            lists = []
            for x in frame.column("met"):
                at, n = (x.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "n"))
                order = np.argsort(at)
                lists.append((at[order], n[order]))
            for raw, rows, begin, offset, start, part in _pieces(frame.column("row").to_numpy(), frame.column("text").cast(pa.binary()).to_pylist(), lists, window):
                at, n, suffix = segments(raw, start, part, window, spread)
                first, part = start[at], part[at]
                s1, s2 = RangeHash(raw.astype(np.uint64) + np.uint64(1))(first, first + n + window - 1)
                key = _prints(raw, suffix, window - spread + 1)
                yield pa.RecordBatch.from_pydict({"row": rows[part], "key": key.view(np.int64), "s1": s1, "s2": s2.astype(np.int32), "at": (first - offset[part] + begin[part]).astype(np.int32), "n": n.astype(np.int32)})

    return run


_PLACE = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


class LevelFamily:
    """Suffix arrays in sizes 1, 2, 4, ... batches: sorted tables of suffixes cut at one depth, with the number of their places.

    A level lies in buckets that are sorted by the suffix's bytes, the same buckets in every level: a
    new batch is sorted once, and meeting it with a level, or merging two levels, is a merge scan of
    sorted files that moves no row between executors. Neighbours that agree to the full depth (a common
    prefix of ``window - spread + 1`` bytes: HEAD of them as they are, all of them by fingerprint) are the
    long matches. Two levels of one size merge into one of twice the size before the next batch comes,
    so a suffix is rewritten once for each doubling of the index. Levels stay until :meth:`close`.

    A family that the caller keeps also keeps, of each call of :func:`repeated_spans`, the texts and the places of their suffixes, so that
    a later batch can be compared with the earlier texts that it meets, and the windows that have been found so far.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        self.found: list[DataFrame] = []
        self.calls: list[tuple[DataFrame, DataFrame]] = []  #: numbered texts and their suffixes
        self.matched: DataFrame | None = None

    def add(self, suffixes: DataFrame) -> None:
        """Index ``suffixes(suffix)``, one row a place."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            both = a.withColumnRenamed("places", "more").join(b.hint("merge"), "suffix", "full_outer")
            merged = both.select("suffix", (F.coalesce("more", F.lit(0)) + F.coalesce("places", F.lit(0))).alias("places"))
            self.levels.append((2 * size, bucketed(merged, "suffix", "level")))
            release(a, b)
        batch = bucketed(suffixes.groupBy("suffix").agg(F.count("*").alias("places")), "suffix", "level")
        met = batch.where("places > 1").select("suffix")
        for _, level in self.levels:
            met = met.union(batch.join(level.select("suffix").hint("merge"), "suffix", "left_semi").select("suffix"))
        self.found.append(frozen(met, "met"))
        self.levels.append((1, batch))

    def matches(self, last: int | None = None) -> DataFrame:
        """``(suffix)`` of all suffixes met more than once, or only of those that the ``last`` batches met."""
        found = self.found[-last:] if last else self.found
        return reduce(DataFrame.union, found).distinct()

    def close(self) -> None:
        release(*(level for _, level in self.levels), *self.found, *(t for call in self.calls for t in call), self.matched)
        self.levels, self.found, self.calls, self.matched = [], [], [], None


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, spread: int = SPREAD, batches: int = BATCHES, family: LevelFamily | None = None) -> DataFrame:
    """``(doc_id, text, spans)`` for all rows: spans, a flat list [from, to, ...] of byte numbers, null where none.

    Covered is each byte in a ``window``-byte string that also starts at any other place, in the same
    document or another. Texts are UTF-8; a null or short one has no windows; matches never cross
    rows. A repeated row is another place. Null ids are ordinary rows. An empty table gives an empty
    result. ``spread`` is 512 at most, and HEAD below ``window`` at least, else this raises.

    The suffix arrays are sparse and cut: of any ``spread`` neighbouring suffixes one at least is indexed, chosen by
    content, so a match of ``window`` bytes always holds one together with ``window - spread + 1``
    bytes after it, to which depth suffixes are sorted. Windows of suffixes that meet are looked at again, by
    denser suffixes, and at last compared by all their bytes. ``family`` (default: one of this call, closed at
    its end) holds the index; one given stays open, and later calls with it return the rows of all calls so far, spans found in any of them
    included, as one call with all the rows would. What a later call works on is its own rows, and the places of older rows that they meet; close the
    family when the last result has been read.
    """
    if not 0 < spread <= min(window - HEAD, MOST):
        raise ValueError(f"spread must lie {HEAD} below window at least, and be {MOST} at most")
    fine = min(FINE, spread)
    index = family or LevelFamily()
    held = numbered(docs, id_col, text_col, len(index.calls))
    suffixes = _long(held, window).mapInArrow(_suffixes(window, spread, batches), SUFFIXES)
    suffixes = frozen(suffixes, "suffixes") if family is None else bucketed(suffixes.repartition(tasks(docs.sparkSession), "suffix"), "suffix", "suffixes")
    for b in range(batches):
        index.add(suffixes.where(F.col("batch") == b).select("suffix"))
    shared = frozen(index.matches(batches), "shared")
    calls = [*index.calls, (held, suffixes)]
    if family is None:
        index.close()
    anchors, mets = [], []
    for texts, places in calls:
        mets.append(frozen(places.join(shared.hint("merge"), "suffix", "left_semi").groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("met")), "met"))
        anchors.append(_long(texts, window).join(mets[-1].hint("merge"), "row").mapInArrow(_anchors(window, fine), ANCHORS))
    every = frozen(reduce(DataFrame.union, anchors), "anchors")
    release(*mets, shared, suffixes if family is None else None)
    several = frozen(every.groupBy("key").count().where("count > 1").select("key"), "shared")
    matched = windows_matched(every, several, [_long(texts, window).withColumnRenamed("text", "data") for texts, _ in calls], window, units, elsewhere=True)
    if family is not None:
        family.calls = calls
        before, family.matched = family.matched, matched if family.matched is None else frozen(family.matched.union(matched), "matched")
        release(before, None if family.matched is matched else matched)
        matched = family.matched
    spans = frozen(spans_of(matched, window), "spans")
    release(None if family is not None else matched)
    return reduce(DataFrame.union, [with_spans(texts, spans) for texts, _ in calls])


def _long(held: DataFrame, window: int) -> DataFrame:
    return held.where(F.octet_length("text") >= window).select("row", "text")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes left; they may end inside a character)."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            raw = [t if t is not None else b"" for t in frame.column("text").cast(pa.binary()).to_pylist()]
            spans = frame.column("spans").to_pylist()
            kept = [b"".join(cut(x, s)) for x, s in zip(raw, spans)]
            n = np.array([len(x) for x in raw], np.int64)
            n_removed = n - np.array([len(x) for x in kept], np.int64)
            n_spans = np.array([len(s) // 2 if s is not None else 0 for s in spans], np.int64)
            yield pa.RecordBatch.from_arrays([frame.column("doc_id"), pa.array(n), pa.array(n_removed), pa.array(n_spans), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return long_texts(repeated_spans(docs, id_col, text_col, **options)).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


__all__ = ["LevelFamily", "removed", "repeated_spans"]
