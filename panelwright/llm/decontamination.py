"""Benchmark decontamination: a broadcast hash set of the benchmark's word n-grams, scanned over the corpus."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recompression import word_hashes
from .store import frozen, long_texts, without

WINDOW = 10
BROADCAST_BYTES = 64 << 20  #: a benchmark whose index may take more is joined, not broadcast
WORD_BYTES = 220  #: what a word takes in the index at most, its own bytes left aside: number, window, hash, item, each in driver and worker
PIECE = 1 << 14  #: windows of a text that are hashed at once for the join
FILTER_BITS = 26  #: of the hashes by which windows without a counterpart are left out before the join: 8 MB
_STEPS = (0x9E3779B97F4A7C15, 0xE7037ED1A0B428DB)
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Runs of a-z, 0-9 and all characters outside ASCII, A-Z lower-cased."""
    return text.encode().translate(_FOLD).split() if text else []


class _Windows:
    """The distinct windows of all items: by length, sorted hashes of word numbers, the numbers behind them, and the items that have each."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.number: dict[bytes, int] = {}
        of_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, words in items:
            if words:
                ids = np.array([self.number.setdefault(w, len(self.number)) for w in words], np.int32)
                of_size.setdefault(min(window, len(ids)), []).append((item, ids))
        #: length -> hashes, windows [window, word], where the items of each begin, items
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}
        for size, members in of_size.items():
            every, of = np.unique(np.concatenate([np.lib.stride_tricks.sliding_window_view(ids, size) for _, ids in members]), axis=0, return_inverse=True)
            owner = np.repeat(np.array([item for item, _ in members], np.int64), [len(ids) - size + 1 for _, ids in members])
            hashes = self._hash(every.T, size)
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            pairs = np.unique(np.column_stack((place[of.ravel()], owner)), axis=0)
            begin = np.searchsorted(pairs[:, 0], np.arange(len(order) + 1))
            self.tables[size] = (hashes[order], np.ascontiguousarray(every[order]), begin, pairs[:, 1].copy())

    @staticmethod
    def _hash(columns, size: int) -> np.ndarray:
        total = np.zeros(len(columns[0]), np.uint64)
        for i in range(size):
            total = (total ^ (columns[i].astype(np.uint64) + np.uint64(1))) * _MULT
            total ^= total >> np.uint64(29)
        return total

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[int]]:
        """Number of words, which are hit, and the items found."""
        words = words_of(text)
        hit = np.zeros(len(words), bool)
        found: set[int] = set()
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        known = ids >= 0
        run = np.concatenate(([0], np.cumsum(known)))
        for size, (hashes, windows, begin, items) in self.tables.items():
            if len(ids) < size:
                continue
            starts = np.flatnonzero(run[size:] - run[:-size] == size)
            if not len(starts):
                continue
            value = self._hash([ids[starts + i] for i in range(size)], size)
            at = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            near = hashes[at] == value
            for s, w, h in zip(starts[near].tolist(), at[near].tolist(), value[near]):
                while w < len(hashes) and hashes[w] == h:  # more than one only where hashes collide
                    if (windows[w] == ids[s : s + size]).all():
                        hit[s : s + size] = True
                        found.update(items[begin[w] : begin[w + 1]].tolist())
                    w += 1
        return len(words), hit, found


def _spans(hit: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return edge.reshape(-1, 2).tolist()


def index_bytes(items: DataFrame) -> int:
    """What the index of ``items`` takes at most."""
    row = items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))).alias("words"), F.sum(F.octet_length("text")).alias("bytes")).first()
    return (row["words"] or 0) * WORD_BYTES + (row["bytes"] or 0)


def _rows(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32())))
    columns = zip(*found) if found else ((),) * 4
    return pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), k) for c, k in zip(columns, kinds))], ["__id", "n_words", "n_hit", "items", "spans"])


_OUT = "n_words long, n_hit long, items array<long>, spans array<array<int>>"


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row a document: its id, n_words, n_hit, items (ids whose windows occur) and spans of hit words ([from, to) word numbers).

    A window is ``window`` consecutive item words; an item of fewer, but not none, is one window.
    The benchmark is measured first: an index of up to ``broadcast_bytes`` travels to each task as a
    hash set and hits are verified word by word; above that, windows are joined by their words.
    Ids of any kind are given back as they are. Null texts have no words; rows without an item id are skipped; repeated rows each get a row;
    empty tables give an empty or an all-clean result.
    """
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    kind = source.schema["__id"].dataType.simpleString()
    if index_bytes(items) > broadcast_bytes:
        out = _joined(source, items, window, kind)
    else:
        words = [(r["item_id"], words_of(r["text"])) for r in items.toLocalIterator()]
        held = source.sparkSession.sparkContext.broadcast(_Windows(words, window))

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                yield _rows(frame.column("__id"), [(n, int(hit.sum()), sorted(found), _spans(hit)) for n, hit, found in map(held.value.scan, frame.column("__text").to_pylist())])

        out = long_texts(source).mapInArrow(run, f"__id {kind}, {_OUT}")
    return out.withColumnRenamed("__id", id_col)


def _chained(unit: np.ndarray, size: int, step: int) -> np.ndarray:
    """64 bits of each ``size`` units in a row."""
    n = len(unit) - size + 1
    total = np.full(n, np.uint64(size * step % (1 << 64)))
    for i in range(size):
        total = (total ^ unit[i : i + n]) * np.uint64(step)
        total ^= total >> np.uint64(29)
    return total


def _pieces(keys: list[int], texts: list[str | None], sizes: list[int] | None, window: int) -> Iterator[dict[str, np.ndarray]]:
    """Windows of texts, PIECE of them at a time at most: key, first word, size, and two hashes of the words."""
    for k, text in zip(keys, texts):
        words = words_of(text)
        for at in range(0, len(words), PIECE):
            unit = word_hashes(words[at : at + PIECE + window - 1])
            for size in sizes if sizes is not None else [min(window, len(words))]:
                n = min(PIECE, len(unit) - size + 1)
                if n > 0:
                    h1, h2 = (_chained(unit[: n + size - 1], size, step) for step in _STEPS)
                    yield {"k": np.full(n, k), "at": np.arange(at, at + n), "size": np.full(n, size), "h1": h1.view(np.int64), "h2": h2.view(np.int64)}


def _filter(of_items: DataFrame) -> np.ndarray:
    """One bit for each of 2**FILTER_BITS remainders that a window of the benchmark has: FILTER_BITS / 8 bytes, whatever the benchmark's size."""
    place = f"pmod(h1, {1 << FILTER_BITS})"
    words = of_items.groupBy(F.expr(f"{place} div 32").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast({place} % 32 as int)))").alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    for r in words.toLocalIterator():
        out[r["word"]] = r["bits"]
    return out


def _joined(source: DataFrame, items: DataFrame, window: int, kind: str) -> DataFrame:
    """The same result for a benchmark too large to broadcast: windows of both sides meet by 128 bits of their words.

    Windows are hashed PIECE at a time, and of the documents only those travel that pass a filter of bounded size. A window of
    many items is one row with their list, so many documents that hold it do not multiply them.
    """

    def of_benchmark(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for piece in _pieces(frame.column("item_id").to_pylist(), frame.column("text").to_pylist(), None, window):
                yield pa.RecordBatch.from_pydict(piece)

    schema = "k long, at long, size long, h1 long, h2 long"
    of_items = long_texts(items).select("item_id", "text").mapInArrow(of_benchmark, schema).groupBy("h1", "h2", "size").agg(F.sort_array(F.collect_set("k")).alias("items"))
    of_items = frozen(of_items, "windows")
    sizes = sorted(r[0] for r in of_items.select("size").distinct().collect())  # up to `window` of them
    held = source.sparkSession.sparkContext.broadcast(_filter(of_items))
    rows = frozen(source.withColumn("__row", F.monotonically_increasing_id()), "decontaminate")

    def of_documents(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for piece in _pieces(frame.column("__row").to_pylist(), frame.column("__text").to_pylist(), sizes, window):
                place = piece["h1"].view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
                live = (held.value[place >> np.uint64(5)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0
                if live.any():
                    yield pa.RecordBatch.from_pydict({c: v[live] for c, v in piece.items()})

    of_docs = long_texts(rows.select("__row", "__text")).mapInArrow(of_documents, schema)
    met = of_docs.join(of_items, ["h1", "h2", "size"])
    hits = met.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.collect_set(F.struct("at", "size")).alias("at"))

    def finish(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            done = []
            for text, items_, at in zip(*(frame.column(c).to_pylist() for c in ("__text", "items", "at"))):
                hit = np.zeros(len(words_of(text)), bool)
                for x in at or []:
                    hit[x["at"] : x["at"] + x["size"]] = True
                done.append((len(hit), int(hit.sum()), sorted(items_ or []), _spans(hit)))
            yield _rows(frame.column("__id"), done)

    return rows.join(hits.withColumnRenamed("k", "__row"), "__row", "left").select("__id", "__text", "items", "at").mapInArrow(finish, f"__id {kind}, {_OUT}")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, columns as they were."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    if index_bytes(items) > BROADCAST_BYTES:
        held = frozen(without(docs, "__row").withColumn("__row", F.monotonically_increasing_id()), "drop")
        clean = scan(held, benchmark, "__row", text_col, window).where("n_hit = 0").select("__row")
        return held.join(clean, "__row", "left_semi").select(*docs.columns)
    return docs.where(~contains_window(docs, items, text_col, window))


def contains_window(docs: DataFrame, items: DataFrame, text_col: str, window: int = WINDOW) -> Column:
    """Whether any window of a benchmark of bounded size occurs in the text."""
    held = long_texts(docs).sparkSession.sparkContext.broadcast(_Windows([(r["item_id"], words_of(r["text"])) for r in items.toLocalIterator()], window))

    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bool(held.value.scan(t)[1].any())).astype(bool)

    return hit(F.coalesce(F.col(text_col), F.lit("")))
