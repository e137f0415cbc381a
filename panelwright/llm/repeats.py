"""Windows that repeat across a corpus: what exact substring removal by either index has in common.

A row is a sequence of units (words or bytes), taken in parts of PART window starts; a part holds
the units of all its windows. Every window of ``size`` units picks an anchor by its own content
alone, so equal windows pick equal anchors. Consecutive windows of one anchor form a segment.
Segments meet by anchor; where all of an anchor's segments are equal, all their windows repeat, and
only where they differ are single windows compared. What is shuffled is a few hashes a segment; hot
anchors are combined before the shuffle and joined, never gathered.

Segments and windows are told apart by two polynomials modulo the prime 2**61 - 1, at two points
drawn at random, 61 bits of the one and 32 of the other: the odds that any two of n different windows
are taken for equal are about n**2 / 2**94, whatever they hold (0.1 % for 4e12 windows).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bucketed, frozen, release, tasks

PART = 1 << 17  #: window starts of a part
MOST = 512  #: windows of a segment
PRIME = (1 << 61) - 1
_POINTS = (1368092745231968317, 2079410573906318211)  # below PRIME, drawn once
_P, _30, _31, _61 = np.uint64(PRIME), np.uint64(30), np.uint64(31), np.uint64(61)
_LOW30, _LOW31, _LOW32 = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1), np.uint64((1 << 32) - 1)
_LOW29 = np.uint64((1 << 29) - 1)
_BLOCK = 1 << 13
_tables: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.minimum(x, x - _P)  # below _P the difference wraps round to a large number


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of numbers below it."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    mid = a1 * b0 + a0 * b1
    return _reduced(np.uint64(2) * a1 * b1 + (mid >> _30) + ((mid & _LOW30) << _31) + a0 * b0)


def _by_small(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for b below 2**31."""
    mid = (a >> _31) * b
    return _reduced((mid >> _30) + ((mid & _LOW30) << _31) + (a & _LOW31) * b)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0, ..., base**n modulo PRIME at least."""
    table = _tables.get(base)
    if table is None:
        table = np.array([1], np.uint64)
    while len(table) < n + 1:
        table = np.concatenate((table, mulmod(table, np.array([pow(base, len(table), PRIME)], np.uint64))))
    _tables[base] = table
    return table


class RangeHash:
    """Hash pairs of any range of a sequence of units below PRIME, from prefix sums modulo PRIME."""

    def __init__(self, unit: np.ndarray):
        self.sums = []
        small = len(unit) == 0 or int(unit.max()) < 1 << 31
        for base in _POINTS:
            power, sums, carry = _powers(base, len(unit)), np.zeros(len(unit) + 1, np.uint64), np.uint64(0)
            for at in range(0, len(unit), _BLOCK):  # blocks that stay in a core's cache
                u = unit[at : at + _BLOCK]
                term = (_by_small if small else mulmod)(power[at : at + len(u)], u)
                high = np.cumsum(term >> np.uint64(32))
                total = np.cumsum(term & _LOW32) + (high >> np.uint64(29)) + ((high & _LOW29) << np.uint64(32)) + carry
                sums[at + 1 : at + 1 + len(u)] = total = _reduced(total)
                carry = total[-1]
            self.sums.append(sums)

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for base, sums in zip(_POINTS, self.sums):
            back = _powers(pow(base, -1, PRIME), len(sums))
            found.append(mulmod(_reduced(sums[stop] + (_P - sums[start])), back[start]).view(np.int64))
        return found[0], found[1]


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def windows_matched(anchors: DataFrame, shared: DataFrame, parts: DataFrame | list[DataFrame], size: int, units: Callable[[bytes], np.ndarray], elsewhere: bool) -> DataFrame:
    """Starts of repeated windows: ``(row, at, n)``, n consecutive starts from ``at``.

    anchors: frozen rows (row, doc, key, s1, s2, at, n); s1, s2 are the segment's hash pair. shared: the
    keys worth a look, ``(key)``. parts: ``(row, part, data)``, data with the units of part number ``part``,
    or ``(row, data)`` with all units of a row; several tables of different rows are each joined where they lie.
    elsewhere: a window counts if it starts at any other place too; else if it starts in a smaller doc.
    The result is a written table; anchors, shared, and all tables on the way to it are deleted when
    they have served.
    """
    who = ["row"] if elsewhere else ["row", "doc"]
    keys = ["key", "s1", "s2", "n"]
    flagged = frozen(anchors.join(shared.hint("merge"), "key", "left_semi").select(*keys, *who, "at"), "flagged")
    release(anchors, shared)
    found = flagged.groupBy(*keys).agg(F.count("*").alias("c"), F.min(F.struct("row", "at")).alias("rep"), *([] if elsewhere else [F.min("doc").alias("least")]))
    distinct = frozen(found, "segments")
    variants = frozen(distinct.groupBy("key").agg((F.count("*") > 1).alias("several")).where("several").select("key"), "variants")
    segments = distinct.join(variants.withColumn("several", F.lit(True)), "key", "left").withColumn("several", F.coalesce("several", F.lit(False)))
    segments = frozen(segments, "segments")
    met = flagged.join(segments.hint("merge"), keys)
    whole = (F.col("c") > 1) if elsewhere else (F.col("least") < F.col("doc"))
    asked = F.col("several") & ((F.struct("row", "at") == F.col("rep")) if elsewhere else (F.col("least") == F.col("doc")))
    met = frozen(met.withColumns({"whole": whole, "asked": asked}).where("whole or asked").select(*who, "at", "n", "whole", "asked"), "met")
    release(flagged, distinct, variants, segments)
    need = frozen(met.where("asked").select(*who, "at", "n").withColumn("id", F.monotonically_increasing_id()), "need")
    parts = parts if isinstance(parts, list) else [parts]
    by = [c for c in ("row", "part") if c in parts[0].columns]
    place = F.expr(f"cast(at % {PART} as int)").alias("at") if "part" in by else F.col("at")
    lists = need.groupBy("row", *([F.expr(f"cast(at div {PART} as int)").alias("part")] if "part" in by else [])).agg(F.collect_list(F.struct("id", place, "n")).alias("need"), *([] if elsewhere else [F.first("doc").alias("doc")]))

    def hashes(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            held, total = [], 0
            for data, asks, doc in zip(frame.column("data"), frame.column("need"), [None] * frame.num_rows if elsewhere else frame.column("doc").to_pylist()):
                unit = units(data.as_py())
                ident, at, n = (asks.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("id", "at", "n"))
                piece = at // PART  # a long row goes piece by piece
                for p in np.unique(piece).tolist():
                    mine = piece == p
                    held.append((unit[p * PART : (p + 1) * PART + MOST + size], ident[mine], at[mine] - p * PART, n[mine], doc))
                    total += len(held[-1][0])
                    if total >= 1 << 18:
                        yield hashed(held)
                        held, total = [], 0
            if held:
                yield hashed(held)

    def hashed(held: list[tuple]) -> pa.RecordBatch:
        data, ident, at, n, docs = zip(*held)
        length, asks = np.array([len(x) for x in data]), np.array([len(x) for x in at])
        of = np.repeat(np.arange(len(held)), asks)
        ident, at, n = map(np.concatenate, (ident, at, n))
        start = ranges(at + (np.cumsum(length) - length)[of], n)
        h1, h2 = RangeHash(np.concatenate(data))(start, start + size)
        out = {"h1": h1, "h2": h2.astype(np.int32), "place": np.repeat(ident * MOST, n) + ranges(np.zeros(len(n), np.int64), n)}
        if not elsewhere:
            out["doc"] = np.repeat(np.array(docs, np.int64)[of], n)
        return pa.RecordBatch.from_pydict(out)

    schema = "h1 long, h2 int, place long" + ("" if elsewhere else ", doc long")
    hashed_parts = [some.join(lists.hint("merge"), by).mapInArrow(hashes, schema) for some in parts]
    found = frozen(reduce(DataFrame.union, hashed_parts), "windows")
    if elsewhere:
        repeated = frozen(found.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"), "repeated")
        single = found.join(repeated.hint("merge"), ["h1", "h2"], "left_semi")
    else:
        repeated = frozen(found.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("h1", "h2", "least"), "repeated")
        single = found.join(repeated.hint("merge"), ["h1", "h2"]).where("least < doc")
    offsets = single.groupBy(F.expr(f"place div {MOST}L").alias("id")).agg(F.collect_set(F.expr(f"cast(place % {MOST} as int)")).alias("offsets"))
    ones = offsets.join(need, "id").select("row", F.explode("offsets").alias("off"), "at").select("row", (F.col("at") + F.col("off")).alias("at"), F.lit(1).alias("n"))
    matched = frozen(met.where("whole").select("row", "at", "n").union(ones), "matched")
    release(met, need, found, repeated)
    return matched


def numbered(docs: DataFrame, id_col: str, text_col: str, call: int = 0) -> DataFrame:
    """``(row, id, doc, text)``, written in buckets of row, so that no join by row moves a text again.

    row tells rows apart whatever their ids, also those of different calls (below 128); doc orders documents, a null id as the largest number.
    """
    ident = F.col(id_col).cast("long")
    rows = docs.select(ident.alias("id"), F.coalesce(ident, F.lit((1 << 63) - 1)).alias("doc"), F.col(text_col).alias("text"))
    return bucketed(rows.withColumn("row", F.monotonically_increasing_id() + F.lit(call << 56)).repartition(tasks(docs.sparkSession), "row"), "row", "numbered")


def spans_of(matched: DataFrame, size: int) -> DataFrame:
    """``(row, spans)``: per row the covered ranges [from, to) in order, not touching one another."""

    listed = matched.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("n") + (size - 1)).alias("end")))).alias("raw"))

    def merged(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            raw = frame.column("raw")
            n = raw.value_lengths().to_numpy()
            at, end = (raw.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("at", "end"))
            of = np.repeat(np.arange(len(n)), n)
            apart = of << 33  # rows lie one after the other, far apart
            end = np.maximum.accumulate(end + apart)
            new = np.ones(len(at), bool)
            new[1:] = (at + apart)[1:] > end[:-1]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at))[: len(first)] - 1
            edges = np.column_stack((at[first], (end - apart)[last])).ravel().astype(np.int32)
            offsets = np.concatenate(([0], np.cumsum(2 * np.bincount(of[first], minlength=len(n))))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([frame.column("row"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(edges))], ["row", "spans"])

    return listed.select("row", "raw").mapInArrow(merged, "row long, spans array<int>")


def with_spans(held: DataFrame, spans: DataFrame) -> DataFrame:
    """``(doc_id, text, spans)`` of all numbered rows, with the flat list of span ends (null: none)."""
    return held.join(spans.hint("merge"), "row", "left").select(F.col("id").alias("doc_id"), "text", "spans")


def cut(sequence, spans) -> list:
    """The pieces of a sequence outside the spans, given as a flat list of ends."""
    edges = [0, *(spans if spans is not None else []), len(sequence)]
    return [sequence[i:j] for i, j in zip(edges[::2], edges[1::2])]
