"""SimHash near-duplicates: 64-bit fingerprints, and a Gray-order hierarchical index over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import frozen, release, tasks, without

RADIUS = 3
GROUP_ROWS = 4096  #: a larger group of equal blocks is divided by further blocks
LEAF, FAN = 16, 8  #: fingerprints of a leaf, nodes below an upper node
_LANES = np.uint64(0x0101010101010101)
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of ``text`` over word shingles, repeats counted; no words: 0.

    Words are runs of characters other than ASCII white space, A-Z lower-cased. A bit is 1 if set in
    over half of the shingles' XXH64 (seed 42) values.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: n - 1])).tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts, stops)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        part = np.concatenate((part, np.zeros(-len(part) % 255, np.uint64))).reshape(-1, 255)
        for bit in range(8):
            lanes = ((part >> np.uint64(bit)) & _LANES).sum(axis=1)  # eight counts of up to 255 in a word
            total[bit::8] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in range(64) if 2 * int(total[i]) > len(hashes))


def _fingerprints(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        values = np.fromiter(map(fingerprint, frame.column("text").to_pylist()), np.uint64, frame.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([frame.column("__row"), frame.column("__id"), pa.array(values)], ["__row", "__id", "__fp"])


def _gray_rank(x: np.ndarray) -> np.ndarray:
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def _tree(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels over fingerprints in Gray order, the top first: of each node the bits that all its members share, mask and pattern."""
    levels, low, high, fan = [], fp, fp, LEAF
    while not levels or len(low) > FAN:
        first = np.arange(0, len(low), fan)
        low, high, fan = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first), FAN
        levels.append((~(low ^ high), low))
    return levels[::-1]


def _index_edges(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Member and root of each linked set among distinct ``fp`` of one group, itself left out.

    Fingerprints in Gray order are cut into leaves, leaves into upper nodes, up to a top of FAN nodes. A
    node keeps the bit pattern its members share; a search adds up the differences to the patterns on its
    way down, counting at each node only bits that no node above it has, and leaves a node, with all
    that is below it, once they pass RADIUS.
    """
    fp = fp[np.argsort(_gray_rank(fp), kind="stable")]
    n = len(fp)
    levels = _tree(fp)
    label = np.arange(n)

    def find(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for at in range(0, n, 256):
        q = fp[at : at + 256]
        top = len(levels[0][0])
        qi, node = np.divmod(np.arange(len(q) * top), top)
        seen, above = np.zeros(len(qi), np.uint8), np.zeros(len(qi), np.uint64)
        for depth, (mask, bits) in enumerate(levels):
            seen = seen + np.bitwise_count((q[qi] ^ bits[node]) & mask[node] & ~above)
            ok = seen <= RADIUS
            qi, node, seen = qi[ok], node[ok], seen[ok]
            fan, below = (LEAF, n) if depth + 1 == len(levels) else (FAN, len(levels[depth + 1][0]))
            qi, seen, above = np.repeat(qi, fan), np.repeat(seen, fan), np.repeat(mask[node], fan)
            node = (node[:, None] * fan + np.arange(fan)).ravel()
            ok = node < below
            qi, node, seen, above = qi[ok], node[ok], seen[ok], above[ok]
        later = node > qi + at
        qi, member, seen, above = qi[later], node[later], seen[later], above[later]
        ok = seen + np.bitwise_count((q[qi] ^ fp[member]) & ~above) <= RADIUS
        for i, j in zip((qi[ok] + at).tolist(), member[ok].tolist()):
            i, j = find(i), find(j)
            if i != j:
                label[max(i, j)] = min(i, j)
    roots = np.array([find(i) for i in range(n)])
    moved = np.flatnonzero(roots != np.arange(n))
    return fp[moved], fp[roots[moved]]


def _edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        key = frame["__key"].to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        rest = frame.iloc[cut:]
        if cut:
            yield _groups(key[:cut], frame["__fp"].to_numpy()[:cut])
    if rest is not None and len(rest):
        yield _groups(rest["__key"].to_numpy(), rest["__fp"].to_numpy())


def _groups(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    stops = np.r_[starts[1:], len(key)]
    several = stops - starts >= 2
    found = [_index_edges(np.ascontiguousarray(fp[i:j]).view(np.uint64)) for i, j in zip(starts[several].tolist(), stops[several].tolist())]
    a = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.uint64)
    b = np.concatenate([x for _, x in found]) if found else np.empty(0, np.uint64)
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def _blocks(rows: DataFrame, bits: int) -> DataFrame:
    """Four rows for each: the key so far plus one quarter of the remaining bits, which are then left out."""
    cuts = [bits * i // 4 for i in range(5)]
    parts = []
    for j, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        block = f"shiftrightunsigned(__rem, {lo}) & {(1 << (hi - lo)) - 1}L"
        above = f"shiftleft(shiftrightunsigned(__rem, {hi}), {lo})" if hi < 64 else "0L"
        parts.append(F.struct(F.expr(f"xxhash64(__key, {j}, {block})").alias("__key"), F.expr(f"{above} | (__rem & {(1 << lo) - 1}L)").alias("__rem")))
    return rows.withColumn("__b", F.explode(F.array(*parts))).select("__b.__key", "__b.__rem", "__fp")


def linked(fps: DataFrame) -> DataFrame:
    """Distinct ``__fp`` longs -> a written table of edges (a, b) that connect all fingerprints within RADIUS differing bits.

    Two such fingerprints agree in one of four blocks of 16 bits, so only groups of one block's value
    are searched, each by its index. A group over GROUP_ROWS is divided by a quarter of its other
    bits, again and again; fingerprints that share all but a few bits are few, so no group stays large.
    """
    rows = _blocks(fps.select(F.lit(0).cast("long").alias("__key"), F.col("__fp").alias("__rem"), "__fp"), 64)
    bits, ready, spent = 48, None, []
    while True:
        big = None
        if bits > 10:
            big = frozen(rows.groupBy("__key").count().where(F.col("count") > GROUP_ROWS).select("__key"), "big")
            spent.append(big)
            big = None if big.isEmpty() else big
        calm = (rows if big is None else rows.join(big, "__key", "left_anti")).select("__key", "__fp")
        ready = calm if ready is None else ready.union(calm)
        if big is None:
            break
        rows = _blocks(rows.join(big, "__key", "left_semi"), bits)
        bits -= bits // 4
    edges = frozen(ready.repartition(tasks(fps.sparkSession), "__key").sortWithinPartitions("__key").mapInPandas(_edges, "a long, b long"), "near")
    release(*spent)
    return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """One row for each of ``docs``: ``__row``, ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    Fingerprints at RADIUS or fewer differing bits link; component_id is the smallest id reachable,
    through equal fingerprints too. A null or empty text has fingerprint zero, linked like any other.
    Null ids are no component's smallest (a component of null ids has a null id). Repeated rows each
    get a row. An empty table gives an empty result.
    """
    row = F.monotonically_increasing_id() if row is None else row
    source = docs.select(row.alias("__row"), F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text"))
    prints = frozen(source.mapInArrow(_fingerprints, "__row long, __id long, __fp long"), "prints")
    least = frozen(prints.groupBy("__fp").agg(F.min("__id").alias("__least")), "least")
    near = linked(least.select("__fp"))
    nodes = components(near)
    member = least.join(nodes.withColumnRenamed("node", "__fp"), "__fp", "left").withColumn("root", F.coalesce("root", "__fp"))
    member = frozen(member, "members")
    smallest = frozen(member.groupBy("root").agg(F.min("__least").alias("component_id")), "smallest")
    names = frozen(member.join(smallest, "root").select("__fp", "root", "component_id"), "components")
    release(least, near, nodes, member, smallest)
    found = prints.join(names, "__fp").select("__row", F.col("__id").alias("doc_id"), F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id", F.col("root").alias("__root"))
    found.frozen_inputs = (prints, names)  # tables that go with the result
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less all but one row of each component: the one with the smallest id (nulls last), the first written among equals."""
    columns = docs.columns
    held = frozen(without(docs, "__row").withColumn("__row", F.monotonically_increasing_id()), "dedup")
    found = near_duplicates(held, id_col, text_col, F.col("__row"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__row"))
    best = frozen(found.groupBy("__root").agg(F.min_by("__row", order).alias("__row")).select("__row"), "kept")
    release(*found.frozen_inputs)
    # texts are joined by sorted merge at every size: what is kept grows with the input
    return held.join(best.hint("merge"), "__row", "left_semi").select(*columns)
