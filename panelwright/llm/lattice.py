"""Embedding near-duplicates: lattice hashing on E8 with several tables, neighbouring cells, and exact cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .repeats import mixed, ranges
from .store import frozen, release, tasks

TABLES = 4
PROBES = 3
SCALE = 0.45  #: a lattice step as a multiple of the expected length of a unit vector's 8-dimensional projection
CELL_ROWS = 1024  #: a group with more rows is dealt as pairs of chunks
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to neighbouring cells."""
    whole = [[s if k == i else t if k == j else 0.0 for k in range(8)] for i in range(8) for j in range(i) for s in (1.0, -1.0) for t in (1.0, -1.0)]
    half = [[0.5 - (m >> k & 1) for k in range(8)] for m in range(256) if bin(m).count("1") % 2 == 0]
    return np.array(whole + half)


ROOTS = _roots()


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the better of the nearest point of D8 and of D8 + (1/2, ..., 1/2)."""

    def d8(y: np.ndarray) -> np.ndarray:
        z = np.rint(y)
        odd = np.flatnonzero(z.sum(axis=1) % 2 != 0)
        worst = np.abs(y[odd] - z[odd]).argmax(axis=1)
        z[odd, worst] += np.where(y[odd, worst] >= z[odd, worst], 1.0, -1.0)
        return z

    a, b = d8(x), d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def projections(dim: int, tables: int, seed: int) -> np.ndarray:
    """``tables`` random maps to 8 dimensions with orthonormal rows where dim allows."""
    rng = np.random.default_rng(seed)
    maps = []
    for _ in range(tables):
        g = rng.standard_normal((dim, 8))
        maps.append(np.linalg.qr(g)[0] if dim >= 8 else g / np.sqrt(8))
    return np.stack(maps)


def _cell_hash(points: np.ndarray, table: int) -> np.ndarray:
    doubled = np.rint(points * 2).astype(np.int64).view(np.uint64)
    h = np.full(points.shape[:-1], np.uint64(table + 1), np.uint64)
    for i in range(8):
        h = (h ^ doubled[..., i]) * _ODD
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = 7) -> np.ndarray:
    """For unit rows: hashes [row, table, 1 + probes] of the home cell and of the ``probes`` neighbours nearest to the row."""
    dim = unit.shape[1]
    step = scale * np.sqrt(min(8 / dim, 1.0))
    out = np.empty((len(unit), tables, 1 + probes), np.int64)
    for t, p in enumerate(projections(dim, tables, seed)):
        y = unit @ p / step
        home = decode_e8(y)
        near = np.argsort(-((y - home) @ ROOTS.T), axis=1, kind="stable")[:, :probes]
        out[:, t, 0] = _cell_hash(home, t)
        out[:, t, 1:] = _cell_hash(home[:, None, :] + ROOTS[near], t)
    return out


def unit_rows(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _index(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label hash, vector) -> (key, node, home) for the home cell and the probed ones of each table."""
    for frame in frames:
        node, label, vec = frame.column("node").to_numpy(), frame.column("lab").to_numpy(), frame.column("vec")
        dims = vec.value_lengths().to_numpy()
        for dim in np.unique(dims[dims > 0]).tolist():
            every = np.flatnonzero(dims == dim)
            for at in range(0, len(every), 2048):
                rows = every[at : at + 2048]
                found = cells(unit_rows(vec.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)))
                key = mixed(found.view(np.uint64) ^ mixed(label[rows].view(np.uint64) + np.uint64(dim))[:, None, None])
                width = found.shape[1] * found.shape[2]
                yield pa.RecordBatch.from_pydict({"key": key.reshape(-1).view(np.int64), "node": np.repeat(node[rows], width), "home": np.tile(np.arange(width) % found.shape[2] == 0, len(rows))})


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite the sets of i and j for all pairs; ``label`` holds the least row of each row's set, before and after."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))  # roots alone; a root takes one of its links, the others stay for the next round
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _counted(lists: np.ndarray, homes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs of rows: the least group that holds both, one of them in its home cell. Rows with one list are worked out once."""
    _, of = np.unique(np.hstack([lists, homes.astype(np.int64)]), axis=0, return_inverse=True)
    of = of.ravel()
    codes, inverse = np.unique(of[i] * (of.max() + 1) + of[j], return_inverse=True)
    place = np.empty(of.max() + 1, np.int64)
    place[of] = np.arange(len(of))
    a, b = place[codes // (of.max() + 1)], place[codes % (of.max() + 1)]
    least = np.full(len(codes), np.iinfo(np.int64).max)
    for x in range(lists.shape[1]):
        for y in range(lists.shape[1]):
            g = lists[a, x]
            met = (g == lists[b, y]) & (g != _NONE) & (homes[a, x] | homes[b, y])
            least[met] = np.minimum(least[met], g[met])
    return least[inverse]


_NONE = np.iinfo(np.int64).min


def _padded(column: pa.ChunkedArray, fill, kind) -> np.ndarray:
    """A column of lists as a matrix."""
    lists = column.combine_chunks()
    n = lists.value_lengths().to_numpy()
    out = np.full((len(n), n.max(initial=0)), fill, kind)
    out[np.repeat(np.arange(len(n)), n), ranges(np.zeros(len(n), np.int64), n)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _links(x: pa.Table, cosine: float) -> pa.RecordBatch:
    """Links among the rows of whole groups (or chunk pairs of one), sorted by group: of each row with any the number, each link
    counted in one group only, and a row that it hangs together with."""
    g, side, node, mult, gid = (x.column(c).to_numpy() for c in ("__g", "side", "node", "mult", "gid"))
    dims = x.column("vec").combine_chunks().value_lengths().to_numpy()
    unit = unit_rows(_padded(x.column("vec"), 0.0, np.float64))
    label = pd.factorize(x.column("label").to_pandas())[0] * (int(dims.max()) + 1) + dims  # lengths never mix
    lists, homes = _padded(x.column("gids"), _NONE, np.int64), _padded(x.column("homes"), False, bool)
    n = len(g)
    links, root = np.zeros(n, np.int64), np.arange(n)

    def take(i: np.ndarray, j: np.ndarray) -> None:
        ok = (label[i] == label[j]) & (node[i] != node[j])
        i, j = i[ok], j[ok]
        if not len(i):
            return
        least = _counted(lists, homes, i, j)
        met = least < np.iinfo(np.int64).max  # two visitors of a cell are no candidates there
        _join(root, i[met], j[met])
        first = least == gid[i]
        np.add.at(links, i[first], mult[j[first]])
        np.add.at(links, j[first], mult[i[first]])

    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    size = np.diff(np.append(starts, n))
    many = (size > SMALL) | (np.maximum.reduceat(side, starts) > 0)
    rows = ranges(starts[~many], size[~many])  # small groups: all pairs of all of them, some at a time
    later = np.repeat((starts + size)[~many], size[~many]) - rows - 1
    ends = np.cumsum(later) // PAIRS
    for at in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(ends)) + 1):
        i, j = np.repeat(rows[at], later[at]), ranges(rows[at] + 1, later[at])
        near = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
        take(i[near], j[near])
    for begin, m in zip(starts[many].tolist(), size[many].tolist()):
        mine = slice(begin, begin + m)
        apart = bool(side[mine].any())
        for at in range(0, m, 256):
            i, j = np.nonzero(unit[mine][at : at + 256] @ unit[mine].T >= cosine)
            i, j = i + at + begin, j + begin
            ok = (side[i] < side[j]) if apart else (i < j)
            take(i[ok], j[ok])
    touched = (links > 0) | (root != np.arange(n))
    return pa.RecordBatch.from_pydict({"node": node[touched], "links": links[touched], "root": node[root[touched]]})


SMALL = 64  #: rows of a group whose pairs are taken together with those of others
PAIRS = 1 << 15


def link(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` -> one row each: vec_id, n_links, component_id, kept.

    Vectors link at equal, non-null labels (of any type that has equality) and a cosine (double precision) of at least
    ``cosine``. Equal vectors of a label are one class with a multiplicity, so copies are never paired off. Each
    class enters its home cell of TABLES random E8 lattices and visits the PROBES neighbouring cells
    nearest to it; a pair is a candidate where one is at home. Only (cell, class, home) is shuffled at first.
    Cells with a single class, or none at home, are done with; cells of the same members, as a close
    cluster has in every table, are one group. Vectors go to the groups that are left, once to each, and
    are verified by exact cosine; a pair is counted in the least group in which it is a candidate. A group
    over CELL_ROWS rows is dealt as pairs of chunks over many tasks, all of them. What a group sends
    on is a count and a spanning edge per row, never its pairs.

    Vectors that are null, empty, zero, or hold null or non-finite components, and vectors without a
    label, link with nothing (component: themselves). Vectors of different lengths never link.
    Repeated rows count as rows of their own. An empty table gives an empty result; other columns are ignored.
    """
    base = vectors.select("vec_id", "embedding", "label")
    fine = F.col("label").isNotNull() & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False)) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.coalesce(fine, F.lit(False))
    classes = base.where(good).groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"))
    classes = frozen(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    narrow = classes.schema["embedding"].dataType.simpleString() == "array<float>"
    vec = F.col("embedding") if narrow else F.col("embedding").cast("array<double>")
    index = frozen(classes.select("node", F.xxhash64("label").alias("lab"), vec.alias("vec")).mapInArrow(_index, "key long, node long, home boolean"), "index")
    members = F.bit_xor(F.xxhash64("node", "home"))
    cells_ = index.groupBy("key").agg(F.count("*").alias("c"), F.max("home").alias("h"), members.alias("m")).where("c > 1 and h")
    live = index.join(cells_.select("key", F.xxhash64("m", "c").alias("gid")).hint("merge"), "key").select("node", "gid", "home")
    live = frozen(live.groupBy("node", "gid").agg(F.max("home").alias("home")), "live")
    release(index)
    big = frozen(live.groupBy("gid").count().where(F.col("count") > CELL_ROWS).withColumn("__k", F.ceil(F.col("count") / CELL_ROWS).cast("int")).drop("count"), "big")
    lists = live.groupBy("node").agg(F.collect_list(F.struct("gid", "home")).alias("mine"))
    rows = classes.select("node", "mult", F.to_json(F.struct("label")).alias("label"), vec.alias("vec")).join(lists, "node")
    rows = rows.select("node", "mult", "label", "vec", F.col("mine.gid").alias("gids"), F.col("mine.home").alias("homes"), F.explode("mine.gid").alias("gid"))
    own = F.pmod(F.xxhash64("node"), F.col("__k")).cast("int")
    dealt = rows.join(big, "gid", "left").withColumn("__own", own)
    dealt = dealt.withColumn("__other", F.explode(F.when(F.col("__k").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("__k") - 1))))
    part = F.when(F.col("__k").isNull(), F.lit(-1)).otherwise(F.least("__own", "__other") * F.lit(1 << 20).cast("long") + F.greatest("__own", "__other"))
    side = F.coalesce((F.col("__own") > F.col("__other")).cast("int"), F.lit(0))
    every = dealt.withColumns({"part": part, "side": side}).withColumn("__g", F.xxhash64("gid", "part")).select("__g", "gid", "side", "node", "mult", "label", "vec", "gids", "homes")

    def verify(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for frame in frames:
            table = pa.Table.from_batches([frame])
            table = table if rest is None else pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            g = table.column("__g").to_numpy()
            cut = int(np.flatnonzero(g == g[-1])[0])
            rest = table.slice(cut)
            if cut:
                yield _links(table.slice(0, cut), cosine)
        if rest is not None:
            yield _links(rest, cosine)

    found = frozen(every.repartition(tasks(base.sparkSession), "__g").sortWithinPartitions("__g").mapInArrow(verify, "node long, links long, root long"), "links")
    release(live, big)
    tree = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "least", "label", "embedding", "mult").join(tree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = frozen(named.join(counts, "node", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("mult") - 1), "named")
    release(found, tree, classes)
    least = frozen(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    final = frozen(named.join(least, "root").select("label", "embedding", "n_links", "component_id"), "final")
    release(named, least)
    linked = base.where(good).join(final, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = base.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

