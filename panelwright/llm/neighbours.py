"""Approximate nearest neighbours by inner product: NN-descent builds a graph in Spark joins, a greedy walk over it answers.

Every vector gets one more component that brings all to the length of the longest, so that the largest inner
product is the smallest angle. The graph holds KEEP neighbours of each node. It begins with the
nearest of blocks that two random orders cut; then, in each round, the neighbours of a node, either way, are
introduced to one another, and a node keeps the best it has met, until few change. A query starts at its own
node's neighbours and looks at the neighbours of its best, again and again, until its best have all been looked at.

Nodes lie in blocks of BLOCK. What a block needs of other nodes goes to it once, whatever number of its own name it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .repeats import ranges
from .store import frozen, release, tasks, trim

BLOCK = 256
KEEP = 64  #: neighbours of a node in the graph
BACK = 48  #: nodes that name a node, of which as many are drawn anew in each round
OFFER = 4  #: what a node is offered at most by one list of neighbours in a round ...
FROM_BLOCK = 16  #: ... and by all lists of a block; better ones are met again in the next round
SETTLED = 0.1  #: share of the graph's edges that are new in a round that ends the descent
ROUNDS = 12
LISTS = 16  #: of neighbours whose pairs are looked at together
ASKED = 32  #: queries of a block that are answered together
_EDGES = "node long, block long, nb array<long>, sc array<float>, fresh array<boolean>"
_OFFERS = f"{_EDGES}, who array<long>"
_LISTS = {"node": pa.int64(), "block": pa.int64(), "nb": pa.list_(pa.int64()), "sc": pa.list_(pa.float32()), "fresh": pa.list_(pa.bool_())}


def _usable(e: Column) -> Column:
    fine = F.exists(e, lambda v: v != 0) & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(fine, F.lit(False))


def _rows(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _halves(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    """n byte strings of equal length as rows of half-precision floats, not copied."""
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + n + 1]
    return np.frombuffer(held.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.float16).reshape(n, -1)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values))


def _norms(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        dims = frame.column("dim").to_numpy()
        out = np.zeros(len(dims))
        for dim in np.unique(dims).tolist():
            mine = np.flatnonzero(dims == dim)
            x = _rows(frame.column("vec").take(pa.array(mine)), dim, np.float64)
            most = np.abs(x).max(axis=1)
            with np.errstate(over="ignore"):
                out[mine] = np.minimum(most * np.sqrt(((x / most[:, None]) ** 2).sum(axis=1)), np.finfo(np.float64).max)
        yield pa.RecordBatch.from_pydict({"node": frame.column("node"), "norm": out})


def _lifted(x: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Rows over the greatest length, with the component that makes all of length one. Half precision does for the graph; answers are scored anew."""
    y = x / top[:, None]
    return np.hstack([y, np.sqrt(np.maximum(1 - (y**2).sum(axis=1), 0))[:, None]]).astype(np.float16)


def _ordered(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lifted vectors with two numbers of 20 random signs each, by which blocks are cut."""
    for frame in frames:
        dims, top = frame.column("dim").to_numpy(), frame.column("top").to_numpy()
        for dim in np.unique(dims).tolist():
            mine = np.flatnonzero(dims == dim)
            y = _lifted(_rows(frame.column("vec").take(pa.array(mine)), dim, np.float64), top[mine])
            planes = np.random.default_rng(dim).standard_normal((dim + 1, 40)).astype(np.float32)
            bits = y.astype(np.float32) @ planes > 0
            code = [bits[:, k : k + 20] @ (1 << np.arange(20)[::-1]) for k in (0, 20)]
            units = pa.array([row.tobytes() for row in y], pa.binary())
            yield pa.RecordBatch.from_pydict({"node": frame.column("node").take(pa.array(mine)), "dim": pa.array(dims[mine]), "code0": code[0], "code1": code[1], "unit": units})


def _best(u: np.ndarray, w: np.ndarray, s: np.ndarray, old: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For offers w with score s to u: the order of those kept, ``most`` each, best first, and how many each u keeps. Of equal pairs an old one stays."""
    order = np.lexsort((~old, w, u))
    same = np.zeros(len(order), bool)
    same[1:] = (u[order][1:] == u[order][:-1]) & (w[order][1:] == w[order][:-1])
    order = order[~same]
    order = order[np.lexsort((w[order], -s[order], u[order]))]
    begin = np.flatnonzero(np.diff(u[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    order = order[rank < most]
    return order, np.diff(np.append(np.flatnonzero(np.diff(u[order], prepend=-1)), len(order)))


def _within_blocks(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted nodes of a task -> blocks of one dimension, and each node's nearest in its block."""
    held, number, base = None, 0, TaskContext.get().partitionId() << 32

    def block(part: pa.Table) -> pa.RecordBatch:
        node = part.column("node").to_numpy()
        x = _halves(part.column("unit"), len(node)).astype(np.float32)
        near = x @ x.T
        np.fill_diagonal(near, -np.inf)
        k = min(KEEP, len(node) - 1)
        best = np.argsort(-near, axis=1, kind="stable")[:, :k]
        counts = np.full(len(node), k)
        lists = [_lists(node[best].ravel(), counts), _lists(np.take_along_axis(near, best, axis=1).ravel(), counts), _lists(np.ones(best.size, bool), counts)]
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.full(len(node), base + number)), *lists, part.column("unit").combine_chunks()], [*_LISTS, "unit"])

    for frame in frames:
        table = pa.Table.from_batches([frame])
        held = table if held is None else pa.concat_tables([held, table])
        while held.num_rows:
            dims = held.column("dim").to_numpy()
            change = np.flatnonzero(dims != dims[0])
            stop = min(BLOCK, int(change[0]) if len(change) else held.num_rows)
            if stop == held.num_rows and stop < BLOCK:
                break
            yield block(held.slice(0, stop))
            held, number = held.slice(stop), number + 1
    if held is not None and held.num_rows:
        yield block(held)


def _merged(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, of nodes with their edges first, then of offers to several (``who``) -> one row a node with its KEEP best.

    Only the best so far of the nodes of one block are carried on, however much they are offered.
    """

    def pressed(parts: list[pa.Table]) -> pa.Table:
        node, block, us, ws, ss, olds = [], [], [], [], [], []
        for part in parts:
            part = part.combine_chunks()
            lists, own = part.column("nb").combine_chunks(), part.column("node").to_numpy()
            counts = lists.value_lengths().to_numpy()
            u = np.repeat(own, counts)
            if "who" in part.column_names:
                u[u < 0] = part.column("who").combine_chunks().flatten().to_numpy()
            node.append(own[own >= 0])
            block.append(part.column("block").to_numpy()[own >= 0])
            us.append(u)
            for to, c in ((ws, "nb"), (ss, "sc"), (olds, "fresh")):
                to.append(part.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False))
        node, at = np.unique(np.concatenate(node), return_index=True)
        of = np.searchsorted(node, np.concatenate(us))
        w, s, fresh = np.concatenate(ws), np.concatenate(ss), np.concatenate(olds)
        order, _ = _best(of, w, s, ~fresh, KEEP)
        counts = np.bincount(of[order], minlength=len(node))
        return pa.Table.from_arrays([pa.array(node), pa.array(np.concatenate(block)[at]), *[_lists(x[order], counts) for x in (w, s, fresh)]], schema=pa.schema(_LISTS))

    held = None
    for frame in frames:
        if not frame.num_rows:
            continue
        done = pressed(([] if held is None else [held]) + [pa.Table.from_batches([frame])])
        last = done.column("block").to_numpy() == frame.column("block")[-1].as_py()
        if not last.all():
            yield from done.filter(pa.array(~last)).to_batches()
        held = done.filter(pa.array(last))
    if held is not None:
        yield from held.to_batches()
    trim()


def _introduced(lists: pa.Table, members: pa.Table) -> pa.Table:
    """All pairs of the nodes in one list that have not met in it before: of those, what betters a node's own list."""
    order = np.argsort(members.column("node").to_numpy())
    node, limit, home = (members.column(c).to_numpy()[order] for c in ("node", "limit", "home"))
    x = _halves(members.column("unit"), len(node))[order].astype(np.float32)
    held = lists.column("all").combine_chunks()
    counts = held.value_lengths().to_numpy()
    place = np.searchsorted(node, held.flatten().to_numpy())
    fresh = lists.column("new").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    begin = np.cumsum(counts) - counts
    us, ws, ss = [], [], []
    for at in range(0, len(counts), LISTS):
        n = counts[at : at + LISTS]
        wide = int(n.max(initial=0))
        if wide < 2:
            continue
        index, new = np.full((len(n), wide), -1), np.zeros((len(n), wide), bool)
        cell = np.repeat(np.arange(len(n)), n), ranges(np.zeros(len(n), np.int64), n)
        index[cell], new[cell] = place[begin[at] : begin[at] + n.sum()], fresh[begin[at] : begin[at] + n.sum()]
        rows = x[index]
        near = rows @ rows.transpose(0, 2, 1)
        real = index >= 0
        ok = real[:, :, None] & real[:, None, :] & (new[:, :, None] | new[:, None, :]) & (index[:, :, None] != index[:, None, :]) & (near > limit[index][:, :, None])
        near[~ok] = -np.inf
        top = np.argpartition(-near, min(OFFER, wide - 1), axis=2)[:, :, :OFFER]
        score = np.take_along_axis(near, top, axis=2)
        c, i, j = np.nonzero(score > -np.inf)
        us.append(index[c, i])
        ws.append(index[c, top[c, i, j]])
        ss.append(score[c, i, j])
    u, w, s = (np.concatenate(v) if v else np.empty(0, kind) for v, kind in ((us, np.int64), (ws, np.int64), (ss, np.float32)))
    order, _ = _best(u, w, s, np.zeros(len(u), bool), FROM_BLOCK)
    order = order[np.argsort(home[u[order]], kind="stable")]  # a row for each block that nodes are offered something in
    to, counts = np.unique(home[u[order]], return_counts=True)
    trim()
    lists = [_lists(v, counts) for v in (node[w[order]], s[order], np.ones(len(order), bool), node[u[order]])]
    return pa.Table.from_arrays([pa.array(np.full(len(to), -1)), pa.array(to), *lists], schema=pa.schema({**_LISTS, "who": pa.list_(pa.int64())}))


def _merge(rows: DataFrame, label: str) -> DataFrame:
    n = tasks(rows.sparkSession)
    return frozen(rows.repartition(n, "block").sortWithinPartitions("block", F.desc("node")).mapInArrow(_merged, _EDGES), label)


def _as_offers(edges: DataFrame) -> DataFrame:
    return edges.select("node", "block", "nb", "sc", "fresh", F.array().cast("array<long>").alias("who"))


def _both_ways(edges: DataFrame, turn: int) -> DataFrame:
    """``(node, block, all, new)``: each node's neighbours and up to BACK of those that name it."""
    back = edges.select(F.col("node").alias("other"), F.inline(F.arrays_zip("nb", "fresh"))).withColumnRenamed("nb", "node")
    drawn = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("other", "node", F.lit(turn)), "other"))
    back = back.withColumn("__n", drawn).where(F.col("__n") <= BACK).groupBy("node").agg(F.collect_list("other").alias("others"), F.collect_list("fresh").alias("news"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    joined = edges.join(back, "node", "left")
    return joined.select("node", "block", F.concat("nb", none(F.col("others"), "long")).alias("all"), F.concat("fresh", none(F.col("news"), "boolean")).alias("new"))


def graph(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes(node, dim, vec array<double>)``, distinct, usable and written -> edges by NN-descent, and the blocks with both ways' lists."""
    spark = nodes.sparkSession
    norms = frozen(nodes.select("node", "dim", "vec").mapInArrow(_norms, "node long, norm double"), "norms")
    sized = nodes.select("node", "dim", "vec").join(norms, "node")
    coded = sized.join(sized.groupBy("dim").agg(F.max("norm").alias("top")), "dim").select("node", "dim", "vec", "top")
    coded = frozen(coded.mapInArrow(_ordered, "node long, dim int, code0 long, code1 long, unit binary"), "coded")
    release(norms)
    count = coded.count()
    cuts = max(1, min(tasks(spark), count // (2 * BLOCK)))

    def near(code: str) -> DataFrame:
        dealt = coded.repartitionByRange(cuts, "dim", code, "node") if cuts > 1 else coded.coalesce(1)
        return frozen(dealt.sortWithinPartitions("dim", code, "node").mapInArrow(_within_blocks, f"{_EDGES}, unit binary"), "near")

    first, second = near("code0"), near("code1")
    units = frozen(first.select("node", "unit"), "units")
    homes = second.drop("block", "unit").join(first.select("node", "block"), "node").select("block", F.array_repeat("node", F.size("nb")).alias("who"), "nb", "sc", "fresh")
    edges = _merge(_as_offers(first.drop("unit")).union(homes.select(F.lit(-1).cast("long").alias("node"), "block", "nb", "sc", "fresh", "who")), "edges")
    release(coded, first, second)
    for turn in range(ROUNDS if count > BLOCK else 0):
        lists = frozen(_both_ways(edges, turn), "lists")
        limit = F.when(F.size("sc") >= KEEP, F.array_min("sc")).otherwise(F.lit(float("-inf")).cast("float"))
        known = units.join(edges.select("node", limit.alias("limit"), F.col("block").alias("home")), "node")
        members = lists.select("block", F.explode("all").alias("node")).distinct().join(known, "node").select(*[F.col(c).alias(c) for c in ("block", "node", "limit", "home", "unit")])  # not the columns that the lists have
        offers = lists.select("block", "all", "new").groupBy("block").cogroup(members.groupBy("block")).applyInArrow(_introduced, _OFFERS)
        met = edges.withColumn("fresh", F.transform("fresh", lambda _: F.lit(False)))
        better = _merge(_as_offers(met).union(offers), "edges")
        release(edges, lists)
        edges = better
        new, all_ = edges.agg(F.sum(F.size(F.filter("fresh", lambda f: f))), F.sum(F.size("nb"))).first()
        if (new or 0) <= SETTLED * (all_ or 0):
            break
    release(units)
    lists = frozen(_both_ways(edges, ROUNDS).select("node", "block", "all"), "lists")
    return edges, lists


def _looked(keep: int):
    def step(asks: pa.Table, members: pa.Table) -> pa.Table:
        """Scores of what each query of a group has newly met, by adding up products in order; the best ``keep`` stay."""
        order = np.argsort(members.column("node").to_numpy())
        node, least = members.column("node").to_numpy()[order], members.column("least").to_numpy()[order]
        vec = members.column("vec").combine_chunks()
        out = []
        for k in range(asks.num_rows):
            own = asks.column("node")[k].as_py()
            q = asks.column("vec")[k].values.to_numpy()
            known, score, first, seen = (asks.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("known", "score", "first", "seen"))
            met = np.unique(asks.column("met")[k].values.to_numpy())
            met = met[~np.isin(met, known) & (met != own)]
            place = np.searchsorted(node, met)
            x = _rows(vec.take(pa.array(order[place])), len(q), np.float64)
            found = np.zeros(len(met))
            with np.errstate(over="ignore", invalid="ignore"):
                for j in range(len(q)):
                    found += x[:, j] * q[j]
            known, score, first = np.concatenate((known, met)), np.concatenate((score, found)), np.concatenate((first, least[place]))
            seen = np.concatenate((np.ones(len(seen), bool), np.zeros(len(met), bool)))
            best = np.lexsort((known, first, -score))[:keep]
            out.append((own, known[best], score[best], first[best], seen[best]))
        columns = list(zip(*out))
        trim()
        counts = np.array([len(v) for v in columns[1]])
        return pa.Table.from_arrays([pa.array(columns[0]), *[_lists(np.concatenate(v), counts) for v in columns[1:]]], ["node", "known", "score", "first", "seen"])

    return step


def _walk(asked: DataFrame, lists: DataFrame, nodes: DataFrame, keep: int) -> DataFrame:
    """Greedy search for the distinct nodes ``asked(node, team)``: (node, known, score), ``keep`` at most, best first."""
    state_schema = "node long, known array<long>, score array<double>, first array<long>, seen array<boolean>"
    none = [F.array().cast(f"array<{kind}>").alias(name) for name, kind in (("known", "long"), ("score", "double"), ("first", "long"), ("seen", "boolean"))]
    vectors = nodes.select("node", "vec", "least")
    front = asked.select("team", "node", F.col("node").alias("at"))
    state = asked.select("node", *none)
    ended: list[DataFrame] = []
    while True:
        met = front.join(lists.select(F.col("node").alias("at"), "all"), "at").select("team", "node", F.explode("all").alias("c")).distinct()
        met = frozen(met, "met")
        members = met.select("team", F.col("c").alias("node")).distinct().join(vectors, "node")
        members = members.select([F.col(c).alias(c) for c in members.columns])  # not the columns that the queries have
        asks = met.groupBy("team", "node").agg(F.collect_list("c").alias("met")).join(state, "node").join(vectors.drop("least"), "node")
        after = frozen(asks.groupBy("team").cogroup(members.groupBy("team")).applyInArrow(_looked(keep), state_schema), "state")
        release(met, state if hasattr(state, "frozen_path") else None)
        ended.append(after)
        fresh = F.filter(F.arrays_zip("known", "seen"), lambda e: ~e.seen)
        front = asked.join(after, "node").select("team", "node", F.explode(fresh).alias("e")).select("team", "node", F.col("e.known").alias("at"))
        if front.isEmpty():
            break
        still = frozen(after.where(F.exists("seen", lambda s: ~s)), "state")
        ended[-1] = frozen(after.where(~F.exists("seen", lambda s: ~s)).select("node", "known", "score"), "found")
        front = frozen(front, "front")
        release(after)
        state = still
    found = ended[0].select("node", "known", "score")
    for more in ended[1:]:
        found = found.union(more.select("node", "known", "score"))
    return found


def nearest(vectors: DataFrame, asks: Column, k: int = 20) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> ``(query_id, rank, vec_id, score)``: for each row under ``asks`` the k rows of largest inner product found, itself left out.

    Scores are inner products in double precision of the vectors as given; nearest first, ties to the smaller vec_id. Equal vectors are one node of
    the graph, and a node stands for its k + 1 smallest ids, so copies are never paired off. Candidates have as many components as the query.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows without an id, take no part. Repeated rows
    are rows of their own. Fewer than k candidates: all that are found. An empty table gives an empty result; other columns are ignored.

    The graph is approximate where there are over BLOCK distinct vectors; recall is measured by the tests. It holds KEEP neighbours a node whatever
    the data; a hub, which many nodes name, is met through BACK of them, drawn anew in each round. Where a few vectors are many times longer than the rest, recall falls, as all others then have one direction.
    """
    base = vectors.withColumn("__asks", F.coalesce(asks, F.lit(False))).select("vec_id", "embedding", "__asks")
    good = base.where(F.col("vec_id").isNotNull() & _usable(F.col("embedding"))).withColumn("vec", F.col("embedding").cast("array<double>"))
    classes = good.groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"), F.max("__asks").alias("asks"))
    nodes = frozen(classes.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("vec")}), "nodes")
    rows = frozen(good.select("vec", "vec_id", "__asks").join(nodes.select("vec", "node", "mult"), "vec").where("__asks or mult > 1").select("vec_id", "__asks", "node", "mult"), "rows")
    edges, lists = graph(nodes)
    release(edges)
    team = F.floor((F.row_number().over(Window.partitionBy("block").orderBy("node")) - 1) / ASKED)
    asked = lists.join(nodes.where("asks").select("node"), "node").select("node", F.xxhash64("block", team).alias("team"))
    asked = frozen(asked, "asked")
    found = frozen(_walk(asked, lists, nodes, k + 1), "walked")
    release(lists)
    own = nodes.where("asks").select("node", F.col("node").alias("c"), F.aggregate(F.transform("vec", lambda v: v * v), F.lit(0.0), lambda a, v: a + v).alias("score"))
    other = found.select("node", F.inline(F.arrays_zip("known", "score"))).select("node", F.col("known").alias("c"), "score")
    first = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
    many = rows.where("mult > 1").withColumn("__n", first).where(F.col("__n") <= k + 1).groupBy("node").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    names = nodes.select("node", "least").join(many, "node", "left").select(F.col("node").alias("c"), F.coalesce("ids", F.array("least")).alias("ids"))
    each = own.union(other).join(names, "c").select("node", "c", "score", F.explode("ids").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "vec_id", "c"))
    best = each.withColumn("__n", place).where(F.col("__n") <= k + 1).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("__n", "c", "vec_id", "score"))).alias("best"))
    best = frozen(best, "best")
    asking = rows.where("__asks").select(F.col("vec_id").alias("query_id"), "node").join(best, "node")
    mine = F.array_position(F.transform("best", lambda b: (b.vec_id == F.col("query_id")) & (b.c == F.col("node"))), F.lit(True))
    others = asking.withColumn("__mine", mine).withColumn("best", F.slice(F.filter("best", lambda b, i: i + 1 != F.col("__mine")), 1, k))
    out = others.select("query_id", F.posexplode("best").alias("pos", "b")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")
    out = frozen(out, "nearest")
    release(nodes, rows, asked, found, best)
    return out
