"""Mixing sources to target weights: pivotal dependent rounding with a distributed reduction tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sharding import number_rows
from .store import frozen, release, row_hash, tasks, without

LEAF_ROWS = 4096  #: documents of one source that a leaf of the tree pairs
FAN_IN = 64  #: leaves or nodes, with one residual each, that one inner node pairs
_MASK = (1 << 64) - 1


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space, tab, newline, vertical tab, form feed, return; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``sizes(source, source_size)`` with one row a source -> plus ``target``.

    Sources by code point, null last, take ``weights`` in turn and share ``share`` times all sizes;
    a target stops at ``most`` times its source's size and the excess is shared again by weight
    among the rest until none is above. Sources are sorted by the level that fills them, and the level follows from sums over those before each, in one pass
    whatever the number of sources. Only totals reach the driver.
    """
    ranked = number_rows(sizes, [F.col("source").isNull(), F.col("source")], "__rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    table = frozen(ranked.select("source", "source_size", w.alias("__w"), (F.col("source_size") * float(most)).alias("__cap")), "targets")
    release(ranked.written)
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    # by cap a weight, those before a source are full and share what is left no more: the first source that the level does not fill has the level
    order = F.col("__cap") / F.col("__w")
    dealt = table.select("__w", "__cap", order.alias("__full_at")).repartitionByRange(tasks(sizes.sparkSession), "__full_at")
    dealt = frozen(dealt.withColumn("__p", F.spark_partition_id()), "by-cap")
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    parts = dealt.groupBy("__p").agg(F.sum("__w").alias("w"), F.sum("__cap").alias("c"))
    parts = parts.select("__p", F.coalesce(F.sum("w").over(earlier), F.lit(0.0)).alias("w0"), F.coalesce(F.sum("c").over(earlier), F.lit(0.0)).alias("c0"), F.sum("w").over(Window.partitionBy()).alias("w_all"))
    run = Window.partitionBy("__p").orderBy("__full_at").rowsBetween(Window.unboundedPreceding, -1)
    held, spent = F.col("c0") + F.coalesce(F.sum("__cap").over(run), F.lit(0.0)), F.col("w0") + F.coalesce(F.sum("__w").over(run), F.lit(0.0))
    levels = dealt.join(parts, "__p").select("__full_at", ((F.lit(total) - held) / (F.col("w_all") - spent)).alias("level"))
    found = levels.where(F.col("level") <= F.col("__full_at")).agg(F.min_by("level", "__full_at")).first()[0]
    release(dealt)
    level = float("inf") if found is None else found  # every source is full
    full = F.col("__w") * F.lit(level) > F.col("__cap")
    target = F.when(full, F.col("__cap")).otherwise(F.col("__w") * F.lit(level))
    out = table.select("source", "source_size", target.alias("target"))
    out.written = table
    return out


def _uniform(h: int) -> float:
    z = (h + 0x9E3779B97F4A7C15) & _MASK
    z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & _MASK
    z = ((z ^ z >> 27) * 0x94D049BB133111EB) & _MASK
    return ((z ^ z >> 31) >> 11) * 2.0**-53


def _groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames sorted by group, cut anew so that each holds one group, which has LEAF_ROWS or FAN_IN rows at most."""
    rest: list[pd.DataFrame] = []
    for frame in frames:
        group = frame["__group"].to_numpy()
        cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
        for i, j in zip(cuts, cuts[1:]):
            part = frame.iloc[i:j]
            if rest and rest[0]["__group"].iloc[0] != part["__group"].iloc[0]:
                yield pd.concat(rest)
                rest = []
            rest.append(part)
    if rest:
        yield pd.concat(rest)


def _whole(x: float) -> float:
    return float(round(x)) if abs(x - round(x)) < 1e-9 else x


def deal(size: list[int], x: float, draw: list[float]) -> list[float]:
    """Settle documents of one common fraction ``x``, the largest first; one of them at most stays fractional.

    A document is paired with the pool of all that come after it, whose members share one fraction:
    mass moves between the two until one is whole, which way is drawn so that every member's expected
    copies stay as they are, and the words of document and pool together stay as they are too. So large
    documents are settled against many small ones, and what is left is one of the smallest.
    """
    rest = float(sum(size))
    mass = x * rest
    out = []
    for w, u in zip(size, draw):
        rest -= w
        if rest <= 0:
            out.append(_whole(min(max(mass / w, 0.0), 1.0)))
            continue
        f = min(max(mass / (rest + w), 0.0), 1.0)
        up, down = min(w * (1 - f), rest * f), min(w * f, rest * (1 - f))
        if up + down > 0:
            f += up / w if u * (up + down) < down else -down / w
        out.append(_whole(f))
        mass -= out[-1] * w
    return out


def finish(size: list[int], x: float, out: list[float], draw: float) -> list[float]:
    """Settle the last fractional document of a source that is dealt at once, and what this misses against whole ones.

    The document is drawn, and whole documents change sides, the larger ones first, while that brings the
    words nearer to ``x`` times all. Where a document outweighs all the others together, the draw
    may lie beyond what they can make good; then the way that comes nearer is taken.
    """
    last = next((i for i, v in enumerate(out) if 0.0 < v < 1.0), None)
    if last is None:
        return out
    ways = []
    for v in (1.0, 0.0) if draw < out[last] else (0.0, 1.0):
        way = [*out[:last], v, *out[last + 1 :]]
        miss = sum(w * (c - x) for w, c in zip(size, way))
        for i, w in enumerate(size):  # the largest first
            if i != last and w <= abs(miss) and way[i] == (1.0 if miss > 0 else 0.0):
                miss += w * (1 - 2 * way[i])
                way[i] = 1 - way[i]
        ways.append((abs(miss), way))
    drawn, other = ways
    return (drawn if drawn[0] <= max(other[0], size[-1]) else other)[1]


def pair(size: list[int], x: list[float], draw: list[float]) -> list[float]:
    """Pivotal rounding of documents with fractions of their own: the fractional one so far meets the next, and words move until one is whole."""
    out, held = list(x), None
    for j, u in enumerate(draw):
        if not 0.0 < out[j] < 1.0:
            continue
        if held is None:
            held = j
            continue
        wi, xi, wj, xj = size[held], out[held], size[j], out[j]
        up, down = min(wi * (1 - xi), wj * xj), min(wi * xi, wj * (1 - xj))
        move = up if u * (up + down) < down else -down
        out[held], out[j] = _whole(xi + move / wi), _whole(xj - move / wj)
        if not 0.0 < out[held] < 1.0:
            held = j if 0.0 < out[j] < 1.0 else None
    return out


def _settle(leaf: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(frames):
            size, x = group["__size"].tolist(), group["__x"].tolist()
            draw = [_uniform(h & _MASK) for h in group["__draw"].tolist()]
            out = deal(size, x[0], draw) if leaf else pair(size, x, draw)
            if leaf and group["__only"].iloc[0]:
                out = finish(size, x[0], out, draw[0])
            yield pd.DataFrame({"__place": group["__place"].to_numpy(np.int64), "__x": np.array(out, float)})

    return run


def mix(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, identity: Column | None = None) -> DataFrame:
    """``rows`` with columns source and size (and any others) -> plus source_size, target and copies.

    A row's expected copies are target / source_size of its source: the whole part is certain, the
    fraction is settled by pivotal rounding. LEAF_ROWS rows of a source at a time, in the order of a
    hash, leave one fractional row, a small one; these meet in a tree, and the last is drawn. So a
    source's taken words miss its target by a part of one small document. Order and draws hang on
    ``identity`` alone (default: a hash of the row): a rerun agrees.

    A null size counts as 0; rows of size 0 get the certain copies alone, and none in a source without words. Null sources
    are a source of their own. Equal rows are drawn one by one, over as many leaves as they fill. An empty table gives an
    empty result. Columns already called source_size, target or copies are replaced.
    """
    rows = without(rows, "source_size", "target", "copies")
    h = row_hash(rows) if identity is None else identity
    rows = frozen(rows.withColumns({"size": F.coalesce(F.col("size").cast("long"), F.lit(0)), "__h": h}), "mix")
    per = frozen(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("__n")), "sources")
    goal = targets(per.select("source", "source_size"), weights, share, most)
    counts = per.select(F.col("source").alias("__s"), "__n")
    goals = frozen(goal.join(counts, F.col("source").eqNullSafe(F.col("__s"))).drop("__s"), "goals")
    release(per, goal.written)
    goal = goals.withColumnRenamed("source", "__s")
    ratio = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    placed = rows.join(goal, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    placed = placed.withColumns({"__whole": F.floor(ratio).cast("long"), "__x": F.when(F.col("size") > 0, ratio - F.floor(ratio)).otherwise(F.lit(0.0)), "__place": F.monotonically_increasing_id()})
    start = frozen(placed, "pivotal")
    release(rows)
    source = F.xxhash64("source", F.col("source").isNull())
    moving = start.where("__x > 0").select("__place", source.alias("__src"), F.col("size").alias("__size"), "__x", "__h", (F.col("__n") <= LEAF_ROWS).alias("__only"))
    level = number_rows(moving, [F.col("__src"), F.xxhash64("__h"), F.col("__h"), F.col("__size")], "__number")
    begin = frozen(level.groupBy("__src").agg(F.min("__number").alias("__begin")), "begin")
    draw = F.xxhash64("__h", F.col("__number") - F.col("__begin"))  # equal rows get draws of their own
    numbered = level
    level = level.join(begin, "__src").withColumns({"__bucket": F.floor((F.col("__number") - F.col("__begin")) / LEAF_ROWS).cast("long"), "__draw": draw}).drop("__number", "__begin", "__h")
    level = frozen(level, "level")
    release(numbered.written, begin)
    settled, spent, depth = None, [goals, level], 0
    buckets = goal.agg(F.max(F.ceil(F.col("__n") / LEAF_ROWS))).first()[0] or 0
    while True:
        dealt = level.withColumn("__group", F.xxhash64("__src", "__bucket", F.lit(depth)))
        dealt = dealt.repartition("__group").sortWithinPartitions("__group", F.desc("__size"), "__draw", "__place").select("__group", "__place", "__size", "__x", "__only", F.xxhash64("__draw", F.lit(depth)).alias("__draw"))
        out = frozen(dealt.mapInPandas(_settle(depth == 0), "__place long, __x double"), "paired")
        spent.append(out)
        whole = out.where("__x <= 0 or __x >= 1")
        settled = whole if settled is None else settled.union(whole)
        rest = out.where("__x > 0 and __x < 1")
        level = rest.withColumnRenamed("__x", "__y").join(level, "__place").select("__place", "__src", F.expr(f"__bucket div {FAN_IN}").alias("__bucket"), "__size", F.col("__y").alias("__x"), "__only", "__draw")
        if buckets <= 1:
            break
        buckets, depth = -(-buckets // FAN_IN), depth + 1
    chance = F.shiftrightunsigned(F.xxhash64("__draw", F.lit("last")), 11) * F.lit(2.0**-53)
    last = level.select("__place", (chance < F.col("__x")).cast("double").alias("__x"))  # one a source at most
    settled = frozen(settled.union(last), "settled")
    release(*spent)
    both = start.withColumnRenamed("__x", "__y").join(settled, "__place", "left")
    return both.withColumn("copies", F.col("__whole") + F.coalesce(F.col("__x"), F.lit(0.0)).cast("long")).drop("__h", "__place", "__n", "__whole", "__x", "__y")
