"""Sharding: a Feistel permutation over global row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import frozen, row_hash, without

ROUNDS = 6
_M = 2**31
_A, _B = 1103515245, 1566083941
_IN_PART = (1 << 33) - 1


def number_rows(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """``df`` with a gapless 0-based long ``name`` that follows ``order``, without a one-task sort.

    Range partitions are sorted and written; a row's number is its place in its partition plus the
    sizes of the partitions before it. Rows that tie in all of ``order`` are numbered in scan order;
    a hot tie is dealt over partitions too. The result reads the table in its attribute ``written``.
    """
    keyed = df.withColumns({f"__o{i}": c for i, c in enumerate(order)}).withColumn("__tie", F.monotonically_increasing_id())
    keys = [f"__o{i}" for i in range(len(order))]
    placed = (
        keyed.repartitionByRange(*keys, "__tie")
        .sortWithinPartitions(*keys, "__tie")
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PART)))
        .drop(*keys, "__tie")
    )
    placed = frozen(placed, "numbered")
    sizes = placed.groupBy("__part").count()  # one row a partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__from"))
    out = placed.join(F.broadcast(starts), "__part").withColumn(name, F.col("__from") + F.col("__at")).drop("__part", "__at", "__from")
    out.written = placed
    return out


def round_keys(seed: int) -> list[int]:
    """One key a round, from the seed."""
    keys, x = [], seed % _M
    for _ in range(ROUNDS):
        x = (x * 69069 + 362437) % _M
        keys.append(x)
    return keys


def sides(n: int) -> tuple[int, int]:
    """The halves' sizes a, b: a*b is the least rectangle over n with a = ceil(sqrt(n)), so under a numbers lie outside."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def _mixed(v: str, key: str) -> str:
    f1 = f"(({v} + {key}) % {_M}L * {_A}L % {_M}L)"
    f2 = f"(({f1} ^ shiftright({f1}, 15)) * {_B}L % {_M}L)"
    return f"({f2} ^ shiftright({f2}, 13))"


def permuted(row: str, n: int, seed: int) -> Column:
    """The place of row number ``row`` (a column name) among ``n``: a Feistel network on the a x b rectangle, walked until it lands below n.

    A walk leaves [0, n) for numbers not met before, so it ends within a*b-n+1 steps. From 577 rows
    on, more than 24 steps have a chance below 24**-24 a row; such a row would raise an error, never be lost.
    """
    a, b = sides(n)
    keys = ", ".join(f"{k}L" for k in round_keys(seed))

    def network(v: str) -> str:
        left = f"named_struct('l', (s.l + {_mixed('s.r', 'k')}) % {a}L, 'r', s.r, 'i', s.i + 1)"
        right = f"named_struct('l', s.l, 'r', (s.r + {_mixed('s.l', 'k')}) % {b}L, 'i', s.i + 1)"
        return f"aggregate(array({keys}), named_struct('l', {v} div {b}L, 'r', {v} % {b}L, 'i', 0), (s, k) -> if(s.i % 2 = 0, {left}, {right}), s -> s.l * {b}L + s.r)"

    steps = min(a * b - n, 24)
    walked = f"aggregate(sequence(0, {steps}), {network(f'`{row}`')}, (v, j) -> if(v < {n}L, v, {network('v')}))" if steps else network(f"`{row}`")
    return F.expr(walked)


def shard(df: DataFrame, shards: int, order: list[Column] | None = None, seed: int = 20260101) -> DataFrame:
    """All rows of ``df`` with ``row_number``, ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in its shard).

    Rows are numbered by ``order`` (default: ``doc_id`` if there is one, then a hash of the row, so a
    rerun over the same rows in other files agrees), permuted, and dealt in turn: shard = place mod
    shards, slot = place div shards. Shard counts differ by one at most. :func:`row_of` inverts it.

    Nulls are ordinary values (a null key sorts first). Rows that are equal throughout take
    neighbouring numbers and are all kept. An empty table gives an empty result. Columns already
    called row_number, shard or slot are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    df = without(df, "row_number", "shard", "slot")
    if order is None:
        order = ([F.col("doc_id")] if "doc_id" in df.columns else []) + [row_hash(df)]
    rows = number_rows(df, order)
    n = rows.agg(F.count("*")).first()[0]
    if n == 0:
        return rows.withColumns({"shard": F.lit(0), "slot": F.col("row_number")})
    placed = rows.withColumn("__place", permuted("row_number", n, seed))
    placed = placed.withColumn("__place", F.when(F.col("__place") < n, F.col("__place")).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long")))
    return placed.withColumns({"shard": (F.col("__place") % shards).cast("int"), "slot": F.expr(f"__place div {shards}L")}).drop("__place")


def row_of(shard_no: int, slot: int, shards: int, n: int, seed: int = 20260101) -> int:
    """The row number that sits at ``slot`` of ``shard_no``: the network run backwards."""
    a, b = sides(n)
    keys = round_keys(seed)

    def mixed(v: int, key: int) -> int:
        f = (v + key) % _M * _A % _M
        f = (f ^ f >> 15) * _B % _M
        return f ^ f >> 13

    v = slot * shards + shard_no
    while True:
        l, r = divmod(v, b)
        for i in reversed(range(ROUNDS)):
            if i % 2 == 0:
                l = (l - mixed(r, keys[i])) % a
            else:
                r = (r - mixed(l, keys[i])) % b
        v = l * b + r
        if v < n:
            return v
