"""One long series in many tasks: row numbers without a sort of the whole, blocks of rows with a halo, and carries between blocks.

A window over ``entity`` puts all rows of an entity into one task. Here an entity is cut into blocks of equally many rows, and a
block gets copies of the few rows before and after it that its windows look at, so that windows over (entity, block) give
what windows over the entity would. What runs on without an end, a maximum or an exponential average, is worked out
within blocks, and over a table with a row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import without

ROWS = 1 << 16
RUN = 256  #: maps that are composed one after the other in a row; longer series of maps are composed by levels


TASKS = 64  #: that :func:`spread` deals rows to, at least


def spread(df: DataFrame, *keys: str, tasks: int = TASKS) -> DataFrame:
    """``df`` dealt by ``keys`` to ``tasks`` partitions, or as many as a shuffle of the session has. Spark sizes partitions by their bytes, and makes one of a few MB
    whatever is then done with its rows; these stay apart, and grouping by ``keys`` needs no further exchange."""
    return df.repartition(max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _number(df: DataFrame, order: str) -> Column:
    """``order`` as a double that never falls where it rises."""
    kind = dict(df.dtypes)[order]
    if kind == "date":
        return F.unix_date(order).cast("double")
    return (F.unix_micros(order) if kind == "timestamp" else F.col(order)).cast("double")


def numbered(df: DataFrame, entity: str = "ticker", order: str = "date", rows: int = ROWS) -> DataFrame:
    """``df`` with ``rn``, the number of a row in its entity from 0, and ``n_rows`` of the entity.

    The span of ``order`` is cut into stretches with about ``rows`` rows each, if they lie evenly; counts of stretches give the number at
    which one starts, and only its rows are sorted together. ``order`` (a date, a timestamp or a number) tells the rows of an entity apart; nulls come first.
    """
    df = without(df, "rn", "n_rows").withColumn("__x", _number(df, order))
    spans = df.groupBy(entity).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), F.count("*").alias("n_rows"))
    spans = spans.select(F.col(entity).alias("__e"), "__lo", "__hi", "n_rows", F.ceil(F.col("n_rows") / rows).alias("__m"))
    stretch = F.when(F.col("__x").isNull(), -1).when(F.col("__hi") > F.col("__lo"), F.least(F.col("__m") - 1, F.floor((F.col("__x") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * F.col("__m")))).otherwise(0)
    df = df.join(spans, F.col(entity).eqNullSafe(F.col("__e"))).withColumn("__at", stretch.cast("long")).drop("__x", "__lo", "__hi", "__m", "__e")
    counts = df.groupBy(F.col(entity).alias("__e"), F.col("__at").alias("__a")).agg(F.count("*").alias("__c"))
    before = Window.partitionBy("__e").orderBy("__a").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__e", "__a", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__from"))
    place = F.row_number().over(Window.partitionBy(entity, "__at").orderBy(order))
    joined = df.join(starts, F.col(entity).eqNullSafe(F.col("__e")) & (F.col("__at") == F.col("__a")))
    return joined.withColumn("rn", (F.col("__from") + place - 1).cast("long")).drop("__e", "__a", "__at", "__from")


def halo(df: DataFrame, before: Column | int, after: Column | int = 0, rows: int = ROWS) -> DataFrame:
    """Numbered rows (``rn``, ``n_rows``) in blocks of ``rows`` rows: ``__block``, and ``__own``, false for the copies of the ``before``
    rows before a block and the ``after`` rows after it, at most ``rows`` each."""
    mine = F.expr(f"rn div {rows}")
    ahead = F.when((F.col("rn") >= (mine + 1) * rows - before) & ((mine + 1) * rows < F.col("n_rows")), mine + 1)
    behind = F.when((F.col("rn") < mine * rows + after) & (mine > 0), mine - 1)
    at = F.filter(F.array(mine, ahead, behind), lambda b: b.isNotNull())
    return df.withColumn("__block", F.explode(at)).withColumn("__own", F.col("__block") == F.expr(f"rn div {rows}"))


def cut(df: DataFrame, before: int, after: int = 0, entity: str = "ticker", order: str = "date", rows: int = ROWS) -> DataFrame:
    """``df`` numbered and in blocks, as :func:`halo` gives them. Windows over (entity, __block) may look that far; :func:`own` then drops the copies."""
    if max(before, after) > rows:
        raise ValueError("a block must be as long as the windows look")
    return halo(numbered(without(df, "__block", "__own"), entity, order, rows), before, after, rows)


def own(df: DataFrame) -> DataFrame:
    return df.where("__own").drop("__own")


def running_max(df: DataFrame, value: str, name: str, entity: str = "ticker", order: str = "date") -> DataFrame:
    """``name``: the greatest value so far, of rows in blocks: that of the block so far, and of the blocks before."""
    run = Window.partitionBy(entity, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    tops = df.groupBy(F.col(entity).alias("__e"), F.col("__block").alias("__b")).agg(F.max(value).alias("__top"))
    before = Window.partitionBy("__e").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("__e", "__b", F.max("__top").over(before).alias("__top"))
    joined = df.join(tops, F.col(entity).eqNullSafe(F.col("__e")) & (F.col("__block") == F.col("__b")))
    return joined.withColumn(name, F.greatest(F.max(value).over(run), "__top")).drop("__e", "__b", "__top")


def _composed(first: Column, then: Column) -> Column:
    """For structs of arrays p, q, the maps y -> p * y + q: ``then`` after ``first``."""
    p = F.zip_with(first["p"], then["p"], lambda a, b: a * b)
    q = F.zip_with(F.zip_with(then["p"], first["q"], lambda a, b: a * b), then["q"], lambda a, b: a + b)
    return F.struct(p.alias("p"), q.alias("q"))


def carries(maps: DataFrame, width: int, longest: int) -> DataFrame:
    """``maps(e, seq, p, q)``, arrays of ``width`` maps y -> p * y + q for each entity and seq from 0 -> ``(e, seq, m)``: the maps of all
    seq before it, composed in order.

    RUN maps at a time are composed in a row; the runs are maps again, and are carried in the same way, so that no row or task holds
    more than RUN of them however long a series is. ``longest``: maps of an entity at most.
    """
    none = F.struct(F.array_repeat(F.lit(1.0), F.lit(width)).alias("p"), F.array_repeat(F.lit(0.0), F.lit(width)).alias("q"))
    item = F.struct("seq", F.struct("p", "q").alias("m"))
    runs = maps.groupBy("e", F.expr(f"seq div {RUN}").alias("run")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    start = F.struct(none.alias("m"), F.array().cast("array<struct<seq:bigint,m:struct<p:array<double>,q:array<double>>>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(_composed(acc["m"], x["m"]).alias("m"), F.array_append(acc["out"], F.struct(x["seq"].cast("bigint").alias("seq"), acc["m"].alias("m"))).alias("out"))

    runs = runs.select("e", "run", F.aggregate("items", start, step).alias("r"))
    inside = runs.select("e", "run", F.explode("r.out").alias("o")).select("e", "run", F.col("o.seq").alias("seq"), F.col("o.m").alias("m"))
    if longest <= RUN:
        return inside.drop("run")
    above = carries(runs.select("e", F.col("run").alias("seq"), F.col("r.m.p").alias("p"), F.col("r.m.q").alias("q")), width, -(-longest // RUN))
    above = above.select(F.col("e").alias("__e"), F.col("seq").alias("run"), F.col("m").alias("__m"))
    joined = inside.join(above, inside["e"].eqNullSafe(above["__e"]) & (inside["run"] == above["run"]))
    return joined.select("e", "seq", _composed(F.col("__m"), F.col("m")).alias("m"))
