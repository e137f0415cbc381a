"""Train and test sides by time, without leakage, and walk-forward windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.columns import without

#: Ranges of a draw in which a class is ranked: what is broadcast has at most so many rows a class.
BUCKETS = 1 << 12


def date_index(panel: DataFrame) -> DataFrame:
    """The distinct dates with their positions ``pos`` from 0. There is one row a date, however many rows the panel has."""
    return panel.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


def purged_split(panel: DataFrame, test_size: float = 0.2, horizon: int = 30) -> tuple[DataFrame, DataFrame]:
    """``panel`` with ``side`` (train, purged, test), and one row of metadata.

    Of the sorted distinct dates D, the test side starts at the clamped half-even rounding of
    len(D) * (1 - test_size), and the ``horizon`` dates before it are purged, so that no training
    label looks into the test side. All rows of a date share a side.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    if horizon < 0:
        raise ValueError("horizon must not be negative")
    dates = date_index(panel)
    n = F.count("*").over(Window.partitionBy())
    split = F.greatest(F.lit(1), F.least(F.bround(n * (1 - test_size)).cast("int"), (n - 1).cast("int")))
    marks = dates.withColumns({"n": n, "split_pos": split}).withColumn("purge_pos", F.greatest(F.lit(0), F.col("split_pos") - horizon))
    row = marks.agg(
        F.max("n").alias("n_dates"), F.max(F.when(F.col("pos") == F.col("split_pos"), F.col("date"))).alias("split_date"), F.max(F.when(F.col("pos") == F.col("purge_pos"), F.col("date"))).alias("purge_start"), F.max("purge_pos").alias("purge_pos")
    ).first()
    if row is None or (row["n_dates"] or 0) < 2:
        raise ValueError("needs at least two dates")
    if row["purge_pos"] == 0:
        raise ValueError("the horizon leaves no training rows")
    side = F.when(F.col("date") < F.lit(row["purge_start"]), "train").when(F.col("date") < F.lit(row["split_date"]), "purged").otherwise("test")
    out = panel.withColumn("side", side)
    meta = out.agg(F.lit(row["split_date"]).alias("split_date"), F.lit(row["purge_start"]).alias("purge_start"), F.count_if(F.col("side") == "purged").alias("n_purged"))
    return out, meta


def purged_split_by(panel: DataFrame, by: str, test_size: float = 0.2, horizon: int = 30) -> DataFrame:
    """:func:`purged_split` of every group of ``by``, by the dates of that group. The sides are worked out on the groups' dates, without the driver; a group of which
    no training date is left has test and purged rows only."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    if horizon < 0:
        raise ValueError("horizon must not be negative")
    w = Window.partitionBy("__g")
    dates = panel.select(F.col(by).alias("__g"), F.col("date").alias("__d")).distinct().withColumns({"__pos": F.row_number().over(w.orderBy("__d")) - 1, "__n": F.count("*").over(w)})
    split = F.greatest(F.lit(1), F.least(F.bround(F.col("__n") * (1 - test_size)).cast("int"), (F.col("__n") - 1).cast("int")))
    side = F.when(F.col("__pos") >= split, "test").when(F.col("__pos") < split - horizon, "train").otherwise("purged")
    return panel.join(dates.select("__g", "__d", side.alias("side")), (F.col(by) == F.col("__g")) & (F.col("date") == F.col("__d"))).drop("__g", "__d")


def row_cut_split(panel: DataFrame, train: float = 0.8, embargo_days: int = 60) -> DataFrame:
    """``side`` by position in (date, ticker) order: train up to the cut less a calendar embargo, test from the cut on.

    The cut row is found from counts per date, so rows are never sorted as a whole.
    """
    per = panel.groupBy("date").agg(F.count("*").alias("n"))
    run = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"before": F.coalesce(F.sum("n").over(run), F.lit(0)), "total": F.sum("n").over(Window.partitionBy())})
    row = per.withColumn("cut", F.floor(F.col("total") * train)).where("before <= cut and cut < before + n").select("date", (F.col("cut") - F.col("before")).alias("k")).first()
    if row is None:
        raise ValueError("the panel is empty")
    in_date = F.row_number().over(Window.partitionBy("date").orderBy("ticker"))
    rows = panel.withColumn("__k", in_date)
    after = (F.col("date") > F.lit(row["date"])) | ((F.col("date") == F.lit(row["date"])) & (F.col("__k") > row["k"]))
    side = F.when(after, "test").when(F.col("date") < F.date_sub(F.lit(row["date"]), embargo_days) if embargo_days else F.lit(True), "train").otherwise("purged")
    return rows.withColumn("side", side).drop("__k")


def stratified_split(panel: DataFrame, train: float = 0.8, seed: int = 42, target: str = "target", key: tuple[str, ...] = ("ticker", "date")) -> DataFrame:
    """``side`` at random with the same share of each class: rows ranked by a seeded draw of their key (:mod:`..functions.draws`) within the class.

    A class may hold any share of the rows, so it is ranked in BUCKETS ranges of the draw: the counts of
    the ranges before give the rank at which a range starts.
    """
    rows = panel.withColumn("__h", draws.draw(draws.key_number(*key), seed)).withColumn("__b", F.floor(F.col("__h") / (draws.SPAN // BUCKETS)))
    counts = rows.groupBy(target, "__b").agg(F.count("*").alias("__c"))
    run = Window.partitionBy(target).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(target).alias("__t"), F.col("__b").alias("__at"), F.coalesce(F.sum("__c").over(run), F.lit(0)).alias("__from"), F.sum("__c").over(Window.partitionBy(target)).alias("__n"))
    rows = rows.join(F.broadcast(starts), F.col(target).eqNullSafe(F.col("__t")) & (F.col("__b") == F.col("__at")))
    rank = F.col("__from") + F.row_number().over(Window.partitionBy(target, "__b").orderBy("__h", *key))
    return rows.withColumn("side", F.when(rank <= F.floor(F.col("__n") * train), "train").otherwise("test")).select(*panel.columns, "side")


def walk_forward(panel: DataFrame, train: int = 500, test: int = 60, step: int = 60, purge_rows: int = 0) -> DataFrame:
    """A row for each window that a panel row belongs to: ``window_id``, ``side`` and ``i``, its place on that side; ``panel_rows``: rows of the ticker.

    Window w of a ticker starts at row w * step and exists while train + test rows fit. The windows of
    a row follow from its number, so there is no join. ``purge_rows`` drops the last rows before a test side.
    """
    n = F.count("*").over(Window.partitionBy("ticker"))
    place = F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1
    rows = panel.withColumns({"__p": place, "__n": n}).where(F.col("__n") >= train + test)
    last = F.least(F.expr(f"__p div {step}"), F.expr(f"(__n - {train + test}) div {step}"))
    first = F.greatest(F.lit(0), F.ceil((F.col("__p") - (train + test) + 1) / step).cast("int"))
    rows = rows.withColumns({"__first": first.cast("int"), "__last": last.cast("int")}).where("__first <= __last")
    rows = rows.withColumn("window_id", F.explode(F.sequence("__first", "__last")))
    into = F.col("__p") - F.col("window_id") * step
    rows = rows.withColumn("side", F.when(into >= train, "test").otherwise("train")).withColumn("i", F.when(into >= train, into - train).otherwise(into).cast("int"))
    if purge_rows:
        rows = rows.where((F.col("side") == "test") | (F.col("i") < train - purge_rows))
    return without(rows, "panel_rows").withColumnRenamed("__n", "panel_rows").drop("__p", "__first", "__last")


def regime_split(panel: DataFrame, regimes: DataFrame, embargo_days: int = 60, min_train: int = 1000, min_test: int = 50) -> DataFrame:
    """For each regime (regime, start, end; both ends included) its test rows and all earlier training rows; small ones are skipped."""
    r = regimes  # a handful of rows; Spark broadcasts them by their size
    test = panel.join(r, F.col("date").between(F.col("start"), F.col("end"))).withColumn("side", F.lit("test"))
    train = panel.join(r, F.col("date") < F.date_sub("start", embargo_days)).withColumn("side", F.lit("train"))
    both = train.unionByName(test)
    sizes = both.groupBy("regime").agg(F.count_if(F.col("side") == "train").alias("n_train"), F.count_if(F.col("side") == "test").alias("n_test"))
    return both.join(F.broadcast(sizes.where((F.col("n_train") >= min_train) & (F.col("n_test") >= min_test)).select("regime")), "regime", "left_semi").drop("start", "end")


def trailing_validation(rows: DataFrame, share: float = 0.15, entity: str = "ticker", order: str = "date") -> DataFrame:
    """``side``: the last ``share`` of each entity's rows (at least one, never all) are for validation."""
    n = F.count("*").over(Window.partitionBy(entity))
    held = F.greatest(F.lit(1), F.least(F.floor(n * share), n - 1))
    place = F.row_number().over(Window.partitionBy(entity).orderBy(order))
    return rows.withColumn("side", F.when(place > n - held, "validation").otherwise("train"))
