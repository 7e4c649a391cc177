"""Walk-forward and purged combinatorial folds over distinct dates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def date_index(panel: DataFrame, date: str = "date") -> DataFrame:
    """Distinct dates with a dense index from 0 (a date table: as many rows as dates)."""
    return panel.select(date).distinct().withColumn("idx", F.row_number().over(Window.orderBy(date)) - 1)


def walk_forward_cuts(dates: DataFrame, first_train: int, eval_size: int, step: int, embargo: int = 0) -> DataFrame:
    """(fold_id, cut): the number of training dates of each fold, a row a fold."""
    n = dates.agg(F.count(F.lit(1)).alias("n"))
    last = F.greatest(F.floor((F.col("n") - first_train - embargo - eval_size) / F.lit(step)), F.lit(0)).cast("int")
    folds = n.select(F.explode(F.sequence(F.lit(0), last)).alias("fold_id"), "n").withColumn("cut", F.lit(first_train) + F.col("fold_id") * step)
    return folds.where(F.col("cut") + embargo + eval_size <= F.col("n")).drop("n")


def walk_forward(dates: DataFrame, first_train: int, eval_size: int, step: int, embargo: int = 0) -> DataFrame:
    """(fold_id, date, role): an expanding training window, an embargo, then an evaluation window that moves by step."""
    folds = walk_forward_cuts(dates, first_train, eval_size, step, embargo)
    on = (F.col("idx") < F.col("cut")) | ((F.col("idx") >= F.col("cut") + embargo) & (F.col("idx") < F.col("cut") + embargo + eval_size))
    out = dates.join(F.broadcast(folds), on)  # as many rows as folds
    return out.select("fold_id", "date", F.when(F.col("idx") < F.col("cut"), "train").otherwise("eval").alias("role"))


def combinatorial_splits(groups: int, test_groups: int, most: int) -> list[tuple[int, ...]]:
    """Chosen group sets, thinned to `most` by even spacing."""
    every = list(combinations(range(groups), test_groups))
    if len(every) <= most:
        return every
    return [every[int(i * (len(every) - 1) / max(1, most - 1))] for i in range(most)]


def purged_splits(dates: DataFrame, groups: int, test_groups: int, embargo: int, most: int) -> DataFrame:
    """(split_id, date, role): test dates of the chosen groups; training dates farther than embargo from any of them."""
    spark = dates.sparkSession
    picks = spark.createDataFrame([(i, g) for i, p in enumerate(combinatorial_splits(groups, test_groups, most)) for g in p], "split_id int, grp int")
    dates = dates.withColumn("grp", F.ntile(groups).over(Window.orderBy("idx")) - 1)
    test = dates.join(F.broadcast(picks), "grp").select("split_id", "date", "idx")
    near = test.select("split_id", F.explode(F.sequence(F.col("idx") - embargo, F.col("idx") + embargo)).alias("idx")).distinct()
    every = dates.crossJoin(F.broadcast(picks.select("split_id").distinct()))
    train = every.join(near, ["split_id", "idx"], "left_anti").select("split_id", "date", F.lit("train").alias("role"))
    return train.unionByName(test.select("split_id", "date", F.lit("test").alias("role")))


def calibration_tail(dates: DataFrame, fraction: float, min_days: int) -> DataFrame:
    """Last max(min_days, round(n * fraction)) dates; none when n is at most that plus 5."""
    n = dates.agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.greatest(F.lit(min_days), F.bround(F.col("n") * fraction).cast("int")))
    return dates.crossJoin(F.broadcast(n)).where((F.col("n") > F.col("size") + 5) & (F.col("idx") >= F.col("n") - F.col("size"))).drop("n", "size")


def recent_windows(dates: DataFrame, width: int) -> DataFrame:
    """(date, part): the last `width` dates are current, the `width` before them reference."""
    n = dates.agg(F.count(F.lit(1)).alias("n"))
    out = dates.crossJoin(F.broadcast(n)).where(F.col("idx") >= F.col("n") - 2 * width)
    return out.select("date", F.when(F.col("idx") >= F.col("n") - width, "current").otherwise("reference").alias("part"))


def chronological_cut(dates: DataFrame, share: float = 0.8) -> DataFrame:
    """(date, idx, part): the first int(n * share) dates train (at least one of each part), the rest are validation."""
    n = dates.agg(F.count(F.lit(1)).alias("n"))
    cut = F.greatest(F.lit(1), F.least(F.floor(F.col("n") * share), F.col("n") - 1))
    return dates.crossJoin(F.broadcast(n)).select("date", "idx", F.when(F.col("idx") < cut, "train").otherwise("validation").alias("part"))
