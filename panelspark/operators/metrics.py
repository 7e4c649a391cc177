"""Forecast metrics by group (fold)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.stats import normal_cdf, safe_corr

PROBS = ("prob_down", "prob_flat", "prob_up")


def argmax(*probs: str) -> Column:
    """Index of the largest value, the first on ties."""
    a = F.array(*probs)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def class_metrics(df: DataFrame, by: list[str], label: str = "direction_label") -> DataFrame:
    """Hit rate, log loss (clipped at 1e-9), Brier score and calibration gap of each group."""
    p = F.array(*PROBS)
    hit = (argmax(*PROBS) == F.col(label)).cast("double")
    conf = F.array_max(p)
    loss = -F.log(F.greatest(F.element_at(p, F.col(label) + 1), F.lit(1e-9)))
    brier = sum(F.pow(F.col(c) - (F.col(label) == i).cast("double"), 2) for i, c in enumerate(PROBS))
    return df.where(F.col(label).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("hit_rate"), F.avg(loss).alias("log_loss"), F.avg(brier).alias("brier"), F.abs(F.avg(conf) - F.avg(hit)).alias("calibration_gap"))


def expected_calibration_error(df: DataFrame, by: list[str], bins: int = 10, label: str = "direction_label") -> DataFrame:
    """Mean gap of confidence and accuracy over equal-width bins, weighted by rows; the top bin is closed on the right."""
    conf = F.array_max(F.array(*PROBS))
    rows = df.where(F.col(label).isNotNull()).withColumn("conf", conf).withColumn("hit", (argmax(*PROBS) == F.col(label)).cast("double"))
    rows = rows.groupBy(*by, F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("c"), F.avg("hit").alias("h"))
    return rows.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("h"))) / F.sum("n")).alias("ece"))


def average_ranks(df: DataFrame, by: list[str], value: str, out: str, cells: int = 16) -> DataFrame:
    """(by, value, out): the average rank of each distinct value within its group. Distinct values are counted first. A mergeable
    sketch cuts the values of a group into cells of about equal size; values are ordered inside their cell only and get the
    number of rows in the cells below, so no task orders a whole group."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    edges = df.groupBy(*by).agg(F.percentile_approx(value, [i / cells for i in range(1, cells)], 1000).alias("__e"))  # a row a group
    counts = counts.join(edges, by).withColumn("__b", F.size(F.filter("__e", lambda e: e < F.col(value)))).drop("__e")
    w = Window.partitionBy(*by, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("__to", F.sum("__c").over(w))
    below = counts.groupBy(*by, "__b").agg(F.max("__to").alias("__s"))
    below = below.select(*by, "__b", (F.sum("__s").over(Window.partitionBy(*by).orderBy("__b")) - F.col("__s")).alias("__below"))  # `cells` rows a group
    return counts.join(below, [*by, "__b"]).select(*by, value, (F.col("__below") + F.col("__to") - (F.col("__c") - 1) / 2.0).alias(out))


def information_coefficients(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson and rank correlation of x and y over rows where both are finite."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"))
    ranked = ok.join(average_ranks(ok, by, "__x", "__rx"), [*by, "__x"]).join(average_ranks(ok, by, "__y", "__ry"), [*by, "__y"])
    return ranked.groupBy(*by).agg(safe_corr(F.col("__x"), F.col("__y")).alias("ic"), safe_corr(F.col("__rx"), F.col("__ry")).alias("rank_ic"))


def return_metrics(df: DataFrame, by: list[str], predicted: str, actual: str) -> DataFrame:
    """MAE and RMSE of returns; MAPE over rows whose actual is not 0 (0 if there is none)."""
    e = F.col(predicted) - F.col(actual)
    pct = F.when(F.col(actual) != 0, F.abs(F.try_divide(e, F.col(actual))))
    ok = df.where(e.isNotNull())
    return ok.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.coalesce(F.avg(pct), F.lit(0.0)).alias("mape"))


def class_priors(df: DataFrame, by: list[str], label: str = "direction_label") -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg((F.col(label) == i).cast("double")).alias(f"prior_{i}") for i in range(3)])


def training_priors(rows: DataFrame, dates: DataFrame, cuts: DataFrame, label: str = "direction_label") -> DataFrame:
    """(fold_id, prior_0, prior_1, prior_2): class shares of the rows of each fold's training dates, 0 for a class without rows.
    Counts are taken once a date and cumulated over the dates."""
    w = Window.orderBy("idx")  # a date table
    counts = rows.groupBy("date").agg(*[F.count_if(F.col(label) == i).alias(f"n_{i}") for i in range(3)])
    total = dates.join(counts, "date", "left").select("idx", *[F.sum(F.coalesce(f"n_{i}", F.lit(0))).over(w).alias(f"n_{i}") for i in range(3)])
    n = F.col("n_0") + F.col("n_1") + F.col("n_2")
    return cuts.select("fold_id", (F.col("cut") - 1).alias("idx")).join(total, "idx").select("fold_id", *[F.try_divide(f"n_{i}", n).alias(f"prior_{i}") for i in range(3)])


def diebold_mariano(df: DataFrame, by: list[str], differential: str) -> DataFrame:
    """Mean loss differential over its standard error, and the two-sided p-value (normal, error below 1e-6)."""
    d = F.col(differential)
    out = df.groupBy(*by).agg(F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.count(d).alias("n"))
    out = out.withColumn("dm_stat", F.when((F.col("n") < 2) | (F.coalesce("sd", F.lit(0.0)) == 0), 0.0).otherwise(F.try_divide("mean", F.try_divide("sd", F.sqrt("n")))))
    return out.withColumn("p_value", 2 * (1 - normal_cdf(F.abs("dm_stat")))).drop("mean", "sd", "n")


def fold_summary(folds: DataFrame, metrics: list[str], breach: tuple[str, float]) -> DataFrame:
    """Mean and population deviation of each metric over folds; folds whose breach metric is under its floor."""
    name, floor = breach
    return folds.agg(*[f for m in metrics for f in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))], F.count_if(F.col(name) < floor).alias("breaches"), F.avg((F.col(name) < floor).cast("double")).alias("breach_ratio"))


def compare_to(folds: DataFrame, model: str, primary: str, metrics: list[str]) -> DataFrame:
    """Each model's mean metrics and their differences to the primary model's."""
    mean = folds.groupBy(model).agg(*[F.avg(m).alias(m) for m in metrics])
    base = mean.where(F.col(model) == primary).select(*[F.col(m).alias(f"__{m}") for m in metrics])
    out = mean.crossJoin(F.broadcast(base))  # one row
    return out.select(model, *metrics, *[(F.col(m) - F.col(f"__{m}")).alias(f"{m}_delta") for m in metrics])


def family_importance(importance: DataFrame, catalog: DataFrame) -> DataFrame:
    """importance (feature, value) with the catalog (feature, family, source, missing_rate, stale_rate) -> by family: features,
    mean importance and rates, sources. Features without an entry are family `unknown`."""
    x = importance.join(catalog, "feature", "left").withColumn("family", F.coalesce("family", F.lit("unknown"))).withColumn("source", F.coalesce("source", F.lit("unknown")))
    zero = lambda c: F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(f"mean_{c}")
    return x.groupBy("family").agg(F.count(F.lit(1)).alias("features"), F.avg("value").alias("mean_importance"), zero("missing_rate"), zero("stale_rate"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"))
