"""Probability of backtest overfitting from scores of candidates by split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_clusters(df: DataFrame, by: list[str], value: str, tolerance: float, out: str = "cluster") -> DataFrame:
    """Sorted values belong together until a step is over the tolerance."""
    w = Window.partitionBy(*by).orderBy(value) if by else Window.partitionBy(F.lit(0)).orderBy(value)  # few values
    gap = (F.col(value) - F.lag(value).over(w) > tolerance).cast("int")
    return df.withColumn(out, F.sum(F.coalesce(gap, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def split_outcomes(scores: DataFrame, unit: str = "candidate") -> DataFrame:
    """scores (split_id, unit, in_score, out_score) -> per split the in-sample winner, its runner-up's gap, its
    out-of-sample rank share (1 is best), logit and overfit flag (logit < 0; exactly one half is not overfit)."""
    inn = Window.partitionBy("split_id").orderBy(F.desc("in_score"), unit)
    oos = Window.partitionBy("split_id").orderBy("out_score", F.desc(unit))
    df = scores.withColumn("__in", F.row_number().over(inn)).withColumn("__out", F.row_number().over(oos))
    df = df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("split_id"))).withColumn("__gap", F.col("in_score") - F.lead("in_score").over(inn))
    df = df.where("__in = 1").withColumn("rank_share", F.col("__out") / F.col("__n"))
    omega = F.least(F.greatest("rank_share", F.lit(1e-6)), F.lit(1 - 1e-6))
    df = df.withColumn("logit", F.log(omega / (1 - omega))).withColumn("overfit", F.col("logit") < -1e-12)
    return df.select("split_id", F.col(unit).alias("winner"), F.col("__gap").alias("winner_gap"), "out_score", "rank_share", "logit", "overfit")


def pbo(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.avg(F.col("overfit").cast("double")).alias("pbo"), F.count(F.lit(1)).alias("splits")).withColumn("label", pbo_label(F.col("pbo")))


def pbo_label(p: Column) -> Column:
    return F.when(p.isNull(), "not_available").when(p < 0.2, "low_overfit_risk").when(p < 0.5, "moderate_overfit_risk").when(p < 0.8, "high_overfit_risk").otherwise("severe_overfit_risk")


def cluster_scores(scores: DataFrame, clusters: DataFrame) -> DataFrame:
    """Mean in- and out-of-sample score of each cluster by split."""
    return scores.join(F.broadcast(clusters), "candidate").groupBy("split_id", "cluster").agg(F.avg("in_score").alias("in_score"), F.avg("out_score").alias("out_score"))


def axis_contribution(outcomes: DataFrame, grid: DataFrame, axes: list[str]) -> DataFrame:
    """Wins and overfit share by value of each axis of the candidate grid."""
    rows = outcomes.join(F.broadcast(grid), outcomes["winner"] == grid["candidate"]).select("overfit", *[F.col(a).cast("string").alias(a) for a in axes])
    rows = rows.unpivot(["overfit"], axes, "axis", "value")
    return rows.groupBy("axis", "value").agg(F.count(F.lit(1)).alias("wins"), F.avg(F.col("overfit").cast("double")).alias("overfit_share"))


def near_competition(outcomes: DataFrame, close: float) -> DataFrame:
    """Share of splits whose winner leads by at most `close`, and the median lead."""
    return outcomes.agg(F.avg((F.col("winner_gap") <= close).cast("double")).alias("close_ratio"), F.percentile("winner_gap", 0.5).alias("median_gap"), F.count_distinct("winner").alias("winners"))


def mean_out_of_sample(scores: DataFrame) -> DataFrame:
    return scores.groupBy("candidate").agg(F.avg("out_score").alias("mean_out"), F.count(F.lit(1)).alias("splits"))


def named_clusters(grid: DataFrame, axes: dict[str, float]) -> DataFrame:
    """grid (candidate, strategy, axes...) plus cluster: on each axis neighbouring values within the tolerance are one, named
    by their range; the cluster is the strategy and its ranges."""
    out = grid
    for axis, tolerance in axes.items():
        values = gap_clusters(grid.select(axis).distinct(), [], axis, tolerance, "__c")
        ends = values.groupBy("__c").agg(F.min(axis).alias("a"), F.max(axis).alias("b"))
        text = lambda c: F.format_string("%.2f", F.col(c).cast("double"))
        label = F.when(F.col("a") == F.col("b"), text("a")).otherwise(F.concat_ws("-", text("a"), text("b")))
        named = values.join(ends, "__c").select(axis, F.concat(F.lit(f"{axis}="), label).alias(f"__{axis}"))
        out = out.join(F.broadcast(named), axis)  # as many rows as values of a tiny grid
    return out.withColumn("cluster", F.concat_ws("|", "strategy", *[f"__{a}" for a in axes])).drop(*[f"__{a}" for a in axes])


def family_summary(candidates: DataFrame, axes: list[str], metrics: list[str]) -> DataFrame:
    """Candidates' mean out-of-sample metrics by value of each axis, in one pass of grouping sets."""
    out = candidates.groupingSets([[a] for a in axes], *axes).agg(F.count(F.lit(1)).alias("candidates"), *[F.avg(m).alias(m) for m in metrics], *[F.grouping(a).alias(f"__g_{a}") for a in axes])
    name = F.coalesce(*[F.when(F.col(f"__g_{a}") == 0, F.lit(a)) for a in axes])
    value = F.coalesce(*[F.when(F.col(f"__g_{a}") == 0, F.col(a).cast("string")) for a in axes])
    return out.select(name.alias("axis"), value.alias("value"), "candidates", *metrics)


def cluster_summary(candidates: DataFrame, metrics: list[str]) -> DataFrame:
    return candidates.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.array_join(F.array_sort(F.collect_set("candidate")), ",").alias("names"), *[F.avg(m).alias(m) for m in metrics])


def competition(outcomes: DataFrame, runner_up: DataFrame, grid: DataFrame, axes: list[str], close: float, ratio: float = 0.5, dominance: float = 0.6) -> DataFrame:
    """One row: share of close splits, their axis flips between winner and runner-up, the axis value with the largest
    overfit share, and whether close competition dominates."""
    g = lambda side: grid.select(F.col("candidate").alias(side), *[F.col(a).alias(f"{side}_{a}") for a in axes])
    x = outcomes.join(runner_up, "split_id").join(F.broadcast(g("winner")), "winner").join(F.broadcast(g("second")), "second")
    near = F.col("winner_gap") <= close
    flips = [F.coalesce(F.avg(F.when(near, (F.col(f"winner_{a}") != F.col(f"second_{a}")).cast("double"))), F.lit(0.0)).alias(f"{a}_flips") for a in axes]
    one = x.agg(F.avg(near.cast("double")).alias("close_ratio"), F.avg("winner_gap").alias("mean_gap"), F.percentile("winner_gap", 0.5).alias("median_gap"), *flips)
    top = axis_contribution(outcomes, grid, axes).agg(F.max(F.struct("overfit_share", "wins", "axis", "value")).alias("d"))
    out = one.crossJoin(top).select("*", F.col("d.axis").alias("dominant_axis"), F.col("d.value").alias("dominant_value"), F.col("d.overfit_share").alias("dominant_overfit_share")).drop("d")
    return out.withColumn("competition_dominated", (F.col("close_ratio") >= ratio) & (F.col("dominant_overfit_share") >= dominance))


def runners_up(scores: DataFrame, unit: str = "candidate") -> DataFrame:
    w = Window.partitionBy("split_id").orderBy(F.desc("in_score"), unit)
    return scores.withColumn("__n", F.row_number().over(w)).where("__n = 2").select("split_id", F.col(unit).alias("second"))
