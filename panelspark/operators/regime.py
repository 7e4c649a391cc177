"""Market regimes from daily observations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def market_observations(panel: DataFrame, ret: str, vol: str, level: str, change: str) -> DataFrame:
    """Mean return, median volatility, median level and median change of each date."""
    return panel.groupBy("date").agg(F.avg(ret).alias("mean_return"), F.percentile(vol, 0.5).alias("median_vol"), F.percentile(level, 0.5).alias("median_level"), F.percentile(change, 0.5).alias("median_change"))


def threshold_state(level: Column, low: float, high: float) -> Column:
    return F.when(level < low, "low_vol").when(level < high, "transition").when(level.isNotNull(), "high_vol").otherwise("unknown")


def state_statistics(days: DataFrame, state: str = "state") -> DataFrame:
    return days.groupBy(state).agg(F.count(F.lit(1)).alias("days"), F.avg("mean_return").alias("mean_return"), F.avg("median_vol").alias("mean_vol"), F.avg("median_level").alias("mean_level"))


def named_states(stats: DataFrame, state: str = "state") -> DataFrame:
    """The state of lowest (volatility, level) is low_vol, the highest high_vol, others transition."""
    w = Window.orderBy("mean_vol", "mean_level", state)  # one row a state
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rank = F.row_number().over(w)
    return stats.withColumn("regime", F.when(rank == 1, "low_vol").when(rank == n, "high_vol").otherwise("transition"))


def transitions(days: DataFrame, state: str = "state", recent: int = 20) -> DataFrame:
    """Per date: previous state, most frequent state of the recent days before, share of changes among them, shift flag."""
    w = Window.orderBy("date")  # a date table
    back = w.rowsBetween(-recent, -1)
    df = days.withColumn("previous", F.lag(state).over(w))
    df = df.withColumn("__change", F.when(F.col("previous").isNotNull(), (F.col(state) != F.col("previous")).cast("double")))
    df = df.withColumn("__list", F.collect_list(state).over(back)).withColumn("transition_rate", F.coalesce(F.avg("__change").over(back), F.lit(0.0)))
    names = F.array_sort(F.array_distinct("__list"))
    counts = F.transform(names, lambda s: F.struct(-F.size(F.filter("__list", lambda y: y == s)), s.alias("s")))
    df = df.withColumn("dominant_recent", F.get(F.array_sort(counts), F.lit(0))["s"])
    return df.withColumn("shifted", F.coalesce(F.col("dominant_recent") != F.col(state), F.lit(False))).drop("__list", "__change")


def mixture_states(days: DataFrame, columns: list[str], order: str, k: int = 3, rounds: int = 15) -> DataFrame:
    """days (complete rows only) plus state, from a mixture of k Gaussians with diagonal spread over standardised observations (no
    transition matrix), and share, the state's probability.

    Expectation-maximisation for a fixed number of rounds from a fixed start: the k-tiles of `order`. A round is one aggregate of
    one row, run when called; the last model scores the days lazily. Persist the days before."""
    p = range(len(columns))
    x = days.dropna(subset=columns)
    base = x.agg(*[f.alias(f"{n}{j}") for j, c in enumerate(columns) for n, f in (("m", F.avg(c)), ("s", F.stddev_pop(c)))]).first()
    scaled = {f"__x{j}": (F.col(c) - (base[f"m{j}"] or 0.0)) / (base[f"s{j}"] or 1.0) for j, c in enumerate(columns)}
    tile = F.ntile(k).over(Window.orderBy(order, "date")) - 1  # a date table
    x = x.withColumn("__t", tile).withColumns(scaled)
    shares = [(F.col("__t") == c).cast("double") for c in range(k)]
    for _ in range(rounds):
        rows = x.withColumns({f"__r{c}": s for c, s in enumerate(shares)})
        sums = [s.alias(n) for c in range(k) for r in [F.col(f"__r{c}")] for n, s in [(f"n{c}", F.sum(r)), *[(f"a{c}_{j}", F.sum(r * F.col(f"__x{j}"))) for j in p], *[(f"q{c}_{j}", F.sum(r * F.col(f"__x{j}") * F.col(f"__x{j}"))) for j in p]]]
        m = rows.agg(F.count(F.lit(1)).alias("n"), *sums).first()
        if not m["n"]:
            break
        logs = []
        for c in range(k):
            n = m[f"n{c}"] or 1e-12
            mean = [m[f"a{c}_{j}"] / n for j in p]
            var = [max(m[f"q{c}_{j}"] / n - mean[j] ** 2, 1e-3) for j in p]
            away = sum((F.pow(F.col(f"__x{j}") - mean[j], 2) / var[j] for j in p), F.lit(0.0))
            logs.append(F.lit(math.log(max(n / m["n"], 1e-12)) - 0.5 * sum(math.log(v) for v in var)) - 0.5 * away)
        x = x.drop(*[f"__d{c}" for c in range(k)]).withColumns({f"__d{c}": d for c, d in enumerate(logs)})
        e = [F.exp(F.col(f"__d{c}") - F.greatest(*[f"__d{i}" for i in range(k)])) for c in range(k)]
        shares = [v / sum(e[1:], e[0]) for v in e]
    every = F.array(*shares)
    return x.select(*days.columns, (F.array_position(every, F.array_max(every)) - 1).cast("int").alias("state"), F.array_max(every).alias("share"))
