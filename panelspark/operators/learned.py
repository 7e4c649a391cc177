"""Learned weights of (source, session) combinations, fitted walk-forward on trailing history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.calendar import bday_ord
from panelspark.operators.news import floor_weights


def combo_rows(items: DataFrame) -> DataFrame:
    """Items -> one row a (ticker, date, source, session): sums of weight, weighted sentiment and relevance, and articles."""
    w = F.greatest(F.least("relevance_score", F.lit(1.0)), F.lit(0.0))
    return items.groupBy("ticker", "date", "source_name", F.col("session").alias("session_bucket"), F.concat_ws("::", "source_name", "session").alias("combo_key")).agg(F.sum(w).alias("base_weight_sum"), F.sum(w * F.col("sentiment_score")).alias("sentiment_weighted_sum"), F.sum(w * F.col("relevance_score")).alias("relevance_weighted_sum"), F.count(F.lit(1)).alias("article_count"))


def expand_breakdown(daily: DataFrame, breakdown: str = "breakdown") -> DataFrame:
    """daily (ticker, date, source_mix, source, session_bucket, headline_count, sentiment_score, relevance_score, breakdown
    map combo -> struct) -> rows of combinations. Without a breakdown the day's weight is split over its sources."""
    have = F.col(breakdown).isNotNull() & (F.size(breakdown) > 0)
    full = daily.where(have).select("ticker", "date", F.explode(breakdown).alias("combo_key", "s"))
    full = full.select("ticker", "date", F.substring_index("combo_key", "::", 1).alias("source_name"), F.substring_index("combo_key", "::", -1).alias("session_bucket"), "combo_key", F.greatest(F.col("s.weight"), F.lit(0.0)).alias("base_weight_sum"), F.col("s.sentiment_sum").alias("sentiment_weighted_sum"), F.col("s.articles").cast("double").alias("article_count"))
    names = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce("source_mix", F.lit("")), "[|]"), F.trim), lambda x: (x != "") & (x != "none"))))
    alone = F.when(F.coalesce(F.trim("source"), F.lit("")).isin("", "none"), F.array(F.lit("unknown"))).otherwise(F.array(F.trim("source")))
    names = F.when(F.size(names) > 0, names).otherwise(alone)
    clip = F.greatest(F.least(F.coalesce("relevance_score", F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    weight = F.when(F.col("headline_count") * clip > 0, F.col("headline_count") * clip).otherwise(F.col("headline_count"))
    rest = daily.where(~F.coalesce(have, F.lit(False))).withColumn("__w", weight).where("__w > 0").withColumn("__s", names)
    share = F.col("__w") / F.size("__s")
    articles = F.greatest(F.bround(F.col("headline_count") / F.size("__s")), F.lit(1.0))
    rest = rest.select("ticker", "date", F.explode("__s").alias("source_name"), F.coalesce("session_bucket", F.lit("unknown")).alias("session_bucket"), share.alias("base_weight_sum"), (F.col("sentiment_score") * share).alias("sentiment_weighted_sum"), articles.cast("double").alias("article_count"))
    return full.unionByName(rest.withColumn("combo_key", F.concat_ws("::", "source_name", "session_bucket")))


def target_score(abs_ic: Column, overlap: Column, target: str) -> Column:
    return {"overlap_rate": overlap, "combined": abs_ic * overlap}.get(target, abs_ic)


def trailing_fits(combos: DataFrame, returns: DataFrame, lookback: int, target: str = "abs_ic") -> DataFrame:
    """(date, combo_key, n, signal_days, abs_ic, overlap_rate, target_score) for each evaluation date and each combination
    that has a sample in the `lookback` business days before it.

    Moments are summed by day first; the history is then a range of ordinals over the day sums, not a join of the rows."""
    x = combos.join(returns.select("ticker", "date", "ret"), ["ticker", "date"], "left").withColumn("signal", F.try_divide("sentiment_weighted_sum", F.when(F.col("base_weight_sum") != 0, F.col("base_weight_sum"))))
    on = F.col("base_weight_sum") > 0
    both = on & F.col("ret").isNotNull() & F.col("signal").isNotNull()
    s = lambda c: F.sum(F.when(both, c).otherwise(0.0))
    sums = {"n": s(F.lit(1.0)), "sx": s(F.col("signal")), "sy": s(F.col("ret")), "sxx": s(F.col("signal") ** 2), "syy": s(F.col("ret") ** 2), "sxy": s(F.col("signal") * F.col("ret")), "days": F.sum(on.cast("double"))}
    day = x.groupBy("combo_key", "date").agg(*[v.alias(k) for k, v in sums.items()])
    grid = day.select("date").distinct().crossJoin(F.broadcast(day.select("combo_key").distinct()))  # dates x a few combinations
    back = Window.partitionBy("combo_key").orderBy("ord").rangeBetween(-lookback, -1)
    t = grid.join(day, ["combo_key", "date"], "left").withColumn("ord", bday_ord(F.col("date")))
    t = t.select("date", "combo_key", *[F.coalesce(F.sum(c).over(back), F.lit(0.0)).alias(c) for c in sums]).where("n > 0")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") ** 2 / F.col("n"), F.col("syy") - F.col("sy") ** 2 / F.col("n")
    ic = F.when((F.col("n") < 2) | (vx <= 1e-12) | (vy <= 1e-12), 0.0).otherwise(F.try_divide(cov, F.sqrt(F.abs(vx)) * F.sqrt(F.abs(vy))))
    t = t.withColumn("abs_ic", F.abs(ic)).withColumn("overlap_rate", F.coalesce(F.try_divide("n", "days"), F.lit(0.0)))
    return t.withColumn("target_score", target_score(F.col("abs_ic"), F.col("overlap_rate"), target)).select("date", "combo_key", "n", F.col("days").alias("signal_days"), "abs_ic", "overlap_rate", "target_score")


def shrunk_scores(fits: DataFrame, dates: DataFrame, shrinkage: float, least_samples: int) -> tuple[DataFrame, DataFrame]:
    """(fits plus shrunk_score, one row an evaluation date with valid, reason, global_score, total and eligible counts).

    A fit is refused for too few samples in all, no combination, no combination with enough samples, or no positive score."""
    w = Window.partitionBy("date")
    f = fits.withColumn("global_score", F.try_divide(F.sum(F.col("target_score") * F.col("n")).over(w), F.sum("n").over(w)))
    f = f.withColumn("shrunk_score", F.greatest((F.col("n") * F.col("target_score") + shrinkage * F.col("global_score")) / (F.col("n") + shrinkage), F.lit(0.0)))
    per = f.groupBy("date").agg(F.sum("n").alias("total"), F.count_if(F.col("n") >= least_samples).alias("eligible"), F.max("target_score").alias("best"), F.max("global_score").alias("global_score"), F.max("shrunk_score").alias("top"))
    d = dates.select("date").distinct().join(per, "date", "left").fillna({"total": 0.0, "eligible": 0})
    reason = F.when(F.col("total") < least_samples, "insufficient_total_samples").when(F.col("eligible") == 0, "insufficient_combo_samples").when((F.col("global_score") <= 0) & (F.col("best") <= 0), "zero_target_score").when(F.col("top") <= 0, "zero_shrunk_score").otherwise("learned")
    d = d.withColumn("reason", reason).withColumn("valid", F.col("reason") == "learned")
    return f, d.select("date", "valid", "reason", "global_score", "total", "eligible")


def applied_weights(combos: DataFrame, fits: DataFrame, days: DataFrame, floor: float) -> DataFrame:
    """combos of valid days plus their weight: shrunk score of the combination (the day's global score if it was not seen),
    floor-normalised within (ticker, date)."""
    rows = combos.join(days.where("valid").select("date", "global_score"), "date")
    rows = rows.join(fits.select("date", "combo_key", "n", "target_score", "shrunk_score"), ["date", "combo_key"], "left")
    rows = rows.withColumn("raw", F.coalesce("shrunk_score", "global_score"))
    return floor_weights(rows, ["ticker", "date"], "raw", floor)


def learned_daily(weights: DataFrame) -> DataFrame:
    """(ticker, date, sentiment_learned, relevance_learned) from the weighted combinations of each day."""
    den = F.sum(F.col("weight") * F.greatest("base_weight_sum", F.lit(0.0)))
    out = weights.where("weight is not null").groupBy("ticker", "date").agg(den.alias("__d"), F.sum(F.col("weight") * F.col("sentiment_weighted_sum")).alias("s"), F.sum(F.col("weight") * F.col("relevance_weighted_sum")).alias("r")).where("__d > 0")
    return out.select("ticker", "date", (F.col("s") / F.col("__d")).alias("sentiment_learned"), F.greatest(F.least(F.col("r") / F.col("__d"), F.lit(1.0)), F.lit(0.0)).alias("relevance_learned"))


def with_learned(panel: DataFrame, learned: DataFrame, fallback: str = "source_session_weighted") -> DataFrame:
    """The news panel plus learned scores; days without a fit take the fallback weighting."""
    out = panel.join(learned, ["ticker", "date"], "left")
    return out.withColumn("sentiment_learned", F.coalesce("sentiment_learned", f"sentiment_{fallback}")).withColumn("relevance_learned", F.coalesce("relevance_learned", f"relevance_{fallback}"))


def weight_summary(weights: DataFrame, by: str) -> DataFrame:
    """Mean, least and largest applied weight and number of (ticker, date) groups by combination, source or session."""
    per = weights.where("weight is not null").groupBy("ticker", "date", F.col(by).alias("item")).agg(F.sum("weight").alias("w"))
    return per.groupBy("item").agg(F.avg("w").alias("mean_weight"), F.min("w").alias("min_weight"), F.max("w").alias("max_weight"), F.count(F.lit(1)).alias("group_count"))


def fit_summary(days: DataFrame) -> DataFrame:
    """One row: fitted and fallback days, fallback rate, mean global score, samples and eligible combinations of fitted days."""
    ok = F.col("valid")
    mean = lambda c: F.coalesce(F.avg(F.when(ok, F.col(c).cast("double"))), F.lit(0.0))
    return days.agg(F.count_if(ok).alias("fit_days"), F.count_if(~ok).alias("fallback_days"), F.avg((~ok).cast("double")).alias("fallback_rate"), mean("global_score").alias("global_score_mean"), mean("total").alias("samples_mean"), mean("eligible").alias("eligible_mean"))


def parameter_sweep(fits: DataFrame, dates: DataFrame, grid: DataFrame) -> DataFrame:
    """fits by look-back (lookback, date, ...) x grid (lookback, shrinkage, least_samples): every setting in one job. Ranked
    by fit rate, mean global score, mean top score, then smaller shrinkage and fewer samples."""
    f = fits.join(F.broadcast(grid), "lookback")  # a tiny grid
    keys = ["lookback", "shrinkage", "least_samples"]
    w = Window.partitionBy(*keys, "date")
    f = f.withColumn("g", F.try_divide(F.sum(F.col("target_score") * F.col("n")).over(w), F.sum("n").over(w)))
    f = f.withColumn("s", F.greatest((F.col("n") * F.col("target_score") + F.col("shrinkage") * F.col("g")) / (F.col("n") + F.col("shrinkage")), F.lit(0.0)))
    d = f.groupBy(*keys, "date").agg(F.sum("n").alias("total"), F.count_if(F.col("n") >= F.col("least_samples")).alias("eligible"), F.max("g").alias("g"), F.max("s").alias("top"))
    ok = (F.col("total") >= F.col("least_samples")) & (F.col("eligible") > 0) & (F.col("top") > 0)
    n_dates = dates.select("date").distinct().agg(F.count(F.lit(1)).alias("__dates"))  # one row
    out = d.groupBy(*keys).agg(F.count_if(ok).alias("fit_days"), F.coalesce(F.avg(F.when(ok, F.col("g"))), F.lit(0.0)).alias("global_score_mean"), F.coalesce(F.avg(F.when(ok, F.col("top"))), F.lit(0.0)).alias("top_score_mean"))
    out = out.crossJoin(F.broadcast(n_dates)).withColumn("fit_rate", F.col("fit_days") / F.col("__dates")).drop("__dates")
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("fit_rate"), F.desc(F.round("global_score_mean", 9)), F.desc(F.round("top_score_mean", 9)), "shrinkage", "least_samples", "lookback")  # settings, a few
    return out.withColumn("rank", F.row_number().over(order))


def refined_grid(results: DataFrame, best: int = 2, factors: tuple[float, ...] = (0.5, 1.0, 2.0), fewer: tuple[float, ...] = (0.5, 1.0)) -> DataFrame:
    """The settings about the first `best` ranks: their shrinkage times each factor, and fewer or as many samples."""
    x = results.where(F.col("rank") <= best).select("lookback", F.explode(F.array(*[F.col("shrinkage") * f for f in factors])).alias("shrinkage"), "least_samples")
    return x.select("lookback", "shrinkage", F.explode(F.array(*[F.ceil(F.col("least_samples") * f).cast("int") for f in fewer])).alias("least_samples")).distinct()


def staged_sweep(fits: DataFrame, dates: DataFrame, grid: DataFrame, best: int = 2) -> DataFrame:
    """parameter_sweep over the coarse grid (stage 1), then over refined_grid about its best (stage 2), with `stage`; a job a stage."""
    first = parameter_sweep(fits, dates, grid)
    second = parameter_sweep(fits, dates, refined_grid(first, best))
    return first.withColumn("stage", F.lit(1)).unionByName(second.withColumn("stage", F.lit(2)))


def stage_summary(results: DataFrame, metrics: tuple[str, ...] = ("fit_rate", "global_score_mean", "top_score_mean")) -> DataFrame:
    """By stage: settings tried, best, worst and median of each metric, and the settings of the first rank."""
    spread = [f.alias(f"{m}_{n}") for m in metrics for n, f in (("best", F.max(m)), ("worst", F.min(m)), ("median", F.median(m)))]
    return results.groupBy("stage").agg(F.count(F.lit(1)).alias("settings"), *spread, *[F.min_by(c, "rank").alias(c) for c in ("lookback", "shrinkage", "least_samples")])


def preset(results: DataFrame) -> DataFrame:
    """One row: the first rank of the last stage, as settings to run with."""
    last = results.groupBy().agg(F.max(F.struct(F.col("stage").alias("stage"), (-F.col("rank")).alias("r"), "lookback", "shrinkage", "least_samples", "fit_rate", "global_score_mean")).alias("b"))
    return last.select("b.stage", "b.lookback", "b.shrinkage", "b.least_samples", "b.fit_rate", "b.global_score_mean")
