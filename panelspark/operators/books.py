"""Daily cross-sectional long/short books per candidate, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def candidate_grid(spark, strategies: list[str], fractions: list[float], holdings: list[int]) -> DataFrame:
    """(candidate, strategy, fraction, holding): a product of tiny lists, in one partition."""
    one = lambda name, values, kind: F.explode(F.array(*[F.lit(x).cast(kind) for x in values])).alias(name)
    grid = spark.range(0, 1, 1, 1).select(one("strategy", strategies, "string")).select("strategy", one("fraction", fractions, "double")).select("strategy", "fraction", one("holding", holdings, "int"))
    return grid.withColumn("candidate", F.format_string("%s|%s|%d", "strategy", "fraction", "holding"))


def side_edges(scores: DataFrame, threshold: float, minimum_edge: float) -> DataFrame:
    """(strategy, side, ticker, date, edge, signal): who may be held on which side, by strategy."""
    up, down, flat, sig = (F.col(c) for c in ("prob_up", "prob_down", "prob_flat", "signal"))
    direction = F.when((down >= flat) & (down >= up), "DOWN").when(flat >= up, "FLAT").otherwise("UP")
    long_edge = F.when((direction == "UP") & (up >= threshold), up - F.greatest(down, flat))
    short_edge = F.when((direction == "DOWN") & (down >= threshold), down - F.greatest(up, flat))
    rank_long, rank_short = F.when(sig >= minimum_edge, sig), F.greatest(down - up, -sig)
    rank_short = F.when(rank_short >= minimum_edge, rank_short)
    kinds = [("classified_two_sided", "long", long_edge), ("classified_two_sided", "short", short_edge), ("classified_directional", "long", long_edge), ("classified_directional", "short", short_edge), ("rank_long_short", "long", rank_long), ("rank_long_short", "short", rank_short), ("rank_long_only", "long", rank_long)]
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(d).alias("side"), e.alias("edge")) for s, d, e in kinds]))
    sized = scores.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("date")))
    out = sized.select("ticker", "date", "signal", "n", rows.alias("x"))
    return out.select("ticker", "date", "signal", "n", "x.*").where("edge is not null")


def bucket_size(n: Column, fraction: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(n * fraction).cast("int"))


def selections(edges: DataFrame, grid: DataFrame) -> DataFrame:
    """(candidate, holding, date, side, ticker, w): top buckets by edge, equal weights a side (long +, short -); two-sided
    strategies are empty on days without both sides."""
    rows = edges.join(F.broadcast(grid), "strategy")  # a tiny grid
    side = Window.partitionBy("candidate", "date", "side")
    better = F.when(F.col("side") == "long", -F.col("signal")).otherwise(F.col("signal"))
    rows = rows.withColumn("rn", F.row_number().over(side.orderBy(F.desc("edge"), better, "ticker"))).where(F.col("rn") <= bucket_size(F.col("n"), F.col("fraction")))
    day = Window.partitionBy("candidate", "date")
    rows = rows.withColumn("sides", F.size(F.collect_set("side").over(day)))
    rows = rows.where(~F.col("strategy").isin("classified_two_sided", "rank_long_short") | (F.col("sides") == 2))
    share = F.when(F.col("side") == "long", 1.0).otherwise(-1.0) / F.count(F.lit(1)).over(side)
    return rows.withColumn("w", share)


def target_books(edges: DataFrame, grid: DataFrame) -> DataFrame:
    """(candidate, holding, date, ticker, weight): the selections of each day netted by ticker."""
    return selections(edges, grid).groupBy("candidate", "holding", "date", "ticker").agg(F.sum("w").alias("weight"))


def side_ratios(chosen: DataFrame, grid: DataFrame, dates: DataFrame) -> DataFrame:
    """(candidate, signal_ratio, two_sided_ratio, one_sided_ratio) of all dates: days with a selection, with both sides, with one.
    Candidates that never select anything have zeros."""
    days = chosen.groupBy("candidate", "date").agg(F.count_distinct("side").alias("sides"))
    n = dates.agg(F.count(F.lit(1)).alias("n"))  # one row
    per = days.groupBy("candidate").agg(F.count(F.lit(1)).alias("signal"), F.count_if(F.col("sides") == 2).alias("two"), F.count_if(F.col("sides") == 1).alias("one"))
    out = grid.select("candidate").join(per, "candidate", "left").crossJoin(F.broadcast(n))
    return out.select("candidate", *[F.coalesce(F.try_divide(c, "n"), F.lit(0.0)).alias(name) for c, name in (("signal", "signal_ratio"), ("two", "two_sided_ratio"), ("one", "one_sided_ratio"))])


def held_books(targets: DataFrame, dates: DataFrame) -> DataFrame:
    """(candidate, idx, ticker, weight): mean of the last `holding` target books; dates has (date, idx)."""
    rows = targets.join(F.broadcast(dates), "date")
    rows = rows.withColumn("idx", F.explode(F.sequence(F.col("idx"), F.col("idx") + F.col("holding") - 1)))
    return rows.groupBy("candidate", "idx", "ticker").agg(F.sum(F.col("weight") / F.col("holding")).alias("weight"))


def daily_results(held: DataFrame, returns: DataFrame, dates: DataFrame, cost_bps: float) -> DataFrame:
    """(candidate, idx, gross, turnover, net, names, exposure). Turnover is half of the absolute weight changes: each
    weight counts at its day and, with the other sign, at the next."""
    moves = held.select("candidate", "ticker", F.explode(F.array(F.struct(F.col("idx").alias("i"), F.col("weight").alias("d")), F.struct((F.col("idx") + 1).alias("i"), (-F.col("weight")).alias("d")))).alias("x"))
    turnover = moves.groupBy("candidate", "x.i", "ticker").agg(F.sum("x.d").alias("d")).groupBy("candidate", F.col("i").alias("idx")).agg((F.sum(F.abs("d")) / 2).alias("turnover"))
    r = returns.join(F.broadcast(dates), "date").select("idx", "ticker", "ret")
    gross = held.join(r, ["idx", "ticker"], "left").groupBy("candidate", "idx").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("gross"), F.count(F.lit(1)).alias("names"), F.sum(F.abs("weight")).alias("exposure"))
    last = dates.agg(F.max("idx").alias("last"))
    out = turnover.join(gross, ["candidate", "idx"], "left").crossJoin(F.broadcast(last)).where("idx <= last").drop("last")
    out = out.fillna({"gross": 0.0, "names": 0, "exposure": 0.0})
    return out.withColumn("net", F.col("gross") - F.col("turnover") * cost_bps / 1e4)


def performance(daily: DataFrame, cost_bps: float) -> DataFrame:
    """Annual return, volatility, information ratio, Sortino, drawdown, Calmar, drag and mean turnover per candidate."""
    w = Window.partitionBy("candidate").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    df = daily.withColumn("curve", F.exp(F.sum(F.log1p(F.greatest("net", F.lit(-0.999999)))).over(w)))
    df = df.withColumn("drawdown", F.col("curve") / F.max("curve").over(w) - 1)
    down = F.stddev_samp(F.least("net", F.lit(0.0))) * 252**0.5
    out = df.groupBy("candidate").agg(F.count(F.lit(1)).alias("days"), (F.avg("net") * 252).alias("annual_return"), (F.avg("gross") * 252).alias("gross_annual_return"), F.coalesce(F.stddev_samp("net") * 252**0.5, F.lit(0.0)).alias("annual_volatility"), F.min("drawdown").alias("max_drawdown"), F.coalesce(down, F.lit(0.0)).alias("downside"), F.avg("turnover").alias("mean_turnover"), (F.sum("turnover") * cost_bps).alias("total_cost_bps"), F.avg("exposure").alias("mean_exposure"), F.avg((F.col("names") > 0).cast("double")).alias("active_ratio"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.when(b != 0, b)), F.lit(0.0))
    out = out.withColumn("information_ratio", ratio("annual_return", F.col("annual_volatility"))).withColumn("sortino", ratio("annual_return", F.col("downside")))
    return out.withColumn("calmar", ratio("annual_return", F.abs("max_drawdown"))).withColumn("cost_drag", F.col("gross_annual_return") - F.col("annual_return")).drop("downside")


def selection_stability(targets: DataFrame, dates: DataFrame) -> DataFrame:
    """Mean Jaccard overlap of the names of consecutive non-empty books."""
    books = targets.groupBy("candidate", "date").agg(F.collect_set("ticker").alias("names"))
    w = Window.partitionBy("candidate").orderBy("date")
    books = books.withColumn("before", F.lag("names").over(w)).where("before is not null")
    jaccard = F.size(F.array_intersect("names", "before")) / F.size(F.array_union("names", "before"))
    return books.groupBy("candidate").agg(F.avg(jaccard).alias("stability"))


def rank_band(edges: DataFrame, k: int, band: float) -> DataFrame:
    """Hysteresis as a table: a ticker enters at rank k or better and leaves at rank k + ceil(k * band) or worse."""
    leave = k + -int(-k * band // 1)
    w = Window.partitionBy("strategy", "side", "date").orderBy(F.desc("edge"), "ticker")
    df = edges.withColumn("rank", F.row_number().over(w))
    mark = F.when(F.col("rank") <= k, 1).when(F.col("rank") >= leave, 0)
    seen = Window.partitionBy("strategy", "side", "ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("held", F.coalesce(F.last(mark, ignorenulls=True).over(seen), F.lit(0)) == 1)


def liquidity_multiplier(volume_ratio: Column, floor: float, cap: float) -> Column:
    """Cost multiplier of a group: inverse of the median volume ratio, clipped."""
    return F.greatest(F.lit(floor), F.least(F.lit(cap), F.try_divide(F.lit(1.0), F.percentile(volume_ratio, 0.5))))


def cool_down(targets: DataFrame, dates: DataFrame, days: int) -> DataFrame:
    """targets (candidate, date, ticker, weight) plus idx and reentry: the ticker was out on the day before and its last
    holding ended at most `days` trading days ago."""
    t = targets.join(F.broadcast(dates), "date")  # a row a date
    before = F.lag("idx").over(Window.partitionBy("candidate", "ticker").orderBy("idx"))
    gap = F.col("idx") - before
    return t.withColumn("reentry", F.coalesce((gap > 1) & (gap <= days + 1), F.lit(False)))


def turnover_budget(daily: DataFrame, most: float) -> DataFrame:
    """daily (candidate, idx, turnover, ...) plus breach and the scale that one step would need to stay within the budget."""
    over = F.col("turnover") > most
    return daily.withColumn("breach", over).withColumn("scale", F.when(over, most / F.col("turnover")).otherwise(1.0))


def rule_comparison(performance: DataFrame, selected: str, uncontrolled: str, legacy: str, pbo: DataFrame | None = None) -> DataFrame:
    """One row: the selected rule against the uncontrolled and the legacy one, and the reasons that hold. Side ratios, where
    performance has them, and a row with the family's pbo add a reason each."""
    pick = lambda who, c: F.max(F.when(F.col("candidate") == who, F.col(c))).alias(f"{c}__{name[who]}")
    name = {selected: "s", uncontrolled: "u", legacy: "l"}
    sides = [c for c in ("one_sided_ratio", "two_sided_ratio") if c in performance.columns]
    cols = ["information_ratio", "mean_turnover", "cost_drag", "gross_annual_return", "active_ratio", "stability", *sides]
    one = performance.agg(*[pick(w, c) for w in name for c in cols])
    x = lambda c, who="s": F.col(f"{c}__{who}")
    delta = lambda c: (x(c) - x(c, "u")).alias(f"{c}_delta")
    reasons = {
        "legacy_rule_mostly_flat": (x("active_ratio", "l") <= 0.05) & (x("active_ratio") > x("active_ratio", "l")),
        "gross_return_not_positive": x("gross_annual_return") <= 0,
        "costs_erode_return": x("cost_drag") > F.greatest(F.abs(x("gross_annual_return")) * 0.25, F.lit(0.01)),
        "names_unstable": x("stability") < 0.25,
        "controls_raise_information_ratio": x("information_ratio") > x("information_ratio", "u"),
        "controls_cut_cost_drag": x("cost_drag") < x("cost_drag", "u"),
        "controls_raise_stability": x("stability") > x("stability", "u"),
    }
    if sides:
        reasons["one_sided_days_dominate"] = x("one_sided_ratio") > x("two_sided_ratio")
    if pbo is not None:
        one = one.crossJoin(F.broadcast(pbo.select(F.col("pbo").alias("__pbo"))))  # one row
        reasons["severe_pbo"] = F.col("__pbo") >= 0.8
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in reasons.items()]))
    return one.select(delta("information_ratio"), delta("mean_turnover"), delta("cost_drag"), delta("stability"), F.when(F.size(found) > 0, F.array_join(found, "|")).otherwise("no_dominant_failure").alias("reasons"))
