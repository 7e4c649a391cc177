"""Event studies over business-day windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.calendar import bday_ord, is_business_day


def earnings_events(fundamentals: DataFrame) -> DataFrame:
    """(ticker, report_date, effective_date = the later of report and availability, lag_days), once each."""
    available = F.to_date("available_at")
    e = fundamentals.select("ticker", "report_date", F.greatest("report_date", available).alias("effective_date"))
    return e.withColumn("lag_days", F.date_diff("effective_date", "report_date")).dropDuplicates(["ticker", "effective_date", "report_date"])


def simple_returns(bars: DataFrame, tie: str | None = None) -> DataFrame:
    """(ticker, date, ret); of duplicate days the last by tie stays."""
    if tie:
        w = Window.partitionBy("ticker", "date").orderBy(F.desc(tie))
        bars = bars.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    w = Window.partitionBy("ticker").orderBy("date")
    return bars.select("ticker", "date", (F.try_divide("close", F.lag("close").over(w)) - 1).alias("ret"))


def t_statistic(x: Column) -> Column:
    """Mean over its standard error; 0 if n < 2 or there is no spread."""
    sd, n = F.stddev_samp(x), F.count(x)
    return F.when((n < 2) | (F.coalesce(sd, F.lit(0.0)) <= 1e-15), 0.0).otherwise(F.try_divide(F.avg(x), F.try_divide(sd, F.sqrt(n))))


def abnormal_returns(events: DataFrame, returns: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """Per event: sums of return less benchmark over `window` business days before and after, the day itself left out,
    and the t-statistic over those days. Events are spread over their few candidate days: equi-joins only."""
    span = window + 2 * (window // 5 + 1)
    days = F.sequence(F.date_sub("effective_date", span), F.date_add("effective_date", span))
    grid = events.withColumn("date", F.explode(days)).where(is_business_day(F.col("date")))
    grid = grid.withColumn("rel", bday_ord(F.col("date")) - bday_ord(F.col("effective_date")))
    grid = grid.where((F.col("rel") != 0) & (F.abs("rel") <= window) & (F.col("date") != F.col("effective_date")))
    grid = grid.join(returns, ["ticker", "date"]).join(benchmark, ["sector", "date"]).where("ret is not null and benchmark is not null")
    ab = F.col("ret") - F.col("benchmark")
    keys = [c for c in events.columns]
    return grid.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("rel") < 0, ab)), F.lit(0.0)).alias("pre"), F.coalesce(F.sum(F.when(F.col("rel") > 0, ab)), F.lit(0.0)).alias("post"), F.sum(ab).alias("total"), t_statistic(ab).alias("t_stat"), F.count(ab).alias("n"))


def event_rollup(events: DataFrame, critical: float = 1.96) -> DataFrame:
    """Overall and by sector: events, mean effects and the share with |t| at or above the critical value."""
    significant = F.avg((F.abs("t_stat") >= critical).cast("double"))
    agg = [F.count(F.lit(1)).alias("events"), F.avg("pre").alias("mean_pre"), F.avg("post").alias("mean_post"), F.avg("total").alias("mean_total"), significant.alias("significant_share")]
    return events.groupingSets([["sector"], []], "sector").agg(*agg).withColumn("sector", F.coalesce("sector", F.lit("__all__")))


def sector_returns(rows: DataFrame) -> DataFrame:
    """Benchmark rows under any of their column names (sector or industry; date or timestamp_utc; ret, return or benchmark) to
    (sector, date, benchmark); duplicate days are averaged, a null sector is `__all__`."""

    def first(*names: str) -> Column:
        have = [F.col(n) for n in names if n in rows.columns]
        return F.coalesce(*have) if have else F.lit(None)

    x = rows.select(F.coalesce(first("sector", "industry").cast("string"), F.lit("__all__")).alias("sector"), first("date", "timestamp_utc").cast("date").alias("date"), first("benchmark", "ret", "return").cast("double").alias("benchmark"))
    return x.where("date is not null and benchmark is not null").groupBy("sector", "date").agg(F.avg("benchmark").alias("benchmark"))


def with_sector_fallback(events: DataFrame, benchmark: DataFrame) -> DataFrame:
    """events (ticker, sector, ...) whose sector has no benchmark take `__all__`."""
    known = benchmark.select(F.col("sector").alias("__s")).distinct()
    return events.join(known, F.col("sector") == F.col("__s"), "left").withColumn("sector", F.coalesce("__s", F.lit("__all__"))).drop("__s")
