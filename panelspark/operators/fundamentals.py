"""Filings to point-in-time ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.asof import price_at

def filing_type(df: DataFrame) -> DataFrame:
    """By cadence: the gap to the previous filing, else to the next, else 91 days; 250 days or more is annual."""
    w = Window.partitionBy("ticker").orderBy("report_date")
    gap = F.coalesce(F.date_diff("report_date", F.lag("report_date").over(w)), F.date_diff(F.lead("report_date").over(w), "report_date"), F.lit(91))
    return df.withColumn("filing_type", F.when(gap >= 250, "annual").otherwise("quarterly"))


def recent_filings(df: DataFrame, n: int, kind: str) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy(F.desc("report_date"))
    return filing_type(df).where(F.col("filing_type") == kind).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def ratios(df: DataFrame) -> DataFrame:
    """(revenue, profit, debt, equity) -> growth, profitability, leverage, forward-filled; incomplete rows go."""
    w = Window.partitionBy("ticker").orderBy("report_date")
    safe = lambda a, b: F.try_divide(a, F.when(b != 0, b))
    df = df.withColumn("revenue_growth", safe(F.col("revenue"), F.lag("revenue").over(w)) - 1)
    df = df.withColumn("profitability", safe(F.col("profit"), F.col("revenue"))).withColumn("debt_to_equity", safe(F.col("debt"), F.col("equity")))
    gap = F.date_diff("report_date", F.lag("report_date").over(w))
    df = df.withColumn("annualised_profit", F.col("profit") * F.when(gap <= 130, 4).otherwise(1))
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    for c in ("revenue_growth", "profitability", "debt_to_equity"):
        df = df.withColumn(c, F.last(c, ignorenulls=True).over(back))
    return df.dropna(subset=["revenue_growth", "profitability", "debt_to_equity"])


def earnings_yield(filings: DataFrame, bars: DataFrame) -> DataFrame:
    """filings (ticker, report_date, available_at, eps, revenue, profit, debt, equity) plus annualised_eps (four times the figure
    where the report before is at most 130 days away or there is none), close on or before available_at, and earnings_yield;
    growth is 0 without a report before, the other ratios are filled forward, and rows that still lack one go."""
    w = Window.partitionBy("ticker").orderBy("report_date")
    safe = lambda a, b: F.try_divide(a, F.when(b != 0, b))
    gap = F.coalesce(F.date_diff("report_date", F.lag("report_date").over(w)), F.lit(91))
    df = filings.withColumn("annualised_eps", F.col("eps") * F.when(gap <= 130, 4.0).otherwise(1.0))
    df = df.withColumn("revenue_growth", F.coalesce(safe(F.col("revenue"), F.lag("revenue").over(w)) - 1, F.lit(0.0)))
    df = df.withColumn("profitability", safe(F.col("profit"), F.col("revenue"))).withColumn("debt_to_equity", safe(F.col("debt"), F.col("equity")))
    df = price_at(df, bars).withColumn("earnings_yield", safe(F.col("annualised_eps"), F.col("close")))
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    filled = ("earnings_yield", "debt_to_equity", "profitability")
    df = df.withColumns({c: F.last(c, ignorenulls=True).over(back) for c in filled})
    return df.dropna(subset=["revenue_growth", *filled])


def pick_metric(facts: DataFrame, priorities: dict[str, int]) -> DataFrame:
    """facts (ticker, concept, start, end, filed, val): quarterly durations (70-110 days) where the ticker has any, else
    annual (300-380); one row a report date by concept priority, then the latest filing."""
    days = F.date_diff("end", "start")
    tier = F.when(days.between(70, 110), 1).when(days.between(300, 380), 2)
    prio = F.coalesce(*[F.when(F.col("concept") == c, p) for c, p in priorities.items()])
    df = facts.withColumn("tier", tier).withColumn("prio", prio).where("tier is not null and prio is not null")
    df = df.withColumn("best", F.min("tier").over(Window.partitionBy("ticker"))).where("tier = best")
    w = Window.partitionBy("ticker", "end").orderBy("prio", F.desc("filed"), "val")
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("ticker", F.col("end").alias("report_date"), "filed", "concept", "val")


def available_at(*filed: str) -> Column:
    return F.greatest(*filed)
