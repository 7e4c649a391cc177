"""Point-in-time joins and membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str | None, left_ts: str, right_ts: str, prefix: str = "") -> DataFrame:
    """Each left row with the newest right row at or before its time, taken whole (nulls included).

    Both sides are put in one sorted stream per key: one shuffle, no range join. Without a key use
    asof_keyless."""
    keep = [c for c in right.columns if c not in (key, right_ts)]
    r = right.select(key, F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), F.struct(F.col(right_ts), *keep).alias("__r"))
    names = [c for c in left.columns if c != key]
    le = left.select(key, F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), F.struct(*names).alias("__l"))
    w = Window.partitionBy(key).orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = le.unionByName(r, allowMissingColumns=True).withColumn("__m", F.last("__r", ignorenulls=True).over(w))
    both = both.where("__side = 1")
    return both.select(key, *[F.col(f"__l.{c}").alias(c) for c in names], *[F.col(f"__m.{c}").alias(prefix + c) for c in [right_ts, *keep]])


def asof_keyless(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, prefix: str = "") -> DataFrame:
    """Each left row with the newest right row at or before its time, whole, without a key.

    Time is cut into months: inside a month both sides are one sorted stream, and what a month begins with comes from a table
    of one row a month, so neither side has to be small and no task gets all rows."""
    keep = [c for c in right.columns if c != right_ts]
    month = lambda c: F.trunc(F.col(c).cast("date"), "month")
    r = right.where(F.col(right_ts).isNotNull()).select(month(right_ts).alias("__m"), F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), F.struct(F.col(right_ts), *keep).alias("__r"))
    le = left.select(month(left_ts).alias("__m"), F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"))
    w = Window.partitionBy("__m").orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    inside = le.unionByName(r, allowMissingColumns=True).withColumn("__x", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    ends = r.groupBy("__m").agg(F.max_by("__r", "__ts").alias("__e")).unionByName(le.select("__m").distinct(), allowMissingColumns=True).groupBy("__m").agg(F.first("__e", ignorenulls=True).alias("__e"))
    before = Window.orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)  # a row a month
    ends = ends.withColumn("__c", F.last("__e", ignorenulls=True).over(before)).select("__m", "__c")
    out = inside.join(ends, "__m", "left").withColumn("__x", F.coalesce("__x", "__c"))
    return out.select(*[F.col(f"__l.{c}").alias(c) for c in left.columns], *[F.col(f"__x.{c}").alias(prefix + c) for c in [right_ts, *keep]])


def point_in_time(df: DataFrame, as_of, available: str = "available_at") -> DataFrame:
    return df.where(F.col(available) <= as_of)


def flag_stale(df: DataFrame, as_of, hours: float, fetched: str = "fetched_at") -> DataFrame:
    """data_age_hours (at least 0) and stale_data_flag (age above hours); a missing time gives 0 and false."""
    age = F.greatest((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col(fetched))) / 3.6e9, F.lit(0.0))
    df = df.withColumn("data_age_hours", F.coalesce(age, F.lit(0.0)))
    return df.withColumn("stale_data_flag", F.col("data_age_hours") > hours)


def membership_intervals(base: DataFrame, changes: DataFrame) -> DataFrame:
    """base (ticker, base_date) and changes (date, added array, removed array) -> (ticker, from, to): half-open intervals.
    On one day removals apply before additions."""
    events = base.select("ticker", F.col("base_date").alias("date"), F.lit(2).alias("step"), F.lit(True).alias("on"))
    adds = changes.select(F.explode("added").alias("ticker"), "date", F.lit(1).alias("step"), F.lit(True).alias("on"))
    drops = changes.select(F.explode("removed").alias("ticker"), "date", F.lit(0).alias("step"), F.lit(False).alias("on"))
    w = Window.partitionBy("ticker").orderBy("date", "step")
    events = events.unionByName(adds).unionByName(drops).withColumn("to", F.lead("date").over(w))
    return events.where("on").select("ticker", F.col("date").alias("from"), "to")


def constituents(panel: DataFrame, intervals: DataFrame, date: str = "date") -> DataFrame:
    """Panel rows whose ticker is a member on their date."""
    i = intervals.select(F.col("ticker").alias("__t"), "from", "to")
    on = (F.col("ticker") == F.col("__t")) & (F.col(date) >= F.col("from")) & (F.col("to").isNull() | (F.col(date) < F.col("to")))
    return panel.join(i, on, "left_semi")


def dense_fill(daily: DataFrame, tickers: DataFrame, calendar: DataFrame, fill: dict) -> DataFrame:
    """(ticker x date) left join daily; missing cells take the neutral values."""
    grid = tickers.crossJoin(F.broadcast(calendar))
    out = grid.join(daily, ["ticker", "date"], "left")
    return out.fillna(fill)


def tickers_ever(base: DataFrame, changes: DataFrame) -> DataFrame:
    """All tickers that were ever a member or named in a change."""
    every = base.select("ticker").unionByName(changes.select(F.explode("added").alias("ticker"))).unionByName(changes.select(F.explode("removed").alias("ticker")))
    return every.distinct()


def default_universe(base: DataFrame, optional: list[DataFrame]) -> DataFrame:
    """The base list and all optional lists, each ticker once, trimmed and upper-cased."""
    out = base.select("ticker")
    for o in optional:
        out = out.unionByName(o.select("ticker"))
    return out.select(F.upper(F.trim("ticker")).alias("ticker")).where("ticker <> ''").distinct()


def fold_constituents(folds: DataFrame, panel: DataFrame, intervals: DataFrame) -> DataFrame:
    """folds (fold_id, date, role) x panel rows, of tickers that are members on the last date of the fold."""
    ends = folds.groupBy("fold_id").agg(F.max("date").alias("fold_end"))
    on = (F.col("fold_end") >= F.col("from")) & (F.col("to").isNull() | (F.col("fold_end") < F.col("to")))
    members = ends.join(intervals, on).select("fold_id", "ticker").distinct()  # folds x tickers
    return panel.join(F.broadcast(folds), "date").join(members, ["fold_id", "ticker"], "left_semi")


def price_at(filings: DataFrame, bars: DataFrame, filed: str = "available_at") -> DataFrame:
    """filings plus close: that of the newest bar on or before the filing date."""
    b = bars.select("ticker", F.col("date").alias("bar_date"), "close")
    return asof_join(filings, b, "ticker", filed, "bar_date")


def one_row_a_report(facts: DataFrame, metrics: list[str]) -> DataFrame:
    """facts (ticker, report_date, metric, filed, val) -> one row a report with a column a metric and available_at, the
    latest filing of those used."""
    values = [F.max(F.when(F.col("metric") == m, F.col("val"))).alias(m) for m in metrics]
    return facts.where(F.col("metric").isin(*metrics)).groupBy("ticker", "report_date").agg(*values, F.max("filed").alias("available_at"))


def fuse_stale(df: DataFrame, flags: list[str], out: str = "stale_data_flag") -> DataFrame:
    """True where any of the flags is; nulls count as false."""
    either = F.lit(False)
    for f in flags:
        either = either | F.coalesce(F.col(f), F.lit(False))
    return df.withColumn(out, either)
