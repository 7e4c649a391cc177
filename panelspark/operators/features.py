"""Price, volume and label windows per key. One window order serves all, so one shuffle and sort does."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.stats import ewm, ewms, full_window

ANNUAL = math.sqrt(252)


def _w(key: str, date: str):
    return Window.partitionBy(key).orderBy(date)


def price_features(bars: DataFrame, key: str = "ticker", date: str = "date") -> DataFrame:
    """bars (open, high, low, close, volume) plus returns, volatilities, oscillators, bands, ranges and volume features."""
    w = _w(key, date)
    rows = lambda n: w.rowsBetween(1 - n, 0)
    c, h, lo, v = (F.col(x) for x in ("close", "high", "low", "volume"))
    df = bars
    for n in (1, 5, 10, 20):
        df = df.withColumn(f"log_return_{n}d", F.log(F.try_divide(c, F.lag(c, n).over(w))))
    for n in (5, 10, 20):
        df = df.withColumn(f"roc_{n}d", F.try_divide(c, F.lag(c, n).over(w)) - 1)
    r1 = F.col("log_return_1d")
    for n in (5, 10, 20):
        df = df.withColumn(f"realized_vol_{n}d", full_window(F.stddev_samp(r1), r1, rows(n), n) * ANNUAL)
    gk = 0.5 * F.pow(F.log(h / lo), 2) - (2 * math.log(2) - 1) * F.pow(F.log(c / F.col("open")), 2)
    df = df.withColumn("gk_vol", F.sqrt(F.greatest(gk, F.lit(0.0))) * ANNUAL)
    df = df.withColumn("__d", c - F.lag(c, 1).over(w))
    gain, loss = F.greatest(F.col("__d"), F.lit(0.0)), F.greatest(-F.col("__d"), F.lit(0.0))
    gain, loss = F.when(F.col("__d").isNotNull(), gain), F.when(F.col("__d").isNotNull(), loss)
    up, down = full_window(F.avg(gain), gain, rows(14), 14), full_window(F.avg(loss), loss, rows(14), 14)
    df = df.withColumn("rsi_14", F.coalesce(100 - 100 / (1 + F.try_divide(up, F.when(down > 0, down))), F.lit(50.0)))
    for n in (5, 20):
        df = df.withColumn(f"volume_ratio_{n}d", F.try_divide(v, full_window(F.avg(v), v, rows(n), n)))
    df = df.withColumn("obv", F.sum(F.coalesce(F.signum("__d"), F.lit(0.0)) * v).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("obv_slope_10d", F.col("obv") - F.lag("obv", 10).over(w))
    for n in (5, 20, 50, 200):
        df = df.withColumn(f"price_vs_sma_{n}d", F.try_divide(c, full_window(F.avg(c), c, rows(n), n)) - 1)
    mean, sd = full_window(F.avg(c), c, rows(20), 20), full_window(F.stddev_samp(c), c, rows(20), 20)
    df = df.withColumn("bb_position", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(c - (mean - 2 * sd), 4 * sd))))
    df = df.withColumn("bb_width", F.try_divide(4 * sd, mean))
    prev = F.lag(c, 1).over(w)
    df = df.withColumn("true_range", F.greatest(h - lo, F.abs(h - prev), F.abs(lo - prev)))
    tr = F.col("true_range")
    df = df.withColumn("atr_14", full_window(F.avg(tr), tr, rows(14), 14)).withColumn("atr_ratio", F.try_divide("atr_14", c))
    return df.drop("__d")


def macd(bars: DataFrame, key: str = "ticker", date: str = "date", spans: tuple[int, int, int] = (12, 26, 9)) -> DataFrame:
    """bars plus macd and macd_signal."""
    decay = [1 - 2 / (s + 1) for s in spans]
    df = ewms(bars, key, [date], [("close", "__fast", decay[0]), ("close", "__slow", decay[1])]).withColumn("macd", F.col("__fast") - F.col("__slow"))
    return ewm(df, key, [date], "macd", "macd_signal", decay[2]).drop("__fast", "__slow")


def direction_label(r: Column, threshold: float) -> Column:
    """0 down (r <= -t), 1 flat, 2 up (r > t)."""
    return F.when(r <= -threshold, 0).when(r <= threshold, 1).when(r.isNotNull(), 2)


def label_windows(bars: DataFrame, horizon: int = 1, threshold: float = 0.2, key: str = "ticker", date: str = "date") -> DataFrame:
    """bars plus future returns, the three-class label and the next 20 days' volatility."""
    w = _w(key, date)
    c = F.col("close")
    df = bars.withColumn("future_simple_return", F.try_divide(F.lead(c, horizon).over(w), c) - 1)
    df = df.withColumn("target_return", F.log1p("future_simple_return")).withColumn("direction_label", direction_label(F.col("future_simple_return"), threshold))
    df = df.withColumn("__r", F.log(F.try_divide(c, F.lag(c, 1).over(w))))
    ahead = w.rowsBetween(1, 20)
    return df.withColumn("future_volatility_20d", full_window(F.stddev_samp("__r"), F.col("__r"), ahead, 20) * ANNUAL).drop("__r")


def market_context(bars: DataFrame, key: str = "ticker", date: str = "date") -> DataFrame:
    """Dollar volume, its 20-day mean (at least one value) and the 20-day stddev of simple returns (at least two)."""
    w = _w(key, date)
    df = bars.withColumn("dollar_volume", F.col("close") * F.col("volume")).withColumn("__r", F.try_divide("close", F.lag("close", 1).over(w)) - 1)
    frame = w.rowsBetween(-19, 0)
    return df.withColumn("adv_20d", F.avg("dollar_volume").over(frame)).withColumn("return_std_20d", F.when(F.count("__r").over(frame) >= 2, F.stddev_samp("__r").over(frame))).drop("__r")


def sector_features(panel: DataFrame, sector_map: DataFrame, value: str = "roc_20d", vol: str = "realized_vol_20d") -> DataFrame:
    """panel plus sector, momentum relative to the sector, the sector's strength and the volatility spread to it."""
    df = panel.join(sector_map.select("ticker", "sector"), "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("unknown")))
    by_sector, by_day = Window.partitionBy("date", "sector"), Window.partitionBy("date")
    mean = F.avg(value).over(by_sector)
    df = df.withColumn("sector_relative_momentum", F.coalesce(F.col(value) - mean, F.lit(0.0)))
    df = df.withColumn("sector_strength", F.coalesce(mean - F.avg(value).over(by_day), F.lit(0.0)))
    return df.withColumn("sector_vol_spread", F.coalesce(F.col(vol) - F.avg(vol).over(by_sector), F.lit(0.0)))


def calendar_features(df: DataFrame, date: str = "date") -> DataFrame:
    d = F.col(date)
    return df.withColumn("day_of_week", F.weekday(d)).withColumn("month", F.month(d)).withColumn("is_month_end", F.last_day(d) == d)


def training_frame(df: DataFrame, required: list[str]) -> DataFrame:
    return df.dropna(subset=required)


def latest_rows(df: DataFrame, key: str, date: str) -> DataFrame:
    """The newest row of each key, whole."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), date).alias("x")).select(key, "x.*")


def sequences(df: DataFrame, columns: list[str], length: int, key: str = "ticker", date: str = "date") -> DataFrame:
    """Fixed-length windows of feature structs; shorter ones are left out."""
    w = _w(key, date).rowsBetween(1 - length, 0)
    df = df.select(key, date, F.collect_list(F.struct(*columns)).over(w).alias("sequence"))
    return df.where(F.size("sequence") == length)


def feature_catalog(df: DataFrame, families: dict[str, str], stale: str | None = None) -> DataFrame:
    """One row a feature: family, missing rate, stale rate. One pass."""
    rate = F.avg(F.col(stale).cast("double")) if stale else F.lit(0.0)
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in families], rate.alias("__stale"))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(f).alias("family"), F.col(c).alias("missing_rate"), F.col("__stale").alias("stale_rate")) for c, f in families.items()]))
    return one.select(rows.alias("x")).select("x.*")


def impute_and_standardise(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Median fill, then (x - mean) / population stddev (1 where 0), all fitted on train."""
    fit = train.agg(*[F.percentile(c, 0.5).alias(f"m_{c}") for c in columns])
    filled = train.crossJoin(F.broadcast(fit)).agg(*[f for c in columns for f in (F.avg(F.coalesce(c, f"m_{c}")).alias(f"a_{c}"), F.stddev_pop(F.coalesce(c, f"m_{c}")).alias(f"s_{c}"))])
    out = df.crossJoin(F.broadcast(fit)).crossJoin(F.broadcast(filled))  # one row each
    for c in columns:
        out = out.withColumn(c, (F.coalesce(c, f"m_{c}") - F.col(f"a_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")))
    return out.drop(*fit.columns, *filled.columns)
