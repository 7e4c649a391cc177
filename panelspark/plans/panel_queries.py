"""Queries over prices: bars, features, labels, as-of joins, universe. Each pairs an operator with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import calendar as cal
from panelspark.operators import asof, features
from panelspark.plans.fixtures import kept, table, view, with_views

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str = "", *views: str):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, counts as long, for comparison across engines."""
    cast = {"double": lambda c: F.round(c, digits) + F.lit(0.0), "int": lambda c: F.col(c).cast("bigint"), "smallint": lambda c: F.col(c).cast("bigint")}
    return df.select(*[cast.get(t, F.col)(c).alias(c) for c, t in df.dtypes])


def bars(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "daily_bars")


def price_panel(spark, sf_dir) -> DataFrame:
    """The price features of all bars; several queries use them."""
    return kept(spark, sf_dir, "price features", lambda: features.price_features(bars(spark, sf_dir)))


def _r(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in cols)


FEATURES = ["log_return_1d", "log_return_5d", "log_return_10d", "log_return_20d", "roc_5d", "roc_10d", "roc_20d", "realized_vol_5d", "realized_vol_10d", "realized_vol_20d", "gk_vol", "rsi_14", "volume_ratio_5d", "volume_ratio_20d", "obv", "obv_slope_10d", "price_vs_sma_5d", "price_vs_sma_20d", "price_vs_sma_50d", "price_vs_sma_200d", "bb_position", "bb_width", "atr_14", "atr_ratio"]


def _full(agg: str, x: str, n: int) -> str:
    frame = f"over (partition by ticker order by date rows between {n - 1} preceding and current row)"
    return f"case when count({x}) {frame} = {n} then {agg}({x}) {frame} end"


FEATURE_SQL = f"""with s1 as (select *, close - lag(close) over w as d, ln(close / lag(close) over w) as r1, lag(close) over w as prev from daily_bars window w as (partition by ticker order by date)),
s2 as (select *, greatest(high - low, abs(high - prev), abs(low - prev)) as tr, case when d is not null then greatest(d, 0) end as gain, case when d is not null then greatest(-d, 0) end as loss,
  sum(coalesce(sign(d), 0) * volume) over (partition by ticker order by date rows between unbounded preceding and current row) as obv from s1),
s3 as (select ticker, date, close, volume, open, high, low, r1 as log_return_1d, tr,
  {", ".join(f"ln(close / lag(close, {n}) over w) as log_return_{n}d" for n in (5, 10, 20))}, {", ".join(f"close / lag(close, {n}) over w - 1 as roc_{n}d" for n in (5, 10, 20))},
  {", ".join(f"sqrt(252) * ({_full('stddev_samp', 'r1', n)}) as realized_vol_{n}d" for n in (5, 10, 20))},
  sqrt(greatest(0.5 * pow(ln(high / low), 2) - (2 * ln(2.0::double) - 1) * pow(ln(close / open), 2), 0)) * sqrt(252) as gk_vol,
  ({_full("avg", "gain", 14)}) as up, ({_full("avg", "loss", 14)}) as down, obv, obv - lag(obv, 10) over w as obv_slope_10d,
  {", ".join(f"volume / ({_full('avg', 'volume', n)}) as volume_ratio_{n}d" for n in (5, 20))}, {", ".join(f"close / ({_full('avg', 'close', n)}) - 1 as price_vs_sma_{n}d" for n in (5, 20, 50, 200))},
  ({_full("avg", "close", 20)}) as m20, ({_full("stddev_samp", "close", 20)}) as s20, ({_full("avg", "tr", 14)}) as atr_14 from s2 window w as (partition by ticker order by date)),
s4 as (select *, coalesce(100 - 100 / (1 + up / nullif(down, 0)), 50) as rsi_14, greatest(0, least(1, (close - (m20 - 2 * s20)) / nullif(4 * s20, 0))) as bb_position,
  4 * s20 / nullif(m20, 0) as bb_width, atr_14 / close as atr_ratio from s3)
"""


@query(FEATURE_SQL + f"select ticker, date, {_r(*FEATURES)} from s4", "daily_bars")
def panel_price_features(spark, sf_dir):
    df = price_panel(spark, sf_dir)
    return rounded(df.select("ticker", "date", *FEATURES))


@query(FEATURE_SQL + ", lab as (select s4.*, lead(close) over (partition by ticker order by date) / close - 1 as fr from s4) select cast(case when fr <= -0.2 then 0 when fr <= 0.2 then 1 else 2 end as bigint) as direction_label, count(*) as n, round(avg(realized_vol_20d), 6) as mean_vol, round(avg(price_vs_sma_20d), 6) as mean_sma, round(count(*) / sum(count(*)) over (), 6) as share from lab where fr is not null group by 1", "daily_bars")
def panel_label_profile(spark, sf_dir):
    """Share, mean volatility and mean price to average of each direction class."""
    df = features.label_windows(price_panel(spark, sf_dir), 1, 0.2).where("direction_label is not null")
    out = df.groupBy("direction_label").agg(F.count(F.lit(1)).alias("n"), F.avg("realized_vol_20d").alias("mean_vol"), F.avg("price_vs_sma_20d").alias("mean_sma"))
    total = out.agg(F.sum("n").alias("t"))
    return rounded(out.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("t")).drop("t"))


@query(f"""with recursive ordered as (select ticker, date, close, row_number() over (partition by ticker order by date) as rn from daily_bars),
e as (select ticker, date, rn, close as fast, close as slow, 0.0::double as macd, 0.0::double as sig from ordered where rn = 1 union all
  select ticker, date, rn, fast, slow, macd, sig * 0.8 + macd * 0.2 from (select o.ticker, o.date, o.rn, e.fast * (1 - 2.0::double/13) + o.close * (2.0::double/13) as fast, e.slow * (1 - 2.0::double/27) + o.close * (2.0::double/27) as slow,
  (e.fast * (1 - 2.0::double/13) + o.close * (2.0::double/13)) - (e.slow * (1 - 2.0::double/27) + o.close * (2.0::double/27)) as macd, e.sig from e join ordered o on o.ticker = e.ticker and o.rn = e.rn + 1) t)
select ticker, date, {_r("macd")}, round(sig, 6) + 0.0 as macd_signal from e""".replace("with recursive", "with", 1), "daily_bars")
def panel_macd(spark, sf_dir):
    return rounded(features.macd(bars(spark, sf_dir)).select("ticker", "date", "macd", "macd_signal"))


@query(f"""with r as (select *, close * volume as dollar_volume, close / lag(close) over (partition by ticker order by date) - 1 as rr from daily_bars),
 x as (select ticker, date, dollar_volume, avg(dollar_volume) over w as adv_20d, case when count(rr) over w >= 2 then stddev_samp(rr) over w end as return_std_20d from r window w as (partition by ticker order by date rows between 19 preceding and current row))
select ticker, date, {_r("dollar_volume", "adv_20d", "return_std_20d")} from x""", "daily_bars")
def panel_market_context(spark, sf_dir):
    return rounded(features.market_context(bars(spark, sf_dir)).select("ticker", "date", "dollar_volume", "adv_20d", "return_std_20d"))


@query(f"""with r as (select *, lead(close, 5) over w / close - 1 as future_simple_return, ln(close / lag(close) over w) as r1 from daily_bars window w as (partition by ticker order by date)),
x as (select ticker, date, future_simple_return, ln(1 + future_simple_return) as target_return, cast(case when future_simple_return <= -0.1 then 0 when future_simple_return <= 0.1 then 1 when future_simple_return is not null then 2 end as bigint) as direction_label,
 sqrt(252) * case when count(r1) over a = 20 then stddev_samp(r1) over a end as future_volatility_20d from r window a as (partition by ticker order by date rows between 1 following and 20 following))
select ticker, date, direction_label, {_r("future_simple_return", "target_return", "future_volatility_20d")} from x""", "daily_bars")
def panel_label_windows(spark, sf_dir):
    df = features.label_windows(bars(spark, sf_dir), 5, 0.1)
    return rounded(df.select("ticker", "date", "direction_label", "future_simple_return", "target_return", "future_volatility_20d"))


@query(FEATURE_SQL + """, s5 as (select s4.ticker, date, coalesce(sector, 'unknown') as sector, roc_20d, realized_vol_20d from s4 left join sector_map m on m.ticker = s4.ticker),
s6 as (select *, avg(roc_20d) over s as ms, avg(roc_20d) over d as md, avg(realized_vol_20d) over s as vs from s5 window s as (partition by date, sector), d as (partition by date))
select ticker, date, sector, round(coalesce(roc_20d - ms, 0), 6) + 0.0 as sector_relative_momentum, round(coalesce(ms - md, 0), 6) + 0.0 as sector_strength, round(coalesce(realized_vol_20d - vs, 0), 6) + 0.0 as sector_vol_spread from s6""", "daily_bars", "sector_map")
def panel_sector_features(spark, sf_dir):
    df = price_panel(spark, sf_dir).select("ticker", "date", "roc_20d", "realized_vol_20d")
    df = features.sector_features(df, view(spark, sf_dir, "sector_map"))
    return rounded(df.select("ticker", "date", "sector", "sector_relative_momentum", "sector_strength", "sector_vol_spread"))


CATALOG = {"log_return_1d": "price", "realized_vol_20d": "volatility", "price_vs_sma_200d": "price", "volume_ratio_20d": "volume", "bb_width": "volatility"}


@query(FEATURE_SQL + " select feature, family, round(missing_rate, 6) as missing_rate, 0.0::double as stale_rate from (" + " union all ".join(f"select '{c}' as feature, '{f}' as family, avg(case when {c} is null then 1.0 else 0.0 end) as missing_rate from s4" for c, f in CATALOG.items()) + ") t", "daily_bars")
def panel_feature_catalog(spark, sf_dir):
    return rounded(features.feature_catalog(price_panel(spark, sf_dir), CATALOG))


@query("""select ticker, date, cast(isodow(date) - 1 as bigint) as day_of_week, cast(month(date) as bigint) as month, last_day(date) = date as is_month_end, strftime(date, '%G-W%V') as week_id,
  cast(date - cast(isodow(date) - 1 as integer) as date) as week_start, cast(date - cast(isodow(date) - 1 as integer) + 4 as date) as week_end from daily_bars""", "daily_bars")
def calendar_features(spark, sf_dir):
    df = features.calendar_features(bars(spark, sf_dir)).withColumn("week_id", cal.iso_week(F.col("date")))
    a, b = cal.week_bounds(F.col("date"))
    return rounded(df.select("ticker", "date", "day_of_week", "month", "is_month_end", "week_id", a.alias("week_start"), b.alias("week_end")))


@query("""with d as (select distinct date from daily_bars), cal as (select cast(g as date) as day, row_number() over (order by g) as k from generate_series(timestamp '1990-01-01', timestamp '2010-12-31', interval 1 day) t(g) where isodow(g) < 6),
b as (select d.date, (select max(k) from cal where day <= d.date) as prev, isodow(d.date) >= 6 as weekend from d)
select date, n5.day as plus_5, m3.day as minus_3, cast((select count(*) from cal where day >= b.date and day < date '2000-01-03') as bigint) as to_2000 from b join cal n5 on n5.k = prev + 5 join cal m3 on m3.k = prev - 3 + case when weekend then 1 else 0 end""", "daily_bars")
def calendar_business_days(spark, sf_dir):
    d = F.col("date")
    days = bars(spark, sf_dir).select("date").distinct()
    return rounded(days.select("date", cal.bday_add(d, 5).alias("plus_5"), cal.bday_add(d, -3).alias("minus_3"), cal.bday_distance(d, F.lit("2000-01-03").cast("date")).alias("to_2000")))


@query(f"""with m as (select series_id, available_at, value from macro), d as (select date, series_id from (select distinct date from daily_bars) x, (select distinct series_id from macro) y),
a as (select d.date, d.series_id, m.value as level from d asof left join m on d.series_id = m.series_id and d.date >= m.available_at), b as (select *, level - lag(level, 5) over (partition by series_id order by date) as change_5d from a)
select ticker, p.date, series_id, {_r("level", "change_5d")} from daily_bars p join b on p.date = b.date""", "daily_bars", "macro")
def asof_macro_levels(spark, sf_dir):
    """The newest level of each macro series known on each date, its change over five distinct dates, joined to the panel."""
    from pyspark.sql import Window

    panel, macro = bars(spark, sf_dir), view(spark, sf_dir, "macro")
    grid = panel.select("date").distinct().crossJoin(F.broadcast(macro.select("series_id").distinct()))  # dates x a few series
    days = asof.asof_join(grid, macro.select("series_id", "available_at", F.col("value").alias("level")), "series_id", "date", "available_at")
    days = days.withColumn("change_5d", F.col("level") - F.lag("level", 5).over(Window.partitionBy("series_id").orderBy("date")))
    return rounded(panel.select("ticker", "date").join(days, "date").select("ticker", "date", "series_id", "level", "change_5d"))


@query(f"select b.ticker, b.date, f.available_at, f.report_date, {_r('revenue', 'profit')} from daily_bars b asof left join fundamentals f on b.ticker = f.ticker and b.date >= f.available_at", "daily_bars", "fundamentals")
def asof_fundamentals(spark, sf_dir):
    f = view(spark, sf_dir, "fundamentals").select("ticker", "available_at", "report_date", "revenue", "profit")
    out = asof.asof_join(bars(spark, sf_dir).select("ticker", "date"), f, "ticker", "date", "available_at")
    return rounded(out.select("ticker", "date", "available_at", "report_date", "revenue", "profit"))


@query("select series_id, count(*) as n, max(date) as last_date from macro where available_at <= date '1997-06-30' group by series_id", "macro")
def point_in_time_filter(spark, sf_dir):
    m = asof.point_in_time(view(spark, sf_dir, "macro"), F.lit("1997-06-30").cast("date"))
    return m.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last_date"))


@query("""with ev as (select concat('Brand#', cast(o_custkey % 25 + 1 as string)) as ticker, cast(o_orderdate as date) as date, max(o_orderkey % 2) as on_ from orders group by all), ea as (select * from ev union all select ticker, date '1990-01-01', 1 from sector_map),
last as (select p.ticker, p.date, e.on_ as state from daily_bars p asof join ea e on e.ticker = p.ticker and p.date >= e.date) select date, count(*) as members from last where state = 1 group by date""", "daily_bars", "sector_map")
def universe_constituents(spark, sf_dir):
    """Members by date from a base list and dated additions and removals (removals first on a day)."""
    o = table(spark, sf_dir, "orders")
    o = o.select(F.col("o_orderdate").cast("date").alias("date"), F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("ticker"), (F.col("o_orderkey") % 2 == 1).alias("on"))
    changes = o.groupBy("date").agg(F.collect_set(F.when(F.col("on"), F.col("ticker"))).alias("added"), F.collect_set(F.when(~F.col("on"), F.col("ticker"))).alias("removed"))
    base = view(spark, sf_dir, "sector_map").select("ticker", F.lit("1990-01-01").cast("date").alias("base_date"))
    members = asof.constituents(bars(spark, sf_dir), asof.membership_intervals(base, changes))
    return members.groupBy("date").agg(F.count(F.lit(1)).alias("members"))


@query("with l as (select ticker, max(date) as date from daily_bars group by ticker) select l.ticker, l.date, round(b.close, 6) as close, round(b.volume, 6) as volume from l join daily_bars b on b.ticker = l.ticker and b.date = l.date", "daily_bars")
def latest_slice(spark, sf_dir):
    return rounded(features.latest_rows(bars(spark, sf_dir), "ticker", "date").select("ticker", "date", "close", "volume"))


@query("""select ticker, date, cast(20 as bigint) as length, round(s, 6) as close_sum from (select ticker, date, count(*) over w as n, sum(close) over w as s from daily_bars window w as (partition by ticker order by date rows between 19 preceding and current row)) t where n = 20""", "daily_bars")
def sequence_windows(spark, sf_dir):
    df = features.sequences(bars(spark, sf_dir), ["close", "volume"], 20)
    total = F.aggregate("sequence", F.lit(0.0), lambda s, x: s + x["close"])
    return rounded(df.select("ticker", "date", F.size("sequence").alias("length"), total.alias("close_sum")))


@query("""with g as (select t.ticker, cast(c.g as date) as date from (select distinct ticker from daily_bars) t, generate_series((select cast(min(date) as timestamp) from daily_bars), (select cast(max(date) as timestamp) from daily_bars), interval 1 day) c(g) where isodow(c.g) < 6)
select g.ticker, g.date, coalesce(round(b.close, 9), 0.0) as close, coalesce(round(b.volume, 9), 0.0) as volume from g left join daily_bars b on b.ticker = g.ticker and b.date = g.date""", "daily_bars")
def dense_calendar_fill(spark, sf_dir):
    """Every ticker on every business day of the panel."""
    b = bars(spark, sf_dir)
    ends = b.agg(F.min("date").alias("a"), F.max("date").alias("b"))  # one row
    days = ends.select(F.explode(F.sequence("a", "b")).alias("date")).where(cal.is_business_day(F.col("date")))
    return rounded(asof.dense_fill(b.select("ticker", "date", "close", "volume"), b.select("ticker").distinct(), days, {"close": 0.0, "volume": 0.0}), 9)
