"""Queries over landed payloads derived from the tables, normalisation and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import models, normalize
from panelspark.plans.fixtures import table, view, with_views
from panelspark.plans.forecast_queries import LABELLED, labelled
from panelspark.plans.panel_queries import bars, rounded
from panelspark.sources import landed

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str = "", *views: str):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return put


@query("select b.ticker, cast(date as date) as date, round(open, 6) as open, round(close, 6) as close, round(volume, 6) as volume from daily_bars b", "daily_bars")
def source_column_quotes(spark, sf_dir):
    """Bars written as column-array JSON by ticker and year, and read back."""
    b = bars(spark, sf_dir).withColumn("t", F.unix_seconds(F.col("date").cast("timestamp")))
    cols = ["open", "high", "low", "close", "volume"]
    j = b.groupBy("ticker", F.year("date").alias("y")).agg(F.sort_array(F.collect_list(F.struct("t", *cols))).alias("r"))
    payload = F.to_json(F.struct(F.col("r.t").alias("timestamp"), *[F.col(f"r.{c}").alias(c) for c in cols]))
    out = landed.column_quotes(j.select("ticker", payload.alias("payload")))
    return rounded(out.select("ticker", F.to_date("timestamp_utc").alias("date"), "open", "close", "volume"))


@query("select user_id as ticker, cast(ts as date) as date, round(arg_min(value, ts), 6) as open, round(max(value), 6) as high, round(min(value), 6) as low, round(arg_max(value, ts), 6) as close, round(arg_max(value * 2, ts), 6) as volume from events group by all")
def source_tick_bars(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), (F.col("value") * 2).alias("volume"))
    return rounded(landed.tick_bars(e).select("ticker", "date", "open", "high", "low", "close", "volume"))


@query("""with s as (select series_id, date, value, isodow(date) < 6 as b from macro), c as (select series_id as ticker, date, value as close, lead(date) over (partition by series_id order by date) as nx from s where b),
g as (select ticker, cast(g.d as date) as date, close from c, lateral (select unnest(generate_series(cast(c.date as timestamp), coalesce(cast(c.nx as timestamp) - interval 1 day, cast(c.date as timestamp)), interval 1 day)) as d) g where isodow(g.d) < 6), h as (select *, coalesce(lag(close) over (partition by ticker order by date), close) as open from g)
select ticker, date, round(open, 6) as open, round(greatest(open, close) * (1 + 0.5 * least(abs(close / open - 1), 0.1)), 6) as high, round(least(open, close) * (1 - 0.5 * least(abs(close / open - 1), 0.1)), 6) as low, round(close, 6) as close from h""", "macro")
def source_proxy_bars(spark, sf_dir):
    m = view(spark, sf_dir, "macro").select(F.col("series_id").alias("ticker"), "date", F.col("value").alias("close"))
    return rounded(landed.proxy_bars(m).select("ticker", "date", "open", "high", "low", "close"))


@query("""with f as (select o_orderstatus as source, o_orderpriority as ticker, cast(o_orderdate as date) as date from orders), p as (select source, ticker, min(date) as a, max(date) as b from f group by all)
select ticker, max(a) as start, min(b) as "end" from p group by ticker having count(*) = (select count(distinct source) from f) and max(a) <= min(b)""")
def source_common_window(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return landed.common_window(o.select(F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("date").alias("date")))


@query("""with u as (select o_custkey as k, o_orderstatus as s, case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end as priority, count(*) as n from orders group by all)
select k, s, n, priority > 1 as fallback_used from (select *, row_number() over (partition by k order by priority) as rn from u) t where rn = 1""")
def source_fallback(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    o = o.withColumn("priority", F.when(F.col("s") == "F", 1).when(F.col("s") == "O", 2).otherwise(3))
    return landed.first_source(o, ["k"], "priority").select("k", "s", "n", "fallback_used")


@query("""with t as (select p_brand as ticker, cast(l_shipdate as date) as d, l_extendedprice as x from lineitem join part on l_partkey = p_partkey) select ticker, d as timestamp_utc, round(min(x), 6) as close from t group by all""")
def normalize_bars(spark, sf_dir):
    """Trades as raw bars with text prices and many duplicates: one row a key, the first in a total order."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    x = F.col("l_extendedprice")
    raw = li.select(F.col("p_brand").alias("ticker"), F.col("l_shipdate").cast("date").alias("timestamp_utc"), x.alias("open"), x.alias("high"), x.alias("low"), x.cast("string").alias("close"), x.alias("volume"))
    return rounded(normalize.bars(raw).select("ticker", "timestamp_utc", "close"))


@query("""select doc_id, 'short' as rule from documents where coalesce(length(text) >= 100, false) = false union all select doc_id, 'language' from documents where coalesce(lang in ('en', 'de'), false) = false union all select doc_id, 'source' from documents where coalesce(regexp_matches(source, '^src[0-9]$'), false) = false""")
def contract_violations(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rules = {"short": F.length("text") >= 100, "language": F.col("lang").isin("en", "de"), "source": F.col("source").rlike("^src[0-9]$")}
    return normalize.violations(d, "doc_id", rules)


@query("with " + LABELLED + """, t as (select * from p where y is not null), g as (select y as cls, ln(count(*) / (select count(*) from t)) as lp, avg(prob_up) as m1, greatest(var_pop(prob_up), 1e-6) as v1, avg(prob_down) as m2, greatest(var_pop(prob_down), 1e-6) as v2 from t group by y),
l as (select ticker, date, cls, lp - 0.5 * (ln(2 * pi() * v1) + pow(prob_up - m1, 2) / v1) - 0.5 * (ln(2 * pi() * v2) + pow(prob_down - m2, 2) / v2) as l from t, g), ee as (select *, exp(l - max(l) over (partition by ticker, date)) as x from l)
select ticker, date, cast(cls as bigint) as cls, round(x / sum(x) over (partition by ticker, date), 6) as posterior from ee""", "daily_bars", "scores")
def model_gaussian(spark, sf_dir):
    t = labelled(spark, sf_dir).where("direction_label is not null")
    cols = ["prob_up", "prob_down"]
    return rounded(models.gaussian_posterior(t, models.gaussian_fit(t, cols, "direction_label"), cols, ["ticker", "date"]))


@query()
def model_ridge_contributions(spark, sf_dir):
    """Ridge on the forecast probabilities; mean score and the leading feature's count."""
    t = labelled(spark, sf_dir).where("future_simple_return is not null")
    coef = models.ridge(t, ["prob_up", "prob_down"], "future_simple_return", 1.0)
    out = t.withColumn("score", models.linear_score(coef)).withColumn("top", models.top_contributions(coef, 1)[0]["name"])
    return rounded(out.groupBy("top").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score")))
