"""Queries over the utility of news and learned weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import learned, news, news_utility
from panelspark.plans.fixtures import kept, view, with_views
from panelspark.plans.panel_queries import bars, rounded

Q: dict = {}
SQL: dict[str, str] = {}
SOURCES = {"click": 1.5, "view": 0.5, "error": -2.0}
SESSIONS = {"pre_market": 1.2, "post_market": 0.8}


def query(sql: str = "", *views: str):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *views)
        return f

    return put


def _weighted(x: str, w: str) -> str:
    return f"coalesce(sum({x} * {w}) / nullif(sum({w}), 0), avg({x}))"


W = {"unweighted": "b", "source_weighted": "b * sw", "session_weighted": "b * nw", "source_session_weighted": "b * sw * nw"}
ITEMS = """it as (select *, 1.0 / row_number() over (partition by ticker, headline_key order by published_at, item_id) as novelty, greatest(least(relevance_score, 1), 0) as b,
 case source_name when 'click' then 1.5 when 'view' then 0.5 else 1.0 end as sw, case session when 'pre_market' then 1.2 when 'post_market' then 0.8 else 1.0 end as nw from mapped)"""
DAILY = f"""{ITEMS}, dv as (select ticker, date, {", ".join(f"{_weighted('sentiment_score', w)} as sentiment_{k}, {_weighted('relevance_score', w)} as relevance_{k}" for k, w in W.items())},
 count(*) as headline_count, avg(mapping_confidence) as mapping_confidence, avg(novelty) as novelty, count(distinct source_key) as source_diversity, count(distinct source_name) as source_count, string_agg(distinct source_name, '|' order by source_name) as source_mix,
 case when count(distinct session) = 1 then min(session) else 'mixed' end as session_bucket from it group by ticker, date)"""
PANEL = f"""{DAILY}, cov as (select ticker, date, close / lag(close) over (partition by ticker order by date) - 1 as ret from daily_bars union all
 select ticker, cast(g as date), null from (select distinct ticker from daily_bars) t, (select g from generate_series((select cast(max(date) + 1 as timestamp) from daily_bars), (select cast(max(date) + 9 as timestamp) from daily_bars), interval 1 day) s(g) where isodow(g) < 6 order by g limit 3) c),
pn as (select cov.ticker, cov.date, ret, {", ".join(f"coalesce(sentiment_{k}, 0) as sentiment_{k}, coalesce(relevance_{k}, 0) as relevance_{k}" for k in W)}, coalesce(headline_count, 0) as headline_count, coalesce(mapping_confidence, 0) as mapping_confidence,
 coalesce(novelty, 0) as novelty, coalesce(source_diversity, 0) as source_diversity, coalesce(source_count, 0) as source_count, coalesce(source_mix, 'none') as source_mix, coalesce(session_bucket, 'none') as session_bucket from cov left join dv on dv.ticker = cov.ticker and dv.date = cov.date)"""
EFF = "case when headline_count * greatest(least({r}, 1), 0) * greatest(least(mapping_confidence, 1), 0) > 0 then headline_count * greatest(least({r}, 1), 0) * greatest(least(mapping_confidence, 1), 0) else greatest(headline_count, 0) end"
SIGNAL = f"{PANEL}, sg as (select *, {EFF.format(r='relevance_source_session_weighted')} as news_weight, sentiment_source_session_weighted as signal from pn), sa as (select *, news_weight > 0 as active from sg)"
IC = "coalesce(covar_pop(x, ret) / nullif(sqrt(var_pop(case when ret is not null then x end)) * sqrt(var_pop(case when x is not null then ret end)), 0), 0)"


def metrics_sql(rows: str, by: str, total: str = "count(*)") -> str:
    """Metrics of long rows (by, signal, active, ret, source_diversity, source_count)."""
    return f"""select {by}, signal_days, round(signal_days / t, 9) as coverage, round(ic, 9) + 0.0 as ic, round(abs(ic), 9) as abs_ic, round(coalesce(n_both / nullif(signal_days, 0), 0), 9) as overlap_rate, round(coalesce(d, 0), 9) as source_diversity_mean, round(coalesce(c, 0), 9) as source_count_mean from
 (select {by}, count(*) filter (active) as signal_days, {total} as t, {IC} as ic, count(*) filter (active and ret is not null) as n_both, avg(case when active then source_diversity end) as d, avg(case when active then source_count end) as c from (select *, case when active then signal end as x from {rows}) q group by {by}) z"""


COLS = ["signal_days", "coverage", "ic", "abs_ic", "overlap_rate", "source_diversity_mean", "source_count_mean"]


def items(spark, sf_dir):
    return news_utility.with_weights(news.novelty(view(spark, sf_dir, "mapped")), SOURCES, SESSIONS)


def panel(spark, sf_dir):
    daily = news_utility.daily_variants(items(spark, sf_dir))
    return news_utility.with_signals(news_utility.news_panel(news_utility.coverage_panel(bars(spark, sf_dir), 3), daily))


@query(f"with {DAILY} select ticker, date, {', '.join(f'round(sentiment_{k}, 9) + 0.0 as sentiment_{k}, round(relevance_{k}, 9) as relevance_{k}' for k in W)}, headline_count, round(mapping_confidence, 9) as mapping_confidence, round(novelty, 9) as novelty, source_diversity, source_count, source_mix, session_bucket from dv", "mapped")
def news_daily_variants(spark, sf_dir):
    """Two scores under four weightings, counts and labels by ticker and day."""
    return rounded(news_utility.daily_variants(items(spark, sf_dir)), 9)


@query(f"with {ITEMS} select ticker, date, session, count(*) as n from it where session <> '' group by all", "mapped")
def news_session_counts(spark, sf_dir):
    return news_utility.session_counts(items(spark, sf_dir)).select("ticker", "date", F.explode("session_counts").alias("session", "n"))


@query("select item_id, ticker, published_at from mapped order by published_at desc, relevance_score desc, item_id limit 10", "mapped")
def news_newest_relevant(spark, sf_dir):
    """Top-k report: the ten newest, more relevant first."""
    return news_utility.newest_relevant(view(spark, sf_dir, "mapped")).select("item_id", "ticker", "published_at")


@query(f"with {PANEL} select ticker, date, round(ret, 9) + 0.0 as ret, headline_count, source_mix, session_bucket, round(sentiment_source_session_weighted, 9) + 0.0 as sentiment from pn", "daily_bars", "mapped")
def news_coverage_panel(spark, sf_dir):
    """The coverage panel joined with news; days without news are neutral."""
    return rounded(panel(spark, sf_dir).select("ticker", "date", "ret", F.col("headline_count").cast("bigint").alias("headline_count"), "source_mix", "session_bucket", F.col("sentiment_source_session_weighted").alias("sentiment")), 9)


@query(f"""with {DAILY}, mo as (select ticker, cast(date_trunc('week', date) as date) as date, * exclude (ticker, date) from dv), sp as (select ticker, date, unnest(string_split(source_mix, '|')) as s from mo), sx as (select ticker, date, string_agg(distinct trim(s), '|' order by trim(s)) as source_mix from sp where trim(s) not in ('', 'none') group by all)
select mo.ticker, mo.date, round({_weighted('sentiment_unweighted', 'headline_count')}, 9) + 0.0 as sentiment_unweighted, round({_weighted('relevance_unweighted', 'headline_count')}, 9) as relevance_unweighted, cast(sum(headline_count) as bigint) as headline_count, round(avg(novelty), 9) as novelty, max(source_count) as source_count,
 case when count(distinct session_bucket) = 1 then min(session_bucket) else 'mixed' end as session_bucket, any_value(sx.source_mix) as source_mix from mo join sx on sx.ticker = mo.ticker and sx.date = mo.date group by mo.ticker, mo.date""", "mapped")
def news_collapse(spark, sf_dir):
    """Daily news collapsed to one row a ticker and week, weighted by headline counts."""
    d = news_utility.daily_variants(items(spark, sf_dir)).withColumn("date", F.to_date(F.date_trunc("week", "date")))
    out = news_utility.collapse(d, ["sentiment_unweighted", "relevance_unweighted"])
    return rounded(out.select("ticker", "date", "sentiment_unweighted", "relevance_unweighted", "headline_count", "novelty", "source_count", "session_bucket", "source_mix"), 9)


WINDOWS = [1, 3, 5, 10]
LOOKBACK = "lb as (" + " union all ".join(f"select cast({n} as bigint) as window_days, ret, source_diversity, source_count, sum(signal * news_weight) over w / nullif(sum(news_weight) over w, 0) as signal, sum(news_weight) over w > 0 as active from sa window w as (partition by ticker order by date rows between {n - 1} preceding and current row)" for n in WINDOWS) + ")"


@query(f"with {SIGNAL}, {LOOKBACK} {metrics_sql('lb', 'window_days')}", "daily_bars", "mapped")
def news_lookback_metrics(spark, sf_dir):
    return rounded(news_utility.signal_metrics(news_utility.lookback_rows(panel(spark, sf_dir), WINDOWS), ["window_days"]).select("window_days", *COLS), 9)


@query(f"""with {SIGNAL}, od as (select *, signal * news_weight as v, row_number() over (partition by ticker order by date) as rn from sa),
dk as (select ticker, rn, ret, source_diversity, source_count, v as n3, cast(news_weight as double) as d3, v as n5, cast(news_weight as double) as d5 from od where rn = 1 union all
 select o.ticker, o.rn, o.ret, o.source_diversity, o.source_count, n3 * pow(0.5, 1.0 / 3) + o.v * (1 - pow(0.5, 1.0 / 3)), d3 * pow(0.5, 1.0 / 3) + o.news_weight * (1 - pow(0.5, 1.0 / 3)), n5 * pow(0.5, 1.0 / 5) + o.v * (1 - pow(0.5, 1.0 / 5)), d5 * pow(0.5, 1.0 / 5) + o.news_weight * (1 - pow(0.5, 1.0 / 5)) from dk join od o on o.ticker = dk.ticker and o.rn = dk.rn + 1),
dr as (select cast(3 as bigint) as halflife_days, ret, source_diversity, source_count, n3 / nullif(d3, 0) as signal, d3 >= 0.05 as active from dk union all select 5, ret, source_diversity, source_count, n5 / nullif(d5, 0), d5 >= 0.05 from dk)
select halflife_days, signal_days, round(coverage, 6) as coverage, round(abs_ic, 6) as abs_ic, overlap_rate from ({metrics_sql('dr', 'halflife_days')}) m""", "daily_bars", "mapped")
def news_decay_metrics(spark, sf_dir):
    out = news_utility.signal_metrics(news_utility.decay_rows(panel(spark, sf_dir), [3, 5]), ["halflife_days"])
    return rounded(rounded(out.select("halflife_days", "signal_days", "coverage", "abs_ic")).join(rounded(out.select("halflife_days", "overlap_rate"), 9), "halflife_days"), 9)


FIVE = "sum({c} * news_weight) over w / nullif(sum(news_weight) over w, 0)"
FEATURES = f"""fr as (select 'sentiment_1d' as variant, ret, source_diversity, source_count, signal, active from sa union all select 'headline_count_1d', ret, source_diversity, source_count, ln(1 + headline_count), headline_count > 0 from sa union all
 select 'novelty_5d', ret, source_diversity, source_count, {FIVE.format(c='novelty')}, sum(news_weight) over w > 0 from sa window w as (partition by ticker order by date rows between 4 preceding and current row) union all
 select 'source_diversity_5d', ret, source_diversity, source_count, {FIVE.format(c='source_diversity')}, sum(news_weight) over w > 0 from sa window w as (partition by ticker order by date rows between 4 preceding and current row))"""


@query(f"with {SIGNAL}, {FEATURES} {metrics_sql('fr', 'variant')}", "daily_bars", "mapped")
def news_feature_variants(spark, sf_dir):
    return rounded(news_utility.signal_metrics(news_utility.feature_rows(panel(spark, sf_dir)), ["variant"]).select("variant", *COLS), 9)


VARIANTS = {f"{k}_1d": k for k in W}
WEIGHTED = "wr as (" + " union all ".join(f"select '{label}' as variant, ret, source_diversity, source_count, sentiment_{k} as signal, {EFF.format(r=f'relevance_{k}')} > 0 as active from pn" for label, k in VARIANTS.items()) + ")"
MULTI = WEIGHTED.replace("wr as", "wm as").replace(" > 0 as active", " > 0 and source_count >= 2 as active")


@query(f"with {PANEL}, {WEIGHTED} {metrics_sql('wr', 'variant')}", "daily_bars", "mapped")
def news_weighting_variants(spark, sf_dir):
    return rounded(news_utility.signal_metrics(news_utility.weighting_rows(panel(spark, sf_dir), VARIANTS), ["variant"]).select("variant", *COLS), 9)


@query(f"with {PANEL}, {MULTI}, m as ({metrics_sql('wm', 'variant')}), b as (select * from m where variant = 'source_session_weighted_1d') select m.variant as against, round(b.abs_ic - m.abs_ic, 8) + 0.0 as abs_ic_delta, round(b.overlap_rate - m.overlap_rate, 8) + 0.0 as overlap_rate_delta, b.abs_ic > m.abs_ic and b.overlap_rate > m.overlap_rate as improves_joint from m, b where m.variant in ('unweighted_1d', 'source_weighted_1d')", "daily_bars", "mapped")
def news_weighting_improvement(spark, sf_dir):
    """Rows of several sources only: the fixed weighting against two others."""
    m = rounded(news_utility.signal_metrics(news_utility.weighting_rows(panel(spark, sf_dir), VARIANTS, multi_source=True), ["variant"]), 9)
    return rounded(news_utility.improvement(m, "source_session_weighted_1d", ["unweighted_1d", "source_weighted_1d"]), 8)


BUCKETS = """bk as (select 'session_bucket' as dimension, session_bucket as bucket, * exclude (session_bucket) from sa union all by name select 'source_mix' as dimension, source_mix as bucket, * from sa union all by name select 'source_session' as dimension, source_mix || '::' || session_bucket as bucket, * from sa
 union all by name select 'diversity' as dimension, case when source_count <= 1 then 'single_source' else 'multi_source' end as bucket, * from sa), bq as (select * from bk where bucket not like 'none%' and bucket <> '')"""
BUCKET_METRICS = metrics_sql("bq", "dimension, bucket", "(select count(*) from sa)")


@query(f"with {SIGNAL}, {BUCKETS} {BUCKET_METRICS}", "daily_bars", "mapped")
def news_bucket_metrics(spark, sf_dir):
    return rounded(news_utility.bucket_metrics(panel(spark, sf_dir)).select("dimension", "bucket", *COLS), 9)


@query(f"with {SIGNAL}, {BUCKETS}, m as ({BUCKET_METRICS}) select dimension, bucket, abs_ic, overlap_rate, coverage from (select *, row_number() over (partition by dimension order by abs_ic desc, overlap_rate desc, coverage desc, bucket) as rn from m) t where rn = 1", "daily_bars", "mapped")
def news_best_entries(spark, sf_dir):
    return news_utility.best_entry(news_bucket_metrics(spark, sf_dir), ["dimension"], "bucket").select("dimension", "bucket", "abs_ic", "overlap_rate", "coverage")


@query(f"""with {SIGNAL}, {BUCKETS}, m as ({BUCKET_METRICS}), g as (select coalesce(max(abs_ic), 0) as a, coalesce(max(overlap_rate), 0) as o, coalesce(max(coverage), 0) as c from m where dimension = 'source_mix' and bucket = 'click'),
b as (select * from m where dimension = 'source_mix' and contains(bucket, '|') order by abs_ic desc, overlap_rate desc, coverage desc, bucket limit 1), x as (select b.bucket as best_multi_source, round(g.a - coalesce(b.abs_ic, 0), 8) + 0.0 as abs_ic_advantage, round(g.o - coalesce(b.overlap_rate, 0), 8) + 0.0 as overlap_advantage, round(g.c - coalesce(b.coverage, 0), 8) + 0.0 as coverage_advantage from g left join b on true)
select *, case when abs_ic_advantage > 0 and overlap_advantage > 0.05 then 'overlap_advantage' when abs_ic_advantage > 0 and coverage_advantage > 0.002 then 'coverage_advantage' when abs_ic_advantage > 0 and best_multi_source is not null then 'multi_source_dilution' else 'mixed_or_no_clear_advantage' end as dominant_reason from x""", "daily_bars", "mapped")
def news_source_advantage(spark, sf_dir):
    return rounded(news_utility.source_advantage(news_bucket_metrics(spark, sf_dir), "click"), 8)


@query(f"""with {SIGNAL}, {BUCKETS}, m as ({BUCKET_METRICS}), s as (select * from m where dimension = 'session_bucket'), o as (select * from s where bucket not in ('mixed', 'none') order by abs_ic desc, overlap_rate desc, coverage desc, bucket limit 1), x as (select count(*) > 0 as present, max(abs_ic) as a, max(overlap_rate) as r from s where bucket = 'mixed')
select present, o.bucket as best_other, round(coalesce(x.a, 0) - coalesce(o.abs_ic, 0), 8) + 0.0 as abs_ic_advantage, round(coalesce(x.r, 0) - coalesce(o.overlap_rate, 0), 8) + 0.0 as overlap_advantage from x left join o on true""", "daily_bars", "mapped")
def news_mixed_session(spark, sf_dir):
    return rounded(news_utility.mixed_session(news_bucket_metrics(spark, sf_dir)), 8)


@query("with r as (select distinct ticker as run_id from mapped), m as (select ticker as run_id, session, avg(sentiment_score) as v from mapped group by all), g as (select run_id, session from r, (select distinct session from m) s), f as (select g.session, coalesce(m.v, 0) as v from g left join m on m.run_id = g.run_id and m.session = g.session) select session, count(*) as count, round(avg(v), 9) + 0.0 as mean, round(median(v), 9) + 0.0 as median, round(stddev_pop(v), 9) as std, round(min(v), 9) as min, round(max(v), 9) as max from f group by session", "mapped")
def news_across_runs(spark, sf_dir):
    """Mean sentiment by session over tickers as runs; a run without the session counts as 0."""
    m = view(spark, sf_dir, "mapped")
    per = m.groupBy(F.col("ticker").alias("run_id"), "session").agg(F.avg("sentiment_score").alias("v"))
    return rounded(news_utility.across_runs(per, m.select(F.col("ticker").alias("run_id")), "session", "v"), 9)


ORD = "cast(5 * floor((date_diff('day', date '1970-01-05', {d})) / 7) + least(isodow({d}) - 1, 5) as bigint)"
COMBOS = f"""cb as (select ticker, date, {ORD.format(d='date')} as ord, source_name, session as session_bucket, source_name || '::' || session as combo_key, sum(b) as base_weight_sum, sum(b * sentiment_score) as sentiment_weighted_sum, sum(b * relevance_score) as relevance_weighted_sum, count(*) as article_count from (select *, greatest(least(relevance_score, 1), 0) as b from mapped) t group by all),
rt as (select ticker, date, close / lag(close) over (partition by ticker order by date) - 1 as ret from daily_bars), h as (select cb.*, ret, sentiment_weighted_sum / nullif(base_weight_sum, 0) as signal from cb left join rt on rt.ticker = cb.ticker and rt.date = cb.date),
ev as (select distinct date, ord from cb)"""


def fits_sql(lookback: int, name: str = "ft") -> str:
    return f"""{name} as (select e.date, combo_key, cast(count(*) filter (base_weight_sum > 0 and ret is not null) as double) as n, cast(count(*) filter (base_weight_sum > 0) as double) as signal_days,
 case when count(*) filter (base_weight_sum > 0 and ret is not null) < 2 then 0 else abs(coalesce(covar_pop(signal, ret) / nullif(sqrt(var_pop(case when ret is not null then signal end)) * sqrt(var_pop(case when signal is not null then ret end)), 0), 0)) end as abs_ic
 from ev e join h on h.ord < e.ord and h.ord >= e.ord - {lookback} group by all having count(*) filter (base_weight_sum > 0 and ret is not null) > 0)"""


FITS = f"""{COMBOS}, {fits_sql(15)}, fo as (select *, n / signal_days as overlap_rate, abs_ic as target_score from ft), fg as (select *, sum(target_score * n) over (partition by date) / sum(n) over (partition by date) as global_score from fo),
fs as (select *, greatest((n * target_score + 30 * global_score) / (n + 30), 0) as shrunk_score from fg), dg as (select ev.date, coalesce(sum(n), 0) as total, count(*) filter (n >= 20) as eligible, max(target_score) as best, max(global_score) as global_score, max(shrunk_score) as top from ev left join fs on fs.date = ev.date group by ev.date),
dd as (select date, case when total < 20 then 'insufficient_total_samples' when eligible = 0 then 'insufficient_combo_samples' when global_score <= 0 and best <= 0 then 'zero_target_score' when top <= 0 then 'zero_shrunk_score' else 'learned' end as reason, global_score, total, eligible from dg)"""


def fitted(spark, sf_dir):
    combos = learned.combo_rows(view(spark, sf_dir, "mapped"))
    fits = learned.trailing_fits(combos, _returns(spark, sf_dir), 15)
    return (combos, *learned.shrunk_scores(fits, combos, 30.0, 20))


def _returns(spark, sf_dir):
    return news_utility.coverage_panel(bars(spark, sf_dir), 1).where("ret is not null")


@query(f"with {COMBOS} select ticker, date, source_name, session_bucket, combo_key, round(base_weight_sum, 9) as base_weight_sum, round(sentiment_weighted_sum, 9) + 0.0 as sentiment_weighted_sum, round(relevance_weighted_sum, 9) as relevance_weighted_sum, article_count from cb", "daily_bars", "mapped")
def learned_combo_rows(spark, sf_dir):
    return rounded(learned.combo_rows(view(spark, sf_dir, "mapped")), 9)


@query(f"""with {DAILY}, ss as (select *, unnest(string_split(source_mix, '|')) as s, len(string_split(source_mix, '|')) as k, case when headline_count * greatest(least(relevance_unweighted, 1), 0) > 0 then headline_count * greatest(least(relevance_unweighted, 1), 0) else headline_count end as w from dv)
select ticker, date, s as source_name, session_bucket, s || '::' || session_bucket as combo_key, round(w / k, 9) as base_weight_sum, round(sentiment_unweighted * (w / k), 9) + 0.0 as sentiment_weighted_sum, cast(greatest(round_even(headline_count / k, 0), 1) as double) as article_count from ss where w > 0""", "mapped")
def learned_fallback_breakdown(spark, sf_dir):
    """Days without a breakdown: the day's weight split over the sources of its mix."""
    d = news_utility.daily_variants(items(spark, sf_dir))
    d = d.select("ticker", "date", "source_mix", F.lit(None).cast("string").alias("source"), "session_bucket", "headline_count", F.col("sentiment_unweighted").alias("sentiment_score"), F.col("relevance_unweighted").alias("relevance_score"), F.lit(None).cast("map<string,struct<articles:bigint,weight:double,sentiment_sum:double>>").alias("breakdown"))
    return rounded(learned.expand_breakdown(d), 9)


@query(f"with {FITS} select date, combo_key, n, signal_days, round(abs_ic, 7) as abs_ic, round(overlap_rate, 9) as overlap_rate, round(shrunk_score, 7) as shrunk_score from fs", "daily_bars", "mapped")
def learned_trailing_fits(spark, sf_dir):
    f = fitted(spark, sf_dir)[1]
    return rounded(rounded(f.select("date", "combo_key", "n", "signal_days", "abs_ic", "shrunk_score"), 7).join(rounded(f.select("date", "combo_key", "overlap_rate"), 9), ["date", "combo_key"]), 9)


@query(f"with {FITS} select reason, count(*) as days, round(avg(global_score), 7) as global_score, cast(sum(eligible) as bigint) as eligible from dd group by reason", "daily_bars", "mapped")
def learned_fit_reasons(spark, sf_dir):
    d = fitted(spark, sf_dir)[2]
    return rounded(d.groupBy("reason").agg(F.count(F.lit(1)).alias("days"), F.avg("global_score").alias("global_score"), F.sum("eligible").alias("eligible")), 7)


@query(f"with {FITS} select count(*) filter (reason = 'learned') as fit_days, count(*) filter (reason <> 'learned') as fallback_days, round(avg((reason <> 'learned')::int), 7) as fallback_rate, round(coalesce(avg(case when reason = 'learned' then global_score end), 0), 7) as global_score_mean, round(coalesce(avg(case when reason = 'learned' then total end), 0), 7) as samples_mean, round(coalesce(avg(case when reason = 'learned' then eligible end), 0), 7) as eligible_mean from dd", "daily_bars", "mapped")
def learned_fit_summary(spark, sf_dir):
    return rounded(learned.fit_summary(fitted(spark, sf_dir)[2]), 7)


APPLIED = f"""{FITS}, rw as (select cb.*, coalesce(shrunk_score, dd.global_score) as raw from cb join dd on dd.date = cb.date and reason = 'learned' left join fs on fs.date = cb.date and fs.combo_key = cb.combo_key),
wk as (select *, count(*) over (partition by ticker, date) as cnt, row_number() over (partition by ticker, date order by raw, combo_key) - 1 as k, sum(raw) over (partition by ticker, date) as tot from rw),
wz as (select *, (1 - k * 0.05) / sum(raw) over (partition by ticker, date order by k rows between current row and unbounded following) as sc from wk), wf as (select *, min(k) filter (raw * sc >= 0.05) over (partition by ticker, date) as first from wz),
aw as (select *, case when tot <= 0 then null when 0.05 * cnt >= 1 then 1.0 / cnt when k < first then 0.05 else raw * max(sc) filter (k = first) over (partition by ticker, date) end as weight from wf)"""


def applied(spark, sf_dir):
    combos, f, d = fitted(spark, sf_dir)
    return learned.applied_weights(combos, f, d, 0.05)


@query(f"with {APPLIED} select ticker, date, round(sum(weight * sentiment_weighted_sum) / sum(weight * base_weight_sum), 7) + 0.0 as sentiment_learned, round(greatest(least(sum(weight * relevance_weighted_sum) / sum(weight * base_weight_sum), 1), 0), 7) as relevance_learned from aw where weight is not null group by all having sum(weight * base_weight_sum) > 0", "daily_bars", "mapped")
def learned_walk_forward(spark, sf_dir):
    """Learned sentiment and relevance of each day whose history allowed a fit."""
    return rounded(learned.learned_daily(applied(spark, sf_dir)), 7)


@query(f"with {APPLIED}, p as (select ticker, date, 'source' as kind, source_name as item, sum(weight) as w from aw where weight is not null group by all union all select ticker, date, 'session', session_bucket, sum(weight) from aw where weight is not null group by all union all select ticker, date, 'combo', combo_key, sum(weight) from aw where weight is not null group by all) select kind, item, round(avg(w), 7) as mean_weight, round(min(w), 7) as min_weight, round(max(w), 7) as max_weight, count(*) as group_count from p group by all", "daily_bars", "mapped")
def learned_weight_summary(spark, sf_dir):
    w = applied(spark, sf_dir)
    out = None
    for kind, by in (("source", "source_name"), ("session", "session_bucket"), ("combo", "combo_key")):
        one = learned.weight_summary(w, by).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return rounded(out, 7)


@query(f"""with {COMBOS}, {fits_sql(10, "f10")}, {fits_sql(20, "f20")}, fa as (select 10 as lookback, * from f10 union all select 20, * from f20), gr as (select * from (values (10), (20)) a(lookback), (values (10.0), (30.0)) b(shrinkage), (values (20), (60)) c(least_samples)),
x as (select gr.lookback, shrinkage, least_samples, date, n, abs_ic, sum(abs_ic * n) over w / sum(n) over w as g from fa join gr on gr.lookback = fa.lookback window w as (partition by gr.lookback, shrinkage, least_samples, date)), y as (select *, greatest((n * abs_ic + shrinkage * g) / (n + shrinkage), 0) as s from x),
d as (select lookback, shrinkage, least_samples, date, sum(n) as total, count(*) filter (n >= least_samples) as eligible, max(g) as g, max(s) as top from y group by all), o as (select lookback, shrinkage, least_samples, count(*) filter (ok) as fit_days, coalesce(avg(case when ok then g end), 0) as g, coalesce(avg(case when ok then top end), 0) as top from (select *, total >= least_samples and eligible > 0 and top > 0 as ok from d) t group by all)
select cast(lookback as bigint) as lookback, cast(shrinkage as double) as shrinkage, cast(least_samples as bigint) as least_samples, fit_days, round(g, 7) as global_score_mean, round(top, 7) as top_score_mean, round(fit_days / (select count(*) from ev), 7) as fit_rate, row_number() over (order by fit_days desc, round(g, 9) desc, round(top, 9) desc, shrinkage, least_samples, lookback) as rank from o""", "daily_bars", "mapped")
def learned_parameter_sweep(spark, sf_dir):
    """Look-back x shrinkage x least samples, all settings in one job, ranked."""
    combos = learned.combo_rows(view(spark, sf_dir, "mapped"))
    fits = None
    for n in (10, 20):
        one = learned.trailing_fits(combos, _returns(spark, sf_dir), n).withColumn("lookback", F.lit(n))
        fits = one if fits is None else fits.unionByName(one)
    grid = spark.createDataFrame([(n, s, m) for n in (10, 20) for s in (10.0, 30.0) for m in (20, 60)], "lookback int, shrinkage double, least_samples int")
    return rounded(learned.parameter_sweep(fits, combos, grid), 7)


def _sweep_sql(grid: str, out: str) -> str:
    return f"""{out}x as (select gr.lookback, shrinkage, least_samples, date, n, abs_ic, sum(abs_ic * n) over w / sum(n) over w as g from fa join {grid} gr on gr.lookback = fa.lookback window w as (partition by gr.lookback, shrinkage, least_samples, date)), {out}y as (select *, greatest((n * abs_ic + shrinkage * g) / (n + shrinkage), 0) as s from {out}x),
{out}d as (select lookback, shrinkage, least_samples, date, sum(n) as total, count(*) filter (n >= least_samples) as eligible, max(g) as g, max(s) as top from {out}y group by all), {out}o as (select lookback, shrinkage, least_samples, count(*) filter (ok) as fit_days, coalesce(avg(case when ok then g end), 0) as g, coalesce(avg(case when ok then top end), 0) as top from (select *, total >= least_samples and eligible > 0 and top > 0 as ok from {out}d) t group by all),
{out} as materialized (select *, fit_days / (select count(*) from ev) as fit_rate, row_number() over (order by fit_days desc, round(g, 9) desc, round(top, 9) desc, shrinkage, least_samples, lookback) as rank from {out}o)"""


STAGED_SQL = f"""with {COMBOS}, {fits_sql(10, "f10")}, {fits_sql(20, "f20")}, fa as materialized (select 10 as lookback, * from f10 union all select 20, * from f20), g1 as (select * from (values (10), (20)) a(lookback), (values (10.0::double), (30.0::double)) b(shrinkage), (values (20), (60)) c(least_samples)), {_sweep_sql("g1", "s1")},
g2 as (select distinct lookback, shrinkage * f as shrinkage, cast(ceil(least_samples * h) as bigint) as least_samples from s1, (values (0.5::double), (1.0::double), (2.0::double)) a(f), (values (0.5::double), (1.0::double)) b(h) where rank <= 2), {_sweep_sql("g2", "s2")}, rs as (select 1 as stage, * from s1 union all select 2, * from s2)"""


def staged(spark, sf_dir):
    combos = learned.combo_rows(view(spark, sf_dir, "mapped"))
    fits = None
    for n in (10, 20):
        one = learned.trailing_fits(combos, _returns(spark, sf_dir), n).withColumn("lookback", F.lit(n))
        fits = one if fits is None else fits.unionByName(one)
    grid = spark.createDataFrame([(n, s, m) for n in (10, 20) for s in (10.0, 30.0) for m in (20, 60)], "lookback int, shrinkage double, least_samples int")
    fits = kept(spark, sf_dir, "fits by look-back", lambda: fits)
    return kept(spark, sf_dir, "staged sweep", lambda: learned.staged_sweep(fits, combos, grid))


@query(STAGED_SQL + " select cast(stage as bigint) as stage, cast(lookback as bigint) as lookback, cast(shrinkage as double) as shrinkage, cast(least_samples as bigint) as least_samples, fit_days, round(g, 7) as global_score_mean, round(top, 7) as top_score_mean, round(fit_rate, 7) as fit_rate, rank from rs", "daily_bars", "mapped")
def learned_staged_sweep(spark, sf_dir):
    """A coarse grid, then a finer one about its two best settings."""
    return rounded(staged(spark, sf_dir), 7)


@query(STAGED_SQL + """, sm as (select stage, count(*) as settings, max(fit_rate) as fit_rate_best, min(fit_rate) as fit_rate_worst, median(fit_rate) as fit_rate_median, max(g) as gb, min(g) as gw, median(g) as gm, max(top) as tb, min(top) as tw, median(top) as tm, min_by(lookback, rank) as lookback, min_by(shrinkage, rank) as shrinkage, min_by(least_samples, rank) as least_samples from rs group by stage)
select cast(stage as bigint) as stage, settings, round(fit_rate_best, 7) as fit_rate_best, round(fit_rate_worst, 7) as fit_rate_worst, round(fit_rate_median, 7) as fit_rate_median, round(gb, 7) as global_score_mean_best, round(gw, 7) as global_score_mean_worst, round(gm, 7) as global_score_mean_median, round(tb, 7) as top_score_mean_best, round(tw, 7) as top_score_mean_worst, round(tm, 7) as top_score_mean_median, cast(lookback as bigint) as lookback, shrinkage, cast(least_samples as bigint) as least_samples, stage = 2 as preset from sm""", "daily_bars", "mapped")
def learned_stage_summary(spark, sf_dir):
    """What each stage found; the preset is the first rank of the last stage."""
    results = staged(spark, sf_dir)
    chosen = learned.preset(results).select("stage", "lookback", "shrinkage", "least_samples", F.lit(True).alias("preset"))
    out = learned.stage_summary(results).join(chosen, ["stage", "lookback", "shrinkage", "least_samples"], "left")
    return rounded(out.withColumn("preset", F.coalesce("preset", F.lit(False))), 7)
