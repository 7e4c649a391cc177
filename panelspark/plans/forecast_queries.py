"""Queries over forecasts: folds, metrics, drift, regimes, event studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import drift, events, features, folds, metrics, regime
from panelspark.plans.fixtures import kept, view, with_views
from panelspark.plans.panel_queries import FEATURE_SQL, bars, price_panel, rounded

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str = "", *views: str):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *views)
        return f

    return put


LABELLED = """lab as (select ticker, date, lead(close) over (partition by ticker order by date) / close - 1 as fr from daily_bars),
p as (select s.ticker, s.date, round(prob_down, 10) as prob_down, round(prob_flat, 10) as prob_flat, round(prob_up, 10) as prob_up, round(prob_up - prob_down, 8) as signal, round(fr, 9) as fr, case when fr <= -0.2 then 0 when fr <= 0.2 then 1 when fr is not null then 2 end as y from scores s join lab l on l.ticker = s.ticker and l.date = s.date),
di as (select date, row_number() over (order by date) - 1 as idx from (select distinct date from p) t),
f as (select cast(k as bigint) as fold_id, 500 + k * 200 as cut from range(0, (select cast(floor((count(*) - 500 - 5 - 200) / 200.0) as bigint) + 1 from di)) t(k)),
e as (select f.fold_id, p.* from p join di on di.date = p.date join f on idx >= cut + 5 and idx < cut + 205)"""


def labelled(spark, sf_dir):
    return kept(spark, sf_dir, "labelled", lambda: _labelled(spark, sf_dir))


def _labelled(spark, sf_dir):
    lab = features.label_windows(bars(spark, sf_dir), 1, 0.2).select("ticker", "date", "future_simple_return", "direction_label")
    out = view(spark, sf_dir, "scores").join(lab, ["ticker", "date"]).withColumn("signal", F.round(F.col("prob_up") - F.col("prob_down"), 8))
    out = out.withColumn("future_simple_return", F.round("future_simple_return", 9))
    return out.withColumns({c: F.round(c, 10) for c in metrics.PROBS})  # ties are then the same on every engine


def evaluated(spark, sf_dir):
    p = labelled(spark, sf_dir)
    days = folds.walk_forward(folds.date_index(p), 500, 200, 200, 5).where("role = 'eval'").select("fold_id", "date")
    return kept(spark, sf_dir, "evaluated", lambda: p.join(F.broadcast(days), "date"))  # as many rows as evaluation dates


@query("with " + LABELLED + ", r as (select f.fold_id, case when idx < cut then 'train' else 'eval' end as role, di.date from di join f on idx < cut or (idx >= cut + 5 and idx < cut + 205)) select fold_id, role, count(*) as days, min(date) as first_date, max(date) as last_date from r group by all", "daily_bars", "scores")
def folds_walk_forward(spark, sf_dir):
    out = folds.walk_forward(folds.date_index(labelled(spark, sf_dir)), 500, 200, 200, 5)
    return rounded(out.groupBy("fold_id", "role").agg(F.count(F.lit(1)).alias("days"), F.min("date").alias("first_date"), F.max("date").alias("last_date")))


@query("""with di as (select date, row_number() over (order by date) - 1 as idx from (select distinct date from daily_bars) t), g as (select *, ntile(6) over (order by idx) - 1 as grp from di),
c as (select row_number() over (order by a.g, b.g) - 1 as split_id, a.g as g1, b.g as g2 from range(6) a(g), range(6) b(g) where a.g < b.g), te as (select split_id, date, idx from g join c on grp in (g1, g2)),
tr as (select c.split_id, g.date from c, g where not exists (select 1 from te where te.split_id = c.split_id and te.idx between g.idx - 5 and g.idx + 5))
select split_id, 'test' as role, count(*) as days, min(date) as first_date, max(date) as last_date from te group by split_id union all select split_id, 'train', count(*), min(date), max(date) from tr group by split_id""", "daily_bars")
def folds_purged(spark, sf_dir):
    out = folds.purged_splits(folds.date_index(bars(spark, sf_dir)), 6, 2, 5, 15)
    return rounded(out.groupBy("split_id", "role").agg(F.count(F.lit(1)).alias("days"), F.min("date").alias("first_date"), F.max("date").alias("last_date")))


@query("with " + LABELLED + """, h as (select *, case when prob_down >= prob_flat and prob_down >= prob_up then 0 when prob_flat >= prob_up then 1 else 2 end as am, greatest(prob_down, prob_flat, prob_up) as conf from e where y is not null)
select fold_id, count(*) as n, round(avg(case when am = y then 1.0 else 0 end), 6) as hit_rate, round(avg(-ln(greatest(case y when 0 then prob_down when 1 then prob_flat else prob_up end, 1e-9))), 6) as log_loss,
 round(avg(pow(prob_down - (y = 0)::int, 2) + pow(prob_flat - (y = 1)::int, 2) + pow(prob_up - (y = 2)::int, 2)), 6) as brier, round(abs(avg(conf) - avg(case when am = y then 1.0 else 0 end)), 6) as calibration_gap from h group by fold_id""", "daily_bars", "scores")
def metrics_classification(spark, sf_dir):
    return rounded(metrics.class_metrics(evaluated(spark, sf_dir), ["fold_id"]))


@query("with " + LABELLED + """, h as (select *, case when prob_down >= prob_flat and prob_down >= prob_up then 0 when prob_flat >= prob_up then 1 else 2 end as am, greatest(prob_down, prob_flat, prob_up) as conf from e where y is not null),
b as (select fold_id, least(floor(conf * 10), 9) as bin, count(*) as n, avg(conf) as c, avg(case when am = y then 1.0 else 0 end) as hr from h group by all) select fold_id, round(sum(n * abs(c - hr)) / sum(n), 6) as ece from b group by fold_id""", "daily_bars", "scores")
def metrics_calibration_error(spark, sf_dir):
    return rounded(metrics.expected_calibration_error(evaluated(spark, sf_dir), ["fold_id"]))


@query("with " + LABELLED + """, k as (select *, rank() over (partition by fold_id order by signal) + (count(*) over (partition by fold_id, signal) - 1) / 2.0 as rx, rank() over (partition by fold_id order by fr) + (count(*) over (partition by fold_id, fr) - 1) / 2.0 as ry from e where fr is not null)
select fold_id, round(covar_pop(signal, fr) / nullif(sqrt(var_pop(signal)) * sqrt(var_pop(fr)), 0), 6) as ic, round(covar_pop(rx, ry) / nullif(sqrt(var_pop(rx)) * sqrt(var_pop(ry)), 0), 6) as rank_ic from k group by fold_id""", "daily_bars", "scores")
def metrics_information_coefficients(spark, sf_dir):
    return rounded(metrics.information_coefficients(evaluated(spark, sf_dir), ["fold_id"], "signal", "future_simple_return"))


@query("with " + LABELLED + " select fold_id, round(avg(abs(signal - fr)), 6) as mae, round(sqrt(avg(pow(signal - fr, 2))), 6) as rmse, round(coalesce(avg(abs((signal - fr) / nullif(fr, 0))), 0), 6) as mape from e where fr is not null group by fold_id", "daily_bars", "scores")
def metrics_returns(spark, sf_dir):
    return rounded(metrics.return_metrics(evaluated(spark, sf_dir), ["fold_id"], "signal", "future_simple_return"))


@query("with " + LABELLED + """, q as (select fold_id, avg((y = 0)::int) as p0, avg((y = 1)::int) as p1, avg((y = 2)::int) as p2 from p join di on di.date = p.date join f on idx < cut where y is not null group by fold_id), d as (select e.fold_id, -ln(greatest(case y when 0 then prob_down when 1 then prob_flat else prob_up end, 1e-9)) + ln(case y when 0 then p0 when 1 then p1 else p2 end) as d from e join q on q.fold_id = e.fold_id where y is not null)
, s as (select fold_id, avg(d) / (stddev_samp(d) / sqrt(count(*))) as dm from d group by fold_id), z as (select *, abs(dm) / sqrt(2.0::double) as x, 1 / (1 + 0.3275911::double * abs(dm) / sqrt(2.0::double)) as t from s)
select fold_id, round(dm, 5) as dm_stat, round(t * (0.254829592::double + t * (-0.284496736::double + t * (1.421413741::double + t * (-1.453152027::double + t * 1.061405429::double)))) * exp(-x * x), 7) as p_value from z""", "daily_bars", "scores")
def metrics_loss_against_prior(spark, sf_dir):
    """Diebold-Mariano statistic of the log loss against that of the class shares of each fold's training rows."""
    e = evaluated(spark, sf_dir).where("direction_label is not null")
    rows = labelled(spark, sf_dir).where("direction_label is not null")
    prior = metrics.training_priors(rows, folds.date_index(labelled(spark, sf_dir)), folds.walk_forward_cuts(folds.date_index(labelled(spark, sf_dir)), 500, 200, 200, 5))
    e = e.join(prior, "fold_id")
    p, q = F.array(*metrics.PROBS), F.array("prior_0", "prior_1", "prior_2")
    e = e.withColumn("d", -F.log(F.greatest(F.element_at(p, F.col("direction_label") + 1), F.lit(1e-9))) + F.log(F.element_at(q, F.col("direction_label") + 1)))
    out = metrics.diebold_mariano(e, ["fold_id"], "d")
    return rounded(rounded(out.select("fold_id", "dm_stat"), 5).join(rounded(out.select("fold_id", "p_value"), 7), "fold_id"), 7)


@query("with " + LABELLED + """, k as (select fold_id, avg(case when (case when prob_down >= prob_flat and prob_down >= prob_up then 0 when prob_flat >= prob_up then 1 else 2 end) = y then 1.0 else 0 end) as hit_rate from e where y is not null group by fold_id)
select round(avg(hit_rate), 6) as hit_rate_mean, round(stddev_pop(hit_rate), 6) as hit_rate_std, count(*) filter (hit_rate < 0.4) as breaches, round(avg((hit_rate < 0.4)::int), 6) as breach_ratio from k""", "daily_bars", "scores")
def metrics_fold_summary(spark, sf_dir):
    return rounded(metrics.fold_summary(metrics.class_metrics(evaluated(spark, sf_dir), ["fold_id"]), ["hit_rate"], ("hit_rate", 0.4)))


DRIFTED = ["log_return_5d", "realized_vol_20d", "volume_ratio_20d", "rsi_14"]
FAMILY = {"log_return_5d": "price", "realized_vol_20d": "volatility", "volume_ratio_20d": "volume", "rsi_14": "price"}
DRIFT_SQL = FEATURE_SQL + """, di as (select date, row_number() over (order by date) - 1 as idx, count(*) over () as n from (select distinct date from s4) t),
w as (select date, case when idx >= n - 250 then 'current' else 'reference' end as part from di where idx >= n - 500), lg as (unpivot (select s4.date, part, log_return_5d, realized_vol_20d, volume_ratio_20d, rsi_14 from s4 join w on w.date = s4.date) on log_return_5d, realized_vol_20d, volume_ratio_20d, rsi_14 into name feature value value),
"""
PSI_SQL = """ed as (select feature, list_sort(list_distinct(quantile_cont(value, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) as e from {0} where part = 'reference' group by feature),
bn as (select feature, part, len(list_filter(e[2:len(e)-1], lambda x: x <= value)) as bin, len(e) - 1 as nb from {0} join ed using (feature)), ct as (select feature, bin, nb, count(*) filter (part = 'reference') as r, count(*) filter (part = 'current') as c from bn group by all),
tt as (select feature, sum(r) as tr, sum(c) as tc, max(nb) as nb from ct group by feature), gr as (select feature, unnest(range(0, nb)) as bin, tr, tc from tt),
sh as (select gr.feature, greatest(coalesce(r, 0) / tr, 1e-6) as r, greatest(coalesce(c, 0) / tc, 1e-6) as c from gr left join ct on ct.feature = gr.feature and ct.bin = gr.bin)
"""


def drifted(spark, sf_dir):
    df = price_panel(spark, sf_dir).select("date", *DRIFTED)
    parts = folds.recent_windows(folds.date_index(bars(spark, sf_dir)), 250)
    return kept(spark, sf_dir, "drifted", lambda: drift.to_long(df.join(F.broadcast(parts), "date"), DRIFTED, ["date", "part"]))  # 500 dates


@query(DRIFT_SQL + PSI_SQL.format("lg") + " select feature, round(sum((c - r) * ln(c / r)), 6) as psi from sh group by feature", "daily_bars")
def drift_psi(spark, sf_dir):
    return rounded(drift.psi(drifted(spark, sf_dir)))


@query(DRIFT_SQL + """m as (select feature, avg(value) filter (part = 'reference') as mr, stddev_pop(value) filter (part = 'reference') as sr, avg(value) filter (part = 'current') as mc from lg group by feature)
select feature, round(abs(mc - mr) / sr, 6) as mean_shift, false as infinite_shift from m""", "daily_bars")
def drift_mean_shift(spark, sf_dir):
    return rounded(drift.mean_shift(drifted(spark, sf_dir)))


@query(DRIFT_SQL + PSI_SQL.format("lg") + """, ps as (select feature, sum((c - r) * ln(c / r)) as psi from sh group by feature), st as (select *, case when feature = 'realized_vol_20d' then 'volatility' when feature = 'volume_ratio_20d' then 'volume' else 'price' end as family, case when psi >= 0.01 then 'FAIL' when psi >= 0.004 then 'WARNING' else 'PASS' end as status from ps)
select family, count(*) as n, round(max(psi), 6) as max_psi, round(avg(psi), 6) as mean_psi, coalesce(string_agg(feature, '|' order by feature) filter (status <> 'PASS'), '') as flagged from st group by family""", "daily_bars")
def drift_family_summary(spark, sf_dir):
    families = spark.createDataFrame(list(FAMILY.items()), "feature string, family string")
    return rounded(drift.family_summary(drift.drift_report(drifted(spark, sf_dir), families, 0.004, 0.01)))


OBS_SQL = FEATURE_SQL + ", ob as (select date, avg(log_return_1d) as mean_return, quantile_cont(realized_vol_20d, 0.5) as median_vol, quantile_cont(gk_vol, 0.5) as median_level, quantile_cont(rsi_14, 0.5) as median_change from s4 group by date)"


def observations(spark, sf_dir):
    return regime.market_observations(price_panel(spark, sf_dir), "log_return_1d", "realized_vol_20d", "gk_vol", "rsi_14")


@query(OBS_SQL + " select date, round(mean_return, 6) + 0.0 as mean_return, round(median_vol, 6) as median_vol, round(median_level, 6) as median_level, round(median_change, 6) as median_change from ob", "daily_bars")
def regime_observations(spark, sf_dir):
    return rounded(observations(spark, sf_dir))


@query(OBS_SQL + """, s as (select *, case when median_level < 8 then 'low_vol' when median_level < 12 then 'transition' when median_level is not null then 'high_vol' else 'unknown' end as state from ob),
t as (select *, lag(state) over (order by date) as previous from s), u as (select *, case when previous is not null then (state <> previous)::int end as ch from t)
, v as (select *, row_number() over (order by date) as rn from u), pr as (select a.date, b.state as st, count(*) as c from v a join v b on b.rn >= a.rn - 20 and b.rn < a.rn group by all), dm as (select date, st as dominant_recent from (select *, row_number() over (partition by date order by c desc, st) as k from pr) t where k = 1)
select v.date, v.state, v.previous, round(coalesce(avg(ch) over (order by v.date rows between 20 preceding and 1 preceding), 0), 6) as transition_rate, dominant_recent, coalesce(dominant_recent <> v.state, false) as shifted from v left join dm on dm.date = v.date""", "daily_bars")
def regime_transitions(spark, sf_dir):
    days = observations(spark, sf_dir).withColumn("state", regime.threshold_state(F.col("median_level"), 8, 12))
    return rounded(regime.transitions(days).select("date", "state", "previous", "transition_rate", "dominant_recent", "shifted"))


@query(OBS_SQL + """, s as (select *, case when median_level < 8 then 'low_vol' when median_level < 12 then 'transition' when median_level is not null then 'high_vol' else 'unknown' end as state from ob),
st as (select state, count(*) as days, avg(mean_return) as mr, avg(median_vol) as mv, avg(median_level) as ml from s group by state)
select state, days, round(mr, 6) + 0.0 as mean_return, round(mv, 6) as mean_vol, round(ml, 6) as mean_level, case when row_number() over (order by mv nulls first, ml nulls first, state) = 1 then 'low_vol' when row_number() over (order by mv nulls first, ml nulls first, state) = count(*) over () then 'high_vol' else 'transition' end as regime from st""", "daily_bars")
def regime_statistics(spark, sf_dir):
    days = observations(spark, sf_dir).withColumn("state", regime.threshold_state(F.col("median_level"), 8, 12))
    return rounded(regime.named_states(regime.state_statistics(days)))


MIXED = ["mean_return", "median_vol", "median_level"]
_M = range(len(MIXED))
_START = ", ".join(f"(t = {c})::int::double as r{c}" for c in range(3))
_SUMS = "count(*) as n, " + ", ".join(f"sum(r{c}) as n{c}, " + ", ".join(f"sum(r{c} * x{j}) / sum(r{c}) as u{c}_{j}, greatest(sum(r{c} * x{j} * x{j}) / sum(r{c}) - pow(sum(r{c} * x{j}) / sum(r{c}), 2), 1e-3) as v{c}_{j}" for j in _M) for c in range(3))
_DENSITY = ", ".join(f"ln(greatest(n{c} / n, 1e-12)) - 0.5 * (" + " + ".join(f"ln(v{c}_{j}) + pow(x{j} - u{c}_{j}, 2) / v{c}_{j}" for j in _M) + f") as d{c}" for c in range(3))
MIXTURE_SQL = OBS_SQL + ", m0 as materialized (select date, " + ", ".join(f"({c} - avg({c}) over ()) / stddev_pop({c}) over () as x{j}" for j, c in enumerate(MIXED)) + ", median_vol, median_level, mean_return, ntile(3) over (order by median_vol, date) - 1 as t from ob where " + " and ".join(f"{c} is not null" for c in MIXED) + f"), e0 as materialized (select *, {_START} from m0)" + "".join(f", k{r} as materialized (select {_SUMS} from e{r}), e{r + 1} as materialized (select * exclude (d0, d1, d2), exp(d0 - greatest(d0, d1, d2)) / (exp(d0 - greatest(d0, d1, d2)) + exp(d1 - greatest(d0, d1, d2)) + exp(d2 - greatest(d0, d1, d2))) as r0, exp(d1 - greatest(d0, d1, d2)) / (exp(d0 - greatest(d0, d1, d2)) + exp(d1 - greatest(d0, d1, d2)) + exp(d2 - greatest(d0, d1, d2))) as r1, exp(d2 - greatest(d0, d1, d2)) / (exp(d0 - greatest(d0, d1, d2)) + exp(d1 - greatest(d0, d1, d2)) + exp(d2 - greatest(d0, d1, d2))) as r2 from (select m0.*, {_DENSITY} from m0, k{r}) t)" for r in range(15))


@query(MIXTURE_SQL + """, st as (select *, case when r0 >= r1 and r0 >= r2 then 0 when r1 >= r2 then 1 else 2 end as state, greatest(r0, r1, r2) as sh from e15),
ag as (select state, count(*) as days, avg(mean_return) as mr, avg(median_vol) as mv, avg(median_level) as ml, avg(sh) as ms from st group by state)
select cast(state as bigint) as state, days, round(mr, 6) + 0.0 as mean_return, round(mv, 6) as mean_vol, round(ml, 6) as mean_level, round(ms, 6) as mean_share, case when row_number() over (order by mv, ml, state) = 1 then 'low_vol' when row_number() over (order by mv, ml, state) = count(*) over () then 'high_vol' else 'transition' end as regime from ag""", "daily_bars")
def regime_mixture(spark, sf_dir):
    """The states of a Gaussian mixture over the daily observations, named by volatility and level."""
    days = regime.mixture_states(kept(spark, sf_dir, "observations", lambda: observations(spark, sf_dir)), MIXED, "median_vol")
    stats = regime.named_states(regime.state_statistics(days)).join(days.groupBy("state").agg(F.avg("share").alias("mean_share")), "state")
    return rounded(stats)


EVENT_SQL = """ev as (select distinct ticker, report_date, greatest(report_date, available_at) as eff from fundamentals), rt as (select ticker, date, close / lag(close) over (partition by ticker order by date) - 1 as ret from daily_bars),
rs as (select rt.*, sector from rt join sector_map using (ticker)), bm as (select sector, date, avg(ret) as bench from rs group by all), al as (select date, avg(ret) as bench from rs group by date),
cal as (select cast(g as date) as day, row_number() over (order by g) as k from generate_series(timestamp '1990-01-01', timestamp '2005-12-31', interval 1 day) t(g) where isodow(g) < 6),
o as (select ev.*, (select max(k) from cal where day <= eff) + case when isodow(eff) >= 6 then 1 else 0 end as k0 from ev),
g as (select o.ticker, o.report_date, o.eff, cal.day, cal.k - k0 as rel from o join cal on cal.k between k0 - 3 and k0 + 3 and cal.k <> k0),
x as (select g.*, rs.sector, rs.ret - al.bench as ab from g join rs on rs.ticker = g.ticker and rs.date = g.day join al on al.date = g.day where rs.ret is not null and al.bench is not null),
a as (select ticker, sector, eff as effective_date, coalesce(sum(ab) filter (rel < 0), 0) as pre, coalesce(sum(ab) filter (rel > 0), 0) as post, sum(ab) as total, case when count(*) < 2 or coalesce(stddev_samp(ab), 0) <= 1e-15 then 0 else avg(ab) / (stddev_samp(ab) / sqrt(count(*))) end as t_stat, count(*) as n from x group by all)"""


def event_effects(spark, sf_dir):
    ev = events.earnings_events(view(spark, sf_dir, "fundamentals")).drop("report_date", "lag_days")
    rets = events.simple_returns(bars(spark, sf_dir))
    sectors = view(spark, sf_dir, "sector_map")
    market = rets.groupBy("date").agg(F.avg("ret").alias("benchmark"))
    bench = market.crossJoin(sectors.select("sector").distinct())
    return events.abnormal_returns(ev.join(sectors, "ticker"), rets, bench, 3)


@query("with " + EVENT_SQL + " select ticker, sector, effective_date, round(pre, 6) + 0.0 as pre, round(post, 6) + 0.0 as post, round(total, 6) + 0.0 as total, round(t_stat, 5) + 0.0 as t_stat, n from a", "daily_bars", "fundamentals", "sector_map")
def event_abnormal_returns(spark, sf_dir):
    effects = event_effects(spark, sf_dir)
    return rounded(effects.drop("t_stat")).join(rounded(effects.select("ticker", "sector", "effective_date", "t_stat"), 5), ["ticker", "sector", "effective_date"])


@query("with " + EVENT_SQL + " select coalesce(sector, '__all__') as sector, count(*) as events, round(avg(pre), 6) + 0.0 as mean_pre, round(avg(post), 6) + 0.0 as mean_post, round(avg(total), 6) + 0.0 as mean_total, round(avg((abs(t_stat) >= 1.96)::int), 6) as significant_share from a group by grouping sets ((sector), ())", "daily_bars", "fundamentals", "sector_map")
def event_rollup(spark, sf_dir):
    return rounded(events.event_rollup(event_effects(spark, sf_dir)))


@query("select ticker, report_date, greatest(report_date, available_at) as effective_date, cast(greatest(report_date, available_at) - report_date as bigint) as lag_days from fundamentals", "fundamentals")
def event_dates(spark, sf_dir):
    return rounded(events.earnings_events(view(spark, sf_dir, "fundamentals")))


SECTOR_EVENT_SQL = EVENT_SQL.replace("x as (select g.*, rs.sector, rs.ret - al.bench as ab from g join rs on rs.ticker = g.ticker and rs.date = g.day join al on al.date = g.day where rs.ret is not null and al.bench is not null)", """bs as (select sector, date, bench from bm where not starts_with(sector, 'ECONOMY') union all select '__all__', date, bench from al),
x as (select g.ticker, g.report_date, g.eff, g.rel, case when starts_with(rs.sector, 'ECONOMY') then '__all__' else rs.sector end as sector, rs.ret - bs.bench as ab from g join rs on rs.ticker = g.ticker and rs.date = g.day join bs on bs.date = g.day and bs.sector = case when starts_with(rs.sector, 'ECONOMY') then '__all__' else rs.sector end where rs.ret is not null and bs.bench is not null)""")


@query("with " + SECTOR_EVENT_SQL + " select coalesce(sector, '__total__') as sector, count(*) as events, round(avg(pre), 6) + 0.0 as mean_pre, round(avg(post), 6) + 0.0 as mean_post, round(avg(total), 6) + 0.0 as mean_total, round(avg((abs(t_stat) >= 1.96)::int), 6) as significant_share from a group by grouping sets ((sector), ())", "daily_bars", "fundamentals", "sector_map")
def event_sector_effects(spark, sf_dir):
    """Returns around events less those of the event's own sector; sectors without a benchmark take the market's."""
    rets = kept(spark, sf_dir, "returns", lambda: events.simple_returns(bars(spark, sf_dir)))
    sectors = view(spark, sf_dir, "sector_map")
    own = rets.join(sectors, "ticker").where(~F.col("sector").startswith("ECONOMY")).select("sector", "date", "ret")
    bench = events.sector_returns(own.unionByName(rets.select(F.lit("__all__").alias("sector"), "date", "ret")))
    ev = events.earnings_events(view(spark, sf_dir, "fundamentals")).drop("report_date", "lag_days").join(sectors, "ticker")
    effects = events.abnormal_returns(events.with_sector_fallback(ev, bench), rets, bench, 3)
    return rounded(_total_named(events.event_rollup(effects)))


def _total_named(rollup):
    """The row over all events, the one with the most of them, is named apart from the fallback's."""
    most = rollup.agg(F.max("events").alias("__most"))
    x = rollup.crossJoin(F.broadcast(most))  # one row
    return x.withColumn("sector", F.when((F.col("sector") == "__all__") & (F.col("events") == F.col("__most")), "__total__").otherwise(F.col("sector"))).drop("__most")


@query(DRIFT_SQL + "qa as (select feature, quantile_cont(value, 0.01) as lo, quantile_cont(value, 0.99) as hi from lg where part = 'reference' group by feature), aj as (select lg.feature, part, greatest(lo, least(hi, value)) as value from lg join qa using (feature)), ra as (with " + PSI_SQL.format("lg") + " select feature, sum((c - r) * ln(c / r)) as psi from sh group by feature), ad as (with " + PSI_SQL.format("aj") + """ select feature, sum((c - r) * ln(c / r)) as psi from sh group by feature)
select count(*) as features, round(avg((ra.psi < 0.004)::int), 6) as stable_ratio, round(max(ra.psi), 6) as max_psi, round(avg(ra.psi), 6) as mean_psi, round(max(ad.psi), 6) as max_adjusted_psi, round(avg(ad.psi), 6) as mean_adjusted_psi, string_agg(feature, '|' order by ra.psi desc, feature) as by_psi from ra join ad using (feature)""", "daily_bars")
def drift_run_summary(spark, sf_dir):
    """The drift of a run in one row, as it is and winsorised."""
    families = spark.createDataFrame(list(FAMILY.items()), "feature string, family string")
    return rounded(drift.run_summary(drift.drift_report(drifted(spark, sf_dir), families, 0.004, 0.01)))
