"""Queries over models fitted on every fold: forecasts, their metrics, calibration, trees, and books on their probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import books, calibration, features, folds, metrics, trees, walkforward
from panelspark.plans.book_queries import BOOK_SQL
from panelspark.plans.fixtures import with_views, written
from panelspark.plans.panel_queries import FEATURE_SQL, bars, price_panel, rounded

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str = "", *views: str):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *(views or ("daily_bars",)))
        return f

    return put


USED = ["log_return_5d", "realized_vol_20d", "volume_ratio_20d", "rsi_14"]
P = range(len(USED))
TARGETS = ["target_return", "future_volatility_20d"]
FOLDS = (500, 200, 200, 5)  # first training dates, evaluation dates, step, embargo

#: Complete rows, their dates, folds, and the sums of each fold's training rows taken directly from the rows.
ROWS_SQL = FEATURE_SQL + f""", la as (select *, lead(close) over w / close - 1 as fr, ln(close / lag(close) over w) as lr from daily_bars window w as (partition by ticker order by date)),
lv as (select ticker, date, fr, ln(1 + fr) as tr, case when fr <= -0.2 then 0 when fr <= 0.2 then 1 when fr is not null then 2 end as y, case when count(lr) over a = 20 then stddev_samp(lr) over a end * sqrt(252) as fv from la window a as (partition by ticker order by date rows between 1 following and 20 following)),
rw as (select s4.ticker, s4.date, {", ".join(f"{c} as f{j}" for j, c in enumerate(USED))}, fr, lv.tr, y, fv from s4 join lv on lv.ticker = s4.ticker and lv.date = s4.date where {" and ".join(f"{c} is not null" for c in USED)} and y is not null and lv.tr is not null and fv is not null),
dx as (select date, row_number() over (order by date) - 1 as idx from (select distinct date from rw) t),
fo as (select cast(k as bigint) as fold_id, 500 + k * 200 as cut from range(0, (select cast(floor((count(*) - 705) / 200.0) as bigint) + 1 from dx)) t(k)), ri as materialized (select rw.*, idx from rw join dx using (date)),
"""
_GAUSS = ", ".join(f"avg(f{j}) as mu{j}, case when var_pop(f{j}) > 1e-18 then stddev_pop(f{j}) else 1 end as sd{j}" for j in P)
_CLASS = ", ".join(f"coalesce(count(*) filter (y = {c}), 0) as n{c}, " + ", ".join(f"avg(f{j}) filter (y = {c}) as cm{c}_{j}, var_pop(f{j}) filter (y = {c}) as cv{c}_{j}" for j in P) for c in range(3))
_DENSE = ", ".join(f"ln(greatest(n{c} / n, 1e-9)) - 0.5 * (" + " + ".join(f"ln(2 * pi() * case when n{c} = 0 then 1 else greatest(cv{c}_{j} / (sd{j} * sd{j}), 1e-6) end) + pow((f{j} - mu{j}) / sd{j} - coalesce((cm{c}_{j} - mu{j}) / sd{j}, 0), 2) / case when n{c} = 0 then 1 else greatest(cv{c}_{j} / (sd{j} * sd{j}), 1e-6) end" for j in P) + f") as d{c}" for c in range(3))


def _eliminated(p: int, targets: int) -> list[str]:
    """Columns that solve (Z'Z + I) b = Z'y by Gauss-Jordan elimination: stage k of the tableau is made of stage k - 1."""
    stages = []
    width = p + targets
    name = lambda s, i, j: f"t{s}_{i}_{j}"
    for k in range(p):
        cols = [f"{name(k, k, j)} / {name(k, k, k)} as {name(k + 1, k, j)}" for j in range(width)]
        cols += [f"{name(k, i, j)} - {name(k, i, k)} * {name(k, k, j)} / {name(k, k, k)} as {name(k + 1, i, j)}" for i in range(p) if i != k for j in range(width)]
        stages.append(", ".join(cols))
    return stages


_T0 = ", ".join([f"regr_count(f{i}, f{j}) * covar_pop(f{i}, f{j}) / (any_value(sd{i}) * any_value(sd{j})) + {int(i == j)} as t0_{i}_{j}" for i in P for j in P] + [f"count(*) * covar_pop(f{i}, {y}) / any_value(sd{i}) as t0_{i}_{len(USED) + t}" for i in P for t, y in enumerate(("tr", "fv"))])
_STAGES = _eliminated(len(USED), 2)
MODEL_SQL = ROWS_SQL + f"""gm as materialized (select fold_id, count(*) as n, avg(tr) as b0, avg(fv) as b1, {_GAUSS}, {_CLASS} from ri join fo on idx < cut group by fold_id),
r0 as (select ri.fold_id, {_T0} from (select fold_id, ri.* from ri join fo on idx < cut) ri join gm on gm.fold_id = ri.fold_id group by ri.fold_id), {", ".join(f"r{k + 1} as (select fold_id, {s} from r{k})" for k, s in enumerate(_STAGES))},
rb as materialized (select fold_id, {", ".join(f"t{len(USED)}_{j}_{len(USED) + t} as b{t}_{j}" for t in range(2) for j in P)} from r{len(USED)}),
ev as (select fo.fold_id, ri.* from ri join fo on idx >= cut + 5 and idx < cut + 205), de as (select ev.*, n, n0, n1, n2, {_DENSE}, {", ".join(f"b{t} + " + " + ".join(f"(f{j} - mu{j}) / sd{j} * b{t}_{j}" for j in P) + f" as l{t}" for t in range(2))},
 {", ".join(f"(f{j} - mu{j}) / sd{j} * b0_{j} as c{j}" for j in P)} from ev join gm on gm.fold_id = ev.fold_id join rb on rb.fold_id = ev.fold_id),
ex as (select *, exp(d0 - greatest(d0, d1, d2)) as e0, exp(d1 - greatest(d0, d1, d2)) as e1, exp(d2 - greatest(d0, d1, d2)) as e2 from de),
fc as materialized (select fold_id, ticker, date, idx, fr, tr, fv, y, e0 / (e0 + e1 + e2) as prob_down, e1 / (e0 + e1 + e2) as prob_flat, e2 / (e0 + e1 + e2) as prob_up, l0 as expected_return, greatest(l1, 0) as predicted_volatility, n0 / n as prior_0, n1 / n as prior_1, n2 / n as prior_2, {", ".join(f"c{j}" for j in P)} from ex)
"""


def training_rows(spark, sf_dir):
    """Complete rows of features, label and targets."""
    lab = features.label_windows(bars(spark, sf_dir), 1, 0.2).select("ticker", "date", "future_simple_return", "direction_label", *TARGETS)
    rows = price_panel(spark, sf_dir).select("ticker", "date", *USED).join(lab, ["ticker", "date"])
    return written(spark, sf_dir, "training rows", lambda: features.training_frame(rows, [*USED, "direction_label", *TARGETS]))


def fitted(spark, sf_dir):
    return walkforward.fitted_folds(training_rows(spark, sf_dir), USED, "direction_label", TARGETS, *FOLDS)


def forecasts(spark, sf_dir):
    """All folds' forecasts on their own evaluation rows."""
    models, windows = fitted(spark, sf_dir)
    return written(spark, sf_dir, "forecasts", lambda: walkforward.scored(training_rows(spark, sf_dir), models, windows, USED))


@query(MODEL_SQL + " select fold_id, ticker, date, y as direction_label, round(prob_down, 6) as prob_down, round(prob_flat, 6) as prob_flat, round(prob_up, 6) as prob_up, round(expected_return, 6) + 0.0 as expected_return, round(predicted_volatility, 6) + 0.0 as predicted_volatility, case when greatest(prob_down, prob_flat, prob_up) > 0.5 then 'high' when greatest(prob_down, prob_flat, prob_up) > 0.4 then 'medium' else 'low' end as confidence from fc")
def forecast_walk_forward(spark, sf_dir):
    """Class probabilities, expected return and volatility of each fold's evaluation rows, fitted on its training rows alone."""
    return rounded(forecasts(spark, sf_dir).select("fold_id", "ticker", "date", "direction_label", *metrics.PROBS, "expected_return", "predicted_volatility", "confidence"))


@query(MODEL_SQL + " select gm.fold_id, n as training_rows, round(n0 / n, 6) as prior_0, round(n1 / n, 6) as prior_1, round(n2 / n, 6) as prior_2, " + ", ".join(f"round(b{t}_{j}, 6) + 0.0 as b_{t}_{j}" for t in range(2) for j in P) + ", round(b0, 6) + 0.0 as b_0, round(b1, 6) + 0.0 as b_1 from gm join rb on rb.fold_id = gm.fold_id")
def forecast_fold_models(spark, sf_dir):
    """The class shares of each fold's training rows, and the ridge coefficients of return and volatility."""
    models, _ = fitted(spark, sf_dir)
    return rounded(models.select("fold_id", F.col("n").alias("training_rows"), "prior_0", "prior_1", "prior_2", *[f"b_{t}_{j}" for t in range(2) for j in P], "b_0", "b_1"))


@query(MODEL_SQL + """, h as (select *, case when prob_down >= prob_flat and prob_down >= prob_up then 0 when prob_flat >= prob_up then 1 else 2 end as am, greatest(prob_down, prob_flat, prob_up) as conf from fc),
b as (select fold_id, least(floor(conf * 10), 9) as bin, count(*) as n, avg(conf) as c, avg((am = y)::int) as hr from h group by all), ec as (select fold_id, sum(n * abs(c - hr)) / sum(n) as ece from b group by fold_id)
select h.fold_id, count(*) as n, round(avg((am = y)::int), 6) as hit_rate, round(avg(-ln(greatest(case y when 0 then prob_down when 1 then prob_flat else prob_up end, 1e-9))), 6) as log_loss,
 round(avg(pow(prob_down - (y = 0)::int, 2) + pow(prob_flat - (y = 1)::int, 2) + pow(prob_up - (y = 2)::int, 2)), 6) as brier, round(abs(avg(conf) - avg((am = y)::int)), 6) as calibration_gap, round(any_value(ece), 6) as ece from h join ec on ec.fold_id = h.fold_id group by h.fold_id""")
def forecast_classification(spark, sf_dir):
    rows = forecasts(spark, sf_dir)
    return rounded(metrics.class_metrics(rows, ["fold_id"]).join(metrics.expected_calibration_error(rows, ["fold_id"]), "fold_id"))


@query(MODEL_SQL + """, d as (select fold_id, -ln(greatest(case y when 0 then prob_down when 1 then prob_flat else prob_up end, 1e-9)) + ln(greatest(case y when 0 then prior_0 when 1 then prior_1 else prior_2 end, 1e-9)) as d from fc)
select fold_id, round(avg(d), 6) + 0.0 as mean_differential, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) + 0.0 as dm_stat from d group by fold_id""")
def forecast_loss_against_prior(spark, sf_dir):
    """Log loss less that of the class shares of the fold's training rows, with the Diebold-Mariano statistic."""
    at = lambda *c: F.greatest(F.element_at(F.array(*c), F.col("direction_label") + 1), F.lit(1e-9))
    rows = forecasts(spark, sf_dir).withColumn("d", F.log(at("prior_0", "prior_1", "prior_2")) - F.log(at(*metrics.PROBS)))
    out = rows.groupBy("fold_id").agg(F.avg("d").alias("mean_differential")).join(metrics.diebold_mariano(rows, ["fold_id"], "d").select("fold_id", F.round("dm_stat", 4).alias("dm_stat")), "fold_id")
    return rounded(out)


@query(MODEL_SQL + """ select fold_id, round(avg(abs(expected_return - tr)), 6) as return_mae, round(sqrt(avg(pow(expected_return - tr, 2))), 6) as return_rmse, round(covar_pop(expected_return, fr) / (stddev_pop(expected_return) * stddev_pop(fr)), 6) + 0.0 as return_ic,
 round(avg(abs(predicted_volatility - fv)), 6) as volatility_mae, round(sqrt(avg(pow(predicted_volatility - fv, 2))), 6) as volatility_rmse, round(coalesce(avg(abs((predicted_volatility - fv) / nullif(fv, 0))), 0), 6) as volatility_mape from fc group by fold_id""")
def forecast_regression(spark, sf_dir):
    """Errors of the expected return against the target return, and of the predicted against the realised volatility."""
    rows = forecasts(spark, sf_dir)
    ret = metrics.return_metrics(rows, ["fold_id"], "expected_return", "target_return").select("fold_id", F.col("mae").alias("return_mae"), F.col("rmse").alias("return_rmse"))
    ic = metrics.information_coefficients(rows, ["fold_id"], "expected_return", "future_simple_return").select("fold_id", F.col("ic").alias("return_ic"))
    vol = metrics.return_metrics(rows, ["fold_id"], "predicted_volatility", "future_volatility_20d").select("fold_id", *[F.col(m).alias(f"volatility_{m}") for m in ("mae", "rmse", "mape")])
    return rounded(ret.join(ic, "fold_id").join(vol, "fold_id"))


@query(MODEL_SQL + ", lo as (" + " union all ".join(f"select fold_id, ticker, date, {j} as j, '{c}' as name, c{j} as value from fc" for j, c in enumerate(USED)) + """), tp as (select *, row_number() over (partition by fold_id, ticker, date order by abs(value) desc, name) as rn from lo)
select fold_id, name, count(*) as leads, round(avg(abs(value)), 6) as mean_size from tp where rn = 1 group by all""")
def forecast_top_contributions(spark, sf_dir):
    """How often each feature is the largest part of a row's expected return, and the mean size of that part."""
    top = forecasts(spark, sf_dir).select("fold_id", F.col("contributions")[0].alias("c"))
    return rounded(top.groupBy("fold_id", F.col("c.name").alias("name")).agg(F.count(F.lit(1)).alias("leads"), F.avg(F.abs("c.value")).alias("mean_size")))


FORECAST_BOOK_SQL = MODEL_SQL + ", scores as (select ticker, date, prob_down, prob_flat, prob_up from fc), " + BOOK_SQL


@query(FORECAST_BOOK_SQL + """ select candidate, count(*) as days, round(avg(net) * 252, 5) + 0.0 as annual_return, round(stddev_samp(net) * sqrt(252), 5) as annual_volatility, round(avg(turnover), 5) as mean_turnover, round(avg(exposure), 5) as mean_exposure from dy group by candidate""")
def forecast_book_performance(spark, sf_dir):
    """Books of every candidate rule over the forecasts of all folds."""
    rows = forecasts(spark, sf_dir).select("ticker", "date", *[F.round(c, 10).alias(c) for c in metrics.PROBS]).withColumn("signal", F.round(F.col("prob_up") - F.col("prob_down"), 8))
    days = folds.date_index(rows)
    rets = features.label_windows(bars(spark, sf_dir), 1, 0.2).select("ticker", "date", F.round("future_simple_return", 9).alias("ret"))
    grid = books.candidate_grid(spark, ["rank_long_short", "rank_long_only"], [0.1, 0.3], [1, 3])
    held = books.held_books(books.target_books(books.side_edges(rows, 0.0, 0.01), grid), days)
    out = books.performance(books.daily_results(held, rets, days, 10), 10)
    return rounded(out.select("candidate", "days", "annual_return", "annual_volatility", "mean_turnover", "mean_exposure"), 5)


TAIL = (0.2, 60)  # share of the training dates kept for calibration, and the least number
#: The models once more, fitted before each fold's tail, scored on the tail and on the evaluation rows.
_SOFT = lambda w: ", ".join(f"exp(z{k} - greatest(z0, z1, z2)) / (exp(z0 - greatest(z0, z1, z2)) + exp(z1 - greatest(z0, z1, z2)) + exp(z2 - greatest(z0, z1, z2))) as p{k}" for k in range(3))
_LOGIT = ", ".join(f"{{0}}.w{k}_0 + " + " + ".join(f"{{0}}.w{k}_{i} * x{i}" for i in range(1, 4)) + f" as z{k}" for k in range(3))
_CENTRED = ", ".join(f"ln(greatest(least(q{k}, 1 - 1e-6), 1e-6)) - (" + " + ".join(f"ln(greatest(least(q{m}, 1 - 1e-6), 1e-6))" for m in range(3)) + f") / 3 as x{k + 1}" for k in range(3))
_INVERSE = _eliminated(4, 4)
_GRAM = ", ".join([f"sum(x{i} * x{j}) / 2 + {int(i == j and i > 0)} as t0_{i}_{j}" for i in range(4) for j in range(4)] + [f"{int(i == j)} as t0_{i}_{4 + j}" for i in range(4) for j in range(4)])
_ROUND = ", ".join(f"any_value(w{k}_{i}) + " + " + ".join(f"any_value(t4_{i}_{4 + j}) * (sum(x{j} * ((y = {k})::int - p{k}))" + (f" - any_value(w{k}_{j})" if j else "") + ")" for j in range(4)) + f" as w{k}_{i}" for k in range(3) for i in range(4))
CALIBRATED_SQL = ROWS_SQL + f"""fq as (select fold_id, cut, case when cut > greatest(60, round_even(cut * 0.2, 0)) + 5 then cast(cut - greatest(60, round_even(cut * 0.2, 0)) as bigint) else cut end as fit_cut from fo),
gm as materialized (select fold_id, any_value(cut) as cut, any_value(fit_cut) as fit_cut, count(*) as n, {_GAUSS}, {_CLASS} from ri join fq on idx < fit_cut group by fold_id),
dt as (select gm.fold_id, ticker, date, y, idx >= cut as is_eval, {_DENSE} from ri join gm on (idx >= fit_cut and idx < cut) or (idx >= cut + 5 and idx < cut + 205)),
qt as (select *, exp(d0 - greatest(d0, d1, d2)) / (exp(d0 - greatest(d0, d1, d2)) + exp(d1 - greatest(d0, d1, d2)) + exp(d2 - greatest(d0, d1, d2))) as q0, exp(d1 - greatest(d0, d1, d2)) / (exp(d0 - greatest(d0, d1, d2)) + exp(d1 - greatest(d0, d1, d2)) + exp(d2 - greatest(d0, d1, d2))) as q1, exp(d2 - greatest(d0, d1, d2)) / (exp(d0 - greatest(d0, d1, d2)) + exp(d1 - greatest(d0, d1, d2)) + exp(d2 - greatest(d0, d1, d2))) as q2 from dt),
xt as materialized (select fold_id, ticker, date, y, is_eval, q0, q1, q2, 1.0::double as x0, {_CENTRED} from qt),
i0 as (select fold_id, {_GRAM} from xt where not is_eval group by fold_id having count(distinct y) = 3), {", ".join(f"i{k + 1} as (select fold_id, {c} from i{k})" for k, c in enumerate(_INVERSE))},
iv as materialized (select fold_id, {", ".join(f"t4_{i}_{4 + j}" for i in range(4) for j in range(4))} from i4), w0 as (select fold_id, {", ".join(f"0.0::double as w{k}_{i}" for k in range(3) for i in range(4))} from iv),
""" + ", ".join(f"w{r + 1} as materialized (select fold_id, {_ROUND} from (select *, {_SOFT('')} from (select xt.*, w{r}.* exclude (fold_id), iv.* exclude (fold_id), {_LOGIT.format(f'w{r}')} from xt join w{r} on w{r}.fold_id = xt.fold_id join iv on iv.fold_id = xt.fold_id where not is_eval) a) b group by fold_id)" for r in range(12)) + f""",
cf as (select fold_id, ticker, date, y, q0, q1, q2, {", ".join(f"case when f is null then q{k} else p{k} end as c{k}" for k in range(3))} from (select *, {_SOFT('')} from (select xt.*, w12.fold_id as f, {_LOGIT.format("w12")} from xt left join w12 on w12.fold_id = xt.fold_id where is_eval) a) b)
"""


def calibrated_forecasts(spark, sf_dir):
    """Evaluation rows with raw and calibrated probabilities; the model is fitted before the tail that calibrates it."""
    rows = training_rows(spark, sf_dir)
    first, size, step, embargo = FOLDS
    dates = folds.date_index(rows)
    cuts = calibration.tail_cuts(folds.walk_forward_cuts(dates, first, size, step, embargo), *TAIL)
    sums = walkforward.training_sums(rows, dates, cuts.select("fold_id", F.col("fit_cut").alias("cut")), USED, "direction_label", TARGETS)
    scales = walkforward.scales(sums, len(USED))
    models = walkforward.ridge_by_fold(walkforward.gaussian_by_fold(scales, len(USED)), len(USED), len(TARGETS))
    tail = cuts.where("fit_cut < cut").select("fold_id", F.explode(F.sequence("fit_cut", F.col("cut") - 1)).alias("idx")).join(dates, "idx").select("fold_id", "date")
    slim = rows.select("ticker", "date", "direction_label", *USED)
    before = written(spark, sf_dir, "tail", lambda: walkforward.scored(slim, models, tail, USED).select("fold_id", "direction_label", *metrics.PROBS))
    after = walkforward.scored(slim, models, walkforward.eval_dates(dates, cuts, size, embargo), USED).select("fold_id", "ticker", "date", "direction_label", *metrics.PROBS)
    return calibration.calibrated(after, calibration.fitted(before, "direction_label"))


_ECE = "select fold_id, sum(n * abs(c - hr)) / sum(n) as ece from (select fold_id, least(floor(conf * 10), 9) as bin, count(*) as n, avg(conf) as c, avg((am = y)::int) as hr from (select fold_id, y, greatest({0}0, {0}1, {0}2) as conf, case when {0}0 >= {0}1 and {0}0 >= {0}2 then 0 when {0}1 >= {0}2 then 1 else 2 end as am from cf) a group by all) b group by fold_id"


@query(CALIBRATED_SQL + f", er as ({_ECE.format('q')}), ec as ({_ECE.format('c')}), ll as (select fold_id, avg(-ln(greatest(case y when 0 then q0 when 1 then q1 else q2 end, 1e-9))) as raw_log_loss, avg(-ln(greatest(case y when 0 then c0 when 1 then c1 else c2 end, 1e-9))) as log_loss from cf group by fold_id)" + " select fold_id, round(er.ece, 5) as raw_ece, round(ec.ece, 5) as ece, round(raw_log_loss, 5) as raw_log_loss, round(log_loss, 5) as log_loss from er join ec using (fold_id) join ll using (fold_id)")
def forecast_calibration(spark, sf_dir):
    """Calibration error and log loss of the calibrated probabilities beside those of the raw ones."""
    rows = written(spark, sf_dir, "calibrated", lambda: calibrated_forecasts(spark, sf_dir))
    after = rows.select("fold_id", "direction_label", *[F.col(c).alias(p) for c, p in zip(("cal_down", "cal_flat", "cal_up"), metrics.PROBS, strict=True)])
    out = None
    for name, df in (("raw_", rows), ("", after)):
        one = metrics.expected_calibration_error(df, ["fold_id"]).withColumnRenamed("ece", f"{name}ece").join(metrics.class_metrics(df, ["fold_id"]).select("fold_id", F.col("log_loss").alias(f"{name}log_loss")), "fold_id")
        out = one if out is None else out.join(one, "fold_id")
    return rounded(out, 5)


BINS, TREE_ROUNDS, RATE, LEAST = 16, 2, 0.3, 20
_Y = ("y = 0", "y = 1", "y = 2")


def _tree_round(r: int) -> str:
    """The tables of one round: gradients g, root cuts c, node cuts d, leaves l and new scores s. Long rows: fold, model m, row."""
    prob = [f"exp(f{k} - greatest(f0, f1, f2)) / (exp(f0 - greatest(f0, f1, f2)) + exp(f1 - greatest(f0, f1, f2)) + exp(f2 - greatest(f0, f1, f2)))" for k in range(3)]
    pairs = [f"select *, {k} as m, ({_Y[k]})::int - ({prob[k]}) as g, ({prob[k]}) * (1 - ({prob[k]})) as h from ts{r} where train" for k in range(3)] + [f"select *, {3 + i} as m, {t} - f{3 + i} as g, 1.0 as h from ts{r} where train" for i, t in enumerate(("tr", "fv"))]

    def best(rows: str, by: str) -> str:
        left = f"select {by}, j, bin, sum(g) over w as gl, sum(h) over w as hl, sum(n) over w as nl, sum(g) over v as ga, sum(h) over v as ha, sum(n) over v as na from (select {by}, j, b[j + 1] as bin, sum(g) as g, sum(h) as h, count(*) as n from {rows}, range({len(USED)}) t(j) group by all) a window w as (partition by {by}, j order by bin), v as (partition by {by}, j)"
        gain = f"select *, case when nl >= {LEAST} and na - nl >= {LEAST} then gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1) else -1 end as gain from ({left}) b"
        return f"select {by}, case when gain > 1e-9 then j else 0 end as j, case when gain > 1e-9 then bin else {1 << 20} end as t, case when gain > 1e-9 then gl / (hl + 1) else ga / (ha + 1) end as low, case when gain > 1e-9 then (ga - gl) / (ha - hl + 1) else 0 end as high from ({gain}) c qualify row_number() over (partition by {by} order by gain desc, j, bin) = 1"

    add = ", ".join(f"max(f{m}) + {RATE} * max(case when l.m = {m} then case when s.b[l.j + 1] <= l.t then l.low else l.high end end) as f{m}" for m in range(5))
    return f"""g{r} as materialized ({" union all ".join(pairs)}), c{r} as materialized ({best(f"g{r}", "fold_id, m")}), n{r} as materialized (select g{r}.*, case when b[c{r}.j + 1] <= c{r}.t then 0 else 1 end as side from g{r} join c{r} on c{r}.fold_id = g{r}.fold_id and c{r}.m = g{r}.m),
d{r} as materialized ({best(f"n{r}", "fold_id, m, side")}), ts{r + 1} as materialized (select s.fold_id, ticker, date, any_value(y) as y, any_value(tr) as tr, any_value(fv) as fv, any_value(fr) as fr, any_value(train) as train, any_value(b) as b, {add}
 from ts{r} s join c{r} c on c.fold_id = s.fold_id join d{r} l on l.fold_id = s.fold_id and l.m = c.m and l.side = case when s.b[c.j + 1] <= c.t then 0 else 1 end group by s.fold_id, ticker, date)"""


_EDGES = ", ".join(f"list_distinct(quantile_cont(f{j}, [{', '.join(str(i / BINS) for i in range(1, BINS))}])) as e{j}" for j in P)
TREE_SQL = ROWS_SQL + f"""eg as materialized (select {_EDGES} from ri where idx < 500), bn as materialized (select ri.*, [{", ".join(f"len(list_filter(e{j}, lambda v: v <= f{j}))" for j in P)}] as b from ri, eg),
t0 as materialized (select fold_id, bn.*, idx < cut as train from bn join fo on idx < cut or (idx >= cut + 5 and idx < cut + 205)), z0 as (select fold_id, {", ".join(f"ln(greatest(avg(({_Y[k]})::int), 1e-9)) as f{k}" for k in range(3))}, avg(tr) as f3, avg(fv) as f4 from t0 where train group by fold_id),
ts0 as materialized (select t0.fold_id, ticker, date, y, tr, fv, fr, train, b, z0.f0, z0.f1, z0.f2, z0.f3, z0.f4 from t0 join z0 on z0.fold_id = t0.fold_id), {", ".join(_tree_round(r) for r in range(TREE_ROUNDS))}
"""


def tree_rows(spark, sf_dir):
    """(binned rows with their fold and part, as many times as folds use them)."""
    rows = training_rows(spark, sf_dir)
    first, size, step, embargo = FOLDS
    dates = folds.date_index(rows)
    windows = folds.walk_forward(dates, first, size, step, embargo)
    early = rows.join(dates.where(F.col("idx") < first).select("date"), "date")
    slim = trees.binned(rows, trees.bin_edges(early, USED, BINS)).select("ticker", "date", "direction_label", *TARGETS, "future_simple_return", "bins")
    return written(spark, sf_dir, "tree rows", lambda: slim.join(windows, "date"))


def fitted_trees(spark, sf_dir):
    rows = tree_rows(spark, sf_dir)
    return trees.FoldTrees(TREE_ROUNDS, RATE, LEAST).fit(rows.where("role = 'train'"), len(USED), "direction_label", TARGETS)


@query(TREE_SQL + """, ev as (select *, exp(f0 - greatest(f0, f1, f2)) / (exp(f0 - greatest(f0, f1, f2)) + exp(f1 - greatest(f0, f1, f2)) + exp(f2 - greatest(f0, f1, f2))) as q0, exp(f1 - greatest(f0, f1, f2)) / (exp(f0 - greatest(f0, f1, f2)) + exp(f1 - greatest(f0, f1, f2)) + exp(f2 - greatest(f0, f1, f2))) as q1,
 exp(f2 - greatest(f0, f1, f2)) / (exp(f0 - greatest(f0, f1, f2)) + exp(f1 - greatest(f0, f1, f2)) + exp(f2 - greatest(f0, f1, f2))) as q2 from ts2 where not train)
select fold_id, count(*) as n, round(avg(((case when q0 >= q1 and q0 >= q2 then 0 when q1 >= q2 then 1 else 2 end) = y)::int), 6) as hit_rate, round(avg(-ln(greatest(case y when 0 then q0 when 1 then q1 else q2 end, 1e-9))), 6) as log_loss, round(sqrt(avg(pow(f3 - tr, 2))), 6) as return_rmse, round(sqrt(avg(pow(greatest(f4, 0) - fv, 2))), 6) as volatility_rmse from ev group by fold_id""")
def forecast_trees(spark, sf_dir):
    """Metrics of the boosted trees on each fold's evaluation rows."""
    rows = fitted_trees(spark, sf_dir).predict(tree_rows(spark, sf_dir).where("role = 'eval'").drop("role"))
    rows = written(spark, sf_dir, "tree forecasts", lambda: rows)
    out = metrics.class_metrics(rows, ["fold_id"]).select("fold_id", "n", "hit_rate", "log_loss")
    for name, predicted, actual in (("return_rmse", "expected_return", "target_return"), ("volatility_rmse", "predicted_volatility", "future_volatility_20d")):
        out = out.join(metrics.return_metrics(rows, ["fold_id"], predicted, actual).select("fold_id", F.col("rmse").alias(name)), "fold_id")
    return rounded(out)


@query(TREE_SQL + " " + " union all ".join(f"select c.fold_id, {r} as round, cast(c.m as bigint) as model, cast(c.j as bigint) as root_feature, cast(c.t as bigint) as root_bin, cast(a.j as bigint) as left_feature, cast(a.t as bigint) as left_bin, cast(b.j as bigint) as right_feature, cast(b.t as bigint) as right_bin, round(a.low, 6) + 0.0 as leaf_0, round(a.high, 6) + 0.0 as leaf_1, round(b.low, 6) + 0.0 as leaf_2, round(b.high, 6) + 0.0 as leaf_3 from c{r} c join d{r} a on a.fold_id = c.fold_id and a.m = c.m and a.side = 0 left join d{r} b on b.fold_id = c.fold_id and b.m = c.m and b.side = 1" for r in range(TREE_ROUNDS)))
def forecast_tree_cuts(spark, sf_dir):
    """Every tree: the root's and the children's cuts, and the leaves."""
    fit = fitted_trees(spark, sf_dir)
    rows = [(f, r, m, *cuts, *leaves) for f, rounds in fit.trees.items() for r, models in enumerate(rounds) for m, (cuts, leaves) in enumerate(models)]
    names = ["fold_id", "round", "model", "root_feature", "root_bin", "left_feature", "left_bin", "right_feature", "right_bin"]
    return rounded(spark.createDataFrame(rows, ", ".join([f"{n} bigint" for n in names] + [f"leaf_{i} double" for i in range(4)])))
