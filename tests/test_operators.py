"""Known answers and edges of the panel operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelspark.functions import calendar as cal
from panelspark.functions.stats import ewm, normal_cdf
from panelspark.operators import asof, audit, drift, events, folds, ledger, metrics, news, overfit

D = dt.date


def days(n, start=D(2026, 1, 5)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(days=1)
    return out


def test_business_day_arithmetic(spark):
    row = spark.range(1).select(
        cal.bday_add(F.lit(D(2026, 1, 3)), 1).alias("sat_next"), cal.bday_add(F.lit(D(2026, 1, 3)), -1).alias("sat_prev"),
        cal.bday_distance(F.lit(D(2026, 1, 2)), F.lit(D(2026, 1, 5))).alias("gap"), cal.iso_week(F.lit(D(2026, 1, 1))).alias("week"),
    ).first()
    assert (row.sat_next, row.sat_prev, row.gap, row.week) == (D(2026, 1, 5), D(2026, 1, 2), 1, "2026-W01")


def test_ewm_equals_the_recurrence(spark):
    xs = [math.sin(i) * 10 for i in range(700)]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "k string, t int, x double")
    got = [r.y for r in ewm(df, "k", ["t"], "x", "y", 25 / 27).orderBy("t").collect()]
    want, y = [], xs[0]
    for i, x in enumerate(xs):
        y = x if i == 0 else y * 25 / 27 + x * 2 / 27
        want.append(y)
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-9


def test_normal_cdf(spark):
    row = spark.range(1).select(normal_cdf(F.lit(1.96)).alias("a"), normal_cdf(F.lit(-1.0)).alias("b")).first()
    assert row.a == pytest.approx(0.9750021, abs=1e-6) and row.b == pytest.approx(0.1586553, abs=1e-6)


def test_abnormal_return_known_answer(spark):
    d = days(5)
    rets = spark.createDataFrame([("A", x, r) for x, r in zip(d, [0.01, 0.02, 0.03, 0.04, 0.05], strict=True)], "ticker string, date date, ret double")
    bench = spark.createDataFrame([("S", x, r) for x, r in zip(d, [0.0, 0.01, 0.02, 0.01, 0.03], strict=True)], "sector string, date date, benchmark double")
    ev = spark.createDataFrame([("A", "S", D(2026, 1, 7))], "ticker string, sector string, effective_date date")
    row = events.abnormal_returns(ev, rets, bench, 2).first()
    assert (row.pre, row.post, row.total, row.n) == (pytest.approx(0.02), pytest.approx(0.05), pytest.approx(0.07), 4)
    assert row.t_stat == pytest.approx(3.6556307751)


def test_return_metrics_known_answers(spark):
    df = spark.createDataFrame([(1, 0.10, 0.10), (1, 0.20, 0.25), (1, 0.30, 0.20), (2, 0.10, 0.0), (2, 0.0, 0.0)], "g int, p double, a double")
    got = {r.g: r for r in metrics.return_metrics(df, ["g"], "p", "a").collect()}
    assert (got[1].mae, got[1].mape, got[1].rmse) == (pytest.approx(0.05), pytest.approx(0.2333333, abs=1e-6), pytest.approx(0.0645497, abs=1e-6))
    assert (got[2].mae, got[2].mape, got[2].rmse) == (pytest.approx(0.05), 0.0, pytest.approx(0.0707107, abs=1e-6))


def test_information_coefficients_and_constant_side(spark):
    df = spark.createDataFrame([(1, 0.01, 0.02), (1, 0.02, 0.04), (1, 0.03, 0.06), (2, 1.0, 0.1), (2, 1.0, 0.2)], "g int, p double, a double")
    got = {r.g: (r.ic, r.rank_ic) for r in metrics.information_coefficients(df, ["g"], "p", "a").collect()}
    assert got[1] == (pytest.approx(1.0), pytest.approx(1.0)) and got[2] == (0.0, 0.0)


def test_impact_known_answer(spark):
    t, p = ledger.market_impact(F.lit(1e6), F.lit(1e8), F.lit(0.02), 0.01)
    row = spark.range(1).select(t.alias("t"), p.alias("p")).first()
    assert (row.t, row.p) == (pytest.approx(28.4), pytest.approx(0.628))


def test_ledger_moves_from_queued_to_settled(spark):
    d = days(3)
    bars = spark.createDataFrame([("A", d[0], 99.0, 100.0), ("A", d[1], 101.0, 103.0), ("A", d[2], 102.0, 104.0)], "ticker string, date date, open double, close double")
    scores = spark.createDataFrame([("A", d[0], "UP"), ("A", d[1], "FLAT")], "ticker string, date date, direction string")
    book = ledger.queue_trades(scores, bars.select("ticker", "date", "close", F.lit(1e9).alias("adv_20d")), 1, 1000)
    assert {(r.status, r.skip_reason) for r in book.collect()} == {("QUEUED", None), ("SKIPPED", "flat_forecast")}
    book = ledger.execute_due(book, bars, F.lit(d[1]))
    assert {(r.status, r.execution_price) for r in book.collect()} == {("PENDING", 101.0), ("SKIPPED", None)}
    done = ledger.settle_due(book, bars, F.lit(d[2]), 0.005, 0).where("status = 'SETTLED'").first()
    assert done.asset_return == pytest.approx(104 / 101 - 1) and done.hit


def test_purged_splits_counts(spark):
    df = spark.createDataFrame([(x,) for x in days(120)], "date date")
    out = folds.purged_splits(folds.date_index(df), 6, 2, 0, 15).groupBy("split_id", "role").count().collect()
    test = {r.split_id: r["count"] for r in out if r.role == "test"}
    assert len(test) == 15 and set(test.values()) == {40}


def test_pbo_of_planted_scores(spark):
    rows = [(0, "a", 0.30, 0.9), (0, "b", 0.2, 0.5), (0, "c", 0.1, 0.1), (1, "a", 0.1, 0.9), (1, "b", 0.2, 0.5), (1, "c", 0.35, 0.1)]
    out = overfit.split_outcomes(spark.createDataFrame(rows, "split_id int, candidate string, in_score double, out_score double"))
    assert [(r.winner, r.overfit) for r in out.orderBy("split_id").collect()] == [("a", False), ("c", True)]
    row = overfit.pbo(out).first()
    assert (row.pbo, row.label) == (0.5, "high_overfit_risk")


def test_psi_small_and_large(spark):
    ref = [(-1 + 2 * i / 199) for i in range(200)]
    rows = [("near", "reference", x) for x in ref] + [("near", "current", x - 0.05) for x in ref] + [("far", "reference", x) for x in ref] + [("far", "current", x + 1.5) for x in ref]
    rows += [("flat", "reference", 1.0)] * 5 + [("flat", "current", 1.0)] * 5
    got = {r.feature: r.psi for r in drift.psi(spark.createDataFrame(rows, "feature string, part string, value double")).collect()}
    assert got["near"] < 0.1 and got["far"] > 0.25 and got["flat"] == pytest.approx(0.0)


def test_asof_takes_whole_rows_and_equal_times(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 3), (None, 2)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 7.0, "x"), ("a", 5, None, "y"), ("b", 4, 1.0, "z")], "k string, u int, v double, w string")
    got = {(r.k, r.t): (r.u, r.v, r.w) for r in asof.asof_join(left, right, "k", "t", "u").collect()}
    assert got == {("a", 1): (None, None, None), ("a", 5): (5, None, "y"), ("b", 3): (None, None, None), (None, 2): (None, None, None)}


def test_universe_on_the_day(spark):
    base = spark.createDataFrame([(t, D(2024, 1, 1)) for t in ("AAA", "BBB", "CCC")], "ticker string, base_date date")
    changes = spark.createDataFrame([(D(2024, 3, 1), ["DDD"], ["BBB"])], "date date, added array<string>, removed array<string>")
    grid = spark.createDataFrame([(t, d) for t in ("AAA", "BBB", "CCC", "DDD") for d in (D(2024, 2, 29), D(2024, 3, 1))], "ticker string, date date")
    got = {(r.ticker, r.date) for r in asof.constituents(grid, asof.membership_intervals(base, changes)).collect()}
    assert {t for t, d in got if d == D(2024, 2, 29)} == {"AAA", "BBB", "CCC"}
    assert {t for t, d in got if d == D(2024, 3, 1)} == {"AAA", "CCC", "DDD"}


def test_stale_flag(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 1, 11, 30),), (dt.datetime(2026, 1, 1, 8, 0),), (None,)], "fetched_at timestamp")
    assert [r.stale_data_flag for r in asof.flag_stale(df, "2026-01-01 12:00:00", 2).collect()] == [False, True, False]


def test_floor_weights_known_answer(spark):
    df = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 0.0), ("h", "a", 0.0), ("u", "a", 3.0), ("u", "b", 1.0)], "g string, k string, v double")
    got = {(r.g, r.k): r.weight for r in news.floor_weights(df, ["g"], "v", 0.25).collect()}
    assert got == {("g", "a"): 0.75, ("g", "b"): 0.25, ("h", "a"): None, ("u", "a"): 0.75, ("u", "b"): 0.25}


def test_cool_off_feeds_back(spark):
    d = [D(2026, 3, 20), D(2026, 3, 27), D(2026, 4, 10)]
    runs = spark.createDataFrame([("k", x, True) for x in d], "key string, date date, wanted boolean")
    assert [r.effective for r in audit.cool_off(runs, 10).orderBy("date").collect()] == [True, False, True]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "feature string, part string, value double")
    assert drift.psi(none).count() == 0
    assert asof.asof_join(spark.createDataFrame([], "k string, t int"), spark.createDataFrame([], "k string, u int, v int"), "k", "t", "u").count() == 0


def test_candidate_grid_is_one_partition(spark):
    from panelspark.operators import books

    grid = books.candidate_grid(spark, ["a", "b"], [0.1, 0.3], [1, 3])
    assert grid.rdd.getNumPartitions() == 1 and grid.dtypes == [("strategy", "string"), ("fraction", "double"), ("holding", "int"), ("candidate", "string")]
    assert {r.candidate for r in grid.collect()} == {f"{s}|{f}|{h}" for s in "ab" for f in (0.1, 0.3) for h in (1, 3)}


def test_bars_and_scores_are_one_pass_over_the_facts(spark):
    from panelspark.plans import fixtures

    sf = "/root/testdata/sf0.001"
    found = fixtures.scoped(lambda s, d: [fixtures.view(s, d, n) for n in ("daily_bars", "scores")])(spark, sf)
    days = [k[2] for k in fixtures._shared]
    assert [n for n in days if n not in ("px",)] == ["written days"]
    assert found[0].count() == found[1].count() > 0 and found[1].columns == ["ticker", "date", "prob_down", "prob_flat", "prob_up"]
