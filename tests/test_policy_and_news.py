"""Normalisation, policy, news utility and learned weights on small tables with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelspark.functions.letters import capitals
from panelspark.functions.stats import ewms, exact_quantiles
from panelspark.operators import audit, books, learned, news_utility, normalize, overfit, policy
from panelspark.sources import landed


def day(n):
    return dt.date(2026, 1, 5) + dt.timedelta(days=n)


def test_normalisation_keeps_the_first_of_its_own_key(spark):
    m = normalize.macro(spark.createDataFrame([("a", day(0), "1", day(2)), ("a", day(0), "2", day(1)), ("a", day(1), "x", day(1)), (None, day(0), "3", day(0))], "series_id string, date date, value string, available_at date")).collect()
    assert [(r.series_id, r.value, r.available_at, r.source) for r in m] == [("a", 2.0, day(1), "unknown")]
    rows = [("a", day(0), day(1), "0.5", "0.2", "1"), ("a", day(1), day(1), "0.7", "0.2", "1"), ("a", day(2), day(2), None, "0.2", "1"), ("a", day(3), day(3), "0.1", "0.2", None)]
    n = normalize.news(spark.createDataFrame(rows, "ticker string, published_at date, available_at date, sentiment_score string, relevance_score string, headline_count string")).collect()
    assert len(n) == 1 and n[0].sentiment_score_source_weighted == n[0].sentiment_score and n[0].session_bucket == "none" and n[0].source_session_breakdown == "{}" and n[0].fetched_at == day(1)
    f = spark.createDataFrame([("a", day(0), day(9), 1.0, 1.0, 1.0, 1.0), ("a", day(1), day(9), 1.0, 1.0, 1.0, 1.0), ("a", day(2), day(3), None, 1.0, 1.0, 1.0)], "ticker string, report_date date, available_at date, revenue_growth double, earnings_yield double, debt_to_equity double, profitability double")
    assert len(normalize.fundamentals(f).collect()) == 1
    s = normalize.sector_map(spark.createDataFrame([("a", "y"), ("a", "x"), ("b", None)], "ticker string, sector string")).collect()
    assert [(r.ticker, r.sector, r.stale_data_flag) for r in s] == [("a", "x", False)] and s[0].fetched_at is not None


def test_fallback_is_measured_against_the_preferred_source(spark):
    rows = landed.first_source(spark.createDataFrame([("a", 2), ("a", 3), ("b", 1)], "k string, priority int"), ["k"], "priority").collect()
    assert {(r.k, r.priority, r.fallback_used, r.attempts) for r in rows} == {("a", 2, True, 2), ("b", 1, False, 1)}


def test_exponential_means_over_blocks(spark):
    values = [float((7 * i) % 11) for i in range(300)]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "key string, n int, v double")
    got = ewms(df, "key", ["n"], [("v", "a", 0.9), ("v", "b", 0.8)], block=16).orderBy("n").collect()
    a = b = values[0]
    for r, v in zip(got, values, strict=True):
        if r.n:
            a, b = 0.9 * a + 0.1 * v, 0.8 * b + 0.2 * v
        assert r.a == pytest.approx(a) and r.b == pytest.approx(b)


def test_exact_quantiles_equal_numpy(spark):
    import numpy as np

    r = np.random.default_rng(2)
    groups = {"a": r.normal(size=997), "b": np.repeat([1.0, 2.0], 50), "c": np.array([5.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None)], "k string, v double")
    for row in exact_quantiles(df, "k", "v", [0.0, 0.01, 0.5, 0.9, 1.0], cells=8).collect():
        assert list(row.q) == pytest.approx(list(np.quantile(groups[row.k], [0.0, 0.01, 0.5, 0.9, 1.0])))


def test_transition_needs_runs_and_span(spark):
    rows = [("k", day(7 * i), "transition", 0.6, 0.05) for i in range(4)] + [("k", day(35), "low_vol", 0.9, 0.0)]
    out = {r.date: r for r in policy.transition_profile(spark.createDataFrame(rows, "key string, date date, regime string, state_probability double, transition_rate double")).collect()}
    assert [out[day(7 * i)].matches for i in range(4)] == [0, 1, 2, 3]
    assert [out[day(7 * i)].profile for i in range(4)] == ["watch_transition", "watch_transition", "stable_transition", "stable_transition"]
    assert out[day(35)].profile == "not_transition" and out[day(14)].span == 10


def test_cool_off_is_by_cause_and_regime_bucket(spark):
    rows = [("k", day(0), "low_vol", ["feature_drift"], ["a"]), ("k", day(7), "low_vol", ["feature_drift"], ["a"]), ("k", day(14), "high_vol", ["feature_drift"], ["a"]), ("k", day(21), "low_vol", ["pbo"], ["b"]), ("k", day(49), "low_vol", ["feature_drift"], ["a"]), ("k", day(50), "low_vol", ["regime_shift"], ["regime_shift:x"]), ("k", day(51), "low_vol", [], [])]
    df = spark.createDataFrame(rows, "key string, date date, regime string, triggers array<string>, causes array<string>").withColumn("state_probability", F.lit(0.9)).withColumn("transition_rate", F.lit(0.0))
    out = [(r.decision, r.should_retrain) for r in policy.decide(df).orderBy("date").collect()]
    assert out == [("trigger", True), ("suppressed_by_cooloff", False), ("trigger", True), ("trigger", True), ("trigger", True), ("watch_regime_shift_only", False), ("watch_only", False)]


def test_signal_metrics_without_and_with_active_rows(spark):
    rows = [("a", 1.0, True, 0.1, 1, 1), ("a", 2.0, True, 0.2, 3, 2), ("a", 9.0, False, 0.9, 9, 9), ("a", 3.0, True, None, 2, 2), ("b", 1.0, False, 0.1, 1, 1)]
    got = {r.k: r for r in news_utility.signal_metrics(spark.createDataFrame(rows, "k string, signal double, active boolean, ret double, source_diversity int, source_count int"), ["k"]).collect()}
    assert got["a"].signal_days == 3 and got["a"].coverage == 0.75 and got["a"].ic == pytest.approx(1) and got["a"].overlap_rate == pytest.approx(2 / 3) and got["a"].source_diversity_mean == 2
    assert (got["b"].signal_days, got["b"].coverage, got["b"].abs_ic, got["b"].overlap_rate) == (0, 0, 0, 0)


def test_weights_that_are_not_positive_count_as_one(spark):
    df = spark.createDataFrame([("x",), ("y",), ("z",)], "s string")
    assert [r.w for r in df.select(news_utility.lookup_weight(F.col("s"), {"x": 2.0, "y": -1.0}).alias("w")).collect()] == [2.0, 1.0, 1.0]


def test_unseen_combination_takes_the_global_score(spark):
    combos = spark.createDataFrame([("t", day(0), "s::a", "s", "a", 1.0, 0.5, 0.4), ("t", day(0), "s::b", "s", "b", 1.0, -0.5, 0.6)], "ticker string, date date, combo_key string, source_name string, session_bucket string, base_weight_sum double, sentiment_weighted_sum double, relevance_weighted_sum double")
    fits = spark.createDataFrame([(day(0), "s::a", 30.0, 0.3, 0.3)], "date date, combo_key string, n double, target_score double, shrunk_score double")
    days = spark.createDataFrame([(day(0), True, 0.1)], "date date, valid boolean, global_score double")
    w = learned.applied_weights(combos, fits, days, 0.05)
    assert {r.combo_key: round(r.weight, 6) for r in w.collect()} == {"s::a": 0.75, "s::b": 0.25}
    assert learned.learned_daily(w).first().sentiment_learned == pytest.approx(0.25)


def test_clusters_and_budget(spark):
    grid = spark.createDataFrame([("a", "s", 1), ("b", "s", 2), ("c", "s", 9)], "candidate string, strategy string, holding int")
    named = {r.candidate: r.cluster for r in overfit.named_clusters(grid, {"holding": 1.0}).collect()}
    assert named["a"] == named["b"] == "s|holding=1.00-2.00" and named["c"] == "s|holding=9.00"
    rows = books.turnover_budget(spark.createDataFrame([("a", 0, 0.5), ("a", 1, 2.0)], "candidate string, idx int, turnover double"), 1.0).orderBy("idx").collect()
    assert [(r.breach, r.scale) for r in rows] == [(False, 1.0), (True, 0.5)]


def test_risk_levels(spark):
    rows = [(1, 0.0, 0, 0, 0.5, False, False, "low_vol", 0.0, None), (2, 0.2, 0, 0, 0.5, False, False, "low_vol", 0.0, None), (3, 0.2, 0, 0, 0.8, False, False, "low_vol", 0.0, None), (4, 0.0, 1, 0, 0.5, False, False, "low_vol", 0.0, None), (5, 0.0, 1, 0, 0.5, False, False, "low_vol", 0.0, "null_random_walk")]
    df = spark.createDataFrame(rows, "run int, stale_ratio double, critical int, warning int, concentration double, retrain boolean, shift_flag boolean, regime string, max_drawdown double, dummy string")
    assert [(r.risk_level, r.approval) for r in audit.risk_review(df, 0.2).orderBy("run").collect()] == [("LOW", "AUTO_APPROVED"), ("MEDIUM", "MANUAL_REVIEW_REQUIRED"), ("HIGH", "MANUAL_REVIEW_REQUIRED"), ("CRITICAL", "BLOCKED"), ("MEDIUM", "MANUAL_REVIEW_REQUIRED")]


def test_relevance_equals_its_sql_on_odd_texts(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = ["Geß enüß es", "eßt von ſeſt", "ﬁes esﬁ ﬂ ᾳ ŉ ΐ", "x " * 511 + "es", "x " * 509 + "es es es", "", "12", "ESES es ẞ", None]
    rows = [(i, t, lang) for i, (t, lang) in enumerate((t, lang) for t in texts for lang in ("es", "ss", "fi", "ß", None))]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    got = {r.doc_id: r.relevance for r in entry.queries()["news_relevance"](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(entry.oracle_sql()["news_relevance"]).fetchall())


def test_capitals_equal_those_of_the_oracle(spark):
    duckdb = pytest.importorskip("duckdb")
    cased = [c for c in map(chr, (i for i in range(0x110000) if not 0xD800 <= i < 0xE000)) if c.upper() != c or c.lower() != c]
    got = [r.c for r in spark.createDataFrame([(i, c) for i, c in enumerate(cased)], "i int, x string").orderBy("i").select(capitals(F.col("x")).alias("c")).collect()]
    wrong = [(c, g, w) for c, g in zip(cased, got, strict=True) if g != (w := duckdb.execute("select upper(?)", [c]).fetchone()[0])]
    assert len(cased) > 2000 and all(c in "ƛɤ" for c, _, _ in wrong)  # their capitals came with Unicode 16, which the oracle does not know
