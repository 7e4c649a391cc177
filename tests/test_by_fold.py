"""Models by fold against plain numpy, the replay's feedback, ranks in cells, landed unions and flat documents on literal rows."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import audit, calibration, folds, metrics, policy, trees, walkforward
from panelspark.plans import fixtures
from panelspark.sources import landed


@pytest.fixture(scope="module")
def panel():
    g = np.random.default_rng(3)
    day = dt.date(2026, 1, 1)
    rows = []
    for d in range(30):
        for t in range(12):
            a, b = g.normal(), g.normal(5, 2)
            rows.append((f"t{t}", day + dt.timedelta(d), float(a), float(b), int(np.digitize(a + g.normal(0, 0.5), [-0.4, 0.4])), float(2 * a - b + g.normal()), float(abs(b) + 0.1 * a)))
    return rows


SCHEMA = "ticker string, date date, a double, b double, y int, r double, v double"


def test_all_folds_equal_fits_one_by_one(spark, panel):
    rows = spark.createDataFrame(panel, SCHEMA)
    models, windows = walkforward.fitted_folds(rows, ["a", "b"], "y", ["r", "v"], 10, 5, 5, 2)
    got = {(r.fold_id, r.ticker, r.date): r for r in walkforward.scored(rows, models, windows, ["a", "b"]).collect()}
    days = sorted({r[1] for r in panel})
    assert {f for f, _, _ in got} == {0, 1, 2} and len(got) == 3 * 5 * 12
    for fold in range(3):
        cut = 10 + 5 * fold
        train = [r for r in panel if r[1] in days[:cut]]
        x = np.array([r[2:4] for r in train])
        mean, std, y = x.mean(axis=0), x.std(axis=0), np.array([r[4] for r in train])
        z = (x - mean) / std
        design = np.column_stack([np.ones(len(z)), z])
        beta = [np.linalg.solve(design.T @ design + np.diag([0.0, 1, 1]), design.T @ np.array([r[k] for r in train])) for k in (5, 6)]
        for r in (r for r in panel if r[1] in days[cut + 2 : cut + 7]):
            q = (np.array(r[2:4]) - mean) / std
            logs = [np.log((y == c).mean()) - 0.5 * (np.log(2 * np.pi * z[y == c].var(axis=0)) + (q - z[y == c].mean(axis=0)) ** 2 / z[y == c].var(axis=0)).sum() for c in range(3)]
            p = np.exp(logs - np.max(logs)) / np.exp(logs - np.max(logs)).sum()
            s = got[fold, r[0], r[1]]
            assert np.allclose([s.prob_down, s.prob_flat, s.prob_up], p) and s.expected_return == pytest.approx(beta[0] @ [1, *q]) and s.predicted_volatility == pytest.approx(max(0, beta[1] @ [1, *q]))
            assert s.prior_2 == pytest.approx((y == 2).mean()) and s.contributions[0]["name"] == ("a", "b")[int(abs(beta[0][2] * q[1]) > abs(beta[0][1] * q[0]))]


def test_calibration_lowers_the_loss_and_skips_folds_without_a_class(spark):
    g = np.random.default_rng(2)
    rows = []
    for i in range(400):
        y = i % 3
        p = np.exp(3 * np.eye(3)[y] * (g.random() < 0.6) + g.normal(0, 0.3, 3))
        rows.append((i // 300, *(p / p.sum()).tolist(), y if i < 300 else 0))
    df = spark.createDataFrame(rows, "fold_id int, prob_down double, prob_flat double, prob_up double, y int").persist()
    w = calibration.fitted(df, "y", rounds=30)
    assert [r.fold_id for r in w.collect()] == [0]
    out = calibration.calibrated(df, w)
    loss = lambda cols: F.avg(-F.log(F.element_at(F.array(*cols), F.col("y") + 1)))
    r = out.where("fold_id = 0").agg(loss(["prob_down", "prob_flat", "prob_up"]).alias("raw"), loss(["cal_down", "cal_flat", "cal_up"]).alias("cal")).first()
    assert r.cal < r.raw - 0.01
    assert out.where("fold_id = 1 and cal_up <> prob_up").count() == 0
    df.unpersist()


def test_one_tree_is_the_best_of_all_cuts(spark, panel):
    rows = [(0, [int(np.digitize(a, [-1, 0, 1])), int(np.digitize(b, [3, 5, 7]))], y, r, v) for _, _, a, b, y, r, v in panel]
    df = spark.createDataFrame(rows, "fold_id bigint, bins array<int>, y int, r double, v double")
    fit = trees.FoldTrees(rounds=1, rate=1.0, least=5).fit(df, 2, "y", ["r", "v"])
    bins, g = np.array([r[1] for r in rows]), np.array([r[3] for r in rows])
    g = g - g.mean()
    worth = lambda m: g[m].sum() ** 2 / (m.sum() + 1) if m.sum() else 0.0
    best = max((worth(bins[:, j] <= t) + worth(bins[:, j] > t), -j, -t) for j in range(2) for t in range(3) if 5 <= (bins[:, j] <= t).sum() <= len(g) - 5)
    cuts, leaves = fit.trees[0][0][3]
    assert cuts[:2] == [-best[1], -best[2]] and len(leaves) == 4
    out = fit.predict(df).select("expected_return").distinct().count()
    assert out <= 4


def test_replay_feeds_itself(spark):
    """The second run's calibration counts only because the first one's cause came out of the replay."""
    monday = dt.date(2026, 1, 5)
    runs = [("k", monday + dt.timedelta(14 * i), "low_vol", [], None, ece, 3, 0.6, 0.0, "low_overfit_risk", False, 0.9, 0.0) for i, ece in enumerate((0.09, 0.06, 0.06))]
    schema = "key string, date date, regime string, drift_causes array<string>, shift_cause string, ece double, breaches int, ratio double, pbo double, label string, competition boolean, state_probability double, transition_rate double"
    got = [(r.calibration_matches, r.base, r.decision) for r in sorted(policy.replay(spark.createDataFrame(runs, schema)).collect(), key=lambda r: r.date)]
    assert got == [(0, ["calibration_ece"], "trigger"), (1, ["calibration_ece"], "suppressed_by_cooloff"), (2, ["calibration_ece"], "suppressed_by_cooloff")]
    alone = [policy.replay(spark.createDataFrame([r], schema)).first().decision for r in runs[1:]]
    assert alone == ["watch_only", "watch_only"]
    assert policy.replay(spark.createDataFrame([], schema)).count() == 0


def test_ranks_in_cells(spark):
    g = np.random.default_rng(1)
    rows = [(int(i % 3), float(v)) for i, v in enumerate(np.concatenate([g.normal(size=300), np.repeat(0.25, 60)]))]
    got = {(r.k, r.v): r.rank for r in metrics.average_ranks(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", "rank", cells=7).collect()}
    for k in range(3):
        v = np.array([x for i, x in rows if i == k])
        assert all(got[k, x] == pytest.approx((v < x).sum() + ((v == x).sum() + 1) / 2) for x in v)


def test_landed_union_and_artifacts(spark, tmp_path):
    for name, lines in (("a", ['{"x": 1}', '{"x": 2}']), ("b", ['{"x": 3}', "{broken"]), ("c", ["no json"])):
        spark.createDataFrame([(x,) for x in lines], "value string").write.text(str(tmp_path / name))
    rows, status = landed.union_landed(spark, {n: str(tmp_path / n) for n in "abcd"}, "x bigint")
    assert sorted((r.source, r.x) for r in rows.collect()) == [("a", 1), ("a", 2), ("b", 3)]
    assert {r.source: (r.status, r.rows, r.broken) for r in status.collect()} == {"a": ("ok", 2, 0), "b": ("partial", 1, 1), "c": ("failed", 0, 1), "d": ("missing", 0, 0)}
    path = str(tmp_path / "artifacts")
    df = spark.createDataFrame([("2026-01-05", 1), ("2026-01-06", 2)], "run_date string, x int")
    landed.write_artifacts(df, path)
    landed.write_artifacts(df, path)
    landed.write_artifacts(spark.createDataFrame([("2026-01-06", 9)], "run_date string, x int"), path)
    assert sorted((str(r.run_date), r.x) for r in landed.read_artifacts(spark, path, "run_date string, x int").collect()) == [("2026-01-05", 1), ("2026-01-06", 9)]


def test_flat_documents_tolerate_missing_and_mistyped(spark):
    docs = [json.dumps({"audit_id": "A", "backtest": {"pbo": 0.5, "retraining_monitor": {"should_retrain": True, "calibration_signal": {"ece_breach_count": "three"}, "effective_trigger_names": ["x", "y"]}}}), "{broken", None]
    out = audit.flat_documents(spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string"), "d").orderBy("i").collect()
    assert len(out[0]) > 110 and (out[0].audit_id, out[0].pbo, out[0].should_retrain, out[0].ece_breach_count, out[0].trigger_names, out[0].current_regime) == ("A", 0.5, True, 0, ["x", "y"], "unknown")
    assert (out[1].pbo, out[1].state_probability, out[2].policy_decision, out[2].news_feature_missing_rate) == (0.0, 1.0, "watch_only", 1.0)


def test_a_query_call_reads_its_tables_anew(spark, tmp_path):
    query = fixtures.scoped(lambda s, d: fixtures.view(s, d, "runs").agg(F.sum("n").alias("n")))
    path = str(tmp_path / "orders.parquet")
    put = lambda n: spark.createDataFrame([("1-URGENT", dt.date(2026, 1, 5), 1.0, "P")] * n, "o_orderpriority string, o_orderdate date, o_totalprice double, o_orderstatus string").write.mode("overwrite").parquet(path)
    put(3)
    assert query(spark, str(tmp_path)).first().n == 3
    put(5)
    assert query(spark, str(tmp_path)).first().n == 5 and not spark.catalog.tableExists("orders")


def test_cuts_hold_the_embargo(spark):
    dates = folds.date_index(spark.createDataFrame([(dt.date(2026, 1, 1) + dt.timedelta(i),) for i in range(30)], "date date"))
    assert [r.cut for r in folds.walk_forward_cuts(dates, 10, 5, 5, 2).orderBy("fold_id").collect()] == [10, 15, 20]
