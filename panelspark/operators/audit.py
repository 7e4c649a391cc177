"""Roll-ups over many runs, alert rules, and the retraining policy over run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.calendar import bday_ord


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, median, population deviation, extremes."""
    return df.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def grouped_rollup(df: DataFrame, fields: list[str], value: str) -> DataFrame:
    """The distribution of each field's values and over all rows, in one pass of grouping sets."""
    out = df.groupingSets([*[[f] for f in fields], []], *fields).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), *[F.grouping(f).alias(f"__g_{f}") for f in fields])
    name = F.coalesce(*[F.when(F.col(f"__g_{f}") == 0, F.lit(f)) for f in fields], F.lit("all"))
    item = F.coalesce(*[F.when(F.col(f"__g_{f}") == 0, F.col(f).cast("string")) for f in fields], F.lit("all"))
    return out.select(name.alias("dimension"), item.alias("item"), "count", "mean", "min", "max")


def trigger_counts(df: DataFrame, names: str) -> DataFrame:
    """Runs that contain each name."""
    return df.select(F.explode(F.array_distinct(names)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("runs"))


def co_triggers(df: DataFrame, names: str) -> DataFrame:
    """Runs that contain both of two different names; lists are short."""
    x = df.select(F.array_sort(F.array_distinct(names)).alias("n"))
    pairs = F.flatten(F.transform("n", lambda a, i: F.transform(F.slice("n", i + 2, F.greatest(F.size("n") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return x.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("runs"))


def run_class(base: Column, effective: Column) -> Column:
    """What dominates a run's triggers."""
    return F.when(F.size(base) == 0, "none").when(F.size(F.array_except(base, F.array(F.lit("calibration")))) == 0, "calibration_only").when(F.arrays_overlap(base, F.array(F.lit("drift"))), "drift").when(F.arrays_overlap(base, F.array(F.lit("regime"))), "regime").otherwise("other")


def alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """metrics (run, metric, value) x rules (metric, op, threshold, severity): findings and each run's worst severity."""
    hit = ((F.col("op") == ">=") & (F.col("value") >= F.col("threshold"))) | ((F.col("op") == "<=") & (F.col("value") <= F.col("threshold")))
    f = metrics.join(F.broadcast(rules), "metric").where(hit)
    level = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "warning", 2).otherwise(1)
    return f.groupBy("run").agg(F.count(F.lit(1)).alias("findings"), F.max_by("severity", level).alias("severity"), F.array_join(F.array_sort(F.collect_set("metric")), "|").alias("metrics"))


def evidence_hash(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """A digest of each group that does not depend on row order."""
    h = F.xxhash64(*columns)
    return df.groupBy(*by).agg(F.bit_xor(h).alias("digest"), F.sum(F.shiftright(h, 32)).alias("check"), F.count(F.lit(1)).alias("rows"))


def history_match(runs: DataFrame, window: int) -> DataFrame:
    """runs (key, date, causes array): prior runs of the key within `window` business days that share a cause, and the
    business days since the first of them. A range of ordinals by (key, cause), at most `window` days long; no pairs are joined."""
    r = runs.withColumn("ord", bday_ord(F.col("date")))
    back = Window.partitionBy("key", "cause").orderBy("ord").rangeBetween(-window, -1)
    a = r.select("key", "date", "ord", F.explode("causes").alias("cause")).withColumn("prior", F.collect_set("ord").over(back))
    m = a.groupBy("key", "date", "ord").agg(F.array_distinct(F.flatten(F.collect_list("prior"))).alias("prior"))
    m = m.select("key", "date", "ord", F.size("prior").alias("matches"), F.array_min("prior").alias("first"))
    out = runs.join(m, ["key", "date"], "left")
    return out.select("key", "date", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce(F.col("ord") - F.col("first"), F.lit(0)).alias("span"))


def cool_off(runs: DataFrame, days: int) -> DataFrame:
    """runs (key, date, wanted): a wanted run is effective unless an effective one lies within `days` business days before.
    The rule feeds back on itself: one ordered fold over the (short) history of each key."""
    rows = F.array_sort(F.collect_list(F.struct("date", bday_ord(F.col("date")).alias("ord"), "wanted")))
    start = F.struct(F.lit(-1_000_000).alias("last"), F.array().cast("array<boolean>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        ok = x["wanted"] & (x["ord"] - s["last"] > days)
        return F.struct(F.when(ok, x["ord"]).otherwise(s["last"]).alias("last"), F.concat(s["out"], F.array(ok)).alias("out"))

    h = runs.groupBy("key").agg(rows.alias("rows")).withColumn("flags", F.aggregate("rows", start, step, lambda s: s["out"]))
    x = F.explode(F.arrays_zip("rows", "flags"))
    return h.select("key", x.alias("x")).select("key", F.col("x.rows.date").alias("date"), F.col("x.rows.wanted").alias("wanted"), F.col("x.flags").alias("effective"))


def drift_policy(diagnostics: DataFrame, weights: DataFrame, threshold: float, persistence: int) -> DataFrame:
    """diagnostics (key, date, family, status): family-weighted drift score of a run, and persistence over runs in a row."""
    points = F.when(F.col("status") == "FAIL", 1.0).when(F.col("status") == "WARNING", 0.5).otherwise(0.0)
    score = diagnostics.join(F.broadcast(weights), "family").groupBy("key", "date").agg(F.sum(points * F.col("weight")).alias("score"))
    w = Window.partitionBy("key").orderBy("date")
    over = score.withColumn("over", (F.col("score") >= threshold).cast("int"))
    recent = F.sum("over").over(w.rowsBetween(1 - persistence, 0))
    return over.withColumn("persistent", recent == persistence).withColumn("over", F.col("over") == 1)


def recent_history(runs: DataFrame, n: int = 128) -> DataFrame:
    w = Window.partitionBy("key").orderBy(F.desc("date"))
    return runs.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def value_counts(df: DataFrame, field: str, when: Column | None = None) -> DataFrame:
    """Non-empty values of a field and their runs, of all runs or of those where the condition holds."""
    x = df.where(F.coalesce(F.col(field).cast("string"), F.lit("")) != "")
    return (x if when is None else x.where(when)).groupBy(F.col(field).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("runs"))


def top_items(counts: DataFrame, item: str, n: str, limit: int) -> DataFrame:
    return counts.orderBy(F.desc(n), item).limit(limit)


def relief_count(df: DataFrame, by: list[str], flag: Column, names: str, of: str = "feature_drift") -> DataFrame:
    """Runs that a rule would have relieved: the flag holds and no other trigger than `of` is there."""
    alone = F.size(F.array_except(names, F.array(F.lit(of)))) == 0
    return df.groupBy(*by).agg(F.count_if(flag & alone).alias("relieved"), F.count(F.lit(1)).alias("runs"))


def rates(df: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """Share of runs with each flag (nulls count as no)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), *[F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(k) for k, c in flags.items()])


def watch_only(df: DataFrame, base: str, effective: str, suppressed: str) -> DataFrame:
    """Names that stayed watch-only: raised but not effective, and suppressed ones; a name that is both counts twice."""
    names = F.concat(F.array_except(base, effective), F.coalesce(F.col(suppressed), F.array().cast("array<string>")))
    return df.select(F.explode(names).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("runs"))


def family_contribution(df: DataFrame) -> DataFrame:
    """Rows (run, family, importance, missing_rate, stale_rate, source) -> means by family over all runs."""
    return df.groupBy("family").agg(F.avg("importance").alias("importance"), F.avg("missing_rate").alias("missing_rate"), F.avg("stale_rate").alias("stale_rate"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"), F.count_distinct("run").alias("runs"))


def catalog_across_runs(df: DataFrame, worst: int | None = None) -> DataFrame:
    """Rows (run, feature, family, missing_rate, stale_rate) -> mean rates by feature; the `worst` ones by missing, then stale."""
    out = df.groupBy("feature", "family").agg(F.avg("missing_rate").alias("missing_rate"), F.avg("stale_rate").alias("stale_rate"), F.count(F.lit(1)).alias("runs"))
    return out if worst is None else out.orderBy(F.desc("missing_rate"), F.desc("stale_rate"), "feature").limit(worst)


def risk_review(runs: DataFrame, max_drawdown_limit: float) -> DataFrame:
    """runs (run, stale_ratio, critical, warning, concentration, retrain, shift_flag, regime, max_drawdown, dummy) -> the
    checks' states, risk level and approval."""
    drift = F.when((F.col("critical") > 0) & F.col("dummy").isNull(), "FAIL").when((F.col("critical") > 0) | (F.col("warning") > 0), "WARNING").otherwise("PASS")
    warn = lambda c: F.when(c, "WARNING").otherwise("PASS")
    df = runs.withColumn("data_freshness", warn(F.col("stale_ratio") > 0.1)).withColumn("feature_drift", drift).withColumn("prediction_concentration", warn(F.col("concentration") > 0.75)).withColumn("model_staleness", warn(F.col("retrain"))).withColumn("regime_consistency", warn(F.col("shift_flag") | (F.col("regime") == "transition")))
    checks = F.array("data_freshness", "feature_drift", "prediction_concentration", "model_staleness", "regime_consistency")
    warnings, failed = F.size(F.filter(checks, lambda x: x == "WARNING")), F.array_contains(checks, "FAIL")
    df = df.withColumn("warnings", warnings)
    high = (F.col("max_drawdown") < -max_drawdown_limit) | (F.col("warnings") >= 2)
    level = F.when(failed, "CRITICAL").when(high, "HIGH").when(F.col("warnings") > 0, "MEDIUM").when(F.col("dummy") == "null_random_walk", "MEDIUM").otherwise("LOW")
    approval = F.when(failed, "BLOCKED").when(high | (F.col("warnings") > 0) | F.coalesce(F.col("dummy") == "null_random_walk", F.lit(False)), "MANUAL_REVIEW_REQUIRED").otherwise("AUTO_APPROVED")
    return df.withColumn("risk_level", level).withColumn("approval", approval)


def risk_checks(reviewed: DataFrame, keys: list[str]) -> DataFrame:
    """A risk_review with all eight checks as rows: (keys, check_name, status, metric_value, threshold). Liquidity, free-form text
    and source integrity have nothing to measure and pass by definition."""
    metric = {"data_freshness": ("stale_ratio", 0.1), "feature_drift": ("max_psi", None), "prediction_concentration": ("concentration", 0.75), "model_staleness": ("trigger_count", 1.0), "regime_consistency": ("state_probability", 0.6)}
    none = F.lit(None).cast("double")
    rows = [F.struct(F.lit(n).alias("check_name"), F.col(n).alias("status"), (F.col(c).cast("double") if c in reviewed.columns else none).alias("metric_value"), (F.when(F.col(n) == "FAIL", 0.25).otherwise(0.2) if n == "feature_drift" else F.lit(t)).alias("threshold")) for n, (c, t) in metric.items()]
    rows += [F.struct(F.lit(n).alias("check_name"), F.lit("PASS").alias("status"), none.alias("metric_value"), none.alias("threshold")) for n in ("liquidity_check", "hallucination_guard", "source_integrity")]
    return reviewed.select(*keys, F.explode(F.array(*rows)).alias("x")).select(*keys, "x.*")


def highest_confidence(df: DataFrame, by: list[str], item: str, confidence: Column) -> DataFrame:
    """The item with the largest confidence of each group; ties take the first by name."""
    w = Window.partitionBy(*by).orderBy(F.desc("__c"), item)
    out = df.withColumn("__c", confidence).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return out.select(*by, item, F.col("__c").alias("confidence"))


def deltas(new: DataFrame, old: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """new less old by key; a side that lacks the key counts as 0."""
    o = old.select(*keys, *[F.col(v).alias(f"__{v}") for v in values])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return new.join(o, keys, "full").select(*keys, *[(zero(v) - zero(f"__{v}")).alias(f"{v}_delta") for v in values])


def side_by_side(metrics: DataFrame, by: list[str], mode: str, modes: list[str], values: list[str]) -> DataFrame:
    """One row a group with each mode's values in columns of their own."""
    return metrics.groupBy(*by).agg(*[F.max(F.when(F.col(mode) == m, F.col(v))).alias(f"{m}_{v}") for m in modes for v in values])


def linked(runs: DataFrame, parts: dict[str, DataFrame], key: str = "run_id") -> DataFrame:
    """Runs left joined with each artifact table by id; has_<name> says whether it was found."""
    for name, p in parts.items():
        p = p.select(key, *[F.col(c).alias(f"{name}_{c}") for c in p.columns if c != key]).withColumn(f"has_{name}", F.lit(True))
        runs = runs.join(p, key, "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    return runs


def flat_run(documents: DataFrame, paths: dict[str, str]) -> DataFrame:
    """Nested run documents to flat rows: output column -> path of struct fields; a path that the document lacks is null."""

    def there(path: str) -> bool:
        kind = documents.schema
        for part in path.split("."):
            if not hasattr(kind, "fieldNames") or part not in kind.fieldNames():
                return False
            kind = kind[part].dataType
        return True

    return documents.select(*[(F.col(p) if there(p) else F.lit(None).cast("string")).alias(c) for c, p in paths.items()])


#: Sections of a run document, the type of their fields, and the fields, as `column=field` where the names differ
#: and `?default` where it is not 0, false or the empty text.
RUN_SECTIONS = [
    ("", "string", "audit_id as_of_date ticker_set"),
    ("backtest", "string", "backtest_id"),
    ("backtest", "double", "pbo"),
    ("backtest.cost_adjusted_metrics", "double", "information_ratio selection_stability"),
    ("backtest.aggregate_metrics", "double", "hit_rate_mean"),
    ("backtest.cpcv", "double", "cluster_adjusted_pbo"),
    ("backtest.cpcv.pbo_summary", "string", "pbo_label=label"),
    ("backtest.cpcv.cluster_adjusted_pbo_summary", "string", "cluster_adjusted_pbo_label=label"),
    ("backtest.cpcv.pbo_diagnostics.near_candidate_competition", "boolean", "candidate_pbo_competition_dominated=competition_dominated"),
    ("backtest.cpcv.pbo_diagnostics.near_candidate_competition", "string", "candidate_pbo_dominant_axis=dominant_axis candidate_pbo_dominant_value=dominant_value"),
    ("backtest.cpcv.pbo_diagnostics.near_candidate_competition", "double", "candidate_pbo_close_competition_ratio=close_split_ratio"),
    ("backtest.cpcv.cluster_adjusted_pbo_diagnostics.near_candidate_competition", "boolean", "pbo_competition_dominated=competition_dominated"),
    ("backtest.cpcv.cluster_adjusted_pbo_diagnostics.near_candidate_competition", "string", "pbo_dominant_axis=dominant_axis pbo_dominant_value=dominant_value"),
    ("backtest.cpcv.cluster_adjusted_pbo_diagnostics.near_candidate_competition", "double", "pbo_close_competition_ratio=close_split_ratio"),
    ("backtest.regime_monitor", "string", "current_regime?unknown dominant_recent_regime?unknown"),
    ("backtest.regime_monitor", "boolean", "regime_shift_flag"),
    ("backtest.regime_monitor", "double", "state_probability?1.0 transition_rate"),
    ("backtest.retraining_monitor.regime_signal", "string", "transition_profile?not_transition state_probability_bucket?stable transition_rate_bucket?zero"),
    ("backtest.retraining_monitor.regime_signal", "bigint", "transition_history_matches transition_observation_count transition_span_business_days"),
    ("backtest.retraining_monitor.regime_signal", "boolean", "transition_persistent stable_transition unstable_transition immediate_transition"),
    ("backtest.retraining_monitor.drift_signal", "double", "drift_weighted_score=weighted_score drift_pre_suppression_weighted_score=pre_suppression_weighted_score drift_weighted_threshold=weighted_threshold drift_low_vol_threshold=low_vol_threshold drift_immediate_threshold=immediate_threshold drift_family_persistence_counterfactual_score=family_persistence_counterfactual_score drift_threshold_delta_to_suppress=threshold_delta_to_suppress drift_stable_transition_counterfactual_score=stable_transition_counterfactual_score"),
    ("backtest.retraining_monitor.drift_signal", "bigint", "drift_trigger_feature_count=trigger_feature_count drift_trigger_family_count=trigger_family_count drift_pre_suppression_trigger_feature_count=pre_suppression_trigger_feature_count drift_pre_suppression_trigger_family_count=pre_suppression_trigger_family_count drift_proxy_sensitive_trigger_feature_count=proxy_sensitive_trigger_feature_count drift_non_proxy_trigger_feature_count=non_proxy_trigger_feature_count drift_pre_suppression_proxy_sensitive_trigger_feature_count=pre_suppression_proxy_sensitive_trigger_feature_count drift_pre_suppression_non_proxy_trigger_feature_count=pre_suppression_non_proxy_trigger_feature_count drift_history_matches=history_matches drift_span_business_days=span_business_days"),
    ("backtest.retraining_monitor.drift_signal", "array<string>", "drift_trigger_families=trigger_families drift_pre_suppression_trigger_families=pre_suppression_trigger_families drift_suppressed_families=suppressed_families drift_stable_transition_suppressed_families=stable_transition_suppressed_families"),
    ("backtest.retraining_monitor.drift_signal", "string", "drift_proxy_sensitive_profile=proxy_sensitive_profile?none"),
    ("backtest.retraining_monitor.drift_signal", "boolean", "drift_family_persistence_would_suppress=family_persistence_would_suppress drift_low_vol_threshold_would_suppress=low_vol_threshold_would_suppress drift_stable_transition_suppression_would_suppress=stable_transition_suppression_would_suppress"),
    ("backtest.drift_monitor.supplementary_analysis", "string", "drift_primary_cause=primary_cause"),
    ("backtest.retraining_monitor.calibration_signal", "bigint", "ece_breach_count calibration_gap_breach_count ece_history_matches calibration_gap_history_matches ece_observation_count calibration_gap_observation_count ece_span_business_days calibration_gap_span_business_days"),
    ("backtest.retraining_monitor.calibration_signal", "double", "ece_breach_ratio calibration_gap_breach_ratio"),
    ("backtest.retraining_monitor.calibration_signal", "boolean", "ece_fold_persistent calibration_gap_fold_persistent ece_run_persistent calibration_gap_run_persistent"),
    ("backtest.retraining_monitor", "boolean", "base_should_retrain should_retrain"),
    ("backtest.retraining_monitor", "string", "policy_decision?watch_only"),
    ("backtest.retraining_monitor", "array<string>", "trigger_names=effective_trigger_names base_trigger_names suppressed_trigger_names policy_notes"),
    ("data_sources", "string", "ohlcv_source macro_source"),
    ("data_sources.ohlcv_transport", "string", "ohlcv_transport_origin=origin"),
    ("data_sources.macro_transport", "string", "macro_transport_origin=origin"),
    ("data_sources.feature_sources.news", "string", "news_used_source=used_source news_requested_source=requested_source"),
    ("data_sources.feature_sources.news", "boolean", "news_fallback_used=fallback_used"),
    ("data_sources.feature_sources.news.transport", "string", "news_transport_origin=origin"),
    ("data_sources.feature_sources.fundamental", "string", "fundamental_used_source=used_source fundamental_requested_source=requested_source"),
    ("data_sources.feature_sources.fundamental", "boolean", "fundamental_fallback_used=fallback_used"),
    ("data_sources.feature_sources.fundamental.transport", "string", "fundamental_transport_origin=origin"),
    ("news_coverage_analysis", "bigint", "news_best_aggregation_window=best_aggregation_window news_best_decay_halflife=best_decay_halflife"),
    ("news_coverage_analysis", "double", "news_best_aggregation_coverage=best_aggregation_coverage news_best_aggregation_abs_ic=best_aggregation_abs_ic news_best_decay_coverage=best_decay_coverage news_best_decay_abs_ic=best_decay_abs_ic"),
    ("news_coverage_analysis", "boolean", "news_aggregation_improves_coverage=aggregation_improves_coverage news_aggregation_improves_utility=aggregation_improves_utility news_decay_improves_coverage=decay_improves_coverage news_decay_improves_utility=decay_improves_utility"),
]


def run_fields() -> list[tuple[str, str, str, object]]:
    """(column, path, type, default) of every scalar or list of a flat run row."""
    nothing = {"double": 0.0, "bigint": 0, "boolean": False, "string": "", "array<string>": None}
    out = []
    for section, kind, names in RUN_SECTIONS:
        for item in names.split():
            name, _, default = item.partition("?")
            column, _, field = name.partition("=")
            path = ".".join(filter(None, [section, field or column]))
            out.append((column, path, kind, type(nothing[kind])(default) if default else nothing[kind]))
    return out


def flat_documents(df: DataFrame, document: str) -> DataFrame:
    """df without the column `document` (JSON text), plus a flat row's columns: those of run_fields, look-backs and half-lives of the news
    analysis, and the mean missing and stale rate of the news features in the catalog. Each is read from a VARIANT by its path
    and type; a path that is missing or holds another type gives the default, and text that is no JSON gives defaults only."""
    v = df.withColumn("__v", F.try_parse_json(document))
    get = lambda path, kind: F.try_variant_get("__v", f"$.{path}", kind)
    empty = F.array().cast("array<string>")
    columns = {c: F.coalesce(get(p, k), empty if k == "array<string>" else F.lit(d)) for c, p, k, d in run_fields()}
    for entries, key, sizes, prefix, suffix in (("lookback_windows", "window_days", (1, 3, 5, 10), "lookback", "d"), ("decay_halflives", "halflife_days", (3, 5), "halflife", "d")):
        items = get(f"news_coverage_analysis.{entries}", f"array<struct<{key}: bigint, coverage: double, abs_ic: double>>")
        for n in sizes:
            one = F.try_element_at(F.filter(items, lambda x: x[key] == n), F.lit(-1))
            for field in ("coverage", "abs_ic"):
                columns[f"news_{'decay_' if prefix == 'halflife' else ''}{field}_{prefix}_{n}{suffix}"] = F.coalesce(one[field], F.lit(0.0))
    catalog = F.filter(get("backtest.feature_catalog", "array<struct<feature_family: string, missing_rate: double, stale_rate: double>>"), lambda x: x["feature_family"] == "news")
    mean = lambda field: F.aggregate(catalog, F.lit(0.0), lambda s, x: s + F.coalesce(x[field], F.lit(0.0))) / F.greatest(F.size(catalog), F.lit(1))
    there = F.coalesce(F.size(catalog), F.lit(0)) > 0
    columns["news_feature_missing_rate"] = F.when(there, mean("missing_rate")).otherwise(1.0)
    columns["news_feature_coverage"] = F.greatest(1 - columns["news_feature_missing_rate"], F.lit(0.0))
    columns["news_feature_stale_rate"] = F.when(there, mean("stale_rate")).otherwise(F.coalesce(get("data_sources.feature_sources.news.stale_rate", "double"), F.lit(0.0)))
    return v.withColumns(columns).drop("__v", document)
