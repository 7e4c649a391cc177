"""The retraining policy over run history: drift, calibration, regime and overfitting signals, and their decision.

Runs are rows (key, date, ...). History is what earlier rows of the same key say: ranges of business-day ordinals over the
rows of a key, never a join of all pairs. Only the cool-off feeds back on itself; it is one ordered fold a key."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.calendar import bday_ord

#: Fixed defaults of the policy.
FAMILY_WEIGHTS = {"price_momentum": 1.0, "volatility": 1.2, "volume": 0.8, "macro": 0.9, "calendar": 0.3}
DRIFT_MULTIPLIER = {"low_vol": 1.0, "transition": 0.9, "high_vol": 1.4, "unknown": 1.15}
DRIFT_IMMEDIATE_MULTIPLIER = {"low_vol": 1.0, "transition": 0.95, "high_vol": 1.25, "unknown": 1.10}
BREACH_MULTIPLIER = {"low_vol": 1.0, "transition": 0.9, "high_vol": 1.15, "unknown": 1.0}
SUPPRESSED = {"high_vol": ["price_momentum", "volume"]}
PBO_LABELS = ["low_overfit_risk", "moderate_overfit_risk", "high_overfit_risk", "severe_overfit_risk"]


def choose(key: Column, table: dict, default) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()], F.lit(default))


def regime_bucket(regime: Column) -> Column:
    return F.when(regime.isin("transition", "high_vol"), "stress").when(regime == "low_vol", "low_vol").otherwise("unknown")


def history(days: int):
    """The rows of the key in the `days` business days before (needs column ord)."""
    return Window.partitionBy("key").orderBy("ord").rangeBetween(-days, -1)


def with_ord(runs: DataFrame) -> DataFrame:
    return runs.withColumn("ord", bday_ord(F.col("date")))


def prior(condition: Column, days: int) -> tuple[Column, Column]:
    """(number of earlier runs where the condition holds, business days since the first of them, 0 without one)."""
    first = F.min(F.when(condition, F.col("ord"))).over(history(days))
    return F.count_if(condition).over(history(days)), F.coalesce(F.col("ord") - first, F.lit(0))


def state_probability_bucket(p: Column) -> Column:
    return F.when(p < 0.45, "very_low").when(p < 0.55, "low").when(p < 0.75, "medium").otherwise("stable")


def transition_rate_bucket(r: Column) -> Column:
    return F.when(r <= 0, "zero").when(r <= 0.10, "low").when(r <= 0.15, "medium").otherwise("high")


def transition_profile(runs: DataFrame, days: int = 45, least_runs: int = 3, least_span: int = 10) -> DataFrame:
    """runs (key, date, regime, state_probability, transition_rate) plus the transition profile: matches and span in the
    history, persistent, stable, unstable, immediate, class and the two buckets."""
    now = F.col("regime") == "transition"
    n, span = prior(now, days)
    p, r = F.col("state_probability"), F.col("transition_rate")
    df = with_ord(runs).withColumn("matches", F.when(now, n).otherwise(0)).withColumn("span", F.when(now, span).otherwise(0))
    df = df.withColumn("persistent", now & (F.col("matches") + 1 >= least_runs) & (F.col("span") >= least_span))
    df = df.withColumn("stable", now & (r <= 0.10) & ((p >= 0.75) | F.col("persistent"))).withColumn("unstable", now & ((p < 0.55) | (r > 0.10))).withColumn("immediate", now & ((p < 0.45) | (r > 0.15)))
    kind = F.when(~now, "not_transition").when(F.col("stable"), "stable_transition").when(F.col("unstable"), "unstable_transition").otherwise("watch_transition")
    return df.withColumn("profile", kind).withColumn("probability_bucket", state_probability_bucket(p)).withColumn("rate_bucket", transition_rate_bucket(r)).drop("ord")


def drift_signal(diagnostics: DataFrame, profile: DataFrame, threshold: float = 2.45, immediate: float = 2.95, stable_suppressed: tuple[str, ...] = ("calendar",)) -> DataFrame:
    """diagnostics (key, date, family, feature, status, action) and profile (key, date, regime, stable) -> one row a run:
    trigger features and families, family-weighted score before and after suppression, thresholds by regime, what
    counterfactual rules would have done, and whether drift triggers (persistent or at once)."""
    hit = F.col("status").isin("WARNING", "FAIL") & (F.col("action") == "trigger")
    f = diagnostics.where(hit).groupBy("key", "date", "family").agg(F.count(F.lit(1)).alias("features"))
    f = f.join(profile.select("key", "date", "regime", "stable"), ["key", "date"])
    weight = choose(F.col("family"), FAMILY_WEIGHTS, 0.0)
    by_regime = F.coalesce(*[F.when(F.col("regime") == r, F.col("family").isin(*fs)) for r, fs in SUPPRESSED.items()], F.lit(False))
    by_stable = F.col("stable") & F.col("family").isin(*stable_suppressed)
    out = ~(by_regime | by_stable)
    total = lambda on: F.coalesce(F.sum(F.when(on, weight)), F.lit(0.0))
    s = f.groupBy("key", "date").agg(total(out).alias("score"), F.sum(weight).alias("raw_score"), F.sum(F.when(out, F.col("features")).otherwise(0)).alias("features"), F.count_if(out).alias("families"), F.sum(F.when(out, 0).otherwise(F.col("features"))).alias("suppressed_features"), total(F.col("features") >= 2).alias("two_feature_score"), total(~by_stable).alias("stable_transition_score"), F.array_join(F.array_sort(F.collect_list(F.when(out, F.col("family")))), "|").alias("trigger_families"))
    s = profile.select("key", "date", "regime", "stable").join(s, ["key", "date"], "left").fillna({"score": 0.0, "raw_score": 0.0, "features": 0, "families": 0, "suppressed_features": 0, "two_feature_score": 0.0, "stable_transition_score": 0.0, "trigger_families": ""})
    s = s.withColumn("threshold", F.lit(threshold) * choose(F.col("regime"), DRIFT_MULTIPLIER, DRIFT_MULTIPLIER["unknown"]))
    s = s.withColumn("persistent", (F.col("features") >= 2) & (F.col("families") >= 2)).withColumn("immediate", (F.col("families") >= 1) & (F.col("score") >= F.lit(immediate) * choose(F.col("regime"), DRIFT_IMMEDIATE_MULTIPLIER, DRIFT_IMMEDIATE_MULTIPLIER["unknown"])))
    s = s.withColumn("triggered", (F.col("persistent") & (F.col("score") >= F.col("threshold"))) | F.col("immediate"))
    s = s.withColumn("family_rule_would_suppress", F.col("two_feature_score") < F.col("threshold")).withColumn("stable_rule_would_suppress", F.col("stable") & (F.col("stable_transition_score") < F.col("threshold")))
    return s.withColumn("low_vol_rule_would_suppress", F.col("raw_score") < threshold * DRIFT_MULTIPLIER["low_vol"])


def calibration_signal(runs: DataFrame, kind: str, mean: str, breaches: str, ratio: str, warning: float, days: int = 30, least_runs: int = 2, least_span: int = 10, least_folds: int = 2, least_ratio: float = 0.4, immediate: float = 1.5) -> DataFrame:
    """runs (key, date, regime, causes array, metrics) -> persistence over folds, over runs that share the cause
    `kind:bucket`, immediacy and the trigger."""
    bucket = regime_bucket(F.col("regime"))
    df = with_ord(runs).withColumn("bucket", bucket)
    names = ("stress", "low_vol", "unknown")
    found = {b: prior(F.array_contains("causes", f"{kind}:{b}"), days) for b in names}
    pick = lambda i: F.coalesce(*[F.when(F.col("bucket") == b, found[b][i]) for b in names])
    df = df.withColumn("matches", pick(0)).withColumn("span", pick(1))
    df = df.withColumn("fold_persistent", (F.col(breaches) >= least_folds) & (F.col(ratio) >= F.lit(least_ratio) * choose(F.col("regime"), BREACH_MULTIPLIER, 1.0)))
    df = df.withColumn("run_persistent", F.col("fold_persistent") & (F.col("matches") + 1 >= least_runs) & (F.col("span") >= least_span))
    df = df.withColumn("immediate", F.col("fold_persistent") & (F.col(mean) >= warning * immediate))
    return df.withColumn("triggered", F.col("run_persistent") | F.col("immediate")).drop("ord")


def pbo_signal(runs: DataFrame, warning: float = 0.6, at_once: float = 0.85, days: int = 45, least_runs: int = 3, least_span: int = 20) -> DataFrame:
    """runs (key, date, pbo, label, causes, competition) -> earlier runs with a PBO at the warning or the same cause, their
    span, persistence, the downgrade where close competition dominates, and what comes out."""
    df = with_ord(runs)
    found = {b: prior((F.col("pbo") >= warning) | F.array_contains("causes", f"pbo:{b}"), days) for b in PBO_LABELS}
    pick = lambda i: F.coalesce(*[F.when(F.col("label") == b, found[b][i]) for b in PBO_LABELS])
    df = df.withColumn("matches", pick(0)).withColumn("span", pick(1))
    over = F.col("pbo") >= warning
    df = df.withColumn("persistent", over & (F.col("matches") + 1 >= least_runs) & (F.col("span") >= least_span)).withColumn("immediate", (F.col("pbo") >= at_once) & ~F.col("competition"))
    out = F.when(F.col("persistent") | F.col("immediate"), "pbo").when(F.col("pbo") >= at_once, "pbo_competition_watch").when(over, "pbo_persistence_watch").otherwise("none")
    return df.withColumn("outcome", out).drop("ord")


def regime_signal(profile: DataFrame, high_vol_retrains: bool = False) -> DataFrame:
    """profile (transition_profile, shift_flag) plus the regime triggers and the watch note."""
    t = F.col("regime") == "transition"
    unsettled = t & (F.col("immediate") | (F.col("unstable") & F.col("persistent")))
    names = F.array_compact(F.array(F.when(F.col("shift_flag"), "regime_shift"), F.when(unsettled, "transition_regime"), F.when((F.col("regime") == "high_vol") & F.lit(high_vol_retrains), "high_vol_regime")))
    df = profile.withColumn("triggers", names)
    return df.withColumn("watch", F.when(t & ~unsettled, "transition_regime_watch").when((F.size("triggers") == 0) & F.col("regime").isin("transition", "high_vol"), "regime_watch").otherwise("none"))


def decide(runs: DataFrame, days: int = 30) -> DataFrame:
    """runs (key, date, regime, state_probability, transition_rate, triggers array, causes array) -> effective triggers,
    suppressed ones, and the decision: a lone regime shift in a settled state is watched, a regime shift needs drift beside
    it, and a run whose cause was effective in the same regime bucket within the cool-off is suppressed."""
    df = with_ord(runs).withColumn("bucket", regime_bucket(F.col("regime")))
    shift = F.array_contains("triggers", "regime_shift")
    lone = (F.size("triggers") == 1) & shift & (F.col("state_probability") >= 0.65) & (F.col("transition_rate") <= 0.15)
    drop = shift & (lone | ~F.array_contains("triggers", "feature_drift"))
    df = df.withColumn("confirmed", F.when(drop, F.filter("triggers", lambda x: x != "regime_shift")).otherwise(F.col("triggers")))
    left = F.when(drop, F.filter("causes", lambda c: ~c.startswith("regime_shift:"))).otherwise(F.col("causes"))
    df = df.withColumn("wanted", F.when(F.size("confirmed") > 0, F.transform(left, lambda c: F.concat_ws("@", c, F.col("bucket")))).otherwise(F.array().cast("array<string>"))).withColumn("lone", lone)
    rows = F.array_sort(F.collect_list(F.struct("ord", "date", "wanted")))
    start = F.struct(F.create_map().cast("map<string,int>").alias("last"), F.array().cast("array<boolean>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        cooling = F.exists(x["wanted"], lambda c: F.coalesce(x["ord"] - F.element_at(s["last"], c) < days, F.lit(False)))
        ok = (F.size(x["wanted"]) > 0) & ~cooling
        new = F.map_from_arrays(x["wanted"], F.transform(x["wanted"], lambda c: x["ord"]))
        kept = F.map_filter(s["last"], lambda k, v: ~F.array_contains(x["wanted"], k))
        return F.struct(F.when(ok, F.map_concat(kept, new)).otherwise(s["last"]).alias("last"), F.concat(s["out"], F.array(ok)).alias("out"))

    folded = df.groupBy("key").agg(rows.alias("rows")).withColumn("ok", F.aggregate("rows", start, step, lambda s: s["out"]))
    x = folded.select("key", F.explode(F.arrays_zip("rows", "ok")).alias("x")).select("key", F.col("x.rows.date").alias("date"), F.col("x.ok").alias("should_retrain"))
    df = df.join(x, ["key", "date"])
    cooled = (F.size("confirmed") > 0) & ~F.col("should_retrain") & (F.size("wanted") > 0)
    out = F.when(F.size("triggers") == 0, "watch_only").when(F.col("should_retrain"), "trigger").when(cooled, "suppressed_by_cooloff").when(F.col("lone"), "watch_regime_shift_only").otherwise("trigger")
    df = df.withColumn("decision", out).withColumn("base_should_retrain", F.size("triggers") > 0)
    df = df.withColumn("effective", F.when(F.col("should_retrain"), F.col("confirmed")).otherwise(F.array().cast("array<string>")))
    return df.withColumn("suppressed", F.array_sort(F.array_except("triggers", "effective"))).drop("ord", "lone", "wanted", "confirmed")


REPLAYED = "key string, date date, calibration_matches bigint, pbo_matches bigint, base array<string>, effective array<string>, causes array<string>, decision string, should_retrain boolean"


def replay(runs: DataFrame, warning: float = 0.05, immediate: float = 1.5, pbo_warning: float = 0.6, pbo_at_once: float = 0.85, entries: int = 128, calibration_days: int = 30, pbo_days: int = 45, cool_off: int = 30) -> DataFrame:
    """The policy over stored runs in order, where what the replay itself decides is the history of later runs: causes that it
    finds feed the persistence of calibration and of overfitting, and effective ones the cool-off.

    runs: key, date, regime, drift_causes (array), shift_cause (null without a shift), ece, breaches, ratio, pbo, label,
    competition, state_probability, transition_rate. A key's runs are one ordered stream; what a task keeps of it is the window
    of the last `entries` runs, so long histories need no memory. Equal dates stand in the order of all columns; null metrics
    trigger nothing; an empty table gives no rows."""
    fields = ["ord", "date", "bucket", "regime", "drift_causes", "shift_cause", "ece", "breaches", "ratio", "pbo", "label", "competition", "state_probability", "transition_rate"]
    rows = with_ord(runs).withColumn("bucket", regime_bucket(F.col("regime"))).select("key", *fields)
    rows = rows.repartition("key").sortWithinPartitions("key", *fields)

    def step(past: deque, x) -> tuple:
        near = lambda days: [e for e in past if x.ord - e["ord"] <= days]
        value = lambda v, other=0.0: other if v is None or v != v else v
        names, causes = [], list(x.drift_causes)
        if causes:
            names.append("feature_drift")
        cause = f"calibration_ece:{x.bucket}"
        seen = [e["ord"] for e in near(calibration_days) if cause in e["base"]]
        folds = value(x.breaches) >= 2 and value(x.ratio) >= 0.4 * BREACH_MULTIPLIER.get(x.regime, 1.0)
        if folds and (len(seen) + 1 >= 2 and seen and x.ord - min(seen) >= 10 or value(x.ece) >= warning * immediate):
            names.append("calibration_ece")
            causes.append(cause)
        if isinstance(x.shift_cause, str):
            names.append("regime_shift")
            causes.append(x.shift_cause)
        cause = f"pbo:{x.label}"
        pbo, over = value(x.pbo), value(x.pbo) >= pbo_warning
        held = [e["ord"] for e in near(pbo_days) if e["pbo"] >= pbo_warning or cause in e["base"]]
        if over and len(held) + 1 >= 3 and held and x.ord - min(held) >= 20 or pbo >= pbo_at_once and not x.competition:
            names.append("pbo")
            causes.append(cause)
        effective, left, decision = list(names), list(causes), "trigger"
        if "regime_shift" in names and ("feature_drift" not in names or len(names) == 1):
            if len(names) == 1 and value(x.state_probability) >= 0.65 and value(x.transition_rate) <= 0.15:
                decision = "watch_regime_shift_only"
            effective, left = [n for n in names if n != "regime_shift"], [c for c in causes if not c.startswith("regime_shift:")]
        cooling = any(e["did"] and e["bucket"] == x.bucket and x.ord - e["ord"] < cool_off and set(left) & set(e["effective"]) for e in past)
        if effective and cooling:
            effective, left, decision = [], [], "suppressed_by_cooloff"
        decision = "watch_only" if not names else "trigger" if effective else decision
        past.append({"ord": x.ord, "bucket": x.bucket, "base": set(causes), "pbo": pbo, "did": bool(effective), "effective": set(left)})
        return x.key, x.date, len(seen), len(held), names, effective, causes, decision, bool(effective)

    def run(batches):
        key, past = None, deque(maxlen=entries)
        for pdf in batches:
            out = []
            for x in pdf.itertuples(index=False):
                if not out and key is None or x.key != key:
                    key, past = x.key, deque(maxlen=entries)
                out.append(step(past, x))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in REPLAYED.split(", ")])

    return rows.mapInPandas(run, REPLAYED)


def history_entry(decided: DataFrame) -> DataFrame:
    """What a decided run leaves in the history."""
    return decided.select("key", "date", "regime", "bucket", "base_should_retrain", "should_retrain", F.col("triggers").alias("base_trigger_names"), F.col("effective").alias("effective_trigger_names"), F.col("suppressed").alias("suppressed_trigger_names"), F.col("causes").alias("base_cause_keys"), F.col("decision").alias("policy_decision"))


def replay_delta(replayed: DataFrame, stored: DataFrame) -> DataFrame:
    """By key: base and effective retraining rates of the replay less those of the stored runs, and decisions that changed."""
    s = stored.select("key", "date", F.col("should_retrain").alias("was"), F.col("decision").alias("was_decision"))
    j = replayed.join(s, ["key", "date"])
    rate = lambda c: F.avg(c.cast("double"))
    return j.groupBy("key").agg(F.count(F.lit(1)).alias("runs"), (rate(F.col("should_retrain")) - rate(F.col("was"))).alias("rate_delta"), F.count_if(F.col("decision") != F.col("was_decision")).alias("changed"))
