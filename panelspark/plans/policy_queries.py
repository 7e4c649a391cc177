"""Queries over the retraining policy and audit suites; runs are weekly aggregates of the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import audit, policy
from panelspark.plans.fixtures import table, view, with_views
from panelspark.plans.panel_queries import rounded
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


def runs(spark, sf_dir):
    return view(spark, sf_dir, "policy_runs")


def names(**conditions):
    """Array of the names whose SQL condition holds."""
    return F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n.replace("__", ":"))) for n, c in conditions.items()]))


ORD = "cast(5 * floor((date_diff('day', date '1970-01-05', date)) / 7) + least(isodow(date) - 1, 5) as bigint)"
BUCKET = "case when regime in ('transition', 'high_vol') then 'stress' when regime = 'low_vol' then 'low_vol' else 'unknown' end"


def listed(**conditions) -> str:
    return "list_filter([" + ", ".join(f"case when {c} then '{n.replace('__', ':')}' end" for n, c in conditions.items()) + "], lambda x: x is not null)"


PROFILE = f"""po as (select *, {ORD} as ord from policy_runs), pa as (select *, case when regime = 'transition' then count(*) filter (regime = 'transition') over h else 0 end as matches, case when regime = 'transition' then coalesce(ord - min(case when regime = 'transition' then ord end) over h, 0) else 0 end as span from po window h as (partition by key order by ord range between 45 preceding and 1 preceding)),
pb as (select *, regime = 'transition' and matches + 1 >= 3 and span >= 10 as persistent from pa), pc as (select *, regime = 'transition' and transition_rate <= 0.10 and (state_probability >= 0.75 or persistent) as stable, regime = 'transition' and (state_probability < 0.55 or transition_rate > 0.10) as unstable, regime = 'transition' and (state_probability < 0.45 or transition_rate > 0.15) as immediate from pb)"""


@query(f"""with {PROFILE} select key, date, matches, cast(span as bigint) as span, persistent, case when regime <> 'transition' then 'not_transition' when stable then 'stable_transition' when unstable then 'unstable_transition' else 'watch_transition' end as profile, immediate,
case when state_probability < 0.45 then 'very_low' when state_probability < 0.55 then 'low' when state_probability < 0.75 then 'medium' else 'stable' end as probability_bucket, case when transition_rate <= 0 then 'zero' when transition_rate <= 0.10 then 'low' when transition_rate <= 0.15 then 'medium' else 'high' end as rate_bucket from pc""", "policy_runs")
def policy_transition_profile(spark, sf_dir):
    return rounded(policy.transition_profile(runs(spark, sf_dir)).select("key", "date", "matches", "span", "persistent", "profile", "immediate", "probability_bucket", "rate_bucket"))


@query(f"""with {PROFILE}, rs as (select *, regime = 'transition' and (immediate or (unstable and persistent)) as unsettled from pc), rt as (select *, {listed(regime_shift="shift_flag", transition_regime="unsettled")} as triggers from rs)
select key, date, array_to_string(triggers, '|') as triggers, case when regime = 'transition' and not unsettled then 'transition_regime_watch' when len(triggers) = 0 and regime in ('transition', 'high_vol') then 'regime_watch' else 'none' end as watch from rt""", "policy_runs")
def policy_regime_signal(spark, sf_dir):
    out = policy.regime_signal(policy.transition_profile(runs(spark, sf_dir)))
    return out.select("key", "date", F.array_join("triggers", "|").alias("triggers"), "watch")


FAMILIES = [("price_momentum", 0), ("price_momentum", 1), ("volatility", 2), ("volatility", 3), ("volume", 4), ("macro", 5), ("calendar", 6)]


def diagnostics(spark, sf_dir):
    grid = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(k).alias("k")) for f, k in FAMILIES]))
    d = runs(spark, sf_dir).select("key", "date", "n", grid.alias("g")).select("key", "date", "g.family", F.col("g.k").cast("string").alias("feature"), (F.col("n") + F.col("g.k")).alias("m"))
    return d.withColumn("status", F.when(F.col("m") % 3 == 0, "PASS").when(F.col("m") % 3 == 1, "WARNING").otherwise("FAIL")).withColumn("action", F.when(F.col("m") % 5 == 0, "watch").otherwise("trigger"))


_CASE = lambda table, col, default: "case " + col + " " + " ".join(f"when '{k}' then {v}" for k, v in table.items()) + f" else {default} end"


@query(f"""with {PROFILE}, gr as (select * from (values {", ".join(f"('{f}', {k})" for f, k in FAMILIES)}) v(family, k)), dg as (select p.key, p.date, family, n + k as m from policy_runs p, gr), fm as (select key, date, family, count(*) as features, {_CASE(policy.FAMILY_WEIGHTS, "family", 0)} as w from dg where m % 3 <> 0 and m % 5 <> 0 group by all),
fj as (select fm.*, regime = 'high_vol' and family in ('price_momentum', 'volume') or stable and family = 'calendar' as outd, stable and family = 'calendar' as by_stable from fm join pc on pc.key = fm.key and pc.date = fm.date),
sc as (select key, date, coalesce(sum(w) filter (not outd), 0) as score, sum(w) as raw_score, coalesce(sum(features) filter (not outd), 0) as features, count(*) filter (not outd) as families, coalesce(sum(features) filter (outd), 0) as suppressed_features, coalesce(sum(w) filter (features >= 2), 0) as s2, coalesce(sum(w) filter (not by_stable), 0) as ss, coalesce(string_agg(family, '|' order by family) filter (not outd), '') as trigger_families from fj group by all),
sj as (select pc.key, pc.date, regime, stable, coalesce(score, 0) as score, coalesce(raw_score, 0) as raw_score, coalesce(features, 0) as features, coalesce(families, 0) as families, coalesce(suppressed_features, 0) as suppressed_features, coalesce(s2, 0) as s2, coalesce(ss, 0) as ss, coalesce(trigger_families, '') as trigger_families, 2.45 * {_CASE(policy.DRIFT_MULTIPLIER, "regime", 1.15)} as threshold, 2.95 * {_CASE(policy.DRIFT_IMMEDIATE_MULTIPLIER, "regime", 1.10)} as t2 from pc left join sc on sc.key = pc.key and sc.date = pc.date)
select key, date, round(cast(score as double), 6) as score, round(cast(raw_score as double), 6) as raw_score, cast(features as bigint) as features, families, cast(suppressed_features as bigint) as suppressed_features, trigger_families, round(cast(threshold as double), 6) as threshold, (features >= 2 and families >= 2 and score >= threshold) or (families >= 1 and score >= t2) as triggered, s2 < threshold as family_rule_would_suppress, stable and ss < threshold as stable_rule_would_suppress, raw_score < 2.45 as low_vol_rule_would_suppress from sj""", "policy_runs")
def policy_drift_signal(spark, sf_dir):
    out = policy.drift_signal(diagnostics(spark, sf_dir), policy.transition_profile(runs(spark, sf_dir)))
    return rounded(out.select("key", "date", "score", "raw_score", "features", "families", "suppressed_features", "trigger_families", "threshold", "triggered", "family_rule_would_suppress", "stable_rule_would_suppress", "low_vol_rule_would_suppress"))


@query(f"""with po as (select *, {ORD} as ord, {BUCKET} as bucket, n % 3 = 0 as caused from policy_runs), ca as (select *, ord as o, 'calibration_ece:' || bucket as cause from po), cb as (select a.key, a.date, count(b.ord) as matches, coalesce(a.ord - min(b.ord), 0) as span from ca a left join ca b on b.key = a.key and b.caused and b.bucket = a.bucket and b.ord >= a.ord - 30 and b.ord < a.ord group by a.key, a.date, a.ord),
cc as (select po.*, matches, span, breaches >= 2 and breaches / 5.0 >= 0.4 * {_CASE(policy.BREACH_MULTIPLIER, "regime", 1.0)} as fold_persistent from po join cb on cb.key = po.key and cb.date = po.date)
select key, date, matches, cast(span as bigint) as span, fold_persistent, fold_persistent and matches + 1 >= 2 and span >= 10 as run_persistent, (fold_persistent and matches + 1 >= 2 and span >= 10) or (fold_persistent and ece >= 0.05 * 1.5) as triggered from cc""", "policy_runs")
def policy_calibration_signal(spark, sf_dir):
    r = runs(spark, sf_dir).withColumn("causes", F.when(F.col("n") % 3 == 0, F.array(F.concat(F.lit("calibration_ece:"), policy.regime_bucket(F.col("regime"))))).otherwise(F.array().cast("array<string>"))).withColumn("ratio", F.col("breaches") / 5.0)
    out = policy.calibration_signal(r, "calibration_ece", "ece", "breaches", "ratio", 0.05)
    return rounded(out.select("key", "date", "matches", "span", "fold_persistent", "run_persistent", "triggered"))


@query(f"""with po as (select *, {ORD} as ord, case when pbo < 0.2 then 'low_overfit_risk' when pbo < 0.5 then 'moderate_overfit_risk' when pbo < 0.8 then 'high_overfit_risk' else 'severe_overfit_risk' end as label from policy_runs),
pj as (select a.key, a.date, count(b.ord) as matches, coalesce(a.ord - min(b.ord), 0) as span from po a left join po b on b.key = a.key and b.ord >= a.ord - 45 and b.ord < a.ord and (b.pbo >= 0.6 or (b.n % 7 = 0 and b.label = a.label)) group by a.key, a.date, a.ord), pk as (select po.*, matches, span, pbo >= 0.6 and matches + 1 >= 3 and span >= 20 as persistent, pbo >= 0.85 and not competition as immediate from po join pj on pj.key = po.key and pj.date = po.date)
select key, date, matches, cast(span as bigint) as span, persistent, case when persistent or immediate then 'pbo' when pbo >= 0.85 then 'pbo_competition_watch' when pbo >= 0.6 then 'pbo_persistence_watch' else 'none' end as outcome from pk""", "policy_runs")
def policy_pbo_signal(spark, sf_dir):
    p = F.col("pbo")
    label = F.when(p < 0.2, policy.PBO_LABELS[0]).when(p < 0.5, policy.PBO_LABELS[1]).when(p < 0.8, policy.PBO_LABELS[2]).otherwise(policy.PBO_LABELS[3])
    r = runs(spark, sf_dir).withColumn("label", label).withColumn("causes", F.when(F.col("n") % 7 == 0, F.array(F.concat(F.lit("pbo:"), F.col("label")))).otherwise(F.array().cast("array<string>")))
    return rounded(policy.pbo_signal(r).select("key", "date", "matches", "span", "persistent", "outcome"))


TRIGGERS = {"feature_drift": "n % 2 = 0", "regime_shift": "shift_flag", "pbo": "pbo >= 0.8", "calibration_ece": "n % 9 = 0"}
CAUSES = {"feature_drift__volatility": "n % 2 = 0", "regime_shift__a": "shift_flag", "pbo__severe": "pbo >= 0.8", "calibration_ece__x": "n % 9 = 0"}
DECIDED = f"""po as (select *, {ORD} as ord, {BUCKET} as bucket, {listed(**TRIGGERS)} as triggers, {listed(**CAUSES)} as causes from policy_runs), pd as (select *, len(triggers) = 1 and list_contains(triggers, 'regime_shift') and state_probability >= 0.65 and transition_rate <= 0.15 as lone, list_contains(triggers, 'regime_shift') and not list_contains(triggers, 'feature_drift') as unconfirmed from po),
pe as (select *, case when lone or unconfirmed then list_filter(triggers, lambda x: x <> 'regime_shift') else triggers end as confirmed, list_transform(case when lone or unconfirmed then list_filter(causes, lambda x: not starts_with(x, 'regime_shift:')) else causes end, lambda x: x || '@' || bucket) as wanted, row_number() over (partition by key order by ord) as rn from pd),
fo as (select key, rn, len(wanted) > 0 as ok, case when len(wanted) > 0 then list_transform(wanted, lambda x: {{'c': x, 'o': ord}}) else [] end as hist from pe where rn = 1 union all
 select e.key, e.rn, q.ok, case when q.ok then list_filter(f.hist, lambda h: e.ord - h.o < 30) || list_transform(e.wanted, lambda x: {{'c': x, 'o': e.ord}}) else f.hist end from fo f join pe e on e.key = f.key and e.rn = f.rn + 1, lateral (select len(e.wanted) > 0 and len(list_filter(f.hist, lambda h: list_contains(e.wanted, h.c) and e.ord - h.o < 30)) = 0 as ok) q),
de as (select pe.*, fo.ok as should_retrain, case when len(triggers) = 0 then 'watch_only' when fo.ok then 'trigger' when len(confirmed) > 0 and len(wanted) > 0 then 'suppressed_by_cooloff' when lone then 'watch_regime_shift_only' else 'trigger' end as decision, case when fo.ok then confirmed else [] end as effective from pe join fo on fo.key = pe.key and fo.rn = pe.rn)"""


def decided(spark, sf_dir):
    return policy.decide(runs(spark, sf_dir).withColumn("triggers", names(**TRIGGERS)).withColumn("causes", names(**CAUSES)))


@query(f"with {DECIDED} select key, date, should_retrain, decision, array_to_string(list_sort(list_filter(triggers, lambda x: not list_contains(effective, x))), '|') as suppressed from de", "policy_runs")
def policy_decisions(spark, sf_dir):
    """Confirmation rules and the cool-off by cause and regime bucket, an ordered fold a key."""
    return decided(spark, sf_dir).select("key", "date", "should_retrain", "decision", F.array_join("suppressed", "|").alias("suppressed"))


@query(f"with {DECIDED}, h as (select key, date, bucket, decision as policy_decision, len(triggers) as base, len(effective) as eff, row_number() over (partition by key order by date desc) as rn from de) select key, bucket, policy_decision, count(*) as runs, cast(sum(base) as bigint) as base, cast(sum(eff) as bigint) as eff from h where rn <= 128 group by all", "policy_runs")
def policy_history_entries(spark, sf_dir):
    """The last 128 history entries of each ticker set, counted by what they hold."""
    h = audit.recent_history(policy.history_entry(decided(spark, sf_dir)), 128)
    return h.groupBy("key", "bucket", "policy_decision").agg(F.count(F.lit(1)).alias("runs"), F.sum(F.size("base_trigger_names").cast("bigint")).alias("base"), F.sum(F.size("effective_trigger_names").cast("bigint")).alias("eff"))


@query(f"with {DECIDED}, st as (select *, n % 4 = 0 as was, case when n % 4 = 0 then 'trigger' else 'watch_only' end as was_decision from de) select key, count(*) as runs, round(avg(should_retrain::int) - avg(was::int), 6) + 0.0 as rate_delta, count(*) filter (decision <> was_decision) as changed from st group by key", "policy_runs")
def policy_replay(spark, sf_dir):
    """The policy over all stored runs, against what they had decided."""
    d = decided(spark, sf_dir)
    stored = runs(spark, sf_dir).select("key", "date", (F.col("n") % 4 == 0).alias("should_retrain"), F.when(F.col("n") % 4 == 0, "trigger").otherwise("watch_only").alias("decision"))
    return rounded(policy.replay_delta(d, stored))


@query(f"with {DECIDED} select decision as value, count(*) as runs, count(*) filter (shift_flag) as shifted from de group by 1", "policy_runs")
def audit_value_counts(spark, sf_dir):
    d = decided(spark, sf_dir)
    some = audit.value_counts(d, "decision", F.col("shift_flag")).withColumnRenamed("runs", "shifted")
    return audit.value_counts(d, "decision").join(some, "value", "left").fillna({"shifted": 0})


@query(f"with {DECIDED}, c as (select unnest(triggers) as name from de) select name, count(*) as runs from c group by name order by runs desc, name limit 3", "policy_runs")
def audit_top_triggers(spark, sf_dir):
    """Top-k report: the three most frequent triggers."""
    return audit.top_items(audit.trigger_counts(decided(spark, sf_dir), "triggers"), "name", "runs", 3)


@query(f"with {DECIDED}, p as (select unnest(list_transform(generate_series(1, len(t) - 1), lambda i: list_transform(t[i + 1:], lambda b: {{'a': t[i], 'b': b}}))) as x from (select list_sort(list_distinct(triggers)) as t from de) q), r as (select unnest(x) as p from p) select p.a as a, p.b as b, count(*) as runs from r group by all", "policy_runs")
def audit_co_triggers(spark, sf_dir):
    return audit.co_triggers(decided(spark, sf_dir), "triggers")


@query(f"with {DECIDED} select key, count(*) filter (n % 4 = 0 and len(list_filter(effective, lambda x: x <> 'feature_drift')) = 0) as relieved, count(*) as runs from de group by key", "policy_runs")
def audit_relief(spark, sf_dir):
    return audit.relief_count(decided(spark, sf_dir), ["key"], F.col("n") % 4 == 0, "effective")


@query(f"with {DECIDED} select key, count(*) as runs, round(avg((len(triggers) > 0)::int), 6) as base_rate, round(avg(should_retrain::int), 6) as effective_rate, round(avg((n % 6 = 0)::int), 6) as news_fallback_rate from de group by key", "policy_runs")
def audit_rates(spark, sf_dir):
    return rounded(audit.rates(decided(spark, sf_dir), ["key"], {"base_rate": F.col("base_should_retrain"), "effective_rate": F.col("should_retrain"), "news_fallback_rate": F.col("n") % 6 == 0}))


@query(f"with {DECIDED}, x as (select unnest(list_filter(triggers, lambda x: not list_contains(effective, x)) || list_filter(triggers, lambda x: not list_contains(effective, x))) as name from de) select name, count(*) as runs from x group by name", "policy_runs")
def audit_watch_only(spark, sf_dir):
    return audit.watch_only(decided(spark, sf_dir), "triggers", "effective", "suppressed")


@query(f"with {DECIDED} select key, case when len(triggers) = 0 then 'none' when len(list_filter(triggers, lambda x: x <> 'calibration_ece')) = 0 then 'calibration_only' when list_contains(triggers, 'feature_drift') then 'drift' when list_contains(triggers, 'regime_shift') then 'regime' else 'other' end as class, count(*) as runs from de group by all", "policy_runs")
def audit_dominated_runs(spark, sf_dir):
    d = decided(spark, sf_dir)
    short = F.transform("triggers", lambda x: F.when(x == "calibration_ece", "calibration").when(x == "feature_drift", "drift").when(x == "regime_shift", "regime").otherwise(x))
    return d.groupBy("key", audit.run_class(short, short).alias("class")).agg(F.count(F.lit(1)).alias("runs"))


IMPORTANCE = "select key || date as run, family, (n * (k + 3)) % 17 / 17.0 as importance, (n + k) % 10 / 10.0 as missing_rate, (n + 2 * k) % 8 / 8.0 as stale_rate, 'src' || (k % 3) as source, 'f' || k as feature from policy_runs, gr"


def importance(spark, sf_dir):
    grid = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(k).alias("k")) for f, k in FAMILIES]))
    d = runs(spark, sf_dir).select(F.concat(F.col("key"), F.col("date").cast("string")).alias("run"), "n", grid.alias("g")).select("run", "n", "g.family", F.col("g.k").alias("k"))
    n, k = F.col("n"), F.col("k")
    return d.select("run", "family", ((n * (k + 3)) % 17 / 17.0).alias("importance"), ((n + k) % 10 / 10.0).alias("missing_rate"), ((n + 2 * k) % 8 / 8.0).alias("stale_rate"), F.concat(F.lit("src"), (k % 3).cast("string")).alias("source"), F.concat(F.lit("f"), k.cast("string")).alias("feature"))


GRID = f"gr as (select * from (values {', '.join(f"('{f}', {k})" for f, k in FAMILIES)}) v(family, k))"


@query(f"with {GRID}, im as ({IMPORTANCE}) select family, round(avg(importance), 7) as importance, round(avg(missing_rate), 7) as missing_rate, round(avg(stale_rate), 7) as stale_rate, string_agg(distinct source, '|' order by source) as sources, count(distinct run) as runs from im group by family", "policy_runs")
def audit_family_contribution(spark, sf_dir):
    return rounded(audit.family_contribution(importance(spark, sf_dir)), 7)


@query(f"with {GRID}, im as ({IMPORTANCE}) select feature, family, round(avg(missing_rate), 7) as missing_rate, round(avg(stale_rate), 7) as stale_rate, count(*) as runs from im group by all order by avg(missing_rate) desc, avg(stale_rate) desc, feature limit 5", "policy_runs")
def audit_worst_features(spark, sf_dir):
    """Top-k report: the five features with the highest mean missing and stale rates."""
    return rounded(audit.catalog_across_runs(importance(spark, sf_dir), 5), 7)


RISK = """rk as (select key, date, n % 20 / 100.0 as stale_ratio, n % 9 as critical, n % 4 as warning, state_probability as concentration, n % 6 = 0 as retrain, shift_flag, regime, -transition_rate as max_drawdown, case when n % 10 = 0 then 'null_random_walk' end as dummy from policy_runs)"""


@query(f"""with {RISK}, ck as (select *, [case when stale_ratio > 0.1 then 'WARNING' else 'PASS' end, case when critical > 7 and dummy is null then 'FAIL' when critical > 7 or warning > 2 then 'WARNING' else 'PASS' end, case when concentration > 0.75 then 'WARNING' else 'PASS' end, case when retrain then 'WARNING' else 'PASS' end, case when shift_flag or regime = 'transition' then 'WARNING' else 'PASS' end] as c from rk),
cw as (select *, len(list_filter(c, lambda x: x = 'WARNING')) as warnings, list_contains(c, 'FAIL') as failed from ck), rv as (select *, case when failed then 'CRITICAL' when max_drawdown < -0.12 or warnings >= 2 then 'HIGH' when warnings > 0 then 'MEDIUM' when dummy is not null then 'MEDIUM' else 'LOW' end as risk_level from cw)
select risk_level, case when failed then 'BLOCKED' when risk_level in ('HIGH', 'MEDIUM') then 'MANUAL_REVIEW_REQUIRED' else 'AUTO_APPROVED' end as approval, count(*) as runs, cast(sum(warnings) as bigint) as warnings from rv group by all""", "policy_runs")
def audit_risk_review(spark, sf_dir):
    n = F.col("n")
    r = runs(spark, sf_dir).select("key", "date", (n % 20 / 100.0).alias("stale_ratio"), F.greatest(n % 9 - 7, F.lit(0)).alias("critical"), F.greatest(n % 4 - 2, F.lit(0)).alias("warning"), F.col("state_probability").alias("concentration"), (n % 6 == 0).alias("retrain"), "shift_flag", "regime", (-F.col("transition_rate")).alias("max_drawdown"), F.when(n % 10 == 0, "null_random_walk").alias("dummy"))
    return audit.risk_review(r, 0.12).groupBy("risk_level", "approval").agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col("warnings").cast("bigint")).alias("warnings"))


@query("select date, ticker, round(c, 9) as confidence from (select date, ticker, greatest(prob_down, prob_flat, prob_up) as c, row_number() over (partition by date order by round(greatest(prob_down, prob_flat, prob_up), 9) desc, ticker) as rn from scores) t where rn = 1", "scores")
def audit_highest_confidence(spark, sf_dir):
    s = view(spark, sf_dir, "scores")
    return rounded(audit.highest_confidence(s, ["date"], "ticker", F.round(F.greatest("prob_down", "prob_flat", "prob_up"), 9)), 9)


@query("with m as (select key, regime, avg(pbo) as pbo, avg(ece) as ece from policy_runs group by all), a as (select * from m where regime = 'low_vol'), b as (select * from m where regime = 'high_vol') select coalesce(a.key, b.key) as key, round(coalesce(a.pbo, 0) - coalesce(b.pbo, 0), 9) + 0.0 as pbo_delta, round(coalesce(a.ece, 0) - coalesce(b.ece, 0), 9) + 0.0 as ece_delta from a full join b on a.key = b.key", "policy_runs")
def audit_deltas(spark, sf_dir):
    m = runs(spark, sf_dir).groupBy("key", "regime").agg(F.avg("pbo").alias("pbo"), F.avg("ece").alias("ece"))
    return rounded(audit.deltas(m.where("regime = 'low_vol'"), m.where("regime = 'high_vol'"), ["key"], ["pbo", "ece"]), 9)


@query("select key, " + ", ".join(f"round(avg(pbo) filter (regime = '{m}'), 9) as {m}_pbo, round(avg(ece) filter (regime = '{m}'), 9) as {m}_ece" for m in ("low_vol", "transition", "high_vol")) + " from policy_runs group by key", "policy_runs")
def audit_side_by_side(spark, sf_dir):
    m = runs(spark, sf_dir).groupBy("key", "regime").agg(F.avg("pbo").alias("pbo"), F.avg("ece").alias("ece"))
    return rounded(audit.side_by_side(m, ["key"], "regime", ["low_vol", "transition", "high_vol"], ["pbo", "ece"]), 9)


@query("with r as (select key, date, n from policy_runs), b as (select key, date, pbo from policy_runs where n % 2 = 0), c as (select key, date, ece from policy_runs where n % 3 = 0) select r.key || '@' || r.date as run_id, b.key is not null as has_backtest, c.key is not null as has_batch, b.pbo as backtest_pbo, c.ece as batch_ece from r left join b on b.key = r.key and b.date = r.date left join c on c.key = r.key and c.date = r.date", "policy_runs")
def audit_linked_artifacts(spark, sf_dir):
    r = runs(spark, sf_dir).withColumn("run_id", F.concat_ws("@", "key", F.col("date").cast("string")))
    out = audit.linked(r.select("run_id"), {"backtest": r.where("n % 2 = 0").select("run_id", "pbo"), "batch": r.where("n % 3 = 0").select("run_id", "ece")})
    return out.select("run_id", "has_backtest", "has_batch", "backtest_pbo", "batch_ece")


@query("select key || '@' || date as run_id, n as trades, round(pbo, 9) as pbo, regime, cast(null as varchar) as news_source from policy_runs", "policy_runs")
def audit_flat_runs(spark, sf_dir):
    """Run documents as nested JSON, read with a schema and flattened; a path that they lack is null."""
    r = runs(spark, sf_dir)
    doc = F.to_json(F.struct(F.struct(F.concat_ws("@", "key", F.col("date").cast("string")).alias("id"), F.struct("regime").alias("context")).alias("run"), F.struct("pbo", F.col("n").alias("trades")).alias("metrics")))
    parsed = r.select(F.from_json(doc, "run struct<id: string, context: struct<regime: string>>, metrics struct<pbo: double, trades: bigint>").alias("d")).select("d.*")
    return rounded(audit.flat_run(parsed, {"run_id": "run.id", "trades": "metrics.trades", "pbo": "metrics.pbo", "regime": "run.context.regime", "news_source": "run.news.source"}), 9)


@query("with m as (select key, avg(pbo) as pbo, avg(ece) as ece, avg(transition_rate) as rate from policy_runs group by key), l as (select key, 'pbo' as metric, pbo as value from m union all select key, 'ece', ece from m union all select key, 'rate', rate from m), r as (select * from (values ('pbo', 0.3, 'warning', 2), ('ece', 0.01, 'info', 1), ('rate', 0.07, 'critical', 3)) v(metric, threshold, severity, lv)), f as (select key, l.metric, severity, lv from l join r on r.metric = l.metric where value >= threshold) select key as run, count(*) as findings, max_by(severity, lv) as severity, string_agg(distinct metric, '|' order by metric) as metrics from f group by key", "policy_runs")
def audit_alerts(spark, sf_dir):
    m = runs(spark, sf_dir).groupBy(F.col("key").alias("run")).agg(F.avg("pbo").alias("pbo"), F.avg("ece").alias("ece"), F.avg("transition_rate").alias("rate"))
    rules = spark.createDataFrame([("pbo", ">=", 0.3, "warning"), ("ece", ">=", 0.01, "info"), ("rate", ">=", 0.07, "critical")], "metric string, op string, threshold double, severity string")
    return audit.alerts(m.unpivot(["run"], ["pbo", "ece", "rate"], "metric", "value"), rules)


_FOLDS = f"(breaches >= 2 and breaches / 5.0 >= 0.4 * {_CASE(policy.BREACH_MULTIPLIER, 'regime', 1.0)})"
REPLAY_SQL = f"""rp as (select key, date, {ORD} as ord, {BUCKET} as bucket, case when n % 4 = 0 then ['feature_drift:volatility'] else cast([] as varchar[]) end as dc, case when shift_flag then 'regime_shift:a' end as sc, {_FOLDS} as folds, ece >= 0.05 * 1.5 as hot, pbo, competition, 'pbo:' || case when pbo < 0.2 then 'low_overfit_risk' when pbo < 0.5 then 'moderate_overfit_risk' when pbo < 0.8 then 'high_overfit_risk' else 'severe_overfit_risk' end as pc,
 state_probability >= 0.65 and transition_rate <= 0.15 as settled, row_number() over (partition by key order by {ORD}) as rn from policy_runs),
st as (select key, cast(0 as bigint) as rn, cast(null as date) as date, cast(0 as bigint) as cm, cast(0 as bigint) as pm, cast([] as varchar[]) as names, cast([] as varchar[]) as causes, cast([] as varchar[]) as eff, '' as decision, cast([] as struct(o bigint, b varchar, c varchar[], p double, did boolean, e varchar[])[]) as hist from (select distinct key from rp) t
 union all select key, rn, date, cm, pm, names, causes, eff, decision, (hist || [{{'o': cast(ord as bigint), 'b': bucket, 'c': causes, 'p': cast(pbo as double), 'did': len(eff) > 0, 'e': case when len(eff) > 0 then kept when decision = 'suppressed_by_cooloff' then [] else kept end}}])[-128:] from
 (select *, case when cooling then [] else conf end as eff, case when len(names) = 0 then 'watch_only' when len(conf) > 0 and not cooling then 'trigger' when len(conf) > 0 then 'suppressed_by_cooloff' when len(names) = 1 and settled then 'watch_regime_shift_only' else 'trigger' end as decision from
 (select *, len(conf) > 0 and len(list_filter(hist, lambda h: h.did and h.b = bucket and ord - h.o < 30 and len(list_intersect(h.e, kept)) > 0)) > 0 as cooling from
 (select *, case when list_contains(names, 'regime_shift') and not list_contains(names, 'feature_drift') then list_filter(names, lambda x: x <> 'regime_shift') else names end as conf, case when list_contains(names, 'regime_shift') and not list_contains(names, 'feature_drift') then list_filter(causes, lambda x: not starts_with(x, 'regime_shift:')) else causes end as kept from
 (select *, list_filter([case when len(dc) > 0 then 'feature_drift' end, case when cal then 'calibration_ece' end, case when sc is not null then 'regime_shift' end, case when over then 'pbo' end], lambda x: x is not null) as names, dc || list_filter([case when cal then 'calibration_ece:' || bucket end, sc, case when over then pc end], lambda x: x is not null) as causes from
 (select *, folds and (hot or (cm >= 1 and ord - cf >= 10)) as cal, (pbo >= 0.6 and pm >= 2 and ord - pf >= 20) or (pbo >= 0.85 and not competition) as over from
 (select *, len(seen) as cm, list_min(list_transform(seen, lambda h: h.o)) as cf, len(held) as pm, list_min(list_transform(held, lambda h: h.o)) as pf from
 (select rp.*, st.hist, list_filter(st.hist, lambda h: rp.ord - h.o <= 30 and list_contains(h.c, 'calibration_ece:' || rp.bucket)) as seen, list_filter(st.hist, lambda h: rp.ord - h.o <= 45 and (h.p >= 0.6 or list_contains(h.c, rp.pc))) as held from st join rp on rp.key = st.key and rp.rn = st.rn + 1) a) b) c) d) e) f) g)"""


def replay_runs(spark, sf_dir):
    r, p = runs(spark, sf_dir), F.col("pbo")
    label = F.when(p < 0.2, policy.PBO_LABELS[0]).when(p < 0.5, policy.PBO_LABELS[1]).when(p < 0.8, policy.PBO_LABELS[2]).otherwise(policy.PBO_LABELS[3])
    drift = F.when(F.col("n") % 4 == 0, F.array(F.lit("feature_drift:volatility"))).otherwise(F.array().cast("array<string>"))
    return r.withColumns({"drift_causes": drift, "shift_cause": F.when(F.col("shift_flag"), "regime_shift:a"), "ratio": F.col("breaches") / 5.0, "label": label})


@query(f"with {REPLAY_SQL} select key, date, cm as calibration_matches, pm as pbo_matches, array_to_string(names, '|') as base, array_to_string(eff, '|') as effective, decision, len(eff) > 0 as should_retrain from st where rn > 0", "policy_runs")
def policy_replay_feedback(spark, sf_dir):
    """The replay whose own causes are the history of later runs."""
    out = policy.replay(replay_runs(spark, sf_dir))
    return out.select("key", "date", "calibration_matches", "pbo_matches", F.array_join("base", "|").alias("base"), F.array_join("effective", "|").alias("effective"), "decision", "should_retrain")


def _leaf_rule(i: int, kind: str) -> tuple[str, str]:
    """(value, JSON text) of the i-th field of a stored run, as SQL over n; every fifth is missing, and some hold another type."""
    gone, other = f"(n + {i}) % 5 = 0", f"(n + {i}) % 13 = 0"
    value = {"double": f"cast((n * {i + 1}) % 11 as double) / 8", "bigint": f"cast((n * {i + 1}) % 7 as bigint)", "boolean": f"(n + {i}) % 2 = 0", "string": f"concat('v', cast((n + {i}) % 3 as string))"}.get(kind)
    if kind == "array<string>":
        return f"case when {gone} then '' else concat('a|b', cast((n + {i}) % 3 as string)) end", f"case when {gone} then null else concat('[\"a\",\"b', cast((n + {i}) % 3 as string), '\"]') end"
    text = f"concat('\"', {value}, '\"')" if kind == "string" else f"cast({value} as string)"
    odd = f"when {other} then '[\"bad\"]' " if kind != "string" else ""
    return f"case when {gone} {'or ' + other if odd else ''} then null else {value} end", f"case when {gone} then null {odd}else {text} end"


def _document() -> str:
    """SQL text that makes the JSON document of a run."""
    tree: dict = {}
    for i, (_, path, kind, _) in enumerate(audit.run_fields()):
        *above, name = path.split(".")
        at = tree
        for part in above:
            at = at.setdefault(part, {})
        at[name] = _leaf_rule(i, kind)[1]
    tree["news_coverage_analysis"]["lookback_windows"] = "concat('[{\"window_days\":1,\"coverage\":', cast(cast(n % 4 as double) / 4 as string), '},{\"window_days\":3,\"coverage\":0.5,\"abs_ic\":', cast(cast(n % 8 as double) / 8 as string), '}]')"
    tree["backtest"]["feature_catalog"] = "case when n % 3 = 0 then null else concat('[{\"feature_family\":\"news\",\"missing_rate\":0.25,\"stale_rate\":', cast(cast(n % 2 as double) / 2 as string), '},{\"feature_family\":\"price\",\"missing_rate\":1}]') end"

    def text(node) -> str:
        parts = [f"concat('\"{k}\":', {text(v) if isinstance(v, dict) else v})" for k, v in node.items()]
        return f"concat('{{', concat_ws(',', {', '.join(parts)}), '}}')"

    return text(tree)


def _flat_sql() -> str:
    def shown(c: str, kind: str, rule: str, default) -> str:
        rule = rule.replace(" as string)", " as varchar)")
        none = {"string": f"'{default}'", "boolean": "false", "array<string>": "''"}.get(kind, str(default))
        return f"coalesce({rule}, {none}) as {c}"

    columns = [shown(c, k, _leaf_rule(i, k)[0], d) for i, (c, _, k, d) in enumerate(audit.run_fields())]
    zero = [f"0.0::double as {c}" for c in ("news_abs_ic_lookback_1d", *[f"news_{f}_lookback_{n}d" for n in (5, 10) for f in ("coverage", "abs_ic")], *[f"news_decay_{f}_halflife_{n}d" for n in (3, 5) for f in ("coverage", "abs_ic")])]
    rates = ["case when n % 3 = 0 then 1.0::double else 0.25 end as news_feature_missing_rate", "case when n % 3 = 0 then 0.0::double else 0.75 end as news_feature_coverage", "case when n % 3 = 0 then 0.0::double else (n % 2) / 2.0::double end as news_feature_stale_rate"]
    return "select key, date, " + ", ".join([*columns, "(n % 4) / 4.0::double as news_coverage_lookback_1d", "0.5::double as news_coverage_lookback_3d", "(n % 8) / 8.0::double as news_abs_ic_lookback_3d", *zero, *rates]) + " from policy_runs"


@query(_flat_sql(), "policy_runs")
def audit_flat_documents(spark, sf_dir):
    """Run documents, written as JSON text and read back, to flat rows of about 120 columns."""
    path = landed.shared_folder(spark, "run-documents")
    landed.write_artifacts(runs(spark, sf_dir).select("key", F.col("date").cast("string").alias("date"), F.lit("all").alias("part"), F.expr(_document()).alias("document")), path, "part")
    back = landed.read_artifacts(spark, path, "key string, date date, document string").drop("part")
    out = audit.flat_documents(back, "document")
    return out.select(*[F.array_join(c, "|").alias(c) if t == "array<string>" else F.col(c) for c, t in out.dtypes])


@query("with a as (select key, n, 'w' || cast(weekofyear(date) % 20 as varchar) as week_id from policy_runs) select week_id, count(*) as rows, cast(sum(case when week_id in ('w1', 'w3') then n + 1 else n end) as bigint) as total from a group by week_id", "policy_runs")
def source_artifact_folders(spark, sf_dir):
    """Artifacts by week folder: all written, all written again, two weeks written anew with other numbers, and read back."""
    path = landed.shared_folder(spark, "artifacts")
    rows = runs(spark, sf_dir).select("key", "n", F.concat(F.lit("w"), (F.weekofyear("date") % 20).cast("string")).alias("week_id"))
    landed.write_artifacts(rows, path, "week_id")
    landed.write_artifacts(rows, path, "week_id")
    landed.write_artifacts(rows.where("week_id in ('w1', 'w3')").withColumn("n", F.col("n") + 1), path, "week_id")
    back = landed.read_artifacts(spark, path, "key string, n bigint, week_id string")
    return rounded(back.groupBy("week_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total")))


@query("""with o as (select o_orderkey, o_orderpriority as p, case o_orderpriority when '1-URGENT' then 'first' when '2-HIGH' then 'second' when '3-MEDIUM' then 'third' end as source from orders where o_orderpriority < '4'), g as (select * from o where source = 'first' or (source = 'second' and o_orderkey % 10 <> 1)),
x as (select source, count(*) as rows, cast(sum(o_orderkey) as bigint) as total from g group by source), b as (select source, count(*) as broken from o where source = 'third' or (source = 'second' and o_orderkey % 10 = 1) group by source)
select n.source, case n.source when 'fourth' then 'missing' when 'third' then 'failed' when 'second' then 'partial' else 'ok' end as status, coalesce(rows, 0) as rows, coalesce(broken, 0) as broken, total from (values ('first'), ('second'), ('third'), ('fourth')) n(source) left join x on x.source = n.source left join b on b.source = n.source""")
def source_tolerant_union(spark, sf_dir):
    """Four landed sources: one whole, one with broken lines, one that is no JSON at all, one that is not there."""
    o = table(spark, sf_dir, "orders")
    good = F.to_json(F.struct("o_orderkey", "o_orderpriority"))
    rules = {"first": ("1-URGENT", good), "second": ("2-HIGH", F.when(F.col("o_orderkey") % 10 == 1, F.substring(good, 1, 14)).otherwise(good)), "third": ("3-MEDIUM", F.concat(F.lit("<"), good))}
    path, sources = landed.shared_folder(spark, "sources"), {}
    for name, (priority, text) in rules.items():
        sources[name] = f"{path}/{name}"
        o.where(F.col("o_orderpriority") == priority).select(text.alias("value")).write.text(sources[name])
    rows, status = landed.union_landed(spark, sources | {"fourth": f"{path}/fourth"}, "o_orderkey bigint, o_orderpriority string")
    return status.join(rows.groupBy("source").agg(F.sum("o_orderkey").alias("total")), "source", "left")


@query(f"""with {RISK}, ck as (select *, case when critical > 7 and dummy is null then 'FAIL' when critical > 7 or warning > 2 then 'WARNING' else 'PASS' end as drift from rk), lg as (select key, date, unnest([{{'n': 'data_freshness', 's': case when stale_ratio > 0.1 then 'WARNING' else 'PASS' end, 'm': cast(stale_ratio as double), 't': 0.1::double}}, {{'n': 'feature_drift', 's': drift, 'm': (critical + 1) / 20.0::double, 't': case when drift = 'FAIL' then 0.25::double else 0.2::double end}},
 {{'n': 'prediction_concentration', 's': case when concentration > 0.75 then 'WARNING' else 'PASS' end, 'm': concentration, 't': 0.75::double}}, {{'n': 'model_staleness', 's': case when retrain then 'WARNING' else 'PASS' end, 'm': retrain::int::double, 't': 1.0::double}}, {{'n': 'regime_consistency', 's': case when shift_flag or regime = 'transition' then 'WARNING' else 'PASS' end, 'm': concentration, 't': 0.6::double}}, {{'n': 'liquidity_check', 's': 'PASS', 'm': null, 't': null}}, {{'n': 'hallucination_guard', 's': 'PASS', 'm': null, 't': null}}, {{'n': 'source_integrity', 's': 'PASS', 'm': null, 't': null}}]) as x from ck)
select x.n as check_name, x.s as status, count(*) as runs, round(avg(x.m), 6) as mean_metric, round(max(x.t), 6) as threshold from lg group by all""", "policy_runs")
def audit_risk_checks(spark, sf_dir):
    """All eight risk checks by name and state."""
    n = F.col("n")
    r = runs(spark, sf_dir).select("key", "date", (n % 20 / 100.0).alias("stale_ratio"), F.greatest(n % 9 - 7, F.lit(0)).alias("critical"), F.greatest(n % 4 - 2, F.lit(0)).alias("warning"), F.col("state_probability").alias("concentration"), "state_probability", (n % 6 == 0).alias("retrain"), (n % 6 == 0).cast("int").alias("trigger_count"), ((n % 9 + 1) / 20.0).alias("max_psi"), "shift_flag", "regime", (-F.col("transition_rate")).alias("max_drawdown"), F.when(n % 10 == 0, "null_random_walk").alias("dummy"))
    rows = audit.risk_checks(audit.risk_review(r, 0.12), ["key", "date"])
    return rounded(rows.groupBy("check_name", "status").agg(F.count(F.lit(1)).alias("runs"), F.avg("metric_value").alias("mean_metric"), F.max("threshold").alias("threshold")))
