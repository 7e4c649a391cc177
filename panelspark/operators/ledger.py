"""Transaction costs and a trade ledger as table updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.calendar import bday_add, iso_week


def market_impact(notional: Column, adv: Column, vol: Column, cap: float, eta: float = 0.142, gamma: float = 0.314) -> tuple[Column, Column]:
    """(temporary, permanent) impact in basis points: square root and linear in the share of daily volume; 0 for bad inputs."""
    ok = (notional > 0) & (adv > 0) & (vol > 0)
    share = F.try_divide(notional, F.when(adv > 0, adv))
    temporary = F.lit(eta) * vol * F.sqrt(share / max(cap, 1e-9)) * 1e4
    permanent = F.lit(gamma) * vol * share * 1e4
    return F.when(ok, temporary).otherwise(0.0), F.when(ok, permanent).otherwise(0.0)


def cost_estimate(orders: DataFrame, spread_bps: float, commission_bps: float, cap: float, slices: int = 4) -> DataFrame:
    """orders (order_type, notional, adv, vol, urgency) plus fill_rate, cost_bps: market and TWAP fill whole, TWAP with the
    impact of one slice; a limit order fills the share of the needed cross that its threshold pays."""
    kind, half = F.col("order_type"), spread_bps / 2
    total = lambda n: sum(market_impact(n, F.col("adv"), F.col("vol"), cap))
    needed = F.greatest(total(F.col("notional")) + half, F.lit(1e-9))
    threshold = F.greatest(half * F.greatest(F.least("urgency", F.lit(1.0)), F.lit(0.1)), F.lit(0.01))
    fill = F.when(kind == "limit", F.least(threshold / needed, F.lit(1.0))).otherwise(1.0)
    df = orders.withColumn("fill_rate", fill).withColumn("filled_notional", F.greatest("notional", F.lit(0.0)) * F.col("fill_rate"))
    impact = F.when(kind == "twap", total(F.col("notional") / slices)).otherwise(total(F.col("filled_notional")))
    spread = F.when(kind == "limit", F.least(threshold, F.lit(half))).otherwise(half)
    return df.withColumn("cost_bps", spread + impact + commission_bps)


def capacity_fill(df: DataFrame, cap: float) -> DataFrame:
    """Fill limited to a share of daily volume; fill_state full, partial or blocked."""
    room = F.greatest(F.col("adv") * cap, F.lit(0.0))
    df = df.withColumn("filled", F.least("notional", F.coalesce(room, F.lit(0.0))))
    return df.withColumn("fill_state", F.when(F.col("filled") <= 0, "blocked").when(F.col("filled") < F.col("notional"), "partial").otherwise("full"))


def adverse_gap_bps(direction: Column, signal: Column, price: Column) -> Column:
    move = F.try_divide(price, F.when(signal > 0, signal)) - 1
    return F.when((signal <= 0) | (price <= 0), 0.0).when(direction == "UP", F.greatest(move, F.lit(0.0)) * 1e4).when(direction == "DOWN", F.greatest(-move, F.lit(0.0)) * 1e4).otherwise(0.0)


def queue_trades(scores: DataFrame, market: DataFrame, horizon: int, notional: float) -> DataFrame:
    """Forecasts to ledger rows: QUEUED for the next business day, settled after the horizon; SKIPPED with a reason."""
    df = scores.join(market, ["ticker", "date"], "left")
    reason = F.when(F.col("direction") == "FLAT", "flat_forecast").when(F.col("close").isNull(), "no_price").when(F.coalesce("adv_20d", F.lit(0.0)) <= 0, "no_volume")
    df = df.withColumn("skip_reason", reason).withColumn("status", F.when(reason.isNotNull(), "SKIPPED").otherwise("QUEUED"))
    df = df.withColumn("execute_on", bday_add(F.col("date"), 1)).withColumn("settle_on", bday_add(bday_add(F.col("date"), 1), horizon))
    return df.withColumn("notional", F.lit(float(notional))).withColumn("quantity", F.when(F.col("status") == "QUEUED", F.try_divide(F.lit(float(notional)), "close")))


def execute_due(ledger: DataFrame, bars: DataFrame, as_of: Column) -> DataFrame:
    """Due QUEUED rows with a bar take its open and become PENDING."""
    b = bars.select("ticker", F.col("date").alias("execute_on"), F.col("open").alias("__open"))
    df = ledger.join(b, ["ticker", "execute_on"], "left")
    due = (F.col("status") == "QUEUED") & (F.col("execute_on") <= as_of) & F.col("__open").isNotNull()
    return df.withColumn("execution_price", F.when(due, F.col("__open"))).withColumn("status", F.when(due, "PENDING").otherwise(F.col("status"))).drop("__open")


def settle_due(ledger: DataFrame, bars: DataFrame, as_of: Column, threshold: float, cost_bps: float) -> DataFrame:
    """Due PENDING rows with a bar settle at its close: returns, realised direction (r >= t is UP), hit."""
    b = bars.select("ticker", F.col("date").alias("settle_on"), F.col("close").alias("__close"))
    df = ledger.join(b, ["ticker", "settle_on"], "left")
    due = (F.col("status") == "PENDING") & (F.col("settle_on") <= as_of) & F.col("__close").isNotNull()
    r = F.try_divide("__close", "execution_price") - 1
    realised = F.when(r <= -threshold, "DOWN").when(r >= threshold, "UP").otherwise("FLAT")
    directional = F.when(F.col("direction") == "UP", r).when(F.col("direction") == "DOWN", -r).otherwise(0.0)
    df = df.withColumn("asset_return", F.when(due, r)).withColumn("net_return", F.when(due, directional - cost_bps / 1e4))
    df = df.withColumn("hit", F.when(due, realised == F.col("direction"))).withColumn("status", F.when(due, "SETTLED").otherwise(F.col("status")))
    return df.drop("__close")


def weekly_review(ledger: DataFrame) -> DataFrame:
    """By ISO week of the forecast: counts by status, mean net return, hit rate."""
    return ledger.groupBy(iso_week(F.col("date")).alias("week_id")).agg(F.count(F.lit(1)).alias("trades"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("QUEUED", "PENDING", "SETTLED", "SKIPPED")], F.avg("net_return").alias("mean_net_return"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def execution_diagnostics(fills: DataFrame, by: list[str]) -> DataFrame:
    """fills (status, quantity, filled_quantity, notional, executed_notional, cost_bps, gap_bps) -> of rows that are not queued
    and were meant to trade: fill, partial and miss rates, exposure, and notional-weighted drag and gap."""
    x = fills.where((F.col("status") != "QUEUED") & (F.col("quantity") > 0))
    filled = F.col("filled_quantity") > 0
    per = lambda a, b: F.coalesce(F.try_divide(a, F.when(b > 0, b)), F.lit(0.0))
    n, done = F.count(F.lit(1)), F.sum(F.when(filled, F.col("executed_notional")))
    partial, missed = F.count_if(filled & (F.col("filled_quantity") < F.col("quantity"))), F.count_if(~filled)
    return x.groupBy(*by).agg(n.alias("intended_trades"), F.count_if(filled).alias("filled_trades"), per(F.sum("filled_quantity"), F.sum("quantity")).alias("fill_rate"), per(partial.cast("double"), n).alias("partial_fill_rate"), per(missed.cast("double"), n).alias("missed_trade_rate"), per(F.sum("executed_notional"), F.sum("notional")).alias("realized_vs_intended"), per(F.sum(F.when(filled, F.col("cost_bps") * F.col("executed_notional"))), done).alias("cost_drag_bps"), per(F.sum(F.when(filled, F.col("gap_bps") * F.col("executed_notional"))), done).alias("gap_slippage_bps"))


def retraining_events(runs: DataFrame) -> DataFrame:
    """Ledger rows of the runs that retrain: key, date, ISO week, sorted trigger names and causes."""
    return runs.where("should_retrain").select("key", "date", iso_week(F.col("date")).alias("week_id"), F.array_sort("triggers").alias("trigger_names"), F.array_sort("causes").alias("cause_keys"))
