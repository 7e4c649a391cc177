"""Queries over books, overfitting, ledger, filings, news and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.calendar import session_alignment
from panelspark.operators import audit, books, events, folds, fundamentals, ledger, news, overfit
from panelspark.operators.features import market_context
from panelspark.plans.fixtures import kept, table, view, with_views
from panelspark.plans.forecast_queries import labelled
from panelspark.plans.panel_queries import bars, rounded

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str = "", *views: str):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return put


BOOK_SQL = """sc as (select ticker, date, round(prob_down, 10) as prob_down, round(prob_flat, 10) as prob_flat, round(prob_up, 10) as prob_up, round(prob_up - prob_down, 8) as signal from scores),
ct as (select *, count(*) over (partition by date) as n, greatest(prob_down - prob_up, -signal) as se from sc),
ed as (select ticker, date, signal, n, 'rank_long_short' as strategy, 'long' as side, signal as edge from ct where signal >= 0.01 union all select ticker, date, signal, n, 'rank_long_short', 'short', se from ct where se >= 0.01 union all select ticker, date, signal, n, 'rank_long_only', 'long', signal from ct where signal >= 0.01),
gd as (select s as strategy, f as fraction, h as holding, concat(s, '|', f, '|', h) as candidate from (values ('rank_long_short'), ('rank_long_only')) a(s), (values (0.1::double), (0.3::double)) b(f), (values (1), (3)) c(h)),
rk as (select gd.candidate, holding, gd.strategy, date, side, ticker, row_number() over (partition by candidate, date, side order by edge desc, case when side = 'long' then -signal else signal end, ticker) as rn, greatest(1, round_even(n * fraction, 0)) as k from ed join gd on gd.strategy = ed.strategy),
tp as (select * from rk where rn <= k), sd as (select candidate, date, count(distinct side) as sides from tp group by all),
kp as (select tp.* from tp join sd on sd.candidate = tp.candidate and sd.date = tp.date where strategy = 'rank_long_only' or sides = 2),
tg as (select candidate, holding, date, ticker, sum(w) as weight from (select *, case when side = 'long' then 1.0 else -1.0 end / count(*) over (partition by candidate, date, side) as w from kp) t group by all),
di as (select date, row_number() over (order by date) - 1 as idx from (select distinct date from sc) t), hd as (select candidate, i as idx, ticker, sum(weight / holding) as weight from (select candidate, holding, ticker, weight, unnest(range(idx, idx + holding)) as i from tg join di on di.date = tg.date) t group by all),
rt as (select ticker, date, round(lead(close) over (partition by ticker order by date) / close - 1, 9) as ret from daily_bars), mv as (select candidate, idx, ticker, weight as d from hd union all select candidate, idx + 1, ticker, -weight from hd),
tn as (select candidate, idx, sum(abs(d)) / 2 as turnover from (select candidate, idx, ticker, sum(d) as d from mv group by all) t group by all),
gr as (select hd.candidate, hd.idx, sum(weight * coalesce(ret, 0)) as gross, count(*) as names, sum(abs(weight)) as exposure from hd join di on di.idx = hd.idx left join rt on rt.ticker = hd.ticker and rt.date = di.date group by all),
dy as (select tn.candidate, tn.idx, turnover, coalesce(gross, 0) as gross, coalesce(names, 0) as names, coalesce(exposure, 0) as exposure, coalesce(gross, 0) - turnover * 10 / 1e4 as net from tn left join gr on gr.candidate = tn.candidate and gr.idx = tn.idx where tn.idx <= (select max(idx) from di))"""


def book_parts(spark, sf_dir):
    scores = labelled(spark, sf_dir)
    days = folds.date_index(scores)
    grid = books.candidate_grid(spark, ["rank_long_short", "rank_long_only"], [0.1, 0.3], [1, 3])
    targets = kept(spark, sf_dir, "books", lambda: books.target_books(books.side_edges(scores, 0.0, 0.01), grid))
    dates = kept(spark, sf_dir, "book dates", lambda: days)
    return targets, dates, scores.select("ticker", "date", F.col("future_simple_return").alias("ret")), grid


def book_days(spark, sf_dir):
    """Daily results of all candidates."""
    targets, dates, rets, _ = book_parts(spark, sf_dir)
    return kept(spark, sf_dir, "book days", lambda: books.daily_results(books.held_books(targets, dates), rets, dates, 10))


@query("with " + BOOK_SQL + " select candidate, date, count(*) as names, round(sum(abs(weight)), 6) as exposure, round(sum(weight), 6) + 0.0 as net_exposure from tg group by all", "daily_bars", "scores")
def book_targets(spark, sf_dir):
    out = book_parts(spark, sf_dir)[0].groupBy("candidate", "date").agg(F.count(F.lit(1)).alias("names"), F.sum(F.abs("weight")).alias("exposure"), F.sum("weight").alias("net_exposure"))
    return rounded(out)


@query("with " + BOOK_SQL + " select candidate, idx, round(turnover, 9) as turnover, round(gross, 9) + 0.0 as gross, round(net, 9) + 0.0 as net, names, round(exposure, 9) as exposure from dy", "daily_bars", "scores")
def book_daily_results(spark, sf_dir):
    out = book_days(spark, sf_dir)
    return rounded(out.select("candidate", "idx", "turnover", "gross", "net", "names", "exposure"), 9)


@query("with " + BOOK_SQL + """, cv as (select *, exp(sum(ln(1 + greatest(net, -0.999999))) over w) as curve from dy window w as (partition by candidate order by idx rows between unbounded preceding and current row)),
dd as (select *, curve / max(curve) over (partition by candidate order by idx rows between unbounded preceding and current row) - 1 as drawdown from cv)
select candidate, count(*) as days, round(avg(net) * 252, 5) as annual_return, round(stddev_samp(net) * sqrt(252), 5) as annual_volatility, round(avg(net) * 252 / (stddev_samp(net) * sqrt(252)), 5) as information_ratio, round(avg(net) * 252 / (stddev_samp(least(net, 0)) * sqrt(252)), 5) as sortino,
 round(min(drawdown), 5) as max_drawdown, round(avg(turnover), 5) as mean_turnover, round(avg(exposure), 5) as mean_exposure, round(avg((names > 0)::int), 5) as active_ratio from dd group by candidate""", "daily_bars", "scores")
def book_performance(spark, sf_dir):
    out = books.performance(book_days(spark, sf_dir), 10)
    return rounded(out.select("candidate", "days", "annual_return", "annual_volatility", "information_ratio", "sortino", "max_drawdown", "mean_turnover", "mean_exposure", "active_ratio"), 5)


@query("with " + BOOK_SQL + """, bk as (select candidate, date, list(distinct ticker) as names from tg group by all), lg as (select *, lag(names) over (partition by candidate order by date) as before from bk)
select candidate, round(avg(len(list_intersect(names, before)) / len(list_distinct(list_concat(names, before)))), 6) as stability from lg where before is not null group by candidate""", "daily_bars", "scores")
def book_stability(spark, sf_dir):
    targets, dates, _, _ = book_parts(spark, sf_dir)
    return rounded(books.selection_stability(targets, dates))


PBO_SQL = BOOK_SQL + """, gs as (select *, ntile(6) over (order by idx) - 1 as grp from di), dg as (select dy.candidate, grp, sum(net) as s, count(*) as c from dy join gs on gs.idx = dy.idx group by all),
c6 as (select row_number() over (order by a.g, b.g) - 1 as split_id, a.g as g1, b.g as g2 from range(6) a(g), range(6) b(g) where a.g < b.g),
sc2 as (select split_id, candidate, round(sum(s) filter (grp not in (g1, g2)) / sum(c) filter (grp not in (g1, g2)), 12) as in_score, round(sum(s) filter (grp in (g1, g2)) / sum(c) filter (grp in (g1, g2)), 12) as out_score from c6, dg group by all),
r2 as (select *, row_number() over (partition by split_id order by in_score desc, candidate) as ri, row_number() over (partition by split_id order by out_score, candidate desc) as ro, count(*) over (partition by split_id) as n, in_score - lead(in_score) over (partition by split_id order by in_score desc, candidate) as gap from sc2),
oc as (select split_id, candidate as winner, gap as winner_gap, out_score, ro / n as rank_share, ln(least(greatest(ro / n, 1e-6), 1 - 1e-6) / (1 - least(greatest(ro / n, 1e-6), 1 - 1e-6))) as logit from r2 where ri = 1)"""


def split_scores(spark, sf_dir):
    _, dates, _, grid = book_parts(spark, sf_dir)
    daily = book_days(spark, sf_dir)
    splits = folds.purged_splits(dates, 6, 2, 0, 15).join(dates, "date").select("split_id", "idx", "role")
    rows = daily.join(F.broadcast(splits), "idx").groupBy("split_id", "candidate")
    is_test = F.col("role") == "test"
    out = rows.agg(F.round(F.avg(F.when(~is_test, F.col("net"))), 12).alias("in_score"), F.round(F.avg(F.when(is_test, F.col("net"))), 12).alias("out_score"))
    return kept(spark, sf_dir, "split scores", lambda: out), grid


@query("with " + PBO_SQL + " select split_id, winner, round(winner_gap, 6) as winner_gap, round(out_score, 6) + 0.0 as out_score, round(rank_share, 6) as rank_share, round(logit, 6) + 0.0 as logit, logit < -1e-12 as overfit from oc", "daily_bars", "scores")
def overfit_split_outcomes(spark, sf_dir):
    return rounded(overfit.split_outcomes(split_scores(spark, sf_dir)[0]))


@query("with " + PBO_SQL + ", p as (select avg((logit < -1e-12)::int) as pbo, count(*) as splits from oc) select round(pbo, 6) as pbo, splits, case when pbo < 0.2 then 'low_overfit_risk' when pbo < 0.5 then 'moderate_overfit_risk' when pbo < 0.8 then 'high_overfit_risk' else 'severe_overfit_risk' end as label from p", "daily_bars", "scores")
def overfit_pbo(spark, sf_dir):
    return rounded(overfit.pbo(overfit.split_outcomes(split_scores(spark, sf_dir)[0])))


@query("with " + PBO_SQL + """, ax as (select 'strategy' as axis, strategy as value, logit from oc join gd on gd.candidate = winner union all select 'holding', cast(holding as varchar), logit from oc join gd on gd.candidate = winner)
select axis, value, count(*) as wins, round(avg((logit < -1e-12)::int), 6) as overfit_share from ax group by all""", "daily_bars", "scores")
def overfit_axis_contribution(spark, sf_dir):
    scores, grid = split_scores(spark, sf_dir)
    return rounded(overfit.axis_contribution(overfit.split_outcomes(scores), grid, ["strategy", "holding"]))


IMPACT = "case when notional > 0 and adv > 0 and vol > 0 then 0.142 * vol * sqrt({n} / adv / 0.01) * 1e4 + 0.314 * vol * ({n} / adv) * 1e4 else 0 end"


@query(f"""with o as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * 100 as notional, l_quantity * 1e7 as adv, l_discount as vol, l_tax * 10 as urgency, case l_linenumber % 3 when 0 then 'market' when 1 then 'limit' else 'twap' end as order_type from lineitem),
f as (select *, case when order_type = 'limit' then least(greatest(2 * greatest(least(urgency, 1.0), 0.1), 0.01) / greatest({IMPACT.format(n="notional")} + 2, 1e-9), 1.0) else 1.0 end as fill_rate from o), g as (select *, greatest(notional, 0) * fill_rate as fn from f)
select order_type, count(*) as orders, round(avg(fill_rate), 6) as mean_fill, round(avg(case when order_type = 'limit' then least(greatest(2 * greatest(least(urgency, 1.0), 0.1), 0.01), 2) else 2 end + case when order_type = 'twap' then {IMPACT.format(n="(notional / 4)")} else {IMPACT.format(n="fn")} end + 1), 5) as mean_cost from g group by order_type""")
def ledger_cost_estimate(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "market").when(F.col("l_linenumber") % 3 == 1, "limit").otherwise("twap")
    o = li.select((F.col("l_extendedprice") * 100).alias("notional"), (F.col("l_quantity") * 1e7).alias("adv"), F.col("l_discount").alias("vol"), (F.col("l_tax") * 10).alias("urgency"), kind.alias("order_type"))
    out = ledger.cost_estimate(o, 4.0, 1.0, 0.01).groupBy("order_type").agg(F.count(F.lit(1)).alias("orders"), F.avg("fill_rate").alias("mean_fill"), F.avg("cost_bps").alias("mean_cost"))
    return rounded(rounded(out.drop("mean_cost")).join(rounded(out.select("order_type", "mean_cost"), 5), "order_type"))


LEDGER_SQL = """sc as (select ticker, date, round(prob_down, 10) as d, round(prob_flat, 10) as f, round(prob_up, 10) as u from scores), dr as (select ticker, date, case when d >= f and d >= u then 'DOWN' when f >= u then 'FLAT' else 'UP' end as direction from sc),
cal as (select cast(g as date) as day, row_number() over (order by g) as k from generate_series(timestamp '1990-01-01', timestamp '2005-12-31', interval 1 day) t(g) where isodow(g) < 6),
pk as (select dr.*, (select max(k) from cal where day <= dr.date) as k0 from dr), sch as (select pk.*, c1.day as execute_on, c2.day as settle_on from pk join cal c1 on c1.k = k0 + 1 join cal c2 on c2.k = k0 + 6),
x as (select s.*, e.open as ep, b.close as sp, case when direction = 'FLAT' then 'SKIPPED' when e.open is null or execute_on > date '1998-12-31' then 'QUEUED' when b.close is null or settle_on > date '1998-12-31' then 'PENDING' else 'SETTLED' end as status from sch s left join daily_bars e on e.ticker = s.ticker and e.date = s.execute_on left join daily_bars b on b.ticker = s.ticker and b.date = s.settle_on),
y as (select *, case when status = 'SETTLED' then sp / ep - 1 end as r from x),
z as (select *, case when direction = 'UP' then r else -r end - 10 / 1e4 as net, case when status = 'SETTLED' then (case when r <= -0.05 then 'DOWN' when r >= 0.05 then 'UP' else 'FLAT' end) = direction end as hit from y)"""


def settled(spark, sf_dir):
    p = labelled(spark, sf_dir)
    d, f, u = (F.col(c) for c in ("prob_down", "prob_flat", "prob_up"))
    p = p.select("ticker", "date", F.when((d >= f) & (d >= u), "DOWN").when(f >= u, "FLAT").otherwise("UP").alias("direction"))
    b = bars(spark, sf_dir)
    book = ledger.queue_trades(p, market_context(b).select("ticker", "date", "close", "adv_20d"), 5, 1e5)
    as_of = F.lit("1998-12-31").cast("date")
    return ledger.settle_due(ledger.execute_due(book, b, as_of), b, as_of, 0.05, 10)


@query("with " + LEDGER_SQL + " select status, direction, count(*) as trades, round(avg(r), 5) as mean_return, round(avg(net), 5) as mean_net, round(avg(hit::int), 6) as hit_rate from (select status, direction, r, case when status = 'SETTLED' then net end as net, hit from z) t group by all", "daily_bars", "scores")
def ledger_settlement(spark, sf_dir):
    out = settled(spark, sf_dir).groupBy("status", "direction").agg(F.count(F.lit(1)).alias("trades"), F.avg("asset_return").alias("mean_return"), F.avg("net_return").alias("mean_net"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))
    return rounded(rounded(out.select("status", "direction", "trades", "mean_return", "mean_net"), 5).join(out.select("status", "direction", "hit_rate"), ["status", "direction"]))


@query("with " + LEDGER_SQL + " select strftime(date, '%G-W%V') as week_id, count(*) as trades, count(*) filter (status = 'QUEUED') as queued, count(*) filter (status = 'PENDING') as pending, count(*) filter (status = 'SETTLED') as settled, count(*) filter (status = 'SKIPPED') as skipped, round(avg(case when status = 'SETTLED' then net end), 6) as mean_net_return, round(avg(hit::int), 6) as hit_rate from z group by 1", "daily_bars", "scores")
def ledger_weekly_review(spark, sf_dir):
    return rounded(ledger.weekly_review(settled(spark, sf_dir)))


@query("""with x as (select *, revenue / nullif(lag(revenue) over w, 0) - 1 as g, profit / nullif(revenue, 0) as p, debt / nullif(equity, 0) as d, profit * case when report_date - lag(report_date) over w <= 130 then 4 else 1 end as ap from fundamentals window w as (partition by ticker order by report_date))
select ticker, report_date, round(g, 6) + 0.0 as revenue_growth, round(p, 6) as profitability, round(d, 6) as debt_to_equity, round(ap, 4) as annualised_profit from x where g is not null""", "fundamentals")
def filings_ratios(spark, sf_dir):
    out = fundamentals.ratios(view(spark, sf_dir, "fundamentals"))
    return rounded(out.select("ticker", "report_date", "revenue_growth", "profitability", "debt_to_equity", F.round("annualised_profit", 4).alias("annualised_profit")))


@query("""with x as (select ticker, report_date, coalesce(report_date - lag(report_date) over w, lead(report_date) over w - report_date, 91) as gap, row_number() over (partition by ticker order by report_date desc) as rn from fundamentals window w as (partition by ticker order by report_date))
select ticker, report_date, 'quarterly' as filing_type from x where gap < 250 and rn <= 4""", "fundamentals")
def filings_recent(spark, sf_dir):
    return fundamentals.recent_filings(view(spark, sf_dir, "fundamentals"), 4, "quarterly").select("ticker", "report_date", "filing_type")


NEWS_SQL = """dd as (select * from (select *, row_number() over (partition by ticker, headline_key, published_at, source_name order by relevance_score desc, item_id) as rn from news_items) t where rn = 1),
nv as (select *, 1.0 / row_number() over (partition by ticker, headline_key order by published_at, item_id) as novelty, cast(published_at as date) as date from dd),
dn as (select ticker, date, count(*) as headline_count, avg(sentiment_score) as sentiment, coalesce(case when sum(case when sentiment_score is not null then relevance_score end) > 0 then sum(sentiment_score * relevance_score) / sum(case when sentiment_score is not null then relevance_score end) end, avg(sentiment_score)) as sentiment_weighted, avg(relevance_score) as relevance, avg(novelty) as novelty, count(distinct source_name) as source_count, string_agg(distinct source_name, '|' order by source_name) as source_mix from nv group by all)"""


def daily(spark, sf_dir):
    items = news.novelty(news.dedupe_items(view(spark, sf_dir, "news_items"))).withColumn("date", F.to_date("published_at"))
    return news.daily_news(items)


@query("with " + NEWS_SQL + " select ticker, date, headline_count, round(sentiment, 9) + 0.0 as sentiment, round(sentiment_weighted, 9) + 0.0 as sentiment_weighted, round(relevance, 9) as relevance, round(novelty, 9) as novelty, source_count, source_mix from dn", "news_items")
def news_daily(spark, sf_dir):
    return rounded(daily(spark, sf_dir), 9)


@query("with " + NEWS_SQL + """, rw as (select ticker, date, headline_count, coalesce(sum(sentiment * headline_count) over b / sum(headline_count) over b, 0) as s, case when count(*) over m >= 5 then (headline_count - avg(headline_count) over m) / nullif(stddev_samp(headline_count) over m, 0) end as z from dn window b as (partition by ticker order by date rows between 4 preceding and current row), m as (partition by ticker order by date rows between 19 preceding and current row))
select ticker, date, round(s, 9) + 0.0 as sentiment_nd, round(coalesce(z, 0), 9) + 0.0 as count_z from rw""", "news_items")
def news_signal_windows(spark, sf_dir):
    return rounded(news.signal_windows(daily(spark, sf_dir)).select("ticker", "date", "sentiment_nd", "count_z"), 9)


@query("with " + NEWS_SQL + """, rr as (select ticker, date, lead(close) over (partition by ticker order by date) / close - 1 as ret from daily_bars), j as (select dn.ticker, dn.date, sentiment, ret from dn left join rr on rr.ticker = dn.ticker and rr.date = dn.date),
w as (select '1' as window_, sentiment as x, ret from j union all select '3', avg(sentiment) over (partition by ticker order by date rows between 2 preceding and current row), ret from j union all select '5', avg(sentiment) over (partition by ticker order by date rows between 4 preceding and current row), ret from j)
select window_ as "window", count(*) as n, round(coalesce(covar_pop(x, ret) / nullif(sqrt(var_pop(x)) * sqrt(var_pop(ret)), 0), 0), 6) as ic, round(abs(coalesce(covar_pop(x, ret) / nullif(sqrt(var_pop(x)) * sqrt(var_pop(ret)), 0), 0)), 6) as abs_ic, round(avg(case when x <> 0 then (sign(x) = sign(ret))::int end), 6) as overlap_rate from w where x is not null and ret is not null group by 1""", "daily_bars", "news_items")
def news_lookback_sweep(spark, sf_dir):
    rets = events.simple_returns(bars(spark, sf_dir))
    from pyspark.sql import Window

    rets = rets.withColumn("ret", F.lead("ret").over(Window.partitionBy("ticker").orderBy("date")))
    return rounded(news.lookback_sweep(daily(spark, sf_dir).join(rets, ["ticker", "date"], "left"), "ret", [1, 3, 5]))


@query("""with t as (select doc_id, lower(text) as body, text from documents), k as (select doc_id, list_transform(regexp_extract_all(body, '[a-z'']+'), lambda w: case when w in ('the', 'and', 'of') then 1 when w in ('der', 'die', 'la', 'le') then -1 else 0 end) as h from t)
select doc_id, round(coalesce(list_sum(h) / nullif(list_sum(list_transform(h, lambda v: abs(v))), 0), 0), 6) + 0.0 as sentiment from k""")
def news_lexicon_sentiment(spark, sf_dir):
    """Lexicon score of whole document texts (lexicons are parameters)."""
    d = table(spark, sf_dir, "documents")
    return rounded(d.select("doc_id", news.lexicon_sentiment(F.col("text"), ["the", "and", "of"], ["der", "die", "la", "le"]).alias("sentiment")))


KEY = "trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"""with a as (select distinct w as alias, ticker from (select 'B' || item_id % 7 as ticker, unnest(string_split({KEY}, ' ')) as w from benchmark) t where length(w) >= 9 and w not in ('incorporated')),
d as (select distinct doc_id as item_id, unnest(string_split({KEY}, ' ')) as alias from documents) select item_id, ticker, count(distinct d.alias) as hits from d join a on a.alias = d.alias group by all""")
def news_phrase_matches(spark, sf_dir):
    """Documents that contain a long word of a named item, by n-gram equi-join with the alias dimension."""
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("B"), (F.col("item_id") % 7).cast("string")).alias("ticker"), F.col("text").alias("name"))
    aliases = news.alias_dimension(b, ["incorporated"], 9)
    return news.phrase_matches(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("body")), aliases, 1)


@query("""with l as (select event_id, timezone('America/New_York', timezone('UTC', ts)) as lt from events), b as (select event_id, cast(lt as date) as day, case when isodow(lt) >= 6 then 'weekend' when hour(lt) * 60 + minute(lt) < 570 then 'pre_market' when hour(lt) * 60 + minute(lt) < 960 then 'regular' else 'post_market' end as session from l)
select session, case when session in ('weekend', 'post_market') then cast(day + cast(case isodow(day) when 5 then 3 when 6 then 2 else 1 end as integer) as date) else day end as signal_day, count(*) as n from b group by all""")
def news_session_alignment(spark, sf_dir):
    day, bucket = session_alignment(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(bucket.alias("session"), day.alias("signal_day")).groupBy("session", "signal_day").agg(F.count(F.lit(1)).alias("n"))


@query("select ticker_set, count(*) as count, round(avg(metric), 5) as mean, round(median(metric), 5) as median, round(stddev_pop(metric), 5) as std, round(min(metric), 5) as min, round(max(metric), 5) as max from runs group by 1", "runs")
def audit_distribution(spark, sf_dir):
    return rounded(audit.distribution(view(spark, sf_dir, "runs"), ["ticker_set"], "metric"), 5)


@query("""select case when grouping(ticker_set) = 0 then 'ticker_set' when grouping(flag) = 0 then 'flag' else 'all' end as dimension, coalesce(ticker_set, cast(flag as varchar), 'all') as item, count(*) as count, round(avg(metric), 5) as mean, round(min(metric), 5) as min, round(max(metric), 5) as max from runs group by grouping sets ((ticker_set), (flag), ())""", "runs")
def audit_grouped_rollup(spark, sf_dir):
    return rounded(audit.grouped_rollup(view(spark, sf_dir, "runs"), ["ticker_set", "flag"], "metric"), 5)


@query("""with r as (select ticker_set as key, as_of_date as date, case when flag = 1 then ['pending'] else [] end || case when n % 2 = 0 then ['even'] else [] end as causes from runs), x as (select key, date, unnest(causes) as c, 5 * floor((date - date '1970-01-05') / 7) as o from r),
m as (select distinct a.key, a.date, a.o, b.o as o2 from x a join x b on a.key = b.key and a.c = b.c and b.o < a.o and b.o >= a.o - 20)
select r.key, r.date, count(o2) as matches, cast(coalesce(max(o) - min(o2), 0) as bigint) as span from r left join m on m.key = r.key and m.date = r.date group by all""", "runs")
def policy_history_match(spark, sf_dir):
    r = view(spark, sf_dir, "runs")
    causes = F.array_compact(F.array(F.when(F.col("flag") == 1, "pending"), F.when(F.col("n") % 2 == 0, "even")))
    return rounded(audit.history_match(r.select(F.col("ticker_set").alias("key"), F.col("as_of_date").alias("date"), causes.alias("causes")), 20))


@query("""with r as (select ticker_set as key, as_of_date as date, n % 3 = 0 as wanted, 5 * floor((as_of_date - date '1970-01-05') / 7) as o, row_number() over (partition by ticker_set order by as_of_date) as rn from runs),
f as (select key, date, wanted, rn, wanted as effective, case when wanted then o else -1000000 end as last from r where rn = 1 union all select r.key, r.date, r.wanted, r.rn, r.wanted and r.o - f.last > 15, case when r.wanted and r.o - f.last > 15 then r.o else f.last end from f join r on r.key = f.key and r.rn = f.rn + 1)
select key, date, wanted, effective from f""", "runs")
def policy_cool_off(spark, sf_dir):
    r = view(spark, sf_dir, "runs")
    return audit.cool_off(r.select(F.col("ticker_set").alias("key"), F.col("as_of_date").alias("date"), (F.col("n") % 3 == 0).alias("wanted")), 15)


@query("""with w as (select key, x, greatest(v, 0) as v, count(*) over (partition by key) as n, row_number() over (partition by key order by v, x) - 1 as k from (select o_orderpriority as key, o_orderstatus as x, round(cast(count(*) as double) * count(*), 0) as v from orders group by all) t),
s as (select *, (1 - k * 0.1) / sum(v) over (partition by key order by k rows between current row and unbounded following) as sc from w), f as (select *, min(k) filter (v * sc >= 0.1) over (partition by key) as first from s)
select key, x, round(case when k < first then 0.1 else v * max(sc) filter (k = first) over (partition by key) end, 6) as weight from f""")
def learned_floor_weights(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("key"), F.col("o_orderstatus").alias("x")).agg(F.pow(F.count(F.lit(1)).cast("double"), 2).alias("v"))
    return rounded(news.floor_weights(o, ["key"], "v", 0.1).select("key", "x", "weight"))


@query("with " + BOOK_SQL + """, cv as (select *, exp(sum(ln(1 + greatest(net, -0.999999))) over w) as curve from dy window w as (partition by candidate order by idx rows between unbounded preceding and current row)),
dd as (select *, curve / max(curve) over (partition by candidate order by idx rows between unbounded preceding and current row) - 1 as drawdown from cv)
select candidate, round(avg(gross) * 252, 5) + 0.0 as gross_annual_return, round(avg(gross) * 252 - avg(net) * 252, 5) + 0.0 as cost_drag, round(sum(turnover) * 10, 4) as total_cost_bps, round(coalesce(avg(net) * 252 / nullif(abs(min(drawdown)), 0), 0), 4) + 0.0 as calmar from dd group by candidate""", "daily_bars", "scores")
def book_costs(spark, sf_dir):
    """Gross return, cost drag, total cost and Calmar ratio of each candidate."""
    out = books.performance(book_days(spark, sf_dir), 10)
    first, last = rounded(out.select("candidate", "gross_annual_return", "cost_drag"), 5), rounded(out.select("candidate", "total_cost_bps", "calmar"), 4)
    return first.join(last, "candidate")


SIDES_SQL = """sc as (select ticker, date, round(prob_down, 10) as prob_down, round(prob_flat, 10) as prob_flat, round(prob_up, 10) as prob_up, round(prob_up - prob_down, 8) as signal from scores),
ct as (select *, count(*) over (partition by date) as n, greatest(prob_down - prob_up, -signal) as se, case when prob_down >= prob_flat and prob_down >= prob_up then 0 when prob_flat >= prob_up then 1 else 2 end as am from sc),
lo as (select ticker, date, n, signal, 'long' as side, prob_up - greatest(prob_down, prob_flat) as edge from ct where am = 2 and prob_up >= 0.4), so as (select ticker, date, n, signal, 'short' as side, prob_down - greatest(prob_up, prob_flat) as edge from ct where am = 0 and prob_down >= 0.4),
rl as (select ticker, date, n, signal, 'long' as side, signal as edge from ct where signal >= 0.01), rh as (select ticker, date, n, signal, 'short' as side, se as edge from ct where se >= 0.01),
ed as (select 'classified_two_sided' as strategy, * from lo union all select 'classified_two_sided', * from so union all select 'classified_directional', * from lo union all select 'classified_directional', * from so union all select 'rank_long_short', * from rl union all select 'rank_long_short', * from rh union all select 'rank_long_only', * from rl),
gd as (select s as strategy, s || '|0.2|1' as candidate from (values ('classified_two_sided'), ('classified_directional'), ('rank_long_short'), ('rank_long_only')) a(s)),
rk as (select ed.*, candidate, row_number() over (partition by candidate, date, side order by edge desc, case when side = 'long' then -signal else signal end, ticker) as rn, greatest(1, round_even(n * 0.2::double, 0)) as k from ed join gd on gd.strategy = ed.strategy),
sd as (select strategy, candidate, date, count(distinct side) as sides, count(*) as names from rk where rn <= k group by all), ks as (select * from sd where strategy in ('classified_directional', 'rank_long_only') or sides = 2), nd as (select count(distinct date) as n from sc)
select gd.candidate, round(count(ks.date) / any_value(nd.n), 6) as signal_ratio, round(count(*) filter (sides = 2) / any_value(nd.n), 6) as two_sided_ratio, round(count(*) filter (sides = 1) / any_value(nd.n), 6) as one_sided_ratio, cast(coalesce(sum(names), 0) as bigint) as names from gd left join ks on ks.candidate = gd.candidate, nd group by gd.candidate"""


@query("with " + SIDES_SQL, "daily_bars", "scores")
def book_side_ratios(spark, sf_dir):
    """All four strategies: shares of days with a selection, with both sides and with one."""
    scores = view(spark, sf_dir, "scores").withColumns({c: F.round(c, 10) for c in ("prob_down", "prob_flat", "prob_up")})
    scores = scores.withColumn("signal", F.round(F.col("prob_up") - F.col("prob_down"), 8))
    grid = books.candidate_grid(spark, ["classified_two_sided", "classified_directional", "rank_long_short", "rank_long_only"], [0.2], [1])
    chosen = kept(spark, sf_dir, "selections", lambda: books.selections(books.side_edges(scores, 0.4, 0.01), grid))
    names = chosen.groupBy("candidate").agg(F.count(F.lit(1)).alias("names"))
    out = books.side_ratios(chosen, grid, folds.date_index(scores)).join(names, "candidate", "left").fillna({"names": 0})
    return rounded(out)


@query("""with x as (select *, profit / 1000 as eps, coalesce(report_date - lag(report_date) over w, 91) as gap, coalesce(revenue / nullif(lag(revenue) over w, 0) - 1, 0) as g, profit / nullif(revenue, 0) as p, debt / nullif(equity, 0) as d from fundamentals window w as (partition by ticker order by report_date)),
y as (select x.ticker, report_date, available_at, g, p, d, eps * case when gap <= 130 then 4.0 else 1.0 end as ae, close from x asof left join daily_bars b on b.ticker = x.ticker and b.date <= x.available_at)
select ticker, report_date, round(ae, 4) as annualised_eps, round(close, 6) as close, round(ae / close, 6) as earnings_yield, round(g, 6) + 0.0 as revenue_growth from y where close is not null""", "fundamentals", "daily_bars")
def filings_earnings_yield(spark, sf_dir):
    """Annualised earnings against the close on or before the day they became available."""
    f = view(spark, sf_dir, "fundamentals").withColumn("eps", F.col("profit") / 1000)
    out = fundamentals.earnings_yield(f, bars(spark, sf_dir))
    return rounded(out.select("ticker", "report_date", F.round("annualised_eps", 4).alias("annualised_eps"), "close", "earnings_yield", "revenue_growth"))


@query("""with f as (select ticker, report_date from fundamentals where ascii(right(ticker, 1)) % 2 = 0 or month(report_date) = 12), x as (select *, coalesce(report_date - lag(report_date) over w, lead(report_date) over w - report_date, 91) as gap from f window w as (partition by ticker order by report_date)),
k as (select *, case when gap >= 250 then 'annual' else 'quarterly' end as filing_type from x), r as (select *, row_number() over (partition by ticker, filing_type order by report_date desc) as rn from k)
select ticker, filing_type, count(*) as filings, min(report_date) as first_date, max(report_date) as last_date from r where rn <= 3 group by all""", "fundamentals")
def filings_by_cadence(spark, sf_dir):
    """The last three filings of each type; every other ticker reports in December only, so both types are there."""
    f = view(spark, sf_dir, "fundamentals").where((F.ascii(F.substring("ticker", -1, 1)) % 2 == 0) | (F.month("report_date") == 12)).select("ticker", "report_date")
    both = fundamentals.recent_filings(f, 3, "quarterly").unionByName(fundamentals.recent_filings(f, 3, "annual"))
    return both.groupBy("ticker", "filing_type").agg(F.count(F.lit(1)).alias("filings"), F.min("report_date").alias("first_date"), F.max("report_date").alias("last_date"))
