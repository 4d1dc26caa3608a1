"""Queries P15 to P20, Q4, Q19 and J3, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions.columns import KEY, rounded
from ..operators import quality as Q
from ..operators import signals as S
from ..operators import trades as T
from ..sources.fixtures import bars
from .clean_queries import GAPS
from .indicator_queries import _full_sql
from .quality_queries import B as BAD
from .quality_queries import COMPLETE, MEDIAN, PRICE, W, clean
from .trade_queries import PARAMS, hourly, ind_sql, outcomes, OUT_SQL, PLAN_SQL, r6, score_sql, scored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(name: str, make, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(make(spark, sf_dir))
    SQL[name] = sql


def planned(s, d) -> DataFrame:
    """Bars whose better score is 50 or more, as signals of that side and strength."""
    made = scored(s, d).withColumn("strength", F.greatest("long_score", "short_score").cast("double"))
    return made.filter("strength >= 50").withColumn("side", F.when(F.col("long_score") >= F.col("short_score"), "LONG").otherwise("SHORT"))


def stopped(s, d) -> DataFrame:
    """Signals with a stop at a twentieth of their layered plan's, as the given events are random and their ranges as wide as their prices."""
    plan = S.layered_plan(planned(s, d)).filter("level = 1").drop("level", "level_price", "share_pct", "n_levels", "strategy")
    return plan.withColumn("stop_price", F.col("close") - 0.05 * (F.col("close") - F.col("stop_price")))


PL = f"""{score_sql()}, p0 as (select *, greatest(long_score, short_score)::double as strength, case when long_score >= short_score then 'LONG' else 'SHORT' end as side, case when long_score >= short_score then 1.0 else -1.0 end as way, coalesce(rsi, 50.0) as rs from sc where greatest(long_score, short_score) >= 50),
p1 as (select *, case when strength >= 85 then 'SCALP' when strength >= 75 then 'SWING_SHORT' when strength >= 65 then 'SWING_MEDIUM' else 'POSITION' end as strategy, case when strength >= 85 then 0.75 when strength >= 75 then 1.0 when strength >= 65 then 1.25 else 1.4 end as sf,
  case volatility when 'LOW' then 1.8 when 'HIGH' then 2.5 when 'VERY_HIGH' then 2.5 else 2.0 end as va, case volatility when 'LOW' then 0.95 when 'HIGH' then 1.1 when 'VERY_HIGH' then 1.1 else 1.0 end as vs from p0),
pl as (select *, close - way * atr * va * sf * case when (side = 'LONG' and rs < 25) or (side = 'SHORT' and rs > 75) then 1.15 else 1.0 end * vs as stop_price from p1)"""
_query("p15_layered_plan", lambda s, d: S.layered_plan(planned(s, d)).select(*KEY, "side", "strategy", "n_levels", "level", "level_price", "share_pct", "stop_price"),
       f"""{PL}, e(strategy, n_levels, level, distance, share_pct) as (values ('SCALP', 2, 1, 0.0, 70.0), ('SCALP', 2, 2, 0.25, 30.0), ('SWING_SHORT', 3, 1, 0.0, 45.0), ('SWING_SHORT', 3, 2, 0.4, 35.0), ('SWING_SHORT', 3, 3, 0.8, 20.0), ('SWING_MEDIUM', 3, 1, 0.0, 45.0), ('SWING_MEDIUM', 3, 2, 0.4, 35.0), ('SWING_MEDIUM', 3, 3, 0.8, 20.0),
  ('POSITION', 4, 1, 0.0, 35.0), ('POSITION', 4, 2, 0.3, 30.0), ('POSITION', 4, 3, 0.6, 20.0), ('POSITION', 4, 4, 1.0, 15.0))
select symbol, timeframe, ts, side, strategy, n_levels, level, {r6('(close - way * atr * va * distance)::double as level_price', 'share_pct::double as share_pct', 'stop_price::double as stop_price')} from pl join e using (strategy)""")
CAND = f"""{PL}, sw as (select symbol, timeframe, ts, max(high) over w as top, min(low) over w as bottom from b window w as (partition by symbol, timeframe order by ts rows between 49 preceding and current row)),
c0 as (select pl.*, top, bottom, case when side = 'LONG' then bottom else top end as st from pl join sw using (symbol, timeframe, ts)),
fixed(seq, kind, x, level_strength) as (values (0, 'FIBONACCI', 1.236, 80), (1, 'FIBONACCI', 1.382, 80), (2, 'FIBONACCI', 1.618, 80), (3, 'FIBONACCI', 2.618, 80), (10, 'BOLLINGER', 0, 75), (5000, 'VWAP', 0, 85), (6002, 'ATR_EXTENSION', 2, 70), (6003, 'ATR_EXTENSION', 3, 60), (6004, 'ATR_EXTENSION', 4, 50), (6006, 'ATR_EXTENSION', 6, 50)),
steps as (select *, unnest(case when close > 100 then [5.0, 10.0] when close > 50 then [2.5, 5.0] else [1.0, 2.5] end) as step, unnest([1, 2]) as i from c0),
levels as (select *, unnest(range(1, 1 + greatest(0, case when side = 'LONG' then floor((close + close * 0.15::double) / step) - floor(close / step) else floor(close / step) - ceil((close - close * 0.15::double) / step) + 1 end)::bigint)) as k from steps),
c1 as (select symbol, timeframe, ts, side, way, close, atr, strength, stop_price, roc, rs, seq, kind, case kind when 'FIBONACCI' then st + way * (top - bottom) * x when 'BOLLINGER' then case when side = 'LONG' then bb_upper else bb_lower end when 'VWAP' then cum_vwap else close + way * coalesce(atr, close * 0.02) * x end as target, level_strength from c0 cross join fixed
  union all select symbol, timeframe, ts, side, way, close, atr, strength, stop_price, roc, rs, 1000 * i + k, 'PSYCHOLOGICAL', case when side = 'LONG' then floor(close / step) + k else floor(close / step) - k + 1 end * step, 60 from levels),
cand as (select * from c1 where way * (target - close) > 0)"""


def candidates(s, d) -> DataFrame:
    return S.candidate_targets(stopped(s, d), bars(s, d))


_query("p17_candidate_targets", lambda s, d: candidates(s, d).select(*KEY, "side", F.col("seq").cast("bigint").alias("seq"), "kind", "target", "level_strength"), f"{CAND} select symbol, timeframe, ts, side, seq::bigint as seq, kind, {r6('target::double as target')}, level_strength from cand")
_query("p18_rank_targets", lambda s, d: S.rank_targets(candidates(s, d)).select(*KEY, "side", "kind", "target", "rr", "score", "place", "exit_pct"),
       f"""{CAND}, g as (select *, abs(target - close) as gain, abs(target - close) / nullif(0.05 * abs(close - stop_price), 0) as rr, abs(target - close) / close * 100 as away from cand),
k as (select * from g where away <= 20 and rr between 1.2 and 6 qualify row_number() over (partition by symbol, timeframe, ts, side order by gain, seq) <= 6),
m as (select *, case kind when 'FIBONACCI' then 90 when 'VWAP' then 85 when 'BOLLINGER' then 75 when 'PSYCHOLOGICAL' then 65 else 60 end * level_strength / 100
  * ((case when way * coalesce(roc, 0.0) > 3 then 1.3 when way * coalesce(roc, 0.0) > 1.5 then 1.1 when way * coalesce(roc, 0.0) > 0 then 1.0 else 0.8 end + case when (side = 'LONG' and rs < 30) or (side = 'SHORT' and rs > 70) then 1.2 when (side = 'LONG' and rs < 50) or (side = 'SHORT' and rs > 50) then 1.1 else 0.9 end) / 2)
  * greatest(0.5, 1 - away / 100) * strength / 100 as score from k),
n as (select *, (row_number() over (partition by symbol, timeframe, ts, side order by score desc, gain, seq))::integer as place, least(4, count(*) over (partition by symbol, timeframe, ts, side)) as nt from m)
select symbol, timeframe, ts, side, kind, {r6('target::double as target', 'rr::double as rr', 'score::double as score')}, place,
  case when nt = 1 then 100 when strength >= 85 then [70, 30, 0, 0][place] when strength >= 75 then case when nt = 2 then [60, 40][place] else [50, 35, 15, 0][place] end when nt = 2 then [65, 35][place] when nt = 3 then [45, 35, 20][place] else [40, 30, 20, 10][place] end as exit_pct from n where place <= 4""")


def open_positions(s, d) -> DataFrame:
    """A LONG and a SHORT position of each symbol, entered at its first close, for the exit rules."""
    sides = F.explode(F.array(F.lit("LONG"), F.lit("SHORT"))).alias("side")
    return bars(s, d).groupBy("symbol").agg(F.min_by("close", "ts").alias("entry_price")).select("symbol", "entry_price", sides)


def exits(s, d) -> DataFrame:
    """The exit rules at every bar."""
    return S.exit_urgency(S.exit_scores(open_positions(s, d), scored(s, d)))


EXIT = f"""{score_sql()}, en as (select symbol, arg_min(close, ts) as entry_price from b group by 1), po as (select sc.*, side, entry_price, case when side = 'LONG' then 1.0 else -1.0 end as way from sc join en using (symbol), (values ('LONG'), ('SHORT')) v(side)),
va as (select *, coalesce(macd_hist, 0) as h, coalesce(rsi, 50) as r, coalesce(vwap_dev, 0) as dv, coalesce(roc, 0) as o, coalesce(bb_pct, 0.5) as bp, coalesce(vol_osc, 0) as vo, (close - entry_price) / nullif(entry_price, 0) * 100 as ch, coalesce(macd_cross, '') as cr from po),
ru as (select *, case when side = 'LONG' then case when cr = 'BEARISH' then 25 when h < -0.01 then 15 else 0 end else case when cr = 'BULLISH' then 25 when h > 0.01 then 15 else 0 end end as e1,
  case when side = 'LONG' then case when r > 80 then 25 when r > 75 then 15 else 0 end else case when r < 20 then 25 when r < 25 then 15 else 0 end end as e2,
  case when side = 'LONG' then case when dv > 3 then 20 when dv > 2 then 10 else 0 end else case when dv > -1 and dv < 1 then 20 when dv < -2 then 15 else 0 end end as e3,
  case when side = 'LONG' then case when o < -2.5 then 25 when o < -1 then 15 else 0 end else case when o > 2.5 then 25 when o > 1 then 15 else 0 end end as e4,
  case when side = 'LONG' then case when bp > 0.9 then 20 when bp > 0.8 then 10 else 0 end else case when bp < 0.1 then 20 when bp < 0.2 then 10 else 0 end end as e5,
  case when vo > 50 and way * ch < -1 then 15 else 0 end as e6 from va),
ex as (select symbol, timeframe, ts, side, (e1 + e2 + e3 + e4 + e5 + e6)::integer as exit_score,
  array_to_string(list_filter([case e1 when 25 then 'MACD_CROSS' when 15 then 'MACD_AGAINST' end, case e2 when 25 then 'RSI_EXTREME' when 15 then 'RSI_SEVERE' end, case when side = 'LONG' then case e3 when 20 then 'VWAP_VERY_FAR' when 10 then 'VWAP_FAR' end else case e3 when 20 then 'VWAP_RETURN' when 15 then 'VWAP_BELOW' end end,
    case e4 when 25 then 'MOMENTUM_STRONG' when 15 then 'MOMENTUM' end, case e5 when 20 then 'BAND_EDGE' when 10 then 'BAND_ZONE' end, case e6 when 15 then 'VOLUME' end], lambda x: x is not null), ',') as reasons,
  e1 > 0 and case when side = 'LONG' then r > 70 or o < -1 else r < 30 or o > 1 end as trend_reversal, vo > 50 and coalesce(way * ch < -2, false) as volume_divergence from ru)"""
_query("p19_exit_scores", lambda s, d: exits(s, d).select(*KEY, "side", "exit_score", "reasons"), f"{EXIT} select symbol, timeframe, ts, side, exit_score, reasons from ex")
_query("p20_exit_urgency", lambda s, d: exits(s, d).select(*KEY, "side", "urgency", "exit_pct", "trend_reversal", "volume_divergence"), f"{EXIT} select symbol, timeframe, ts, side, case when exit_score >= 80 then 'EXIT_URGENT' when exit_score >= 70 then 'EXIT_RECOMMENDED' when exit_score >= 60 then 'EXIT_WATCH' else 'HOLD' end as urgency, case when exit_score >= 90 then 100 when exit_score >= 80 then 75 when exit_score >= 70 then 50 else 0 end as exit_pct, trend_reversal, volume_divergence from ex")
QS = f"""{BAD}, {COMPLETE}, {GAPS}, {PRICE}, {MEDIAN}, ga as (select symbol, timeframe, count(*) as gaps, max(minutes) / 60 as longest from g0 where minutes > 90 group by all),
vo as (select symbol, timeframe, count(*) filter (volume < 0) + count(*) filter (m > 0 and volume > 10 * m) + count(*) filter (m = 0 and volume = 0) as v from md group by all),
q as (select symbol, timeframe, n, completeness_pct, coalesce(gaps, 0) as g, coalesce(longest, 0) as lo, order_violations, order_violations + jumps as p, v from cp left join ga using (symbol, timeframe) join pr using (symbol, timeframe) join vo using (symbol, timeframe))"""
_query("q04_quality_score", lambda s, d: Q.quality_score(clean(s, d)), f"""{QS} select symbol, timeframe, {r6("(0.4 * completeness_pct + case when g = 0 then 25.0 when g <= 5 then 20.0 when g <= 15 then 15.0 when g <= 30 then 10.0 else 5.0 end * case when lo > 72 then 0.5 when lo > 24 then 0.8 else 1.0 end + case when p = 0 then 20.0 when p < 0.01 * n then 16.0 when p < 0.05 * n then 10.0 else 0.0 end + case when v = 0 then 15.0 when v < 0.01 * n then 12.0 when v < 0.05 * n then 7.5 else 0.0 end)::double as score")}, completeness_pct >= 90 and lo <= 72 and p < 0.05 * n as suitable from q""")
READY = f"""{BAD},
gp as (select *, date_diff('second', lag(ts) over ({W}), ts) / 3600.0 as gap from b),
pa as (select symbol, timeframe, count(*) as n, min(ts) as a, max(ts) as z, count(*) filter (gap > 1.5) as gaps, coalesce(max(gap) filter (gap > 1.5), 0) as longest,
         count(*) filter (high < low) + count(*) filter (high < open) + count(*) filter (high < close) + count(*) filter (low > open) + count(*) filter (low > close) as wrong,
         count(*) filter (open <= 0 or high <= 0 or low <= 0 or close <= 0) as bad, count(*) filter (open is null or high is null or low is null or close is null) as absent,
         count(*) filter (volume = 0) as zero, count(*) filter (volume < 0) as negative, count(*) filter (gap = 0) as twice from gp group by all),
i0 as (select symbol, timeframe, {_full_sql('avg(close)', 'close', 20)} as x, {_full_sql('avg(close)', 'close', 50)} as y from b),
nu as (select symbol, timeframe, (count(*) - count(x) > 0.1 * count(*))::int + (count(*) - count(y) > 0.1 * count(*))::int + 1 as missing from i0 group by all),
sc as (select *, (wrong + bad + absent) / n as rate from pa join nu using (symbol, timeframe)),
ss as (select *, (case when gaps = 0 then 100.0 when gaps <= 0.05 * n then 100 - gaps / (0.05 * n) * 20 else greatest(0.0, 80 - 100.0 * gaps / n) end * case when longest > 24 then 0.7 when longest > 8 then 0.9 else 1.0 end)::double as gaps_score,
         (case when rate > 0.1 then 0.0 when rate > 0.05 then 50.0 else greatest(0.0, 100 - 1000 * rate) end)::double as ohlc_score, greatest(0.0, 100 - 100 * missing / 3)::double as indicators_score,
         greatest(0.0, 100 - 200 * (case when zero > 0.05 * n then zero else 0 end + negative) / n)::double as volume_score, case when twice > 0 then 70.0 else 100.0 end::double as consistency_score,
         100.0 * n / greatest(1.0, floor(floor(date_diff('second', a, z) / 86400.0) * (5 / 7) * (5.5 * 60 / 60.0))) as completeness_pct from sc),
so as (select *, round(gaps_score * 0.25 + ohlc_score * 0.30 + indicators_score * 0.25 + volume_score * 0.10 + consistency_score * 0.10, 2) as score from ss),
re as (select *, concat_ws(',', case when score < 70 then 'SCORE' end, 'CRITICAL', case when completeness_pct < 85 then 'COMPLETENESS' end, case when longest > 72 then 'LONG_GAP' end,
         case when missing > 2 then 'INDICATORS' end, case when ohlc_score < 90 then 'OHLC' end, case when n < 100 then 'FEW_ROWS' end) as reasons from so)"""
#: One required indicator is not there, which is critical: no series is ready.
_query("q19_backtest_readiness", lambda s, d: Q.backtest_readiness(clean(s, d), I.sma(I.sma(clean(s, d), 20), 50), ["sma_20", "sma_50", "macd"]),
       f"{READY} select symbol, timeframe, {r6('gaps_score', 'ohlc_score', 'indicators_score', 'volume_score', 'consistency_score', 'completeness_pct', 'score')}, reasons = '' as ready, reasons from re")
#: With all of them; a critical gap or price still counts.
_query("q19b_readiness_all_indicators", lambda s, d: Q.backtest_readiness(clean(s, d), I.sma(I.sma(clean(s, d), 20), 50), ["sma_20", "sma_50"]).select("symbol", "timeframe", "indicators_score", "score", "ready", "reasons"),
       f"""{READY.replace("+ 1 as missing", "as missing").replace("100 * missing / 3", "100 * missing / 2").replace("'CRITICAL',", "case when longest > 72 or bad > 0 then 'CRITICAL' end,")}
select symbol, timeframe, {r6('indicators_score', 'score')}, reasons = '' as ready, reasons from re""")


def alerts(s, d) -> DataFrame:
    return S.trade_plan(S.vwap_bounce(hourly(s, d), PARAMS)).select(F.concat_ws("|", "symbol", F.date_format("ts", "yyyyMMddHH")).alias("alert_id"), "symbol", "side", F.col("entry").alias("price"))


_query("j03_alerts_with_performance", lambda s, d: T.alerts_with_performance(alerts(s, d), outcomes(s, d).select(F.concat_ws("|", "symbol", F.date_format("ts", "yyyyMMddHH")).alias("alert_id"), F.col("reason").alias("outcome"), F.col("r_multiple").alias("pnl_r"), F.col("entry").alias("entry_price"))),
       f"with {ind_sql()}, {PLAN_SQL}, {OUT_SQL} select p.symbol || '|' || strftime(p.ts, '%Y%m%d%H') as alert_id, p.symbol, p.side, {r6('p.entry as price')}, reason as outcome, {r6('r_multiple as pnl_r', 'case when reason is not null then p.entry end as entry_price')} from plan p left join outcomes o on o.symbol = p.symbol and o.ts = p.ts")
