"""Queries P1 to P16, J1 to J9 and T1 to T27, each with its SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions.columns import KEY, rounded
from ..functions.indicators import TR_SQL, _full_sql
from ..operators import signals as S
from ..operators import trades as T
from ..sources import fixtures as X
from ..sources.fixtures import bars, bars_sql
from .clean_queries import EVEN, TWO_SQL, two
from .indicator_queries import SQL as INDICATOR_SQL
from .indicator_queries import VWAP_SQL, adx_sql, ema_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
PARAMS = {"wick_ratio": 1.0, "vol_mult": 1.0}


def _query(name: str, make, sql: str, digits: int = 6) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(make(spark, sf_dir), digits)
    SQL[name] = sql


def r6(*names: str) -> str:
    return ", ".join(f"round({n.split(' as ')[0]}, 6) + 0.0 as {n.split(' as ')[-1]}" for n in names)


def hourly(spark, sf_dir, hours=1) -> DataFrame:
    """Bars with what entries need."""
    return I.session_vwap(I.atr(I.sma(bars(spark, sf_dir, hours), 20, "volume", "volume_sma_20")))


def ind_sql(hours: int = 1) -> str:
    return f"""{bars_sql('b', hours)}, i1 as (select *, {_full_sql('avg(volume)', 'volume', 20)} as volume_sma_20, {TR_SQL} as tr from b),
i2 as (select *, {_full_sql('avg(tr)', 'tr', 14)} as atr from i1), {VWAP_SQL.format(src='i2', out='ind')},
sig as (select *, case when coalesce(vwap, 0) = 0 or coalesce(volume_sma_20, 0) = 0 or volume <= volume_sma_20 then null
  when low <= vwap and close > vwap and least(open, close) - low > abs(close - open) then 'LONG'
  when high >= vwap and close < vwap and high - greatest(open, close) > abs(close - open) then 'SHORT' end as side from ind)"""


PLAN_SQL = """plan0 as (select *, case when side = 'LONG' then 1.0 else -1.0 end as way, coalesce(2 * atr, close * 0.004) as stop, coalesce(4 * atr, close * 0.01) as reach from sig where side is not null),
plan as (select symbol, timeframe, ts, side, close as entry, close - way * stop as sl, close + way * reach as tp, least(floor(200 / nullif(stop, 0)), floor(10000 / nullif(close, 0)))::bigint as qty, stop,
  least(floor(200 / nullif(stop, 0)), floor(10000 / nullif(close, 0))) * stop as risk_amount from plan0
  where least(floor(200 / nullif(stop, 0)), floor(10000 / nullif(close, 0))) >= 1)"""
OUT_SQL = """ends as (select p.symbol, p.timeframe, p.ts, b.ts as last_ts from plan p asof join ind b on b.symbol = p.symbol and b.timeframe = p.timeframe and b.ts >= p.ts + interval 8 hour),
aft as (select p.*, b.ts as bar_ts, b.low as lo, b.high as hi, b.close as cl, b.vwap as vw, date_diff('second', p.ts, b.ts) / 3600.0 as gone, (b.ts at time zone 'UTC' at time zone 'America/New_York') as ny
  from plan p left join ends e using (symbol, timeframe, ts) join ind b on b.symbol = p.symbol and b.timeframe = p.timeframe and b.ts > p.ts and (e.last_ts is null or b.ts <= e.last_ts)),
rs as (select *, case when (side = 'LONG' and lo <= sl) or (side = 'SHORT' and hi >= sl) then 'SL' when (side = 'LONG' and hi >= tp) or (side = 'SHORT' and lo <= tp) then 'TP'
  when (side = 'LONG' and cl < vw) or (side = 'SHORT' and cl > vw) then 'EARLY_EXIT' when gone >= 8 then 'TIME_STOP'
  when isodow(ny) < 6 and hour(ny) * 60 + minute(ny) >= 950 and hour(ny) < 16 then 'SESSION_CLOSE' end as reason from aft),
outs as (select symbol, timeframe, ts, side, entry, sl, tp, bar_ts as exit_ts, reason, case reason when 'SL' then sl when 'TP' then tp else cl end as exit_price from rs where reason is not null
  qualify row_number() over (partition by symbol, timeframe, ts order by bar_ts) = 1),
outcomes as (select *, case when side = 'LONG' then 1.0 else -1.0 end * (exit_price - entry) as pnl, case when side = 'LONG' then 1.0 else -1.0 end * (exit_price - entry) / nullif(greatest(abs(entry - sl), abs(entry) * 0.001), 0) as r_multiple,
  date_diff('second', ts, exit_ts) / 60.0 as minutes from outs)"""
OUTS = "symbol, timeframe, ts, side, exit_ts, reason, " + r6("entry", "sl", "tp", "exit_price", "pnl", "r_multiple", "minutes")


def outcomes(spark, sf_dir, hours=1, capital=10_000.0) -> DataFrame:
    b = hourly(spark, sf_dir, hours)
    return T.bracket_outcomes(S.trade_plan(S.vwap_bounce(b, PARAMS), capital), b)


# Patterns and signals.
PAT_SQL = """pa as (select *, abs(close - open) as body, high - greatest(open, close) as upper_wick, least(open, close) - low as lower_wick, lag(open) over w as po, lag(close) over w as pc from b window w as (partition by symbol, timeframe order by ts)),
pb as (select *, case when lower_wick > 2 * body then 100 else 0 end as pat_wick_bull, case when upper_wick > 2 * body then -100 else 0 end as pat_wick_bear,
  case when lower_wick > 2 * body and upper_wick < body * 0.5 then 100 else 0 end as pat_hammer, case when upper_wick > 2 * body and lower_wick < body * 0.5 then -100 else 0 end as pat_shooting_star,
  case when body <= (high - low) * 0.1 then 100 else 0 end as pat_doji,
  case when close > open and pc < po and open < pc and close > po then 100 when close < open and pc > po and open > pc and close < po then -100 else 0 end as pat_engulfing from pa)"""
B1 = bars_sql("b", 1)
_query("p01_candle_anatomy", lambda s, d: S.candle_anatomy(bars(s, d)).select(*KEY, "body", "upper_wick", "lower_wick", "pat_wick_bull", "pat_wick_bear"), f"with {B1}, {PAT_SQL} select symbol, timeframe, ts, {r6('body', 'upper_wick', 'lower_wick')}, pat_wick_bull, pat_wick_bear from pb")
_query("p02_single_bar_patterns", lambda s, d: S.single_bar_patterns(bars(s, d)).select(*KEY, "pat_hammer", "pat_shooting_star", "pat_doji"), f"with {B1}, {PAT_SQL} select symbol, timeframe, ts, pat_hammer, pat_shooting_star, pat_doji from pb")
_query("p03_engulfing", lambda s, d: S.engulfing(bars(s, d)).select(*KEY, "pat_engulfing"), f"with {B1}, {PAT_SQL} select symbol, timeframe, ts, pat_engulfing from pb")
_query("p04_reversal_flags", lambda s, d: S.reversal_flags(bars(s, d)).select(*KEY, "bullish_reversal", "bearish_reversal", "wick_direction"),
       f"with {B1}, {PAT_SQL} select symbol, timeframe, ts, pat_hammer > 0 or pat_engulfing > 0 or pat_doji <> 0 as bullish_reversal, pat_shooting_star <> 0 or pat_engulfing < 0 or pat_doji <> 0 as bearish_reversal, case when pat_wick_bull > 0 then 1 when pat_wick_bear < 0 then -1 else 0 end as wick_direction from pb")
_query("p05_vwap_bounce", lambda s, d: S.vwap_bounce(hourly(s, d), PARAMS).select(*KEY, "side", "close"), f"with {ind_sql()} select symbol, timeframe, ts, side, close from sig where side is not null")


def pullback(s, d) -> DataFrame:
    day = I.adx(I.ema(bars(s, d, 24), {"day_ema": ("close", 10)}), 5).select("symbol", "ts", F.col("close").alias("day_close"), "day_ema", F.col("adx").alias("day_adx"), F.col("plus_di").alias("day_plus"), F.col("minus_di").alias("day_minus"))
    hour = I.ema(bars(s, d), {"ema_20": ("close", 20)})
    return S.ema_pullback(T.asof_daily(hour, day, ["day_close", "day_ema", "day_adx", "day_plus", "day_minus"]), {"adx_min": 10.0})



_query("p06_j02_ema_pullback", lambda s, d: pullback(s, d).select(*KEY, "side", "close", "day_adx"),
       f"""with recursive {B1}, {bars_sql('dd', 24)}, {ema_sql('dd', 'd1', {'day_ema': ('close', 10)}, '')}, {adx_sql('d1', 'd2').replace('= 14', '= 5').replace('13 preceding', '4 preceding')},
d3 as (select symbol, ts, lag(close) over w as day_close, lag(day_ema) over w as day_ema, lag(adx) over w as day_adx, lag(plus_di) over w as day_plus, lag(minus_di) over w as day_minus, lag(ts) over w as had from d2 window w as (partition by symbol order by ts)),
{ema_sql('b', 'h1', {'ema_20': ('close', 20)}, '')}, jj as (select h1.*, d3.* exclude (symbol, ts) from h1 asof left join (select * from d3 where had is not null) d3 on h1.symbol = d3.symbol and h1.ts >= d3.ts),
ss as (select *, case when day_adx > 10 and day_close > day_ema and day_plus > day_minus and low <= ema_20 and close > ema_20 then 'LONG' when day_adx > 10 and day_close < day_ema and day_minus > day_plus and high >= ema_20 and close < ema_20 then 'SHORT' end as side from jj)
select symbol, timeframe, ts, side, close, {r6('day_adx')} from ss where side is not null""")
_query("p07_condition_funnel", lambda s, d: S.condition_funnel(hourly(s, d), {"volume": F.col("volume") > F.col("volume_sma_20"), "touch": F.col("low") <= F.col("vwap"), "above": F.col("close") > F.col("vwap")}),
       f"""with {ind_sql()}, c as (select volume > volume_sma_20 as a, low <= vwap as t, close > vwap as u from ind), n as (select count(*) as bars, count(*) filter (a) as a1, count(*) filter (t) as t1, count(*) filter (u) as u1, count(*) filter (a and t) as t2, count(*) filter (a and t and u) as u2 from c)
select 0 as step, 'volume' as condition, a1 as passed, a1 as passed_all, bars from n union all select 1, 'touch', t1, t2, bars from n union all select 2, 'above', u1, u2, bars from n""")


def scored(s, d) -> DataFrame:
    return S.score_card(I.volume_oscillator(I.macd(I.cumulative_vwap(I.bollinger(I.roc(I.rsi(I.atr(bars(s, d)))))))))


def _ladder_sql(value: str, ladder) -> tuple[str, str]:
    kind, steps, rest = ladder
    return ("case " + " ".join(f"when {value} {kind} {b} then {p}" for p, _, b in steps) + " else 0 end", "case " + " ".join(f"when {value} {kind} {b} then '{n}'" for _, n, b in steps) + f" else '{rest}' end")


VALUES = {"rsi": "coalesce(rsi, 50.0)", "vwap": "abs(coalesce(vwap_dev, 0.0))", "roc": "coalesce(roc, 0.0)", "bollinger": "coalesce(bb_pct, 0.5)", "volume": "coalesce(vol_osc, 0.0)"}


def _body(name: str) -> str:
    """The relations of an indicator's SQL, from b to r, under a prefix of its own."""
    sql = INDICATOR_SQL[name].replace(bars_sql("b", 1, True), B1)
    return sql


def score_sql() -> str:
    parts = {"i03_rsi": ["rsi"], "i08_cumulative_vwap": ["cum_vwap", "vwap_dev"], "i14_roc": ["roc"], "i04_bollinger": ["bb_upper", "bb_lower", "bb_pct"], "i16_volume_oscillator": ["vol_osc"], "i12_macd": ["macd_hist", "macd_cross"], "i05_atr": ["atr", "atr_pct", "volatility"]}
    joined = " ".join(f"join ({_body(n).replace(', 6) + 0.0', ', 15) + 0.0')}) {n} using (symbol, timeframe, ts)" for n in parts)
    cols = ", ".join(c for cs in parts.values() for c in cs)
    points, labels = [], []
    for side, ladders, sign, cross in (("long", S.LONG_LADDERS, "", "BULLISH"), ("short", S.SHORT_LADDERS, "-", "BEARISH")):
        macd = f"case when macd_cross = '{cross}' then 20 when {sign}coalesce(macd_hist, 0.0) > 0 then 15 when {sign}coalesce(macd_hist, 0.0) > -0.01 then 10 else 0 end"
        both = {k: _ladder_sql(VALUES[k], v) for k, v in ladders.items()}
        points.append(" + ".join([macd, *(f"({p})" for p, _ in both.values())]) + f" as {side}_score")
        labels += [f"{both[k][1]} as {side}_{k}_label" for k in ("rsi", "volume")]
    return f"with {B1}, al as (select b.*, {cols} from b {joined}), sc as (select *, {', '.join(points + labels)} from al)"


_query("p08_score_card", lambda s, d: scored(s, d).select(*KEY, "long_score", "short_score", "long_rsi_label", "long_volume_label", "short_rsi_label", "short_volume_label"), f"{score_sql()} select symbol, timeframe, ts, long_score, short_score, long_rsi_label, long_volume_label, short_rsi_label, short_volume_label from sc")
_query("p09_signal_quality", lambda s, d: S.signal_quality(scored(s, d), "long_score").select(*KEY, "entry_quality", "confidence"),
       f"{score_sql()} select symbol, timeframe, ts, case when long_score >= 75 then 'FULL_ENTRY' when long_score >= 55 then 'PARTIAL_ENTRY' else 'NO_TRADE' end as entry_quality, case when long_score >= 75 then 'VERY_HIGH' when long_score >= 65 then 'HIGH' when long_score >= 55 then 'MEDIUM' else 'LOW' end as confidence from sc")
_query("p10_market_context", lambda s, d: S.market_context(scored(s, d)).select(*KEY, "market_context"),
       f"""{score_sql()} select symbol, timeframe, ts, array_to_string(list_filter([case when coalesce(roc, 0) > 2 then 'STRONG_UPTREND' when coalesce(roc, 0) > 0.5 then 'UPTREND' when coalesce(roc, 0) < -2 then 'STRONG_DOWNTREND' when coalesce(roc, 0) < -0.5 then 'DOWNTREND' else 'SIDEWAYS' end,
case when coalesce(atr_pct, 1.5) > 3 then 'HIGH_VOLATILITY' when coalesce(atr_pct, 1.5) < 1 then 'LOW_VOLATILITY' end, case when coalesce(vol_osc, 0) > 50 then 'HIGH_VOLUME' when coalesce(vol_osc, 0) < 0 then 'LOW_VOLUME' end,
case when coalesce(bb_pct, 0.5) > 0.8 then 'RANGE_TOP' when coalesce(bb_pct, 0.5) < 0.2 then 'RANGE_BOTTOM' end], lambda x: x is not null)[1:3], ' | ') as market_context from sc""")
_query("p11_new_signals", lambda s, d: S.new_signals(S.vwap_bounce(hourly(s, d), PARAMS).select(*KEY, "side"), bars(s, d, where=EVEN).filter("volume > 60").select("symbol", "ts"), bars(s, d, 24).filter("high > 495 and symbol = 'click'").select("symbol")),
       f"with {ind_sql()}, {bars_sql('st', 1, False, EVEN)}, {bars_sql('da', 24)} select symbol, timeframe, ts, side from sig where side is not null and not exists (select 1 from st where st.symbol = sig.symbol and st.ts = sig.ts and st.volume > 60) and symbol not in (select symbol from da where high > 495 and symbol = 'click')")
_query("p12_position_size", lambda s, d: S.position_size(S.vwap_bounce(hourly(s, d), PARAMS), 10_000.0, 0.02).select(*KEY, "qty"), f"with {ind_sql()} select symbol, timeframe, ts, least(floor(200.0 / nullif(2 * atr, 0)), floor(10000 / nullif(close, 0)))::bigint as qty from sig where side is not null and least(floor(200.0 / nullif(2 * atr, 0)), floor(10000 / nullif(close, 0))) >= 1")
_query("p13_volatility_multiplier", lambda s, d: S.volatility_multiplier(hourly(s, d).withColumn("atr_avg", I.mean(F.col("atr"), 20))).select(*KEY, "size_factor"),
       f"with {ind_sql()}, v as (select *, atr / nullif({_full_sql('avg(atr)', 'atr', 20)}, 0) as x from ind) select symbol, timeframe, ts, case when x > 2 then 0.5 when x > 1.5 then 0.75 else 1.0 end::double as size_factor from v")
_query("p14_trade_plan", lambda s, d: S.trade_plan(S.vwap_bounce(hourly(s, d), PARAMS)).select(*KEY, "side", "qty", "risk_amount", F.explode("orders").alias("o")).select(*KEY, "side", F.col("qty").cast("bigint").alias("qty"), "risk_amount", "o.kind", "o.price"),
       f"with {ind_sql()}, {PLAN_SQL}, o as (select *, unnest([{{'kind': 'ENTRY', 'price': entry}}, {{'kind': 'SL', 'price': sl}}, {{'kind': 'TP', 'price': tp}}]) as o from plan) select symbol, timeframe, ts, side, qty, {r6('risk_amount')}, o.kind as kind, {r6('o.price as price')} from o")
_query("p16_pivots", lambda s, d: S.pivots(bars(s, d)),
       f"""with {B1}, n as (select *, lag(high) over w as h1, lag(high, 2) over w as h2, lead(high) over w as h3, lead(high, 2) over w as h4, lag(low) over w as l1, lag(low, 2) over w as l2, lead(low) over w as l3, lead(low, 2) over w as l4 from b window w as (partition by symbol, timeframe order by ts)),
p as (select symbol, timeframe, ts, 'HIGH' as kind, high as level from n where high > h1 and high > h2 and high > h3 and high > h4 union all select symbol, timeframe, ts, 'LOW', low from n where low < l1 and low < l2 and low < l3 and low < l4),
q as (select * from p qualify row_number() over (partition by symbol, timeframe, kind order by ts desc) <= 50)
select q.symbol, q.timeframe, q.ts, q.kind, q.level, count(*) as touches from q join b on b.symbol = q.symbol and b.timeframe = q.timeframe and abs(case when kind = 'HIGH' then b.high else b.low end - level) <= 0.002 * level group by all""")

# Joins.
_query("j01_join_indicators", lambda s, d: bars(s, d).select(*KEY, "close").join(hourly(s, d).select(*KEY, "vwap", "atr"), KEY), f"with {ind_sql()} select symbol, timeframe, ts, close, {r6('vwap', 'atr')} from ind")
_query("j04_active_positions", lambda s, d: T.active_positions(X.executions(s, d)), f"with {X.EXECUTIONS_SQL}, a as (select symbol, sum(case when status = 'FILLED' and execution_type = 'ENTRY' then quantity else 0 end) as entered, sum(case when status = 'FILLED' and execution_type <> 'ENTRY' then quantity else 0 end) as exited from executions group by 1) select * from a where entered > exited")
_query("j05_bars_after", lambda s, d: T.bars_after(S.vwap_bounce(hourly(s, d), PARAMS).select(*KEY, "side"), bars(s, d), 8).select(*KEY, "side", "bar_ts", "bar_close"), f"with {ind_sql()} select g.symbol, g.timeframe, g.ts, g.side, b.ts as bar_ts, b.close as bar_close from sig g join b on b.symbol = g.symbol and b.ts > g.ts and b.ts <= g.ts + interval 8 hour where side is not null")
_query("j06_compare_sources", lambda s, d: T.compare_sources(*two(s, d), KEY, ["close", "volume"]), f"with {TWO_SQL} select coalesce(p.symbol, s.symbol) as symbol, coalesce(p.timeframe, s.timeframe) as timeframe, coalesce(p.ts, s.ts) as ts, case when s.symbol is null then 'ONLY_LEFT' when p.symbol is null then 'ONLY_RIGHT' when p.close = s.close and p.volume = s.volume then 'SAME' else 'DIFFERENT' end as status from p full join s on p.symbol = s.symbol and p.ts = s.ts")
_query("j07_variant_delta", lambda s, d: T.variant_delta(X.trades(s, d).groupBy("symbol", "side").agg(F.sum("pnl").alias("pnl")), ["symbol"], "side", "pnl", "LONG", "SHORT"),
       f"with {X.TRADES_SQL}, w as (select symbol, sum(pnl) filter (side = 'LONG') as base, sum(pnl) filter (side = 'SHORT') as variant from trades group by 1) select symbol, {r6('base', 'variant', 'variant - base as delta', '100 * (base - variant) / nullif(base, 0) as reduction_pct')} from w")


def grid(spark) -> DataFrame:
    return spark.createDataFrame([(i, w, v) for i, (w, v) in enumerate((w, v) for w in (0.5, 1.0, 2.0) for v in (1.0, 1.5))], "param_id int, wick_ratio double, vol_mult double")


GRID_SQL = "params(param_id, wick_ratio, vol_mult) as (values (0, 0.5, 1.0), (1, 0.5, 1.5), (2, 1.0, 1.0), (3, 1.0, 1.5), (4, 2.0, 1.0), (5, 2.0, 1.5))"
SWEEP = {"wick_ratio": "wick_ratio", "vol_mult": "vol_mult"}
SWEEP_SIG = """psig as (select * from (select ind.*, param_id, case when coalesce(vwap, 0) = 0 or coalesce(volume_sma_20, 0) = 0 or volume <= volume_sma_20 * vol_mult then null
  when low <= vwap and close > vwap and least(open, close) - low > wick_ratio * abs(close - open) then 'LONG' when high >= vwap and close < vwap and high - greatest(open, close) > wick_ratio * abs(close - open) then 'SHORT' end as side from ind cross join params) where side is not null)"""
_query("j08_with_params", lambda s, d: S.vwap_bounce(T.with_params(hourly(s, d), grid(s)), SWEEP).groupBy("param_id", "side").agg(F.count("*").alias("n")), f"with {ind_sql()}, {GRID_SQL}, {SWEEP_SIG} select param_id, side, count(*) as n from psig group by all")
_query("j09_key_sets", lambda s, d: T.key_sets(*two(s, d), KEY), f"with {TWO_SQL}, f as (select p.symbol as l, s.symbol as r from p full join s on p.symbol = s.symbol and p.ts = s.ts) select count(*) filter (l is not null and r is not null) as common, count(*) filter (r is null) as only_left, count(*) filter (l is null) as only_right, count(*) as all_keys from f")

# Fills and outcomes.
_query("t01_next_bar_fills", lambda s, d: T.next_bar_fills(S.vwap_bounce(hourly(s, d), PARAMS).select(*KEY, "side"), bars(s, d)).select(*KEY, "side", "fill_ts", "fill_price", "fee"),
       f"with {ind_sql()}, n as (select *, lead(ts) over w as fill_ts, lead(open) over w as no from sig window w as (partition by symbol, timeframe order by ts)), f as (select *, no * case when side = 'LONG' then 1.0005 else 0.9995 end as fill_price from n where side is not null and fill_ts is not null) select symbol, timeframe, ts, side, fill_ts, {r6('fill_price', 'fill_price * 0.001 as fee')} from f")


def orders(s, d) -> DataFrame:
    p = S.vwap_bounce(hourly(s, d), PARAMS).withColumn("order_id", F.concat_ws("|", "symbol", F.date_format("ts", "yyyyMMddHH")))
    return p.select(*KEY, "order_id", F.when(F.col("side") == "LONG", "BUY").otherwise("SELL").alias("side"), F.when(F.hour("ts") % 2 == 0, "LIMIT").otherwise("STOP").alias("kind"), (F.col("close") * F.when((F.col("side") == "LONG") == (F.hour("ts") % 2 == 0), 0.9).otherwise(1.1)).alias("level"))


_query("t02_order_fills", lambda s, d: T.order_fills(orders(s, d), bars(s, d)),
       f"""with {ind_sql()}, o as (select symbol, timeframe, ts, symbol || '|' || strftime(ts, '%Y%m%d%H') as order_id, case when side = 'LONG' then 'BUY' else 'SELL' end as side, case when hour(ts) % 2 = 0 then 'LIMIT' else 'STOP' end as kind, close * case when (side = 'LONG') = (hour(ts) % 2 = 0) then 0.9 else 1.1 end as level from sig where side is not null),
h as (select o.*, b.ts as fill_ts, (o.side = 'BUY') = (o.kind = 'LIMIT') as below, b.open as bo, b.low as bl, b.high as bh from o join b on b.symbol = o.symbol and b.ts > o.ts)
select order_id, symbol, side, kind, {r6('level')}, fill_ts, {r6('case when below then least(bo, level) else greatest(bo, level) end as fill_price')} from h where case when below then bl <= level else bh >= level end qualify row_number() over (partition by order_id order by fill_ts) = 1""")
_query("t03_bracket_outcomes", outcomes, f"with {ind_sql()}, {PLAN_SQL}, {OUT_SQL} select {OUTS} from outcomes")
_query("t04_excursions", lambda s, d: T.excursions(outcomes(s, d), bars(s, d)).select(*KEY, "side", "mfe_pct", "mae_pct"),
       f"""with {ind_sql()}, {PLAN_SQL}, {OUT_SQL}, e as (select o.symbol, o.timeframe, o.ts, o.side, 100 * (max(b.high) - o.entry) / nullif(o.entry, 0) as u, 100 * (min(b.low) - o.entry) / nullif(o.entry, 0) as d from outcomes o join b on b.symbol = o.symbol and b.ts > o.ts and b.ts <= o.exit_ts group by o.symbol, o.timeframe, o.ts, o.side, o.entry)
select symbol, timeframe, ts, side, {r6("case when side = 'LONG' then u else -d end as mfe_pct", "case when side = 'LONG' then d else -u end as mae_pct")} from e""")


def greedy_sql(source: str, out: str, keys: str) -> str:
    """Recursion from each kept trade to the first that starts after its exit."""
    on = " and ".join(f"o.{k} = g.{k}" for k in keys.split(", "))
    return f"""{out} as (
  select * from (select * from {source} qualify row_number() over (partition by {keys} order by ts) = 1)
  union all select o.* from (select g.{', g.'.join(keys.split(', '))}, min(o.ts) as nts from {out} g join {source} o on {on} and o.ts > g.exit_ts group by all) n join {source} o on {' and '.join(f'o.{k} = n.{k}' for k in keys.split(', '))} and o.ts = n.nts)"""


_query("t05_one_position", lambda s, d: T.one_position(outcomes(s, d), ["symbol", "timeframe"]).select(*KEY, "exit_ts", "reason"), f"with recursive {ind_sql()}, {PLAN_SQL}, {OUT_SQL}, {greedy_sql('outcomes', 'kept', 'symbol, timeframe')} select symbol, timeframe, ts, exit_ts, reason from kept")
_query("t06_match_fifo", lambda s, d: T.match_fifo(X.fills(s, d)),
       f"""with {X.FILLS_SQL}, c as (select *, sum(qty::decimal(28,9)) over (partition by symbol, side order by ts, seq rows between unbounded preceding and current row) as x, commission / qty as fee from fills),
cb as (select symbol, x, ts, seq, price, fee from c where side = 'BUY'), cs as (select symbol, x, ts, seq, price, fee from c where side = 'SELL'),
cut as (select symbol, x, x - coalesce(lag(x) over (partition by symbol order by x), 0) as qty from (select symbol, x from cb union select symbol, x from cs)),
l as (select k.symbol, qty::double as qty, b.ts as bts, b.price as bp, s.ts as sts, s.price as sp, b.fee + s.fee as fee, (b.ts, b.seq) < (s.ts, s.seq) as lg
  from (select cut.symbol, cut.x, cut.qty, min(cb.x) as bx, min(cs.x) as sx from cut asof join cb on cb.symbol = cut.symbol and cut.x <= cb.x asof join cs on cs.symbol = cut.symbol and cut.x <= cs.x group by all) k
  join cb b on b.symbol = k.symbol and b.x = k.bx join cs s on s.symbol = k.symbol and s.x = k.sx)
select symbol, case when lg then 'LONG' else 'SHORT' end as side, case when lg then bts else sts end as entry_ts, case when lg then sts else bts end as exit_ts, {r6('case when lg then bp else sp end as entry_price', 'case when lg then sp else bp end as exit_price', 'qty', '(sp - bp) * qty - fee * qty as pnl')} from l""", 7)
SQL["t06_match_fifo"] = SQL["t06_match_fifo"].replace(", 6) + 0.0", ", 7) + 0.0")
POS_SQL = "pos as (select *, sum(case when side = 'BUY' then qty else -qty end) over w as position, sum(case when side = 'BUY' then -qty * price else qty * price end - commission) over w as cash from fills window w as (partition by symbol order by ts, seq rows between unbounded preceding and current row))"
_query("t07_running_position", lambda s, d: T.running_position(X.fills(s, d)).select("symbol", "ts", "side", "qty", "position", "cash"), f"with {X.FILLS_SQL}, {POS_SQL} select symbol, ts, side, qty, position, round(cash, 6) + 0.0 as cash from pos")


def curve(s, d) -> DataFrame:
    f = X.fills(s, d)
    return T.equity_curve(f, f.groupBy("symbol", "ts").agg(F.max_by("price", "seq").alias("close")), 1_000_000.0)


EQ_SQL = f"""{X.FILLS_SQL}, m as (select symbol, ts, sum(case when side = 'BUY' then qty else -qty end) as q, sum((case when side = 'BUY' then -qty * price else qty * price end - commission)::decimal(28,7)) as m, arg_max(price, seq) as close from fills group by all),
e0 as (select *, sum(q) over w as qty, 1000000.0::double + (sum(m) over w)::double as cash from m window w as (partition by symbol order by ts rows between unbounded preceding and current row)),
e1 as (select *, cash + qty * close as equity from e0), e2 as (select *, max(equity) over (partition by symbol order by ts rows between unbounded preceding and current row) as peak from e1), eq as (select *, 100 * (equity - peak) / nullif(peak, 0) as drawdown_pct from e2)"""
QUERIES["t08_equity_curve"] = curve  # exact cash, so nothing is rounded
SQL["t08_equity_curve"] = f"with {EQ_SQL} select symbol, ts, cash, qty, equity, peak, drawdown_pct from eq"
_query("t09_return_metrics", lambda s, d: T.return_metrics(curve(s, d)), f"with {EQ_SQL}, r as (select *, (equity - lag(equity) over w) / nullif(lag(equity) over w, 0) as r from eq window w as (partition by symbol order by ts)), g as (select symbol, arg_min(equity, ts) as f, arg_max(equity, ts) as l, min(drawdown_pct) as max_drawdown_pct, arg_min(ts, (drawdown_pct, ts)) as drawdown_ts, avg(r) / nullif(stddev_samp(r), 0) * sqrt(252) as sharpe from r group by 1) select symbol, {r6('100 * (l - f) / nullif(f, 0) as total_return_pct', 'max_drawdown_pct')}, drawdown_ts, {r6('sharpe')} from g")
_query("t10_round_trips", lambda s, d: T.round_trips(X.fills(s, d)), f"with {X.FILLS_SQL}, {POS_SQL}, e as (select *, (abs(position) < 1e-9)::int as flat from pos), k as (select *, coalesce(sum(flat) over (partition by symbol order by ts, seq rows between unbounded preceding and 1 preceding), 0)::bigint as episode from e) select symbol, episode, arg_min(side, (ts, seq)) as first_side, sum(qty) filter (side = 'BUY') as bought, sum(qty) filter (side = 'SELL') as sold, round(sum(case when side = 'BUY' then -qty * price else qty * price end - commission), 3) + 0.0 as pnl, count(*) as fills from k group by symbol, episode having max(flat) = 1", 3)
TR = f"with {X.TRADES_SQL}"
SUMMARY_SQL = "count(*) as trades, round(100.0 * count(*) filter (pnl > 0) / count(*), 4) + 0.0 as win_rate, round(sum(pnl) filter (pnl > 0) / nullif(abs(sum(pnl) filter (pnl <= 0)), 0), 4) + 0.0 as profit_factor, round(sum(pnl), 4) + 0.0 as total_pnl"
_query("t11_metric_summary", lambda s, d: T.metric_summary(X.trades(s, d)), f"{TR} select symbol, coalesce(side, 'ALL') as side, {SUMMARY_SQL} from trades group by grouping sets ((symbol), (symbol, side))", 4)
_query("t12_symbol_stats", lambda s, d: T.symbol_stats(X.trades(s, d)), f"{TR} select symbol, count(*) as trades, count(*) filter (pnl > 0) as wins, count(*) filter (pnl < 0) as losses, {r6('avg(pnl) filter (pnl > 0) as avg_win', 'avg(pnl) filter (pnl < 0) as avg_loss', 'max(pnl) as largest_win', 'min(pnl) as largest_loss')} from trades group by symbol")
_query("t13_by_exit_reason", lambda s, d: T.by_exit_reason(X.trades(s, d)), f"{TR} select exit_reason, count(*) as n, round(avg(pnl), 3) + 0.0 as mean_pnl, round(sum(pnl), 3) + 0.0 as sum_pnl, round(min(pnl), 3) + 0.0 as min_pnl, round(max(pnl), 3) + 0.0 as max_pnl from trades group by 1", 3)
_query("t14_bucketed", lambda s, d: T.bucketed(X.trades(s, d), "adx", [0, 20, 25, 40, 60, 100, 200]), f"{TR}, k(bucket, a, b) as (values ('(0, 20]', 0, 20), ('(20, 25]', 20, 25), ('(25, 40]', 25, 40), ('(40, 60]', 40, 60), ('(60, 100]', 60, 100), ('(100, 200]', 100, 200)) select bucket, count(adx) as n, {r6('avg(pnl) as mean_pnl', '100.0 * count(*) filter (pnl > 0) / nullif(count(adx), 0) as win_rate')} from k left join trades on adx > a and adx <= b group by bucket")
_query("t15_correlations", lambda s, d: T.correlations(X.trades(s, d), ["adx", "strength"], ["pnl", "commission"]), f"{TR}, c as (select unnest([{{'x': 'adx', 'y': 'pnl', 'r': corr(adx, pnl)}}, {{'x': 'adx', 'y': 'commission', 'r': corr(adx, commission)}}, {{'x': 'strength', 'y': 'pnl', 'r': corr(strength, pnl)}}, {{'x': 'strength', 'y': 'commission', 'r': corr(strength, commission)}}]) as u from trades) select u.x as x, u.y as y, {r6('u.r as r')} from c")
_query("t16_winners_vs_losers", lambda s, d: T.winners_vs_losers(X.trades(s, d), ["adx", "strength"]), f"{TR}, w as (select 'adx' as metric, avg(adx) filter (pnl > 0) as winners, avg(adx) filter (not pnl > 0) as losers from trades union all select 'strength', avg(strength) filter (pnl > 0), avg(strength) filter (not pnl > 0) from trades) select metric, {r6('winners', 'losers', '100 * (winners - losers) / nullif(abs(losers), 0) as delta_pct')} from w")
_query("t17_relabel_exits", lambda s, d: T.relabel_exits(outcomes(s, d).withColumn("exit_reason", F.lit("UNKNOWN"))).groupBy("reason", "exit_reason").agg(F.count("*").alias("n")), f"with {ind_sql()}, {PLAN_SQL}, {OUT_SQL} select reason, case when abs((exit_price - tp) / nullif(tp, 0)) < 0.005 then 'TP' when abs((exit_price - sl) / nullif(sl, 0)) < 0.005 then 'SL' else 'UNKNOWN' end as exit_reason, count(*) as n from outcomes group by all")
_query("t18_cost_impact", lambda s, d: T.cost_impact(X.trades(s, d)), f"{TR} select round(sum(pnl + commission), 3) + 0.0 as gross, round(sum(pnl), 3) + 0.0 as net, round(sum(commission), 3) + 0.0 as commissions, round(100 * sum(commission) / sum(pnl + commission) filter (pnl + commission > 0), 3) + 0.0 as commission_pct, count(*) filter (pnl + commission > 0 and pnl <= 0) as turned_losers from trades", 3)
_query("t19_top_k", lambda s, d: T.top_k(T.symbol_stats(X.trades(s, d)).select("symbol", "trades", "wins"), "wins", 10, ["symbol"]), f"{TR} select symbol, count(*) as trades, count(*) filter (pnl > 0) as wins from trades group by 1 order by wins desc, symbol limit 10")
_query("t20_sweep", lambda s, d: T.sweep(hourly(s, d), grid(s), lambda b: S.trade_plan(S.vwap_bounce(b, SWEEP))),
       f"""with recursive {ind_sql()}, {GRID_SQL}, {SWEEP_SIG}, {PLAN_SQL.replace('from sig where side is not null', 'from psig').replace('select symbol, timeframe, ts, side,', 'select param_id, symbol, timeframe, ts, side,')},
{OUT_SQL.replace('outs as (select symbol', 'outs as (select param_id, symbol').replace('partition by symbol, timeframe, ts', 'partition by param_id, symbol, timeframe, ts')}, {greedy_sql('outcomes', 'kept', 'param_id, symbol, timeframe')} select symbol, param_id, {SUMMARY_SQL} from kept group by all""", 4)


def alerts(s, d) -> DataFrame:
    return S.trade_plan(S.vwap_bounce(hourly(s, d), PARAMS)).select(*KEY, "side", "entry", "sl")


_query("t21_daily_outcomes", lambda s, d: outcomes(s, d).groupBy(F.to_date("exit_ts").alias("day"), "reason").agg(F.count("*").alias("n"), F.sum("r_multiple").alias("r"), F.sum("pnl").alias("usd")), f"with {ind_sql()}, {PLAN_SQL}, {OUT_SQL} select exit_ts::date as day, reason, count(*) as n, {r6('sum(r_multiple) as r', 'sum(pnl) as usd')} from outcomes group by all")
_query("t22_floating_r", lambda s, d: alerts(s, d).join(bars(s, d).groupBy("symbol").agg(F.max_by("close", "ts").alias("now")), "symbol").select(*KEY, "side", (F.when(F.col("side") == "LONG", 1.0).otherwise(-1.0) * (F.col("now") - F.col("entry")) / F.when(F.col("entry") == F.col("sl"), 0.01).otherwise(F.abs(F.col("entry") - F.col("sl")))).alias("floating_r")),
       f"with {ind_sql()}, {PLAN_SQL}, n as (select symbol, arg_max(close, ts) as now from b group by 1) select symbol, timeframe, ts, side, {r6("case when side = 'LONG' then 1.0 else -1.0 end * (now - entry) / case when entry = sl then 0.01 else abs(entry - sl) end as floating_r")} from plan join n using (symbol)")
_query("t23_adaptive_slippage", lambda s, d: T.adaptive_slippage(hourly(s, d).withColumn("vol_ratio", F.try_divide("volume", "volume_sma_20"))).select(*KEY, "slippage"),
       f"with {ind_sql()}, a as (select *, atr / nullif(close, 0) * 100 as ap, volume / nullif(volume_sma_20, 0) as vr from ind) select symbol, timeframe, ts, {r6('least(0.0005 * case when ap > 3 then 2.0 when ap > 2 then 1.5 else 1.0 end * case when vr < 0.5 then 2.0 when vr < 1 then 1.5 else 1.0 end, 0.002)::double as slippage')} from a")
EX = f"with {X.EXECUTIONS_SQL}"
_query("t24_position_summary", lambda s, d: T.position_summary(X.executions(s, d)), f"""{EX} select symbol, position_id, count(*) filter (status = 'FILLED') as filled, count(*) filter (status = 'PENDING') as pending, count(*) filter (status = 'CANCELLED') as cancelled,
{r6("coalesce(sum(quantity) filter (status = 'FILLED' and execution_type = 'ENTRY'), 0) as shares", "coalesce(sum(quantity * executed_price) filter (status = 'FILLED' and execution_type = 'ENTRY'), 0) as invested", "coalesce(sum(quantity * executed_price) filter (status = 'FILLED' and execution_type <> 'ENTRY'), 0) as proceeds")}, count(*) as levels, {r6("100.0 * count(*) filter (status = 'FILLED') / count(*) as progress_pct")} from executions group by all""")
_query("t25_execution_stats", lambda s, d: T.execution_stats(X.executions(s, d), dt.datetime(1994, 1, 1)), f"""{EX} select count(*) as total, count(*) filter (status = 'FILLED') as filled, count(*) filter (status = 'PENDING') as pending, count(*) filter (status = 'CANCELLED') as cancelled,
count(*) filter (execution_type = 'ENTRY') as entries, count(*) filter (execution_type = 'EXIT') as exits, {r6("100.0 * count(*) filter (status = 'FILLED') / count(*) as fill_rate", "100.0 * count(*) filter (status = 'CANCELLED') / count(*) as cancel_rate")}, count(distinct symbol) as symbols from executions where created_at >= '1994-01-01'""")
_query("t25b_execution_top", lambda s, d: T.execution_top(X.executions(s, d), dt.datetime(1994, 1, 1)), f"{EX} select symbol, count(*) as total, count(*) filter (status = 'FILLED') as filled, {r6("avg(executed_price) filter (status = 'FILLED') as avg_price")} from executions where created_at >= '1994-01-01' group by symbol order by total desc, symbol limit 10")
_query("t26_position_status", lambda s, d: T.position_status(X.executions(s, d)), f"""{EX}, g as (select symbol, position_id, count(*) filter (execution_type = 'ENTRY') as e, count(*) filter (execution_type = 'ENTRY' and status = 'FILLED') as ef, count(*) filter (execution_type = 'EXIT') as x, count(*) filter (execution_type = 'EXIT' and status = 'FILLED') as xf, count(*) filter (execution_type = 'STOP_LOSS' and status = 'FILLED') as sf,
sum(quantity * executed_price) filter (status = 'FILLED' and execution_type = 'ENTRY') / sum(quantity) filter (status = 'FILLED' and execution_type = 'ENTRY') as avg_entry from executions group by all)
select symbol, position_id, case when sf > 0 then 'STOPPED' when x > 0 and xf = x then 'CLOSED' when xf > 0 then 'EXITING' when ef = 0 then 'PENDING' when ef < e then 'PARTIAL' else 'OPEN' end as position_status, {r6('avg_entry')} from g""")
_query("t27_level_touches", lambda s, d: T.level_touches(alerts(s, d).select("symbol", F.date_format("ts", "yyyyMMddHH").alias("level_id"), F.when(F.col("side") == "LONG", "BUY").otherwise("SELL").alias("side"), F.col("entry").alias("level")), bars(s, d).groupBy("symbol").agg(F.max_by("high", "ts").alias("high"), F.max_by("low", "ts").alias("low"))).select("symbol", "level_id", "side", "touched", "executed_price", "slippage_pct"),
       f"""with {ind_sql()}, {PLAN_SQL}, n as (select symbol, arg_max(high, ts) as high, arg_max(low, ts) as low from b group by 1), t as (select symbol, strftime(ts, '%Y%m%d%H') as level_id, case when side = 'LONG' then 'BUY' else 'SELL' end as side, entry as level, high, low from plan join n using (symbol)),
u as (select *, case when side = 'BUY' then low <= level * 1.001 else high >= level * 0.999 end as touched from t), v as (select *, case when touched then case when side = 'BUY' then least(level, high) else greatest(level, low) end end as executed_price from u) select symbol, level_id, side, touched, {r6('executed_price', '100 * (executed_price - level) / nullif(level, 0) as slippage_pct')} from v""")
_query("entry_vwap_bounce", lambda s, d: outcomes(s, d, 4, 1_000_000.0), f"with {ind_sql(4)}, {PLAN_SQL.replace('floor(200 ', 'floor(20000 ').replace('floor(10000 ', 'floor(1000000 ')}, {OUT_SQL} select {OUTS} from outcomes")
