"""Queries I1 to I20 over hourly bars, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import indicators as I
from ..functions.columns import KEY, rounded
from ..functions.indicators import P_SQL, TR_SQL, _full_sql, ema_sql
from ..sources.fixtures import bars, bars_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, make, columns: list[str], prelude: str, select: str, gappy: bool = True, digits: int = 6) -> None:
    """Register ``make(bars)[key, columns]``; ``prelude`` defines relation r with these columns from b."""

    def run(spark, sf_dir) -> DataFrame:
        return rounded(make(bars(spark, sf_dir, 1, gappy)).select(*KEY, *columns), digits)

    QUERIES[name] = run
    outer = ", ".join(f"round({c}, {digits}) + 0.0 as {c}" if kind == "d" else c for c, kind in (x.split(":") for x in select.split()))
    SQL[name] = f"with recursive {bars_sql('b', 1, gappy)}{',' if prelude else ''} {prelude} select symbol, timeframe, ts, {outer} from r"


_add("i01_sma", lambda b: I.sma(I.sma(I.sma(b, 20), 50), 20, "volume", "volume_sma_20"), ["sma_20", "sma_50", "volume_sma_20"],
     f"r as (select *, {_full_sql('avg(close)', 'close', 20)} as sma_20, {_full_sql('avg(close)', 'close', 50)} as sma_50, {_full_sql('avg(volume)', 'volume', 20)} as volume_sma_20 from b)",
     "sma_20:d sma_50:d volume_sma_20:d")

_add("i02_ema", lambda b: I.ema(b, {"ema_20": ("close", 20), "ema_200": ("close", 200)}), ["ema_20", "ema_200"],
     ema_sql("b", "r", {"ema_20": ("close", 20), "ema_200": ("close", 200)}, ""), "ema_20:d ema_200:d")


def _rsi_sql(src: str, out: str, col: str, n: int, name: str) -> str:
    return f"""{out}_c as (select *, coalesce({col} - lag({col}) over ({P_SQL}), 0.0) as ch from {src}),
{out}_m as (select *, {_full_sql('avg(greatest(ch, 0.0))', 'ch', n)} as up, {_full_sql('avg(greatest(-ch, 0.0))', 'ch', n)} as dn from {out}_c),
{out} as (select * exclude (ch, up, dn), case when dn > 0 then 100 - 100 / (1 + up / dn) end as {name} from {out}_m)"""


_add("i03_rsi", lambda b: I.rsi(b), ["rsi"], _rsi_sql("b", "r", "close", 14, "rsi"), "rsi:d")

_BB = f"""bb as (select *, {_full_sql('avg(close)', 'close', 20)} as bb_mid, {_full_sql('stddev_samp(close)', 'close', 20)} as dev from b),
bc as (select *, bb_mid + 2.0 * dev as bb_upper, bb_mid - 2.0 * dev as bb_lower from bb),
bd as (select *, (bb_upper - bb_lower) / nullif(bb_mid, 0) as bb_width, (close - bb_lower) / nullif(bb_upper - bb_lower, 0) as bb_pct from bc),
r as (select *, case when bb_pct is null then null when bb_pct > 1 then 'ABOVE_UPPER' when bb_pct < 0 then 'BELOW_LOWER' when bb_pct >= 0.8 then 'NEAR_UPPER' when bb_pct <= 0.2 then 'NEAR_LOWER' else 'MIDDLE' end as bb_position from bd)"""
_add("i04_bollinger", lambda b: I.bollinger(b), ["bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_pct", "bb_position"], _BB, "bb_mid:d bb_upper:d bb_lower:d bb_width:d bb_pct:d bb_position:s")

_ATR = f"""tr as (select *, {TR_SQL} as tr from b), ta as (select *, {_full_sql('avg(tr)', 'tr', 14)} as atr from tr), tb as (select *, atr / nullif(close, 0) * 100 as atr_pct from ta),
r as (select *, case when atr_pct is null then null when atr_pct < 1 then 'LOW' when atr_pct < 2 then 'NORMAL' when atr_pct < 4 then 'HIGH' else 'VERY_HIGH' end as volatility from tb)"""
_add("i05_atr", lambda b: I.atr(b), ["tr", "atr", "atr_pct", "volatility"], _ATR, "tr:d atr:d atr_pct:d volatility:s")


def adx_sql(src: str, out: str) -> str:
    return f"""{out}_a as (select *, coalesce(high - lag(high) over ({P_SQL}), 0.0) as up, coalesce(lag(low) over ({P_SQL}) - low, 0.0) as dn, {TR_SQL} as tr_ from {src}),
{out}_b as (select *, case when up > dn and up > 0 then up else 0.0 end as pl, case when dn > up and dn > 0 then dn else 0.0 end as mi from {out}_a),
{out}_c as (select *, {_full_sql('avg(tr_)', 'tr_', 14)} as rg, {_full_sql('avg(pl)', 'pl', 14)} as p_, {_full_sql('avg(mi)', 'mi', 14)} as m_ from {out}_b),
{out}_d as (select *, 100 * p_ / nullif(rg, 0) as plus_di, 100 * m_ / nullif(rg, 0) as minus_di from {out}_c),
{out}_e as (select *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) as dx from {out}_d),
{out} as (select * exclude (up, dn, tr_, pl, mi, rg, p_, m_, dx), {_full_sql('avg(dx)', 'dx', 14)} as adx from {out}_e)"""


_add("i06_adx", lambda b: I.adx(b), ["plus_di", "minus_di", "adx"], adx_sql("b", "r"), "plus_di:d minus_di:d adx:d")

VWAP_SQL = """{out}_n as (select *, (ts at time zone 'UTC' at time zone 'America/New_York')::date as ny_date from {src}),
{out} as (select *, sum((high + low + close) / 3 * volume) over w / nullif(sum(volume) over w, 0) as vwap from {out}_n
  window w as (partition by symbol, timeframe, ny_date order by ts rows between unbounded preceding and current row))"""
_add("i07_session_vwap", lambda b: I.session_vwap(b), ["ny_date", "vwap"], VWAP_SQL.format(src="b", out="r"), "ny_date:s vwap:d")

_add("i08_cumulative_vwap", lambda b: I.cumulative_vwap(b), ["cum_vwap", "vwap_dev", "vwap_label"],
     f"""va as (select *, sum((high + low + close) / 3 * volume) over w / nullif(sum(volume) over w, 0) as cum_vwap from b window w as ({P_SQL} rows between unbounded preceding and current row)),
vb as (select *, (close - cum_vwap) / nullif(cum_vwap, 0) * 100 as vwap_dev from va),
r as (select *, case when vwap_dev is null then null when vwap_dev > 0.5 then 'ABOVE' when vwap_dev < -0.5 then 'BELOW' else 'NEAR' end as vwap_label from vb)""",
     "cum_vwap:d vwap_dev:d vwap_label:s")


def streak_sql(src: str, out: str) -> str:
    return f"""{out}_a as (select *, coalesce(sign(close - lag(close) over ({P_SQL})), 0)::double as sg from {src}),
{out}_b as (select *, case when sg <> coalesce(lag(sg) over ({P_SQL}), 9.0) then 1 else 0 end as st from {out}_a),
{out}_c as (select *, sum(st) over ({P_SQL} rows between unbounded preceding and current row) as run from {out}_b),
{out} as (select * exclude (sg, st, run), sg * row_number() over (partition by symbol, timeframe, run order by ts) as streak from {out}_c)"""


_add("i09_streak", lambda b: I.streak(b), ["streak"], streak_sql("b", "r"), "streak:d")


def rank_sql(src: str, out: str) -> str:
    return f"""{out}_a as (select *, (close - lag(close) over ({P_SQL})) / nullif(lag(close) over ({P_SQL}), 0) as ret from {src}),
{out}_b as (select *, list(ret) over w as rets, count(ret) over w as n from {out}_a window w as ({P_SQL} rows between 99 preceding and current row)),
{out} as (select * exclude (ret, rets, n), case when n = 100 then len(list_filter(rets, lambda x: x < ret)) / 100.0 * 100 end as pct_rank from {out}_b)"""


_add("i10_percent_rank", lambda b: I.percent_rank(b), ["pct_rank"], rank_sql("b", "r"), "pct_rank:d")
_add("i11_connors_rsi", lambda b: I.connors_rsi(b), ["streak", "crsi"],
     f"{streak_sql('b', 's1')}, {rank_sql('s1', 's2')}, {_rsi_sql('s2', 's3', 'close', 3, 'ra')}, {_rsi_sql('s3', 's4', 'streak', 2, 'rb')}, r as (select *, (ra + rb + pct_rank) / 3 as crsi from s4)", "streak:d crsi:d")

_MACD = f"""{ema_sql('b', 'm1', {'f': ('close', 12), 's': ('close', 26)}, '')}, m2 as (select * exclude (f, s), f - s as macd from m1), {ema_sql('m2', 'm3', {'macd_signal': ('macd', 9)}, '')},
m4 as (select *, macd - macd_signal as macd_hist from m3), m5 as (select *, lag(macd_hist) over ({P_SQL}) as bf from m4),
r as (select *, case when bf <= 0 and macd_hist > 0 then 'BULLISH' when bf >= 0 and macd_hist < 0 then 'BEARISH' else 'NONE' end as macd_cross,
  case when macd_hist > 0 then 'BULLISH' when macd_hist < 0 then 'BEARISH' else 'NEUTRAL' end as macd_label from m5)"""
_add("i12_macd", lambda b: I.macd(b), ["macd", "macd_signal", "macd_hist", "macd_cross", "macd_label"], _MACD, "macd:d macd_signal:d macd_hist:d macd_cross:s macd_label:s")

_add("i13_stochastic", lambda b: I.stochastic(b), ["stoch_k", "stoch_d", "williams_r"],
     f"""sa as (select *, {_full_sql('min(low)', 'low', 14)} as lo, {_full_sql('max(high)', 'high', 14)} as hi from b),
sb as (select *, 100 * (close - lo) / nullif(hi - lo, 0) as stoch_k, -100 * (hi - close) / nullif(hi - lo, 0) as williams_r from sa),
r as (select *, {_full_sql('avg(stoch_k)', 'stoch_k', 3)} as stoch_d from sb)""", "stoch_k:d stoch_d:d williams_r:d", digits=9)

ROC_SQL = """{out}_a as (select *, 100 * (close - lag(close, 10) over (partition by symbol, timeframe order by ts)) / nullif(lag(close, 10) over (partition by symbol, timeframe order by ts), 0) as roc from {src}),
{out} as (select *, case when roc is null then null when roc > 2 then 'STRONG_UP' when roc > 0 then 'UP' when roc >= -2 then 'DOWN' else 'STRONG_DOWN' end as momentum from {out}_a)"""
_add("i14_roc", lambda b: I.roc(b), ["roc", "momentum"], ROC_SQL.format(src="b", out="r"), "roc:d momentum:s")

_add("i15_obv", lambda b: I.obv(b), ["obv", "obv_ema"],
     f"oa as (select *, coalesce(sign(close - lag(close) over ({P_SQL})), 0) * volume as sv from b), ob as (select * exclude sv, sum(sv) over ({P_SQL} rows between unbounded preceding and current row) as obv from oa), {ema_sql('ob', 'r', {'obv_ema': ('obv', 20)}, '')}", "obv:d obv_ema:d")

_add("i16_volume_oscillator", lambda b: I.volume_oscillator(b), ["vol_ratio", "vol_osc", "vol_label"],
     f"""oa as (select *, volume / nullif({_full_sql('avg(volume)', 'volume', 20)}, 0) as vol_ratio from b), {ema_sql('oa', 'oe', {'f': ('volume', 5), 's': ('volume', 20)}, '')},
oc as (select *, 100 * (f - s) / nullif(s, 0) as vol_osc from oe), r as (select *, case when vol_osc is null then null when vol_osc > 20 then 'HIGH' when vol_osc < -20 then 'LOW' else 'NORMAL' end as vol_label from oc)""",
     "vol_ratio:d vol_osc:d vol_label:s")

_add("i17_distances", lambda b: I.distances(I.session_vwap(b), (20, 50)), ["dist_ema_20", "dist_ema_50", "dist_vwap"],
     f"""{VWAP_SQL.format(src='b', out='v')}, {ema_sql('v', 'd', {'e20': ('close', 20), 'e50': ('close', 50)}, '')},
r as (select *, 100 * (close - e20) / nullif(e20, 0) as dist_ema_20, 100 * (close - e50) / nullif(e50, 0) as dist_ema_50, 100 * (close - vwap) / nullif(vwap, 0) as dist_vwap from d)""",
     "dist_ema_20:d dist_ema_50:d dist_vwap:d")

_add("i18_time_features", lambda b: I.time_features(b), ["hour_of_day", "day_of_week"], "r as (select *, hour(ts)::integer as hour_of_day, (isodow(ts) - 1)::integer as day_of_week from b)", "hour_of_day:s day_of_week:s")

_add("i19_market_regime", lambda b: I.market_regime(I.roc(b)), ["regime", "regime_level"],
     f"""{ROC_SQL.format(src='b', out='rr')}, r as (select *, case when roc is null then null when abs(roc) > 3 then 'TRENDING' when abs(roc) < 1 then 'RANGING' else 'TRANSITIONING' end as regime,
  case when roc is null then null when abs(roc) > 5 then 'HIGH' when abs(roc) > 2 then 'NORMAL' else 'LOW' end as regime_level from rr)""", "regime:s regime_level:s")

_add("i20_all_indicators", lambda b: I.all_indicators(b), ["sma_20", "rsi", "bb_pct", "atr", "adx", "crsi", "vwap", "roc", "dist_ema_200"],
     f"""a1 as (select *, {_full_sql('avg(close)', 'close', 20)} as sma_20, {_full_sql('stddev_samp(close)', 'close', 20)} as dev from b),
a2 as (select * exclude dev, (close - (sma_20 - 2.0 * dev)) / nullif(4.0 * dev, 0) as bb_pct from a1), {_rsi_sql('a2', 'a3', 'close', 14, 'rsi')},
a4 as (select *, {TR_SQL} as tr from a3), a5 as (select *, {_full_sql('avg(tr)', 'tr', 14)} as atr from a4), {adx_sql('a5', 'a6')}, {streak_sql('a6', 's1')}, {rank_sql('s1', 's2')},
{_rsi_sql('s2', 's3', 'close', 3, 'ra')}, {_rsi_sql('s3', 's4', 'streak', 2, 'rb')}, a7 as (select *, (ra + rb + pct_rank) / 3 as crsi from s4),
{ROC_SQL.format(src='a7', out='a8')}, {VWAP_SQL.format(src='a8', out='a9')}, {ema_sql('a9', 'aa', {'e200': ('close', 200)}, '')},
r as (select *, 100 * (close - e200) / nullif(e200, 0) as dist_ema_200 from aa)""",
     "sma_20:d rsi:d bb_pct:d atr:d adx:d crsi:d vwap:d roc:d dist_ema_200:d")
