"""Queries A1 to A9 and M1 to M9, each with its SQL where SQL can express it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions.columns import KEY, rounded
from ..operators import analytics as A
from ..operators import ml as M
from ..sources import fixtures as X
from ..sources.files import saved
from ..sources.fixtures import bars, bars_sql
from .indicator_queries import ROC_SQL, _rsi_sql, ema_sql
from .trade_queries import OUT_SQL, PLAN_SQL, hourly, ind_sql, outcomes, r6

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = dt.datetime(2024, 1, 20)


def _query(name: str, make, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(make(spark, sf_dir))
    if sql:
        SQL[name] = sql


S = f"with {X.SIGNALS_SQL}"
_query("a01_signal_summary", lambda s, d: A.signal_summary(X.signals_sent(s, d)), f"{S} select signal_type, symbol, count(*) as n, {r6('avg(strength) as avg_strength', 'min(strength) as min_strength', 'max(strength) as max_strength')} from signals group by grouping sets ((signal_type), (symbol))")
_query("a02_best_conditions", lambda s, d: A.best_conditions(X.signals_sent(s, d)), f"{S} select context, signal_type, count(*) as n, {r6('avg(strength) as avg_strength')} from signals where strength >= 80 group by all having count(*) >= 2 order by n desc, context, signal_type limit 10")
_query("a03_indicator_breakdown", lambda s, d: A.indicator_breakdown(X.signals_sent(s, d)), f"{S}, u as (unpivot (select {', '.join(A.SCORES)} from signals) on {', '.join(A.SCORES)} into name indicator value v) select indicator, {r6('avg(v) as avg_score')}, count(*) filter (v >= 15) as high, {r6('100.0 * count(*) filter (v >= 15) / count(v) as high_rate')} from u group by 1")
IND = f"with {ind_sql()}, {ROC_SQL.format(src='ind', out='rr')}, z as (select *, atr / nullif(close, 0) * 100 as atr_pct, case when roc is null then null when abs(roc) > 3 then 'TRENDING' when abs(roc) < 1 then 'RANGING' else 'TRANSITIONING' end as regime from rr)"
_query("a04_regime_summary", lambda s, d: A.regime_summary(I.market_regime(I.roc(hourly(s, d)))), f"{IND} select regime, count(*) as n, {r6('avg(roc) as avg_roc', 'avg(atr_pct) as avg_atr_pct')} from z group by 1")
_query("a04b_volatility_readings", lambda s, d: A.volatility_readings(hourly(s, d)), f"{IND} select symbol, case when atr_pct is null then null when atr_pct < 1 then 'LOW' when atr_pct < 2 then 'NORMAL' when atr_pct < 4 then 'HIGH' else 'VERY_HIGH' end as volatility, count(*) as n, {r6('avg(atr_pct) as avg_atr_pct')} from z group by all")
_query("a05_symbol_profile", lambda s, d: A.symbol_profile(bars(s, d)), f"with {bars_sql('b')}, d0 as (select symbol, ts::date as day, avg(close) as c from b group by all), dd as (select * from d0 qualify row_number() over (partition by symbol order by day desc) <= 10), l as (select symbol, avg(c) as ld, count(*) as days from dd group by 1) select b.symbol, {r6('avg(close) as avg_close', 'avg(volume) as avg_volume', '100 * (max(high) - min(low)) / nullif(min(low), 0) as range_pct', 'any_value(ld) as last_days_close')}, any_value(days) as days from b join l using (symbol) group by b.symbol")
_query("a06_timing", lambda s, d: A.timing(X.signals_sent(s, d)), f"{S}, t as (select strength, hour(ts)::integer as hour, dayofweek(ts)::integer as weekday from signals) select hour, weekday, count(*) as n, {r6('avg(strength) as avg_strength')} from t group by grouping sets ((hour), (weekday)) having count(*) >= 2")
_query("a07_recent_activity", lambda s, d: A.recent_activity(X.signals_sent(s, d), NOW), f"{S} select symbol, count(*) as n, max(ts) as last_ts from signals where ts > timestamp '{NOW}' - interval 24 hour and ts <= '{NOW}' group by 1")
_query("a07b_last_signals", lambda s, d: A.last_signals(X.signals_sent(s, d), NOW).select("signal_id", "symbol", "ts", "strength"), f"{S} select signal_id, symbol, ts, {r6('strength')} from signals where ts <= '{NOW}' order by ts desc, signal_id desc limit 5")
_query("a08_store_health", lambda s, d: A.store_health(bars(s, d), NOW), f"with {bars_sql('b')} select count(*) as n, count(distinct symbol) as symbols, min(ts) as first_ts, max(ts) as last_ts, count(*) filter (ts > timestamp '{NOW}' - interval 24 hour and ts <= '{NOW}') as last_day from b")
_query("a09_collector_performance", lambda s, d: A.collector_performance(X.collector_stats(s, d)), f"with {X.COLLECTOR_SQL} select session, symbol, count(*) as runs, {r6('100.0 * count(*) filter (success) / count(*) as success_rate', 'sum(points) as points', 'avg(ms) as avg_ms')} from collector group by rollup (session, symbol)")


# Machine learning.
def featured(s, d) -> DataFrame:
    return M.features(I.ema(I.rsi(hourly(s, d)), {"ema_200": ("close", 200)}))


FEAT = f"""with recursive {ind_sql()}, {_rsi_sql('ind', 'ir', 'close', 14, 'rsi')}, {ema_sql('ir', 'ie', {'ema_200': ('close', 200)}, '')},
ft as (select *, 100 * atr / nullif(close, 0) as natr, coalesce(100 * (close - vwap) / nullif(vwap, 0), 0.0) as dist_vwap, coalesce(volume / nullif(volume_sma_20, 0), 0.0) as vol_ratio, 100 * (close - ema_200) / nullif(ema_200, 0) as dist_ema200,
  100 * ((least(open, close) - low) - (high - greatest(open, close))) / nullif(close, 0) as wick_pct, hour(ts at time zone 'UTC' at time zone 'America/New_York')::double as hour from ie)"""
_query("m01_features", lambda s, d: featured(s, d).select(*KEY, *M.FEATURES), f"{FEAT} select symbol, timeframe, ts, {r6(*M.FEATURES)} from ft")
_query("m02_lag_features", lambda s, d: M.lag_features(featured(s, d), ["rsi", "natr"], 5).select(*KEY, "rsi_L1", "rsi_L5", "natr_L1", "natr_L5"), f"{FEAT}, l as (select symbol, timeframe, ts, lag(rsi) over w as rsi_L1, lag(rsi, 5) over w as rsi_L5, lag(natr) over w as natr_L1, lag(natr, 5) over w as natr_L5 from ft window w as (partition by symbol, timeframe order by ts)) select symbol, timeframe, ts, {r6('rsi_L1', 'rsi_L5', 'natr_L1', 'natr_L5')} from l")


def tagged(s, d) -> DataFrame:
    """Entries and exits of the bracket outcomes as tagged fills."""
    o = outcomes(s, d)
    ins = o.select(*KEY, "side", F.col("entry").alias("price"), F.lit("ENTRY").alias("tag"))
    outs = o.select("symbol", "timeframe", F.col("exit_ts").alias("ts"), "side", F.col("exit_price").alias("price"), F.lit("EXIT").alias("tag"))
    return ins.unionByName(outs.groupBy("symbol", "timeframe", "ts").agg(F.max_by("side", F.struct("price", "side")).alias("side"), F.max("price").alias("price"), F.first("tag").alias("tag")))


def samples(s, d) -> DataFrame:
    return M.labelled_samples(tagged(s, d), featured(s, d), M.FEATURES)


SAMPLES = f"""{FEAT}, {PLAN_SQL}, {OUT_SQL}, tg as (select symbol, timeframe, ts, side, entry as price, 'ENTRY' as tag from outcomes union all select symbol, timeframe, exit_ts, arg_max(side, (exit_price, side)), max(exit_price), 'EXIT' from outcomes group by symbol, timeframe, exit_ts),
nx as (select *, last_value(case when tag <> 'ENTRY' then {{'ts': ts, 'price': price}} end ignore nulls) over (partition by symbol, timeframe order by ts desc, tag desc rows between unbounded preceding and current row) as x from tg),
fl as (select symbol, timeframe, ts, {', '.join(f'lag({c}) over (partition by symbol, timeframe order by ts) as {c}' for c in M.FEATURES)} from ft),
sm as (select n.symbol, n.timeframe, n.ts, side, price as entry_price, x.ts as exit_ts, x.price as exit_price, case when side = 'LONG' then 1.0 else -1.0 end * (x.price - price) as pnl, {', '.join(M.FEATURES)}
  from nx n join fl using (symbol, timeframe, ts) where tag = 'ENTRY' and x is not null and {' and '.join(f'{c} is not null' for c in M.FEATURES)}), sml as (select *, (pnl > 0)::int::double as label from sm)"""
_query("m03_labelled_samples", lambda s, d: samples(s, d).select(*KEY, "side", "exit_ts", "pnl", "label", "rsi", "natr"), f"{SAMPLES} select symbol, timeframe, ts, side, exit_ts, {r6('pnl')}, label, {r6('rsi', 'natr')} from sml")
_query("m04_label_balance", lambda s, d: M.label_balance(samples(s, d)), f"{SAMPLES} select year(ts)::integer as year, symbol, count(*) as n, {r6('avg(label) as positive')} from sml group by rollup (year(ts)::integer, symbol)")
SCORES_SQL = "with sc as (select doc_id, lang as symbol, quality::double as label, (n_chars % 1000) / 1000.0::double as prob from labels join documents using (doc_id))"


def scores(s, d) -> DataFrame:
    j = X.table(s, d, "labels").join(X.table(s, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return j.select("doc_id", F.col("lang").alias("symbol"), F.col("quality").cast("double").alias("label"), ((F.col("n_chars") % 1000) / 1000.0).alias("prob"))


_query("m05_split", lambda s, d: M.split(scores(s, d), ["doc_id"]).select("doc_id", "label", "is_test"), f"{SCORES_SQL}, r as (select *, row_number() over (partition by label order by md5('42|' || doc_id::varchar), doc_id) as n, count(*) over (partition by label) as c from sc) select doc_id, label, n <= floor(c * 0.2) as is_test from r")


def trained(s, d) -> DataFrame:
    """Out-of-sample probabilities of a random forest on the labelled samples."""
    parts = saved(M.split(samples(s, d), KEY), "samples")
    model = M.train(parts.filter("not is_test"), M.FEATURES, min_samples=20)
    test = parts.filter("is_test")
    scored = M.score(model, test, M.FEATURES) if model else test.withColumn("prob", F.lit(1.0))
    return scored.select(*KEY, "label", "prob")


_query("m06_train", trained)


def by_symbol(s, d) -> DataFrame:
    """Each symbol's samples on both sides of the split, whether it has a model of its own, and whether all its probabilities are such."""
    parts = saved(M.split(samples(s, d), KEY), "samples", "symbol")
    models = M.forests_by_symbol(parts.filter("not is_test"), M.FEATURES, KEY)
    scored = M.score_forests(models, parts, M.FEATURES).join(models.select("symbol", F.lit(True).alias("_has")), "symbol", "left")
    has = F.coalesce("_has", F.lit(False))
    return scored.groupBy("symbol").agg(
        F.count_if(~F.col("is_test")).alias("n_train"), F.count_if(F.col("is_test")).alias("n_test"), F.max(has).alias("trained"),
        F.min(F.when(has, F.col("prob").between(0, 1)).otherwise(F.col("prob") == 1)).alias("in_bounds"))


_query("m06b_train_by_symbol", by_symbol, f"""{SAMPLES}, r as (select symbol, label, row_number() over (partition by label order by md5('42|' || symbol || '|' || timeframe || '|' || ts::varchar), symbol, timeframe, ts) <= floor(count(*) over (partition by label) * 0.2) as is_test from sml)
select symbol, count(*) filter (not is_test) as n_train, count(*) filter (is_test) as n_test, count(*) filter (not is_test) >= 50 and count(distinct label) filter (not is_test) > 1 as trained, true as in_bounds from r group by symbol""")


def compared(s, d) -> DataFrame:
    """Random forest and boosted trees by their out-of-sample probabilities, ranked by F1."""
    parts = saved(M.split(samples(s, d), KEY), "samples")
    test = parts.filter("is_test")
    made = None
    for kind in ("rf", "gbt"):
        model = M.train(parts.filter("not is_test"), M.FEATURES, kind, 20)
        scored = (M.score(model, test, M.FEATURES) if model else test.withColumn("prob", F.lit(1.0))).select(F.lit(kind).alias("model"), "label", "prob")
        made = scored if made is None else made.unionByName(scored)
    return M.rank_models(made)


_query("m07b_compare_models", compared)
EVAL = """c as (select count(*) filter (label = 1 and prob >= 0.5) as tp, count(*) filter (label <> 1 and prob >= 0.5) as fp, count(*) filter (label = 1 and prob < 0.5) as fn, count(*) filter (label <> 1 and prob < 0.5) as tn from sc),
a as (select sum(case when p.prob > q.prob then 1.0 when p.prob = q.prob then 0.5 else 0 end) / count(*) as auc from (select prob from sc where label = 1) p cross join (select prob from sc where label <> 1) q),
e as (select (tp + tn) / (tp + tn + fp + fn) as accuracy, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall, auc from c, a)"""
_query("m07_evaluate", lambda s, d: M.evaluate(scores(s, d)), f"{SCORES_SQL}, {EVAL} select {r6('accuracy', 'precision', 'recall', 'coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1', 'auc')} from e")
MODEL_SQL = SCORES_SQL.replace("with sc as", "with one as") + ", sc as (select doc_id, symbol as model, label, prob from one)"
_query("m07c_rank_models", lambda s, d: M.rank_models(scores(s, d).withColumnRenamed("symbol", "model")), f"""{MODEL_SQL}, c as (select model, count(*) filter (label = 1 and prob >= 0.5) as tp, count(*) filter (label <> 1 and prob >= 0.5) as fp, count(*) filter (label = 1 and prob < 0.5) as fn, count(*) filter (label <> 1 and prob < 0.5) as tn from sc group by 1),
a as (select model, sum(case when p.prob > q.prob then 1.0 when p.prob = q.prob then 0.5 else 0 end) / count(*) as auc from (select model, prob from sc where label = 1) p join (select model, prob from sc where label <> 1) q using (model) group by 1),
e as (select model, (tp + tn) / (tp + tn + fp + fn) as accuracy, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall, auc from c left join a using (model)), f as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from e)
select model, {r6('accuracy', 'precision', 'recall', 'f1', 'auc')}, row_number() over (order by f1 desc, model)::integer as place from f""")
_query("m08_probability_profile", lambda s, d: M.probability_profile(scores(s, d), [0.3, 0.5, 0.7]), f"""{SCORES_SQL}, o as (select min(prob) as mn, max(prob) as mx, avg(prob) as av, {', '.join(f'quantile_cont(prob, {q}) as {n}_' for n, q in M.PERCENTILES.items())} from sc), t(threshold) as (values (0.3::double), (0.5), (0.7))
select {r6('any_value(mn) as min_prob', 'any_value(mx) as max_prob', 'any_value(av) as mean_prob', *(f'any_value({n}_) as {n}' for n in M.PERCENTILES))}, threshold, {r6('100.0 * count(*) filter (prob >= threshold) / count(*) as pass_rate')} from sc, o, t group by threshold""")
_query("m08b_histogram", lambda s, d: M.histogram(scores(s, d)), f"{SCORES_SQL} select least(floor(prob * 10)::integer + 1, 10) as bin, count(*) as n, {r6('avg(label) as positive')} from sc group by 1")
_query("m09_filter_by_probability", lambda s, d: M.filter_by_probability(X.table(s, d, "documents").select("doc_id", "lang"), scores(s, d), ["doc_id"], 0.6), f"{SCORES_SQL} select d.doc_id, d.lang, {r6('coalesce(prob, 1.0) as prob')} from documents d left join sc using (doc_id) where coalesce(prob, 1.0) >= 0.6")
