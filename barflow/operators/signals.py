"""Candle patterns, entry rules, score cards, sizes and plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEY, ratio, series
from .clean import last_n


def candle_anatomy(df: DataFrame) -> DataFrame:
    """Body and wicks, and wick rejections as +100 and -100."""
    made = df.withColumns({"body": F.abs(F.col("close") - F.col("open")), "upper_wick": F.col("high") - F.greatest("open", "close"), "lower_wick": F.least("open", "close") - F.col("low")})
    return made.withColumns({"pat_wick_bull": F.when(F.col("lower_wick") > 2 * F.col("body"), 100).otherwise(0), "pat_wick_bear": F.when(F.col("upper_wick") > 2 * F.col("body"), -100).otherwise(0)})


def single_bar_patterns(df: DataFrame) -> DataFrame:
    made = candle_anatomy(df)
    b, u, w = F.col("body"), F.col("upper_wick"), F.col("lower_wick")
    return made.withColumns({
        "pat_hammer": F.when((w > 2 * b) & (u < b * 0.5), 100).otherwise(0),
        "pat_shooting_star": F.when((u > 2 * b) & (w < b * 0.5), -100).otherwise(0),
        "pat_doji": F.when(b <= (F.col("high") - F.col("low")) * 0.1, 100).otherwise(0)})


def engulfing(df: DataFrame) -> DataFrame:
    o, c, po, pc = F.col("open"), F.col("close"), F.lag("open").over(series()), F.lag("close").over(series())
    bull, bear = (c > o) & (pc < po) & (o < pc) & (c > po), (c < o) & (pc > po) & (o > pc) & (c < po)
    return df.withColumn("pat_engulfing", F.when(bull, 100).when(bear, -100).otherwise(0))


def reversal_flags(df: DataFrame) -> DataFrame:
    """Any bullish or bearish reversal; wick direction, where the bull wins a tie."""
    made = engulfing(single_bar_patterns(df))
    doji = F.col("pat_doji") != 0
    return made.withColumns({
        "bullish_reversal": (F.col("pat_hammer") > 0) | (F.col("pat_engulfing") > 0) | doji,
        "bearish_reversal": (F.col("pat_shooting_star") != 0) | (F.col("pat_engulfing") < 0) | doji,
        "wick_direction": F.when(F.col("pat_wick_bull") > 0, 1).when(F.col("pat_wick_bear") < 0, -1).otherwise(0)})


def _param(params: dict, name: str, default) -> Column:
    """A parameter: a value, or the name of a column that holds it."""
    v = params.get(name, default)
    return F.col(v) if isinstance(v, str) else F.lit(v)


def bounce_side(df: DataFrame, params: dict) -> Column:
    """LONG, SHORT or null for each bar: volume above its mean, the wick through the VWAP, optional RSI and trend filters."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    body, lower, upper = F.abs(c - o), F.least(o, c) - lo, h - F.greatest(o, c)
    ratio_, mult = _param(params, "wick_ratio", 2.0), _param(params, "vol_mult", 1.0)
    long, short = (lo <= F.col("vwap")) & (c > F.col("vwap")) & (lower > ratio_ * body), (h >= F.col("vwap")) & (c < F.col("vwap")) & (upper > ratio_ * body)
    if params.get("use_rsi_filter"):
        r = F.coalesce(F.col("rsi"), F.lit(50.0))
        long, short = long & (r < _param(params, "rsi_threshold_long", 70)), short & (r > _param(params, "rsi_threshold_short", 30))
    if params.get("use_trend_filter"):
        dist = F.col("dist_ema_200") if "dist_ema_200" in df.columns else F.lit(None).cast("double")
        long, short = long & F.coalesce(dist > 0, F.lit(True)), short & F.coalesce(dist < 0, F.lit(True))
    usable = (F.coalesce(F.col("vwap"), F.lit(0.0)) != 0) & (F.coalesce(F.col("volume_sma_20"), F.lit(0.0)) != 0) & (F.col("volume") > F.col("volume_sma_20") * mult)
    return F.when(usable & long, "LONG").when(usable & short, "SHORT")


def vwap_bounce(df: DataFrame, params: dict) -> DataFrame:
    """Bars with an entry, and its side."""
    return df.withColumn("side", bounce_side(df, params)).filter("side is not null")


def ema_pullback(df: DataFrame, params: dict) -> DataFrame:
    """Entries with the daily bias (day_close, day_ema, day_adx, day_plus, day_minus joined as of): pullback to the fast mean and close beyond it."""
    strong = F.col("day_adx") > _param(params, "adx_min", 20.0)
    up = strong & (F.col("day_close") > F.col("day_ema")) & (F.col("day_plus") > F.col("day_minus"))
    down = strong & (F.col("day_close") < F.col("day_ema")) & (F.col("day_minus") > F.col("day_plus"))
    touch = (F.col("low") <= F.col("ema_20")) & (F.col("close") > F.col("ema_20"))
    reject = (F.col("high") >= F.col("ema_20")) & (F.col("close") < F.col("ema_20"))
    return df.withColumn("side", F.when(up & touch, "LONG").when(down & reject, "SHORT")).filter("side is not null")


def condition_funnel(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """For each condition in order: bars that pass it, and bars that pass it and all before."""
    alone, together, so_far = [], [], F.lit(True)
    for c in conditions.values():
        so_far = so_far & F.coalesce(c, F.lit(False))
        alone.append(F.count_if(c))
        together.append(F.count_if(so_far))
    one = df.agg(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("condition"), a.alias("passed"), t.alias("passed_all")) for i, (n, a, t) in enumerate(zip(conditions, alone, together, strict=True))]).alias("x"), F.count("*").alias("bars"))
    return one.select(F.explode("x").alias("x"), "bars").select("x.*", "bars")


#: Score ladders, fixed values: indicator, then (points, label, bound); the first bound that the value meets counts.
LONG_LADDERS = {
    "rsi": ("<", [(20, "OVERSOLD_EXTREME", 30), (18, "OVERSOLD", 40), (10, "WEAK", 50), (5, "NEUTRAL", 60)], "OVERBOUGHT"),
    "vwap": ("<=", [(15, "NEAR_VWAP", 0.5), (10, "CLOSE_TO_VWAP", 1.0), (5, "AWAY_FROM_VWAP", 2.0)], "FAR_FROM_VWAP"),
    "roc": (">", [(20, "VERY_STRONG_BULLISH", 3.0), (18, "STRONG_BULLISH", 1.5), (10, "MODERATE_BULLISH", 0.5), (5, "NEUTRAL", -0.5)], "BEARISH"),
    "bollinger": ("<=", [(15, "LOWER_BAND", 0.2), (10, "LOWER_ZONE", 0.4), (5, "MIDDLE_ZONE", 0.6)], "UPPER_ZONE"),
    "volume": (">", [(10, "VERY_HIGH", 75), (8, "HIGH", 50), (5, "ELEVATED", 25), (3, "NORMAL", 0)], "LOW"),
}
SHORT_LADDERS = LONG_LADDERS | {
    "rsi": (">", [(20, "OVERBOUGHT_EXTREME", 70), (18, "OVERBOUGHT", 60), (10, "STRONG", 50), (5, "NEUTRAL", 40)], "OVERSOLD"),
    "roc": ("<", [(20, "VERY_STRONG_BEARISH", -3.0), (18, "STRONG_BEARISH", -1.5), (10, "MODERATE_BEARISH", -0.5), (5, "NEUTRAL", 0.5)], "BULLISH"),
    "bollinger": (">=", [(15, "UPPER_BAND", 0.8), (10, "UPPER_ZONE", 0.6), (5, "MIDDLE_ZONE", 0.4)], "LOWER_ZONE"),
}


def _ladder(value: Column, kind: str, steps: list, rest: str) -> tuple[Column, Column]:
    ops = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    points, label = F.lit(0), F.lit(rest)
    for p, name, bound in reversed(steps):
        hit = ops[kind](value, F.lit(float(bound)))
        points, label = F.when(hit, p).otherwise(points), F.when(hit, name).otherwise(label)
    return points, label


def score_card(df: DataFrame) -> DataFrame:
    """Points of each indicator and totals for LONG and SHORT, from macd_hist, macd_cross, rsi, vwap_dev, roc, bb_pct and vol_osc."""
    fill = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    values = {"rsi": fill("rsi", 50.0), "vwap": F.abs(fill("vwap_dev", 0.0)), "roc": fill("roc", 0.0), "bollinger": fill("bb_pct", 0.5), "volume": fill("vol_osc", 0.0)}
    h = fill("macd_hist", 0.0)
    out: dict[str, Column] = {}
    for side, ladders, sign, cross in (("long", LONG_LADDERS, 1, "BULLISH"), ("short", SHORT_LADDERS, -1, "BEARISH")):
        out[f"{side}_macd"] = F.when(F.col("macd_cross") == cross, 20).when(sign * h > 0, 15).when(sign * h > -0.01, 10).otherwise(0)
        for k, (kind, steps, rest) in ladders.items():
            out[f"{side}_{k}"], out[f"{side}_{k}_label"] = _ladder(values[k], kind, steps, rest)
    made = df.withColumns(out)
    total = lambda s: sum((F.col(f"{s}_{k}") for k in LONG_LADDERS), F.col(f"{s}_macd"))
    return made.withColumns({"long_score": total("long"), "short_score": total("short")})


def signal_quality(df: DataFrame, score: str = "score", full: int = 75, partial: int = 65, least: int = 55) -> DataFrame:
    s = F.col(score)
    return df.withColumns({
        "entry_quality": F.when(s >= full, "FULL_ENTRY").when(s >= least, "PARTIAL_ENTRY").otherwise("NO_TRADE"),
        "confidence": F.when(s >= full, "VERY_HIGH").when(s >= partial, "HIGH").when(s >= least, "MEDIUM").otherwise("LOW")})


def market_context(df: DataFrame) -> DataFrame:
    """Up to three tags of trend, volatility, volume and place in the range."""
    fill = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    r, a, v, b = fill("roc", 0.0), fill("atr_pct", 1.5), fill("vol_osc", 0.0), fill("bb_pct", 0.5)
    tags = F.array(
        F.when(r > 2, "STRONG_UPTREND").when(r > 0.5, "UPTREND").when(r < -2, "STRONG_DOWNTREND").when(r < -0.5, "DOWNTREND").otherwise("SIDEWAYS"),
        F.when(a > 3, "HIGH_VOLATILITY").when(a < 1, "LOW_VOLATILITY"), F.when(v > 50, "HIGH_VOLUME").when(v < 0, "LOW_VOLUME"), F.when(b > 0.8, "RANGE_TOP").when(b < 0.2, "RANGE_BOTTOM"))
    return df.withColumn("market_context", F.array_join(F.slice(F.array_compact(tags), 1, 3), " | "))


def new_signals(signals: DataFrame, stored: DataFrame, open_alerts: DataFrame) -> DataFrame:
    """Signals not stored yet, of symbols without an open alert."""
    return signals.join(stored.select("symbol", "ts").distinct(), ["symbol", "ts"], "left_anti").join(open_alerts.select("symbol").distinct(), "symbol", "left_anti")


def position_size(signals: DataFrame, capital: float, risk: float) -> DataFrame:
    """Whole units so that two ATR lose ``risk`` of the capital, within the capital; less than one is no trade."""
    by_risk = F.floor(ratio(F.lit(capital * risk), 2 * F.col("atr")))
    return signals.withColumn("qty", F.least(by_risk, F.floor(ratio(F.lit(capital), F.col("close"))))).filter("qty >= 1")


def volatility_multiplier(df: DataFrame) -> DataFrame:
    """Size factor from ATR over its average (atr_avg)."""
    x = ratio(F.col("atr"), F.col("atr_avg"))
    return df.withColumn("size_factor", F.when(x > 2, 0.5).when(x > 1.5, 0.75).otherwise(1.0))


def trade_plan(signals: DataFrame, capital: float = 10_000.0, risk: float = 0.02, sl_mult=2.0, tp_mult=4.0) -> DataFrame:
    """Stop, target, size, risk amount and order rows of each signal."""
    sized = signals.withColumns({"stop": F.coalesce(sl_mult * F.col("atr"), F.col("close") * 0.004), "reach": F.coalesce(tp_mult * F.col("atr"), F.col("close") * 0.01), "way": F.when(F.col("side") == "LONG", 1.0).otherwise(-1.0)})
    made = sized.withColumns({"entry": F.col("close"), "sl": F.col("close") - F.col("way") * F.col("stop"), "tp": F.col("close") + F.col("way") * F.col("reach"), "qty": F.least(F.floor(ratio(F.lit(capital * risk), F.col("stop"))), F.floor(ratio(F.lit(capital), F.col("close"))))})
    made = made.filter("qty >= 1").withColumn("risk_amount", F.col("qty") * F.col("stop")).drop("stop", "reach", "way")
    order = lambda kind, price: F.struct(F.lit(kind).alias("kind"), F.col(price).alias("price"), F.col("qty").alias("qty"))
    return made.withColumn("orders", F.array(order("ENTRY", "entry"), order("SL", "sl"), order("TP", "tp")))


def pivots(bars: DataFrame, lookback: int = 50) -> DataFrame:
    """Strict highs and lows over two bars on each side, among the last ``lookback`` pivots, with bars that touch them within 0.2 %."""
    w = series()
    near = [(-2), (-1), 1, 2]
    at = lambda c, k: (F.lag(c, -k) if k < 0 else F.lead(c, k)).over(w)
    high = bars.withColumn("_ok", sum((F.when(F.col("high") > at("high", k), 1).otherwise(0) for k in near), F.lit(0)) == 4).filter("_ok").select(*KEY, F.lit("HIGH").alias("kind"), F.col("high").alias("level"))
    low = bars.withColumn("_ok", sum((F.when(F.col("low") < at("low", k), 1).otherwise(0) for k in near), F.lit(0)) == 4).filter("_ok").select(*KEY, F.lit("LOW").alias("kind"), F.col("low").alias("level"))
    last = last_n(high.unionByName(low), ["symbol", "timeframe", "kind"], "ts", lookback)
    price = F.when(F.col("kind") == "HIGH", F.col("b_high")).otherwise(F.col("b_low"))
    b = bars.select("symbol", "timeframe", F.col("high").alias("b_high"), F.col("low").alias("b_low"))
    # At most 2 x lookback pivots a series, so the join grows with the bars.
    touch = last.join(b, ["symbol", "timeframe"]).filter(F.abs(price - F.col("level")) <= 0.002 * F.col("level"))
    return touch.groupBy(*KEY, "kind", "level").agg(F.count("*").alias("touches"))


#: Layered plans, fixed values: least strength, strategy, stop factor, and for each entry its distance (in adjusted ATR) and share.
STRATEGIES = (
    (85, "SCALP", 0.75, ((0.0, 70), (0.25, 30))),
    (75, "SWING_SHORT", 1.0, ((0.0, 45), (0.4, 35), (0.8, 20))),
    (65, "SWING_MEDIUM", 1.25, ((0.0, 45), (0.4, 35), (0.8, 20))),
    (0, "POSITION", 1.4, ((0.0, 35), (0.3, 30), (0.6, 20), (1.0, 15))),
)
#: ATR factor and stop factor of a volatility; any other counts as NORMAL.
VOLATILITIES = {"LOW": (1.8, 0.95), "NORMAL": (2.0, 1.0), "HIGH": (2.5, 1.1), "VERY_HIGH": (2.5, 1.1)}


def _way() -> Column:
    return F.when(F.col("side") == "LONG", 1.0).otherwise(-1.0)


def layered_plan(signals: DataFrame) -> DataFrame:
    """Strategy by strength, entry levels with shares, and the stop; from side, close, atr, volatility, rsi and strength."""
    s, rsi = F.col("strength"), F.coalesce("rsi", F.lit(50.0))
    of = lambda x: F.struct(
        F.lit(x[1]).alias("name"), F.lit(x[2]).alias("factor"), F.array(*[F.struct(F.lit(d).alias("distance"), F.lit(float(p)).alias("share_pct")) for d, p in x[3]]).alias("entries"))
    strategy = reduce(lambda rest, x: F.when(s >= x[0], of(x)).otherwise(rest), reversed(STRATEGIES[:-1]), of(STRATEGIES[-1]))
    pair = lambda x: F.struct(F.lit(x[0]).alias("reach"), F.lit(x[1]).alias("stop"))
    volatility = reduce(lambda rest, x: F.when(F.col("volatility") == x[0], pair(x[1])).otherwise(rest), VOLATILITIES.items(), pair(VOLATILITIES["NORMAL"]))
    stretched = ((F.col("side") == "LONG") & (rsi < 25)) | ((F.col("side") == "SHORT") & (rsi > 75))
    made = signals.withColumns({"_s": strategy, "_v": volatility, "_room": F.when(stretched, 1.15).otherwise(1.0)})
    made = made.withColumns({"strategy": F.col("_s.name"), "_entries": F.col("_s.entries"), "_reach": F.col("atr") * F.col("_v.reach")})
    made = made.withColumn("stop_price", F.col("close") - _way() * F.col("_reach") * F.col("_s.factor") * F.col("_room") * F.col("_v.stop")).drop("_s", "_v", "_room")
    made = made.withColumn("n_levels", F.size("_entries")).select("*", F.posexplode("_entries").alias("_at", "_entry"))
    return made.withColumns({
        "level": F.col("_at") + 1, "level_price": F.col("close") - _way() * F.col("_reach") * F.col("_entry.distance"), "share_pct": F.col("_entry.share_pct"),
    }).drop("_entries", "_reach", "_at", "_entry")


#: Candidate targets, fixed values: extensions of the swing, ATR multiples; by price above, the two steps of round numbers.
EXTENSIONS, MULTIPLES, ROUND_STEPS = (1.236, 1.382, 1.618, 2.618), (2, 3, 4, 6), ((100, (5.0, 10.0)), (50, (2.5, 5.0)), (None, (1.0, 2.5)))
#: Weight of each kind and strength of its levels; ATR levels get weaker with the multiple.
KIND_SCORES = {"FIBONACCI": (90, 80), "VWAP": (85, 85), "BOLLINGER": (75, 75), "PSYCHOLOGICAL": (65, 60), "ATR_EXTENSION": (60, None)}


def candidate_targets(signals: DataFrame, bars: DataFrame, lookback: int = 50, most: float = 0.15) -> DataFrame:
    """Possible targets of each signal (side, close, atr, cum_vwap, bb_upper, bb_lower), on its side of the price.

    Extensions of the swing of the last ``lookback`` bars, the band, round numbers up to ``most``
    away, VWAP and ATR multiples (2 % of the price without ATR); ``seq`` numbers them in this order.
    """
    w = series(lookback)
    swing = bars.select(*KEY, F.max("high").over(w).alias("_top"), F.min("low").over(w).alias("_bottom"))
    s = signals.join(swing, KEY).withColumn("_way", _way())
    long, close = F.col("side") == "LONG", F.col("close")
    size, start = F.col("_top") - F.col("_bottom"), F.when(long, F.col("_bottom")).otherwise(F.col("_top"))
    one = lambda seq, kind, price, strength: F.struct((F.lit(seq) if isinstance(seq, int) else seq).cast("int").alias("seq"), F.lit(kind).alias("kind"), price.alias("target"), F.lit(strength).cast("int").alias("level_strength"))
    fixed = [one(i, "FIBONACCI", start + F.col("_way") * size * r, 80) for i, r in enumerate(EXTENSIONS)]
    fixed.append(one(10, "BOLLINGER", F.when(long, F.col("bb_upper")).otherwise(F.col("bb_lower")), 75))
    fixed.append(one(5000, "VWAP", F.col("cum_vwap"), 85))
    atr = F.coalesce("atr", close * 0.02)
    fixed += [one(6000 + m, "ATR_EXTENSION", close + F.col("_way") * atr * m, max(90 - 10 * m, 50)) for m in MULTIPLES]

    def rounds(i: int) -> Column:
        step = reduce(lambda rest, x: F.when(close > x[0], x[1][i]).otherwise(rest), reversed(ROUND_STEPS[:-1]), F.lit(ROUND_STEPS[-1][1][i]))
        base = F.floor(close / step)
        n = F.when(long, F.floor((close + close * most) / step) - base).otherwise(base - F.ceil((close - close * most) / step) + 1).cast("int")
        places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda k: one(F.lit(1000 * (i + 1)) + k, "PSYCHOLOGICAL", F.when(long, base + k).otherwise(base - k + 1) * step, 60))

    made = s.withColumn("_t", F.explode(F.concat(F.array(*fixed), rounds(0), rounds(1)))).select(*[c for c in signals.columns if c not in ("seq", "kind", "target", "level_strength")], "_way", "_t.*")
    return made.filter(F.col("_way") * (F.col("target") - F.col("close")) > 0).drop("_way")


def momentum_factor() -> Column:
    """Mean of the ROC and RSI factors of a signal's side."""
    long, roc, rsi = F.col("side") == "LONG", _way() * F.coalesce("roc", F.lit(0.0)), F.coalesce("rsi", F.lit(50.0))
    by_roc = F.when(roc > 3, 1.3).when(roc > 1.5, 1.1).when(roc > 0, 1.0).otherwise(0.8)
    by_rsi = F.when(F.when(long, rsi < 30).otherwise(rsi > 70), 1.2).when(F.when(long, rsi < 50).otherwise(rsi > 50), 1.1).otherwise(0.9)
    return (by_roc + by_rsi) / 2


#: Shares of the best targets in order, fixed values: least strength, then by number of targets.
EXIT_SHARES = (
    (85, {1: (100,), 2: (70, 30), 3: (70, 30, 0), 4: (70, 30, 0, 0)}),
    (75, {1: (100,), 2: (60, 40), 3: (50, 35, 15), 4: (50, 35, 15, 0)}),
    (0, {1: (100,), 2: (65, 35), 3: (45, 35, 20), 4: (40, 30, 20, 10)}),
)


def rank_targets(candidates: DataFrame, nearest: int = 6, best: int = 4) -> DataFrame:
    """Targets at most 20 % away with reward to risk (to stop_price) of 1.2 to 6: of the nearest six the best four by score, with exit shares."""
    gain = F.abs(F.col("target") - F.col("close"))
    risk = F.abs(F.col("close") - F.col("stop_price"))
    away = gain / F.col("close") * 100
    made = candidates.withColumns({"gain": gain, "rr": ratio(gain, risk), "away": away}).filter(F.col("rr").between(1.2, 6) & (F.col("away") <= 20))
    near = Window.partitionBy(*KEY, "side").orderBy("gain", "seq")
    made = made.withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= nearest)
    weight = reduce(lambda rest, x: F.when(F.col("kind") == x[0], x[1][0]).otherwise(rest), KIND_SCORES.items(), F.lit(50))
    score = weight * F.col("level_strength") / 100 * momentum_factor() * F.greatest(F.lit(0.5), 1 - F.col("away") / 100) * F.col("strength") / 100
    made = made.withColumn("score", score)
    group = Window.partitionBy(*KEY, "side")
    made = made.withColumns({"place": F.row_number().over(group.orderBy(F.desc("score"), "gain", "seq")), "_of": F.least(F.count("*").over(group), F.lit(best))}).filter(F.col("place") <= best)
    share = lambda table: F.element_at(F.element_at(F.create_map(*[x for n, v in table.items() for x in (F.lit(n), F.array(*[F.lit(i) for i in v]))]), F.col("_of").cast("int")), F.col("place"))
    pct = reduce(lambda rest, x: F.when(F.col("strength") >= x[0], share(x[1])).otherwise(rest), reversed(EXIT_SHARES[:-1]), share(EXIT_SHARES[-1][1]))
    return made.withColumn("exit_pct", pct).drop("_n", "_of", "gain", "away")


def exit_scores(positions: DataFrame, indicators: DataFrame) -> DataFrame:
    """How far the indicators (macd_hist, macd_cross, rsi, vwap_dev, roc, bb_pct, vol_osc) have turned against open positions (symbol, side, entry_price), with reasons.

    ``indicators`` has one row a symbol, or one for each time to judge at.
    """
    j = positions.join(indicators, "symbol")
    long = F.col("side") == "LONG"
    value = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    # Seen from a LONG: a SHORT has the mirrored momentum, RSI and band.
    hist, roc = _way() * value("macd_hist", 0.0), _way() * value("roc", 0.0)
    rsi = F.when(long, value("rsi", 50.0)).otherwise(100 - value("rsi", 50.0))
    band = F.when(long, value("bb_pct", 0.5)).otherwise(1 - value("bb_pct", 0.5))
    crossed = F.coalesce(F.col("macd_cross") == F.when(long, "BEARISH").otherwise("BULLISH"), F.lit(False))
    dev, moved = value("vwap_dev", 0.0), _way() * ratio(F.col("close") - F.col("entry_price"), F.col("entry_price")) * 100
    rules = [
        [("MACD_CROSS", crossed, 25), ("MACD_AGAINST", hist < -0.01, 15)],
        [("RSI_EXTREME", rsi > 80, 25), ("RSI_SEVERE", rsi > 75, 15)],
        [("VWAP_VERY_FAR", long & (dev > 3), 20), ("VWAP_FAR", long & (dev > 2), 10), ("VWAP_RETURN", ~long & (dev > -1) & (dev < 1), 20), ("VWAP_BELOW", ~long & (dev < -2), 15)],
        [("MOMENTUM_STRONG", roc < -2.5, 25), ("MOMENTUM", roc < -1, 15)],
        [("BAND_EDGE", band > 0.9, 20), ("BAND_ZONE", band > 0.8, 10)],
        [("VOLUME", (value("vol_osc", 0.0) > 50) & F.coalesce(moved < -1, F.lit(False)), 15)],
    ]
    first = lambda rule, k, rest: reduce(lambda r, x: F.when(x[1], x[k]).otherwise(r), reversed(rule), rest)
    return j.withColumns({
        "exit_score": sum((first(r, 2, F.lit(0)) for r in rules), F.lit(0)),
        "reasons": F.array_join(F.array_compact(F.array(*[first(r, 0, F.lit(None).cast("string")) for r in rules])), ","),
        "trend_reversal": (crossed | (hist < -0.01)) & ((rsi > 70) | (roc < -1)),
        "volume_divergence": (value("vol_osc", 0.0) > 50) & F.coalesce(moved < -2, F.lit(False)),
    })


def exit_urgency(scores: DataFrame) -> DataFrame:
    """Urgency and share to exit by the score; below 60 nothing is to be done."""
    s = F.col("exit_score")
    return scores.withColumns({
        "urgency": F.when(s >= 80, "EXIT_URGENT").when(s >= 70, "EXIT_RECOMMENDED").when(s >= 60, "EXIT_WATCH").otherwise("HOLD"),
        "exit_pct": F.when(s >= 90, 100).when(s >= 80, 75).when(s >= 70, 50).otherwise(0)})
