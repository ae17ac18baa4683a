"""Queries on bars: indicators, features, contexts, events and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.operators import events, patterns
from barline.operators import indicators as I
from barline.sources.tables import HOUR, HOURLY_SQL, hourly

QUERIES, ORACLE_SQL = {}, {}
R = lambda c: F.round(c, 6)
W = "(PARTITION BY symbol ORDER BY open_ms"


def query(sql: str, reach: tuple[int, int] | None = None):
    """reach: rows before and after that a row's result rests on; symbols are then worked on in parts."""

    def add(f):
        def run(spark, folder):
            b = hourly(spark, folder)
            return I.whole(f(I.split(b, *reach, HOUR)), HOUR) if reach else f(b)

        QUERIES[f.__name__] = run
        ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {HOURLY_SQL}{sql}"
        return f

    return add


@query(" SELECT symbol, open_ms, open, high, low, close, volume, round(quote, 6) AS quote FROM bars")
def bars_hourly_ohlcv(b: DataFrame) -> DataFrame:
    return b.withColumn("quote", R("quote"))


@query(f""", g AS (SELECT symbol, open_ms, open_ms - lag(open_ms) OVER {W}) AS gap FROM bars),
s AS (SELECT *, sum(CASE WHEN gap > 3600000 THEN 1 ELSE 0 END) OVER {W} ROWS UNBOUNDED PRECEDING) AS segment FROM g)
SELECT symbol, CAST(segment AS BIGINT) AS segment, count(*) AS n_bars, min(open_ms) AS first_ms, max(open_ms) AS last_ms,
  CAST(coalesce(sum(CASE WHEN gap > 3600000 THEN gap // 3600000 - 1 END), 0) AS BIGINT) AS missing_before FROM s GROUP BY symbol, segment""")
def bar_gap_segments(b: DataFrame) -> DataFrame:
    told = I.segments(b, HOUR)
    missing = F.coalesce(F.sum(F.when(F.col("gap_ms") > HOUR, F.expr(f"gap_ms DIV {HOUR} - 1"))), F.lit(0))
    return told.groupBy("symbol", "segment").agg(F.count("*").alias("n_bars"), F.min("open_ms").alias("first_ms"), F.max("open_ms").alias("last_ms"), missing.alias("missing_before"))


@query(f""", x AS (SELECT *, count(*) OVER f AS n, avg(close) OVER f AS m, stddev_pop(close) OVER f AS s FROM bars WINDOW f AS {W} ROWS 19 PRECEDING))
SELECT symbol, open_ms, CASE WHEN n = 20 THEN round(m, 6) END AS middle, CASE WHEN n = 20 THEN round(m + 2 * s, 6) END AS upper, CASE WHEN n = 20 THEN round(m - 2 * s, 6) END AS lower FROM x""", (20, 0))
def indicator_sma_bollinger(b: DataFrame) -> DataFrame:
    mid, up, low = I.bollinger("close")
    return b.select(*I.KEYS, R(mid).alias("middle"), R(up).alias("upper"), R(low).alias("lower"))


_RSI = f""", d AS (SELECT *, close - lag(close) OVER {W}) AS d FROM bars),
x AS (SELECT *, count(d) OVER f AS n, avg(greatest(d, 0)) OVER f AS g, avg(greatest(-d, 0)) OVER f AS l FROM (SELECT * FROM d) WINDOW f AS {W} ROWS 13 PRECEDING)),
r AS (SELECT symbol, open_ms, CASE WHEN n = 14 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END AS rsi FROM x)"""


@query(_RSI.replace("avg(greatest(d, 0))", "avg(CASE WHEN d IS NOT NULL THEN greatest(d, 0) END)").replace("avg(greatest(-d, 0))", "avg(CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END)") + f""", p AS (SELECT *, lag(rsi) OVER {W}) AS before FROM r)
SELECT symbol, open_ms, round(rsi, 6) AS rsi, CASE WHEN before <= 70 AND rsi > 70 THEN 'over' WHEN before >= 30 AND rsi < 30 THEN 'under' END AS crossing FROM p""", (16, 0))
def indicator_rsi_simple(b: DataFrame) -> DataFrame:
    told = I.rsi_simple(b).withColumn("before", I.lag("rsi"))
    crossing = F.when((F.col("before") <= 70) & (F.col("rsi") > 70), "over").when((F.col("before") >= 30) & (F.col("rsi") < 30), "under")
    return told.select(*I.KEYS, R("rsi").alias("rsi"), crossing.alias("crossing"))


@query(f""", x AS (SELECT symbol, open_ms, list(close) OVER {W} ROWS 59 PRECEDING) AS c FROM bars)
SELECT symbol, open_ms, CASE WHEN len(c) = 60 THEN round(list_reduce(c, lambda e, v: e + CAST(2 AS DOUBLE) / 13 * (v - e)), 6) END AS ema12,
  CASE WHEN len(c) = 60 THEN round(list_reduce(c, lambda e, v: e + CAST(2 AS DOUBLE) / 27 * (v - e)), 6) END AS ema26 FROM x""", (60, 0))
def indicator_ema_finite(b: DataFrame) -> DataFrame:
    return b.select(*I.KEYS, R(I.ema_finite("close", 12)).alias("ema12"), R(I.ema_finite("close", 26)).alias("ema26"))


@query(f""", x AS (SELECT symbol, open_ms, list(close) OVER {W}) AS c FROM bars)
SELECT symbol, open_ms, CASE WHEN len(c) >= 12 THEN round(list_reduce(list_concat([list_sum(c[1:12]) / 12], c[13:]), lambda e, v: e + (v - e) * CAST(2 AS DOUBLE) / 13), 6) END AS ema FROM x""")
def indicator_ema_recursive(b: DataFrame) -> DataFrame:
    return I.ema_recursive(b, "close", 12).select(*I.KEYS, R("ema").alias("ema"))


@query(f""", d AS (SELECT *, close - lag(close) OVER {W}) AS d FROM bars),
x AS (SELECT symbol, open_ms, list_filter(list(d) OVER {W}), lambda v: v IS NOT NULL) AS c FROM d),
y AS (SELECT symbol, open_ms, len(c) AS n, list_transform(c, lambda v: greatest(v, 0)) AS g, list_transform(c, lambda v: greatest(-v, 0)) AS l FROM x),
z AS (SELECT symbol, open_ms, list_reduce(list_concat([list_sum(g[1:14]) / 14], g[15:]), lambda e, v: (e * 13 + v) / 14) AS g,
  list_reduce(list_concat([list_sum(l[1:14]) / 14], l[15:]), lambda e, v: (e * 13 + v) / 14) AS l FROM y WHERE n >= 14)
SELECT symbol, open_ms, round(CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi FROM z""")
def indicator_rsi_wilder(b: DataFrame) -> DataFrame:
    return I.rsi_wilder(b).where("rsi IS NOT NULL").select(*I.KEYS, R("rsi").alias("rsi"))


@query(f""", t AS (SELECT *, CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM bars WINDOW w AS {W}))
SELECT symbol, open_ms, round(tr, 6) AS true_range, CASE WHEN count(tr) OVER f = 14 THEN round(avg(tr) OVER f, 6) END AS atr14 FROM t WINDOW f AS {W} ROWS 13 PRECEDING)""", (16, 0))
def indicator_atr_true_range(b: DataFrame) -> DataFrame:
    return b.withColumn("tr", I.true_range()).select(*I.KEYS, R("tr").alias("true_range"), R(I.sma("tr", 14)).alias("atr14"))


@query(f""", s AS (SELECT *, CASE WHEN lag(close) OVER w IS NULL THEN volume ELSE sign(close - lag(close) OVER w) * volume END AS step FROM bars WINDOW w AS {W}))
SELECT symbol, open_ms, CAST(sum(step) OVER {W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS obv FROM s""")
def indicator_obv(b: DataFrame) -> DataFrame:
    return b.withColumn("step", I.obv_step()).select(*I.KEYS, F.sum("step").over(I.frame(Window.unboundedPreceding, 0)).cast("long").alias("obv"))


@query(f""", p AS (SELECT *, (high + low + close) / 3 * volume AS pv, open_ms // 86400000 AS day FROM bars)
SELECT symbol, open_ms, round(sum(pv) OVER d / sum(volume) OVER d, 6) AS vwap_day, round(sum(pv) OVER r / sum(volume) OVER r, 6) AS vwap_24 FROM p
WINDOW d AS (PARTITION BY symbol, day ORDER BY open_ms ROWS UNBOUNDED PRECEDING), r AS {W} ROWS 23 PRECEDING)""")
def indicator_vwap(b: DataFrame) -> DataFrame:
    p = b.withColumn("pv", (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")).withColumn("day", F.expr("open_ms DIV 86400000"))
    d, r = Window.partitionBy("symbol", "day").orderBy("open_ms").rowsBetween(Window.unboundedPreceding, 0), I.frame(-23, 0)
    return p.select(*I.KEYS, R(F.sum("pv").over(d) / F.sum("volume").over(d)).alias("vwap_day"), R(F.sum("pv").over(r) / F.sum("volume").over(r)).alias("vwap_24"))


@query(f""", x AS (SELECT *, count(*) OVER f AS n, avg(close) OVER f AS m, stddev_samp(close) OVER f AS s, lag(close) OVER w AS c1, lag(close, 4) OVER w AS c4, lag(close, 5) OVER w AS c5
  FROM bars WINDOW f AS {W} ROWS 19 PRECEDING), w AS {W}))
SELECT symbol, open_ms, CASE WHEN n = 20 AND s > 0 THEN round((close - m) / s, 6) END AS zscore, CASE WHEN n = 20 AND m <> 0 THEN round(close / m, 6) END AS ratio,
  CASE WHEN c1 <> 0 THEN round((close - c1) / c1 * 100, 6) END AS return1, CASE WHEN c4 <> 0 THEN round((close - c4) / c4 * 100, 6) END AS return4, round((close - c5) / 5, 6) AS slope5 FROM x""", (20, 0))
def feature_zscore_ratio(b: DataFrame) -> DataFrame:
    m, s = I.sma("close", 20), I.full(F.stddev_samp("close").over(I.frame(-19, 0)), "close", 20)
    x = b.withColumn("m", m).withColumn("s", s).withColumn("c1", I.lag("close")).withColumn("c4", I.lag("close", 4)).withColumn("c5", I.lag("close", 5))
    back = lambda c: R(F.when(F.col(c) != 0, (F.col("close") - F.col(c)) / F.col(c) * 100))
    return x.select(*I.KEYS, R(F.when(F.col("s") > 0, (F.col("close") - F.col("m")) / F.col("s"))).alias("zscore"), R(F.when(F.col("m") != 0, F.col("close") / F.col("m"))).alias("ratio"),
        back("c1").alias("return1"), back("c4").alias("return4"), R((F.col("close") - F.col("c5")) / 5).alias("slope5"))


@query(""" SELECT symbol, open_ms, CASE WHEN open <> 0 THEN round((high - low) / open * 100, 6) END AS range_pct, CASE WHEN high > low THEN round(abs(close - open) / (high - low), 6) END AS body,
  CASE WHEN high > low THEN round((high - greatest(open, close)) / (high - low), 6) END AS upper_wick, CASE WHEN high > low THEN round((least(open, close) - low) / (high - low), 6) END AS lower_wick FROM bars""")
def feature_candle_geometry(b: DataFrame) -> DataFrame:
    span = F.col("high") - F.col("low")
    part = lambda x: R(F.when(span > 0, x / span))
    return b.select(*I.KEYS, R(F.when(F.col("open") != 0, span / F.col("open") * 100)).alias("range_pct"), part(F.abs(F.col("close") - F.col("open"))).alias("body"),
        part(F.col("high") - F.greatest("open", "close")).alias("upper_wick"), part(F.least("open", "close") - F.col("low")).alias("lower_wick"))


@query(""", p AS (SELECT symbol, open_ms, open_ms // 3600000 % 24 AS h, (open_ms // 86400000 + 3) % 7 AS monday0, (open_ms // 86400000 + 4) % 7 AS sunday0 FROM bars)
SELECT symbol, open_ms, round(sin(2 * pi() * h / 24), 6) AS hour_sin, round(cos(2 * pi() * h / 24), 6) AS hour_cos, round(sin(2 * pi() * monday0 / 7), 6) AS monday_sin,
  round(cos(2 * pi() * monday0 / 7), 6) AS monday_cos, round(sin(2 * pi() * sunday0 / 7), 6) AS sunday_sin, round(cos(2 * pi() * sunday0 / 7), 6) AS sunday_cos FROM p""")
def feature_time_cyclic(b: DataFrame) -> DataFrame:
    """Both weekday encodings: Monday as 0 and Sunday as 0."""
    day = F.expr("open_ms DIV 86400000")
    turn = lambda x, n: 2 * F.pi() * x / n
    h, m, s = F.expr("open_ms DIV 3600000 % 24"), (day + 3) % 7, (day + 4) % 7
    return b.select(*I.KEYS, *[R(f(turn(x, n))).alias(f"{name}_{f.__name__}") for name, x, n in (("hour", h, 24), ("monday", m, 7), ("sunday", s, 7)) for f in (F.sin, F.cos)])


@query(f""", x AS (SELECT *, lead(close) OVER w AS c1, lead(close, 4) OVER w AS c4 FROM bars WINDOW w AS {W})),
y AS (SELECT symbol, open_ms, CASE WHEN close <> 0 THEN (c1 - close) / close * 100 END AS r1, CASE WHEN close <> 0 THEN (c4 - close) / close * 100 END AS r4 FROM x)
SELECT symbol, open_ms, round(r1, 6) AS return_1h, CASE WHEN r1 IS NULL THEN NULL WHEN r1 > 0.3 THEN 1 WHEN r1 < -0.3 THEN -1 ELSE 0 END AS direction_1h,
  round(r4, 6) AS return_4h, CASE WHEN r4 IS NULL THEN NULL WHEN r4 > 0.6 THEN 1 WHEN r4 < -0.6 THEN -1 ELSE 0 END AS direction_4h FROM y""", (0, 4))
def targets_forward_direction(b: DataFrame) -> DataFrame:
    x = b
    for n in (1, 4):
        x = x.withColumn(f"r{n}", F.when(F.col("close") != 0, (I.lead("close", n) - F.col("close")) / F.col("close") * 100))
    sign = lambda c, t: F.when(F.col(c).isNull(), None).when(F.col(c) > t, 1).when(F.col(c) < -t, -1).otherwise(0)
    return x.select(*I.KEYS, R("r1").alias("return_1h"), sign("r1", 0.3).alias("direction_1h"), R("r4").alias("return_4h"), sign("r4", 0.6).alias("direction_4h"))


@query(f""", x AS (SELECT symbol, open_ms, flatten(list([open, high, low, close]) OVER f) AS v, min(open_ms) OVER f AS first_ms, count(*) OVER f AS n FROM bars WINDOW f AS {W} ROWS 4 PRECEDING))
SELECT symbol, open_ms, CAST(len(v) AS INTEGER) AS dim, round(list_sum(v), 6) AS total, round(v[1], 6) AS first_open FROM x WHERE n = 5 AND open_ms - first_ms = 14400000""", (5, 0))
def windows_flattened(b: DataFrame) -> DataFrame:
    """Five contiguous bars as one vector of their columns."""
    v = I.frame(-4, 0)
    x = b.select(*I.KEYS, F.flatten(F.collect_list(F.array("open", "high", "low", "close")).over(v)).alias("v"), F.min("open_ms").over(v).alias("first_ms"), F.count("*").over(v).alias("n"))
    x = x.where((F.col("n") == 5) & (F.col("open_ms") - F.col("first_ms") == 4 * HOUR))
    return x.select(*I.KEYS, F.size("v").alias("dim"), R(F.aggregate("v", F.lit(0.0), lambda s, y: s + y)).alias("total"), R(F.col("v")[0]).alias("first_open"))


CONTEXT_SQL = f""", k0 AS (SELECT *, close - lag(close) OVER w AS d, CASE WHEN close <> 0 THEN CASE WHEN lag(close) OVER w IS NULL THEN high - low
  ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END / close END AS r FROM bars WINDOW w AS {W})),
k1 AS (SELECT *, count(*) FILTER (d > 0) OVER f AS up, count(*) FILTER (d < 0) OVER f AS down, count(d) OVER f AS seen, quantile_cont(r, 0.5) OVER p AS prior, count(r) OVER p AS many
  FROM k0 WINDOW f AS {W} ROWS 4 PRECEDING), p AS {W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
ctx AS (SELECT symbol, open_ms, open, high, low, close, volume, quote, CASE WHEN seen < 3 THEN 'unknown' WHEN up >= 4 AND down <= 1 THEN 'up' WHEN down >= 4 AND up <= 1 THEN 'down' ELSE 'sideways' END AS trend,
  CASE WHEN many < 10 OR r IS NULL THEN 'unknown' WHEN r >= 1.5 * prior THEN 'high' WHEN r <= 0.67 * prior THEN 'low' ELSE 'normal' END AS volatility FROM k1)"""


@query(CONTEXT_SQL + " SELECT symbol, open_ms, trend, volatility FROM ctx", (24, 0))
def context_trend_volatility(b: DataFrame) -> DataFrame:
    return I.contexts(b).select(*I.KEYS, "trend", "volatility")


EVENTS_SQL = CONTEXT_SQL + f""", e0 AS (SELECT *, avg(close) OVER a AS m, count(*) OVER a AS n, avg(volume) OVER v AS pv, count(*) OVER v AS nv, row_number() OVER w AS i,
  lag(close) OVER w AS pc, lag(trend) OVER w AS pt, lag(volatility) OVER w AS pvol
  FROM ctx WINDOW a AS {W} ROWS 49 PRECEDING), v AS {W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), w AS {W})),
e1 AS (SELECT *, lag(m) OVER w AS pm, lag(n) OVER w AS pn FROM e0 WINDOW w AS {W})),
ev AS (
  SELECT symbol, open_ms, 'technicalIndicators' AS module, CASE WHEN pc <= pm AND close > m THEN 'CLOSE_ABOVE_SMA50' ELSE 'CLOSE_BELOW_SMA50' END AS event_type FROM e1 WHERE n = 50 AND pn = 50 AND (pc <= pm AND close > m OR pc >= pm AND close < m)
  UNION ALL SELECT symbol, open_ms, 'volumeAnomaly', 'VOLUME_ANOMALY_' || CASE WHEN t = 2 THEN '2_0X' ELSE '1_5X' END FROM e1, (SELECT unnest([1.5, 2.0]) AS t) WHERE nv = 20 AND volume >= t * pv
  UNION ALL SELECT symbol, open_ms, 'marketRegime', 'REGIME_' || CASE trend WHEN 'up' THEN 'BULL' WHEN 'down' THEN 'BEAR' ELSE 'SIDEWAYS' END || '_' || upper(volatility) FROM e1 WHERE i > 11 AND (trend <> pt OR volatility <> pvol))"""


@query(EVENTS_SQL + " SELECT * FROM ev", (60, 0))
def events_cross_anomaly_regime(b: DataFrame) -> DataFrame:
    return events.causal(b).select("symbol", "open_ms", "module", "event_type")


@query(f""", p AS (SELECT *, max(high) OVER l AS hl, max(high) OVER r AS hr, min(low) OVER l AS ll, min(low) OVER r AS lr, count(*) OVER l AS nl, count(*) OVER r AS nr, lead(open_ms, 2) OVER {W}) AS confirmed_ms
  FROM bars WINDOW l AS {W} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), r AS {W} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
q AS (SELECT symbol, open_ms, confirmed_ms, CASE WHEN high > hl AND high > hr THEN 'high' WHEN low < ll AND low < lr THEN 'low' END AS kind, CASE WHEN high > hl AND high > hr THEN high ELSE low END AS price FROM p WHERE nl = 2 AND nr = 2),
z AS (SELECT *, lag(kind) OVER {W}) AS before FROM q WHERE kind IS NOT NULL)
SELECT symbol, open_ms, confirmed_ms, kind, round(price, 6) AS price, before IS NULL OR before <> kind AS leg FROM z""")
def events_pivots_legs(b: DataFrame) -> DataFrame:
    return events.pivots(b).select("symbol", "open_ms", "confirmed_ms", "kind", R("price").alias("price"), "leg")


@query(f""", x AS (SELECT *, lag(high, 2) OVER w AS h0, lag(low, 2) OVER w AS l0, min(low) OVER f AS lo, max(high) OVER f AS hi FROM bars WINDOW w AS {W}), f AS {W} ROWS BETWEEN 1 FOLLOWING AND 99 FOLLOWING))
SELECT symbol, open_ms, CASE WHEN h0 < low THEN 'bullish' ELSE 'bearish' END AS kind, round(CASE WHEN h0 < low THEN h0 ELSE high END, 6) AS gap_low, round(CASE WHEN h0 < low THEN low ELSE l0 END, 6) AS gap_high,
  coalesce(CASE WHEN h0 < low THEN lo <= h0 ELSE hi >= l0 END, false) AS mitigated FROM x WHERE h0 < low OR l0 > high""", (2, 99))
def events_fvg_mitigation(b: DataFrame) -> DataFrame:
    return events.gaps(b).select("symbol", "open_ms", "kind", R("gap_low").alias("gap_low"), R("gap_high").alias("gap_high"), "mitigated")


@query(f""", p AS (SELECT *, max(high) OVER l AS hl, max(high) OVER r AS hr, min(low) OVER l AS ll, min(low) OVER r AS lr, count(*) OVER l AS nl, count(*) OVER r AS nr
  FROM bars WINDOW l AS {W} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), r AS {W} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
q AS (SELECT *, CASE WHEN nl = 2 AND nr = 2 AND high > hl AND high > hr THEN high END AS ph, CASE WHEN nl = 2 AND nr = 2 AND low < ll AND low < lr THEN low END AS pl FROM p),
v AS (SELECT *, last_value(ph IGNORE NULLS) OVER f AS top, last_value(pl IGNORE NULLS) OVER f AS bottom FROM q WINDOW f AS {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)),
d AS (SELECT *, CASE WHEN close > top THEN 'up' WHEN close < bottom THEN 'down' END AS way FROM v),
z AS (SELECT *, last_value(way IGNORE NULLS) OVER {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d)
SELECT symbol, open_ms, way, CASE WHEN before IS NULL OR before = way THEN 'BOS' ELSE 'CHOCH' END AS event_type, round(CASE WHEN way = 'up' THEN top ELSE bottom END, 6) AS price FROM z WHERE way IS NOT NULL""")
def events_bos_choch(b: DataFrame) -> DataFrame:
    return events.structure(b).select("symbol", "open_ms", "way", "event_type", R("price").alias("price"))


@query(CONTEXT_SQL + patterns.SINGLE_SQL + " SELECT symbol, open_ms, shape, pattern1, pattern2, pattern3 FROM pat WHERE shape IS NOT NULL OR pattern1 IS NOT NULL OR pattern2 IS NOT NULL OR pattern3 IS NOT NULL", (24, 4))
def patterns_candles(b: DataFrame) -> DataFrame:
    return patterns.recognise(I.contexts(b)).select("symbol", "open_ms", "shape", "pattern1", "pattern2", "pattern3").where("coalesce(shape, pattern1, pattern2, pattern3) IS NOT NULL")


@query(CONTEXT_SQL + patterns.SINGLE_SQL + f""", named AS (SELECT symbol, open_ms, pattern1 AS p FROM pat WHERE pattern1 IS NOT NULL)
SELECT array_to_string(chain, '>') AS chain, CAST(k AS INTEGER) AS n, count(*) AS seen FROM (
  SELECT symbol, k, list(p) OVER (PARTITION BY symbol, k ORDER BY open_ms ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)[1:k] AS chain FROM named, (SELECT unnest([3, 4, 5]) AS k)) WHERE len(chain) = k GROUP BY chain, k""")
def pattern_ngrams(b: DataFrame) -> DataFrame:
    named = patterns.recognise(I.contexts(b)).where("pattern1 IS NOT NULL").select("symbol", "open_ms", F.col("pattern1").alias("p"))
    return patterns.ngrams(named, (3, 4, 5))


HORIZON_SQL = f""", h0 AS (SELECT *, sum(CASE WHEN g > 3600000 THEN 1 ELSE 0 END) OVER {W} ROWS UNBOUNDED PRECEDING) AS segment FROM (SELECT *, open_ms - lag(open_ms) OVER {W}) AS g FROM bars)),
h1 AS (SELECT symbol, open_ms, h, close, lead(close, h) OVER w AS c, max(high) OVER f AS hi, min(low) OVER f AS lo FROM h0, (SELECT unnest([1, 3, 6]) AS h)
  WINDOW w AS (PARTITION BY symbol, segment, h ORDER BY open_ms), f AS (PARTITION BY symbol, segment, h ORDER BY open_ms ROWS BETWEEN 1 FOLLOWING AND h FOLLOWING)),
fwd AS (SELECT symbol, open_ms, CAST(h AS INTEGER) AS horizon, c / close - 1 AS forward_return, hi / close - 1 AS mfe, lo / close - 1 AS mae FROM h1 WHERE c IS NOT NULL AND close <> 0)"""


@query(HORIZON_SQL + " SELECT symbol, open_ms, horizon, round(forward_return, 6) AS forward_return, round(mfe, 6) AS mfe, round(mae, 6) AS mae FROM fwd", (0, 6))
def forward_horizon_mfe_mae(b: DataFrame) -> DataFrame:
    return events.horizons(b).select("symbol", "open_ms", "horizon", R("forward_return").alias("forward_return"), R("mfe").alias("mfe"), R("mae").alias("mae"))


@query(EVENTS_SQL + HORIZON_SQL + """ SELECT module, event_type, horizon, count(*) AS stored, count(forward_return) AS eligible, round(avg(forward_return), 6) AS mean, round(quantile_cont(forward_return, 0.5), 6) AS median,
  round(min(forward_return), 6) AS least, round(max(forward_return), 6) AS most, count(*) FILTER (forward_return > 0) AS positive
FROM (SELECT e.*, h.h AS horizon, f.forward_return FROM ev e CROSS JOIN (SELECT CAST(unnest([1, 3, 6]) AS INTEGER) AS h) h LEFT JOIN fwd f ON f.symbol = e.symbol AND f.open_ms = e.open_ms AND f.horizon = h.h)
GROUP BY GROUPING SETS ((module, event_type, horizon), (module, horizon), (horizon))""")
def event_group_profiles(b: DataFrame) -> DataFrame:
    """What followed each kind of event, by type, by module and over all: nothing is dropped, missing outcomes are counted."""
    b = I.split(b, 60, 6, HOUR)
    ev = I.whole(events.causal(b), HOUR).select("symbol", "open_ms", "module", "event_type", F.explode(F.array(F.lit(1), F.lit(3), F.lit(6))).alias("horizon"))
    both = ev.join(I.whole(events.horizons(b), HOUR), ["symbol", "open_ms", "horizon"], "left")
    x = F.col("forward_return")
    sets = both.groupingSets([("module", "event_type", "horizon"), ("module", "horizon"), ("horizon",)], "module", "event_type", "horizon")
    return sets.agg(F.count("*").alias("stored"), F.count(x).alias("eligible"), R(F.avg(x)).alias("mean"), R(F.percentile(x, 0.5)).alias("median"), R(F.min(x)).alias("least"), R(F.max(x)).alias("most"), F.count_if(x > 0).alias("positive"))
