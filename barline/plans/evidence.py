"""Queries on event modules over contiguous bars of four hours: events, agreement, lifecycles, exclusions, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.operators import modules
from barline.operators import indicators as I
from barline.plans.series import CONTEXT_SQL
from barline.sources.tables import FOUR_SQL, HOUR, four_hourly, millis, table

QUERIES, ORACLE_SQL = {}, {}
R = lambda c: F.round(c, 6)
W = "(PARTITION BY symbol ORDER BY open_ms"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return modules.by_segment(four_hourly(spark, d), 4 * HOUR)


_REDUCE = "list_reduce(list_slice(c, -{n}, -1), lambda e, v: CAST(2 AS DOUBLE) / {p} * v + (1 - CAST(2 AS DOUBLE) / {p}) * e)"
INDICATOR_SQL = f""", n0 AS (SELECT *, list(close) OVER {W} ROWS 59 PRECEDING) AS c, avg(close) OVER {W} ROWS 49 PRECEDING) AS m, close - lag(close) OVER {W}) AS d FROM bars),
n1 AS (SELECT symbol, open_ms, i, close, m, {_REDUCE.format(n=60, p=13)} AS fast, {_REDUCE.format(n=60, p=27)} AS slow,
  avg(CASE WHEN d > 0 THEN d ELSE 0 END) OVER w AS g, avg(CASE WHEN d < 0 THEN -d ELSE 0 END) OVER w AS l FROM n0 WINDOW w AS {W} ROWS 13 PRECEDING)),
n2 AS (SELECT *, CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS rsi FROM n1),
n3 AS (SELECT *, lag(fast) OVER w AS pf, lag(slow) OVER w AS ps, lag(rsi) OVER w AS pr, lag(m) OVER w AS pm, lag(close) OVER w AS pc FROM n2 WINDOW w AS {W})),
ind AS (
  SELECT symbol, open_ms, 'technicalIndicators' AS module, CASE WHEN pf <= ps AND fast > slow THEN 'EMA_BULL_CROSS' WHEN pf >= ps AND fast < slow THEN 'EMA_BEAR_CROSS' END AS event_type FROM n3 WHERE i >= 60
  UNION ALL SELECT symbol, open_ms, 'technicalIndicators', CASE WHEN pr >= 30 AND rsi < 30 THEN 'RSI_ENTER_OVERSOLD' WHEN pr <= 30 AND rsi > 30 THEN 'RSI_EXIT_OVERSOLD' WHEN pr <= 70 AND rsi > 70 THEN 'RSI_ENTER_OVERBOUGHT' WHEN pr >= 70 AND rsi < 70 THEN 'RSI_EXIT_OVERBOUGHT' END FROM n3 WHERE i >= 60
  UNION ALL SELECT symbol, open_ms, 'technicalIndicators', CASE WHEN pc <= pm AND close > m THEN 'CLOSE_ABOVE_SMA50' WHEN pc >= pm AND close < m THEN 'CLOSE_BELOW_SMA50' END FROM n3 WHERE i >= 60)"""
SHAPE_SQL = f""", p0 AS (SELECT *, abs(close - open) AS body, high - low AS span, lag(open) OVER {W}) AS po, lag(close) OVER {W}) AS pc FROM bars),
p1 AS (SELECT *, greatest(body, span * 0.000001) AS safe, high - greatest(open, close) AS up, least(open, close) - low AS down FROM p0 WHERE span > 0),
pat AS (SELECT symbol, open_ms, 'candlePatterns' AS module, 'DOJI' AS event_type FROM p1 WHERE body / span <= 0.1
  UNION ALL SELECT symbol, open_ms, 'candlePatterns', 'HAMMER_SHAPE' FROM p1 WHERE down >= 2 * safe AND up <= safe
  UNION ALL SELECT symbol, open_ms, 'candlePatterns', 'SHOOTING_STAR_SHAPE' FROM p1 WHERE up >= 2 * safe AND down <= safe
  UNION ALL SELECT symbol, open_ms, 'candlePatterns', 'BULLISH_ENGULFING' FROM p1 WHERE pc < po AND close > open AND open <= pc AND close >= po
  UNION ALL SELECT symbol, open_ms, 'candlePatterns', 'BEARISH_ENGULFING' FROM p1 WHERE pc > po AND close < open AND open >= pc AND close <= po)"""
PROFILE_SQL = f""", f0 AS (SELECT a.symbol, a.open_ms, a.i, min(b.low) AS lo, max(b.high) AS hi FROM bars a JOIN bars b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 99 AND a.i WHERE a.i >= 99 GROUP BY ALL),
f1 AS (SELECT f.symbol, f.open_ms, lo, hi, least(23, greatest(0, CAST(floor(((high + low + close) / 3 - lo) / ((hi - lo) / 24)) AS BIGINT))) AS slot, CAST(sum(volume) AS DOUBLE) AS v
  FROM f0 f JOIN bars b ON f.symbol = b.symbol AND b.i BETWEEN f.i - 99 AND f.i WHERE hi > lo GROUP BY ALL),
f2 AS (SELECT *, sum(v) OVER (PARTITION BY symbol, open_ms ORDER BY v DESC, slot ROWS UNBOUNDED PRECEDING) - v AS before, sum(v) OVER (PARTITION BY symbol, open_ms) AS total, row_number() OVER (PARTITION BY symbol, open_ms ORDER BY v DESC, slot) AS k FROM f1),
lev AS (SELECT symbol, open_ms, min(lo + (slot + 0.5) * (hi - lo) / 24) FILTER (k = 1) AS poc, max(lo + (slot + 0.5) * (hi - lo) / 24) FILTER (before < 0.7 * total) AS vah, min(lo + (slot + 0.5) * (hi - lo) / 24) FILTER (before < 0.7 * total) AS val
  FROM f2 WHERE total > 0 GROUP BY symbol, open_ms),
f3 AS (SELECT b.symbol, b.open_ms, close, lag(close) OVER w AS pc, poc, vah, val, lag(poc) OVER w AS p_poc, lag(vah) OVER w AS p_vah, lag(val) OVER w AS p_val FROM bars b LEFT JOIN lev l ON b.symbol = l.symbol AND b.open_ms = l.open_ms WINDOW w AS (PARTITION BY b.symbol ORDER BY b.open_ms)),
f4 AS (SELECT symbol, open_ms, close, pc, unnest([{{'n': 'POC', 'a': p_poc, 'b': poc}}, {{'n': 'VAH', 'a': p_vah, 'b': vah}}, {{'n': 'VAL', 'a': p_val, 'b': val}}], recursive := true) FROM f3 WHERE poc IS NOT NULL AND p_poc IS NOT NULL),
prof AS (SELECT symbol, open_ms, 'volumeProfile' AS module, CASE WHEN pc < a AND close >= b THEN 'VOLUME_PROFILE_CLOSE_ABOVE_' || n WHEN pc > a AND close <= b THEN 'VOLUME_PROFILE_CLOSE_BELOW_' || n END AS event_type FROM f4)"""
MODULES_SQL = (
    CONTEXT_SQL
    + INDICATOR_SQL
    + SHAPE_SQL
    + PROFILE_SQL
    + f""", r0 AS (SELECT *, row_number() OVER w - 1 AS i, lag(trend) OVER w AS pt, lag(volatility) OVER w AS pv, avg(volume) OVER v AS base, count(*) OVER v AS nb FROM ctx WINDOW w AS {W}), v AS {W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
q0 AS (SELECT *, max(high) OVER l AS hl, max(high) OVER r AS hr, min(low) OVER l AS ll, min(low) OVER r AS lr, count(*) OVER l AS nl, count(*) OVER r AS nr, lead(open_ms, 2) OVER {W}) AS known
  FROM bars WINDOW l AS {W} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), r AS {W} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
q1 AS (SELECT symbol, open_ms, known, CASE WHEN high > hl AND high > hr THEN 'high' WHEN low < ll AND low < lr THEN 'low' END AS kind FROM q0 WHERE nl = 2 AND nr = 2),
q2 AS (SELECT *, lag(kind) OVER {W}) AS before FROM q1 WHERE kind IS NOT NULL),
every_ AS (SELECT * FROM ind UNION ALL SELECT * FROM pat UNION ALL SELECT * FROM prof
  UNION ALL SELECT symbol, open_ms, 'volumeAnomaly', CASE t WHEN 1.5 THEN 'VOLUME_ANOMALY_1_5X' ELSE 'VOLUME_ANOMALY_2_0X' END FROM r0, (SELECT unnest([1.5, 2.0]) AS t) WHERE nb = 20 AND base > 0 AND volume / base >= t
  UNION ALL SELECT symbol, open_ms, 'marketRegime', 'REGIME_' || CASE trend WHEN 'up' THEN 'BULL' WHEN 'down' THEN 'BEAR' ELSE 'SIDEWAYS' END || '_' || upper(volatility) FROM r0 WHERE i >= 11 AND (trend <> pt OR volatility <> pv)
  UNION ALL SELECT symbol, known, 'fibonacci', CASE before WHEN 'low' THEN 'FIBONACCI_LEG_BULL' ELSE 'FIBONACCI_LEG_BEAR' END FROM q2 WHERE before <> kind),
mev AS (SELECT * FROM every_ WHERE event_type IS NOT NULL)"""
)


@query(f"WITH {FOUR_SQL}{MODULES_SQL} SELECT * FROM mev")
def module_events(spark: SparkSession, d: str) -> DataFrame:
    return modules.base_events(_bars(spark, d))


@query(f"""WITH {FOUR_SQL}{MODULES_SQL}, v AS (SELECT *, CASE WHEN regexp_matches(event_type, 'BULL|ABOVE|EXIT_OVERSOLD|ENTER_OVERSOLD') THEN 1 WHEN regexp_matches(event_type, 'BEAR|BELOW|EXIT_OVERBOUGHT|ENTER_OVERBOUGHT') THEN -1 END AS way FROM mev),
m AS (SELECT symbol, open_ms, module, min(way) AS way FROM v WHERE way IS NOT NULL GROUP BY ALL HAVING count(DISTINCT way) = 1)
SELECT symbol, open_ms, CAST(way AS INTEGER) AS way, count(*) AS modules FROM m GROUP BY symbol, open_ms, way HAVING count(*) >= 2""")
def confluence_votes(spark: SparkSession, d: str) -> DataFrame:
    return modules.confluence(modules.base_events(_bars(spark, d)))


@query(f"""WITH {FOUR_SQL}{PROFILE_SQL} SELECT symbol, open_ms, round(poc, 6) AS poc, round(vah, 6) AS vah, round(val, 6) AS val FROM lev""")
def rolling_volume_profile(spark: SparkSession, d: str) -> DataFrame:
    x = modules.profile_levels(_bars(spark, d)).where("poc IS NOT NULL")
    return x.select("symbol", "open_ms", R("poc").alias("poc"), R("vah").alias("vah"), R("val").alias("val"))


@query(f"""WITH {FOUR_SQL}, q AS (SELECT symbol, open_ms, i, k AS level, close * (1 + k / 100.0) AS price, k > 0 AS up FROM bars, (SELECT unnest([-20, -2, 2, 20]) AS k))
SELECT q.symbol, q.open_ms, CAST(q.level AS INTEGER) AS level, CAST(min(b.i) - q.i AS BIGINT) AS bars FROM q LEFT JOIN bars b ON b.symbol = q.symbol AND b.i > q.i AND CASE WHEN up THEN b.high >= price ELSE b.low <= price END GROUP BY q.symbol, q.open_ms, q.level, q.i""")
def lifecycle_first_crossing(spark: SparkSession, d: str) -> DataFrame:
    """Bars until a later bar of the same run first reaches a level over or under each close."""
    b = _bars(spark, d)
    asked = b.select("symbol", "open_ms", "close", F.col("i").alias("at"), F.explode(F.array(*map(F.lit, (-20, -2, 2, 20)))).alias("level"))
    asked = asked.withColumn("price", F.col("close") * (1 + F.col("level") / 100.0)).withColumn("up", F.col("level") > 0)
    told = modules.first_crossing(b, asked, "symbol")
    return told.select("symbol", "open_ms", "level", (F.col("found") - F.col("at")).cast("long").alias("bars"))


@query(f"""WITH {FOUR_SQL}{SHAPE_SQL}, g AS (SELECT CAST(unnest([0.08, 0.1, 0.12]) AS DOUBLE) AS doji), h AS (SELECT CAST(unnest([1.5, 2.0, 2.5]) AS DOUBLE) AS wick),
t AS (SELECT CAST(unnest([1.25, 1.5, 2.0, 2.5]) AS DOUBLE) AS times), v AS (SELECT *, avg(volume) OVER w AS base, count(*) OVER w AS nb FROM bars WINDOW w AS {W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT 'dojiMaxBodyToRange' AS axis, doji AS value, (SELECT count(*) FROM p1 WHERE body / span <= doji) AS n FROM g
UNION ALL SELECT 'longWickToBody', wick, (SELECT count(*) FROM p1 WHERE down >= wick * safe AND up <= safe) + (SELECT count(*) FROM p1 WHERE up >= wick * safe AND down <= safe) FROM h
UNION ALL SELECT 'thresholds', times, (SELECT count(*) FROM v WHERE nb = 20 AND base > 0 AND volume / base >= times) FROM t""")
def sensitivity_grid(spark: SparkSession, d: str) -> DataFrame:
    """Events of each variant of one parameter at a time; variants without events stay."""
    b = _bars(spark, d)
    out = None
    wick = F.col("event_type").isin("HAMMER_SHAPE", "SHOOTING_STAR_SHAPE")
    runs = [("dojiMaxBodyToRange", v, modules.pattern_events(b, doji=v).where("event_type = 'DOJI'")) for v in (0.08, 0.1, 0.12)]
    runs += [("longWickToBody", v, modules.pattern_events(b, long_wick=v).where(wick)) for v in (1.5, 2.0, 2.5)]
    runs += [("thresholds", v, modules.volume_events(b, (v,))) for v in (1.25, 1.5, 2.0, 2.5)]
    for axis, v, found in runs:
        one = found.agg(F.count("*").alias("n")).select(F.lit(axis).alias("axis"), F.lit(v).alias("value"), "n")
        out = one if out is None else out.unionByName(one)
    return out


#: Why an event is left out, in the order in which that is looked at.
REASONS = ("unknown_event_type", "unknown_event_lineage", "unknown_availability", "decision_after_cutoff", "decision_bar_not_found", "source_bar_not_found", "source_bar_not_available")
_CUT = 1706400000000


@query(f"""WITH {FOUR_SQL}{MODULES_SQL}, u AS (SELECT symbol, module, event_type, open_ms, open_ms // 14400000 AS h FROM mev),
e AS (SELECT symbol, module, open_ms, CASE WHEN h % 11 = 0 THEN NULL ELSE event_type END AS event_type, CASE WHEN h % 13 = 0 THEN NULL ELSE 'bars' END AS lineage,
  CASE WHEN h % 17 = 0 THEN NULL ELSE open_ms + 14400000 + CASE WHEN h % 19 = 0 THEN 1 ELSE 0 END END AS available, open_ms + 14400000 AS confirmed,
  CASE WHEN h % 23 = 0 THEN [open_ms - 1, open_ms] WHEN h % 29 = 0 THEN [open_ms + 14400000] ELSE [open_ms] END AS sources FROM u),
s AS (SELECT e.*, d.i AS decision, (SELECT count(*) FROM (SELECT unnest(e.sources) AS o) x WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = e.symbol AND b.open_ms = x.o)) AS lost,
  (SELECT max(o) FROM (SELECT unnest(e.sources) AS o) x) + 14400000 AS latest FROM e LEFT JOIN bars d ON d.symbol = e.symbol AND d.open_ms + 14400000 = e.available),
r AS (SELECT module, CASE WHEN event_type IS NULL THEN 'unknown_event_type' WHEN lineage IS NULL THEN 'unknown_event_lineage' WHEN available IS NULL OR available < confirmed THEN 'unknown_availability'
  WHEN available > {_CUT} THEN 'decision_after_cutoff' WHEN decision IS NULL THEN 'decision_bar_not_found' WHEN lost > 0 THEN 'source_bar_not_found' WHEN latest > available THEN 'source_bar_not_available' ELSE 'eligible' END AS reason FROM s),
k AS (SELECT m.module, x.reason FROM (SELECT DISTINCT module FROM mev) m, (SELECT unnest(['eligible', {", ".join(f"'{x}'" for x in REASONS)}]) AS reason) x)
SELECT k.module, k.reason, count(r.reason) AS n FROM k LEFT JOIN r ON r.module = k.module AND r.reason = k.reason GROUP BY k.module, k.reason""")
def event_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Events by the first reason to leave them out, each reason with its zero; every flaw is planted by the hour."""
    b = _bars(spark, d)
    width = 4 * HOUR
    h = F.expr(f"open_ms DIV {width}")
    e = modules.base_events(b).select(
        "symbol", "module", "open_ms", F.when(h % 11 == 0, None).otherwise(F.col("event_type")).alias("event_type"), F.when(h % 13 == 0, None).otherwise("bars").alias("lineage"),
        F.when(h % 17 == 0, None).otherwise(F.col("open_ms") + width + F.when(h % 19 == 0, 1).otherwise(0)).alias("available"), (F.col("open_ms") + width).alias("confirmed"),
        F.when(h % 23 == 0, F.array(F.col("open_ms") - 1, F.col("open_ms"))).when(h % 29 == 0, F.array(F.col("open_ms") + width)).otherwise(F.array("open_ms")).alias("sources"),
    ).withColumn("id", F.monotonically_increasing_id())
    told = excluded(e, b, width, _CUT).groupBy("module", "reason").agg(F.count("*").alias("n"))
    grid = e.select("module").distinct().withColumn("reason", F.explode(F.array(*map(F.lit, ("eligible", *REASONS)))))
    return grid.join(told, ["module", "reason"], "left").select("module", "reason", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def excluded(e: DataFrame, bars: DataFrame, width: int, cutoff: int) -> DataFrame:
    """e (symbol, event_type, lineage, available, confirmed, sources array of open times, any more) with reason: 'eligible',
    or the first of REASONS that holds. Sources meet the bars one by one and are counted again by event."""
    own = [c for c in e.columns if c != "reason"]
    keyed = e.select(F.struct(*own).alias("e"), F.xxhash64(*own).alias("key"), F.explode_outer("sources").alias("source"))
    opens = bars.select(F.col("symbol").alias("bs"), F.col("open_ms").alias("bo"))
    met = keyed.join(opens, (F.col("e.symbol") == F.col("bs")) & (F.col("source") == F.col("bo")), "left")
    one = met.groupBy("key", "e").agg(F.count("source").alias("many"), F.count("bo").alias("there"), F.max("source").alias("latest"))
    closes = bars.select(F.col("symbol").alias("ds"), (F.col("open_ms") + width).alias("dc"))
    x = one.select("e.*", "many", "there", "latest").join(closes, (F.col("symbol") == F.col("ds")) & (F.col("available") == F.col("dc")), "left")
    late = F.col("available").isNull() | (F.col("available") < F.col("confirmed")) | ((F.col("dc").isNotNull()) & (F.col("available") <= cutoff) & (F.col("many") == 0))
    reason = F.when(F.coalesce(F.trim("event_type"), F.lit("")) == "", REASONS[0]).when(F.col("lineage").isNull(), REASONS[1]).when(late, REASONS[2]).when(F.col("available") > cutoff, REASONS[3])
    reason = reason.when(F.col("dc").isNull(), REASONS[4]).when(F.col("there") < F.col("many"), REASONS[5]).when(F.col("latest") + width > F.col("available"), REASONS[6]).otherwise("eligible")
    return x.withColumn("reason", reason).select(*own, "reason")


@query("""WITH x AS (SELECT event_id, user_id % 7 <> 0 AS model, user_id % 5 <> 0 AS closed, epoch_us(ts) // 1000 AS t, CAST(floor(value) AS BIGINT) * 1000 AS lag_ms FROM events)
SELECT event_id, CASE WHEN NOT model THEN 'model-unavailable' WHEN NOT closed THEN 'signal-bar-not-finalized' WHEN t < t + lag_ms - 20000 THEN 'signal-not-yet-available' WHEN t + lag_ms % 3000 - 2000 > t THEN 'future-observation'
  WHEN lag_ms % 7000 > 5000 THEN 'market-data-stale' ELSE 'allowed' END AS gate,
 CASE WHEN NOT lag_ms > 2000 THEN 'quote-nonpositive' WHEN abs(lag_ms % 5) > 1 THEN 'quote-timestamp-mismatch' WHEN lag_ms > 90000 THEN 'quote-stale' WHEN -lag_ms > -5000 THEN 'quote-from-future' ELSE 'accepted' END AS quote FROM x""")
def fail_closed_gates(spark: SparkSession, d: str) -> DataFrame:
    """Decision gate and quote rejection: the first reason that holds, in order; nothing passes by default."""
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 7 != 0).alias("model"), (F.col("user_id") % 5 != 0).alias("closed"), (F.floor("value").cast("long") * 1000).alias("lag"), millis("ts").alias("t"))
    t, lag = F.col("t"), F.col("lag")
    return e.select("event_id", decision_gate(F.col("model"), F.col("closed"), t + lag - 20000, t, t + lag % 3000 - 2000, lag % 7000 > 5000).alias("gate"), quote_rejection(lag - 2000, lag % 5, lag, F.lit(90000), -lag + 5000 > 0).alias("quote"))


def decision_gate(model, closed, available, decided, observed, stale):
    """Why a decision is not allowed, in the fixed order, or 'allowed'."""
    return (
        F.when(~model, "model-unavailable").when(~closed, "signal-bar-not-finalized").when(decided < available, "signal-not-yet-available").when(observed > decided, "future-observation").when(stale, "market-data-stale").otherwise("allowed")
    )


def quote_rejection(price, mismatch_ms, age_ms, most_ms, ahead):
    """Why a quote cannot price a fill, in the fixed order, or 'accepted'."""
    return F.when(~(price > 0), "quote-nonpositive").when(F.abs(mismatch_ms) > 1, "quote-timestamp-mismatch").when(age_ms > most_ms, "quote-stale").when(ahead, "quote-from-future").otherwise("accepted")


@query(f"""WITH {FOUR_SQL}, n AS (SELECT *, CASE WHEN i % 37 = 5 THEN high - 2 * (high - low) - 1 ELSE high END AS h2, CASE WHEN i % 41 = 7 THEN -close ELSE close END AS c2 FROM bars)
SELECT symbol, open_ms, open_ms + 14400000 <= {_CUT} AS final, coalesce(open > 0 AND h2 > 0 AND low > 0 AND c2 > 0 AND low <= least(open, c2) AND h2 >= greatest(open, c2) AND volume >= 0, false) AS valid,
  array_to_string(list_filter([CASE WHEN NOT (open > 0 AND h2 > 0 AND low > 0 AND c2 > 0) THEN 'nonpositive' END, CASE WHEN h2 < greatest(open, c2) THEN 'high_below_body' END, CASE WHEN low > least(open, c2) THEN 'low_above_body' END], lambda x: x IS NOT NULL), ',') AS flags FROM n""")
def bar_validity(spark: SparkSession, d: str) -> DataFrame:
    """Finality at the cutoff, validity of prices, and every flag that a record raises; flawed prices are planted."""
    b = _bars(spark, d).withColumn("high", F.when(F.col("i") % 37 == 5, F.col("high") - 2 * (F.col("high") - F.col("low")) - 1).otherwise(F.col("high"))).withColumn("close", F.when(F.col("i") % 41 == 7, -F.col("close")).otherwise(F.col("close")))
    flags = bar_flags()
    return b.select("symbol", "open_ms", (F.col("open_ms") + 4 * HOUR <= _CUT).alias("final"), ((F.size(flags) == 0) & (F.col("volume") >= 0)).alias("valid"), F.array_join(flags, ",").alias("flags"))


def bar_flags():
    """What is wrong with a bar: an array of names, empty for a sound one."""
    sound = lambda c: F.coalesce((F.col(c) > 0) & (F.col(c) < float("inf")), F.lit(False))
    bad = ~(sound("open") & sound("high") & sound("low") & sound("close"))
    return F.filter(
        F.array(
            F.when(bad, "nonpositive"), F.when(F.col("high") < F.greatest("open", "close"), "high_below_body"), F.when(F.col("low") > F.least("open", "close"), "low_above_body")),
        lambda x: x.isNotNull(),
    )


@query(f"""WITH {FOUR_SQL}, x AS (SELECT symbol, open_ms, unnest([CASE WHEN i % 3 = 0 THEN NULL ELSE open END, CASE WHEN i % 7 < 5 THEN NULL ELSE high END, CASE WHEN i % 2 = 0 THEN NULL ELSE close END, low]) AS v FROM bars),
r AS (SELECT symbol, open_ms, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) AS r, count(v) = 4 AS whole FROM x GROUP BY symbol, open_ms)
SELECT symbol, open_ms, round(r, 6) AS null_ratio, whole, round(avg(r) OVER f, 6) AS window_ratio, count(*) OVER f = 5 AND avg(r) OVER f <= 0.40 AS keep FROM r WINDOW f AS {W} ROWS 4 PRECEDING)""")
def null_ratio_filters(spark: SparkSession, d: str) -> DataFrame:
    """Nulls among a row's features, rows without any, and windows of five whose mean share is at most 0.4."""
    b = _bars(spark, d)
    i = F.col("i")
    features = F.array(F.when(i % 3 != 0, F.col("open")), F.when(i % 7 >= 5, F.col("high")), F.when(i % 2 != 0, F.col("close")), F.col("low"))
    r = b.withColumn("r", F.size(F.filter(features, lambda v: v.isNull())) / F.size(features)).withColumn("whole", ~F.exists(features, lambda v: v.isNull()))
    f = I.frame(-4, 0)
    return r.select("symbol", "open_ms", R("r").alias("null_ratio"), "whole", R(F.avg("r").over(f)).alias("window_ratio"), ((F.count("*").over(f) == 5) & (F.avg("r").over(f) <= 0.40)).alias("keep"))


@query(f"""WITH {FOUR_SQL}{MODULES_SQL}, h AS (SELECT b.symbol, b.open_ms, lead(close, 3) OVER w / close - 1 AS r, year(make_timestamp(b.open_ms * 1000)) * 100 + week(make_timestamp(b.open_ms * 1000)) AS period, CAST(b.open_ms // 86400000 % 2 AS VARCHAR) AS regime FROM bars b WINDOW w AS (PARTITION BY b.symbol ORDER BY b.open_ms)),
e AS (SELECT module, event_type, period, regime, r FROM mev JOIN h USING (symbol, open_ms) WHERE r IS NOT NULL),
p AS (SELECT module, event_type, count(*) AS n, avg(r) AS mean FROM e GROUP BY ALL), g AS (SELECT module, event_type, regime, avg(r) AS m FROM e GROUP BY ALL)
SELECT p.module, p.event_type, p.n, round(p.mean, 6) AS mean, round(avg(CASE WHEN sign(g.m) = sign(p.mean) THEN 1.0 ELSE 0.0 END), 6) AS agreement, CASE WHEN p.mean > 0 THEN 'positive_mean' ELSE 'non_positive_mean' END AS class
FROM p JOIN g USING (module, event_type) GROUP BY p.module, p.event_type, p.n, p.mean""")
def stability_sign_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The share of regimes whose mean outcome has the sign of the pooled mean, and the sign class of each event type."""
    b = _bars(spark, d)
    h = b.select("symbol", "open_ms", (I.lead("close", 3) / F.col("close") - 1).alias("r"), F.expr("open_ms DIV 86400000 % 2").alias("regime")).where("r IS NOT NULL")
    e = modules.base_events(b).join(h, ["symbol", "open_ms"])
    g = e.groupBy("module", "event_type", "regime").agg(F.count("r").alias("n"), F.sum("r").alias("s"))
    whole = Window.partitionBy("module", "event_type")
    g = g.withColumn("mean", F.sum("s").over(whole) / F.sum("n").over(whole)).withColumn("same", F.when(F.signum(F.col("s") / F.col("n")) == F.signum("mean"), 1.0).otherwise(0.0))
    told = g.groupBy("module", "event_type").agg(F.sum("n").alias("n"), F.first("mean").alias("mean"), R(F.avg("same")).alias("agreement"))
    return told.select("module", "event_type", "n", R("mean").alias("mean"), "agreement", F.when(F.col("mean") > 0, "positive_mean").otherwise("non_positive_mean").alias("class"))


@query(f"""WITH {FOUR_SQL}{MODULES_SQL} SELECT row_number() OVER (ORDER BY symbol, open_ms, module, event_type) AS place, symbol, open_ms, module, event_type FROM mev QUALIFY place <= 200""")
def event_order(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 events in the declared order: a top-k report."""
    order = ["symbol", "open_ms", "module", "event_type"]
    top = modules.base_events(_bars(spark, d)).orderBy(*order).limit(200)
    return top.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"), *order)
