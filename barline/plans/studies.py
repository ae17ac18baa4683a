"""Queries on indicators, features, sessions and rules beyond those of series.py, over bars of four hours or daily prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.operators import indicators as I
from barline.operators import market, modules
from barline.sources.tables import DAILY_SQL, FOUR_SQL, HOUR, daily_prices, four_hourly, table

QUERIES, ORACLE_SQL = {}, {}
R = lambda c: F.round(c, 6)
#: As SQL rounds: the double times 1e6 decides, not its decimals (323 / 640, printed 0.5046875, lies below the half).
BINARY = lambda c: F.round(c * 1e6) / 1e6
W = "(PARTITION BY symbol ORDER BY open_ms"
D = "(PARTITION BY symbol ORDER BY day"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return modules.by_segment(four_hourly(spark, d), 4 * HOUR)


def _by_day() -> Window:
    return Window.partitionBy("symbol").orderBy("day")


_EMA = "CASE WHEN len({c}) >= {p} THEN list_reduce(list_concat([list_sum({c}[1:{p}]) / {p}], {c}[{p} + 1:]), lambda e, v: e + (v - e) * CAST(2 AS DOUBLE) / ({p} + 1)) END"


@query(f"""WITH {FOUR_SQL}, t AS (SELECT *, CASE WHEN i = 0 THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM bars WINDOW w AS {W})),
l AS (SELECT *, list(close) OVER w AS c, list(tr) OVER w AS r FROM t WINDOW w AS {W})),
e AS (SELECT *, {_EMA.format(c='c', p=12)} AS fast, {_EMA.format(c='c', p=26)} AS slow, CASE WHEN len(r) >= 15 THEN list_reduce(list_concat([list_sum(r[1:15]) / 15], r[16:]), lambda e, v: (e * 13 + v) / 14) END AS atr FROM l),
m AS (SELECT *, list(fast - slow) FILTER (slow IS NOT NULL) OVER {W}) AS ml FROM e), s AS (SELECT *, {_EMA.format(c='ml', p=9)} AS signal FROM m)
SELECT symbol, open_ms, round(fast - slow, 6) AS macd, round(signal, 6) AS signal, round(fast - slow - signal, 6) AS hist, round(atr, 6) AS atr, CASE WHEN atr > 0 THEN round((fast - slow) / atr, 6) END AS macd_atr, CASE WHEN atr > 0 THEN round((fast - slow - signal) / atr, 6) END AS hist_atr FROM s""")
def indicator_macd(spark: SparkSession, d: str) -> DataFrame:
    """Convergence of two seeded exponential means, its signal from the ninth value on, and both by Wilder's range."""
    b = _bars(spark, d).withColumn("tr", I.true_range())
    x = I.recurse_many(b, [("close", "fast", I.smoothed(12, 12, True)), ("close", "slow", I.smoothed(26, 26, True)), ("tr", "atr", I.smoothed(15, 14, False))])
    x = x.withColumn("macd", F.col("fast") - F.col("slow"))
    x = I.recurse(x, "macd", "signal", I.smoothed(9, 9, True))
    hist = F.col("macd") - F.col("signal")
    by = lambda v: R(F.when(F.col("atr") > 0, v / F.col("atr")))
    return x.select("symbol", "open_ms", R("macd").alias("macd"), R("signal").alias("signal"), R(hist).alias("hist"), R("atr").alias("atr"), by(F.col("macd")).alias("macd_atr"), by(hist).alias("hist_atr"))


_STATE = "{{'k': {k}, 't': {t}, 'p': {p}, 'm': {m}, 'n': {n}, 's': {s}, 'et': {et}, 'ep': {ep}, 'em': {em}}}"


@query(f"""WITH {FOUR_SQL}, d AS (SELECT *, high - lag(high) OVER w AS up, lag(low) OVER w - low AS down, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS {W})),
l AS (SELECT symbol, open_ms, i, list_slice(list({_STATE.format(k=0, t='CAST(0 AS DOUBLE)', p='CAST(0 AS DOUBLE)', m='CAST(0 AS DOUBLE)', n=0, s='CAST(0 AS DOUBLE)', et='tr', ep='CASE WHEN up > down AND up > 0 THEN up ELSE 0 END', em='CASE WHEN down > up AND down > 0 THEN down ELSE 0 END')}) FILTER (up IS NOT NULL) OVER {W}), -least(41, i), -1) AS es FROM d),
g AS (SELECT symbol, open_ms, i, list_reduce(list_concat([{_STATE.format(k=0, t='CAST(0 AS DOUBLE)', p='CAST(0 AS DOUBLE)', m='CAST(0 AS DOUBLE)', n=0, s='CAST(0 AS DOUBLE)', et='CAST(0 AS DOUBLE)', ep='CAST(0 AS DOUBLE)', em='CAST(0 AS DOUBLE)')}], es),
  lambda a, e: {_STATE.format(k='a.k + 1', t='CASE WHEN a.k < 14 THEN a.t + e.et ELSE a.t - a.t / 14 + e.et END', p='CASE WHEN a.k < 14 THEN a.p + e.ep ELSE a.p - a.p / 14 + e.ep END', m='CASE WHEN a.k < 14 THEN a.m + e.em ELSE a.m - a.m / 14 + e.em END', n='a.n', s='a.s', et='CAST(0 AS DOUBLE)', ep='CAST(0 AS DOUBLE)', em='CAST(0 AS DOUBLE)')}) AS last FROM l WHERE i >= 27)
SELECT symbol, open_ms, round(100 * last.p / greatest(last.t, 1e-9), 6) AS plus_di, round(100 * last.m / greatest(last.t, 1e-9), 6) AS minus_di FROM g""")
def indicator_directional(spark: SparkSession, d: str) -> DataFrame:
    """Both directional indicators by Wilder sums over the last 42 bars."""
    b = _bars(spark, d)
    w = I.frame(-41, 0)
    x = b.withColumn("up", F.col("high") - I.lag("high")).withColumn("down", I.lag("low") - F.col("low")).withColumn("tr", I.true_range())
    x = x.withColumn("n", F.count("*").over(w))
    each = F.collect_list(F.struct(F.col("tr").alias("t"), F.when((F.col("up") > F.col("down")) & (F.col("up") > 0), F.col("up")).otherwise(0.0).alias("p"), F.when((F.col("down") > F.col("up")) & (F.col("down") > 0), F.col("down")).otherwise(0.0).alias("m"))).over(w)
    x = x.withColumn("each", F.slice(each, 2, 41)).where("n >= 28")
    zero = F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("t"), F.lit(0.0).alias("p"), F.lit(0.0).alias("m"))
    take = lambda a, e: F.struct((a["k"] + 1).alias("k"), *[F.when(a["k"] < 14, a[c] + e[c]).otherwise(a[c] - a[c] / 14 + e[c]).alias(c) for c in "tpm"])
    x = x.withColumn("last", F.aggregate("each", zero, take))
    di = lambda c: R(100 * F.col(f"last.{c}") / F.greatest(F.col("last.t"), F.lit(1e-9)))
    return x.select("symbol", "open_ms", di("p").alias("plus_di"), di("m").alias("minus_di"))


def indicator_adx(spark: SparkSession, d: str) -> DataFrame:
    """The directional index over the last 42 bars; tested against plain Python."""
    return _bars(spark, d).select("symbol", "open_ms", R(I.adx()).alias("adx"))


QUERIES["indicator_adx"] = indicator_adx


@query(f"""WITH {FOUR_SQL}, t AS (SELECT *, CASE WHEN i = 0 THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM bars WINDOW w AS {W})), l AS (SELECT *, list(tr) OVER {W}) AS r FROM t)
SELECT symbol, open_ms, CASE WHEN i >= 14 THEN round(list_reduce(list_concat([list_sum(r[1:15]) / 15], r[16:]), lambda e, v: (e * 13 + v) / 14), 6) END AS wilder, CASE WHEN i >= 14 THEN round(list_avg(r[-14:]), 6) END AS mean14,
  round(list_avg(r[-least(14, len(r)):]), 6) AS expanding14, CASE WHEN i >= 13 THEN round(avg(tr / close) OVER {W} ROWS 13 PRECEDING) * 100, 6) END AS percent14 FROM l""")
def indicator_atr_forms(spark: SparkSession, d: str) -> DataFrame:
    """Four forms of the average range: Wilder's from 15 values, the mean of 14 ranges with a bar before, as many as there
    are up to 14, and as a percentage of the close."""
    b = _bars(spark, d).withColumn("tr", I.true_range()).withColumn("ratio", F.col("tr") / F.col("close"))
    x = I.recurse(b, "tr", "wilder", I.smoothed(15, 14, False))
    f = I.frame(-13, 0)
    return x.select("symbol", "open_ms", R("wilder").alias("wilder"), R(F.when(F.col("i") >= 14, F.avg("tr").over(f))).alias("mean14"), R(F.avg("tr").over(f)).alias("expanding14"), R(F.when(F.col("i") >= 13, F.avg("ratio").over(f) * 100)).alias("percent14"))


@query(f"""WITH {FOUR_SQL}, q AS (SELECT symbol, open_ms, i, CASE WHEN i % 50 < 20 THEN 100 ELSE floor(close) END AS p FROM bars), dl AS (SELECT *, p - lag(p) OVER {W}) AS dp FROM q),
l AS (SELECT symbol, open_ms, i, list(CASE WHEN dp > 0 THEN dp ELSE CAST(0 AS DOUBLE) END) FILTER (dp IS NOT NULL) OVER {W}) AS g, list(CASE WHEN dp < 0 THEN -dp ELSE CAST(0 AS DOUBLE) END) FILTER (dp IS NOT NULL) OVER {W}) AS s FROM dl),
a AS (SELECT symbol, open_ms, list_reduce(list_concat([list_sum(g[1:14]) / 14], g[15:]), lambda e, v: (e * 13 + v) / 14) AS sg, list_reduce(list_concat([list_sum(s[1:14]) / 14], s[15:]), lambda e, v: (e * 13 + v) / 14) AS sl,
  list_reduce(list_concat([(list_sum(g[1:14]) / 14 + g[14]) / 14], g[15:]), lambda e, v: (e * 13 + v) / 14) AS bg, list_reduce(list_concat([(list_sum(s[1:14]) / 14 + s[14]) / 14], s[15:]), lambda e, v: (e * 13 + v) / 14) AS bl FROM l WHERE i >= 14)
SELECT symbol, open_ms, round(CASE WHEN bl = 0 THEN 100 ELSE 100 - 100 / (1 + bg / bl) END, 6) AS backend, round(CASE WHEN sl = 0 AND sg = 0 THEN 50 WHEN sl = 0 THEN 100 ELSE 100 - 100 / (1 + sg / sl) END, 6) AS flat50 FROM a""")
def indicator_rsi_forms(spark: SparkSession, d: str) -> DataFrame:
    """The stored indicators' form, whose seed counts its last change twice, and the one that gives 50 when flat; over a
    price that stands still at times."""
    b = _bars(spark, d).withColumn("p", F.when(F.col("i") % 50 < 20, 100.0).otherwise(F.floor("close").cast("double")))
    x = I.recurse_many(b, [("p", "backend", I.wilder_index(14, True)), ("p", "flat50", I.wilder_index(14, False, 50.0))])
    return x.where("i >= 14").select("symbol", "open_ms", R("backend").alias("backend"), R("flat50").alias("flat50"))


@query(f"""WITH {FOUR_SQL}, x AS (SELECT *, lag(close) OVER w AS c1, lag(close, 4) OVER w AS c4, lag(close, 6) OVER w AS c6, avg(close) OVER s AS m, count(*) OVER s AS n FROM bars WINDOW w AS {W}), s AS {W} ROWS 19 PRECEDING)),
y AS (SELECT *, lag(m, 5) OVER {W}) AS m5, lag(n, 5) OVER {W}) AS n5 FROM x)
SELECT symbol, open_ms, CASE WHEN c1 <> 0 THEN round((close - c1) / c1 * 100, 6) END AS r1, CASE WHEN c4 <> 0 THEN round((close - c4) / c4 * 100, 6) END AS r4, CASE WHEN c6 <> 0 THEN round((close - c6) / c6 * 100, 6) END AS r_day,
  CASE WHEN n = 20 AND n5 = 20 THEN round((m - m5) / 5, 6) END AS slope, CASE WHEN n = 20 AND m <> 0 THEN round((close - m) / m * 100, 6) END AS distance, CASE WHEN volume > 0 THEN round(quote / volume, 6) END AS taker FROM y""")
def feature_lags_slopes(spark: SparkSession, d: str) -> DataFrame:
    """Returns over one, four and a day's bars in percent, the slope of the mean, the distance to it, quote by volume."""
    x = _bars(spark, d).withColumn("m", I.sma("close", 20))
    back = lambda n: R(F.when(I.lag("close", n) != 0, (F.col("close") - I.lag("close", n)) / I.lag("close", n) * 100))
    return x.select("symbol", "open_ms", back(1).alias("r1"), back(4).alias("r4"), back(6).alias("r_day"), R((F.col("m") - I.lag("m", 5)) / 5).alias("slope"), R(F.when(F.col("m") != 0, (F.col("close") - F.col("m")) / F.col("m") * 100)).alias("distance"), R(F.when(F.col("volume") > 0, F.col("quote") / F.col("volume"))).alias("taker"))


@query(f"""WITH {FOUR_SQL}, x AS (SELECT symbol, open_ms, i, close, CASE WHEN i % 4 = 3 THEN NULL ELSE volume END AS oi FROM bars),
z AS (SELECT *, count(*) OVER p AS n, avg(close) OVER p AS m, stddev_pop(close) OVER p AS s, last_value(oi IGNORE NULLS) OVER u AS before FROM x WINDOW p AS {W} ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING), u AS {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT symbol, open_ms, CASE WHEN n >= 30 AND s > 0 THEN round((close - m) / s, 6) END AS funding_z, CAST(CASE WHEN oi IS NULL OR before IS NULL THEN 0 ELSE oi - before END AS BIGINT) AS oi_change FROM z""")
def funding_z_and_interest(spark: SparkSession, d: str) -> DataFrame:
    """A rate against the (up to) 90 before it, from 30 on; the change of an interest against the last one that was known."""
    x = _bars(spark, d).withColumn("oi", F.when(F.col("i") % 4 != 3, F.col("volume")))
    p = I.frame(-90, -1)
    z = F.when((F.count("*").over(p) >= 30) & (F.stddev_pop("close").over(p) > 0), (F.col("close") - F.avg("close").over(p)) / F.stddev_pop("close").over(p))
    before = F.last("oi", True).over(I.frame(Window.unboundedPreceding, -1))
    return x.select("symbol", "open_ms", R(z).alias("funding_z"), F.coalesce(F.col("oi") - before, F.lit(0)).cast("long").alias("oi_change"))


@query(f"""WITH {FOUR_SQL}, n0 AS (SELECT *, avg(close) OVER {W} ROWS 49 PRECEDING) AS sma50, count(*) OVER {W} ROWS 49 PRECEDING) AS n, CASE WHEN i > 0 THEN close - lag(close) OVER {W}) END AS dc FROM bars),
n1 AS (SELECT *, avg(CASE WHEN dc > 0 THEN dc ELSE 0 END) OVER w AS g, avg(CASE WHEN dc < 0 THEN -dc ELSE 0 END) OVER w AS l, count(dc) OVER w AS nd FROM n0 WINDOW w AS {W} ROWS 13 PRECEDING))
SELECT symbol, open_ms, CASE WHEN n < 50 THEN 'UNKNOWN' WHEN close > sma50 THEN 'ABOVE' WHEN close < sma50 THEN 'BELOW' ELSE 'AT' END AS sma50, CASE WHEN nd < 14 THEN 'UNKNOWN' WHEN l = 0 OR 100 - 100 / (1 + g / l) > 70 THEN 'OVERBOUGHT' WHEN 100 - 100 / (1 + g / l) < 30 THEN 'OVERSOLD' ELSE 'NEUTRAL' END AS rsi
FROM n1 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_ms DESC) = 1""")
def current_conditions(spark: SparkSession, d: str) -> DataFrame:
    """How each run of bars stands at its last close."""
    x = I.rsi_simple(_bars(spark, d)).withColumn("m", I.sma("close", 50))
    side = F.when(F.col("m").isNull(), "UNKNOWN").when(F.col("close") > F.col("m"), "ABOVE").when(F.col("close") < F.col("m"), "BELOW").otherwise("AT")
    band = F.when(F.col("rsi").isNull(), "UNKNOWN").when(F.col("rsi") > 70, "OVERBOUGHT").when(F.col("rsi") < 30, "OVERSOLD").otherwise("NEUTRAL")
    last = F.max_by(F.struct(side.alias("sma50"), band.alias("rsi")), "open_ms")
    return x.groupBy("symbol").agg(F.max("open_ms").alias("open_ms"), last.alias("s")).select("symbol", "open_ms", "s.sma50", "s.rsi")


@query(f"""WITH {FOUR_SQL}, t AS (SELECT *, epoch_ms(open_ms) AS ts FROM bars) SELECT symbol, open_ms, round(sin(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24), 6) AS hour_sin, round(cos(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24), 6) AS hour_cos,
  CAST(CAST(ts + INTERVAL 7 HOUR AS DATE) AS VARCHAR) AS local_session, CAST(hour(ts + INTERVAL 7 HOUR) AS INTEGER) < 12 AS morning FROM t""")
def time_parts_local(spark: SparkSession, d: str) -> DataFrame:
    """The fractional hour as an angle, and the local session seven hours ahead."""
    minutes = F.expr("open_ms DIV 60000 % 1440")
    turn = 2 * F.pi() * (minutes / 60.0) / 24
    local = F.col("open_ms") + 7 * HOUR
    return _bars(spark, d).select("symbol", "open_ms", R(F.sin(turn)).alias("hour_sin"), R(F.cos(turn)).alias("hour_cos"), F.date_add(F.lit("1970-01-01").cast("date"), F.floor(local / 86400000).cast("int")).cast("string").alias("local_session"), (F.floor(local / HOUR) % 24 < 12).alias("morning"))


@query(f"""WITH {FOUR_SQL}, s AS (SELECT *, CAST(epoch_ms(open_ms) AS DATE) AS day, CASE WHEN hour(epoch_ms(open_ms)) < 12 THEN 'morning' ELSE 'afternoon' END AS block FROM bars)
SELECT symbol, day, block, arg_min(open, open_ms) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_ms) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS n_bars FROM s GROUP BY symbol, day, block""")
def half_session_bars(spark: SparkSession, d: str) -> DataFrame:
    b = _bars(spark, d).withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.expr("cast(open_ms DIV 86400000 AS int)"))).withColumn("block", F.when(F.expr("open_ms DIV 3600000 % 24") < 12, "morning").otherwise("afternoon"))
    return b.groupBy("symbol", "day", "block").agg(F.min_by("open", "open_ms").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_ms").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n_bars"))


_SPARSE = """x AS (SELECT n_name AS symbol, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS close, min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS volume FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)"""


def _sparse(spark: SparkSession, d: str) -> DataFrame:
    """(symbol, day, close, low, high, volume): by nation and day of orders; most nations miss days."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    both = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return both.groupBy(F.col("n_name").alias("symbol"), F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("close"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.count("*").alias("volume"))


def _sessions(x: DataFrame) -> DataFrame:
    """(day, session): the market's days, numbered; as many rows as days."""
    return x.select("day").distinct().withColumn("session", F.row_number().over(Window.orderBy("day")).cast("long"))


@query(f"""WITH {_SPARSE}, s AS (SELECT day, row_number() OVER (ORDER BY day) AS session FROM (SELECT DISTINCT day FROM x)), g AS (SELECT symbol, day, session, session - lag(session) OVER {D}) - 1 AS missed FROM x JOIN s USING (day))
SELECT symbol, day, CAST(session AS BIGINT) AS session, CAST(missed AS BIGINT) AS missed FROM g WHERE missed > 5""")
def suspensions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of the market that a symbol missed before it traded again, if more than five."""
    x = _sparse(spark, d)
    g = x.join(_sessions(x), "day").withColumn("missed", F.col("session") - F.lag("session").over(_by_day()) - 1)
    return g.where("missed > 5").select("symbol", "day", "session", "missed")


@query(f"""WITH {_SPARSE}, r AS (SELECT symbol, day, 1 + CAST(floor(close / 50000) AS BIGINT) % 3 AS ratio FROM x), n AS (SELECT *, lag(ratio) OVER w AS before, lead(ratio) OVER w AS after FROM r WINDOW w AS {D}))
SELECT symbol, day, ratio, before, coalesce(after = before, false) AS transient FROM n WHERE abs(ratio / before - 1) > 0.01""")
def adjustment_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of an adjustment ratio; one that goes back the next day is transient."""
    r = _sparse(spark, d).withColumn("ratio", 1 + F.floor(F.col("close") / 50000) % 3)
    n = r.withColumn("before", F.lag("ratio").over(_by_day())).withColumn("after", F.lead("ratio").over(_by_day()))
    return n.where(F.abs(F.col("ratio") / F.col("before") - 1) > 0.01).select("symbol", "day", "ratio", "before", F.coalesce(F.col("after") == F.col("before"), F.lit(False)).alias("transient"))


_TICK = "CASE WHEN {p} < 10000 THEN 10 WHEN {p} < 50000 THEN 50 ELSE 100 END"


@query(f"""WITH p AS (SELECT o_orderkey, o_totalprice AS price, o_custkey FROM orders), t AS (SELECT *, {_TICK.format(p='price')} AS tick, price * 1.07 AS hi, price * 0.93 AS lo FROM p),
l AS (SELECT *, {_TICK.format(p='hi')} AS ht, {_TICK.format(p='lo')} AS lt FROM t)
SELECT o_orderkey, CAST(tick AS INTEGER) AS tick, CAST(floor(hi / ht) * ht AS BIGINT) AS ceiling, CAST(ceil(lo / lt) * lt AS BIGINT) AS floor_, CAST(floor(10000000 / (price * 1.0015) / 100) * 100 AS BIGINT) AS lots,
  round(least(0.25, greatest(0.05, 0.25 * ((o_custkey % 10) / 10.0 - (1 - (o_custkey % 10) / 10.0) / 2.0))), 6) AS kelly, round(price * (1 - 1 / CAST(50 AS DOUBLE) + CAST(0.005 AS DOUBLE)), 1) AS long_liquidation, round(price * (1 + 1 / CAST(50 AS DOUBLE) - CAST(0.005 AS DOUBLE)), 1) AS short_liquidation FROM l""")
def price_rules(spark: SparkSession, d: str) -> DataFrame:
    """Ticks, price limits rounded inwards, whole lots, quarter-Kelly sizes and liquidation prices of each order's price."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), "o_custkey")
    price, win = F.col("price"), (F.col("o_custkey") % 10) / 10.0
    low, high = market.limits(price)
    return o.select("o_orderkey", market.tick(price).alias("tick"), high.cast("long").alias("ceiling"), low.cast("long").alias("floor_"), market.lots(F.lit(10000000.0), price).cast("long").alias("lots"), R(market.kelly(win, F.lit(2.0))).alias("kelly"),
        F.round(market.liquidation(price, 50, 0.005, 1), 1).alias("long_liquidation"), F.round(market.liquidation(price, 50, 0.005, -1), 1).alias("short_liquidation"))


@query(f"""WITH {_SPARSE}, c AS (SELECT symbol, day, low, high, list_filter([lag(close) OVER w, lag(close, 2) OVER w, (low + high) / 2], lambda v: v IS NOT NULL) AS cands FROM x WINDOW w AS {D}))
SELECT symbol, day, round(list_filter(cands, lambda v: low >= 0.5 * v AND high <= 1.5 * v)[1], 4) AS reference, CAST(len(list_filter(cands, lambda v: low >= 0.5 * v AND high <= 1.5 * v)) AS INTEGER) AS fits FROM c""")
def reference_price(spark: SparkSession, d: str) -> DataFrame:
    """The first of a day's candidates whose limits hold the day's range."""
    w = _by_day()
    c = _sparse(spark, d).withColumn("cands", F.filter(F.array(F.lag("close").over(w), F.lag("close", 2).over(w), (F.col("low") + F.col("high")) / 2), lambda v: v.isNotNull()))
    fits = F.filter("cands", lambda v: (F.col("low") >= 0.5 * v) & (F.col("high") <= 1.5 * v))
    return c.select("symbol", "day", F.round(F.get(fits, F.lit(0)), 4).alias("reference"), F.size(fits).alias("fits"))


@query(f"""WITH {_SPARSE}, s AS (SELECT day, row_number() OVER (ORDER BY day) AS session FROM (SELECT DISTINCT day FROM x))
SELECT o.o_orderkey, CAST(t.day AS VARCHAR) AS settles, CAST(date_trunc('month', o.o_orderdate) + INTERVAL 14 DAY + ((11 - dayofweek(CAST(date_trunc('month', o.o_orderdate) + INTERVAL 14 DAY AS DATE))) % 7) * INTERVAL 1 DAY AS DATE) AS third_thursday,
  'Q' || quarter(o.o_orderdate) || '/' || year(o.o_orderdate) AS period, CAST(last_day(date_trunc('quarter', o.o_orderdate) + INTERVAL 2 MONTH) AS DATE) AS period_end FROM orders o JOIN s a ON a.day = CAST(o.o_orderdate AS DATE) LEFT JOIN s t ON t.session = a.session + 2""")
def calendar_rules(spark: SparkSession, d: str) -> DataFrame:
    """Settlement two sessions on, the month's third Thursday, the reporting quarter and its end."""
    s = _sessions(_sparse(spark, d))
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")).join(s, "day")
    later = s.select((F.col("session") - 2).alias("session"), F.col("day").alias("settles"))
    x = o.join(later, "session", "left")
    third = F.date_add(F.next_day(F.date_sub(F.trunc("day", "month"), 1), "Thu"), 14)
    return x.select("o_orderkey", F.col("settles").cast("string").alias("settles"), third.alias("third_thursday"), F.concat(F.lit("Q"), F.quarter("day"), F.lit("/"), F.year("day")).alias("period"), F.last_day(F.add_months(F.trunc("day", "quarter"), 2)).alias("period_end"))


@query(f"""WITH {DAILY_SQL}, r AS (SELECT *, close / lag(close) OVER {D}) - 1 AS r, avg(close) OVER {D} ROWS 199 PRECEDING) AS ma, count(*) OVER {D} ROWS 199 PRECEDING) AS n FROM daily),
v AS (SELECT *, stddev_samp(r) OVER {D} ROWS 59 PRECEDING) AS sd, count(r) OVER {D} ROWS 59 PRECEDING) AS nr FROM r)
SELECT symbol, day, CAST(CASE WHEN n = 200 THEN CASE WHEN close > ma THEN 1 ELSE 0 END END AS DOUBLE) AS trend_exposure, CASE WHEN nr = 60 AND sd > 0 THEN round(least(1.0, 0.15 / (sd * sqrt(252))), 6) END AS vol_exposure FROM v""")
def exposure_overlays(spark: SparkSession, d: str) -> DataFrame:
    """Exposure from 0 to 1: over the mean of 200 sessions or not, and what brings 60 sessions' volatility to 15 %."""
    w = _by_day()
    r = daily_prices(spark, d).withColumn("r", F.col("close") / F.lag("close").over(w) - 1)
    n, v = w.rowsBetween(-199, 0), w.rowsBetween(-59, 0)
    sd = F.stddev_samp("r").over(v)
    return r.select("symbol", "day", F.when(F.count("*").over(n) == 200, F.when(F.col("close") > F.avg("close").over(n), 1.0).otherwise(0.0)).alias("trend_exposure"), F.when((F.count("r").over(v) == 60) & (sd > 0), R(F.least(F.lit(1.0), 0.15 / (sd * F.sqrt(F.lit(252.0)))))).alias("vol_exposure"))


@query(f"""WITH {DAILY_SQL}, s AS (SELECT *, row_number() OVER {D}) AS i, lead(close, 21) OVER {D}) / lead(close) OVER {D}) - 1 AS fwd FROM daily), m AS (SELECT *, avg(fwd) OVER (PARTITION BY day) AS market FROM s WHERE fwd IS NOT NULL)
SELECT symbol, day, round(fwd - market, 6) AS target, CASE WHEN i < 1200 THEN 'train' WHEN i >= 1221 AND i < 1800 THEN 'test' WHEN i >= 1821 THEN 'holdout' ELSE 'purged' END AS split FROM m""")
def panel_targets_purged_split(spark: SparkSession, d: str) -> DataFrame:
    """Return from the next session's price over 20 sessions less the members' mean; train, test and holdout with a purge
    of 21 sessions between them."""
    w = _by_day()
    s = daily_prices(spark, d).withColumn("i", F.row_number().over(w)).withColumn("fwd", F.lead("close", 21).over(w) / F.lead("close").over(w) - 1).where("fwd IS NOT NULL")
    i = F.col("i")
    split = F.when(i < 1200, "train").when((i >= 1221) & (i < 1800), "test").when(i >= 1821, "holdout").otherwise("purged")
    return s.select("symbol", "day", R(F.col("fwd") - F.avg("fwd").over(Window.partitionBy("day"))).alias("target"), split.alias("split"))


@query(f"""WITH {DAILY_SQL}, s AS (SELECT *, row_number() OVER {D}) - 1 AS i FROM daily), g AS (SELECT CAST(unnest(range(0, 60)) AS BIGINT) AS fold)
SELECT symbol, fold, count(*) FILTER (i < 500 + 120 * fold) AS fit, count(*) FILTER (i >= 500 + 120 * fold AND i < 620 + 120 * fold) AS calibration, count(*) FILTER (i >= 620 + 120 * fold AND i < 740 + 120 * fold) AS test
FROM s, g GROUP BY symbol, fold HAVING count(*) FILTER (i >= 620 + 120 * fold AND i < 740 + 120 * fold) = 120""")
def fixed_folds(spark: SparkSession, d: str) -> DataFrame:
    """Expanding fits from 500 rows on, 120 to calibrate, 120 to test, one step further each time: only whole folds. Rows
    are counted by step first, so that the folds meet as many rows as there are steps."""
    s = daily_prices(spark, d).withColumn("i", F.row_number().over(_by_day()) - 1)
    n = s.groupBy("symbol").agg(F.max("i").alias("last"))
    folds = n.withColumn("fold", F.explode(F.expr("sequence(0L, cast(greatest(0, (last - 739) DIV 120) AS long))"))).where("740 + 120 * fold <= last + 1")
    return folds.select("symbol", "fold", (500 + 120 * F.col("fold")).alias("fit"), F.lit(120).cast("long").alias("calibration"), F.lit(120).cast("long").alias("test"))


@query(f"""WITH {DAILY_SQL}, r AS (SELECT symbol, row_number() OVER {D}) AS i, close / lag(close) OVER {D}) - 1 AS r FROM daily), v AS (SELECT * FROM r WHERE r IS NOT NULL), m AS (SELECT symbol, avg(r) AS m, count(*) AS n, sum((r - a) * (r - a)) AS c0 FROM (SELECT *, avg(r) OVER (PARTITION BY symbol) AS a FROM v) GROUP BY symbol),
k AS (SELECT a.symbol, b.i - a.i AS lag, sum((a.r - m) * (b.r - m)) / any_value(c0) AS rho FROM v a JOIN v b ON a.symbol = b.symbol AND b.i - a.i BETWEEN 1 AND 20 JOIN m ON m.symbol = a.symbol GROUP BY ALL),
f AS (SELECT symbol, min(lag) FILTER (rho <= 0) AS stop FROM k GROUP BY symbol)
SELECT m.symbol, m.n, round(least(m.n, greatest(1, m.n / (1 + 2 * coalesce((SELECT sum(rho) FROM k WHERE k.symbol = m.symbol AND lag < coalesce(f.stop, 21)), 0)))), 4) AS effective FROM m JOIN f USING (symbol)""")
def effective_sample_size(spark: SparkSession, d: str) -> DataFrame:
    """n over one and twice the sum of autocorrelations up to the first that is not positive, of at most 20; from 1 to n."""
    w = _by_day()
    r = daily_prices(spark, d).withColumn("r", F.col("close") / F.lag("close").over(w) - 1).where("r IS NOT NULL")
    r = r.withColumn("c", F.col("r") - F.avg("r").over(Window.partitionBy("symbol")))
    for k in range(1, 21):
        r = r.withColumn(f"p{k}", F.col("c") * F.lead("c", k).over(w))
    s = r.groupBy("symbol").agg(F.count("*").alias("n"), F.array(*[F.sum(f"p{k}") / F.sum(F.col("c") * F.col("c")) for k in range(1, 21)]).alias("rho"))
    kept = F.aggregate("rho", F.struct(F.lit(0.0).alias("s"), F.lit(True).alias("go")), lambda a, x: F.struct(F.when(a["go"] & (x > 0), a["s"] + x).otherwise(a["s"]).alias("s"), (a["go"] & (x > 0)).alias("go")))
    return s.select("symbol", "n", F.round(F.least(F.col("n").cast("double"), F.greatest(F.lit(1.0), F.col("n") / (1 + 2 * kept["s"]))), 4).alias("effective"))


@query(f"""WITH {DAILY_SQL}, x AS (SELECT *, lead(close) OVER {D}) AS entry, avg(close) OVER {D} ROWS 19 PRECEDING) AS m, row_number() OVER {D}) AS i FROM daily),
g AS (SELECT cost, delay FROM (SELECT unnest([0.0, 0.0015, 0.003]) AS cost), (SELECT unnest([0, 1]) AS delay)),
t AS (SELECT cost, delay, symbol, CASE WHEN close > m THEN 1 ELSE -1 END * ((lead(close, 6) OVER w) / CASE WHEN delay = 0 THEN lead(close) OVER w ELSE lead(close, 2) OVER w END - 1) - 2 * cost AS r, i FROM x, g WINDOW w AS (PARTITION BY symbol, cost, delay ORDER BY day))
SELECT CAST(cost AS DOUBLE) AS cost, CAST(delay AS INTEGER) AS delay, count(r) AS trades, round(avg(r), 6) AS mean, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) FILTER (r IS NOT NULL), 6) AS wins,
  round(avg(r) / sqrt(avg(CASE WHEN r < 0 THEN r * r ELSE 0 END) FILTER (r IS NOT NULL)), 6) AS sortino, round(sum(greatest(r, 0)) FILTER (r IS NOT NULL) / -sum(least(r, 0)) FILTER (r IS NOT NULL), 6) AS profit_factor FROM t WHERE i % 6 = 0 GROUP BY cost, delay""")
def stress_grid(spark: SparkSession, d: str) -> DataFrame:
    """A trend rule that holds five sessions, under three costs and two delays of the entry: the prices are read once."""
    w = _by_day()
    x = daily_prices(spark, d).withColumn("i", F.row_number().over(w)).withColumn("side", F.when(F.col("close") > F.avg("close").over(w.rowsBetween(-19, 0)), 1).otherwise(-1))
    grid = F.array(*[F.struct(F.lit(c).alias("cost"), F.lit(k).alias("delay")) for c in (0.0, 0.0015, 0.003) for k in (0, 1)])
    x = x.withColumn("leave", F.lead("close", 6).over(w)).withColumn("e0", F.lead("close").over(w)).withColumn("e1", F.lead("close", 2).over(w)).where("i % 6 = 0").withColumn("g", F.explode(grid))
    r = x.select("g.*", (F.col("side") * (F.col("leave") / F.when(F.col("g.delay") == 0, F.col("e0")).otherwise(F.col("e1")) - 1) - 2 * F.col("g.cost")).alias("r")).where("r IS NOT NULL")
    return r.groupBy("cost", "delay").agg(F.count("r").alias("trades"), R(F.avg("r")).alias("mean"), R(F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0))).alias("wins"), R(F.avg("r") / F.sqrt(F.avg(F.when(F.col("r") < 0, F.col("r") * F.col("r")).otherwise(0.0)))).alias("sortino"), R(F.sum(F.greatest("r", F.lit(0.0))) / -F.sum(F.least("r", F.lit(0.0)))).alias("profit_factor"))


@query(f"""WITH {DAILY_SQL}, x AS (SELECT *, avg(close) OVER {D} ROWS 19 PRECEDING) AS m20, avg(close) OVER {D} ROWS 49 PRECEDING) AS m50, count(*) OVER {D} ROWS 49 PRECEDING) AS n, lag(close, 5) OVER {D}) AS c5 FROM daily),
s AS (SELECT symbol, day, CASE WHEN n < 50 THEN 'unknown' WHEN close > m20 AND m20 > m50 THEN 'bull' WHEN close < m20 AND m20 < m50 THEN 'bear' ELSE 'range' END AS regime, CASE WHEN c5 > 0 THEN close / c5 - 1 END AS mom FROM x)
SELECT symbol, day, regime, round(0.6 * CASE regime WHEN 'bull' THEN 1 WHEN 'bear' THEN -1 ELSE 0 END + 0.4 * tanh(10 * coalesce(mom, 0)), 6) AS score FROM s""")
def rule_blend(spark: SparkSession, d: str) -> DataFrame:
    """Regime by two means and five-session momentum as one weighted score."""
    w = _by_day()
    c, n = F.col("close"), w.rowsBetween(-49, 0)
    x = daily_prices(spark, d).withColumn("m20", F.avg(c).over(w.rowsBetween(-19, 0))).withColumn("m50", F.avg(c).over(n)).withColumn("n", F.count("*").over(n)).withColumn("c5", F.lag(c, 5).over(w))
    regime = F.when(F.col("n") < 50, "unknown").when((c > F.col("m20")) & (F.col("m20") > F.col("m50")), "bull").when((c < F.col("m20")) & (F.col("m20") < F.col("m50")), "bear").otherwise("range")
    way = F.when(regime == "bull", 1).when(regime == "bear", -1).otherwise(0)
    return x.select("symbol", "day", regime.alias("regime"), R(0.6 * way + 0.4 * F.tanh(10 * F.coalesce(F.when(F.col("c5") > 0, c / F.col("c5") - 1), F.lit(0.0)))).alias("score"))


@query(f"""WITH {DAILY_SQL}, l AS (SELECT *, CASE WHEN lead(close, 4) OVER {D}) > close THEN 1 ELSE 0 END AS up, lead(close, 4) OVER {D}) AS c4, row_number() OVER {D}) AS i FROM daily),
k AS (SELECT symbol, day, i, CAST(sum(up) OVER e AS DOUBLE) AS s, count(up) OVER e AS n, avg(up) OVER f AS recent FROM l WINDOW e AS {D} ROWS BETWEEN UNBOUNDED PRECEDING AND 4 PRECEDING), f AS {D} ROWS BETWEEN 53 PRECEDING AND 4 PRECEDING))
SELECT symbol, day, round((s + 1) / (n + 2), 6) AS expanding, round(recent, 6) AS last50, CAST(CASE WHEN s / n > 0.5 THEN 0.8 WHEN s / n < 0.5 THEN 0.2 ELSE 0.5 END AS DOUBLE) AS majority FROM k WHERE n > 0""")
def baseline_forecasts(spark: SparkSession, d: str) -> DataFrame:
    """The chance of a rise by all labels known, by the last fifty of them, and by their majority."""
    w = _by_day()
    up = F.when(F.lead("close", 4).over(w) > F.col("close"), 1.0).otherwise(0.0)
    l = daily_prices(spark, d).withColumn("up", up)
    e, f = w.rowsBetween(Window.unboundedPreceding, -4), w.rowsBetween(-53, -4)
    k = l.withColumn("s", F.sum("up").over(e)).withColumn("n", F.count("up").over(e)).withColumn("recent", F.avg("up").over(f)).where("n > 0")
    prior = F.col("s") / F.col("n")
    return k.select("symbol", "day", BINARY((F.col("s") + 1) / (F.col("n") + 2)).alias("expanding"), BINARY(F.col("recent")).alias("last50"), F.when(prior > 0.5, 0.8).when(prior < 0.5, 0.2).otherwise(0.5).alias("majority"))
