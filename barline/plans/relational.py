"""Queries on joins, aggregates, statistics and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions import text
from barline.operators import events, joins, search, stats
from barline.operators import indicators as I
from barline.plans.series import EVENTS_SQL, HORIZON_SQL
from barline.sources.tables import DAILY_SQL, HOUR, HOURLY_SQL, daily_prices, hourly, millis, table

QUERIES, ORACLE_SQL = {}, {}
R = lambda c: F.round(c, 6)
W = "(PARTITION BY symbol ORDER BY open_ms"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return daily_prices(spark, d)


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey % 5 AS kind, (epoch_us(o_orderdate) // 1000) % 2592000000 + 1704067200000 AS t FROM orders),
e AS (SELECT event_id, user_id % 5 AS kind, (epoch_us(ts) // 1000) AS t, value FROM events),
r AS (SELECT kind, t, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM e GROUP BY kind, t)
SELECT o.o_orderkey, r.event_id, round(r.value, 6) AS value FROM o ASOF LEFT JOIN r ON o.kind = r.kind AND o.t >= r.t""")
def asof_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Each order with the last event of its kind at or before its (wrapped) time."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("kind"), (millis("o_orderdate") % 2592000000 + 1704067200000).alias("at"))
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 5).alias("kind"), millis("ts").alias("at"), "value")
    e = e.groupBy("kind", "at").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"))
    return joins.as_of(o, e, ["kind"], "at", "at", ["event_id", "value"], chunk=24 * HOUR).select("o_orderkey", "event_id", R("value").alias("value"))


@query(f"""WITH {HOURLY_SQL}, x AS (SELECT symbol, open_ms, CASE WHEN open_ms // 3600000 % 7 = 0 THEN close END AS metric FROM bars),
n AS (SELECT *, row_number() OVER {W}) AS i FROM x),
y AS (SELECT *, last_value(CASE WHEN metric IS NOT NULL THEN metric END IGNORE NULLS) OVER f AS m, last_value(CASE WHEN metric IS NOT NULL THEN i END IGNORE NULLS) OVER f AS mi FROM n WINDOW f AS {W} ROWS UNBOUNDED PRECEDING))
SELECT symbol, open_ms, CASE WHEN i - mi < 4 THEN round(m, 6) END AS metric FROM y""")
def asof_bounded_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Each bar with the last metric that is not null among the last four rows of the metrics table."""
    b = hourly(spark, d)
    m = b.select("symbol", "open_ms", F.expr(f"CASE WHEN open_ms DIV {HOUR} % 7 = 0 THEN close END").alias("metric"))
    return joins.as_of(b.select("symbol", "open_ms"), m, ["symbol"], "open_ms", "open_ms", ["metric"], back=4).select("symbol", "open_ms", R("metric").alias("metric"))


@query(f"""WITH {HOURLY_SQL}, l AS (SELECT symbol, open_ms, lead(open_ms, 4) OVER {W}) AS known, CASE WHEN lead(close, 4) OVER {W}) > close THEN 1 ELSE 0 END AS up FROM bars)
SELECT a.symbol, a.open_ms, CAST(count(b.open_ms) AS BIGINT) AS n, round((coalesce(sum(b.up), 0) + 1) / (count(b.open_ms) + 2), 6) AS prior
FROM bars a LEFT JOIN l b ON a.symbol = b.symbol AND b.known <= a.open_ms GROUP BY a.symbol, a.open_ms""")
def availability_prior_rates(spark: SparkSession, d: str) -> DataFrame:
    """The share of rises, with a Laplace prior, among the four-bar labels that are known at each bar."""
    b = hourly(spark, d)
    facts = b.select("symbol", I.lead("open_ms", 4).alias("known"), F.when(I.lead("close", 4) > F.col("close"), 1).otherwise(0).alias("up")).where("known IS NOT NULL")
    told = joins.known_by(b.select("symbol", "open_ms"), facts, ["symbol"], "open_ms", "known", {"n": F.lit(1), "ups": F.col("up")}, chunk=96 * HOUR)
    return told.select("symbol", "open_ms", F.col("n").cast("long").alias("n"), R((F.col("ups") + 1) / (F.col("n") + 2)).alias("prior"))


@query("""WITH p AS (SELECT o_orderpriority AS kind, date_trunc('quarter', o_orderdate) AS start, count(*) AS quarter_orders FROM orders GROUP BY ALL),
v AS (SELECT *, lead(start) OVER (PARTITION BY kind ORDER BY start) AS stop FROM p)
SELECT o.o_orderkey, CAST(v.start AS DATE) AS start, v.quarter_orders FROM orders o LEFT JOIN v ON v.kind = o.o_orderpriority AND o.o_orderdate >= v.start AND (v.stop IS NULL OR o.o_orderdate < v.stop)""")
def interval_membership(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("kind"), F.to_date("o_orderdate").alias("day"))
    p = o.groupBy("kind", F.trunc("day", "quarter").alias("start")).agg(F.count("*").alias("quarter_orders"))
    return joins.membership(o, p, ["kind"], "day", "start").select("o_orderkey", "start", "quarter_orders")


@query("""WITH a AS (SELECT user_id, (epoch_us(ts) // 1000) // 86400000 AS day, max(value) AS m1, CAST(NULL AS DOUBLE) AS m2, max((epoch_us(ts) // 1000)) AS available, 'a' AS source, false AS flag FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2),
b AS (SELECT user_id, (epoch_us(ts) // 1000) // 86400000 AS day, CASE WHEN count(*) > 1 THEN max(value) END AS m1, min(value) AS m2, max((epoch_us(ts) // 1000)) AS available, 'b' AS source, count(*) > 2 AS flag FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT user_id, day, round(coalesce(b.m1, a.m1), 6) AS m1, round(coalesce(b.m2, a.m2), 6) AS m2,
  CASE WHEN a.source IS NULL THEN b.available WHEN b.source IS NULL OR NOT (a.m1 IS NULL AND b.m1 IS NOT NULL OR a.m2 IS NULL AND b.m2 IS NOT NULL) THEN a.available ELSE greatest(a.available, b.available) END AS available,
  CASE WHEN a.source IS NULL THEN b.source WHEN b.source IS NULL THEN a.source ELSE 'multiple' END AS source, coalesce(a.flag, false) OR coalesce(b.flag, false) AS flag FROM a FULL JOIN b USING (user_id, day)""")
def upsert_merge_lineage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "value", millis("ts").alias("at"))
    e = e.withColumn("day", F.expr("at DIV 86400000"))
    a = e.where("event_id % 2 = 0").groupBy("user_id", "day").agg(F.max("value").alias("m1"), F.lit(None).cast("double").alias("m2"), F.max("at").alias("available"), F.lit("a").alias("source"), F.lit(False).alias("flag"))
    b = e.where("event_id % 2 = 1").groupBy("user_id", "day").agg(F.when(F.count("*") > 1, F.max("value")).alias("m1"), F.min("value").alias("m2"), F.max("at").alias("available"), F.lit("b").alias("source"), (F.count("*") > 2).alias("flag"))
    return joins.merge_lineage(a, b, ["user_id", "day"], ["m1", "m2"], "available", "source", "flag").withColumns({"m1": R("m1"), "m2": R("m2")})


@query("""SELECT day FROM (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS day FROM orders) x
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderpriority = '1-URGENT' AND CAST(o.o_orderdate AS DATE) = x.day)""")
def anti_missing_days(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderpriority", F.to_date("o_orderdate").alias("day"))
    days = o.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(o.where("o_orderpriority = '1-URGENT'"), "day", "left_anti")


@query("SELECT c_custkey, c_nationkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000) AND c_nationkey IS DISTINCT FROM 7")
def semi_scope(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").where(~F.col("c_nationkey").eqNullSafe(7)).join(big, "c_custkey", "left_semi").select("c_custkey", "c_nationkey")


@query(f"""WITH {DAILY_SQL}, a AS (SELECT day, close FROM daily WHERE symbol = '1-URGENT'), b AS (SELECT day, close FROM daily WHERE symbol = '5-LOW')
SELECT day, CASE WHEN a.close IS NULL THEN 'only_b' WHEN b.close IS NULL THEN 'only_a' WHEN abs(a.close - b.close) <= 0.05 * b.close THEN 'agree' ELSE 'differ' END AS side, round(a.close - b.close, 4) AS difference FROM a FULL JOIN b USING (day)""")
def provider_crosscheck(spark: SparkSession, d: str) -> DataFrame:
    x = _daily(spark, d)
    a, b = (x.where(F.col("symbol") == s).select("day", F.col("close").alias(n)) for s, n in (("1-URGENT", "a"), ("5-LOW", "b")))
    side = F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").when(F.abs(F.col("a") - F.col("b")) <= 0.05 * F.col("b"), "agree").otherwise("differ")
    return a.join(b, "day", "full_outer").select("day", side.alias("side"), F.round(F.col("a") - F.col("b"), 4).alias("difference"))


@query(f"""WITH {HOURLY_SQL} SELECT a.symbol, a.open_ms, round(b.close / a.close - 1, 6) AS held FROM bars a JOIN bars b ON a.symbol = b.symbol AND b.open_ms = a.open_ms + 4 * 3600000 WHERE a.close <> 0""")
def offset_join(spark: SparkSession, d: str) -> DataFrame:
    """Entry and the exit exactly four hours later, where both bars exist."""
    b = hourly(spark, d)
    later = b.select("symbol", (F.col("open_ms") - 4 * HOUR).alias("open_ms"), F.col("close").alias("leave"))
    return b.where("close <> 0").join(later, ["symbol", "open_ms"]).select("symbol", "open_ms", R(F.col("leave") / F.col("close") - 1).alias("held"))


@query("""WITH s AS (SELECT user_id, event_type AS a, lead(event_type) OVER w AS b, value, lead(value) OVER w AS next_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT a, b, count(*) AS n, avg(CASE WHEN value <> 0 THEN next_value / value - 1 END) AS r FROM s WHERE b IS NOT NULL GROUP BY a, b),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY a) AS p FROM m)
SELECT a, b, n, round(p, 6) AS probability, round(coalesce(r, 0), 6) AS mean_return, round(-sum(p * log2(p)) OVER (PARTITION BY a), 6) AS entropy FROM p""")
def transition_matrix_entropy(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = table(spark, d, "events").select(F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b"), "value", F.lead("value").over(w).alias("next_value")).where("b IS NOT NULL")
    m = s.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg(F.when(F.col("value") != 0, F.col("next_value") / F.col("value") - 1)).alias("r"))
    of = Window.partitionBy("a")
    p = m.withColumn("p", F.col("n") / F.sum("n").over(of))
    return p.select("a", "b", "n", R("p").alias("probability"), R(F.coalesce("r", F.lit(0.0))).alias("mean_return"), R(-F.sum(F.col("p") * F.log2("p")).over(of)).alias("entropy"))


@query("""WITH s AS (SELECT event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c, lead(value, 2) OVER w - value AS move FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT a, b, c, count(*) AS n, round(avg(CASE WHEN move > 0 THEN 1.0 ELSE 0 END), 6) AS up, round(avg(CASE WHEN move < 0 THEN 1.0 ELSE 0 END), 6) AS down, round(avg(move), 6) AS mean FROM s WHERE c IS NOT NULL GROUP BY a, b, c""")
def sequence_second_order(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = table(spark, d, "events").select(F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b"), F.lead("event_type", 2).over(w).alias("c"), (F.lead("value", 2).over(w) - F.col("value")).alias("move"))
    share = lambda c: R(F.avg(F.when(c, 1.0).otherwise(0.0)))
    return s.where("c IS NOT NULL").groupBy("a", "b", "c").agg(F.count("*").alias("n"), share(F.col("move") > 0).alias("up"), share(F.col("move") < 0).alias("down"), R(F.avg("move")).alias("mean"))


def _panel(spark: SparkSession, d: str) -> DataFrame:
    """(month, symbol, score, target): by month and nation the mean order total and the number of orders."""
    o = table(spark, d, "orders").select("o_custkey", "o_totalprice", F.trunc(F.to_date("o_orderdate"), "month").alias("month"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("symbol"))
    return o.join(c, "o_custkey").groupBy("month", "symbol").agg(F.avg("o_totalprice").alias("score"), F.count("*").alias("target"))


PANEL_SQL = "WITH panel AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, c_nationkey AS symbol, avg(o_totalprice) AS score, count(*) AS target FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"


@query(PANEL_SQL + """, r AS (SELECT *, rank() OVER (PARTITION BY month ORDER BY score) + (count(*) OVER (PARTITION BY month, score) - 1) / 2 AS r, count(*) OVER (PARTITION BY month) AS n FROM panel)
SELECT month, symbol, round(CASE WHEN n < 2 THEN 0 ELSE (r - 1) / (n - 1) - 0.5 END, 6) AS normalised FROM r""")
def rank_normalised_cross_section(spark: SparkSession, d: str) -> DataFrame:
    x = _panel(spark, d).withColumn("r", stats.mean_rank("score", ["month"])).withColumn("n", F.count("*").over(Window.partitionBy("month")))
    return x.select("month", "symbol", R(F.when(F.col("n") < 2, 0.0).otherwise((F.col("r") - 1) / (F.col("n") - 1) - 0.5)).alias("normalised"))


@query(PANEL_SQL + """, r AS (SELECT month, rank() OVER (PARTITION BY month ORDER BY score) + (count(*) OVER (PARTITION BY month, score) - 1) / 2 AS a, rank() OVER (PARTITION BY month ORDER BY target) + (count(*) OVER (PARTITION BY month, target) - 1) / 2 AS b FROM panel)
SELECT month, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN round(corr(a, b), 6) END AS ic FROM r GROUP BY month""")
def rank_ic_by_date(spark: SparkSession, d: str) -> DataFrame:
    return stats.rank_ic(_panel(spark, d), "score", "target", ["month"]).withColumn("ic", R("ic"))


@query(PANEL_SQL + """ SELECT month, symbol, CAST(row_number() OVER (PARTITION BY month ORDER BY score DESC, symbol) AS INTEGER) AS rank, round(score, 4) AS score FROM panel QUALIFY row_number() OVER (PARTITION BY month ORDER BY score DESC, symbol) <= 3""")
def top_k_per_date(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("month").orderBy(F.desc("score"), "symbol")
    return _panel(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("month", "symbol", "rank", F.round("score", 4).alias("score"))


@query(f"""WITH {DAILY_SQL}, r AS (SELECT symbol, day, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS r, close / max(close) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM daily),
m AS (SELECT symbol, avg(r) AS m, stddev_samp(r) AS s, stddev_pop(r) AS sp, avg(r * r * r) AS r3, avg(r * r) AS r2, kurtosis_pop(r) + 3 AS kurt, min(dd) AS max_drawdown, count(r) AS n FROM r GROUP BY symbol)
SELECT symbol, round(m, 6) AS mean, round(s, 6) AS sd, round((r3 - 3 * m * r2 + 2 * m * m * m) / (sp * sp * sp), 4) AS skew, round(kurt, 4) AS kurt, round(m / s * sqrt(252), 4) AS sharpe, round(m / (s / sqrt(n)), 4) AS t, round(max_drawdown, 6) AS max_drawdown FROM m""")
def sharpe_moments_drawdown(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("day")
    r = _daily(spark, d).select("symbol", (F.col("close") / F.lag("close").over(w) - 1).alias("r"), (F.col("close") / F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("dd"))
    m = r.groupBy("symbol").agg(*stats.moments("r"), stats.t_statistic("r").alias("t"), F.min("dd").alias("dd"))
    return m.select("symbol", R("mean").alias("mean"), R("sd").alias("sd"), F.round("skew", 4).alias("skew"), F.round("kurt", 4).alias("kurt"), F.round(F.col("mean") / F.col("sd") * F.sqrt(F.lit(252.0)), 4).alias("sharpe"), F.round("t", 4).alias("t"), R("dd").alias("max_drawdown"))


@query("""WITH t AS (SELECT l_returnflag AS regime, l_extendedprice / l_quantity * (1 - l_discount) * (1 - 0.0015) / (l_extendedprice / l_quantity * 0.95 * (1 + 0.0015)) - 1 AS r FROM lineitem WHERE l_quantity > 0)
SELECT regime, count(*) AS trades, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, round(least(999, sum(CASE WHEN r > 0 THEN r ELSE 0 END) / nullif(-sum(CASE WHEN r < 0 THEN r ELSE 0 END), 0)), 6) AS profit_factor, round(sum(ln(1 + r)), 4) AS log_growth FROM t GROUP BY regime""")
def roundtrip_pnl_regimes(spark: SparkSession, d: str) -> DataFrame:
    from barline.operators.simulate import round_trip

    price = F.col("l_extendedprice") / F.col("l_quantity")
    t = table(spark, d, "lineitem").where("l_quantity > 0").select(F.col("l_returnflag").alias("regime"), round_trip(price * 0.95, price * (1 - F.col("l_discount"))).alias("r"))
    won, lost = F.sum(F.when(F.col("r") > 0, F.col("r")).otherwise(0.0)), -F.sum(F.when(F.col("r") < 0, F.col("r")).otherwise(0.0))
    return t.groupBy("regime").agg(F.count("*").alias("trades"), R(F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0))).alias("win_rate"), R(F.when(lost != 0, F.least(F.lit(999.0), won / lost))).alias("profit_factor"), F.round(F.sum(F.log1p("r")), 4).alias("log_growth"))


_PROB = "SELECT l.doc_id, quality AS y, least(1.0, greatest(0.0, 0.5 + (n_chars % 997) / 1994.0)) AS p FROM labels l JOIN documents d USING (doc_id)"


@query(f"""WITH x AS ({_PROB}), b AS (SELECT least(9, CAST(floor(p * 10) AS BIGINT)) AS bin, count(*) AS n, avg(p) AS conf, avg(y) AS hit, avg((p - y) * (p - y)) AS brier, avg(-ln(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-12))) AS loss FROM x GROUP BY 1)
SELECT bin, n, round(conf, 6) AS conf, round(hit, 6) AS hit, round(brier, 6) AS brier, round(loss, 6) AS loss, round(sum(n * abs(conf - hit)) OVER () / sum(n) OVER (), 6) AS ece FROM b""")
def brier_ece_reliability(spark: SparkSession, d: str) -> DataFrame:
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + (F.col("n_chars") % 997) / 1994.0))
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), p.alias("p"))
    loss = -F.log(F.greatest(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")), F.lit(1e-12)))
    b = x.groupBy(F.least(F.lit(9), F.floor(F.col("p") * 10)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("conf"), F.avg("y").alias("hit"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"), F.avg(loss).alias("loss"))
    whole = Window.partitionBy()  # ten rows
    ece = F.sum(F.col("n") * F.abs(F.col("conf") - F.col("hit"))).over(whole) / F.sum("n").over(whole)
    return b.select("bin", "n", R("conf").alias("conf"), R("hit").alias("hit"), R("brier").alias("brier"), R("loss").alias("loss"), R(ece).alias("ece"))


@query("""WITH x AS (SELECT event_type AS kind, user_id % 10 AS g, value - 50 AS v FROM events), s AS (SELECT kind, g, count(*) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS median, avg(v) / stddev_samp(v) AS effect, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END) AS positive FROM x GROUP BY kind, g),
p AS (SELECT *, least(1.0, 1 / (1 + effect * effect * n)) AS p FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY p, g) AS k, count(*) OVER (PARTITION BY kind) AS m FROM p),
h AS (SELECT *, sum(1.0 / k) OVER (PARTITION BY kind) AS h FROM k)
SELECT kind, g, n, round(mean, 6) AS mean, round(median, 6) AS median, round(effect, 6) AS effect, round(positive, 6) AS positive, round(p, 6) AS p,
  round(least(1.0, min(p * m * h / k) OVER (PARTITION BY kind ORDER BY p, g ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM h""")
def effect_size_fdr(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 10).alias("g"), (F.col("value") - 50).alias("v"))
    s = x.groupBy("kind", "g").agg(*stats.effect("v")).withColumn("p", F.least(F.lit(1.0), 1 / (1 + F.col("effect") * F.col("effect") * F.col("n"))))
    q = stats.benjamini_yekutieli(s, "p", ["kind"], ["g"])
    return q.select("kind", "g", "n", *[R(c).alias(c) for c in ("mean", "median", "effect", "positive", "p", "q")])


@query(f"""WITH {HOURLY_SQL}, lim AS (SELECT symbol, min(low) AS lo, max(high) AS hi FROM bars GROUP BY symbol),
v AS (SELECT b.symbol, least(23, CAST(floor(((high + low + close) / 3 - lo) / ((hi - lo) / 24)) AS BIGINT)) AS bin, sum(volume) AS v FROM bars b JOIN lim USING (symbol) WHERE hi > lo GROUP BY 1, 2),
c AS (SELECT *, sum(v) OVER (PARTITION BY symbol ORDER BY v DESC, bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - v AS before, sum(v) OVER (PARTITION BY symbol) AS total, row_number() OVER (PARTITION BY symbol ORDER BY v DESC, bin) AS k FROM v)
SELECT symbol, bin, CAST(v AS BIGINT) AS volume, k = 1 AS poc, before < 0.7 * total AS in_value_area FROM c""")
def volume_profile_poc(spark: SparkSession, d: str) -> DataFrame:
    b = hourly(spark, d)
    lim = b.groupBy("symbol").agg(F.min("low").alias("lo"), F.max("high").alias("hi")).where("hi > lo")
    at = F.floor(((F.col("high") + F.col("low") + F.col("close")) / 3 - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 24))
    v = b.join(lim, "symbol").groupBy("symbol", F.least(F.lit(23), at).cast("long").alias("bin")).agg(F.sum("volume").alias("volume"))
    w = Window.partitionBy("symbol").orderBy(F.desc("volume"), "bin")
    before = F.sum("volume").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("volume")
    return v.select("symbol", "bin", "volume", (F.row_number().over(w) == 1).alias("poc"), (before < 0.7 * F.sum("volume").over(Window.partitionBy("symbol"))).alias("in_value_area"))


_LIQ = "(SELECT unnest([{'lev': 100, 'w': 0.25, 'm': 0.004}, {'lev': 50, 'w': 0.35, 'm': 0.005}, {'lev': 25, 'w': 0.40, 'm': 0.010}], recursive := true))"


@query(f"""WITH {HOURLY_SQL}, n AS (SELECT *, min(low) OVER f AS later_low, max(high) OVER f AS later_high FROM bars WINDOW f AS {W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
l AS (SELECT symbol, lev, side, CAST(0.15 AS DOUBLE) * volume * w AS size, CASE WHEN side = 1 THEN close * (1 - 1.0 / lev + m) ELSE close * (1 + 1.0 / lev - m) END AS price, later_low, later_high FROM n, {_LIQ}, (SELECT unnest([1, -1]) AS side)),
k AS (SELECT * FROM l WHERE NOT coalesce(CASE WHEN side = 1 THEN later_low <= price ELSE later_high >= price END, false)),
c AS (SELECT symbol, arg_max(close, open_ms) AS last_close FROM bars GROUP BY symbol)
SELECT symbol, CAST(ceil((price - 0.85 * last_close) / (0.003 * last_close) - 0.5) AS BIGINT) AS bin, round(sum(size) FILTER (lev = 100), 4) AS lev100, round(sum(size) FILTER (lev = 50), 4) AS lev50, round(sum(size) FILTER (lev = 25), 4) AS lev25, round(sum(size), 4) AS total
FROM k JOIN c USING (symbol) WHERE last_close > 0 AND price BETWEEN 0.85 * last_close AND 1.15 * last_close GROUP BY 1, 2""")
def liquidation_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """Levels of three leverages and both sides that no later bar has reached, by distance from the last close."""
    b = hourly(spark, d)
    ahead = I.frame(1, Window.unboundedFollowing)
    n = b.withColumn("later_low", F.min("low").over(ahead)).withColumn("later_high", F.max("high").over(ahead))
    kinds = F.array(*[F.struct(F.lit(v).alias("lev"), F.lit(w).alias("w"), F.lit(m).alias("m"), F.lit(s).alias("side")) for v, w, m in ((100, 0.25, 0.004), (50, 0.35, 0.005), (25, 0.40, 0.010)) for s in (1, -1)])
    l = n.withColumn("k", F.explode(kinds)).select("symbol", "close", "volume", "later_low", "later_high", "k.*")
    l = l.withColumn("size", 0.15 * F.col("volume") * F.col("w")).withColumn("price", F.when(F.col("side") == 1, F.col("close") * (1 - 1.0 / F.col("lev") + F.col("m"))).otherwise(F.col("close") * (1 + 1.0 / F.col("lev") - F.col("m"))))
    swept = F.when(F.col("side") == 1, F.col("later_low") <= F.col("price")).otherwise(F.col("later_high") >= F.col("price"))
    last = b.groupBy("symbol").agg(F.max_by("close", "open_ms").alias("last_close")).where("last_close > 0")
    k = l.where(~F.coalesce(swept, F.lit(False))).join(last, "symbol").where("price BETWEEN 0.85 * last_close AND 1.15 * last_close")
    k = k.withColumn("bin", F.ceil((F.col("price") - 0.85 * F.col("last_close")) / (0.003 * F.col("last_close")) - 0.5).cast("long"))
    part = lambda v: F.round(F.sum(F.when(F.col("lev") == v, F.col("size"))), 4).alias(f"lev{v}")
    return k.groupBy("symbol", "bin").agg(part(100), part(50), part(25), F.round(F.sum("size"), 4).alias("total"))


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS s FROM q JOIN embeddings c ON q.vec_id <> c.vec_id)
SELECT query_id, vec_id, round(s, 5) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 10""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors most like each whose id is divisible by 100, among all others."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return search.cosine(v, F.col("vec_id") % 100 == 0, 10).select("query_id", "vec_id", F.round("similarity", 5).alias("similarity"))


@query("""WITH u AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), c AS (SELECT label AS centre, i, avg(x) AS m FROM u GROUP BY label, i),
d AS (SELECT vec_id, centre, sqrt(sum((x - m) * (x - m))) AS d FROM u JOIN c USING (i) GROUP BY vec_id, centre)
SELECT vec_id, arg_min(centre, d) AS centre, round(min(d), 5) AS distance FROM d GROUP BY vec_id""")
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of the labels' mean vectors; as many centres as labels, so they are broadcast as one row."""
    v = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    c = v.select("label", F.posexplode("e").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    one = c.agg(F.collect_list(F.struct(F.col("label").alias("centre"), "m")).alias("all"))
    gap = lambda m: F.sqrt(F.aggregate(F.zip_with("e", m, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    near = F.array_min(F.transform("all", lambda s: F.struct(gap(s["m"]).alias("d"), s["centre"].alias("centre"))))
    return v.crossJoin(F.broadcast(one)).select("vec_id", near.alias("n")).select("vec_id", "n.centre", F.round("n.d", 5).alias("distance"))


@query(f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS w FROM documents), x AS ({" UNION ALL ".join(f"SELECT '{k}' AS w, {v} AS s" for k, v in text.LEXICON.items())})
SELECT doc_id, count(*) AS hits, round(tanh(avg(s)), 6) AS sentiment FROM w JOIN x USING (w) GROUP BY doc_id""")
def lexicon_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return text.sentiment(table(spark, d, "documents"), "doc_id", "text").withColumn("sentiment", R("sentiment"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def json_props_extract(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k BIGINT")["k"].alias("k"), "value")
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH g AS (SELECT kind, hour FROM (SELECT DISTINCT event_type AS kind FROM events), (SELECT CAST(unnest(range(0, 24)) AS INTEGER) AS hour)),
f AS (SELECT event_type AS kind, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events WHERE value > 150 GROUP BY 1, 2) SELECT g.kind, g.hour, coalesce(f.n, 0) AS n FROM g LEFT JOIN f USING (kind, hour)""")
def grid_left_join_zero_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every declared pair of type and hour, also those without a row."""
    e = table(spark, d, "events")
    grid = e.select(F.col("event_type").alias("kind")).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    f = e.where("value > 150").groupBy(F.col("event_type").alias("kind"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return grid.join(f, ["kind", "hour"], "left").select("kind", "hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("""SELECT event_type, user_id % 3 AS shard, count(*) AS n, count(CASE WHEN value > 50 THEN 1 END) AS high, min((epoch_us(ts) // 1000)) AS first_ms, max((epoch_us(ts) // 1000)) AS last_ms, count(DISTINCT user_id) AS users FROM events GROUP BY ROLLUP (event_type, user_id % 3)""")
def table_audit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 3).alias("shard"), "value", "user_id", millis("ts").alias("at"))
    return e.rollup("event_type", "shard").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.min("at").alias("first_ms"), F.max("at").alias("last_ms"), F.countDistinct("user_id").alias("users"))


@query("SELECT user_id, arg_max(event_type, epoch_us(ts)) AS event_type, arg_max(event_id, epoch_us(ts)) AS event_id FROM events GROUP BY user_id")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", at).alias("event_type"), F.max_by("event_id", at).alias("event_id"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type AS modal, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1""")
def modal_value(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    return c.withColumn("r", F.row_number().over(w)).where("r = 1").select("user_id", F.col("event_type").alias("modal"), "n")


@query("""WITH h AS (SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS k FROM events GROUP BY 1), z AS (SELECT *, k / n AS p, 1.959963984540054 * 1.959963984540054 AS z2, CAST(1.959963984540054 AS DOUBLE) AS z FROM h)
SELECT event_type, n, k, round(greatest(0, (p + z2 / (2 * n) - z * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS low, round(least(1, (p + z2 / (2 * n) + z * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS high FROM z""")
def wilson_interval(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return h.select("event_type", "n", "k", R(low).alias("low"), R(high).alias("high"))


@query("""WITH x AS (SELECT quality AS y, CASE WHEN n_chars % 7 < 5 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) AS n, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn FROM x)
SELECT n, tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) AS macro_f1,
  round((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c""")
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("n_chars") % 7 < 5, 1).otherwise(0)
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), p.alias("p"))
    c = x.agg(F.count("*").alias("n"), *[F.count_if((F.col("y") == a) & (F.col("p") == b)).alias(n) for n, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))])
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    return c.select("n", "tp", "fp", "fn", "tn", R((tp + tn) / F.col("n")).alias("accuracy"), R((tp / (tp + fn) + tn / (tn + fp)) / 2).alias("balanced"), R((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2).alias("macro_f1"),
        R((tp * tn - fp * fn) / F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"))


@query(f"""WITH {HOURLY_SQL}{EVENTS_SQL}, t AS (SELECT DISTINCT module, symbol, open_ms FROM ev)
SELECT a.module AS a, b.module AS b, count(*) AS both_, round(count(*) / ((SELECT count(*) FROM t x WHERE x.module = a.module) + (SELECT count(*) FROM t x WHERE x.module = b.module) - count(*)), 6) AS jaccard
FROM t a JOIN t b ON a.symbol = b.symbol AND a.open_ms = b.open_ms AND a.module < b.module GROUP BY a.module, b.module""")
def module_overlap_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """How often modules speak at the same close: pairs come from each close's set of modules, not from a join."""
    t = I.whole(events.causal(I.split(hourly(spark, d), 60, 0, HOUR)), HOUR).select("module", "symbol", "open_ms").distinct()
    sizes = F.broadcast(t.groupBy("module").agg(F.count("*").alias("k")))  # a row a module
    sets = t.groupBy("symbol", "open_ms").agg(F.array_sort(F.collect_set("module")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    n = sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("both_"))
    n = n.join(sizes.select(F.col("module").alias("a"), F.col("k").alias("ka")), "a").join(sizes.select(F.col("module").alias("b"), F.col("k").alias("kb")), "b")
    return n.select("a", "b", "both_", R(F.col("both_") / (F.col("ka") + F.col("kb") - F.col("both_"))).alias("jaccard"))


@query(f"""WITH {HOURLY_SQL}, l AS (SELECT symbol, sha256(string_agg(CAST(open_ms AS VARCHAR) || ',' || CAST(volume AS VARCHAR), chr(10) ORDER BY open_ms)) AS checksum, count(*) AS n FROM bars GROUP BY symbol) SELECT * FROM l""")
def checksum_series(spark: SparkSession, d: str) -> DataFrame:
    """A digest of a symbol's lines in order: for comparing snapshots of bounded series."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("open_ms", "volume"))), lambda r: F.concat_ws(",", r["open_ms"], r["volume"]))
    return hourly(spark, d).groupBy("symbol").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("checksum"), F.count("*").alias("n"))


@query("""WITH x AS (SELECT user_id, (epoch_us(ts) // 1000) AS t, value - 60 AS pnl, event_id FROM events)
SELECT event_id, round(sum(pnl) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW), 4) AS pnl_24h,
  count(*) OVER s = 4 AND max(pnl) OVER s < 0 AS four_losses FROM x WINDOW s AS (PARTITION BY user_id ORDER BY t, event_id ROWS 3 PRECEDING)""")
def circuit_breaker_inputs(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("user_id", millis("ts").alias("at"), (F.col("value") - 60).alias("pnl"), "event_id")
    day, four = Window.partitionBy("user_id").orderBy("at").rangeBetween(-86_400_000, 0), Window.partitionBy("user_id").orderBy("at", "event_id").rowsBetween(-3, 0)
    return x.select("event_id", F.round(F.sum("pnl").over(day), 4).alias("pnl_24h"), ((F.count("*").over(four) == 4) & (F.max("pnl").over(four) < 0)).alias("four_losses"))


@query(f"""WITH {DAILY_SQL}, x AS (SELECT symbol, day, close, lead(day) OVER w AS next_day, row_number() OVER w AS i, lag(close, 5) OVER w AS c5, count(close) OVER f AS n, stddev_samp(close) OVER f AS s, max(close) OVER y AS hi, avg(close) OVER y AS ma, count(*) OVER y AS ny
  FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY day), f AS (PARTITION BY symbol ORDER BY day ROWS 19 PRECEDING), y AS (PARTITION BY symbol ORDER BY day ROWS 199 PRECEDING))
SELECT symbol, day, (i - 1) % 20 = 0 AS rebalance, coalesce(month(next_day) <> month(day), false) AS month_end, round(close / c5 - 1, 6) AS momentum5, CASE WHEN n = 20 THEN round(-s, 4) END AS low_vol, CASE WHEN ny = 200 THEN round(close / hi, 6) END AS of_high, CASE WHEN ny = 200 THEN close > ma END AS above_ma FROM x""")
def panel_features_schedule(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("day")
    f, y = w.rowsBetween(-19, 0), w.rowsBetween(-199, 0)
    c = F.col("close")
    x = _daily(spark, d)
    return x.select("symbol", "day", ((F.row_number().over(w) - 1) % 20 == 0).alias("rebalance"), F.coalesce(F.month(F.lead("day").over(w)) != F.month("day"), F.lit(False)).alias("month_end"), R(c / F.lag("close", 5).over(w) - 1).alias("momentum5"),
        F.when(F.count("close").over(f) == 20, F.round(-F.stddev_samp("close").over(f), 4)).alias("low_vol"), F.when(F.count("*").over(y) == 200, R(c / F.max("close").over(y))).alias("of_high"), F.when(F.count("*").over(y) == 200, c > F.avg("close").over(y)).alias("above_ma"))


@query("""WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders), f AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1993-01-01', TIMESTAMP '1997-07-01', INTERVAL 6 MONTH)) AS DATE) AS start)
SELECT start, count(*) FILTER (month < start - INTERVAL 1 MONTH) AS train, count(*) FILTER (month >= start AND month < start + INTERVAL 6 MONTH) AS test FROM f, m GROUP BY start""")
def expanding_folds(spark: SparkSession, d: str) -> DataFrame:
    """Half-year test folds, all before as training, less a purged month: ten folds and the months, both bounded."""
    m = table(spark, d, "orders").select(F.trunc(F.to_date("o_orderdate"), "month").alias("month")).distinct()
    f = spark.range(10).select(F.add_months(F.lit("1993-01-01").cast("date"), (6 * F.col("id")).cast("int")).alias("start"))
    rows = m.join(F.broadcast(f), F.col("month") < F.add_months("start", 6))
    return rows.groupBy("start").agg(F.count_if(F.col("month") < F.add_months("start", -1)).alias("train"), F.count_if(F.col("month") >= F.col("start")).alias("test")).join(f, "start", "right").select("start", F.coalesce("train", F.lit(0).cast("long")).alias("train"), F.coalesce("test", F.lit(0).cast("long")).alias("test"))


@query("""SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    key = lambda c: o.where(c).select("o_custkey")
    return key("o_orderstatus = 'F'").intersect(key("o_orderstatus = 'O'")).subtract(key("o_totalprice > 400000"))


@query(f"""WITH {HOURLY_SQL}{HORIZON_SQL} SELECT symbol, horizon, count(*) AS n, round(quantile_cont(forward_return, 0.05), 6) AS p5, round(quantile_cont(forward_return, 0.25), 6) AS p25, round(quantile_cont(forward_return, 0.75), 6) AS p75, round(quantile_cont(forward_return, 0.95), 6) AS p95,
  round(avg(CASE WHEN forward_return > 0 THEN 1.0 ELSE 0 END), 6) AS up FROM fwd GROUP BY symbol, horizon""")
def distribution_summary(spark: SparkSession, d: str) -> DataFrame:
    x = I.whole(events.horizons(I.split(hourly(spark, d), 0, 6, HOUR)), HOUR)
    p = F.percentile("forward_return", F.array(*[F.lit(v) for v in (0.05, 0.25, 0.75, 0.95)]))
    g = x.groupBy("symbol", "horizon").agg(F.count("*").alias("n"), p.alias("p"), R(F.avg(F.when(F.col("forward_return") > 0, 1.0).otherwise(0.0))).alias("up"))
    return g.select("symbol", "horizon", "n", *[R(F.col("p")[i]).alias(k) for i, k in enumerate(("p5", "p25", "p75", "p95"))], "up")
