"""Product analytics over the event stream, and data-quality gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators.quantiles import quantiles
from ..sources.tables import GRANTS_SQL as G
from ..sources.tables import grants, table
from .registry import query

AS_OF = "2024-02-14"


def _momentum(spark, d, as_of):
    day, at = F.col("ts").cast("date"), F.lit(as_of).cast("date")
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("n_all"), F.count_if(day > F.date_sub(at, 30)).alias("n_30"), F.count_if((day > F.date_sub(at, 60)) & (day <= F.date_sub(at, 30))).alias("n_prev"), F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), 4).alias("total")
    )


@query("""SELECT event_type, count(*) AS n_all, count(*) FILTER (CAST(ts AS DATE) > DATE '2024-02-14' - 30) AS n_30, count(*) FILTER (CAST(ts AS DATE) > DATE '2024-02-14' - 60 AND CAST(ts AS DATE) <= DATE '2024-02-14' - 30) AS n_prev, round(sum(CAST(value AS DECIMAL(18,4)))::DOUBLE, 4) AS total FROM events GROUP BY 1""")
def ws_momentum(spark, d):
    """WS-10, WS-13, WS-14: counts of windows from a given day, in one pass."""
    return _momentum(spark, d, AS_OF)


@query("""WITH g AS (SELECT event_type, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) SELECT event_type, count(gap) AS moves, round(quantile_cont(gap, 0.5), 3) AS median_gap FROM g GROUP BY 1""")
def ws_stage_velocity(spark, d):
    """WS-11: median seconds between moves."""
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    g = table(spark, d, "events").select("event_type", (sec - F.lag(sec).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("gap"))
    n = g.groupBy("event_type").agg(F.count("gap").alias("moves"))
    return n.join(quantiles(g, ["event_type"], "gap", {"median_gap": ("cont", 0.5)}), "event_type", "left").select("event_type", "moves", F.round("median_gap", 3).alias("median_gap"))


@query("""WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END) AS stage FROM events GROUP BY 1, 2) SELECT r.stage, count(*) FILTER (s.stage >= r.stage) AS reached FROM s, (SELECT unnest(range(1, 5))::INT AS stage) r GROUP BY 1""")
def ws_funnel(spark, d):
    """WS-12: visits (a user's day) that reached a stage reached those before it."""
    kind = F.col("event_type")
    stage = F.when(kind == "view", 1).when(kind == "click", 2).when(kind == "signup", 3).when(kind == "purchase", 4).otherwise(0)
    s = table(spark, d, "events").groupBy("user_id", F.col("ts").cast("date")).agg(F.max(stage).alias("stage"))
    r = s.agg(*[F.count_if(F.col("stage") >= k).alias(str(k)) for k in range(1, 5)])
    return r.select(F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), F.col(str(k)).alias("reached")) for k in range(1, 5)])).alias("x")).select("x.stage", "x.reached")


@query("""SELECT CAST(day AS DATE) AS day, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-04-30', INTERVAL 1 DAY)) AS day) LEFT JOIN (SELECT CAST(ts AS DATE) AS d2, count(*) AS n FROM events GROUP BY 1) ON CAST(day AS DATE) = d2""")
def ws_daily_zero_fill(spark, d):
    """DT-07, WS-16."""
    n = table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return R.zero_fill_days(n, "day", "2024-01-01", "2024-04-30", "n")


@query("""SELECT user_id, date_trunc('week', ts)::DATE AS period, count(*) AS used, count(*) > 14 AS over_quota FROM events GROUP BY 1, 2""")
def ws_quota_period(spark, d):
    """WS-18."""
    return table(spark, d, "events").groupBy("user_id", F.trunc(F.col("ts").cast("date"), "week").alias("period")).agg(F.count("*").alias("used"), (F.count("*") > 14).alias("over_quota"))


@query("""WITH b AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, ts, CASE WHEN event_type = 'purchase' THEN 0 WHEN value > 20 THEN 1 WHEN event_type = 'signup' THEN 2 ELSE 3 END AS band FROM events) SELECT user_id, day, event_id, band FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY band, ts DESC, event_id) AS rn FROM b) WHERE rn = 1""")
def ws_focus(spark, d):
    """WS-15: the most pressing reason of each subject."""
    band = F.when(F.col("event_type") == "purchase", 0).when(F.col("value") > 20, 1).when(F.col("event_type") == "signup", 2).otherwise(3)
    return R.latest_per_key(table(spark, d, "events").withColumns({"band": band, "day": F.col("ts").cast("date")}), ["user_id", "day"], F.asc("band"), F.desc("ts"), F.asc("event_id")).select("user_id", "day", "event_id", "band")


@query(G + """SELECT check_name, bad FROM (SELECT 'orphan_line' AS check_name, count(*) AS bad FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'negative_amount', count(*) FROM grants WHERE amount < 0 UNION ALL
SELECT 'duplicate_line', coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'posture_partition', (SELECT count(*) FROM orders) - (SELECT count(*) FILTER (o_orderstatus IN ('O', 'F', 'P')) FROM orders))""")
def dq_expectations(spark, d):
    """DQ-01, DQ-02, DQ-04, INV-F1, INV-X: rows that break each rule; a clean table gives zeros."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    rule = lambda name, df, value: df.agg(value.cast("long").alias("bad")).select(F.lit(name).alias("check_name"), "bad")
    zero = lambda c: F.coalesce(c, F.lit(0))
    orphan = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    twice = li.groupBy("l_orderkey", "l_linenumber").count().filter("count > 1")
    out = [rule("orphan_line", orphan, F.count("*")), rule("negative_amount", grants(spark, d), F.count_if(F.col("amount") < 0)), rule("duplicate_line", twice, zero(F.sum(F.col("count") - 1))), rule("posture_partition", o, F.count("*") - F.count_if(F.col("o_orderstatus").isin("O", "F", "P")))]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("""WITH r AS (SELECT l_suppkey AS q, l_partkey AS item, CAST(l_quantity AS INT) % 3 AS gain, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rk, row_number() OVER (PARTITION BY l_suppkey ORDER BY CAST(l_quantity AS INT) % 3 DESC, l_orderkey, l_linenumber) AS ideal FROM lineitem)
SELECT q, round(sum((pow(2, gain) - 1) / log2(rk + 1)) FILTER (rk <= 10) / nullif(sum((pow(2, gain) - 1) / log2(ideal + 1)) FILTER (ideal <= 10), 0), 8) AS ndcg, round(count(*) FILTER (rk <= 10 AND gain > 0) / 10.0, 4) AS p10 FROM r GROUP BY 1""")
def eval_ndcg(spark, d):
    """DQ-07, DQ-08."""
    p = Window.partitionBy("q")
    tie = ("l_orderkey", "l_linenumber")
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("q"), (F.col("l_quantity").cast("int") % 3).alias("gain"), "l_extendedprice", *tie)
    r = r.withColumns({"rk": F.row_number().over(p.orderBy(F.desc("l_extendedprice"), *tie)), "ideal": F.row_number().over(p.orderBy(F.desc("gain"), *tie))})
    part = lambda c: F.sum(F.when(F.col(c) <= 10, (F.pow(F.lit(2.0), "gain") - 1) / F.log2(F.col(c) + 1)))
    return r.groupBy("q").agg(F.round(F.try_divide(part("rk"), part("ideal")), 8).alias("ndcg"), F.round(F.count_if((F.col("rk") <= 10) & (F.col("gain") > 0)) / 10.0, 4).alias("p10"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(CAST(value AS DECIMAL(18,4)))::DOUBLE, 4) AS total FROM events GROUP BY 1, 2""")
def stream_tumbling(spark, d):
    """Addition: the batch twin of the streaming tumbling window."""
    from ..streaming.events import tumbling

    return tumbling(table(spark, d, "events"))


@query("""WITH w AS (SELECT event_id, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 30 MINUTE * k AS s0, ts FROM events, (SELECT unnest([-1, 0, 1]) AS k)) SELECT s0 AS start, count(*) AS n FROM w WHERE ts >= s0 AND ts < s0 + INTERVAL 1 HOUR GROUP BY 1""")
def stream_sliding(spark, d):
    """Addition: an hour's window every half hour."""
    w = F.window("ts", "1 hour", "30 minutes")
    return table(spark, d, "events").groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def stream_session(spark, d):
    """Addition: sessions that end after two hours without an event."""
    w = F.session_window("ts", "2 hours")
    return table(spark, d, "events").groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
