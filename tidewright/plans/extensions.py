"""General relational and event-time queries over the driver's star schema.

Kept apart as the engine's own extensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import prepare, table


def _t(spark, sf_dir, name):
    return table(prepare(spark), sf_dir, name)


def asof(left: DataFrame, right: DataFrame, by: str, at: str, value: str, span: str = "day") -> DataFrame:
    """Each left row with the last ``value`` of the right at or before its ``at``, by key.

    No join of the two sides: both go into one frame, with one window per key
    and ``span`` of time, so a key with a third of all rows is split; what a
    span without a match needs of earlier ones is carried over by one row per
    key and span.  At equal times the right row counts.
    """
    l = left.select(by, at, F.lit(1).alias("_s"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    r = right.select(by, at, F.lit(0).alias("_s"), F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), F.col(value).alias("_v"))
    spans = r.where(F.col("_v").isNotNull()).groupBy(by, F.date_trunc(span, at).alias("_b")).agg(F.max_by("_v", at).alias("_p"))
    both = l.unionByName(r).withColumn("_b", F.date_trunc(span, at))
    ends = both.select(by, "_b").distinct().join(spans, [by, "_b"], "left")
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_c", F.last("_p", ignorenulls=True).over(before)).select(F.col(by).alias("_k"), F.col("_b").alias("_kb"), "_c")
    w = Window.partitionBy(by, "_b").orderBy(at, "_s").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_a", F.last("_v", ignorenulls=True).over(w)).where("_s = 1")
    out = near.join(ends, F.col(by).eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_kb")), "left")
    return out.select("_l.*", F.coalesce("_a", "_c").alias(value))


def z_hash_join(spark, sf_dir):
    l, o, c = (_t(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return j.groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def z_pricing_summary(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def z_semi_anti(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    with_, without = c.join(o, "c_custkey", "left_semi"), c.join(o, "c_custkey", "left_anti")
    count = lambda df, k: df.groupBy("c_nationkey").agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "c_nationkey", "n")
    return count(with_, "with").unionByName(count(without, "without"))


def z_asof(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("click_id"))
    return asof(left, right, "user_id", "ts", "click_id").select("event_id", "click_id")


def z_window_rank(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return _t(spark, sf_dir, "customer").withColumn("r", F.row_number().over(w).cast("bigint")).where("r <= 3").select("c_nationkey", "c_custkey", "r")


def z_window_frame(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return _t(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("moving"))


def z_rollup(spark, sf_dir):
    return _t(spark, sf_dir, "part").rollup("p_brand", "p_type").agg(F.count("*").alias("n"), F.max("p_size").cast("bigint").alias("largest"))


def z_cube(spark, sf_dir):
    return _t(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


def z_set_ops(spark, sf_dir):
    c, s = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    tag = lambda df, k: df.select(F.lit(k).alias("op"), "k")
    return tag(c.union(s).distinct(), "union").unionByName(tag(c.intersect(s), "intersect")).unionByName(tag(c.exceptAll(s).distinct(), "except"))


def z_having(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 15")


def z_approx_distinct(spark, sf_dir):
    """Whether the sketch of distinct parts lies within three of its standard errors of their number."""
    n = _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.count_distinct("l_partkey").alias("parts"))
    return n.select("l_returnflag", "parts", (F.abs(F.col("a") - F.col("parts")) <= 0.06 * F.col("parts")).alias("close"))


def z_percentile(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.percentile("o_totalprice", F.lit(0.5)), 4).alias("median"))


def z_pivot(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


def z_tumbling(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def z_sliding(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def z_session(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


QUERIES = {f.__name__: f for f in (z_hash_join, z_pricing_summary, z_semi_anti, z_asof, z_window_rank, z_window_frame, z_rollup, z_cube, z_set_ops, z_having, z_approx_distinct, z_percentile, z_pivot, z_tumbling, z_sliding, z_session)}

SQL = {
    "z_hash_join": "SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "z_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "z_semi_anti": "SELECT CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'with' ELSE 'without' END AS kind, c_nationkey, count(*) AS n FROM customer GROUP BY ALL",
    "z_asof": "WITH r AS (SELECT user_id, ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY ALL) SELECT l.event_id, r.click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts",
    "z_window_rank": "SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer QUALIFY r <= 3",
    "z_window_frame": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM events",
    "z_rollup": "SELECT p_brand, p_type, count(*) AS n, max(p_size)::BIGINT AS largest FROM part GROUP BY ROLLUP (p_brand, p_type)",
    "z_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "z_set_ops": "SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', k FROM (SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier))",
    "z_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL HAVING n > 15",
    "z_approx_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS close FROM lineitem GROUP BY ALL",
    "z_percentile": "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS median FROM orders GROUP BY ALL",
    "z_pivot": "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY ALL",
    "z_tumbling": "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "z_sliding": "SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts)::TIMESTAMP, date_trunc('hour', ts)::TIMESTAMP - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY ALL",
    "z_session": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, sid",
}
#: The windows of streams give what those of tables do.
SQL |= {"stream_tumbling": SQL["z_tumbling"], "stream_sliding": SQL["z_sliding"], "stream_session": SQL["z_session"]}
