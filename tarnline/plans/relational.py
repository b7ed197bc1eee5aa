"""Queries over the star schema and events, one or more for each category of operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnline.functions.text import fraction, host, words
from tarnline.functions.vectors import cosine
from tarnline.operators.joins import asof_join, range_join, salted_join
from tarnline.operators.windows import percentiles as exact_percentiles
from tarnline.operators.windows import sessions, top_k, tumbling
from tarnline.plans.registry import query
from tarnline.sources.tables import table


@query(
    "filter_project",
    """SELECT o_orderkey, upper(o_orderpriority) AS priority, o_totalprice / 2 AS half, CAST(year(o_orderdate) AS INTEGER) AS y
       FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000""",
)
def filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars over a scan whose filter and columns reach Parquet."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 100000")
    return o.select("o_orderkey", F.upper("o_orderpriority").alias("priority"), (F.col("o_totalprice") / 2).alias("half"), F.year("o_orderdate").alias("y"))


@query(
    "case_when_dates",
    """SELECT CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'high' END AS band,
         CAST(month(o_orderdate) AS INTEGER) AS m, count(*) AS n, max(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)) AS latest
       FROM orders GROUP BY 1, 2""",
)
def case_when_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    o = table(spark, sf_dir, "orders").select(F.when(p < 50000, "low").when(p < 200000, "mid").otherwise("high").alias("band"), F.month("o_orderdate").alias("m"), "o_orderdate")
    return o.groupBy("band", "m").agg(F.count("*").alias("n"), F.max(F.date_diff("o_orderdate", F.lit("1995-01-01").cast("date"))).cast("long").alias("latest"))


@query(
    "star_join",
    """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
         JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 2""",
)
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact table with dimensions; nation and region have fixed sizes, the rest is Spark's choice."""
    dims = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(dims), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("left_join", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are counted before the join, so that it moves one row a customer."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("full_outer_join", "SELECT s_nationkey AS s_nation, c_nationkey AS c_nation, n_s, n_c FROM (SELECT s_nationkey, count(*) AS n_s FROM supplier GROUP BY 1) FULL JOIN (SELECT c_nationkey, count(*) AS n_c FROM customer WHERE c_acctbal > 9500 GROUP BY 1) ON s_nationkey = c_nationkey")
def full_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("s_nation")).agg(F.count("*").alias("n_s"))
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("c_nation")).agg(F.count("*").alias("n_c"))
    return s.join(c, F.col("s_nation") == F.col("c_nation"), "full")


@query("semi_join", "SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 50)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(big, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("anti_join", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query(
    "range_join",
    """SELECT p_size_lo, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part
       JOIN (SELECT DISTINCT p_size AS p_size_lo, p_size + 3 AS p_size_hi FROM part) r ON p_size >= p_size_lo AND p_size < p_size_hi GROUP BY 1""",
)
def range_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by overlapping ranges of size, in bins."""
    part = table(spark, sf_dir, "part")
    ranges = part.select(F.col("p_size").alias("p_size_lo"), (F.col("p_size") + 3).alias("p_size_hi")).distinct()
    return range_join(part.select("p_size", "p_retailprice"), ranges, "p_size", "p_size_lo", "p_size_hi", 3).groupBy("p_size_lo").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query(
    "asof_join",
    """WITH v AS (SELECT user_id, ts, max(value) AS last_view FROM events WHERE event_type = 'view' GROUP BY 1, 2)
       SELECT p.event_id, p.user_id, v.last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p
       ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def asof_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's latest view before it."""
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("last_view"))
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return asof_join(buys, views, "ts", ["user_id"], ["last_view"]).select("event_id", "user_id", "last_view")


@query("salted_join", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def salted_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    return salted_join(o, c, "k").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query(
    "aggregates",
    """SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, round(stddev_samp(l_quantity), 4) AS sd, min(l_shipdate) AS first_ship,
         max(l_extendedprice) AS top_price, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT AS discounted, bool_or(l_tax > 0.079) AS taxed
       FROM lineitem GROUP BY 1""",
)
def aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.countDistinct("l_suppkey").alias("suppliers"), F.round(F.stddev_samp("l_quantity"), 4).alias("sd"), F.min("l_shipdate").alias("first_ship"),
        F.max("l_extendedprice").alias("top_price"), F.sum(F.when(F.col("l_discount") > 0.05, 1).otherwise(0)).alias("discounted"), F.bool_or(F.col("l_tax") > 0.079).alias("taxed"),
    )


@query(
    "percentiles",
    "SELECT l_linestatus, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1",
)
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, by a sketch that brackets them: no task holds a group's prices."""
    p = exact_percentiles(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_extendedprice", [0.5, 0.9])
    return p.select("l_linestatus", F.round(F.col("p")[0], 4).alias("median"), F.round(F.col("p")[1], 4).alias("p90"))


@query(
    "rollup",
    "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) + grouping(l_linestatus) AS BIGINT) AS depth, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
)
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus")
    return r.agg((F.grouping("l_returnflag").cast("long") + F.grouping("l_linestatus").cast("long")).alias("depth"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("cube", "SELECT event_type, CAST(day(ts) AS INTEGER) AS d, count(*) AS n FROM events GROUP BY CUBE (event_type, CAST(day(ts) AS INTEGER))")
def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", F.dayofmonth("ts").alias("d")).cube("event_type", "d").agg(F.count("*").alias("n"))


@query("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a, b = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.groupingSets([[a], [b], []], a, b).agg(F.count("*").alias("n"))


@query(
    "window_functions",
    """SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS dr,
         lag(o_totalprice) OVER w AS previous, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running,
         CAST(ntile(4) OVER w AS INTEGER) AS quarter
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def window_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several functions over one partitioning: one shuffle."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.row_number().over(w).alias("rn"), F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("dr"),
        F.lag("o_totalprice").over(w).alias("previous"), F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.ntile(4).over(w).alias("quarter"),
    )


@query(
    "top_k_per_group",
    "SELECT c_nationkey, c_custkey, c_acctbal, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3",
)
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "c_acctbal", "rank")


@query("sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(5).limit(20)


@query("set_intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("set_except_all", "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def set_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).exceptAll(table(spark, sf_dir, "customer").select("c_custkey"))


@query("union_distinct", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf_dir, "region").select("r_name")).distinct()


@query(
    "pivot",
    """SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks,
         count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY 1""",
)
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the values given, a pivot is one pass."""
    p = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).count()
    return p.select("user_id", *(F.coalesce(a, F.lit(0)).alias(b) for a, b in (("view", "views"), ("click", "clicks"), ("purchase", "purchases"))))


@query("unpivot", "SELECT s_suppkey, measure, amount FROM (SELECT s_suppkey, s_acctbal, CAST(s_nationkey AS DOUBLE) AS nation FROM supplier) UNPIVOT (amount FOR measure IN (s_acctbal, nation))")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("nation"))
    return s.unpivot("s_suppkey", ["s_acctbal", "nation"], "measure", "amount")


@query(
    "correlated_subquery",
    "SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > 1.5 * (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
)
def correlated_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar subquery as a window: no join."""
    mean = F.avg("o_totalprice").over(Window.partitionBy("o_custkey"))
    return table(spark, sf_dir, "orders").withColumn("m", mean).where(F.col("o_totalprice") > 1.5 * F.col("m")).select("o_orderkey", "o_totalprice")


@query(
    "tumbling_windows",
    "SELECT time_bucket(INTERVAL 1 DAY, ts) AS bucket, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
)
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling(table(spark, sf_dir, "events"), "ts", 86400).groupBy("bucket", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "sessions",
    """WITH m AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events),
       n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM m)
       SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events FROM n GROUP BY user_id, s""",
)
def sessions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"), "user_id", "ts", 6 * 3600)


@query("json_fields", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query(
    "array_functions",
    """SELECT vec_id, len(embedding) AS dims, round(list_max(embedding), 6) AS top, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS mass FROM embeddings""",
)
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mass = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dims"), F.round(F.array_max("embedding"), 6).alias("top"), F.round(mass, 6).alias("mass"))


@query(
    "vector_similarity",
    """SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM embeddings""",
)
def vector_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors against a single probe row, which a scalar subquery reads; nulls where there is none."""
    e = table(spark, sf_dir, "embeddings")
    probe = e.where("vec_id = 0").select("embedding").limit(1).scalar()
    return e.select("vec_id", "embedding", probe.alias("probe")).select("vec_id", F.round(cosine(F.col("embedding"), F.col("probe")), 6).alias("similarity"))


@query(
    "text_statistics",
    r"""SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars, sum(len(list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda w: w <> '')))::BIGINT AS words,
         round(avg(1 - length(regexp_replace(text, '[0-9]', '', 'g')) / length(text)), 6) AS digits FROM documents GROUP BY 1""",
)
def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length(t)).alias("chars"), F.sum(F.size(words(t))).alias("words"), F.round(F.avg(fraction(t, "[0-9]")), 6).alias("digits"))


@query("url_hosts", "SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1")
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("ordered_strings", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def ordered_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["role"]), ">").alias("roles"))
