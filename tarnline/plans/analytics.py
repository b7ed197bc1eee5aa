"""More queries by category: subqueries, theta and lateral joins, sketches with their error, window frames, nested types, functions of the user's, sinks, streams."""

from __future__ import annotations


import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnline.functions.user import geometric_mean, shout, word_spans
from tarnline.operators.joins import overlap_join, theta_join
from tarnline.plans.registry import query
from tarnline.sources.calendar import Calendar
from tarnline.sources.shared import shared_dir, sunk
from tarnline.sources.tables import table
from tarnline.streaming import events as streams


def _views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Tables as arguments of spark.sql."""
    return {n: table(spark, sf_dir, n) for n in names}


# Subqueries and joins.


@query(
    "exists_subqueries",
    """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
         AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')""",
)
def exists_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalyst makes a semi and an anti join of them."""
    text = """SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
         AND NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')"""
    return spark.sql(text, **_views(spark, sf_dir, "customer", "orders"))


@query("in_subquery", "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09) AND p_size IN (1, 5, 9)")
def in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT p_partkey, p_brand FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_discount > 0.09) AND p_size IN (1, 5, 9)"
    return spark.sql(text, **_views(spark, sf_dir, "part", "lineitem"))


@query("scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1.8 * (SELECT avg(o_totalprice) FROM orders)")
def scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.where(F.col("o_totalprice") > 1.8 * o.agg(F.avg("o_totalprice")).scalar()).select("o_orderkey", "o_totalprice")


@query(
    "lateral_join",
    """SELECT n_nationkey, s_suppkey, s_acctbal FROM nation JOIN (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) s
       ON s_nationkey = n_nationkey WHERE r <= 2""",
)
def lateral_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subquery for each row of the left side, with its own order and limit."""
    text = """SELECT n_nationkey, s_suppkey, s_acctbal FROM {nation},
         LATERAL (SELECT s_suppkey, s_acctbal FROM {supplier} WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 2)"""
    return spark.sql(text, **_views(spark, sf_dir, "nation", "supplier"))


@query(
    "theta_join",
    """SELECT band, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer
       JOIN (VALUES ('debt', -1e9, 0.0), ('small', 0.0, 2500.0), ('medium', 2500.0, 7500.0), ('large', 7500.0, 1e9), ('any', -1e9, 1e9)) b(band, lo, hi) ON c_acctbal >= lo AND c_acctbal < hi GROUP BY 1""",
)
def theta_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on inequalities with a side of a few rows, whose size is checked."""
    bands = spark.createDataFrame([("debt", -1e9, 0.0), ("small", 0.0, 2500.0), ("medium", 2500.0, 7500.0), ("large", 7500.0, 1e9), ("any", -1e9, 1e9)], "band string, lo double, hi double")
    both = theta_join(table(spark, sf_dir, "customer").select("c_acctbal"), bands, (F.col("c_acctbal") >= F.col("lo")) & (F.col("c_acctbal") < F.col("hi")))
    return both.groupBy("band").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query(
    "overlap_join",
    """WITH s AS (SELECT s_suppkey, s_acctbal AS lo, s_acctbal + 40 AS hi FROM supplier), c AS (SELECT c_custkey, c_acctbal AS lo2, c_acctbal + 25 AS hi2 FROM customer)
       SELECT s_suppkey, count(*) AS n FROM s JOIN c ON lo < hi2 AND lo2 < hi GROUP BY 1""",
)
def overlap_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that overlap, found in bins."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 40).alias("hi"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("lo2"), (F.col("c_acctbal") + 25).alias("hi2"))
    return overlap_join(s, c, ("lo", "lo2"), ("hi", "hi2"), 50).groupBy("s_suppkey").agg(F.count("*").alias("n"))


# Set operations.


@query("set_intersect_all", "SELECT o_custkey AS k FROM orders INTERSECT ALL SELECT c_custkey FROM (SELECT c_custkey FROM customer UNION ALL SELECT c_custkey FROM customer)")
def set_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).intersectAll(c.unionAll(c))


@query("set_except_distinct", "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def set_except_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).subtract(table(spark, sf_dir, "lineitem").select("l_orderkey"))


# Aggregates and sketches.


@query(
    "more_aggregates",
    """SELECT o_orderpriority, max(o_totalprice) AS top, arg_max(o_orderkey, o_totalprice) AS top_order, round(corr(o_totalprice, o_custkey), 6) AS r, round(covar_pop(o_totalprice, o_custkey) / 1e6, 4) AS cov,
         round(skewness(o_totalprice), 3) > -9 AS has_skew, count(*) FILTER (o_orderstatus = 'F') AS filled, bool_and(o_totalprice > 0) AS positive, round(regr_slope(o_totalprice, o_custkey), 4) AS slope
       FROM orders GROUP BY 1""",
)
def more_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = F.col("o_totalprice"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.max(p).alias("top"), F.max_by("o_orderkey", p).alias("top_order"), F.round(F.corr(p, k), 6).alias("r"), F.round(F.covar_pop(p, k) / 1e6, 4).alias("cov"), (F.skewness(p) > -9).alias("has_skew"),
        F.count_if(F.col("o_orderstatus") == "F").alias("filled"), F.bool_and(p > 0).alias("positive"), F.round(F.regr_slope(p, k), 4).alias("slope"),
    )


@query("modes", "SELECT user_id, event_type AS most FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1")
def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent value, ties to the least: counts are pre-aggregated, so a group has a row a value."""
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.min(F.struct(-F.col("n"), "event_type"))["event_type"].alias("most"))


@query("sketch_distinct", "SELECT count(DISTINCT user_id) AS users, true AS hll_within, true AS theta_within FROM events")
def sketch_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users by mergeable sketches a day, held against the exact number: within 5 %."""
    e = table(spark, sf_dir, "events")
    days = e.groupBy(F.to_date("ts").alias("d")).agg(F.hll_sketch_agg("user_id").alias("h"), F.theta_sketch_agg("user_id").alias("t"))
    both = days.agg(F.hll_sketch_estimate(F.hll_union_agg("h")).alias("h"), F.theta_sketch_estimate(F.theta_union_agg("t")).alias("t"))
    near = lambda c: F.abs(F.col(c) - F.col("users")) <= 0.05 * F.col("users")
    return e.agg(F.countDistinct("user_id").alias("users")).select("users", both.select("h").scalar().alias("h"), both.select("t").scalar().alias("t")).select("users", near("h").alias("hll_within"), near("t").alias("theta_within"))


@query("sketch_quantiles", "SELECT l_returnflag, count(*) AS n, true AS kll_within, true AS approx_within FROM lineitem GROUP BY 1")
def sketch_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians by a KLL sketch and by percentile_approx; the share of rows below each must be within 2 % of a half."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    found = li.groupBy("l_returnflag").agg(F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("l_extendedprice"), F.lit(0.5)).alias("k"), F.percentile_approx("l_extendedprice", 0.5, 1000).alias("a"))
    below = lambda c: F.abs(F.count_if(F.col("l_extendedprice") <= F.col(c)) / F.count("*") - 0.5) <= 0.02
    return li.join(found, "l_returnflag").groupBy("l_returnflag").agg(F.count("*").alias("n"), below("k").alias("kll_within"), below("a").alias("approx_within"))


# Windows.


@query(
    "window_frames",
    """SELECT o_orderkey, nth_value(o_totalprice, 2) OVER w AS second, round(percent_rank() OVER k, 6) AS pr, round(cume_dist() OVER k, 6) AS cd, first_value(o_orderkey) OVER w AS first_order,
         count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 50000 PRECEDING AND 50000 FOLLOWING) AS near, lead(o_orderkey, 2) OVER w AS later,
         round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), k AS (PARTITION BY o_custkey ORDER BY o_totalprice)""",
)
def window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks, values by place, and frames by rows and by range, over one partitioning."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    k = Window.partitionBy("o_custkey").orderBy("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.nth_value("o_totalprice", 2).over(w).alias("second"), F.round(F.percent_rank().over(k), 6).alias("pr"), F.round(F.cume_dist().over(k), 6).alias("cd"),
        F.first("o_orderkey").over(w).alias("first_order"), F.count("*").over(k.rangeBetween(-50000, 50000)).alias("near"), F.lead("o_orderkey", 2).over(w).alias("later"),
        F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("moving"),
    )


# Strings, dates, arrays, maps, JSON.


@query(
    "string_functions",
    r"""SELECT s_suppkey, CAST(levenshtein(s_name, 'Supplier#000000001') AS INTEGER) AS far, lpad(CAST(s_nationkey AS VARCHAR), 4, '0') AS padded, reverse(s_name) AS back, CAST(strpos(s_name, '#') AS INTEGER) AS at,
         replace(s_name, '0', 'o') AS swapped, translate(s_name, '#S', '-s') AS changed, split_part(s_name, '#', 2) AS number, array_to_string(regexp_extract_all(s_name, '[1-9]'), '') AS digits, md5(s_name) AS digest FROM supplier""",
)
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_name")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.levenshtein(n, F.lit("Supplier#000000001")).alias("far"), F.lpad(F.col("s_nationkey").cast("string"), 4, "0").alias("padded"), F.reverse(n).alias("back"), F.instr(n, "#").alias("at"),
        F.replace(n, F.lit("0"), F.lit("o")).alias("swapped"), F.translate(n, "#S", "-s").alias("changed"), F.split_part(n, F.lit("#"), F.lit(2)).alias("number"),
        F.array_join(F.regexp_extract_all(n, F.lit("([1-9])")), "").alias("digits"), F.md5(n.cast("binary")).alias("digest"),
    )


@query(
    "date_functions",
    """SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS m, CAST(last_day(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS next, CAST(quarter(o_orderdate) AS INTEGER) AS q,
         CAST(isodow(o_orderdate) AS INTEGER) AS dow, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, strftime(o_orderdate, '%Y/%m/%d') AS shown FROM orders""",
)
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.trunc(d, "month").cast("string").alias("m"), F.last_day(d).cast("string").alias("last"), F.add_months(d, 1).cast("string").alias("next"), F.quarter(d).alias("q"), (F.weekday(d) + 1).alias("dow"), F.dayofyear(d).alias("doy"), F.date_format(d, "yyyy/MM/dd").alias("shown"),
    )


@query("explode_words", "SELECT word, count(*) AS n, min(place) AS first_place FROM (SELECT unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS place FROM benchmark) GROUP BY 1")
def explode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of arrays as rows, with their places."""
    w = table(spark, sf_dir, "benchmark").select(F.posexplode(F.split("text", " ")).alias("place", "word"))
    return w.groupBy("word").agg(F.count("*").alias("n"), F.min("place").cast("long").alias("first_place"))


@query(
    "inline_structs",
    "SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) >= 4)",
)
def inline_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows packed into an array of structs a conversation, and unpacked again."""
    packed = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("turns"))
    return packed.where(F.size("turns") >= 4).select("conv_id", F.inline("turns"))


@query("json_structs", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS kv, json_extract_string(props, '$.none') AS missing FROM events")
def json_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON by a schema, and as a variant without one."""
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long, none string").alias("j"), F.parse_json("props").alias("v"))
    return e.select("event_id", F.col("j.k").alias("k"), F.variant_get("v", "$.k", "long").alias("kv"), F.col("j.none").alias("missing"))


@query(
    "map_functions",
    """SELECT user_id, count(*) FILTER (event_type = 'view') AS views, CAST(count(DISTINCT event_type) AS INTEGER) AS kinds, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS names, CAST(2 * count(*) FILTER (event_type = 'error') AS BIGINT) AS double_errors FROM events GROUP BY 1""",
)
def map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    zero = F.lit(0).cast("long")
    return m.select(
        "user_id", F.coalesce(F.try_element_at("m", F.lit("view")), zero).alias("views"), F.size("m").alias("kinds"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("names"),
        F.coalesce(F.try_element_at(F.transform_values(F.map_filter("m", lambda k, v: k == "error"), lambda k, v: 2 * v), F.lit("error")), zero).alias("double_errors"),
    )


@query(
    "array_sets",
    """SELECT a.label AS label, CAST(len(list_intersect(a.ids, b.ids)) AS INTEGER) AS both, CAST(len(list_distinct(list_concat(a.ids, b.ids))) AS INTEGER) AS either
       FROM (SELECT label, list(vec_id % 7) AS ids FROM embeddings GROUP BY 1) a, (SELECT list(DISTINCT vec_id % 7) AS ids FROM embeddings WHERE label < 2) b""",
)
def array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 7).alias("i"))
    some = e.where("label < 2").agg(F.collect_set("i")).scalar()
    a = e.groupBy("label").agg(F.collect_set("i").alias("ids")).select("label", "ids", some.alias("some"))
    return a.select("label", F.size(F.array_intersect("ids", "some")).alias("both"), F.size(F.array_union("ids", "some")).alias("either"))


# Functions of the user's.


@query("scalar_udf", "SELECT r_regionkey, upper(r_name) || '!' AS loud FROM region")
def scalar_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of Arrow arrays: no row passes through Python by itself."""
    return table(spark, sf_dir, "region").select("r_regionkey", shout("r_name").alias("loud"))


@query("aggregate_udf", "SELECT p_brand, round(exp(avg(ln(p_retailprice))), 4) AS gm FROM part GROUP BY 1")
def aggregate_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's aggregate in two phases: sums of logarithms for each part of a group where the rows are, and the geometric mean of those."""
    return geometric_mean(table(spark, sf_dir, "part"), "p_brand", "p_retailprice").select("p_brand", F.round("mean", 4).alias("gm"))


@query(
    "grouped_map_udf",
    """SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER w) / stddev_samp(o_totalprice) OVER w, 6) AS z FROM orders
       WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) WINDOW w AS (PARTITION BY o_custkey)""",
)
def grouped_map_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of whole groups, as Arrow tables; a group is a customer's orders."""

    def scaled(rows: pa.Table) -> pa.Table:
        x = rows["o_totalprice"]
        z = pc.divide(pc.subtract(x, pc.mean(x)), pc.stddev(x, ddof=1)) if len(rows) > 1 else pa.nulls(len(rows), pa.float64())
        return pa.table({"o_orderkey": rows["o_orderkey"], "z": z})

    z = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice").groupBy("o_custkey").applyInArrow(scaled, "o_orderkey long, z double")
    return z.where("z IS NOT NULL").select("o_orderkey", F.round("z", 6).alias("z"))


@query("table_udf", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(r_name, ' ')) AS word FROM region UNION ALL SELECT unnest(string_split(n_name, ' ')) FROM nation) GROUP BY 1")
def table_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function of the user's, called for each row by a lateral join."""
    names = table(spark, sf_dir, "region").select(F.col("r_name").alias("name")).unionAll(table(spark, sf_dir, "nation").select("n_name"))
    return names.lateralJoin(word_spans(F.col("name").outer())).groupBy("word").agg(F.count("*").alias("n"))


# Sinks and sources.


@query("partitioned_sink", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def partitioned_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as ORC in a folder for each status; the filter leaves a folder unread."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return sunk(o, "orc", ("o_orderstatus",)).where("o_orderstatus <> 'P'").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("text_sinks", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal, 'csv' AS kind FROM supplier UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, 'json' FROM supplier")
def text_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return sunk(s, "csv", header="true").withColumn("kind", F.lit("csv")).unionAll(sunk(s, "json").withColumn("kind", F.lit("json")))


@query("python_source", "SELECT weekday, count(*) AS days, sum(n)::BIGINT AS events FROM (SELECT CAST(isodow(ts) AS INTEGER) AS weekday, CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-02-01' GROUP BY 1, 2) GROUP BY 1")
def python_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from a data source in Python, with the events of each."""
    spark.dataSource.register(Calendar)
    days = spark.read.format("calendar").option("start", "2024-01-01").option("end", "2024-01-31").option("days", "10").load()
    n = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("d")).agg(F.count("*").alias("n"))
    return days.join(n, F.col("day") == F.col("d")).groupBy("weekday").agg(F.count("*").alias("days"), F.sum("n").alias("events"))


# Streams, drained to what the sources have now.


@query(
    "streaming_windows",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2
       HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
)
def streaming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed, through a streaming query into files."""
    out = streams.drained(streams.windowed_counts(streams.read_events(spark, sf_dir)), shared_dir(spark))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("streaming_dedup", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream, each event twice, without repeats."""
    e = streams.read_events(spark, sf_dir)
    out = streams.drained(streams.deduplicated(e.unionAll(e)).select("event_id", "event_type"), shared_dir(spark))
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


@query("streaming_totals", "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def streaming_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals with state; a user's last one counts."""
    out = streams.drained(streams.running_totals(streams.read_events(spark, sf_dir)), shared_dir(spark))
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 2).alias("total"))
