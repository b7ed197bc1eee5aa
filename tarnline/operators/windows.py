"""Time-series operators over batch frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int, width: int = 86400) -> DataFrame:
    """key, session_start, session_end (the last event), n_events: runs of events of a key less than a gap apart.

    Runs are made within each key's stretches of `width` seconds first, so that a hot key is many groups, and those runs are joined
    across stretches, a few rows a stretch. Events with a null ts are left out, null keys are a key.
    """
    e = events.where(F.col(ts).isNotNull()).select(key, F.col(ts).alias("session_start"), F.col(ts).alias("session_end"), F.lit(1).cast("long").alias("n_events"))
    e = e.withColumn("__at", F.floor(F.unix_seconds(F.col("session_start").cast("timestamp")) / F.lit(width)))
    return _runs(_runs(e, [key, "__at"], gap_seconds).drop("__at"), [key], gap_seconds)


def _runs(parts: DataFrame, keys: list[str], gap_seconds: int) -> DataFrame:
    """Parts of sessions that are no more than a gap after the one before, together."""
    order = Window.partitionBy(*keys).orderBy("session_start", "session_end", "n_events")
    far = F.col("session_start") > F.lag("session_end").over(order) + F.expr(f"INTERVAL {gap_seconds} SECONDS")
    numbered = parts.withColumn("__new", F.coalesce(far, F.lit(False)).cast("int")).withColumn("__n", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__n").agg(F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"), F.sum("n_events").alias("n_events")).drop("__n")


def top_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tumbling(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    """df with bucket, the start of the fixed window that ts lies in, as timestamp_ntz."""
    return df.withColumn("bucket", F.window(ts, f"{seconds} seconds")["start"].cast("timestamp_ntz"))


def percentiles(df: DataFrame, by: list[str], value: str, shares: list[float], slack: float = 2e-4, accuracy: int = 100_000) -> DataFrame:
    """by and p, an array: exact percentiles, interpolated between neighbours, of each group's values that are not null.

    A mergeable sketch brackets each percentile between two values that surely lie on either side; values below the bracket are only counted, those within,
    about 4 * slack of the group, are counted by value and ranked. So no task holds a group's values. Groups of null keys are groups.
    """
    rows = df.where(F.col(value).isNotNull()).select(*(F.col(k).alias(f"__by{n}") for n, k in enumerate(by)), F.col(value).cast("double").alias("x"))
    keys = [f"__by{n}" for n in range(len(by))]
    wide = slack + 2 / accuracy
    ends = [(max(0.0, q - wide), min(1.0, q + wide)) for q in shares]
    around = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("x", [e for pair in ends for e in pair], accuracy).alias("e"), F.min("x").alias("least"), F.max("x").alias("most"))
    # Ranks of the two neighbours, and a bracket that holds both.
    what = [
        F.struct(
            F.lit(k).alias("k"), (F.lit(q) * (F.col("n") - 1)).alias("rank"),
            F.when(F.floor(F.lit(wide) * F.col("n")) < 2, F.col("least")).otherwise(F.col("e")[2 * k]).alias("lo"), F.when(F.floor(F.lit(wide) * F.col("n")) < 2, F.col("most")).otherwise(F.col("e")[2 * k + 1]).alias("hi"),
        )
        for k, q in enumerate(shares)
    ]
    around = around.select(*(F.col(c).alias(f"{c}_") for c in keys), F.explode(F.array(*what)).alias("w")).select(*(f"{c}_" for c in keys), "w.*")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    met = rows.join(around, same) if keys else rows.join(F.broadcast(around))
    spot = F.when(F.col("x") < F.col("lo"), F.lit(None)).otherwise(F.col("x"))
    counted = met.where("x <= hi").groupBy(*keys, "k", "rank", spot.alias("x")).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*keys, "k").orderBy(F.col("x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("to", F.sum("c").over(upto)).withColumn("from", F.col("to") - F.col("c"))
    at = lambda r: F.min(F.when((F.col("from") <= r) & (r < F.col("to")), F.col("x")))
    low, high = F.floor("rank"), F.ceil("rank")
    found = ranked.groupBy(*keys, "k", "rank").agg(at(low).alias("a"), at(high).alias("b"))
    p = F.col("a") + (F.col("rank") - F.floor("rank")) * (F.col("b") - F.col("a"))
    out = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", p.alias("p")))).alias("p"))
    return out.select(*(F.col(f"__by{n}").alias(k) for n, k in enumerate(by)), F.transform("p", lambda x: x["p"]).alias("p"))
