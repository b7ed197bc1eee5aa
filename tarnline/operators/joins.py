"""Joins beyond equality: as-of, range and theta joins that shuffle by key and scale with their input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], tolerance: Column | None = None, width: int = 86400) -> DataFrame:
    """Each row of left with `values` of right's last row of the same `by` at or before its `on`, null if there is none.

    Keys are dealt with their stretch of time, `width` seconds long, so that a hot key is many groups: in each a running last value over both sides finds
    the match, and where a stretch has none yet, the last of the stretches before is carried in, of which there is one row a stretch. Linear in rows,
    without a join on an inequality. `on` is a timestamp or date. With a tolerance (an interval), older matches count as none. Of right's rows of the
    same key and time, the one of greatest values wins. Rows of left are all kept; null keys match null keys, null times nothing. No name in values may
    be one of left's.
    """
    clash = set(values) & set(left.columns)
    if clash:
        raise ValueError(f"names on both sides: {sorted(clash)}")
    keys = [F.col(k).alias(f"__by{n}") for n, k in enumerate(by)]
    names = [f"__by{n}" for n in range(len(by))]
    stretch = F.floor(F.unix_seconds(F.col(on).cast("timestamp")) / F.lit(width)).alias("__at")
    none = F.lit(None)
    a = left.select(*keys, stretch, F.col(on).alias("__on"), F.struct(*left.columns).alias("row"), F.lit(1).alias("side"))
    r = right.where(F.col(on).isNotNull()).select(*keys, stretch, F.col(on).alias("__on"), F.struct(F.col(on).alias("at"), *values).alias("match"), F.lit(0).alias("side"))
    both = a.withColumn("match", none.cast(r.schema["match"].dataType)).unionByName(r.withColumn("row", none.cast(a.schema["row"].dataType)))
    so_far = Window.partitionBy(*names, "__at").orderBy(F.col("__on").asc_nulls_first(), "side", F.col("match").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("match", F.last("match", ignorenulls=True).over(so_far)).where("side = 1")
    # One row a stretch of a key: its last match, and before it those of earlier stretches.
    ends = both.groupBy(*names, "__at").agg(F.max("match").alias("match"))
    before = Window.partitionBy(*names).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*(F.col(n).alias(f"{n}_") for n in (*names, "__at")), F.last("match", ignorenulls=True).over(before).alias("carried"))
    same = F.lit(True)
    for n in (*names, "__at"):
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_"))
    found = seen.join(carried, same, "left").withColumn("match", F.coalesce("match", "carried"))
    fits = F.col("__on").isNotNull()
    if tolerance is not None:
        fits = fits & (F.col("match.at") >= F.col("__on") - tolerance)
    return found.select("row.*", *(F.when(fits, F.col(f"match.{v}")).alias(v) for v in values))


def range_join(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, width: float) -> DataFrame:
    """Pairs of a point and a range with lo <= at < hi, by an equality join on bins of the given width.

    A range is put in each bin it meets, a point in its one, so that each pair meets once. Choose a width near a usual range's
    length: bins a range must be few. at, lo and hi are numbers; rows with nulls among them pair with nothing, as do ranges with hi <= lo.
    """
    bin_of = lambda c: F.floor(F.col(c) / F.lit(float(width)))
    p = points.where(F.col(at).isNotNull()).withColumn("__bin", bin_of(at))
    r = ranges.where(F.col(lo) < F.col(hi)).withColumn("__bin", F.explode(F.sequence(bin_of(lo), bin_of(hi))))
    return p.join(r, "__bin").where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("__bin")


def overlap_join(a: DataFrame, b: DataFrame, lo: tuple[str, str], hi: tuple[str, str], width: float) -> DataFrame:
    """Pairs of ranges that overlap, lo <= x < hi on either side, by an equality join on bins; each pair meets in the first bin that both have.

    lo and hi name a's and b's columns. Ranges with nulls or hi <= lo pair with nothing.
    """
    bin_of = lambda c: F.floor(F.col(c) / F.lit(float(width)))
    put = lambda df, k: df.where(F.col(lo[k]) < F.col(hi[k])).withColumn("__bin", F.explode(F.sequence(bin_of(lo[k]), bin_of(hi[k]))))
    both = put(a, 0).join(put(b, 1), "__bin")
    meet = (F.col(lo[0]) < F.col(hi[1])) & (F.col(lo[1]) < F.col(hi[0]))
    return both.where(meet & (F.col("__bin") == F.greatest(bin_of(lo[0]), bin_of(lo[1])))).drop("__bin")


def theta_join(big: DataFrame, small: DataFrame, condition: Column, how: str = "inner", most: int = 10_000) -> DataFrame:
    """A join on any condition, whose small side is sent to every task; it is counted first, and above `most` rows the join fails.

    For a side without such a bound use range_join or overlap_join.
    """
    n = small.limit(most + 1).count()
    if n > most:
        raise ValueError(f"the small side of a theta join has more than {most} rows")
    return big.join(F.broadcast(small), condition, how)


def salted_join(big: DataFrame, small: DataFrame, on: str, salts: int = 16) -> DataFrame:
    """Inner equality join whose hot keys are dealt over `salts` partitions: small is repeated so often, big is not.

    Always a sort-merge join: the planner's size of small leaves the repeats out, so that it would broadcast what no driver can hold.
    """
    s = F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")
    many = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("__salt", s).join(many.hint("merge"), [on, "__salt"]).drop("__salt")
