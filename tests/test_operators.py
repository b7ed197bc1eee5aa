"""General operators on small frames, and the entry's contract."""

import random
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarnline.functions.vectors import cosine, dot, euclidean
from tarnline.functions.user import geometric_mean
from tarnline.operators.joins import asof_join, overlap_join, range_join, salted_join, theta_join
from tarnline.operators.windows import percentiles, sessions, top_k
from tarnline.sources.calendar import CalendarReader
from tarnline.sources.shared import shared_dir, sunk
from tarnline.sources.tables import table
from tarnline.streaming import events

T0 = datetime(2024, 1, 1)
REPO = Path(__file__).resolve().parent.parent


def at(minutes):
    return None if minutes is None else T0 + timedelta(minutes=minutes)


def test_asof_join(spark):
    left = spark.createDataFrame([(1, "a", at(5)), (2, "a", at(0)), (3, "b", at(9)), (4, None, at(9)), (5, "a", None), (6, "a", at(100))], "id int, k string, ts timestamp_ntz")
    right = spark.createDataFrame([("a", at(1), 1.0), ("a", at(5), 2.0), ("a", at(5), 3.0), ("c", at(1), 9.0), (None, at(2), 7.0), ("a", None, 5.0)], "k string, ts timestamp_ntz, v double")
    assert {r.id: r.v for r in asof_join(left, right, "ts", ["k"], ["v"]).collect()} == {1: 3.0, 2: None, 3: None, 4: 7.0, 5: None, 6: 3.0}
    near = asof_join(left, right, "ts", ["k"], ["v"], F.expr("INTERVAL 10 MINUTES"))
    assert {r.id: r.v for r in near.collect()}[6] is None
    with pytest.raises(ValueError):
        asof_join(left, right, "ts", ["k"], ["id"])


def test_asof_join_over_stretches(spark):
    """Matches from stretches far before, however narrow the stretches are."""
    rng = random.Random(2)
    left = [(k, rng.choice(["a", "b", None]), at(rng.randrange(5000)), "x") for k in range(300)]
    right = [(rng.choice(["a", "b", None]), at(rng.choice([10, 700, 4000]) + rng.randrange(60)), float(k)) for k in range(80)]
    a = spark.createDataFrame(left, "id int, k string, ts timestamp_ntz, match string")
    b = spark.createDataFrame(right, "k string, ts timestamp_ntz, v double")
    for width in (60, 3600, 10**7):
        got = {r.id: r.v for r in asof_join(a, b, "ts", ["k"], ["v"], width=width).collect()}
        assert got == {i: max(((t, v) for key, t, v in right if key == k and t <= ts), default=(None, None))[1] for i, k, ts, _ in left}


def test_overlap_and_theta_joins(spark):
    rng = random.Random(4)
    a = [(k, float(x), x + rng.choice([0.0, 1.0, 25.0])) for k, x in enumerate(rng.sample(range(-100, 100), 60))] + [(99, None, 3.0)]
    b = [(k, float(x), x + rng.choice([0.5, 9.0])) for k, x in enumerate(rng.sample(range(-100, 100), 60))]
    p, q = spark.createDataFrame(a, "i int, lo double, hi double"), spark.createDataFrame(b, "j int, lo2 double, hi2 double")
    expected = sorted((i, j) for i, lo, hi in a for j, lo2, hi2 in b if lo is not None and lo < hi and lo < hi2 and lo2 < hi)
    assert sorted((r.i, r.j) for r in overlap_join(p, q, ("lo", "lo2"), ("hi", "hi2"), 7).collect()) == expected
    assert theta_join(p, q, F.col("lo") < F.col("lo2"), "left").count() == sum(max(1, sum(lo is not None and lo < x for _, x, _ in b)) for _, lo, _ in a)
    with pytest.raises(ValueError):
        theta_join(p, q, F.lit(True), most=59)


@pytest.mark.parametrize("n", [1, 2, 7, 5000])
def test_percentiles(spark, n):
    rng = random.Random(n)
    rows = [(k, rng.choice([rng.gauss(0, 9), 3.0, None if n > 7 else 1.0])) for k in ("a", None) for _ in range(n)] + [("z", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    shares = [0.0, 0.25, 0.5, 0.999, 1.0]
    got = {r.k: r.p for r in percentiles(df, ["k"], "x", shares).collect()}
    for k in ("a", None):
        x = sorted(v for key, v in rows if key == k and v is not None)
        for q, p in zip(shares, got[k], strict=True):
            r = q * (len(x) - 1)
            low = x[int(r)]
            assert abs(p - (low + (r - int(r)) * (x[min(len(x) - 1, int(r) + 1)] - low))) < 1e-9
    assert set(got) == {"a", None} and percentiles(df.limit(0), ["k"], "x", shares).count() == 0
    whole = percentiles(df, [], "x", [0.5]).first().p[0]
    assert whole == pytest.approx(float(df.agg(F.percentile("x", 0.5)).first()[0]))


def test_sessions_over_stretches(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), at(rng.randrange(4000))) for _ in range(300)] + [("a", at(7)), ("a", at(7))]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz")
    expected = []
    for k in "ab":
        run = []
        for t in sorted(t for key, t in rows if key == k):
            if run and t - run[-1] > timedelta(minutes=20):
                expected.append((k, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        expected.append((k, run[0], run[-1], len(run)))
    for width in (60, 600, 86400):
        assert sorted(tuple(r) for r in sessions(df, "k", "ts", 1200, width).collect()) == sorted(expected)


def test_geometric_mean(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 8.0), ("a", None), ("b", -1.0), (None, 5.0)], "k string, x double").repartition(3)
    got = {r.k: r["mean"] for r in geometric_mean(df, "k", "x").collect()}
    assert got["a"] == pytest.approx(4) and got["b"] is None and got[None] == pytest.approx(5)


def test_sinks(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", None), (3, None, 2.5)], "id long, k string, x double")
    for kind in ("parquet", "orc", "json"):
        assert sorted(map(tuple, sunk(df, kind, ("k",)).collect()), key=str) == sorted(map(tuple, df.select("id", "x", "k").collect()), key=str) or sorted(map(tuple, sunk(df, kind, ("k",)).select("id", "k", "x").collect())) == sorted(map(tuple, df.collect()))
    plan = sunk(df, "parquet", ("k",)).where("k = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(k" in plan


def test_calendar_source():
    days = CalendarReader({"start": "2024-02-27", "end": "2024-03-02", "days": "2"})
    rows = [r for p in days.partitions() for r in days.read(p)]
    assert len(days.partitions()) == 3 and [r[0].day for r in rows] == [27, 28, 29, 1, 2] and [r[4] for r in rows] == [False] * 4 + [True]
    with pytest.raises(ValueError):
        CalendarReader({"start": "2024-02-27", "end": "2024-02-01"})


def test_range_join(spark):
    points = spark.createDataFrame([(k, float(k)) for k in range(-5, 30)] + [(99, None)], "id int, x double")
    ranges = spark.createDataFrame([("r", 0.0, 7.5), ("s", 3.0, 3.0), ("t", -4.5, 21.0), ("u", None, 2.0)], "name string, lo double, hi double")
    got = sorted((r.id, r.name) for r in range_join(points, ranges, "x", "lo", "hi", 4).collect())
    assert got == sorted((k, n) for k in range(-5, 30) for n, lo, hi in (("r", 0, 7.5), ("t", -4.5, 21)) if lo <= k < hi)


def test_salted_join(spark):
    big = spark.createDataFrame([(1, k) for k in range(200)] + [(2, 1), (None, 5)], "k int, x int")
    small = spark.createDataFrame([(1, "one"), (3, "three")], "k int, name string")
    assert salted_join(big, small, "k").count() == 200


def test_salted_join_broadcasts_nothing(spark):
    """The repeated side is larger than the planner takes it to be."""
    big, small = spark.range(2000).select((F.col("id") % 50).alias("k"), "id"), spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    got = salted_join(big, small, "k")
    assert sorted(got.collect()) == [(k, i, 2 * k) for k in range(40) for i in range(k, 2000, 50)]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_sessions_and_top_k(spark):
    e = spark.createDataFrame([("a", at(m)) for m in (0, 1, 20, 21, 22)] + [("b", at(3)), ("b", None)], "k string, ts timestamp_ntz")
    assert sorted((r.k, r.n_events) for r in sessions(e, "k", "ts", 600).collect()) == [("a", 2), ("a", 3), ("b", 1)]
    assert sorted((r.k, r["rank"]) for r in top_k(e, ["k"], [F.col("ts").desc()], 2).collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    rows = df.select(dot(F.col("a"), F.col("b")).alias("d"), cosine(F.col("a"), F.col("b")).alias("c"), euclidean(F.col("a"), F.col("b")).alias("e")).collect()
    assert rows[0].d == 11 and abs(rows[0].c - 11 / 125**0.5) < 1e-12 and abs(rows[0].e - 8**0.5) < 1e-12
    assert rows[1].c is None and rows[2].d is None


def test_table_names(spark):
    with pytest.raises(ValueError):
        table(spark, "/nowhere", "users")


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(k % 40, T0 + timedelta(minutes=k), 1, "view" if k % 2 else "click", 1.0, "{}") for k in range(600)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / "events.parquet"))
    frame = spark.read.parquet(str(src / "events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))
    batch = events.windowed_counts(frame)
    assert batch.count() == 20 and batch.agg(F.sum("n")).first()[0] == 600
    stream = spark.readStream.schema(spark.read.parquet(str(src / "events.parquet")).schema).parquet(str(src / "events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))
    events.drain(events.windowed_counts(stream), str(tmp_path / "c1"), str(tmp_path / "o1"))
    out = spark.read.parquet(str(tmp_path / "o1"))
    assert 0 < out.count() <= 20 and {r.n for r in out.collect()} == {30}


def batches(spark, folder, parts, schema):
    """A stream that reads one part a batch."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "events.parquet"))
    return events.read_events(spark, str(folder), 1)


SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_late_rows(spark, tmp_path):
    """A row later than the watermark allows is left out of windows; repeats within it are dropped."""
    spark.conf.set("spark.sql.streaming.stateStore.stateSchemaCheck", "true")
    row = lambda i, m: (i, at(m), i % 3, "view", 1.0, "{}")
    parts = [[row(1, 10), row(2, 70)], [row(3, 200), row(3, 200)], [row(4, 20), row(5, 198), row(3, 200)], [row(6, 400)]]
    stream = batches(spark, tmp_path / "in", parts, SCHEMA)
    shared = shared_dir(spark)
    got = {r.window_start.hour: r.n for r in events.drained(events.windowed_counts(stream), f"{shared}/w").collect()}
    assert got == {0: 1, 1: 1, 3: 4}  # the row of minute 20 came after the watermark of minute 190
    kept = sorted(r.event_id for r in events.drained(events.deduplicated(stream).select("event_id"), f"{shared}/d").collect())
    assert kept == [1, 2, 3, 5, 6]


def test_running_totals(spark, tmp_path):
    rng = random.Random(1)
    parts = [[(10 * b + k, at(b * 60 + k), rng.randrange(4), "view", float(rng.randrange(9)), "{}") for k in range(10)] for b in range(4)]
    out = events.drained(events.running_totals(batches(spark, tmp_path / "in", parts, SCHEMA)), shared_dir(spark)).collect()
    for user in range(4):
        mine = [r[4] for p in parts for r in p if r[2] == user]
        last = max((r for r in out if r.user_id == user), key=lambda r: r.n)
        assert (last.n, last.total) == (len(mine), sum(mine))
        assert len([r for r in out if r.user_id == user]) == sum(any(r[2] == user for r in p) for p in parts)


@pytest.mark.parametrize("missing", ["tarnline.llm", "zstandard", "corpus_pipeline"])
def test_entry_without_llm(tmp_path, missing):
    """The entry works where the llm folders, a library that they need, or the pipeline are gone."""
    for name in ("__spark_entry__.py", "tarnline", "corpus_pipeline.py"):
        (tmp_path / name).symlink_to(REPO / name)
    code = f"import sys; sys.modules[{missing!r}] = None\nimport __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and set(s) <= set(q) and 'pipeline' not in q and any(n.startswith('op1_') for n in q) == ({missing!r} == 'corpus_pipeline')"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_llm_is_imported_by_nothing_else():
    for path in (REPO / "tarnline").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tarnline.llm" not in path.read_text()
