"""Histories over blocks of the timeline and values as of a time, against brute force."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterlight.operators import timeseries


def brute_others(rows, n):
    """rows: (id, t, entity). Ids of the last n rows of other entities before each row."""
    line = sorted(rows, key=lambda r: (r[1], r[0]))
    return {r[0]: [x[0] for x in line[:i] if x[2] != r[2]][-n:] for i, r in enumerate(line)}


def runs_of_one(rng):
    """Long stretches of one entity, so that many blocks' tails reach far back."""
    out = []
    for e, length in ((1, 3), (2, 90), (None, 60), (3, 1), (2, 40), (4, 70)):
        out += [e] * length
    return [(i, int(i // 3), e) for i, e in enumerate(out)]


@pytest.mark.parametrize("block_rows", [7, 40, 100_000])
@pytest.mark.parametrize("kind", ["many", "few", "runs"])
def test_other_history_equals_brute_force(spark, kind, block_rows):
    rng = np.random.default_rng(7)
    if kind == "runs":
        rows = runs_of_one(rng)
    else:
        rows = [(i, int(rng.integers(0, 90)), int(rng.integers(0, 50 if kind == "many" else 2))) for i in range(260)]
    df = spark.createDataFrame(rows, "id long, t int, c int").withColumn("more", F.lit("x"))
    got = timeseries.other_history(df, ["id", "more"], 5, "c", ["t", "id"], block_rows=block_rows).collect()
    assert len(got) == len(rows) and all(x["more"] == "x" for r in got for x in r.others)
    assert {r.id: [x["id"] for x in r.others] for r in got} == brute_others(rows, 5)


def test_other_history_of_nothing_and_one(spark):
    empty = spark.createDataFrame([], "id long, t int, c int")
    assert timeseries.other_history(empty, ["id"], 3, "c", ["t", "id"]).collect() == []
    one = spark.createDataFrame([(1, 1, 1)], "id long, t int, c int")
    assert [list(r.others) for r in timeseries.other_history(one, ["id"], 3, "c", ["t", "id"]).collect()] == [[]]


def test_rows_meet_one_place(spark):
    """No row is copied for other entities: what the blocks read is the table and, for each block, 2n rows."""
    rows = [(i, i, i % 50) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, t int, c int")
    out = timeseries.other_history(df, ["id"], 4, "c", ["t", "id"], block_rows=250)
    assert out.count() == 2000
    carried = timeseries._carried(df.limit(0).select(F.lit(1).alias("block"), F.array(F.struct(F.col("c").alias("_e"))).alias("tail")), 8, 4)
    assert carried.count() == 8 and carried.filter(F.size("tail") > 8).isEmpty()


def facts_and_grid(spark, kind):
    rng = np.random.default_rng(4)
    places = sorted({(int(rng.integers(0, 3)), f"k{int(rng.integers(0, 6))}", int(rng.integers(0, 400))) for _ in range(600)})
    facts = [(c, k, t, float(i)) for i, (c, k, t) in enumerate(places)] + [(0, None, 5, 1.0), (None, "k1", 5, 1.0), (1, "k1", None, 1.0), (2, "late", 399, None)]
    grid = sorted({(int(rng.integers(0, 4)), int(rng.integers(0, 420))) for _ in range(150)}) + [(0, None)]
    if kind == "date":
        day = lambda t: None if t is None else datetime.date(1969, 12, 1) + datetime.timedelta(days=t)
        facts, grid = [(c, k, day(t), v) for c, k, t, v in facts], [(c, day(t)) for c, t in grid]
    return facts, grid, spark.createDataFrame(facts, f"c int, k string, t {kind}, v double"), spark.createDataFrame(grid, f"c int, t {kind}")


@pytest.mark.parametrize("kind,width", [("int", 1), ("int", 30), ("date", 31), ("date", 1000)])
def test_asof_grid_equals_brute_force(spark, kind, width):
    facts, grid, f, g = facts_and_grid(spark, kind)
    got = {(r.c, r.t): {k: (v.value, v.year if kind == "x" else v["year"]) for k, v in r.latest.items()} for r in timeseries.asof_grid(f, g, ["c"], "k", "t", "v", width).collect()}
    want = {}
    for c, t in grid:
        latest = {}
        for a, k, s, v in facts:
            if a is not None and a == c and k is not None and s is not None and t is not None and s <= t and (k not in latest or latest[k][1] < s):
                latest[k] = (v, s)
        if latest:
            want[(c, t)] = latest
    assert got == want


def test_asof_rows_joined_are_near_rows_returned(spark):
    """A long history: 50 keys that change each day for 400 days, looked at on 40 days."""
    facts = spark.range(50 * 400).select(F.lit(1).alias("c"), (F.col("id") % 50).cast("string").alias("k"), F.floor(F.col("id") / 50).cast("int").alias("t"), F.col("id").cast("double").alias("v"))
    grid = spark.range(40).select(F.lit(1).alias("c"), (F.col("id") * 10).cast("int").alias("t"))
    returned = timeseries.asof_intervals(facts, grid, ["c"], "k", "t", 1)
    assert returned.count() == 50 * 40
    whole_history = facts.join(grid.withColumnRenamed("t", "at"), "c").filter("t <= at").count()
    assert whole_history > 180_000


def test_asof_join_counts_what_meets(spark):
    """Rows that meet before the times are compared, with blocks of ten days: at most those of the block."""
    facts, grid, f, g = facts_and_grid(spark, "int")
    out = timeseries.asof_intervals(f, g, ["c"], "k", "t", 10)
    met = out.count()
    spans = {}
    for c, k, t, _ in facts:
        if None not in (c, k, t):
            spans.setdefault((c, k), []).append(t)
    close = 0
    for c, t in {x for x in grid if x[1] is not None}:
        for (a, _), times in spans.items():
            times.sort()
            close += a == c and sum(1 for i, s in enumerate(times) if s // 10 <= t // 10 and (i + 1 == len(times) or times[i + 1] > t // 10 * 10))
    assert met <= close <= 2.5 * met
