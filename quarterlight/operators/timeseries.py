"""Panels of series by entity: resampling, lags, as-of joins, windows of history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterlight.functions.dates import quarter_end, quarter_name
from quarterlight.scratch import stored


def _over(entity: str | Sequence[str], order: str | Sequence[str]):
    return Window.partitionBy(*([entity] if isinstance(entity, str) else entity)).orderBy(*([order] if isinstance(order, str) else order))


def resample_quarter(df: DataFrame, how: Mapping[str, str], entity: str = "entity", ts: str = "ts") -> DataFrame:
    """Rows of days or months to quarters, stamped with the quarter's end.

    how: `mean` or `last` for each column; null values don't count. Quarters
    without rows between an entity's first and last come with nulls.
    """
    day = F.col(ts)
    of = {"mean": lambda c: F.avg(c), "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), day))}
    found = df.groupBy(entity, quarter_end(day).alias("quarter_end")).agg(*[of[h](c).alias(c) for c, h in how.items()])
    grid = (
        found.groupBy(entity).agg(F.min("quarter_end").alias("_a"), F.max("quarter_end").alias("_b"))
        .select(entity, F.explode(F.sequence(F.trunc("_a", "quarter"), F.trunc("_b", "quarter"), F.expr("interval 3 months"))).alias("_q"))
        .select(entity, quarter_end(F.col("_q")).alias("quarter_end"))
    )
    return grid.join(found, [entity, "quarter_end"], "left")


def lagged(column: str, n: int, entity: str = "entity", order: str = "quarter_end") -> Column:
    return F.lag(column, n).over(_over(entity, order))


def yoy_pct(column: str, **by) -> Column:
    """Change over four quarters in per cent; null where either is missing or the base is 0."""
    return (F.try_divide(F.col(column), lagged(column, 4, **by)) - 1) * 100


def qoq_annualized(column: str, **by) -> Column:
    return (F.pow(F.try_divide(F.col(column), lagged(column, 1, **by)), F.lit(4.0)) - 1) * 100


def first_difference(column: str, **by) -> Column:
    return F.col(column) - lagged(column, 1, **by)


def outer_align(long: DataFrame, series: Sequence[str], core: Sequence[str], index: Sequence[str] = ("quarter_end",)) -> DataFrame:
    """Long rows (index, series, value) to one wide row for each index that any series has; rows without a core series go."""
    return long.groupBy(*index).pivot("series", list(series)).agg(F.first("value", ignorenulls=True)).dropna(subset=list(core))


def rate_direction(df: DataFrame, rate: str = "rate", entity: str = "entity", order: str = "ts") -> DataFrame:
    """Adds previous rate and direction: initial, increased, decreased or held."""
    before = F.lag(rate).over(_over(entity, order))
    direction = F.when(before.isNull(), "initial").when(F.col(rate) > before, "increased").when(F.col(rate) < before, "decreased").otherwise("held")
    return df.withColumn("previous", before).withColumn("direction", direction)


def change_points(df: DataFrame, rate: str = "rate", entity: str = "entity", order: str = "ts") -> DataFrame:
    """Rows whose rate differs from the one before; the first stays."""
    before = F.lag(rate).over(_over(entity, order))
    return df.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col(rate))).drop("_before")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str, values: Sequence[str], keep_unmatched: bool = False) -> DataFrame:
    """left with the values of the latest right row at or before its time, for equal `by`.

    Both sides are united and one sorted pass carries the last right row on, so
    the work is linear whatever the number of right rows. Of right rows with
    one time the largest values hold.
    """
    packed = F.struct(F.col(right_ts).alias("_ts"), *values)
    one = right.groupBy(*by, right_ts).agg(F.max(packed).alias("_r")).select(*by, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), "_r", F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_l"))
    two = left.select(*by, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(one.schema["_r"].dataType).alias("_r"), F.struct("*").alias("_l"))
    carried = F.last("_r", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = one.unionByName(two).withColumn("_r", carried).filter("_side = 1")
    out = met if keep_unmatched else met.filter("_r IS NOT NULL")
    return out.select("_l.*", F.col("_r._ts").alias(f"matched_{right_ts}"), *[F.col("_r")[v].alias(v) for v in values])


def asof_intervals(facts: DataFrame, grid: DataFrame, by: Sequence[str], key: str, at: str, width: int) -> DataFrame:
    """(by, at, key, _fact): for each grid row (by, at) and key the facts row that holds then, by joining only rows that meet.

    A fact of a (by, key) holds from its own `at` until that of the next. Time,
    whole numbers or dates, is cut into blocks of `width`; a fact goes to those
    blocks that it reaches and that the grid has, and meets the grid's rows there.
    Facts of one (by, key, at) must be one row; null times and keys hold never.
    """
    day = lambda c: (F.datediff(c, F.lit("1970-01-01").cast("date")) if dict(facts.dtypes)[at] == "date" else F.col(c)).cast("long")
    asked = grid.select(*by, at).filter(F.col(at).isNotNull()).distinct().withColumn("_at", day(at)).withColumn("_block", F.floor(F.col("_at") / width))
    there = asked.groupBy(*by).agg(F.array_sort(F.collect_set("_block")).alias("_blocks"))
    known = facts.filter(F.col(at).isNotNull() & F.col(key).isNotNull())
    spans = known.select(*by, F.col(key), F.struct("*").alias("_fact"), day(at).alias("_from")).withColumn("_to", F.lead("_from").over(_over([*by, key], "_from")))
    reached = lambda b: (b >= F.floor(F.col("_from") / width)) & (F.col("_to").isNull() | (b * width < F.col("_to")))
    dealt = spans.join(there, list(by)).withColumn("_block", F.explode(F.filter("_blocks", reached))).drop("_blocks")
    met = asked.join(dealt, [*by, "_block"]).filter((F.col("_from") <= F.col("_at")) & (F.col("_to").isNull() | (F.col("_at") < F.col("_to"))))
    return met.select(*by, at, key, "_fact")


def asof_grid(facts: DataFrame, grid: DataFrame, by: Sequence[str], key: str, year: str, value: str, width: int = 1) -> DataFrame:
    """For each grid row (by, year) a map from key to the latest (value, year) at or before it; grid rows without any don't come.

    Facts of one (by, key, year) must be one row. A long history isn't met by each
    grid row: see asof_intervals, of which `width` is the block.
    """
    met = asof_intervals(facts.select(*by, key, year, value), grid, by, key, year, width)
    pair = F.struct(F.col(f"_fact.{value}").alias("value"), F.col(f"_fact.{year}").alias("year")).alias("_v")
    return met.select(*by, year, key, pair).groupBy(*by, year).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "_v")))).alias("latest"))


def own_history(df: DataFrame, fields: Sequence[str], n: int, entity: str, order: Sequence[str], name: str = "history") -> DataFrame:
    """Adds the up to n rows of the same entity before each row, oldest first."""
    frame = Window.partitionBy(entity).orderBy(*order).rowsBetween(-n, -1)
    return df.withColumn(name, F.collect_list(F.struct(*fields)).over(frame))


def _tail(rows: Column, n: int) -> Column:
    """Of rows (`_e`, ...), newest first, what is enough to have the last n of all but any one entity: n an entity, 2n in all."""
    seen = lambda x, i: F.size(F.filter(F.slice(rows, F.lit(1), i), lambda y: y["_e"].eqNullSafe(x["_e"]))) < n
    return F.slice(F.filter(rows, seen), 1, 2 * n)


def _carried(blocks: DataFrame, count: int, n: int) -> DataFrame:
    """(block, tail): for each of `count` blocks the tail of all blocks before it, of blocks (block, tail).

    A tail of 2n rows needs nothing from before; only blocks whose tail is
    shorter look back, one block, then two, four and so on further.
    """
    spark = blocks.sparkSession
    every = spark.range(count).select(F.col("id").cast("int").alias("block"))
    empty = F.array().cast(blocks.schema["tail"].dataType)
    now = stored(every.join(blocks, "block", "left").select("block", F.coalesce("tail", empty).alias("tail")), "tails")
    step = 1
    while step < count:
        short = (F.size("tail") < 2 * n) & (F.col("block") >= step)
        if now.filter(short).isEmpty():
            break
        before = now.select((F.col("block") + step).alias("block"), F.col("tail").alias("_old"))
        met = now.filter(short).join(before, "block").withColumn("_all", F.concat("tail", "_old"))
        now = stored(now.filter(~short).unionByName(met.select("block", _tail(F.col("_all"), n).alias("tail"))), "tails")
        step *= 2
    return now.select((F.col("block") + 1).alias("block"), "tail")


def other_history(df: DataFrame, fields: Sequence[str], n: int, entity: str, order: Sequence[str], name: str = "others", block_rows: int = 100_000) -> DataFrame:
    """Adds the up to n rows of all other entities before each row, oldest first; a null entity is one of its own.

    The timeline is cut into blocks of about block_rows rows. A block's tail, its
    last rows with n an entity at most and 2n in all, is enough for whatever
    comes after it; tails are joined over the blocks and each block is finished by
    itself with the tail of what lies before. Rows go to one place, whatever the
    number of entities. `order` must tell all rows apart.
    """
    kept = stored(df, "rows")  # counted, sampled for the ranges and dealt: computed once
    count = max(1, -(-kept.count() // block_rows))
    placed = stored(kept.repartitionByRange(count, *order).withColumn("_block", F.spark_partition_id()), "timeline")
    fact = F.struct(F.col(entity).alias("_e"), *[F.col(c).alias(f"_f_{i}") for i, c in enumerate(fields)])
    newest = [F.desc(c) for c in order]
    narrow = placed.select("_block", *order, entity, fact.alias("_fact")).withColumn("_r", F.row_number().over(Window.partitionBy("_block", entity).orderBy(*newest))).filter(F.col("_r") <= n)
    narrow = narrow.withColumn("_r", F.row_number().over(Window.partitionBy("_block").orderBy(*newest))).filter(F.col("_r") <= 2 * n)
    tails = narrow.groupBy(F.col("_block").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_fact"))), lambda x: x["_fact"]).alias("tail"))
    before = _carried(tails, count, n).filter(F.size("tail") > 0).select(F.col("block").alias("_block"), F.posexplode("tail").alias("_back", "_fact")).select("_block", "_back", "_fact.*")
    kinds = {f.name: f.dataType for f in df.schema}
    listed = T.StructField(name, T.ArrayType(T.StructType([T.StructField(c, kinds[c]) for c in fields])))
    back, orders, own = [f"_f_{i}" for i in range(len(fields))], list(order), df.columns

    def finish(rows: pa.Table, old: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in orders])
        old = old.sort_by([("_back", "descending")])
        line = pa.concat_arrays([*old["_e"].chunks, *rows[entity].cast(old["_e"].type).chunks])
        codes = pc.fill_null(line.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        at = np.arange(len(codes))
        # where each row's run of one entity begins: what is before it is of another
        run = np.maximum.accumulate(np.where(np.concatenate([[True], codes[1:] != codes[:-1]]), at, 0)) if len(codes) else at
        mine = at[len(old) :]
        found, here = np.full((len(mine), n), -1), mine - 1
        for k in range(n):
            here = np.where((here >= 0) & (codes[here] == codes[mine]), run[here] - 1, here)
            found[:, n - 1 - k] = here
            here = np.maximum(here - 1, -1)
        some = found >= 0
        offsets = pa.array(np.concatenate([[0], np.cumsum(some.sum(axis=1))]), pa.int32())
        take = pa.array(found[some])
        values = [pa.concat_arrays([*old[b].chunks, *rows[f].cast(old[b].type).chunks]).take(take) for b, f in zip(back, fields)]
        lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(values, list(fields)))
        return rows.select(own).append_column(name, lists)

    return placed.groupBy("_block").cogroup(before.groupBy("_block")).applyInArrow(finish, T.StructType([*placed.drop("_block").schema.fields, listed]))


def sequence_windows(df: DataFrame, features: Sequence[str], length: int, entity: str, order: str) -> DataFrame:
    """Adds the features of the `length` rows before each row, and those of the last of them; rows with a shorter past go."""
    frame = Window.partitionBy(entity).orderBy(order).rowsBetween(-length, -1)
    seq = F.collect_list(F.array(*[F.col(c).cast("double") for c in features])).over(frame)
    return df.withColumn("sequence", seq).filter(F.size("sequence") == length).withColumn("static", F.element_at("sequence", -1))


def error_correction_term(df: DataFrame, beta: Mapping[str, float], entity: str = "entity", order: str = "quarter_end") -> DataFrame:
    """Adds ect, the combination beta of the row before; each entity's first row goes."""
    combined = sum((F.col(c) * float(b) for c, b in beta.items()), F.lit(0.0))
    return df.withColumn("ect", F.lag(combined).over(_over(entity, order))).dropna(subset=["ect"])


def lagged_feature_join(labels: DataFrame, features: DataFrame, columns: Sequence[str], entity: str = "entity") -> DataFrame:
    """Labels of a quarter with the features of the quarter before; rows with null features go."""
    nxt = quarter_name(F.add_months(F.col("quarter_end"), 3))
    moved = features.select(entity, nxt.alias("quarter"), *columns)
    return labels.join(moved, [entity, "quarter"]).dropna(subset=list(columns))


def expanding_sums(df: DataFrame, entity: str, order: str, sums: Mapping[str, Column]) -> DataFrame:
    """Sums over all earlier rows of the entity, for each row that has some: what a fit on the past needs, without joining it."""
    past = Window.partitionBy(entity).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("n", F.count("*").over(past)).withColumns({k: F.sum(c).over(past) for k, c in sums.items()})
    return out.filter("n > 0").select(entity, order, "n", *sums)
