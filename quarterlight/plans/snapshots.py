"""Context snapshots: what was known before each event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterlight.operators import timeseries


def context_snapshots(events: DataFrame, entity: str, code: str, value: str) -> DataFrame:
    """events (event_id, ts, date, entity, code, value) with own and other history, the latest value of each code before the event's date, and a text.

    Values of one code, entity and date are first cut to the last one, so the
    as-of join meets one row for each.
    """
    own = timeseries.own_history(events, ["event_id", "date"], 12, entity, ["ts", "event_id"], "own")
    both = timeseries.other_history(own, ["event_id", "date"], 20, entity, ["ts", "event_id"])
    daily = events.groupBy(entity, "date", code).agg(F.max_by(value, F.struct("ts", "event_id")).alias("_v"))
    grid = events.select(entity, "date").distinct().withColumn("_before", F.date_sub("date", 1))
    macro = timeseries.asof_grid(daily.withColumnRenamed("date", "_before"), grid.select(entity, "_before"), [entity], code, "_before", "_v").withColumn("date", F.date_add("_before", 1))
    out = both.join(macro.select(entity, "date", F.col("latest").alias("macro")), [entity, "date"], "left")
    return out.withColumn("rag_text", F.concat_ws(" | ", code, F.col(entity).cast("string"), F.col("date").cast("string")))
