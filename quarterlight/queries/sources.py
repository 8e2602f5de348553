"""Readers and writers: each query writes what Spark derives from the tables to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterlight.queries.panels import MONTHS, indicators, months, UNPIVOT
from quarterlight.queries.registry import query, table
from quarterlight.scratch import scratch_path
from quarterlight.sources import files


@query("read_series_json", f"WITH {MONTHS} SELECT entity AS series_id, ts AS date, n::DOUBLE AS value FROM m WHERE n % 5 <> 0")
def _(spark, sf_dir):
    path = scratch_path(spark, "series")
    value = F.when(F.col("n") % 10 == 0, ".").when(F.col("n") % 10 == 5, "bad").otherwise(F.col("n").cast("string"))
    series = months(spark, sf_dir).groupBy(F.col("entity").alias("series_id")).agg(F.collect_list(F.struct(F.col("ts").cast("string").alias("date"), value.alias("value"))).alias("observations"))
    series.write.json(path)
    return files.read_series_lines(spark, path)


@query("read_records_json", f"WITH {UNPIVOT} SELECT country::VARCHAR AS country, code AS indicator, 'name of ' || code AS indicator_name, 'USD' AS unit, CASE WHEN country % 4 > 0 THEN year END::INTEGER AS year, value, 'IMF_WEO' AS source FROM f")
def _(spark, sf_dir):
    path = scratch_path(spark, "records")
    indicators(spark, sf_dir).select(
        F.col("country").cast("string").alias("COUNTRY"), F.concat(F.lit("IMF_WEO_"), "code").alias("INDICATOR"), F.concat(F.lit("name of "), "code").alias("INDICATOR_LABEL"), F.lit("USD").alias("UNIT_MEASURE"),
        F.when(F.col("country") % 4 > 0, F.col("year").cast("string")).otherwise("n/a").alias("TIME_PERIOD"), F.col("value").cast("string").alias("OBS_VALUE"),
    ).write.json(path)
    return files.read_records_json(spark, path)


@query("read_speech_csv", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, event_type AS institution, 'event ' || event_id AS title, length(props)::INTEGER AS text_chars FROM events")
def _(spark, sf_dir):
    path = scratch_path(spark, "speeches")
    table(spark, sf_dir, "events").select(F.col("ts").cast("date").cast("string").alias("Published"), F.col("event_type").alias("Central_Bank"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("Title"), F.col("props").alias("Text")).write.option("header", True).option("sep", "|").option("escape", '"').csv(path)
    return files.read_speech_csv(spark, path).select("date", "institution", "title", "text_chars")


@query("read_jsonl", "SELECT event_id, event_type, value FROM events")
def _(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "event_type", "value")).alias("value")).withColumn("value", F.explode(F.array("value", F.lit("")))).write.text(path)
    return files.read_jsonl(spark, path, "event_id long, event_type string, value double").filter("_corrupt_record IS NULL").drop("_corrupt_record")


@query("write_jsonl", "SELECT count(*)::BIGINT AS written, count(*)::BIGINT AS found FROM conversations")
def _(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    conversations = table(spark, sf_dir, "conversations")
    n = files.write_jsonl(conversations.filter("conv_id % 2 = 0"), path) + files.write_jsonl(conversations.filter("conv_id % 2 = 1"), path, "append")
    return spark.read.schema("conv_id long").json(path).agg(F.count("*").alias("found")).select(F.lit(n).cast("long").alias("written"), "found")


@query("parquet_io", "SELECT year(o_orderdate)::INTEGER AS year, o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) IN (1996, 1999)")
def _(spark, sf_dir):
    path = scratch_path(spark, "by-year")
    files.write_partitioned(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_orderkey", "o_totalprice"), path, ["year"])
    return spark.read.parquet(path).filter("year IN (1996, 1999)").select("year", "o_orderkey", "o_totalprice")


@query("write_csv", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT s_suppkey::INTEGER, s_name FROM supplier")
def _(spark, sf_dir):
    path = scratch_path(spark, "csv")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").unionByName(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("n_nationkey"), F.col("s_name").alias("n_name")))
    files.write_csv(rows, path)
    return spark.read.schema("n_nationkey int, n_name string").option("header", True).csv(path)


@query("load_snapshots_with_fallback", "SELECT doc_id AS id, lang AS country, length(text)::INTEGER AS chars, unnest(['rebuilt', 'snapshot']) AS origin FROM documents")
def _(spark, sf_dir):
    index = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("country"), F.lit("2020-01-01").alias("date"), "text")
    rebuilt, path = files.snapshots_or_rebuilt(spark, scratch_path(spark, "missing"), index), scratch_path(spark, "snapshots")
    rebuilt.withColumn("origin", F.lit("snapshot")).write.parquet(path)
    both = rebuilt.unionByName(files.snapshots_or_rebuilt(spark, path, index))
    return both.select("id", "country", F.length("rag_text").alias("chars"), "origin")
