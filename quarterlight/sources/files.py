"""Files: series, records, speeches, JSON lines, CSV, Parquet. Schemas are declared; what can't be cast is null."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

OBSERVATIONS = "observations array<struct<date:string,value:string>>"


def read_series_json(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, date, value) of one JSON object with observations for each file; series_id is the file's name. `.`, bad numbers and bad dates go."""
    raw = spark.read.schema(OBSERVATIONS).option("multiLine", True).json(path).withColumn("series_id", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1))
    return _observations(raw)


def read_series_lines(spark: SparkSession, path: str) -> DataFrame:
    """As read_series_json, of JSON lines that carry their series_id."""
    return _observations(spark.read.schema(f"series_id string, {OBSERVATIONS}").json(path))


def _observations(raw: DataFrame) -> DataFrame:
    rows = raw.select("series_id", F.explode("observations").alias("o"))
    typed = rows.select("series_id", F.try_to_date("o.date", "yyyy-MM-dd").alias("date"), F.col("o.value").try_cast("double").alias("value"))
    return typed.filter("date IS NOT NULL AND value IS NOT NULL")


def read_wide_csv(spark: SparkSession, path: str, keys: Sequence[str], years: Iterable[int], where: Column | None = None) -> DataFrame:
    """CSV with a column for each year to (keys, year, value); only the keys and the years asked for are parsed, empty cells go."""
    names = [str(y) for y in years]
    raw = spark.read.option("header", True).csv(path).select(*keys, *names)
    kept = raw if where is None else raw.filter(where)
    long = kept.unpivot(list(keys), names, "year", "value")
    return long.select(*keys, F.col("year").cast("int").alias("year"), F.col("value").try_cast("double").alias("value")).filter("value IS NOT NULL")


RECORDS = "COUNTRY string, INDICATOR string, INDICATOR_LABEL string, UNIT_MEASURE string, TIME_PERIOD string, OBS_VALUE string"


def read_records_json(spark: SparkSession, path: str, source: str = "IMF_WEO", prefix: str = "IMF_WEO_") -> DataFrame:
    """API records to a typed panel: renamed, prefix off the indicator, year and value cast, source constant. No files give an empty typed frame."""
    raw = spark.read.schema(RECORDS).json(path)
    return raw.select(
        F.col("COUNTRY").alias("country"), F.regexp_replace("INDICATOR", f"^{prefix}", "").alias("indicator"), F.col("INDICATOR_LABEL").alias("indicator_name"),
        F.col("UNIT_MEASURE").alias("unit"), F.col("TIME_PERIOD").try_cast("int").alias("year"), F.col("OBS_VALUE").try_cast("double").alias("value"), F.lit(source).alias("source"),
    )


# Columns of speech files that mean one thing, first present first.
SPEECH_COLUMNS = {
    "date": ["date", "published", "publication_date", "speech_date"],
    "institution": ["institution", "central_bank", "source", "organisation"],
    "title": ["title", "headline"],
    "text": ["text", "content", "speech", "contents"],
}


def read_speech_csv(spark: SparkSession, path: str, synonyms: Mapping[str, Sequence[str]] = SPEECH_COLUMNS) -> DataFrame:
    """Speeches of one file group: separator by its header line (| or ,), lower-case headers, synonyms coalesced, all but the text kept as JSON, and the text's length."""
    header = spark.read.text(path).filter("value <> ''").first()
    separator = "|" if header and header[0].count("|") > header[0].count(",") else ","
    raw = spark.read.option("header", True).option("sep", separator).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    one = lambda names: F.coalesce(*[F.col(n) for n in names if n in raw.columns], F.lit(""))
    text = one(synonyms["text"])
    meta = F.create_map(*[x for c in raw.columns if c not in synonyms["text"] for x in (F.lit(c), F.col(c))])
    return raw.select(
        *[one(names).alias(k) for k, names in synonyms.items() if k != "text"], F.to_json(F.map_filter(meta, lambda _, v: v.isNotNull())).alias("raw_metadata"), F.length(text).alias("text_chars")
    )


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists, on whatever file system it names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """JSON lines; blank lines go, a line that isn't JSON is kept in _corrupt_record, a missing path is empty."""
    full = StructType.fromDDL(schema + ", _corrupt_record string")
    if not exists(spark, path):
        return spark.createDataFrame([], full)
    df = spark.read.schema(full).option("mode", "PERMISSIVE").json(path)
    return df if limit is None else df.limit(limit)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Writes JSON lines and returns their number, counted in the same pass."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return seen.get["n"]


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def snapshots_or_rebuilt(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """The snapshot table; where it is missing or its files aren't readable as Parquet, minimal snapshots of the index rows (id, country, date, text)."""
    if exists(spark, path):
        try:
            return spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":  # no file in the folder
                raise
        except Py4JJavaError as error:
            if "is not a Parquet file" not in str(error):  # what else fails may pass when tried again
                raise
    return index.select("id", "country", "date", F.col("text").alias("rag_text"), F.array().cast("array<string>").alias("own_history"), F.lit("rebuilt").alias("origin"))
