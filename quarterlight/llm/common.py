"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows, and most bytes in their strings, of a small side that may be broadcast; beyond that a join is left to Spark.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Bits of a filter that tells which rows a join may meet: 8 MB, whatever the number of keys.
FILTER_BITS = 1 << 26
#: Folders of local sessions that name none, by application.
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may name none: driver and executors are one process then."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        folder = _OWN[app] = _OWN.get(app) or tempfile.mkdtemp(prefix="spark-")
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for a table of the session's own, which goes when the session's JVM ends."""
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: computed once, and kept when an executor is lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows and BROADCAST_BYTES of strings, else as it is.

    df must be cheap to read. With rows given it isn't counted: its rows are that many, and narrow.
    """
    if rows is None:
        strings = [F.octet_length(c) for c, t in df.dtypes if t in ("string", "binary")]
        rows, held = df.agg(F.count("*"), F.coalesce(F.sum(sum((F.coalesce(x, F.lit(0)) for x in strings), F.lit(0)).cast("long")), F.lit(0))).first()
        limit = limit if held <= BROADCAST_BYTES else -1
    return F.broadcast(df) if rows <= limit else df


def modest_batches(spark: SparkSession) -> None:
    """Rows go to Python 1,000 at a time from now on, unless the session names another number than Spark's: 10,000 whole texts are tens of MB, several times over in a task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def hand_back() -> None:
    """Gives memory that this worker has freed, but its allocators still hold, back to the machine: for the end of a task, as workers wait for the next one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def lookup(left: DataFrame, right: DataFrame, key: str, hot: int = 2000, saved: bool = False) -> DataFrame:
    """left with the columns of right, which has one row a key at most (nulls where it has none). Keys of more than `hot` rows of left are few: they are joined where the rows are.

    saved: left is cheap to read, so it isn't written in between where no key has that many rows.
    """
    many = save(left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot).select(key), "many")
    if saved and many.isEmpty():
        return left.join(right, key, "left")
    loud = small(save(many.join(right, key).withColumn("_hot", F.lit(True)), "loud"))
    values = [c for c in right.columns if c != key]
    met = save(left.join(loud, key, "left"), "met")
    rest = met.filter("_hot IS NULL").drop("_hot", *values).join(right, key, "left")
    return met.filter("_hot").drop("_hot").unionByName(rest)


def may_meet(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The column __open added to df: false only where no row of wanted (one column) equals key, and for null keys. Names that begin with __open are its own.

    A bit for each hash of wanted is broadcast, so rows that a join surely
    drops needn't be shuffled for it; few others are let through by clashes.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1
    own = wanted.select(bit(F.col(wanted.columns[0])).alias("bit"))
    bits = save(own.groupBy(F.bitmap_bucket_number("bit").alias("__open_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("__open_bits")), "bits")
    at = F.bitmap_bit_position(bit(F.col(key)))
    byte = F.conv(F.hex(F.substring("__open_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = df.join(F.broadcast(bits), F.bitmap_bucket_number(bit(F.col(key))) == F.col("__open_bucket"), "left")
    there = F.col(key).isNotNull() & (F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1)
    return met.withColumn("__open", F.coalesce(there, F.lit(False))).drop("__open_bucket", "__open_bits")


def shielded(df: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """df with columns of these names renamed out of the way, and the names that bring them back (for withColumnsRenamed)."""
    back = {f"__kept_{c}": c for c in df.columns if c in names}
    return df.withColumnsRenamed({v: k for k, v in back.items()}), back
