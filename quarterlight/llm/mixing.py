"""Mixing sources to target weights, with DataFrame operations only.

A source's budget is met by a cut through a hash of the document's key: the
words are summed by source and hash bucket, the bucket in which the running sum
passes the budget is refined by further bits of the hash, and at the end every
document below its source's cut is taken. Nothing is sorted but the histogram,
which has at most 2**BITS rows for a source. Budgets are nested: a larger
budget takes all that a smaller one takes, and over one pass it takes the whole
source and a cut of it again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarterlight.llm.common import save, small, table

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash that each histogram looks at, and the number of histograms.
BITS, LEVELS = 12, 3


def word_count(text: Column) -> Column:
    """Number of words in text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _hash(key: Column, text: Column) -> Column:
    """63 bits by which rows go in or out: of the key, or of the text where there is no key."""
    return F.shiftrightunsigned(F.when(key.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key)), 1)


def _prefix(level: int) -> Column:
    return F.shiftrightunsigned(F.col("_h"), 63 - BITS * level)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) by filling up: weights go round the sources in code-point order, null last.

    The targets add up to share times all words. A target stops at most times
    its source's size and what is over is shared again by weight: sources are
    full in the order of limit by weight, so one running sum finds the level at
    which the first of them isn't full. The windows see one row for a source.
    """
    by_name, by_limit = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("_limit_by_weight", "_rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") - 1) % len(weights) + 1)
    filled = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("_rank", F.row_number().over(by_name))
        .withColumn("_weight", weight)
        .withColumn("_limit", F.col("source_size") * float(most))
        .withColumn("_limit_by_weight", F.col("_limit") / F.col("_weight"))
        .withColumn("_left", F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
        .withColumn("_weight_left", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_weight_left"))
        .withColumn("_open", F.col("_level") < F.col("_limit_by_weight"))
    )
    first_open = F.min(F.when(F.col("_open"), F.struct("_limit_by_weight", "_rank", "_level"))).over(everything)["_level"]
    return filled.withColumn("_at", first_open).select(
        "source", "source_size",
        F.coalesce(F.least(F.col("_limit"), F.col("_at") * F.col("_weight")), F.col("_limit")).alias("target"),
    )


def source_cuts(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, passes, cut): each document is taken `passes` times, and once more if its hash's prefix is under cut."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("int")
    state = save(
        targets.withColumn("passes", passes).withColumn("_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size"))).withColumn("cut", F.lit(0).cast("long")),
        "cuts",
    )
    n = state.count()
    for level in range(1, LEVELS + 1):
        open_ = state.filter("_rest > 0").select(F.col("source").alias("_s"), F.col("cut").alias("_cut"))
        inside = sizes.join(small(open_, n), F.col("source").eqNullSafe(F.col("_s")) & (_prefix(level - 1) == F.col("_cut")))
        histogram = inside.groupBy("source", _prefix(level).alias("_bucket")).agg(F.sum("size").alias("_words"))
        so_far = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        held = histogram.withColumn("_before", F.coalesce(F.sum("_words").over(so_far), F.lit(0)))
        passed = (
            held.join(small(state.select(F.col("source").alias("_s"), "_rest"), n), F.col("source").eqNullSafe(F.col("_s")))
            .filter("_before <= _rest AND _before + _words > _rest")
            .groupBy(F.col("source").alias("_s")).agg(F.min(F.struct("_bucket", "_before", "_words")).alias("_at"))
        )
        # no bucket passes the rest only if the rest is all there is
        rest = F.coalesce(F.col("_rest") - F.col("_at._before"), F.lit(0.0))
        # the last bucket goes in if that brings the sum nearer
        nearer = F.when(rest * 2 >= F.col("_at._words"), 1).otherwise(0) if level == LEVELS else F.lit(0)
        # a cut that met its budget at a bucket's edge stays there, in finer buckets
        edge = F.shiftleft(F.when(F.col("_rest") > 0, F.col("cut") + 1).otherwise(F.col("cut")), BITS)
        state = save(
            state.join(small(passed, n), F.col("source").eqNullSafe(F.col("_s")), "left").select(
                "source", "source_size", "target", "passes",
                F.when(F.col("_rest") > 0, rest).otherwise(0.0).alias("_rest"),
                F.when((F.col("_rest") > 0) & F.col("_at").isNotNull(), F.col("_at._bucket") + nearer).otherwise(edge).cast("long").alias("cut"),
            ),
            "cuts",
        )
    return state.drop("_rest")


def mix_plan(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(sizes, cuts): the size and hash of each document, and what is taken of each source.

    Null text counts 0 words; null sources are one source, the last. An empty
    table gives no sources. Rows with equal keys are taken together, and of
    those without a key rows with equal texts. Sums of words are exact whatever
    else the table has: only key, text and source are read.
    """
    sizes = save(docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), _hash(F.col(key), F.col(text)).alias("_h")), "sizes")
    return sizes, source_cuts(sizes, save(source_targets(sizes, weights, share, most), "targets"))


def _copies() -> Column:
    return F.col("_m.passes") + F.when(_prefix(LEVELS) < F.col("_m.cut"), 1).otherwise(0)


def with_copies(df: DataFrame, cuts: DataFrame) -> DataFrame:
    """df (with source and _h) with the struct _m of its source's cut and _copies, the times that the mix takes the row."""
    packed = cuts.select(F.col("source").alias("_s"), F.struct("source_size", "target", "passes", "cut").alias("_m"))
    return df.join(small(packed, cuts.count()), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("_copies", _copies())


def mix_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of docs (doc_id, text, source, more), each as often as the mix takes it; columns as in docs, whatever their names.

    Null and empty texts have no words and are taken with their hash's place;
    nulls, ties, repeated rows and empty tables are as in mix_plan.
    """
    _, cuts = mix_plan(docs, weights, share, most)
    rows = docs.select(F.struct("*").alias("_row"), "source", _hash(F.col("doc_id"), F.col("text")).alias("_h"))
    kept = with_copies(rows, cuts).filter("_copies > 0")
    return kept.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, cuts = mix_plan(table(spark, sf_dir, "documents"))
    return with_copies(sizes, cuts).select(
        F.col("_key").alias("doc_id"), "size", F.col("_m.source_size").alias("source_size"), F.col("_m.target").alias("target"), (F.col("size") * F.col("_copies")).alias("taken")
    )
