"""Decision labels by period, priors and simple baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterlight.functions.fixed_values import CLASSES


def decision_class(decision: Column, classes: Sequence[str] = CLASSES) -> Column:
    """Class of a decision's sign: up, none, down."""
    up, none, down = classes
    return F.when(decision > 0, up).when(decision < 0, down).otherwise(none)


def period_labels(meetings: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Label of each period: sign of its decisions' sum; on 0 the last non-zero decision, else 0.

    Also the number of meetings. order must be unique inside a period.
    """
    when = F.struct(*order)
    last = F.max_by("decision", F.when(F.col("decision") != 0, when))
    out = meetings.groupBy(*keys).agg(F.sum("decision").cast("int").alias("net"), last.alias("last_move"), F.count("*").alias("meetings"))
    sign = F.when(F.col("net") != 0, F.signum("net")).otherwise(F.coalesce("last_move", F.lit(0))).cast("int")
    return out.withColumn("actual", sign).withColumn("actual_class", decision_class(sign)).drop("last_move")


def class_priors(labels: DataFrame, by: Sequence[str] = (), classes: Sequence[str] = CLASSES) -> DataFrame:
    """Share of each class, one column a class, as p_<class>."""
    return labels.groupBy(*by).agg(*[(F.count_if(F.col("actual_class") == c) / F.count("*")).alias(f"p_{c}") for c in classes])


def persistence(labels: DataFrame, entity: str, order: str, hit: float = 0.8, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Probability `hit` on the class of the period before and equal parts on the others; an entity's first row is left out."""
    before = F.lag("actual_class").over(Window.partitionBy(entity).orderBy(order))
    rest = (1 - hit) / (len(classes) - 1)
    df = labels.withColumn("_before", before).filter("_before IS NOT NULL")
    return df.withColumns({f"p_{c}": F.when(F.col("_before") == c, hit).otherwise(rest) for c in classes}).drop("_before")


def trailing_shares(labels: DataFrame, entity: str, order: str, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Shares of the classes in an entity's earlier periods, one added to each."""
    past = Window.partitionBy(entity).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    n = F.count("*").over(past)
    return labels.withColumns({f"p_{c}": (F.count_if(F.col("actual_class") == c).over(past) + 1) / (n + len(classes)) for c in classes})
