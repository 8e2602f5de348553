"""Forecast metrics: accuracy, Brier, log loss, diagnostics, calibration, confusion.

Evaluated rows have actual_class and a probability column p_<class> for each
class. All metrics of a group come from one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterlight.functions.fixed_values import CLASSES
from quarterlight.functions.rules import argmax_class


def with_prediction(df: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    predicted = argmax_class([F.col(f"p_{c}") for c in classes], classes)
    return df.withColumn("predicted_class", predicted).withColumn("correct", (F.col("actual_class") == F.col("predicted_class")).cast("int"))


def squared_error(c: str) -> Column:
    return F.pow(F.col(f"p_{c}") - F.when(F.col("actual_class") == c, 1.0).otherwise(0.0), F.lit(2.0))


def brier(classes: Sequence[str] = CLASSES) -> Column:
    """Sum over classes, between 0 and 2."""
    return sum((squared_error(c) for c in classes[1:]), squared_error(classes[0]))


def log_loss(classes: Sequence[str] = CLASSES, least: float = 1e-12) -> Column:
    p = F.coalesce(*[F.when(F.col("actual_class") == c, F.col(f"p_{c}")) for c in classes])
    return -F.ln(F.greatest(F.lit(least), F.least(F.lit(1.0), p)))


def metric_columns(classes: Sequence[str] = CLASSES, neutral: str = "hold", digits: int = 6) -> list[Column]:
    """Aggregates over rows of with_prediction."""
    is_a, is_p = (lambda c: F.col("actual_class") == c), (lambda c: F.col("predicted_class") == c)
    support, predicted, hits = ({c: F.count_if(x) for c, x in ((c, test(c)) for c in classes)} for test in (is_a, is_p, lambda c: is_a(c) & is_p(c)))
    mean = lambda parts: F.aggregate(F.array_compact(F.array(*parts)), F.lit(0.0), lambda a, x: a + x) / F.size(F.array_compact(F.array(*parts)))
    recalls = [F.when(support[c] > 0, hits[c] / support[c]) for c in classes]
    f1 = [F.when((support[c] > 0) | (predicted[c] > 0), 2.0 * hits[c] / (support[c] + predicted[c])) for c in classes]
    moving = [c for c in classes if c != neutral]
    n = F.count("*")
    r = lambda x, name: F.round(x, digits).alias(name)
    return [
        n.alias("n"), r(F.avg("correct"), "accuracy"), r(mean(recalls), "balanced_accuracy"), r(mean(f1), "macro_f1"),
        r(F.try_divide(sum((hits[c] for c in moving), F.lit(0)), sum((support[c] for c in moving), F.lit(0))), "non_hold_recall"),
        r(predicted[neutral] / n * F.avg(f"p_{neutral}"), "hold_collapse_index"), r(F.avg(brier(classes)), "brier_score"),
        *[r(F.avg(squared_error(c)), f"brier_{c}") for c in classes], r(F.avg(log_loss(classes)), "log_loss"), r(F.greatest(*support.values()) / n, "majority_accuracy"),
    ]


def forecast_metrics(evaluated: DataFrame, by: Sequence[str] = (), classes: Sequence[str] = CLASSES) -> DataFrame:
    """One row of metrics for each group of evaluated rows; none for no rows."""
    rows = with_prediction(evaluated, classes).groupBy(*by).agg(*metric_columns(classes))
    return rows if by else rows.filter("n > 0")


def metrics_by_split(evaluated: DataFrame, split: str, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Metrics of all rows (split `overall`) and of each split, from grouping sets."""
    rows = with_prediction(evaluated, classes)
    sets = rows.groupingSets([[], [F.col(split)]], F.col(split)).agg(F.grouping_id().alias("_g"), *metric_columns(classes))
    return sets.withColumn(split, F.when(F.col("_g") == 1, "overall").otherwise(F.col(split))).drop("_g")


def confusion_matrix(evaluated: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """A row for each actual class and a count for each predicted, zeros included."""
    rows = with_prediction(evaluated, classes).groupBy("actual_class").pivot("predicted_class", list(classes)).count()
    every = evaluated.sparkSession.createDataFrame([(c,) for c in classes], "actual_class string")
    return every.join(rows, "actual_class", "left").na.fill(0, list(classes))


def calibration_bins(evaluated: DataFrame, bins: int = 10, classes: Sequence[str] = CLASSES) -> DataFrame:
    """(label, bin, count, mean_p, rate, gap) one-vs-rest for each class and for the top label; empty bins are listed."""
    rows = with_prediction(evaluated, classes)
    one = [F.struct(F.lit(c).alias("label"), F.col(f"p_{c}").alias("p"), (F.col("actual_class") == c).cast("int").alias("hit")) for c in classes]
    top = F.struct(F.lit("top").alias("label"), F.greatest(*[F.col(f"p_{c}") for c in classes]).alias("p"), F.col("correct").alias("hit"))
    long = rows.select(F.explode(F.array(*one, top)).alias("x")).select("x.*")
    found = long.groupBy("label", F.least(F.lit(bins - 1), F.floor(F.col("p") * bins)).cast("int").alias("bin")).agg(F.count("*").alias("count"), F.avg("p").alias("mean_p"), F.avg("hit").alias("rate"))
    labels = evaluated.sparkSession.createDataFrame([(c,) for c in [*classes, "top"]], "label string")
    grid = labels.select("label", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(found, ["label", "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
    return out.select("label", "bin", "count", F.round("mean_p", 6).alias("mean_p"), F.round("rate", 6).alias("rate"), F.round(F.abs(F.col("mean_p") - F.col("rate")), 6).alias("gap"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    """(label, ece): gaps weighted by counts."""
    return bins.groupBy("label").agg(F.round(F.sum(F.col("gap") * F.col("count")) / F.sum("count"), 5).alias("ece"))


def event_study(df: DataFrame, entity: str, order: Sequence[str], decision: str, width: int = 4) -> DataFrame:
    """(offset, mean_decision, mean_size, n) of the rows around each non-zero decision, in the entity's order.

    The rows around an event are looked up by lead and lag over one sort, so no
    row meets more than 2 * width + 1 others.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(entity).orderBy(*order)
    around = [F.struct(F.lit(k).alias("offset"), F.lead(decision, k).over(w).alias("d")) for k in range(-width, width + 1)]
    long = df.select(decision, F.array(*around).alias("a")).filter(F.col(decision) != 0).select(F.explode("a").alias("x")).select("x.*").filter("d IS NOT NULL")
    return long.groupBy("offset").agg(F.round(F.avg("d"), 6).alias("mean_decision"), F.round(F.avg(F.abs("d")), 6).alias("mean_size"), F.count("*").alias("n"))


def pinball_loss(quantiles: dict[float, str], actual: str) -> Column:
    """Quantile loss averaged over the quantile columns."""
    parts = [F.greatest((q - 1) * (F.col(actual) - F.col(c)), q * (F.col(actual) - F.col(c))) for q, c in quantiles.items()]
    return F.avg(sum(parts[1:], parts[0]) / len(parts))


def economics_penalty(df: DataFrame, entity: str, order: str, rate: str, rule: str, ect: str, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(entity, penalty): mean distance from the rule's rate, and mean of moves against the error-correction term."""
    from pyspark.sql import Window

    moved = F.col(rate) - F.lag(rate).over(Window.partitionBy(entity).orderBy(order))
    a, b = weights
    return df.withColumn("_m", moved).groupBy(entity).agg(F.round(a * F.avg(F.abs(F.col(rate) - F.col(rule))) + b * F.coalesce(F.avg(F.greatest(F.lit(0.0), -F.col(ect) * F.col("_m"))), F.lit(0.0)), 4).alias("penalty"))
