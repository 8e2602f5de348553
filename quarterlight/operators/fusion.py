"""Combining and comparing models' probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterlight.functions.fixed_values import CLASSES
from quarterlight.operators.metrics import squared_error


def ensemble_average(long: DataFrame, keys: Sequence[str], probs: Sequence[str]) -> DataFrame:
    """Mean of each probability over the models of a key."""
    return long.groupBy(*keys).agg(*[F.avg(p).alias(p) for p in probs])


def gated(df: DataFrame, a: Sequence[str], b: Sequence[str], out: Sequence[str], weights: Sequence[tuple[float, float]] = ((0.1, 0.8), (0.2, 0.55)), else_: float = 0.4) -> DataFrame:
    """Mix of a and b whose weight on a falls with their disagreement on the first class; normalised. Adds weight."""
    apart = F.round(F.abs(F.col(a[0]) - F.col(b[0])), 9)
    weight = F.lit(else_)
    for limit, w in reversed(weights):
        weight = F.when(apart < limit, w).otherwise(weight)
    mixed = [F.col("weight") * F.col(x) + (1 - F.col("weight")) * F.col(y) for x, y in zip(a, b)]
    total = sum(mixed[1:], mixed[0])
    return df.withColumn("weight", weight).withColumns({o: m / total for o, m in zip(out, mixed)})


def mean_of(df: DataFrame, sources: Sequence[Sequence[str]], out: Sequence[str]) -> DataFrame:
    """Mean of the available sources' probabilities, normalised; a source with a null counts as missing."""
    there = [F.when(sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in s), F.lit(0)) == 0, 1.0).otherwise(0.0) for s in sources]
    sums = [sum((t * F.coalesce(F.col(s[i]), F.lit(0.0)) for t, s in zip(there, sources)), F.lit(0.0)) for i in range(len(out))]
    total = sum(sums[1:], sums[0])
    return df.withColumns({o: F.try_divide(s, total) for o, s in zip(out, sums)})


def brier_weights(evaluated: DataFrame, classes: Sequence[str] = CLASSES, least: float = 0.01) -> DataFrame:
    """One row: weight of each class, inverse to its mean squared error, adding to 1."""
    errors = evaluated.agg(*[(1 / F.greatest(F.avg(squared_error(c)), F.lit(least))).alias(c) for c in classes])
    total = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    return errors.select(*[F.round(F.col(c) / total, 6).alias(f"weight_{c}") for c in classes])


def compare(a: DataFrame, b: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Accuracy of two models and their agreement on the keys that both have."""
    left = a.select(*keys, F.col("correct").alias("_x"), F.col("predicted_class").alias("_p"))
    right = b.select(*keys, F.col("correct").alias("_y"), F.col("predicted_class").alias("_q"))
    agg = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return left.join(right, list(keys)).groupBy(by).agg(F.count("*").alias("n"), agg("_x", "accuracy_a"), agg("_y", "accuracy_b"), agg((F.col("_p") == F.col("_q")).cast("int"), "agreement"))


def label_eval(traces: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Traces with their label, and those without one, told apart by `kind`."""
    label = [c for c in labels.columns if c not in keys][0]
    met = traces.join(labels, list(keys), "left")
    return met.select(F.when(F.col(label).isNull(), "unlabelled").otherwise("labelled").alias("kind"), *traces.columns, label)


def drift(df: DataFrame, step: Column, pressure: Column, probs: Sequence[str], rate: float = 0.02) -> DataFrame:
    """Moves probability to the first and off the last class by step * rate * pressure; normalised."""
    first, *middle, last = probs
    moved = {first: F.greatest(F.lit(0.0), F.col(first) + step * rate * pressure), last: F.greatest(F.lit(0.0), F.col(last) - step * rate * pressure)} | {m: F.col(m) for m in middle}
    total = sum((moved[p] for p in probs[1:]), moved[first])
    return df.withColumns({p: moved[p] / total for p in probs})


def test_report(rows: DataFrame, order: Sequence[str], last: int = 8) -> DataFrame:
    """Accuracy, class shares and the last predictions of each model, newest first."""
    share = lambda c: F.round(F.count_if(F.col("predicted_class") == c) / F.count("*"), 6)
    sums = rows.groupBy("model").agg(F.round(F.avg("correct"), 6).alias("accuracy"), share("hike_25bp").alias("hike_share"), share("hold").alias("hold_share"))
    newest = Window.partitionBy("model").orderBy(F.desc(order[0]), *order[1:])
    kept = rows.withColumn("_k", F.row_number().over(newest)).filter(F.col("_k") <= last)
    names = kept.groupBy("model").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "predicted_class"))), lambda x: x["predicted_class"]), ",").alias(f"last_{last}"))
    return sums.join(names, "model")
