"""Training corpora: dates as evidence, splits by time, chat rows, rewards of completions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterlight.functions.dates import name_to_end
from quarterlight.functions.fixed_values import REWARD_WEIGHTS
from quarterlight.functions.rules import argmax_class, stacked

# Last day of the train and validation splits, first and last of all.
SPLITS = (("train", "1900-01-01", "2019-12-31"), ("val", "2020-01-01", "2023-12-31"), ("test", "2024-01-01", "2026-12-31"))


def temporal_evidence(metadata: Column, messages: Column) -> Column:
    """Struct of date and source: of the metadata's as_of_date, date, information_cutoff or quarter, else of the first message whose JSON content has one, in order."""
    day = lambda s: F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd")
    begin = lambda q: F.trunc(name_to_end(q), "quarter")
    found = lambda d, s: F.when(d.isNotNull(), F.struct(d.alias("date"), s.alias("source")))
    names = ["as_of_date", "date", "information_cutoff"]
    own = [found(day(metadata[n]), F.lit(f"metadata.{n}")) for n in names] + [found(begin(metadata["quarter"]), F.lit("metadata.quarter"))]

    def inside(message: Column, i: Column) -> Column:
        get = lambda n: F.get_json_object(message["content"], f"$.{n}")
        path = lambda n: F.concat(F.lit("messages["), i.cast("string"), F.lit(f"].{n}"))
        return F.coalesce(*[found(day(get(n)), path(n)) for n in names], found(begin(get("quarter")), path("quarter")))

    spoken = F.filter(F.transform(messages, inside), lambda x: x.isNotNull())
    return F.coalesce(*own, F.try_element_at(spoken, F.lit(1)))


def temporal_split(date: Column, splits: Sequence[tuple[str, str, str]] = SPLITS) -> Column:
    """Split whose window holds the date; unassigned for none and for null."""
    out = F.lit("unassigned")
    for name, first, last in reversed(list(splits)):
        out = F.when(date.between(F.lit(first).cast("date"), F.lit(last).cast("date")), name).otherwise(out)
    return out


def split_stats(rows: DataFrame, split: str, date: str, source: str) -> DataFrame:
    """Rows, first and last date and counts by source of each split."""
    by_source = rows.groupBy(split, source).agg(F.count("*").alias("_n")).groupBy(split).agg(F.array_sort(F.collect_list(F.struct(source, "_n"))).alias("sources"))
    sums = rows.groupBy(split).agg(F.count("*").alias("rows"), F.min(date).alias("first"), F.max(date).alias("last"))
    return sums.join(by_source, split).withColumn("sources", F.map_from_entries("sources"))


def split_check(stats: DataFrame, split: str, splits: Sequence[tuple[str, str, str]] = SPLITS) -> DataFrame:
    """(split, issue) of splits that are empty, reach out of their window or begin before the one before ends. stats has a row for each split."""
    known = stats.sparkSession.createDataFrame([(i, *s) for i, s in enumerate(splits)], "place int, name string, low string, high string")
    before = F.max("last").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))  # a few rows
    met = known.join(stats, known["name"] == stats[split], "left").withColumn("_before", before)
    issues = stacked([
        F.when(F.col("rows").isNull(), F.lit("empty")), F.when((F.col("first") < F.col("low").cast("date")) | (F.col("last") > F.col("high").cast("date")), F.lit("outside its window")),
        F.when(F.col("first") <= F.col("_before"), F.lit("overlaps the split before")),
    ])
    return met.withColumn("issue", F.explode(issues)).select(F.col("name").alias("split"), "issue")


def union_training_sets(parts: Mapping[str, DataFrame]) -> DataFrame:
    """All rows, tagged with the set they come from; columns that a set lacks are null."""
    out = None
    for name, part in parts.items():
        tagged = part.withColumn("source_file", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def chat_rows(df: DataFrame, task: str, system: Column, user: Column, assistant: Column, metadata: Mapping[str, Column]) -> DataFrame:
    """Adds task, messages (system, user, assistant) and metadata."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    meta = F.create_map(*[x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))])
    return df.select(F.lit(task).alias("task"), F.array(message("system", system), message("user", user), message("assistant", assistant)).alias("messages"), meta.alias("metadata"))


def dapt_text(text: Column, other: Column, chars: int = 6000) -> Column:
    """Text, or the other where that is blank, with line feeds alone and cut to `chars`."""
    picked = F.when(F.trim(F.coalesce(text, F.lit(""))) != "", text).otherwise(other)
    return F.substring(F.replace(picked, F.lit("\r\n"), F.lit("\n")), 1, chars)


def row_checks(counts: Mapping[str, DataFrame], required: Sequence[str]) -> DataFrame:
    """(name, rows, severity) of the sets that are empty: issue for required ones, else warning."""
    out = None
    for name, df in counts.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit("issue" if name in required else "warning").alias("severity"))
        out = one if out is None else out.unionByName(one)
    return out.filter("rows = 0")


def reward_components(df: DataFrame, hike: str, hold: str, cut: str, actual: str) -> DataFrame:
    """Adds the components of a completion's reward that follow from its columns.

    df: the three probabilities and the actual class; evidence (array of struct
    with source_id, url, date), rationale, rounds, converged, stable_rounds,
    regret, future_mentions (number of dates after the cutoff, null without a
    cutoff), complete (all fields there), numeric and in_range, missing (number
    of missing strategy fields). Rows whose completion wasn't JSON have a null
    `complete` and score -1 throughout.
    """
    p = [F.coalesce(F.col(c), F.lit(0.0)) for c in (hike, hold, cut)]
    h, o, c = p
    a = F.col(actual)
    predicted, most = argmax_class(p), F.greatest(*p)
    r, low, high = (lambda x: F.round(x, 6)), (lambda x: F.greatest(F.lit(-1.0), x)), (lambda x: F.least(F.lit(1.0), x))
    of_actual = lambda name: F.when(a == name, 1.0).otherwise(0.0)
    brier = sum((F.pow(x - of_actual(n), 2) for x, n in zip(p, ("hike_25bp", "hold", "cut_25bp"))), F.lit(0.0))
    n_evidence = F.size(F.coalesce("evidence", F.array().cast(df.schema["evidence"].dataType)))
    traceable = F.size(F.filter("evidence", lambda e: F.coalesce(e["source_id"], e["url"], e["date"]).isNotNull()))
    claims = F.regexp_count(F.lower("rationale"), F.lit(r"\b(will|must|clearly|because|therefore|due to|caused by)\b"))
    unsupported = F.greatest(F.lit(0), claims - n_evidence)
    moved, away = a.isin("hike_25bp", "cut_25bp"), F.greatest(h, c)
    scores = {
        "schema_valid": F.when(F.col("complete") & F.col("numeric") & F.col("in_range"), 1.0).when((F.col("missing") <= 2) & F.col("numeric"), 0.0).otherwise(-1.0),
        "no_future_leakage": F.when(F.col("future_mentions").isNull(), 0.0).when(F.col("future_mentions") == 0, 1.0).otherwise(low(-0.25 * F.col("future_mentions"))),
        "evidence_traceable": F.when(n_evidence == 0, -0.3).otherwise(low(high(traceable / n_evidence))),
        "fed_probability_calibrated": F.when(a.isNull(), 0.0).otherwise(r(low(1 - brier))),
        "lower_regret": F.when(F.col("regret").isNull(), 0.0).otherwise(r(low(1 - 4 * F.greatest(F.lit(0.0), F.col("regret"))))),
        "fewer_convergence_rounds": F.when(F.col("rounds").isNull(), 0.0).otherwise(r(low(high(1 - (F.greatest(F.lit(1.0), F.col("rounds").cast("double")) - 1) / 20)))),
        "stable_after_10_rounds": F.when(F.col("converged"), 1.0).when(F.col("stable_rounds").isNull(), 0.0).when(F.col("stable_rounds") >= 10, 1.0).otherwise(r(F.col("stable_rounds") / 10 - 0.5)),
        "unsupported_claims": F.when(F.trim("rationale") == "", 0.0).when((unsupported == 0) & (claims > 0), 1.0).when(unsupported == 0, 0.2).otherwise(low(0.5 - 0.3 * unsupported)),
        "overconfident_wrong_prediction": F.when(a.isNull(), 0.0).when(predicted == a, r(high(most))).when(most >= 0.75, -1.0).when(most >= 0.6, -0.6).otherwise(-0.2),
        "not_always_hold": F.when(moved & (predicted == "hold") & (o >= 0.6), -0.8).when(moved & (predicted == "hold") & (o >= 0.5), -0.5).when(moved & (o >= 0.75), -1.0)
        .when(moved & (o >= 0.6) & (away < 0.25), -0.6).when(moved, F.greatest(F.lit(-0.2), r(1 - o))).when((a == "hold") & (o > 0.9), 0.2).when(a == "hold", high(r(0.3 + o)))
        .when((o >= 0.85) & (away < 0.1), -0.6).otherwise(0.3),
    }
    return df.withColumns({k: F.when(F.col("complete").isNull(), -1.0).otherwise(v) for k, v in scores.items()})


# Token of a role, strategy field, threshold, and whether values under it (-1) or over it (1) are held against the role.
ROLE_BIASES = (
    ("hawk", "hawkish_signal_prob", 0.25, -1), ("dove", "hawkish_signal_prob", 0.75, 1), ("dove", "rate_hike_25bp_prob", 0.45, 1),
    ("euro", "trade_or_sanction_pressure_prob", 0.7, 1), ("energy", "trade_or_sanction_pressure_prob", 0.7, 1),
)


def role_consistency(role: Column, fields: Mapping[str, Column], biases: Sequence[tuple[str, str, float, int]] = ROLE_BIASES) -> Column:
    """1 less three times the excess over the role's thresholds, not under -1; 0 for a role without any."""
    low = F.lower(role)
    checks = sum((low.contains(token).cast("int") for token, *_ in biases), F.lit(0))
    excess = sum((F.when(low.contains(token), F.greatest(F.lit(0.0), side * (F.coalesce(fields[f], F.lit(0.0)) - limit))).otherwise(0.0) for token, f, limit, side in biases), F.lit(0.0))
    return F.when(role.isNull() | (checks == 0), 0.0).otherwise(F.round(F.greatest(F.lit(-1.0), 1 - 3 * excess), 6))


def weighted_reward(names: Sequence[str], weights: Mapping[str, float] = REWARD_WEIGHTS, digits: int = 6) -> Column:
    """Sum of weight times score over the sum of absolute weights."""
    total = sum(abs(weights[n]) for n in names)
    return F.round(sum((F.col(n) * weights[n] for n in names), F.lit(0.0)) / total, digits)


def batch_hold_penalty(df: DataFrame, batch: str, hold: str, predicted: str, score: str) -> DataFrame:
    """The row's score or its batch's penalty for always holding, whichever is less. Batches are summed first and joined back, so one may be of any size."""
    sums = df.groupBy(batch).agg((F.count_if(F.col(predicted) == "hold") / F.count("*")).alias("_s"), F.avg(hold).alias("_m"), F.count("*").alias("_n"))
    penalty = F.when(F.col("_n") < 2, 1.0).when((F.col("_s") >= 0.95) & (F.col("_m") >= 0.6), -1.0).when((F.col("_s") >= 0.85) & (F.col("_m") >= 0.55), -0.6).when(F.col("_s") >= 0.75, -0.2).otherwise(1.0)
    return df.join(sums.select(batch, penalty.alias("_p")), batch).withColumn(score, F.least(score, "_p")).drop("_p")


def reward_report(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(component, mean, negative, buckets below -0.5, 0, 0.5 and above) of each component."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("component"), F.col(n).alias("score")) for n in names])).alias("x")).select("x.*")
    between = lambda low, high: F.count_if((F.col("score") >= low) & (F.col("score") < high))
    return long.groupBy("component").agg(
        F.round(F.avg("score"), 6).alias("mean"), F.count_if(F.col("score") < 0).alias("negative"), between(-9, -0.5).alias("lowest"), between(-0.5, 0).alias("low"), between(0, 0.5).alias("high"), between(0.5, 9).alias("highest")
    )
