"""Stored decision traces: proposals, cluster strategies, convergence, comparisons of runs, leakage."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarterlight.functions.game import distance
from quarterlight.functions.rules import stacked


def latest_per_role(proposals: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each role's last proposal."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return proposals.withColumn("_k", F.row_number().over(newest)).filter("_k = 1").drop("_k")


def top_roles(proposals: DataFrame, keys: Sequence[str], payoff: str, line: Column, n: int = 3, ties: Sequence[str] = ()) -> DataFrame:
    """(keys, lines): text lines of the n proposals with the largest payoff, best first."""
    best = Window.partitionBy(*keys).orderBy(F.desc(payoff), *ties)
    kept = proposals.withColumn("_line", line).withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= n)
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_line"))), lambda x: x["_line"]).alias("lines"))


def persona_consistency(proposals: DataFrame, priors: DataFrame, keys: Sequence[str], role: str, fields: Sequence[str], scale: float = 0.30) -> DataFrame:
    """(keys, distance, score) of proposals to their role's priors (role, prior_<field>); priors are one row for each role."""
    apart = sum((F.abs(F.col(f) - F.col(f"prior_{f}")) for f in fields), F.lit(0.0)) / len(fields)
    met = proposals.join(priors, role).withColumn("_d", apart).groupBy(*keys).agg(F.avg("_d").alias("distance"))
    return met.withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("distance") / scale))


def convergence_streak(rounds: DataFrame, keys: Sequence[str], order: str, moved: Column, gain: Column, near: float, least_gain: float, needed: int) -> DataFrame:
    """(keys, rounds, best_streak, converged): the longest run of rounds with a small move and a small gain."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rounds.withColumn("_ok", (moved < near) & (gain < least_gain)).withColumn("_g", F.sum(F.when(F.col("_ok"), 0).otherwise(1)).over(w))
    streaks = marked.groupBy(*keys, "_g").agg(F.count_if("_ok").alias("_n"), F.count("*").alias("_rows"))
    out = streaks.groupBy(*keys).agg(F.sum("_rows").alias("rounds"), F.max("_n").alias("best_streak"))
    return out.withColumn("converged", F.col("best_streak") >= needed)


def recent_memory(strategies: DataFrame, cluster: str, order: Sequence[str], fields: Sequence[str], n: int = 3) -> DataFrame:
    """Adds memory: the cluster's n strategies before each, newest first."""
    frame = Window.partitionBy(cluster).orderBy(*order).rowsBetween(-n, -1)
    return strategies.withColumn("memory", F.reverse(F.collect_list(F.struct(*fields)).over(frame)))


def weighted_strategy(proposals: DataFrame, keys: Sequence[str], payoff: str, fields: Sequence[str], least: float = 0.05) -> DataFrame:
    """(keys, fields, dispersion): payoff-weighted mean strategy of a cluster, and the largest distance of a member to it."""
    weight = F.greatest(F.lit(least), F.col(payoff))
    mean = proposals.groupBy(*keys).agg(*[(F.sum(weight * F.col(f)) / F.sum(weight)).alias(f"_m_{f}") for f in fields])
    met = proposals.join(mean, list(keys))
    apart = distance([F.col(f) for f in fields], [F.col(f"_m_{f}") for f in fields])
    return met.groupBy(*keys).agg(*[F.first(f"_m_{f}").alias(f) for f in fields], F.max(apart).alias("dispersion"))


def external_shocks(clusters: DataFrame, by: Sequence[str], cluster: str, field: str, picks: Mapping[str, str], floors: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Largest pressure of a field over clusters, that of picked clusters by name, and risks floor + slope * it, as (by, channel, value) rows."""
    sums = clusters.groupBy(*by).agg(F.max(field).alias("pressure"), *[F.coalesce(F.max(F.when(F.col(cluster) == c, F.col(field))), F.lit(0.0)).alias(name) for name, c in picks.items()])
    risks = sums.withColumns({k: F.greatest(F.lit(a), F.col("pressure") * b) for k, (a, b) in floors.items()})
    return risks.unpivot(list(by), ["pressure", *picks, *floors], "channel", "value")


def run_deltas(factual: DataFrame, counterfactual: DataFrame, scope: Sequence[str], fields: Sequence[str], least: float = 1e-6) -> DataFrame:
    """(scope, field, factual, counterfactual, delta) of two runs, outer-matched as they are, then a row for each field; rows null on both sides and deltas of `least` or less go."""
    packed = lambda df, name: df.select(*scope, F.struct(*[F.col(f).cast("double").alias(f) for f in fields]).alias(name))
    met = packed(factual, "_f").join(packed(counterfactual, "_c"), list(scope), "full_outer")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col("_f")[f].alias("factual"), F.col("_c")[f].alias("counterfactual")) for f in fields])
    long = met.select(*scope, F.explode(pairs).alias("_p")).select(*scope, "_p.*")
    both = long.filter("factual IS NOT NULL OR counterfactual IS NOT NULL").withColumn("delta", F.coalesce("counterfactual", F.lit(0.0)) - F.coalesce("factual", F.lit(0.0)))
    return both.filter(F.abs("delta") > least)


def top_shifts(deltas: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """The n largest shifts by size, then field."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.abs("delta")), "field")
    return deltas.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def impact(deltas: DataFrame, cluster: Sequence[str], up: Sequence[str], down: Sequence[str], outside: Sequence[str]) -> DataFrame:
    """Each cluster's summed shift, hawkish and external pressure, largest shift and label."""
    part = lambda names: F.sum(F.when(F.col("field").isin(*names), F.col("delta")).otherwise(0.0))
    r = lambda c: F.round(c, 6)
    sums = deltas.groupBy(*cluster).agg(r(F.sum(F.abs("delta"))).alias("shift"), r(part(up) - part(down)).alias("hawkish"), r(part(outside)).alias("external"), F.max_by("field", F.struct(F.round(F.abs("delta"), 9), F.col("field"))).alias("top_field"))
    # fixed values: thresholds and labels
    label = (
        F.when(F.col("shift") < 0.03, "little strategic change")
        .when(F.abs("external") >= F.greatest(F.abs("hawkish"), F.lit(0.05)), F.when(F.col("external") > 0, "external-pressure shock").otherwise("external-pressure easing"))
        .when(F.col("hawkish") > 0.05, "hawkish policy pressure").when(F.col("hawkish") < -0.05, "dovish or liquidity-support pressure").otherwise("mixed strategic repositioning")
    )
    return sums.withColumn("label", label)


def evidence_diff(a: Column, b: Column) -> Column:
    """Struct of added and removed lines, sorted."""
    return F.struct(F.array_sort(F.array_except(b, a)).alias("added"), F.array_sort(F.array_except(a, b)).alias("removed"))


def mapping_diff(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """(key, name, before, after) of the map entries that differ, missing ones as null."""
    long = lambda df, v: df.select(key, F.explode(column).alias("name", v))
    met = long(left, "before").join(long(right, "after"), [key, "name"], "full_outer")
    return met.filter(~F.col("before").eqNullSafe(F.col("after")))


def apply_overrides(briefing: DataFrame, scenarios: DataFrame, fields: Sequence[str], rate: str, inflation: str, growth: str, gap: str, signal: str) -> DataFrame:
    """Each briefing under each scenario: overridden fields, the rule's gap and signal made anew, and the names that were overridden.

    scenarios: scenario and nullable override columns o_<field>; they are a
    short list that the caller writes, and are broadcast.
    """
    from quarterlight.functions.rules import taylor_rate, taylor_signal

    met = briefing.crossJoin(F.broadcast(scenarios))
    named = stacked([F.when(F.col(f"o_{f}").isNotNull(), F.lit(f)) for f in fields])
    out = met.withColumn("overridden", named).withColumns({f: F.coalesce(F.col(f"o_{f}"), F.col(f)) for f in fields}).drop(*[f"o_{f}" for f in fields])
    out = out.withColumn(gap, taylor_rate(F.col(inflation), F.col(growth)) - F.col(rate))
    return out.withColumn(signal, taylor_signal(F.round(gap, 6)))


def critic(proposals: DataFrame, rules: Mapping[str, Column], penalty: float = 0.2) -> DataFrame:
    """Adds issues (names of the rules that hold) and feasibility, 1 less a penalty for each, not under 0."""
    out = proposals.withColumn("issues", stacked([F.when(test, F.lit(name)) for name, test in rules.items()]))
    return out.withColumn("feasibility", F.round(F.greatest(F.lit(0.0), 1 - penalty * F.size("issues")), 6))


def evidence_chain(df: DataFrame, layers: Sequence[tuple[str, Column, str, Column]]) -> DataFrame:
    """Adds evidence: a struct of layer, bias, confidence for each layer whose test holds; and counts of each bias."""
    items = stacked([F.when(test, F.struct(F.lit(name).alias("layer"), F.lit(bias).alias("bias"), confidence.cast("double").alias("confidence"))) for name, test, bias, confidence in layers])
    out = df.withColumn("evidence", items)
    return out.withColumns({"n_hawkish": F.size(F.filter("evidence", lambda x: x["bias"] == "hawkish")), "n_dovish": F.size(F.filter("evidence", lambda x: x["bias"] == "dovish"))})


def convergence_metrics(traces: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rate of convergence, mean and median rounds, mean distance and gain of traces (converged, rounds, distance, gain)."""
    r = lambda c, n: F.round(c, 4).alias(n)
    return traces.groupBy(*by).agg(F.count("*").alias("n"), r(F.avg(F.col("converged").cast("int")), "convergence_rate"), r(F.avg("rounds"), "mean_rounds"), r(F.median("rounds"), "median_rounds"), r(F.avg("distance"), "mean_distance"), r(F.avg("gain"), "mean_gain"))


def equilibrium_metrics(traces: DataFrame, check: str, by: Sequence[str] = ()) -> DataFrame:
    """Checked and accepted rates and the checked traces' mean gain, of a nullable struct (source, accepted, gain)."""
    done = F.col(check).isNotNull()
    r = lambda c, n: F.round(c, 4).alias(n)
    return traces.groupBy(*by).agg(
        r(F.count_if(done) / F.count("*"), "checked_rate"), r(F.try_divide(F.count_if(F.col(f"{check}.source") == "llm"), F.count_if(done)), "llm_rate"),
        r(F.try_divide(F.count_if(F.col(f"{check}.accepted")), F.count_if(done)), "accepted_rate"), r(F.avg(f"{check}.gain"), "mean_gain"),
    )


def _walk(value, path: str = "$") -> Iterator[tuple[str, object]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _walk(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _walk(v, f"{path}[{i}]")
    else:
        yield path, value


_DATE = re.compile(r"\b(?:19|20)\d{2}[-/]\d{2}[-/]\d{2}\b")
#: Paths of dates that are about the record, not known to the forecast: prefix and suffix.
AUDIT_PATHS = ("$.personas_used.", ".research_cutoff")


def json_dates(df: DataFrame, key: str, column: str, audit: tuple[str, str] = AUDIT_PATHS) -> DataFrame:
    """(key, path, date) of every date mention in JSON records, audit paths aside; text that isn't JSON has none."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf[column]):
                try:
                    record = json.loads(text or "null")
                except ValueError:
                    continue
                for path, value in _walk(record):
                    if isinstance(value, str) and not (path.startswith(audit[0]) and path.endswith(audit[1])):
                        rows += [(k, path, d.replace("/", "-")) for d in _DATE.findall(value)]
            yield pd.DataFrame(rows, columns=[key, "path", "date"])

    kind = dict(df.dtypes)[key]
    return df.select(key, column).mapInPandas(walk, f"`{key}` {kind}, path string, date string").withColumn("date", F.try_to_date("date", "yyyy-MM-dd")).filter("date IS NOT NULL")


def leakage_scan(df: DataFrame, key: str, column: str, cutoff: str, examples: int = 3) -> DataFrame:
    """(key, mentions, future, leaked, examples): date mentions after the record's cutoff, with a few paths."""
    found = json_dates(df, key, column).join(df.select(key, cutoff), key)
    late = F.col("date") > F.col(cutoff)
    ranked = found.withColumn("_late", late).withColumn("_k", F.row_number().over(Window.partitionBy(key, "_late").orderBy("path", "date")))
    sums = ranked.groupBy(key).agg(F.count("*").alias("mentions"), F.count_if("_late").alias("future"), F.array_sort(F.collect_list(F.when(F.col("_late") & (F.col("_k") <= examples), F.col("path")))).alias("examples"))
    out = df.select(key).join(sums, key, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("mentions", "future")})
    return out.withColumn("leaked", F.col("future") > 0).withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))


@F.pandas_udf(StringType())
def first_json(text: pd.Series) -> pd.Series:
    """First balanced {...} of each text if it is a JSON object, else null; braces inside strings don't count."""

    def find(s: str | None) -> str | None:
        start = (s or "").find("{")
        if start < 0:
            return None
        try:
            value, end = json.JSONDecoder().raw_decode(s, start)
        except ValueError:
            return None
        return s[start:end] if isinstance(value, dict) else None

    return text.map(find)
