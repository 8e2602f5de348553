"""Coverage of indicators and documents over countries and years."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def indicator_scores(facts: DataFrame, relevance: Mapping[str, float], n_countries: int, n_years: int, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """code, country_share, cell_share, relevance (largest weight of a contained keyword) and score of facts (country, code, year, value)."""
    weight = F.greatest(*[F.when(F.col("code").contains(k), float(w)).otherwise(0.0) for k, w in relevance.items()], F.lit(0.0))
    shares = facts.groupBy("code").agg(
        F.round(F.countDistinct("country") / float(n_countries), 6).alias("country_share"), F.round(F.count("value") / float(n_countries * n_years), 6).alias("cell_share")
    )
    a, b, c = weights
    return shares.withColumn("relevance", weight).withColumn("score", F.round(a * F.col("relevance") + b * F.col("country_share") + c * F.col("cell_share"), 6))


def keep_top(facts: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """Facts of the n best codes: score, country share, cell share, then code. n bounds the side that is broadcast."""
    best = scores.orderBy(F.desc("score"), F.desc("country_share"), F.desc("cell_share"), "code").limit(n).select("code")
    return facts.join(F.broadcast(best), "code", "left_semi")


def audit(docs: DataFrame, kinds: Sequence[str], enough: int = 5) -> DataFrame:
    """Counts of docs (country, year, kind) by country and year, one column for each kind, and a grade."""
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in kinds]
    return docs.groupBy("country", "year").agg(F.count("*").alias("total"), *counts).withColumn("grade", F.when(F.col("total") >= enough, "ok").otherwise("thin"))


def grid_counts(docs: DataFrame, countries: DataFrame, first: int, last: int, shared_country: str, shared_actor: str) -> DataFrame:
    """Documents of each country and year of the whole grid; one country also has those of actors that match a pattern.

    The pattern's rows are added as rows of that country before the count, so
    the join stays an equality and a document of both kinds counts once.
    """
    grid = countries.select("country", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    own = docs.select("country", "year", "actor")
    shared = docs.filter(F.col("actor").rlike(shared_actor) & (F.col("country") != shared_country)).select(F.lit(shared_country).alias("country"), "year", "actor")
    counts = own.unionByName(shared).groupBy("country", "year").agg(F.count("actor").alias("total"))
    return grid.join(counts, ["country", "year"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
