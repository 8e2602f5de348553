"""From document inventories to events, strategy cards, snapshots and search records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_dedup(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union of inventories (columns that a part lacks are null); of rows with equal keys the first by order stays."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    first = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return whole.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")


def prefer_best(docs: DataFrame, keys: Sequence[str], rank: Column, order: Sequence[str]) -> DataFrame:
    """The lowest by rank, then order, of the rows with equal keys. Filters belong before this: they don't pass its window."""
    first = Window.partitionBy(*keys).orderBy("_rank", *order)
    return docs.withColumn("_rank", rank).withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k", "_rank")


def filter_inventory(docs: DataFrame, years: tuple[int, int], countries: Sequence[str], bad: Sequence[str] = ("fetch_error",)) -> DataFrame:
    return docs.filter(F.col("year").between(*years) & F.col("country").isin(*countries) & ~F.col("doc_type").isin(*bad))


# What a stance presupposes and how it works.
PRECONDITIONS = {
    "tightening": ["inflation above target", "tight labor market"],
    "easing": ["weak demand", "disinflation or financial stress"],
    "hold": ["balanced risks", "data dependence"],
    "communication": ["expectations need guidance"],
}


def strategy_cards(events: DataFrame, key: str, modes: Sequence[str], example: Sequence[str], order: Sequence[str], country: str, last: int = 8) -> DataFrame:
    """One card for each key: the mode of some columns (the smallest on ties), last examples by order, support, countries.

    Examples are cut to `last` for each key before they are gathered, so a key
    with a third of the rows gathers no more than any other.
    """
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    kept = events.withColumn("_k", F.row_number().over(newest)).filter(F.col("_k") <= last)
    examples = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in example if c not in order]))).alias("examples"))
    sums = events.groupBy(key).agg(*[F.mode(c, True).alias(c) for c in modes], F.count("*").alias("support"), F.array_sort(F.collect_set(country)).alias("countries"))
    return sums.join(examples, key)


def card_asof(contexts: DataFrame, cards: DataFrame, key: str, as_of: str, first: int = 5) -> DataFrame:
    """Contexts with their card's examples that are not after as_of, the first ones kept; no card gives an empty array."""
    met = contexts.join(cards.select(key, "examples"), key, "left")
    kept = F.slice(F.filter("examples", lambda x: x["date"] <= F.col(as_of)), 1, first)
    return met.withColumn("examples", F.coalesce(kept, F.array().cast(cards.schema["examples"].dataType)))


def with_context(events: DataFrame, contexts: DataFrame, key: str, defaults: Mapping[str, Column]) -> DataFrame:
    """Events with their context; what is missing takes its default."""
    met = events.join(contexts, key, "left")
    return met.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def rag_records(events: DataFrame, label: Sequence[str], body: Sequence[str]) -> DataFrame:
    """Adds search_text (the label columns) and text (lines `name: value` of the body columns)."""
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in body]
    return events.withColumn("search_text", F.concat_ws(" ", *[F.col(c).cast("string") for c in label])).withColumn("text", F.concat_ws("\n", *lines))


def even_sample(df: DataFrame, year: Column, order: Sequence[str], n: int) -> DataFrame:
    """n evenly spaced rows of each year: places round(i * (N - 1) / (n - 1)), half to even, each once; the middle for n = 1."""
    numbered = df.withColumn("_y", year)
    w = Window.partitionBy("_y")
    placed = numbered.withColumn("_p", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_N", F.count("*").over(w))
    if n == 1:
        return placed.filter(F.col("_p") == F.floor(F.col("_N") / 2)).drop("_y", "_p", "_N")
    wanted = F.array(*[F.bround(F.lit(i) * (F.col("_N") - 1) / F.lit(n - 1)).cast("int") for i in range(n)])
    return placed.filter(F.array_contains(wanted, F.col("_p").cast("int"))).drop("_y", "_p", "_N")


def first_by(df: DataFrame, by: str, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each value of by."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_k") <= n).drop("_k")


def unseen(docs: DataFrame, stored: DataFrame, hash_: str, order: Sequence[str]) -> DataFrame:
    """Documents whose hash isn't stored; of equal ones in the batch the first by order."""
    fresh = docs.join(stored.select(hash_).distinct(), hash_, "left_anti")
    return fresh.withColumn("_k", F.row_number().over(Window.partitionBy(hash_).orderBy(*order))).filter("_k = 1").drop("_k")
