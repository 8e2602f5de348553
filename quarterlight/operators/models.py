"""Model fitting and scoring on tables, with Spark ML and sums of cross products."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def temporal_split(df: DataFrame, date: str, train_end: str, val_end: str) -> DataFrame:
    """Adds split: train, val or test by date."""
    return df.withColumn("split", F.when(F.col(date) <= train_end, "train").when(F.col(date) <= val_end, "val").otherwise("test"))


def usable_features(df: DataFrame, features: Sequence[str], more_than: int = 50) -> list[str]:
    """Features with more than so many values, counted in one pass."""
    counts = df.agg(*[F.count(c).alias(c) for c in features]).first()
    return [c for c in features if counts[c] > more_than]


def standardize(train: DataFrame, features: Sequence[str], out: str = "scaled") -> PipelineModel:
    """Scaler fitted on the training rows alone (sample standard deviation)."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="skip"), StandardScaler(inputCol="_v", outputCol=out, withMean=True, withStd=True)]).fit(train)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds weight n / (classes * n of the class). Classes are few and their counts are broadcast."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    sums = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    weights = counts.crossJoin(F.broadcast(sums)).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(weights), label)


def balanced_logistic(train: DataFrame, features: Sequence[str], label: str, reg: float = 0.01) -> PipelineModel:
    """Multinomial logistic regression with balanced class weights on standardised features."""
    scaler = standardize(train, features)
    model = LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="weight", family="multinomial", regParam=reg, maxIter=100).fit(class_weights(scaler.transform(train), label))
    return PipelineModel(stages=[*scaler.stages, model])


def with_probabilities(model: PipelineModel, df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df with a probability column for each class and prediction, of a fitted balanced_logistic; rows with a null feature go.

    The fitted numbers become column expressions, so scoring is part of the
    query's own generated code.
    """
    assembler, scaler, logistic = model.stages
    features = assembler.getInputCols()
    mean, std, weights, bias = scaler.mean.toArray(), scaler.std.toArray(), logistic.coefficientMatrix.toArray(), logistic.interceptVector.toArray()
    z = [(F.col(c) - float(m)) / float(s) if s > 0 else F.lit(0.0) for c, m, s in zip(features, mean, std)]
    logits = [sum((x * float(w) for x, w in zip(z, row)), F.lit(float(b))) for row, b in zip(weights, bias)]
    most = F.greatest(*logits) if len(logits) > 1 else logits[0]
    parts = [F.exp(x - most) for x in logits]
    total = sum(parts[1:], parts[0])
    out = df.dropna(subset=list(features)).withColumns({n: p / total for n, p in zip(names, parts)})
    largest = F.greatest(*[F.col(n) for n in names[: len(parts)]]) if len(parts) > 1 else F.col(names[0])
    return out.withColumn("prediction", F.coalesce(*[F.when(F.col(n) == largest, i) for i, n in enumerate(names[: len(parts)])]).cast("double"))


_erfc = np.frompyfunc(math.erfc, 1, 1)


def _phi(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distribution and density of the normal law."""
    return _erfc(-z / math.sqrt(2)).astype(float) / 2, np.exp(-np.minimum(z * z, 1e4) / 2) / math.sqrt(2 * math.pi)


def _probit_terms(x: np.ndarray, y: np.ndarray, beta: np.ndarray, cuts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, score and Hessian in (beta, cuts), summed over the rows."""
    eta, ends = x @ beta, np.concatenate([[-np.inf], cuts, [np.inf]])
    up, low = np.clip(ends[y + 1] - eta, -37, 37), np.clip(ends[y] - eta, -37, 37)
    # differences are taken on the side where the law is small
    flip = low > 0
    p = _phi(np.where(flip, -low, up))[0] - _phi(np.where(flip, -up, low))[0]
    p = np.maximum(p, 1e-300)
    a = np.where(y == len(cuts), 0.0, _phi(up)[1] / p)
    b = np.where(y == 0, 0.0, _phi(low)[1] / p)
    at_up, at_low = (np.column_stack([-x, y[:, None] == np.arange(len(cuts)) + shift]).astype(float) for shift in (0, 1))
    score = a @ at_up - b @ at_low
    cross = (at_up * (a * b)[:, None]).T @ at_low
    hessian = (at_up * (-up * a - a * a)[:, None]).T @ at_up + (at_low * (low * b - b * b)[:, None]).T @ at_low + cross + cross.T
    return float(np.log(p).sum()), score, hessian


@dataclass
class OrderedProbit:
    """P(y <= j) = Phi(cut j - x beta) on standardised features. gradient: the largest part of the score at the fit, by row."""

    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    cuts: np.ndarray
    loglik: float
    gradient: float
    rows: int


def ordered_probit(train: DataFrame, features: Sequence[str], label: str, classes: int = 3, rounds: int = 60) -> OrderedProbit:
    """The joint maximum of an ordered probit's likelihood by Newton steps; a label is 0 .. classes - 1.

    Each step is one aggregate of the log-likelihood, its score and its Hessian;
    a step that lowers the likelihood or puts cut points out of order is halved.
    Rows with a null feature or label go. A feature without variance has no part.
    Where the features part the classes without error no maximum exists: the steps
    end after `rounds`. A class without rows has probability 0.
    """
    k = len(features)
    rows = train.dropna(subset=[*features, label]).select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(label).cast("int").alias("y")).filter(F.col("y").between(0, classes - 1))
    said = rows.agg(*[f(f"x{i}").alias(f"{n}{i}") for i in range(k) for n, f in (("m", F.avg), ("s", F.stddev_samp))], *[F.sum((F.col("y") == j).cast("long")).alias(f"n{j}") for j in range(classes)]).first()
    mean, std = (np.array([said[f"{n}{i}"] or 0.0 for i in range(k)]) for n in "ms")
    n = np.array([said[f"n{j}"] or 0 for j in range(classes)], float)
    total = max(int(n.sum()), 1)
    scale = np.where(std > 1e-12, 1 / np.maximum(std, 1e-12), 0.0)
    seen = np.flatnonzero(n)
    m, place = max(len(seen) - 1, 0), np.cumsum(n > 0) - 1
    size = 1 + (k + m) + (k + m) ** 2

    def summed(beta: np.ndarray, cuts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(size)
            for batch in batches:
                if len(batch):
                    x = (np.column_stack([batch.column(i).to_numpy() for i in range(k)]) - mean) * scale
                    ll, score, hessian = _probit_terms(x, place[batch.column(k).to_numpy()], beta, cuts)
                    held += np.concatenate([[ll], score, hessian.reshape(-1)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(held)], names=["at", "v"])

        found = rows.mapInArrow(part, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas().sort_values("at")["v"].to_numpy()
        return float(found[0]), found[1 : 1 + k + m], found[1 + k + m :].reshape(k + m, k + m)

    cuts = np.array([NormalDist().inv_cdf(c) for c in np.cumsum(n[seen])[:-1] / total])
    beta = np.zeros(k)
    now = summed(beta, cuts)
    for _ in range(rounds):
        ll, score, hessian = now
        if np.abs(score).max(initial=0.0) <= 1e-9 * total:
            break
        step = np.linalg.lstsq(-hessian, score, rcond=1e-12)[0]
        share, new = 1.0, None
        while share > 1e-6:
            to_beta, to_cuts = beta + share * step[:k], cuts + share * step[k:]
            new = summed(to_beta, to_cuts) if (np.diff(to_cuts) > 0).all() else None
            if new and new[0] >= ll - 1e-12 * abs(ll):
                break
            share, new = share / 2, None
        if new is None:
            break
        beta, cuts, now = to_beta, to_cuts, new
    ends = np.concatenate([[-37.0], cuts, [37.0]])
    cuts = ends[[int((n[: j + 1] > 0).sum()) for j in range(classes - 1)]]
    return OrderedProbit(list(features), mean, scale, np.where(scale > 0, beta, 0.0), cuts, now[0], float(np.abs(now[1]).max(initial=0.0)) / total, total)


def score_probit(model: OrderedProbit, df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df with the classes' probabilities, which add to one; rows with a null feature go."""

    @F.pandas_udf("array<double>")
    def p(*columns: pd.Series) -> pd.Series:
        eta = ((np.column_stack([c.to_numpy(float) for c in columns]) - model.mean) * model.scale) @ model.beta
        ends = np.column_stack([np.zeros(len(eta)), *(_phi(c - eta)[0] for c in model.cuts), np.ones(len(eta))])
        return pd.Series(list(np.diff(ends, axis=1)), dtype=object)

    scored = df.dropna(subset=model.features).withColumn("_p", p(*[F.col(c).cast("double") for c in model.features]))
    return scored.withColumns({n: F.col("_p")[i] for i, n in enumerate(names)}).drop("_p")


def _lagged(df: DataFrame, columns: Sequence[str], p: int, entity: str, order: str) -> tuple[DataFrame, list[str]]:
    w = Window.partitionBy(entity).orderBy(order)
    names = ["_one"] + [f"_{c}_{k}" for k in range(1, p + 1) for c in columns]
    out = df.withColumn("_one", F.lit(1.0)).withColumns({f"_{c}_{k}": F.lag(c, k).over(w) for k in range(1, p + 1) for c in columns})
    return out.dropna(subset=[*names, *columns]), names


def gram_sums(df: DataFrame, x: Sequence[str], y: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by, n, xx, xy): number of rows and sums of products, as flat arrays. One aggregation, partly done before the shuffle."""
    xx = [F.sum(F.col(a) * F.col(b)) for a in x for b in x]
    xy = [F.sum(F.col(a) * F.col(b)) for a in x for b in y]
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.array(*xx).alias("xx"), F.array(*xy).alias("xy"))


def solve(sums: DataFrame, key: str, kx: int, ky: int, least: int, ridge: float = 0.0) -> DataFrame:
    """(key, beta): coefficients of each row's normal equations, kx by ky as a flat array; rows with fewer than `least` observations go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, n, xx, xy in zip(pdf[key], pdf["n"], pdf["xx"], pdf["xy"]):
                if n >= least:
                    a = np.array(xx).reshape(kx, kx)
                    beta = np.linalg.lstsq(a + ridge * np.trace(a) / kx * np.eye(kx), np.array(xy).reshape(kx, ky), rcond=None)[0]
                    out.append((k, beta.reshape(-1).tolist()))
            yield pd.DataFrame(out, columns=[key, "beta"])

    kind = dict(sums.dtypes)[key]
    return sums.mapInPandas(run, f"`{key}` {kind}, beta array<double>")


def panel_var(df: DataFrame, columns: Sequence[str], p: int, entity: str, order: str) -> DataFrame:
    """Residuals and fitted values of a vector autoregression of order p for each entity, for rows p + 1 on.

    Only matrices of k * p + 1 rows reach Python; residuals come from a join and
    arithmetic.
    """
    ready, names = _lagged(df, columns, p, entity, order)
    beta = solve(gram_sums(ready, names, columns, [entity]), entity, len(names), len(columns), len(names) + 1)
    k = len(columns)
    fitted = {c: sum((F.col(x) * F.col("beta")[i * k + j] for i, x in enumerate(names)), F.lit(0.0)) for j, c in enumerate(columns)}
    out = ready.join(beta, entity).withColumns({f"fit_{c}": v for c, v in fitted.items()})
    return out.withColumns({f"res_{c}": F.col(c) - F.col(f"fit_{c}") for c in columns}).drop("beta", *names)


def _products(ready: DataFrame, columns: Sequence[str], entity: str) -> DataFrame:
    """(entity, n, products): number of rows and sums of the columns' products with each other, flat. Tasks add up what they read, and their sums meet."""
    width = len(columns)

    def frame(held: dict) -> pd.DataFrame:
        return pd.DataFrame({entity: list(held), "n": [v[0] for v in held.values()], "products": [v[1].reshape(-1) for v in held.values()]})

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for key, rows in pdf.groupby(entity):
                z = rows[list(columns)].to_numpy(float)
                n, products = held.get(key, (0, 0.0))
                held[key] = (n + len(z), products + z.T @ z)
            if len(held) > 20_000:
                yield frame(held)
                held = {}
        yield frame(held)

    parts = ready.filter(F.col(entity).isNotNull()).select(entity, *[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(part, f"`{entity}` {dict(ready.dtypes)[entity]}, n long, products array<double>")
    placed = parts.select(entity, "n", F.posexplode("products").alias("_at", "_v")).groupBy(entity, "_at").agg(F.sum("n").alias("n"), F.sum("_v").alias("_v"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda p: p["_v"])
    return placed.groupBy(entity).agg(F.first("n").alias("n"), listed.alias("products")).filter(F.size("products") == width * width)


def choose_order(df: DataFrame, columns: Sequence[str], most: int, entity: str, order: str) -> DataFrame:
    """(entity, p): order from 0 to `most` with the least Akaike criterion, ties to the smaller, all orders over the rows with `most` rows before them.

    One matrix of products an entity serves every order: an order's equations are
    its leading block. Orders with no more rows than unknowns aren't considered;
    an entity without a row that has `most` before it doesn't come.
    """
    ready, x = _lagged(df, columns, most, entity, order)
    k, width = len(columns), len(x)
    sums = _products(ready, [*x, *columns], entity)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, n, flat in zip(pdf[entity], pdf["n"], pdf["products"]):
                m = np.array(flat).reshape(width + k, -1)
                scores = []
                for p in range(most + 1):
                    q = 1 + k * p
                    if p == 0 or n > q + k:
                        beta = np.linalg.lstsq(m[:q, :q], m[:q, width:], rcond=None)[0]
                        rest = m[width:, width:] - m[width:, :q] @ beta
                        scores.append(np.linalg.slogdet((rest + rest.T) / 2 / n + 1e-12 * np.eye(k))[1] + 2 * k * q / n)
                out.append((key, next(p for p, v in enumerate(scores) if v <= min(scores) + 1e-9)))
            yield pd.DataFrame(out, columns=[entity, "p"])

    return sums.mapInPandas(choose, f"`{entity}` {dict(df.dtypes)[entity]}, p int")


def panel_var_by_order(df: DataFrame, columns: Sequence[str], most: int, entity: str, order: str) -> DataFrame:
    """Residuals and fitted values of an autoregression for each entity, of the order that choose_order gives it, with that order as p: rows p + 1 on."""
    w = Window.partitionBy(entity).orderBy(order)
    k = len(columns)
    # lags beyond an entity's order are zero and get no weight
    lags = {f"_{c}_{j}": F.when(F.col("p") >= j, F.lag(c, j).over(w)).otherwise(0.0) for j in range(1, most + 1) for c in columns}
    x = ["_one", *lags]
    ready = df.join(choose_order(df, columns, most, entity, order), entity).withColumns({"_one": F.lit(1.0), **lags}).dropna(subset=[*x, *columns])
    rows_of = lambda start, n: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(x) - 1)), lambda i: F.slice("products", i * (len(x) + k) + start + 1, n)))
    sums = _products(ready, [*x, *columns], entity).select(entity, "n", rows_of(0, len(x)).alias("xx"), rows_of(len(x), k).alias("xy"))
    beta = solve(sums, entity, len(x), k, 1)
    fitted = {c: sum((F.col(v) * F.col("beta")[i * k + j] for i, v in enumerate(x)), F.lit(0.0)) for j, c in enumerate(columns)}
    out = ready.join(beta, entity).withColumns({f"fit_{c}": v for c, v in fitted.items()})
    return out.withColumns({f"res_{c}": F.col(c) - F.col(f"fit_{c}") for c in columns}).drop("beta", *x)


def rolling_var(df: DataFrame, columns: Sequence[str], entity: str, order: str, least: int = 16) -> DataFrame:
    """One-step forecast of the change of the first column from a VAR(1) fitted on all earlier rows: (entity, order, delta), null with fewer than `least`.

    Levels are centred by entity first. Cumulative sums of products over one
    sorted pass give every fit; a row's small system is solved in Python.
    """
    means = df.groupBy(entity).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    centred = df.join(means, entity).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])
    ready, x = _lagged(centred, columns, 1, entity, order)
    past = Window.partitionBy(entity).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda ys: F.array(*[F.sum(F.col(a) * F.col(b)).over(past) for a in x for b in ys])
    rows = ready.withColumns({"n": F.count("*").over(past), "xx": sums(x), "xy": sums([columns[0]]), "_x": F.array(*x), "_last": F.lag(columns[0]).over(Window.partitionBy(entity).orderBy(order))})
    kx = len(x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            delta = []
            for n, xx, xy, v, last in zip(pdf["n"], pdf["xx"], pdf["xy"], pdf["_x"], pdf["_last"]):
                beta = np.linalg.lstsq(np.array(xx).reshape(kx, kx), np.array(xy), rcond=None)[0] if n >= least else None
                delta.append(None if beta is None else float(np.dot(v, beta) - v[1]))
            yield pd.DataFrame({entity: pdf[entity], order: pdf[order], "delta": pd.Series(delta, dtype="float64", index=pdf.index)})

    kinds = dict(df.dtypes)
    return rows.select(entity, order, "n", "xx", "xy", "_x", "_last").mapInPandas(run, f"`{entity}` {kinds[entity]}, `{order}` {kinds[order]}, delta double")


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], key: str, seed: int = 1) -> DataFrame:
    """(feature, importance): mean absolute change of the probabilities when a feature's values are dealt anew.

    A row takes the value of the row that follows it in a seeded order of its
    bucket (one for every few thousand rows), so no window runs over all rows.
    """
    names = [f"_p{i}" for i in range(model.stages[-1].numClasses)]
    p = lambda d: with_probabilities(model, d, names).withColumn("_p", F.array(*names))
    buckets = max(1, df.count() // 4096)
    base = df.withColumn("_b", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(buckets)))
    w = Window.partitionBy("_b").orderBy(F.xxhash64(key, F.lit(seed + 1)), key)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = None
    own = p(base).select(key, F.col("_p").alias("_own"))
    for f in features:
        moved = base.withColumn(f, F.coalesce(F.lead(f).over(w), F.first(f).over(every)))
        change = F.aggregate(F.zip_with("_p", "_own", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x) / F.size("_p")
        one = p(moved).select(key, "_p").join(own, key).agg(F.avg(change).alias("importance")).select(F.lit(f).alias("feature"), "importance")
        out = one if out is None else out.unionByName(one)
    return out


def coefficients(model: PipelineModel, features: Sequence[str], row: int, n: int = 5) -> DataFrame:
    """(feature, coefficient, sign) of the n largest coefficients of one class; as many rows as features at most."""
    from pyspark.sql import SparkSession

    values = model.stages[-1].coefficientMatrix.toArray()[row]
    rows = sorted(((f, float(v)) for f, v in zip(features, values)), key=lambda x: (-abs(x[1]), x[0]))[:n]
    return SparkSession.getActiveSession().createDataFrame([(f, v, "hawkish" if v > 0 else "dovish") for f, v in rows], "feature string, coefficient double, sign string")
