"""Approximate nearest neighbours by stable projections and a kd-tree.

Vectors are projected by a few Gaussian (2-stable) directions: the squared
projected distance of two vectors over their squared distance is distributed as
chi-square with as many degrees of freedom. A kd-tree over the projections
hands out neighbours in rising projected distance, each is verified on the
original vectors, and a query stops when any vector nearer than its k-th best
would, by the chi-square test at level CONFIDENCE, have come already.

The top of the tree is fitted on a bounded sample and deals the vectors into
cells; a query first visits its own cell, and then those that its stopping
radius reaches, in rounds of one, two, four and so on, the nearest first: after
each round the radius is drawn in by what was found. Inner products become distances by one more coordinate that
brings all vectors to the largest norm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarterlight.llm.common import lookup, save, table

#: Projections, and the chi-square level at which a query stops.
DIMENSIONS, CONFIDENCE = 12, 0.95
#: Vectors of a cell (about) and of a leaf, cells at most, and vectors of the sample that fits the cells.
CELL, LEAF, MOST_CELLS, SAMPLE = 8192, 256, 4096, 20_000
#: Vectors and queries at most (about) that meet in one task.
BLOCK, QUERIES = 16_384, 4096
#: Queries whose products with a leaf are made together, and the part of the norms' product by which these may be off.
TOGETHER, SLACK = 1024, 1e-12
#: Parts that equal vectors are first cut down in.
SALTS = 8


def chi_square_quantile(p: float, k: int) -> float:
    """x with P(X <= x) = p for X chi-square with an even k: bisection on the closed form."""
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))
    low, high = 0.0, 10.0 * k + 100
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return high


class Cells:
    """Top of the kd-tree: cuts at medians of the sample, the widest direction each time."""

    def __init__(self, sample: np.ndarray, count: int):
        self.cuts: list[tuple[int, float, int, int]] = []  # direction, place, left, right; a negative child is a cell
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self._grow(sample, count, np.full(sample.shape[1], -np.inf), np.full(sample.shape[1], np.inf))

    def _grow(self, points: np.ndarray, count: int, low: np.ndarray, high: np.ndarray) -> int:
        direction = int(np.argmax(np.ptp(points, axis=0))) if len(points) > 1 else 0
        place = float(np.median(points[:, direction])) if len(points) > 1 else 0.0
        right = points[:, direction] > place if len(points) > 1 else np.empty(0, bool)
        if count < 2 or not right.any():
            self.low.append(low)
            self.high.append(high)
            return -len(self.low)
        at = len(self.cuts)
        self.cuts.append((direction, place, 0, 0))
        left_high, right_low = high.copy(), low.copy()
        left_high[direction] = right_low[direction] = place
        a = self._grow(points[~right], (count + 1) // 2, low, left_high)
        b = self._grow(points[right], count // 2, right_low, high)
        self.cuts[at] = (direction, place, a, b)
        return at

    def of(self, points: np.ndarray) -> np.ndarray:
        """Cell of each point."""
        node = np.zeros(len(points), np.int64) if self.cuts else np.full(len(points), -1)
        cuts = np.array([c[:2] for c in self.cuts]), np.array([c[2:] for c in self.cuts], np.int64)
        while (inner := np.flatnonzero(node >= 0)).size:
            direction, place = cuts[0][node[inner], 0].astype(int), cuts[0][node[inner], 1]
            right = points[inner, direction] > place
            node[inner] = cuts[1][node[inner], right.astype(int)]
        return -node - 1

    def reached(self, points: np.ndarray, radius2: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Cells that meet the ball around each point, the nearest first, and their squared distances."""
        low, high = np.array(self.low), np.array(self.high)
        out = []
        for p, r in zip(points, radius2):
            far = np.square(np.maximum(0, np.maximum(low - p, p - high))).sum(axis=1)
            order = np.argsort(far, kind="stable")[: int((far <= r).sum())]
            out.append((order, far[order]))
        return out


class Leaves:
    """kd-tree of one block: its points in leaves of about LEAF, and the leaves' boxes."""

    def __init__(self, points: np.ndarray):
        self.order: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            own = todo.pop()
            if len(own) <= LEAF:
                self.order.append(own)
                continue
            direction = int(np.argmax(np.ptp(points[own], axis=0)))
            half = np.argpartition(points[own, direction], len(own) // 2)
            todo += [own[half[: len(own) // 2]], own[half[len(own) // 2 :]]]
        self.low = np.array([points[x].min(axis=0) for x in self.order])
        self.high = np.array([points[x].max(axis=0) for x in self.order])

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared projected distance from each point to each leaf's box."""
        out = np.zeros((len(points), len(self.order)))
        for d in range(points.shape[1]):
            p = points[:, d : d + 1]
            out += np.square(np.maximum(0, np.maximum(self.low[:, d] - p, p - self.high[:, d])))
        return out


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner product of each row of a with that of b: one order of summing for each pair, wherever it stands."""
    return (a * b).sum(axis=1)


def search_block(vectors: np.ndarray, ids: np.ndarray, points: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, query_points: np.ndarray, worst2: np.ndarray, norm2: float, k: int, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the up to k best of a block for each query.

    worst2: squared distance of the k-th best known before, inf if none. A query
    takes the leaves in rising distance until the next is beyond
    worst2 * stop, the projected radius that holds all nearer ones at the level
    of the test. Queries at one leaf are verified together: a matrix product
    picks those that may be among the k best, to SLACK of the norms, as its last
    bits depend on the place; these have their exact sums made and are ranked by them.
    """
    leaves = Leaves(points)
    far = leaves.distances(query_points)
    rank = np.argsort(far, axis=1, kind="stable")
    best = np.full((len(queries), k), -np.inf)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
    # inner product p means squared distance |q|^2 + M^2 - 2 p
    length2 = np.square(queries).sum(axis=1)
    base, slack = length2 + norm2, SLACK * np.sqrt(length2 * norm2)
    worst = worst2.copy()
    active = np.arange(len(queries))
    for step in range(len(leaves.order)):
        leaf = rank[active, step]
        live = far[active, leaf] <= worst[active] * stop
        active, leaf = active[live], leaf[live]
        if not len(active):
            break
        by = np.argsort(leaf, kind="stable")
        edges = np.flatnonzero(np.diff(leaf[by], prepend=-1))
        for start, end in zip(edges, [*edges[1:], len(by)]):
            here = leaves.order[leaf[by[start]]]
            for at in range(start, end, TOGETHER):
                who = active[by[at : min(at + TOGETHER, end)]]
                scores = queries[who] @ vectors[here].T
                scores[query_ids[who][:, None] == ids[here][None, :]] = -np.inf
                least = best[who, -1]
                if len(here) > k:
                    least = np.maximum(least, np.partition(scores, len(here) - k, axis=1)[:, len(here) - k])
                row, column = np.nonzero(scores >= (least - slack[who])[:, None])
                column = column[kept := scores[row, column] > -np.inf]
                row = row[kept]
                if not len(row):
                    continue
                count = np.bincount(row, minlength=len(who))
                place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                both = np.full((len(who), k + count.max()), -np.inf)
                both_ids = np.full(both.shape, np.iinfo(np.int64).max)
                both[:, :k], both_ids[:, :k] = best[who], best_id[who]
                both[row, k + place], both_ids[row, k + place] = exact(queries[who[row]], vectors[here[column]]), ids[here[column]]
                order = np.lexsort((both_ids, -both), axis=1)[:, :k]
                best[who], best_id[who] = np.take_along_axis(both, order, 1), np.take_along_axis(both_ids, order, 1)
                worst[who] = np.minimum(worst[who], np.maximum(0, base[who] - 2 * best[who, -1]))
    found = np.isfinite(best)
    return np.repeat(query_ids, found.sum(axis=1)), best_id[found], best[found]


def chunks_by_cell(routed: DataFrame) -> DataFrame:
    """(cell, chunks) of the cells that queries come to: as many chunks as their own queries fill. At most MOST_CELLS rows."""
    return F.broadcast(save(routed.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("chunks")), "chunks"))


def for_chunks(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """blocks once for each chunk of queries that comes to their cell, and not at all where none comes."""
    return blocks.join(chunks, "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")


def in_chunks(routed: DataFrame, chunks: DataFrame) -> DataFrame:
    return routed.join(chunks, "cell").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(2)), F.col("chunks")).cast("int")).drop("chunks")


def valid(vectors: DataFrame) -> DataFrame:
    """id, vec_id and embedding as doubles of the vectors that take part: not null, not zero, all components finite. id numbers the rows in the order of vec_id, nulls last."""
    double = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("v IS NOT NULL")
    fine = double.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    order = [F.asc_nulls_last("vec_id"), F.xxhash64("v")]
    return fine.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE, cell: int = CELL) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each query, ties to the smaller vec_id.

    vectors: vec_id, embedding (extra columns aside). Queries are the rows whose
    vec_id is divisible by `every`, candidates all rows of the query's length but
    its own: rows with repeated ids are queries and candidates each, rows with a
    null id are candidates (the last of equal ones). Null, empty, zero and non-finite
    vectors take no part. Vectors of unlike length are searched apart. Of equal
    vectors the k + 1 first are indexed, as no result can hold more, so a vector
    that a third of the rows share is no hot cell. With at most k candidates all
    are returned.
    """
    rows = save(valid(vectors).withColumn("same", F.xxhash64("v")).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), "vectors")
    found = None
    for length, norm2 in sorted((r.n, r.most) for r in rows.groupBy(F.size("v").alias("n")).agg(F.max("norm2").alias("most")).collect()):
        one = _nearest(rows.filter(F.size("v") == length), length, norm2, every, k, dimensions, confidence, cell)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    names = rows.select(F.col("id").alias("_row"), "vec_id")
    named = lookup(found.withColumnRenamed("query_row", "_row"), names.withColumnRenamed("vec_id", "query_id"), "_row").drop("_row")
    return lookup(named.withColumnRenamed("row", "_row"), names, "_row").select("query_id", "rank", "vec_id", "score")


def _nearest(rows: DataFrame, length: int, norm2: float, every: int, k: int, dimensions: int, confidence: float, cell: int) -> DataFrame:
    """query_row, rank, row, score for rows (id, vec_id, v, same, norm2) with vectors of one length."""
    directions = np.random.default_rng(7).standard_normal((length + 1, dimensions))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["v"].to_numpy())
                lift = np.sqrt(np.maximum(0, norm2 - pdf["norm2"].to_numpy()))
                yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "p": list(np.hstack([v, lift[:, None]]) @ directions), "q": list(v @ directions[:-1])})

    one = lambda by, limit, df: df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).filter(F.col("_k") <= limit).drop("_k")
    few = one(["same", "v"], k + 1, one(["same", "v", "salt"], k + 1, rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))).drop("salt"))
    projected = "id long, v array<double>, p array<double>, q array<double>"
    points = save(few.select("id", "v", "norm2").mapInPandas(project, projected), "points")
    asked = save(rows.filter(F.col("vec_id") % every == 0).select("id", "v", "norm2").mapInPandas(project, projected).drop("p"), "queries")

    m = points.count()
    sampled = points.select("id", "p") if m <= SAMPLE else points.select("id", "p").filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / m))
    sample = np.array([r["p"] for r in sampled.orderBy(F.xxhash64("id")).limit(SAMPLE).collect()]).reshape(-1, dimensions)
    cells = Cells(sample, min(MOST_CELLS, max(1, round(m / cell))))
    per_cell = max(1, m // len(cells.low))
    splits = max(1, round(per_cell / BLOCK))
    stop = chi_square_quantile(confidence, dimensions)

    @F.pandas_udf("int")
    def cell_of(p: pd.Series) -> pd.Series:
        return pd.Series(cells.of(np.stack(p.to_numpy())).astype("int32")) if len(p) else pd.Series([], dtype="int32")

    @F.pandas_udf("array<struct<cell: int, far2: double>>")
    def reached(q: pd.Series, worst2: pd.Series) -> pd.Series:
        found = cells.reached(np.stack(q.to_numpy()), worst2.to_numpy() * stop) if len(q) else []
        return pd.Series([[{"cell": int(c), "far2": float(d)} for c, d in zip(*x)] for x in found], dtype=object)

    blocks = save(points.select("id", "v", "p", cell_of("p").alias("cell"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(splits)).cast("int").alias("part")), "blocks")
    schema = "query_row long, row long, score double"

    def visit(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_row": pd.Series([], dtype="int64"), "row": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        if not len(left) or not len(right):
            return empty
        stack = lambda df, c: np.stack(df[c].to_numpy())
        who, what, score = search_block(stack(left, "v"), left["id"].to_numpy(), stack(left, "p"), stack(right, "v"), right["id"].to_numpy(), stack(right, "q"), right["worst2"].to_numpy(), norm2, k, stop)
        return pd.DataFrame({"query_row": who, "row": what, "score": score}) if len(who) else empty

    def run(routed: DataFrame) -> DataFrame:
        """routed: id, v, q, worst2, cell."""
        chunks = chunks_by_cell(routed)
        held, sent = blocks.transform(for_chunks, chunks), in_chunks(routed, chunks).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
        keys = ["cell", "part", "chunk"]
        return held.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(visit, schema)

    inf = float("inf")
    top = Window.partitionBy("query_row").orderBy(F.desc("score"), "row")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)

    def drawn_in(queries: DataFrame, found: DataFrame) -> DataFrame:
        """queries with worst2 after what was found: the squared distance of the k-th best, inf if there are fewer."""
        kth = found.groupBy(F.col("query_row").alias("id")).agg(F.min("score").alias("_s"), F.count("*").alias("_n"))
        worst2 = F.when(F.col("_n") >= k, F.greatest(F.lit(0.0), F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) + norm2 - 2 * F.col("_s"))).otherwise(inf)
        return queries.drop("worst2").join(kth, "id", "left").withColumn("worst2", worst2).drop("_s", "_n")

    home = save(asked.withColumn("cell", cell_of("q")).withColumn("worst2", F.lit(inf)), "home")
    found = save(ranked(run(home)), "near")
    # a query is one row here, with the list of its other cells, the nearest first
    left = drawn_in(home, found).withColumn("cells", F.filter(reached("q", "worst2"), lambda x: x["cell"] != F.col("cell"))).drop("cell")
    left = save(left.filter(F.size("cells") > 0), "routed")
    taken = 1
    while not left.isEmpty():
        sent = left.withColumn("cell", F.explode(F.transform(F.slice("cells", 1, taken), lambda x: x["cell"]))).drop("cells")
        found = save(ranked(found.drop("rank").unionByName(run(sent))), "near")
        rest = drawn_in(left.withColumn("cells", F.slice("cells", taken + 1, F.greatest(F.size("cells"), F.lit(1)))), found)
        rest = rest.withColumn("cells", F.filter("cells", lambda x: x["far2"] <= F.col("worst2") * stop))
        left = save(rest.filter(F.size("cells") > 0), "routed")
        taken *= 2
    return found


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
