"""Near duplicates among vectors with an inverted multi-index.

Vectors are scaled to length one and cut into halves. Each half has a codebook of
its own, fitted on a bounded sample; the product of the two is a grid of cells,
and each vector stands in the cell of its nearest codewords, under its label. A
vector visits cells in rising order of how much of the link radius they take (the
multi-sequence order): to leave its own cell for another, half a vector has to
cross the plane between two codewords, and the squares of the two crossings add
up. No vector within the radius lies in a cell that takes more than the whole of
it: with recall 1 the visits end there. Below 1 they end where that share of
sampled vectors would still be met by partners at exactly the least similarity.
What is met is verified on the original vectors.

Equal vectors stand for each other and are counted. A cell of many vectors is
dealt into blocks, each of which meets all visitors in tasks of its own; tasks
return a count for each vector and a spanning forest of the links they found, not
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlight.llm.common import lookup, save, table
from quarterlight.llm.near_dup import classes

SIMILARITY, RECALL = 0.93, 0.999
#: Vectors that the codebooks are fitted on, and those of them that the visits are measured on.
SAMPLE, MEASURED = 20_000, 1_000
#: Vectors by cell, and codewords by half at least and at most.
CELL, FEWEST, MOST = 1024, 4, 256
#: Members of a cell that meet visitors in one task, and visitors that meet them at a time.
BLOCK, VISITORS = 1024, 4096
#: Visits of vectors that a task hands on at a time.
LOT = 512


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _nearest(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances to all codewords, and the nearest."""
    d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1), 0)
    return d, d.argmin(axis=1)


def codewords(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means of the rows of x from distinct rows; at most k codewords."""
    x0 = np.unique(x, axis=0)
    words = x0[np.random.default_rng(7).permutation(len(x0))[:k]]
    for _ in range(rounds):
        _, near = _nearest(x, words)
        n = np.bincount(near, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], words)
    return words


class MultiIndex:
    """Two codebooks and the reach of a visit, for vectors of one length."""

    def __init__(self, sample: np.ndarray, k: int, similarity: float = SIMILARITY, recall: float = RECALL):
        self.cut = sample.shape[1] // 2
        self.words = [codewords(h, k) for h in self._halves(sample)]
        self.gaps = [np.sqrt(np.maximum(((w[:, None] - w[None]) ** 2).sum(2), 1e-300)) for w in self.words]
        self.radius2 = 2 - 2 * similarity
        self.reach2 = self.radius2 * (1 + 1e-9)
        if recall < 1:
            self.reach2 = min(self.reach2, self._measured(sample[:MEASURED], similarity, recall))

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut], x[:, self.cut :]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row: codeword of the first half times the number of codewords, plus that of the second."""
        i, j = (_nearest(h, w)[1] for h, w in zip(self._halves(x), self.words))
        return i * len(self.words[1]) + j

    def taken(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Square of the way from each row's halves to each codeword's region, at least."""
        out = []
        for h, w, gap in zip(self._halves(x), self.words, self.gaps):
            d, own = _nearest(h, w)
            ahead = d - d[np.arange(len(d)), own][:, None]
            out.append((ahead / (2 * gap[own])) ** 2 * (ahead > 0))
        return out[0], out[1]

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) within reach in the order in which the sum over both halves rises: a row's own cell comes first."""
        one, two = self.taken(x)
        row, i, j = np.nonzero(one[:, :, None] + two[:, None, :] <= self.reach2)
        order = np.lexsort((one[row, i] + two[row, j], row))
        return row[order], (i * len(self.words[1]) + j)[order]

    def _measured(self, sample: np.ndarray, similarity: float, recall: float) -> float:
        """The reach that meets this share of partners at the least similarity: each row with partners in random directions and towards other rows."""
        rng = np.random.default_rng(11)
        most = []
        for k in range(20):
            aim = rng.standard_normal(sample.shape) if k % 2 else sample[rng.permutation(len(sample))] + 1e-9 * rng.standard_normal(sample.shape)
            aside = aim - (aim * sample).sum(1)[:, None] * sample
            length = np.linalg.norm(aside, axis=1, keepdims=True)
            partner = similarity * sample + np.sqrt(1 - similarity**2) * aside / np.maximum(length, 1e-12)
            one, two = self.taken(sample)
            i, j = np.divmod(self.cells(partner), len(self.words[1]))
            at = np.arange(len(sample))
            most.append(one[at, i] + two[at, j])
        return float(np.quantile(np.concatenate(most), recall, method="higher"))


def codewords_for(rows: int) -> int:
    """Codewords by half so that a cell of an even grid has CELL rows."""
    return int(min(MOST, max(FEWEST, round((rows / CELL) ** 0.5))))


def _vectors(column: pa.Array) -> np.ndarray:
    """Binary vectors of one length as rows of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


VALID = "vec_id long, label string, size int, key string, vector binary"


def valid(df: DataFrame) -> DataFrame:
    """(row, vec_id, label, size, key, vector): rows of df (vec_id, embedding, label) that may have links have a vector: doubles, divided by a power of two near their largest, and its hash as the key."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for v, label in zip(batch.column(1), batch.column(2)):
                x = None
                if v.is_valid and label.is_valid and len(v.values):
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    x = x if v.values.null_count == 0 and np.isfinite(x).all() and x.any() else None
                if x is not None:
                    x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) + 0.0  # exact but for what underflows; no negative zero
                sizes.append(None if x is None else len(x))
                found.append(None if x is None else x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int32()), pa.array(found, pa.binary())], names=["vec_id", "label", "size", "vector"])

    read_rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label")).mapInArrow(read, "vec_id long, label string, size int, vector binary")
    return read_rows.withColumn("row", F.monotonically_increasing_id()).withColumn("key", F.when(F.col("vector").isNotNull(), F.concat_ws(" ", F.sha2("vector", 256), F.sha2("label", 256))))


def _forest(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links enough to join all that (left, right) join."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for a, b in zip(left.tolist(), right.tolist()):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


FOUND = "row long, other long, links long"


def _meet(members: tuple, visitors: tuple, similarity: float, found: dict[int, int], links: list) -> None:
    """Counts and links between the members of a block and the visitors: row numbers, vectors, copies, and for visitors whether they stand in this cell."""
    ids, x, copies = members
    who, y, n, at_home = visitors
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    near = y @ x.T / (ny[:, None] * nx[None]) >= similarity
    near &= ~at_home[:, None] | (who[:, None] < ids[None])  # of two in one cell the first counts
    i, j = np.nonzero(near)
    if not len(i):
        return
    for rows, total in ((who, near @ copies), (ids, n @ near)):
        for r, t in zip(rows[total > 0].tolist(), total[total > 0].tolist()):
            found[r] = found.get(r, 0) + t
    links += _forest(who[i], ids[j])


def links(reps: DataFrame, index: dict[int, MultiIndex], similarity: float = SIMILARITY, block: int = BLOCK, visitors_at_once: int = VISITORS) -> DataFrame:
    """(row, other, links) of distinct vectors (row, label, size, vector, copies): how many rows' vectors are linked with row's (other null), in portions, and links (row, other) that join all that are linked."""
    held = reps.sparkSession.sparkContext.broadcast(index)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for size in np.unique(sizes):
                of_size = batch.take(pa.array(np.flatnonzero(sizes == size)))
                for at in range(0, len(of_size), LOT):
                    part = of_size.slice(at, LOT)
                    if size in held.value:
                        x = unit(_vectors(part.column(2)))
                        row, cell = held.value[size].visits(x)
                        own = held.value[size].cells(x)
                    else:  # a length that the sample lacks: one cell
                        row, own = np.arange(len(part)), np.zeros(len(part), np.int64)
                        cell = own
                    # of two cells the visitor is in the one with the larger number
                    go = cell <= own[row]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[go])), pa.array(cell[go]), pa.array(cell[go] == own[row[go]])], names=["row", "cell", "home"])

    # narrow rows first: a cell where nothing stands is dropped before a vector is sent to it
    visits = save(reps.select("row", "size", "vector").mapInArrow(placed, "row long, cell long, home boolean").join(reps.select("row", "label", "size"), "row"), "visits")
    place = ["label", "size", "cell"]
    cells = save(visits.filter("home").groupBy(*place).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "cells")
    met = visits.join(cells, place)
    stand = met.filter("home").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).withColumn("role", F.lit(0))
    # the visitors of a block of a cell come in parts as well
    guests = save(met.groupBy(*place).agg(F.ceil(F.count("*") / (16 * visitors_at_once)).cast("int").alias("parts")), "guests")
    stand = stand.join(guests, place).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    come = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(guests, place).withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts")).cast("int")).withColumn("role", F.lit(1))
    meeting = [*place, "block", "part"]
    columns = [*meeting, "role", "row", "home"]
    dealt = stand.select(*columns).unionByName(come.select(*columns)).join(reps.select("row", "vector", "copies"), "row").select(*columns, "vector", "copies")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, visitors, found, joined = None, [], [], {}, []

        def gathered(parts: list[tuple]) -> tuple:
            return tuple(np.concatenate(x) for x in zip(*parts))

        def end_visits() -> None:
            nonlocal visitors
            if members and visitors:
                m, v = gathered(members), gathered(visitors)
                for at in range(0, len(v[0]), visitors_at_once):
                    _meet(m[:3], tuple(x[at : at + visitors_at_once] for x in v), similarity, found, joined)
            visitors = []

        def handed() -> pa.RecordBatch:
            rows = list(found) + [a for a, _ in joined]
            other = [None] * len(found) + [b for _, b in joined]
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(other, pa.int64()), pa.array(list(found.values()) + [None] * len(joined), pa.int64())], names=["row", "other", "links"])

        for batch in batches:
            keys = [batch.column(k).to_pylist() for k in range(5)]
            keys = list(zip(*keys))
            role, row, home, copies = batch.column(5).to_numpy(), batch.column(6).to_numpy(), batch.column(7).to_numpy(zero_copy_only=False), batch.column(9).to_numpy()
            edges = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or role[i] != role[i - 1]]
            for start, end in zip([0, *edges], [*edges, len(keys)]):
                if start == end:
                    continue
                if keys[start] != key:
                    end_visits()
                    key, members = keys[start], []
                    if len(found) + len(joined) > 100_000:
                        yield handed()
                        found, joined = {}, []
                part = (row[start:end], _vectors(batch.column(8).slice(start, end - start)), copies[start:end], home[start:end])
                (visitors if role[start] else members).append(part)
                if sum(len(x[0]) for x in visitors) >= visitors_at_once:
                    end_visits()
        end_visits()
        yield handed()

    return dealt.repartition(*meeting).sortWithinPartitions(*meeting, "role").mapInArrow(compare, FOUND)


def fitted(reps: DataFrame, rows: int, similarity: float, recall: float, codewords_by_half: int | None = None) -> dict[int, MultiIndex]:
    """Codebooks by length of the vectors, fitted on the SAMPLE vectors of smallest hash; rows: how many there are."""
    k = codewords_by_half or codewords_for(rows)
    sample = reps.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) <= (1 << 20) * min(1.0, 2 * SAMPLE / max(rows, 1))).orderBy(F.xxhash64("key"), "row").limit(SAMPLE).select("size", "vector").toPandas()
    return {int(size): MultiIndex(unit(np.stack([np.frombuffer(v) for v in group["vector"]])), k, similarity, recall) for size, group in sample.groupby("size") if len(group) >= 2 * k and size > 1}


def vector_classes(df: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, codewords_by_half: int | None = None, block: int = BLOCK, visitors_at_once: int = VISITORS) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each row of df (vec_id, embedding, label).

    Rows of one label are linked from a cosine of `similarity` on. Rows are known
    by a number, not their vec_id: repeated ids are rows of their own, and a null
    id stays null. Null labels, null, empty and zero vectors and those with null or
    infinite components link with nothing, as do vectors of unlike lengths. A
    component's id is the smallest id in it, null if it has none; kept holds where
    both are equal or both null. Other columns of df don't matter.
    """
    rows = save(valid(df), "vectors")
    able = rows.filter("vector IS NOT NULL")
    # rows of one key are copies: the first stands for them
    copies = able.groupBy("key").agg(F.min("row").alias("_first"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    firsts = save(copies, "firsts")
    reps = save(able.join(firsts.select(F.col("_first").alias("row"), "copies"), "row"), "reps")
    index = fitted(reps, reps.count(), similarity, recall, codewords_by_half)
    found = save(links(reps, index, similarity, block, visitors_at_once), "links")
    counts = found.filter("other IS NULL").groupBy("row").agg(F.sum("links").alias("links"))
    joined = classes(found.filter("other IS NOT NULL").select(F.greatest("row", "other").alias("a"), F.least("row", "other").alias("b")))
    ends = firsts.select("key", F.col("_first").alias("row"), "copies", "least").join(counts, "row", "left").join(joined.withColumnRenamed("id", "row"), "row", "left")
    ends = save(ends.select("key", "least", F.coalesce("class", "row").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "ends")
    named = save(ends.groupBy("class").agg(F.min("least").alias("component_id")), "named")
    known = lookup(ends, named, "class").select("key", "n_links", "component_id")
    out = lookup(rows.select("vec_id", "key"), save(known, "known"), "key")
    alone = F.col("key").isNull()
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_classes(table(spark, sf_dir, "embeddings"))
