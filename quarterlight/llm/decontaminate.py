"""Benchmark decontamination by winnowing.

Of the k-grams of words in each run of WINDOW - K + 1 of them the one with the
smallest hash is kept, on both sides, so a shared span of WINDOW words shares a
kept k-gram at the same place. Where a document's kept k-gram is one of the
benchmark's, the windows of WINDOW words around it are compared word by word.
An item of fewer words is one window of its own length; for each such length
the documents' grams of that length are looked up, which is winnowing with one
gram to a run.

A benchmark of up to INDEXED_BYTES is indexed once and goes to every task, and
documents aren't shuffled. Of a larger one the fingerprints of both sides are
joined by Spark, then the words of the windows around the hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarterlight.llm.common import save, shielded, table
from quarterlight.llm.words import WordHash, alnum_words

#: Words of a window and of a k-gram.
WINDOW, K = 10, 5
#: Bytes of benchmark text that are indexed for every task.
INDEXED_BYTES = 8 << 20
#: Document words that a task looks at together (a longer document is one such lot).
LOT_WORDS = 400_000
#: Bits of the bitmap of short items (1 MB).
BITS = 1 << 23

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_HIGH = np.uint64(0xFFFFFFFFFFFFFFFF)


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive ids."""
    count = len(ids) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(count, np.uint64)
    for j in range(n):
        h = h * _MULT + ids[j : j + count]
    h ^= h >> np.uint64(31)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def winnow(hashes: np.ndarray, run: int) -> np.ndarray:
    """Positions of the smallest hash of each `run` consecutive ones, the last of equal ones."""
    count = len(hashes) - run + 1
    if count <= 0:
        return np.empty(0, np.int64)
    best, at = hashes[:count].copy(), np.arange(count)
    for j in range(1, run):
        here = hashes[j : j + count]
        less = here <= best
        best[less] = here[less]
        at[less] = np.flatnonzero(less) + j
    return np.unique(at)


def _window_hashes(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """gram_hashes of n ids at each start."""
    h = np.zeros(len(starts), np.uint64)
    for j in range(n):
        h = h * _MULT + ids[starts + j]
    h ^= h >> np.uint64(31)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


class BenchmarkIndex:
    """Words of the items one after the other, places of their windows by hash, and the winnowed k-grams by which documents find them.

    items: (number, text) with numbers from 0. Built once, and sent to tasks.
    """

    def __init__(self, items: list[tuple[int, str]]):
        vocabulary: dict[bytes, int] = {}
        words = [[vocabulary.setdefault(w, len(vocabulary) + 1) for w in alnum_words(text)] for _, text in items]
        lengths = np.array([len(w) for w in words], np.int64)
        #: A 0 is no word and keeps items apart.
        self.ids = np.fromiter((i for w in words for i in (*w, 0)), np.uint64, int(lengths.sum()) + len(words))
        begins = np.cumsum(lengths + 1) - lengths - 1
        number = np.array([i for i, _ in items], np.int64)
        kept, self.windows, offsets, listed = [], {}, [np.zeros(1, np.int64)], [np.empty(0, np.int64)]
        for n in np.unique(np.minimum(lengths[lengths > 0], WINDOW)).tolist():
            which = np.flatnonzero(np.minimum(lengths, WINDOW) == n)
            count = lengths[which] - n + 1
            starts = np.repeat(begins[which] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            hashes, item = _window_hashes(self.ids, starts, n), np.repeat(number[which], count)
            order = np.argsort(hashes, kind="stable")
            hashes, starts, item = hashes[order], starts[order], item[order]
            # each window once, and each of its items once
            new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
            for j in range(n):
                new[1:] |= self.ids[starts[1:] + j] != self.ids[starts[:-1] + j]
            first = np.flatnonzero(new)
            pairs = np.unique((np.cumsum(new) - 1) * len(items) + item)
            # windows are numbered over all lengths
            self.windows[n] = (hashes[first], starts[first], sum(len(x) for x in offsets) - 1)
            offsets.append(offsets[-1][-1] + np.searchsorted(pairs // len(items), np.arange(len(first)), "right"))
            listed.append(pairs % len(items))
            if n == WINDOW:
                for i in which:
                    grams = gram_hashes(self.ids[begins[i] : begins[i] + lengths[i]], K)
                    kept.append(grams[winnow(grams, WINDOW - K + 1)])
        self.offsets, self.listed = np.concatenate(offsets), np.concatenate(listed)
        self.fingerprints = np.unique(np.concatenate(kept)) if kept else np.empty(0, np.uint64)
        self.vocabulary = vocabulary

    def hits(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(start, length, window) of the windows that occur in ids, a place once whatever the number of items; an id of 0 is no benchmark word."""
        for n, (hashes, windows, base) in self.windows.items():
            if len(ids) < n:
                continue
            if n == WINDOW:
                grams = gram_hashes(ids, K)
                at = winnow(grams, WINDOW - K + 1)
                starts = around(at[np.isin(grams[at], self.fingerprints)], len(ids))
                looked = _window_hashes(ids, starts, n)
            else:
                looked = gram_hashes(ids, n)
                starts = np.flatnonzero(np.isin(looked, hashes))
                looked = looked[starts]
            # windows of one hash are one but for clashes
            first = np.searchsorted(hashes, looked, "left")
            size = np.searchsorted(hashes, looked, "right") - first
            place = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            which = np.repeat(np.arange(len(size)), size)
            same = np.ones(len(place), bool)
            for j in range(n):
                same &= self.ids[windows[place] + j] == ids[starts[which] + j]
            yield starts[which[same]], n, base + place[same]

    def items_of(self, windows: np.ndarray) -> np.ndarray:
        """Items with one of these windows, rising."""
        windows = np.unique(windows)
        first, n = self.offsets[windows], self.offsets[windows + 1] - self.offsets[windows]
        return np.unique(self.listed[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())])


def around(at: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows that hold the k-grams at these places."""
    starts = np.unique(at[:, None] - np.arange(WINDOW - K + 1))
    return starts[(starts >= 0) & (starts <= length - WINDOW)]


def _scan(index: BenchmarkIndex, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
    """For each text its number of words, the hit spans (start, end in words; joined) and the items with a window in it."""
    get, ids, starts = index.vocabulary.get, [], []
    at = 0
    for text in texts:
        own = np.fromiter(map(get, words := alnum_words(text), repeat(0)), np.uint64, len(words))
        # words that no benchmark has keep spans of two documents apart
        ids += [own, np.zeros(WINDOW, np.uint64)]
        starts.append((at, len(own)))
        at += len(own) + WINDOW
    joined = np.concatenate(ids) if ids else np.empty(0, np.uint64)
    edge = np.zeros(len(joined) + 1, np.int64)
    found_at, found_window = [], []
    for start, n, windows in index.hits(joined):
        edge += np.bincount(start, minlength=len(edge)) - np.bincount(start + n, minlength=len(edge))
        found_at.append(start)
        found_window.append(windows)
    where = np.concatenate(found_at) if found_at else np.empty(0, np.int64)
    which = np.concatenate(found_window) if found_window else np.empty(0, np.int64)
    order = np.argsort(where, kind="stable")
    where, which = where[order], which[order]
    covered = np.cumsum(edge) > 0
    out = []
    for start, n in starts:
        lo, hi = np.searchsorted(where, [start, start + n])
        if lo == hi:
            out.append((n, [], []))
            continue
        change = np.flatnonzero(np.diff(np.concatenate([[False], covered[start : start + n], [False]]).astype(np.int8)))
        out.append((n, list(zip(change[::2].tolist(), change[1::2].tolist())), index.items_of(which[lo:hi]).tolist()))
    return out


FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<long>"


def find_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with n_words, spans (start and end in words, joined where they touch) and items (sorted ids with a window in the text).

    benchmark: item_id long, text. Null and empty texts have no words. Documents
    keep all columns but those of the three names, which are replaced; repeated
    and null doc_ids are rows like others, which nothing here looks at. Repeated
    item ids count once; windows of items without an id are hit, but can't be
    listed. Of no documents there are none, with no benchmark none is hit.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    kept = docs.drop("n_words", "spans", "items")
    return _by_index(kept, items) if size <= INDEXED_BYTES else _by_join(kept, items)


def _by_index(docs: DataFrame, items: DataFrame) -> DataFrame:
    """items: at most INDEXED_BYTES of text."""
    place = docs.columns.index("text")
    rows = items.orderBy("item_id", "text").collect()
    listed = [r["item_id"] for r in rows]
    shared = docs.sparkSession.sparkContext.broadcast(BenchmarkIndex([(i, r["text"]) for i, r in enumerate(rows)]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts, found, lot, size = batch.column(place), [], [], 0
            for text in texts:
                lot.append(text.as_py())
                size += len(lot[-1] or "")
                if size > 5 * LOT_WORDS:
                    found += _scan(index, lot)
                    lot, size = [], 0
            found += _scan(index, lot)
            n, spans, which = zip(*found) if found else ((), (), ())
            ids = [sorted({listed[i] for i in w} - {None}) for w in which]
            more = [pa.array(n, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], span), pa.array(ids, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "n_words", "spans", "items"])

    return docs.mapInArrow(scan, StructType(docs.schema.fields + StructType.fromDDL(FOUND).fields))


PRINTS = "array<struct<n:int,at:int,print:long>>"


def bitmap_of(hashes: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bitmap of a column `print` of hashes: of one size whatever their number, and a clash only lets a place be looked at in vain."""
    at = F.pmod(F.col("print"), F.lit(bits))
    words = hashes.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(pmod(print, 64) as int))").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).view(np.uint64)
    return bitmap


def _there(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def fingerprints(words: list[bytes], hashes: WordHash, short: list[int], known: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(window length, place, hash) of a text's winnowed k-grams, and of its grams of each short length that may be known."""
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    grams = gram_hashes(ids, K)
    at = winnow(grams, WINDOW - K + 1)
    found = [(np.full(len(at), WINDOW), at, grams[at])]
    for n in short:
        grams = gram_hashes(ids, n)
        at = np.arange(len(grams)) if known is None else np.flatnonzero(_there(known, grams))
        found.append((np.full(len(at), n), at, grams[at]))
    return list(zip(*(np.concatenate(x).tolist() for x in ([f[0] for f in found], [f[1] for f in found], [f[2].view(np.int64) for f in found]))))


def _by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Fingerprints of documents meet those of the benchmark by hash, distinct on the benchmark's side, so a frequent one isn't multiplied; then windows meet by their words."""
    row = "_row"
    while row in docs.columns:
        row = f"_{row}"
    numbered = save(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(row).alias("row"), "text")

    def own_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1)):
                words = alnum_words(text.as_py())
                n = min(len(words), WINDOW)
                found = {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else ()
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(found), pa.int64()), pa.array([n] * len(found), pa.int32()), pa.array(list(found), pa.binary())], names=["item", "n", "words"])

    windows = save(items.mapInArrow(own_windows, "item long, n int, words binary").distinct(), "windows")
    lengths = [r["n"] for r in windows.select("n").distinct().collect()]  # WINDOW of them at most
    short = sorted(n for n in lengths if n < WINDOW)

    held = None

    def own_prints(batches: Iterator[pa.RecordBatch], of_items: bool = False) -> Iterator[pa.RecordBatch]:
        hashes, bitmap = WordHash(), held.value if held else None
        kind = pa.list_(pa.struct([("n", pa.int32()), ("at", pa.int32()), ("print", pa.int64())]))
        for batch in batches:
            for i in range(batch.num_rows):
                words = alnum_words(batch.column(1)[i].as_py())
                # of an item only the gram that is all of it counts
                lengths = [n for n in short if not of_items or n == len(words)]
                found = [{"n": n, "at": at, "print": h} for n, at, h in fingerprints(words, hashes, lengths, bitmap)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([len(words)], pa.int64()), pa.array([found], kind)], names=["row", "n_words", "prints"])

    made = f"row long, n_words long, prints {PRINTS}"
    of_items = items.select(F.lit(0).cast("long").alias("row"), "text").mapInArrow(lambda batches: own_prints(batches, True), made)
    known = save(of_items.select(F.explode("prints").alias("p")).select("p.n", "p.print").distinct(), "known")
    if short:
        held = docs.sparkSession.sparkContext.broadcast(bitmap_of(known.filter(F.col("n") < WINDOW)))
    prints = save(texts.mapInArrow(own_prints, made), "prints")
    met = prints.select("row", F.explode("prints").alias("p")).select("row", "p.*").join(known, ["n", "print"], "left_semi")
    places = save(met.groupBy("row").agg(F.collect_list(F.struct("n", "at")).alias("places")), "places")

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, out = alnum_words(batch.column(1)[i].as_py()), []
                places = batch.column(2)[i].as_py()
                for n in {p["n"] for p in places}:
                    at = np.array([p["at"] for p in places if p["n"] == n])
                    out += [(n, s) for s in (around(at, len(words)) if n == WINDOW else at).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * len(out), pa.int64()), pa.array([n for n, _ in out], pa.int32()), pa.array([s for _, s in out], pa.int64()), pa.array([b" ".join(words[s : s + n]) for n, s in out], pa.binary())],
                    names=["row", "n", "start", "words"],
                )

    asked = save(texts.join(places, "row").select("row", "text", "places").mapInArrow(looked, "row long, n int, start long, words binary"), "asked")
    # a place counts once whatever the number of items; items meet each window of a document once
    spans = asked.join(windows.select("n", "words").distinct(), ["n", "words"], "left_semi").groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"))
    which = asked.select("row", "n", "words").distinct().join(windows, ["n", "words"]).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = spans.join(which, "row")
    joined = F.aggregate(
        "spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(x))),
    )
    found = hits.select("row", joined.alias("spans"), "items")
    out = numbered.join(prints.select(F.col("row").alias(row), "n_words"), row).join(found.withColumnRenamed("row", row), row, "left")
    empty = lambda t: F.expr(f"cast(array() as {t})")
    return out.select(*docs.columns, "n_words", F.coalesce("spans", empty("array<struct<start:bigint,end:bigint>>")).alias("spans"), F.coalesce("items", empty("array<bigint>")).alias("items"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark window occurs; columns as in docs, whatever their names.

    Null and empty texts stay; repeated rows stay or go together; with no
    benchmark all stay.
    """
    plain, back = shielded(docs, ["n_words", "spans", "items"])
    return find_benchmark(plain, benchmark).filter(F.size("spans") == 0).select(*plain.columns).withColumnsRenamed(back)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), n AS (SELECT DISTINCT n FROM bw), dg AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n.n AS n, unnest(range(1, len(w) - n.n + 2)) AS i FROM d, n WHERE len(w) >= n.n)
), hit AS (
  SELECT DISTINCT dg.doc_id, dg.i, dg.n, bw.item_id FROM dg JOIN bw ON dg.n = bw.n AND dg.g = bw.g
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places p ON d.doc_id = p.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""
