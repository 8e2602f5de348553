"""Phrase collocations from stripes: each prefix keys a counter of the words that follow it.

Tasks read whole texts and make stripes: for a prefix of no, one, two or three
words the words that follow it, with their counts. Stripes of one prefix are
merged elementwise. A merged stripe has the prefix's extensions and their counts
(the counts of phrases one word longer), the largest of which is what may
subsume the prefix. The stripe of no word, which has all words, and those that
begin with one of the words that make up a HOT-th of the corpus each (at most HOT
words) are cut into shards by a hash of the next word, so they are merged in
many tasks.

A phrase is frequent only if its parts are. So the text is read three times: for
words, for pairs of frequent words, and for phrases of three and four words of
frequent pairs. What is frequent is told to tasks by a bitmap of BITS bits, the
same at every size of the corpus: a clash lets a rare phrase be counted, which
the count then drops; it never hides a frequent one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarterlight.llm.common import save, table

LONGEST, LEAST, COVER, TOP = 4, 30, 80, 2000
#: Bits of the bitmap of frequent phrases (8 MB).
BITS = 1 << 26
#: Shards of the stripe of no word, and of stripes that begin with a frequent word; a word is frequent from one in HOT words on.
WORD_SHARDS, SHARDS, HOT = 4096, 16, 4000
#: Bytes of text that are counted together, and the most of one text that is cut at a time.
LOT, SLICE = 16_000_000, 4_000_000
#: Groups into which a language's candidates are dealt before the last ranking.
DEALT = 64

_U = np.uint64
#: A-Z become a-z, ends of pieces a line feed, tabs a space.
_FOLD = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_END = b"\n"


def slices(text: bytes, size: int = SLICE) -> Iterator[tuple[list[bytes], int]]:
    """Words of a text, with _END between pieces: (words, how many of them the slice before had). A slice starts with the last words of the one before."""
    text = text.translate(_FOLD)
    carried: list[bytes] = []
    at = 0
    while at < len(text):
        to = at + size
        if to < len(text):
            cut = max(text.rfind(b" ", at, to), text.rfind(_END, at, to))
            if cut < 0:  # one word is longer than a slice
                cuts = [x for x in (text.find(b" ", to), text.find(_END, to)) if x >= 0]
                cut = min(cuts, default=len(text) - 1)
            to = cut + 1
        words = [w for w in text[at:to].replace(_END, b" \n ").split(b" ") if w]
        yield carried + words, len(carried)
        carried = (carried + words)[-(LONGEST - 1) :]
        at = to


class _Lot:
    """Word numbers of texts of one language, with the hashes of their words."""

    def __init__(self, lang: str):
        self.lang, self.bytes, self.known, self.parts, self.fresh = lang, 0, {_END: 0}, [], []

    def add(self, words: list[bytes], old: int) -> None:
        known = self.known
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
        self.parts += [ids, np.zeros(1, np.int32)]
        fresh = np.ones(len(ids) + 1, bool)
        fresh[:old] = False
        self.fresh.append(fresh)

    def ready(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.known), np.uint64, len(self.known))
        return np.concatenate(self.parts), np.concatenate(self.fresh), hashes


def _mix(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ word) * _U(0x9E3779B97F4A7C15)
    return (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)


def _seed(lang: str) -> np.uint64:
    return _U(xxhash.xxh3_64_intdigest(lang.encode()))


def _has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> _U(64 - (64 * len(bitmap)).bit_length() + 1)
    return (bitmap[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) > 0


def _stripes(lot: _Lot, sizes: tuple[int, ...], bitmap: np.ndarray | None, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stripes of a lot for phrases of these sizes all of whose parts are in the bitmap (words of pairs, pairs of longer phrases); hot: hashes of frequent words."""
    ids, fresh, hashes = lot.ready()
    names = pa.array(list(lot.known), pa.binary()).cast(pa.string())
    usable = ids > 0
    single = _mix(np.full(len(hashes), _seed(lot.lang)), hashes)
    shards = np.where(np.isin(single, hot), SHARDS, 1)
    if bitmap is not None and 2 in sizes:
        usable &= _has(bitmap, single)[ids]
    if bitmap is not None and max(sizes) > 2:
        pair = usable[:-1] & usable[1:]
        at = np.flatnonzero(pair)
        pair[at] = _has(bitmap, _mix(single[ids[at]], hashes[ids[at + 1]]))
    for size in sizes:
        if len(ids) < size:
            continue
        n = len(ids) - size + 1
        good = fresh[size - 1 :].copy()
        if size < 3:
            for j in range(size):
                good &= usable[j : j + n]
        else:
            for j in range(size - 1):
                good &= pair[j : j + n]
        places = np.flatnonzero(good)
        if not len(places):
            continue
        rows = [ids[places + j] for j in range(size)]
        # number the prefixes, then prefix, shard and next word make one key
        prefix = rows[0].astype(np.int64) if size > 1 else np.zeros(len(places), np.int64)
        for row in rows[1:-1]:
            _, prefix = np.unique(prefix * len(hashes) + row, return_inverse=True)
        of = shards[rows[0]] if size > 1 else WORD_SHARDS
        shard = (hashes[rows[-1]] % _U(max(SHARDS, WORD_SHARDS))).astype(np.int64) % of
        order = np.argsort((prefix * WORD_SHARDS + shard) * len(hashes) + rows[-1])
        prefix, shard, last, stand = prefix[order], shard[order], rows[-1][order], places[order]
        new_key = np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (shard[1:] != shard[:-1])])
        new = new_key | np.concatenate([[True], last[1:] != last[:-1]])
        entries = np.flatnonzero(new)
        counts = np.diff(np.concatenate([entries, [len(new)]]))
        stripes = np.flatnonzero(new_key[entries])
        offsets = pa.array(np.concatenate([stripes, [len(entries)]]), pa.int32())
        heads = stand[entries[stripes]]
        words = [names.take(pa.array(ids[heads + j])) for j in range(size - 1)]
        text = pc.binary_join_element_wise(*words, " ") if len(words) > 1 else words[0] if words else pa.array([""] * len(heads))
        joined = lambda x: pc.binary_join(pa.ListArray.from_arrays(offsets, x), " ")  # noqa: E731  words have no spaces
        columns = [pa.array([lot.lang] * len(heads)), pa.array(np.full(len(heads), size), pa.int32()), text, pa.array(shard[entries[stripes]], pa.int32()), joined(names.take(pa.array(last[entries]))), joined(pa.array(counts).cast(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "size", "prefix", "shard", "next", "counts"])


STRIPES = "lang string, size int, prefix string, shard int, next string, counts string"


def stripes(docs: DataFrame, sizes: tuple[int, ...], bitmap: np.ndarray | None = None, hot: Sequence[int] = (), lot_bytes: int = LOT) -> DataFrame:
    """Stripes of docs (lang, text) for phrases of these sizes: a row for each prefix, shard and lot of a task, with the next words and their counts, space-joined."""
    held = docs.sparkSession.sparkContext.broadcast((bitmap, np.array(sorted(hot), np.uint64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots: dict[str, _Lot] = {}
        all_bytes = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                raw = text.as_py()
                if not raw:
                    continue
                for words, old in slices(raw):
                    lot = lots.get(lang) or lots.setdefault(lang, _Lot(lang))
                    lot.add(words, old)
                    taken = min(len(raw), SLICE)
                    lot.bytes += taken
                    all_bytes += taken
                    if all_bytes >= lot_bytes:  # the largest lot goes
                        lang_out = max(lots, key=lambda k: lots[k].bytes)
                        out = lots.pop(lang_out)
                        all_bytes -= out.bytes
                        yield from _stripes(out, sizes, *held.value)
        for out in lots.values():
            yield from _stripes(out, sizes, *held.value)

    return docs.select("lang", "text").mapInArrow(count, STRIPES)


def merged(parts: DataFrame) -> DataFrame:
    """(lang, size, prefix, next, f): stripes of one prefix and shard come together and are added elementwise."""
    met = parts.repartition("lang", "size", "prefix", "shard")
    pairs = F.arrays_zip(F.split("next", " ").alias("next"), F.split("counts", " ").alias("n"))
    entries = met.select("lang", "size", "prefix", "shard", F.explode(pairs).alias("_e"))
    entries = entries.select("lang", "size", "prefix", "shard", F.col("_e.next").alias("next"), F.col("_e.n").cast("long").alias("_n"))
    return entries.groupBy("lang", "size", "prefix", "shard", "next").agg(F.sum("_n").alias("f")).drop("shard")


def bitmap_of(frequent: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bitmap of the phrases (lang, phrase): at most bits / 64 numbers come to the driver, whatever the corpus."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = np.array([_seed(lang)])
                for w in phrase.encode("utf-8", "surrogatepass").split(b" "):
                    h = _mix(h, np.array([xxhash.xxh3_64_intdigest(w)], np.uint64))
                found.append(h[0])
            at = np.array(found, np.uint64) >> _U(64 - bits.bit_length() + 1)
            yield pa.RecordBatch.from_arrays([pa.array((at >> _U(6)).astype(np.int64)), pa.array((_U(1) << (at & _U(63))).view(np.int64))], names=["at", "bits"])

    bitmap = np.zeros(bits // 64, np.uint64)
    got = frequent.select("lang", "phrase").mapInArrow(place, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    bitmap[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return bitmap


def frequent_phrases(docs: DataFrame, least: int = LEAST, bits: int = BITS, lot_bytes: int = LOT) -> tuple[DataFrame, DataFrame]:
    """(lang, size, prefix, next, phrase, f) of all phrases of up to LONGEST words with f >= least, and (lang, n): all words."""

    def named(df: DataFrame) -> DataFrame:
        return df.filter(F.col("f") >= least).withColumn("phrase", F.when(F.col("size") == 1, F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next")))

    words = save(merged(stripes(docs, (1,), lot_bytes=lot_bytes)), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    single = named(words)
    # words of one in HOT, of which there are HOT at most
    much = (words.agg(F.sum("f")).first()[0] or 0) / HOT
    hot = [_mix(np.array([_seed(r.lang)]), np.array([xxhash.xxh3_64_intdigest(r.next.encode())], np.uint64))[0] for r in words.filter(F.col("f") > much).collect()]
    pairs = save(named(merged(stripes(docs, (2,), bitmap_of(single, bits), hot, lot_bytes))), "pairs")
    longer = save(named(merged(stripes(docs, tuple(range(3, LONGEST + 1)), bitmap_of(pairs, bits), hot, lot_bytes))), "longer")
    return single.unionByName(pairs).unionByName(longer), totals


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, top: int | None = TOP, bits: int = BITS, lot_bytes: int = LOT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): phrases of 2 to LONGEST words by their weakest cut.

    docs: lang, text; other columns don't matter. A null language is `und`, a null
    or empty text has no words; repeated rows count each. Words are case-folded in
    A-Z alone and end at spaces and tabs, pieces at . , ; : ! ? and line ends. A
    phrase goes if one with a word more, itself frequent, has at least `cover`
    percent of its occurrences. Ties: larger a, then the phrase in byte order.
    top None returns all. bits and lot_bytes bound memory and change no result.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    found, totals = frequent_phrases(docs, least, bits, lot_bytes)
    counts = found.select("lang", "phrase", "f")
    longer = found.filter("size > 2")
    # the largest extension on either side: that of a prefix is its stripe's maximum
    right = longer.select("lang", F.col("prefix").alias("phrase"), "f")
    left = longer.select("lang", F.expr("substring_index(phrase, ' ', 1 - size)").alias("phrase"), "f")
    covers = right.unionByName(left).groupBy("lang", "phrase").agg(F.max("f").alias("_over"))
    dec = "decimal(38,0)"
    candidates = found.filter("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"))
    kept = candidates.join(covers, ["lang", "phrase"], "left").filter(F.col("_over").isNull() | (F.col("_over").cast(dec) * 100 < F.col("a").cast(dec) * cover)).drop("_over")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("_first", F.expr("substring_index(phrase, ' ', k)")).withColumn("_rest", F.expr("substring_index(phrase, ' ', k - size)"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("_first"), F.col("f").alias("l")), ["lang", "_first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("_rest"), F.col("f").alias("r")), ["lang", "_rest"])
    scored = cuts.withColumn("score", F.expr(f"(cast(a as {dec}) * 2000000) div (cast(l as {dec}) + cast(r as {dec}))"))
    best = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k")).alias("_b")).select("lang", "phrase", "_b.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        dealt = Window.partitionBy("lang", "_part").orderBy(*order)
        best = best.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(DEALT))).withColumn("_r", F.row_number().over(dealt)).filter(F.col("_r") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
cut AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
words AS (SELECT lang, w, len(w) AS m FROM cut WHERE len(w) > 0),
grams AS (SELECT lang, k AS size, unnest(list_transform(range(1, m - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
          FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE m >= k),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
freq AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f FROM f WHERE f >= 30),
cand AS (SELECT * FROM freq WHERE size > 1),
subs AS (SELECT lang, array_to_string(w[s:s + k - 1], ' ') AS phrase, f
         FROM cand, (SELECT unnest([2, 3]) AS k), (SELECT unnest([1, 2, 3]) AS s) WHERE k < size AND s + k - 1 <= size),
covers AS (SELECT lang, phrase, max(f) AS over_f FROM subs GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN covers v ON c.lang = v.lang AND c.phrase = v.phrase WHERE v.over_f IS NULL OR 100::HUGEINT * v.over_f < 80::HUGEINT * c.f),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f::HUGEINT + y.f) AS score
         FROM kept c, (SELECT unnest([1, 2, 3]) AS k), freq x, freq y
         WHERE k < c.size AND x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ') AND y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score::BIGINT AS score FROM ranked r JOIN totals t ON r.lang = t.lang WHERE r.rank <= 2000
"""
