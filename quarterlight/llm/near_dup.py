"""Near duplicates by BagMinHash signatures of the texts' bags of five-word shingles.

A bag is a weight (a count) for each shingle. Along the weight axis of every
shingle and for each of SIZE signature components runs a Poisson process; a
component of the signature is the earliest point below the bag's weights, so two
bags share it with the probability of their weighted Jaccard similarity. The
weight axis is cut into blocks [0,1), [1,2), [2,4), [4,8) ..., each with one
process for all components together, whose points fall to a component and a
place in the block at random: blocks wholly below the weight take every point,
the last takes those that fall below the weight. Points are drawn in rising
time and a block stops once it is later than every component's present minimum.

Signatures are cut into bands. A text is known by its hash and then by a saved
number, never by its document's id: exact copies are one class from the start,
and unlike texts under one id are texts of their own. Band groups don't expand
into pairs: each member meets its group's first, links are checked on the whole
bags, and of groups that then still hold different classes, members are compared
inside tasks, in blocks of bounded size: a pair in the first band that it shares,
if its classes differ, its signatures come near and no link found there has
joined it yet. Tasks return links only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlight.llm.common import hand_back, lookup, may_meet, modest_batches, save, shielded, small, table
from quarterlight.llm.words import WordHash, alnum_words

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of ROWS components: at similarity 0.8 one of BANDS agrees with probability 0.99995.
BANDS, ROWS = 25, 5
SIZE = BANDS * ROWS
#: Members of a band group that meet in one task at most, twice (a block and a block).
BLOCK = 512
#: Rows with one key that a task is given, where one side of a join has many rows for a key and the other has one.
HOT = 2000
#: A pair of a mixed group whose signatures agree less is not checked on the bags: four standard errors below SIMILARITY; 0 checks all.
LEAST_AGREEMENT = SIMILARITY - 4 * (SIMILARITY * (1 - SIMILARITY) / SIZE) ** 0.5

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(words: list[bytes], hashes: WordHash) -> np.ndarray:
    """Hash of each SHINGLE consecutive words; of all words if they are fewer, none if there are none."""
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(ids))
    if not n:
        return ids
    h = np.full(len(ids) - n + 1, n, np.uint64)
    for j in range(n):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + ids[j : j + len(h)])
    return h


def bag(text: str | None, hashes: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, rising, and their counts."""
    return np.unique(shingles(alnum_words(text), hashes), return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, left, right = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][left], b[1][right]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def _blocks(bags: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Document, seed, width and weight inside the block, for each block of each shingle of each bag."""
    doc = np.repeat(np.arange(len(bags)), [len(x[0]) for x in bags])
    seed, weight = np.concatenate([x[0] for x in bags]), np.concatenate([x[1] for x in bags])
    out = [(doc, _mix(seed), np.ones(len(doc)), np.ones(len(doc)))]
    start = 1
    while (weight > start).any():  # the block [start, 2 * start)
        over = weight > start
        doc, seed, weight = doc[over], seed[over], weight[over]
        out.append((doc, _mix(seed + _U(start * 0xD1342543DE82EF95 % 2**64)), np.full(len(doc), float(start)), np.minimum(weight - start, start).astype(float)))
        start *= 2
    return tuple(np.concatenate(x) for x in zip(*out))


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int = SIZE) -> np.ndarray:
    """BagMinHash signatures as times, inf for an empty bag: one row for each bag."""
    least = np.full((len(bags), size), np.inf)
    if not bags:
        return least
    doc, seed, width, inside = _blocks(bags)
    flat, limit, time = least.reshape(-1), np.full(len(bags), np.inf), np.zeros(len(doc))
    step = 0
    while len(doc):
        step += 1
        draw = _mix(seed + _U(step * 0x9E3779B97F4A7C15 % 2**64))
        # the gap to the next of `size * width` points a unit of time
        time = time - np.log(((draw >> _U(11)).astype(float) + 1) * 2.0**-53) / (size * width)
        live = time < limit[doc]
        doc, seed, width, inside, time = doc[live], seed[live], width[live], inside[live], time[live]
        if not len(doc):
            break
        draw = _mix(draw[live] ^ _U(0xA5A5A5A5A5A5A5A5))
        component = ((draw >> _U(32)) * _U(size)) >> _U(32)
        taken = (draw & _U(0xFFFFFFFF)).astype(float) * 2.0**-32 * width < inside  # the place is a whole cell
        np.minimum.at(flat, doc[taken] * size + component[taken].astype(np.int64), time[taken])
        touched = np.unique(doc[taken]) if step < 4 or step % 4 == 0 else doc[:0]
        limit[touched] = least[touched].max(axis=1)
    return least


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), bits.shape[:2]).copy()
    for j in range(bits.shape[2]):
        key = _mix(key * _U(0x9E3779B97F4A7C15) + bits[:, :, j])
    return key.view(np.int64)


def short(signature: np.ndarray) -> np.ndarray:
    """Components as 32-bit integers, to be compared."""
    return (_mix(signature.view(np.uint64)) >> _U(32)).astype(np.uint32)


#: Texts whose copies a task knows again, so that it signs them once.
SEEN = 50_000
SIGNED = "copy string, n long, keys array<long>, signature binary"


def bands(docs: DataFrame, lot_chars: int = 700_000) -> DataFrame:
    """(copy, n, keys, signature) of docs (copy, text): number of shingles, keys of the bands (none for a text without words), short signature.

    Texts with one `copy` are the same; a task signs one of them as long as it remembers it.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        seen: set[bytes] = set()
        for batch in batches:
            ids, lot, size = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if (key := bytes.fromhex(i[:32])) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                ids.append(i)
                lot.append(bag(text.as_py(), hashes))
                size += len(lot[-1][0])
                if size > lot_chars // 6:
                    yield packed(ids, lot)
                    ids, lot, size = [], [], 0
            yield packed(ids, lot)
        hand_back()

    def packed(ids: list, lot: list) -> pa.RecordBatch:
        times = signatures(lot)
        some = np.array([len(x[0]) > 0 for x in lot], bool)
        flat = band_keys(times)[some].reshape(-1) if lot else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(BANDS * some)]), pa.int32()), pa.array(flat, pa.int64()))
        n = pa.array([int(x[1].sum()) for x in lot], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), n, lists, pa.array([x.tobytes() for x in short(times)], pa.binary())], names=["copy", "n", "keys", "signature"])

    return docs.select("copy", "text").mapInArrow(sign, SIGNED)


def _by_group(df: DataFrame, keys: list[str], f, schema: str) -> DataFrame:
    """f(group) -> frame, over the rows with equal keys: tasks read sorted rows and cut them at each new key, as most groups are tiny."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            values = held[keys].to_numpy()
            edges = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *edges[:-1]], edges):
                yield from f(held.iloc[start:end])
            held = held.iloc[edges[-1] :] if len(edges) else held
        if held is not None and len(held):
            yield from f(held)
        hand_back()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(scan, schema)


def _open_pairs(group: pd.DataFrame, similarity: float, least_agreement: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and agreement of the pairs of a block pair that are to be checked here."""
    key, one, two = group[["key", "one", "two"]].iloc[0]
    block, cls, n = group["block"].to_numpy(), group["class"].to_numpy(), group["n"].to_numpy()
    left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
    keys = np.stack(group["keys"].to_numpy())
    sigs = np.frombuffer(b"".join(group["signature"]), np.uint32).reshape(len(group), -1)
    band = int(np.argmax(keys[0] == key))
    found = []
    for a in left:
        to = right[right > a] if one == two else right
        to = to[(cls[to] != cls[a]) & (np.minimum(n[to], n[a]) >= similarity * np.maximum(n[to], n[a]))]
        if len(to):
            to = to[~(keys[to, :band] == keys[a, :band]).any(axis=1)]
        if len(to):
            agree = (sigs[to] == sigs[a]).mean(axis=1)
            near = agree >= least_agreement
            if near.any():
                found.append((np.full(near.sum(), a), to[near], agree[near]))
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def _candidates(group: pd.DataFrame, similarity: float, least_agreement: float) -> Iterator[pd.DataFrame]:
    """Rows of a block pair that have a pair to be checked."""
    if len(group) > 1:
        a, b, _ = _open_pairs(group, similarity, least_agreement)
        if len(a):
            yield group.iloc[np.unique(np.concatenate([a, b]))]


def _links(group: pd.DataFrame, similarity: float, least_agreement: float, hashes: WordHash) -> Iterator[pd.DataFrame]:
    """Links of a block pair that join two classes, nearest signatures first."""
    a, b, agree = _open_pairs(group, similarity, least_agreement)
    ids, cls, texts = group["id"].to_numpy(), group["class"].to_numpy(), group["text"].to_numpy()
    parent: dict[int, int] = {}
    bags: dict[int, tuple] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    def own(i: int) -> tuple:
        if i not in bags:
            bags[i] = bag(texts[i], hashes)
        return bags[i]

    out = []
    for k in np.argsort(-agree, kind="stable"):
        i, j = a[k], b[k]
        x, y = root(cls[i]), root(cls[j])
        if x != y and (alike := weighted_jaccard(own(i), own(j))) >= similarity:
            parent[max(x, y)] = min(x, y)
            out.append((min(ids[i], ids[j]), max(ids[i], ids[j]), alike))
    if out:
        yield pd.DataFrame(out, columns=["a", "b", "similarity"])


def links_inside(members: DataFrame, signed: DataFrame, texts: DataFrame, found: DataFrame, similarity: float, least_agreement: float = LEAST_AGREEMENT) -> DataFrame:
    """Links (a, b, similarity) between different classes of one band group, enough to join all that are linked.

    members: key, id. found: (id, class) so far. A group of more
    than BLOCK members is dealt into blocks by hash and each two blocks meet in
    a task of their own.
    """
    labelled = members.join(found, "id", "left").withColumn("class", F.coalesce("class", "id"))
    mixed = labelled.groupBy("key").agg(F.min("class").alias("_x"), F.max("class").alias("_y"), F.count("*").alias("_m")).filter("_x <> _y").select("key", F.ceil(F.col("_m") / BLOCK).cast("int").alias("blocks"))
    dealt = labelled.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "_o").alias("one"), F.greatest("block", "_o").alias("two"), "block", "id", "class")
    meeting = ["key", "one", "two"]
    rows = dealt.join(signed, "id").select(*meeting, "block", "id", "class", "n", "keys", "signature")
    schema = "key long, one int, two int, block int, id long, class long, n long, keys array<long>, signature binary"
    near = save(_by_group(rows, meeting, lambda group: _candidates(group, similarity, least_agreement), schema), "near")
    ready = near.join(texts, "id").select(*near.columns, "text")

    hashes = WordHash()

    def check(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        return _links(group, similarity, least_agreement, hashes)

    return _by_group(ready, meeting, check, "a long, b long, similarity double")


def linked(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity) of those pairs (a, b) whose whole bags are at least `similarity` alike. texts: id, text."""

    @F.pandas_udf("double")
    def alike(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        hashes = WordHash()
        for left, right in batches:
            # pairs with one text come together: its bag is made once
            last, made, out = None, None, []
            for x, y in zip(left, right):
                if x != last:
                    last, made = x, bag(x, hashes)
                out.append(weighted_jaccard(made, bag(y, hashes)))
            yield pd.Series(out, dtype="float64")
        hand_back()

    # the text that many pairs have in common is dealt over parts
    parts = save(pairs.groupBy("a").agg(F.ceil(F.count("*") / HOT).cast("int").alias("_parts")).filter("_parts > 1"), "parts")
    hot = small(parts)
    dealt = pairs.join(hot, "a", "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("b"), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    centres = texts.select(F.col("id").alias("a"), F.col("text").alias("_x")).join(hot, "a", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    with_a = dealt.join(centres, ["a", "_part"])
    both = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("_y")), "b")
    # else Spark evaluates it in the filter and again for the column, by two workers a task
    once = alike.asNondeterministic()
    return both.select("a", "b", once("_x", "_y").alias("similarity")).filter(F.col("similarity") >= similarity)


def classes(links: DataFrame, name: str = "classes") -> DataFrame:
    """(id, class): the smallest id of each connected component of links (a, b); ids without a link aren't returned.

    Large-star and small-star in turn: every vertex passes its larger, then its
    smaller neighbours on to the smallest it knows. A vertex sends a row for each
    link, never a list, and the number of rounds grows with the logarithm of the
    component. Each round is written to the shared folder.
    """
    def star(edges: DataFrame, larger: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        met = both.join(least, "a")
        if larger:
            return met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        own = least.filter("a <> m").select("a", F.col("m").alias("b"))
        return met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).filter("a <> b").distinct()

    edges = save(links.select("a", "b").filter("a <> b").distinct(), name)
    before = None
    while True:
        edges = save(star(save(star(edges, True), name), False), name)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    found = edges.select(F.col("a").alias("id"), F.col("b").alias("class"))
    return save(found.unionByName(found.select(F.col("class").alias("id"), "class")).distinct(), name)


def _text_key() -> Column:
    return F.when(F.col("text").isNotNull(), F.sha2("text", 256))


def _classed(docs: DataFrame, similarity: float, least_agreement: float) -> DataFrame:
    """(doc_id, copy, class, class_id, n_class, n_copies, partner_id, similarity) of each row of docs (doc_id, text); null texts have no copy and no class."""
    modest_batches(docs.sparkSession)
    rows = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("copy")), "copies")
    # one text stands for its copies, under a number that is saved
    firsts = rows.filter("copy IS NOT NULL").groupBy("copy").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"))
    firsts = save(firsts.withColumn("id", F.monotonically_increasing_id()), "firsts")
    texts = docs.select(_text_key().alias("copy"), "text").filter("copy IS NOT NULL")
    # texts stay where they are: narrow signatures meet, of each text one
    once = bands(texts).groupBy("copy").agg(*[F.first(c).alias(c) for c in ("n", "keys", "signature")])
    signed = save(once.join(firsts.select("copy", "id"), "copy").drop("copy"), "signed")
    keys = signed.select("id", F.explode("keys").alias("key"))
    groups = save(keys.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "groups")
    members = save(keys.join(groups, "key"), "members")
    stars = members.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    wanted = save(firsts.select("copy", "id").join(members.select("id").distinct(), "id"), "wanted")
    texts = may_meet(texts, "copy", wanted.select("copy")).filter("__open")
    texts = save(texts.join(small(wanted, wanted.count()), "copy").select("id", "text").dropDuplicates(["id"]), "texts")
    links = save(linked(stars, texts, similarity), "links")
    more = save(links_inside(members.select("key", "id"), signed, texts, classes(links), similarity, least_agreement), "links")
    links = links.unionByName(more)
    # of the links that were found the nearest, of equal ones that to the smallest id
    ends = links.select(F.col("a").alias("id"), F.col("b").alias("other"), "similarity").unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other"), "similarity"))
    partner = lookup(ends, firsts.select(F.col("id").alias("other"), F.col("least").alias("partner_id")), "other", saved=True)
    partner = partner.groupBy("id").agg(F.min_by(F.struct("partner_id", "similarity"), F.struct(-F.col("similarity"), F.col("partner_id").isNull(), "partner_id")).alias("_p")).select("id", "_p.*")
    found = firsts.join(classes(links), "id", "left").join(partner, "id", "left").withColumn("class", F.coalesce("class", "id"))
    found = save(found.select("copy", "class", "least", "n_copies", "partner_id", "similarity"), "found")
    named = save(found.groupBy("class").agg(F.min("least").alias("class_id"), F.sum("n_copies").alias("n_class")), "named")
    return lookup(rows, save(lookup(found, named, "class", saved=True).drop("least"), "classed"), "copy", saved=True)


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, least_agreement: float = LEAST_AGREEMENT) -> DataFrame:
    """(doc_id, class_id, n_copies, partner_id, similarity): a row for each row of docs (doc_id, text).

    class_id is the smallest doc_id of the rows that links of `similarity` or more
    join, n_copies the number of rows with the same text. partner_id is the smallest doc_id
    of the other text that is nearest among the links that were found, and
    similarity that link's; both null without a link to another text. Rows are
    joined by their texts, so unlike texts under one id have classes of their own.
    Equal texts are one class. A text without words is like none but its exact
    copies; null texts are each alone, under their own id. Rows with a null id take
    part; a class without any id has none. The whole text counts. least_agreement 0
    checks all pairs of mixed groups on their bags.
    """
    found = _classed(docs.select("doc_id", "text"), similarity, least_agreement)
    alone = F.col("copy").isNull()
    return found.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), "partner_id", "similarity")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class: that with the smallest id, nulls last, then with the smallest hash of its text, then of the whole row; columns as in docs, whatever their names.

    Unlike texts under one id are kept or dropped each by its own class, and reruns
    agree. Rows with null texts stay; empty and other texts without words go but for
    one of each exact text. Columns must be of types that can be hashed (no maps).
    """
    plain, back = shielded(docs, ["__copy", "__text", "__id", "__best", "__single", "__open", "__open_bucket", "__open_bits"])
    # a row that is alone in its class stays: only the others are looked up
    found = save(_classed(docs.select("doc_id", "text"), similarity, LEAST_AGREEMENT).filter("copy IS NOT NULL AND n_class > 1").select("doc_id", "copy", "class"), "rows")
    best = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "copy")).alias("_k")).select(F.col("_k.doc_id").alias("_id"), F.col("_k.copy").alias("_copy"), F.lit(True).alias("_best"))
    times = found.groupBy("copy", "doc_id").agg((F.count("*") == 1).alias("__single"))
    judged = times.join(best, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")), "left")
    judged = save(judged.select(F.col("copy").alias("__text"), F.col("doc_id").alias("__id"), F.coalesce("_best", F.lit(False)).alias("__best"), "__single"), "judged")
    n, repeats = judged.agg(F.count("*"), F.count_if(F.col("__best") & ~F.col("__single"))).first()
    columns = [F.col(f"`{c}`") for c in plain.columns]
    keyed, listed, alone = plain.withColumn("__copy", _text_key()), small(judged, n), None
    if listed is judged:  # too many to be broadcast: rows that are surely not among them stay where they are
        keyed = may_meet(keyed, "__copy", found.select("copy"))
        keyed, alone = keyed.filter("__open"), keyed.filter("NOT __open").select(*columns)
    met = keyed.join(listed, (F.col("__copy") == F.col("__text")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left").filter("__best IS NULL OR __best")
    kept = met.filter("__single IS NULL OR __single").select(*columns)
    if alone is not None:
        kept = alone.unionByName(kept)
    if repeats:  # a row of each text that its id has several times
        kept = kept.unionByName(met.filter("NOT __single").groupBy("__copy", "__id").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_r")).select("_r.*"))
    return kept.withColumnsRenamed(back).select(*docs.columns)


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
