"""Spelling variants by a trie over words' letter-group counts.

Letters fall into GROUPS groups by their code point, and a word is its vector of
counts by group. One inserted letter adds one to a count, one deleted takes one
away, one replaced does both or neither: two words one edit apart have vectors
whose differences above and below are at most one each. Words stand in a trie, a
level for each group's count; a search walks down depth first and spends a
surplus and a deficit of one, and the words of the leaves that it reaches are
compared letter by letter.

Above these levels stand SPLIT levels of coarser groups, by whose counts the trie
is dealt over tasks: a word stands in its own branch and asks in those branches of
a larger number that its budget reaches. A branch of more than BRANCH words is
dealt into parts by hash, all of which are asked. A task answers with a row a
word, how many words are near it and the best of them, for words that ask and for
words that are found.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlight.llm.common import save, small, table

LETTERS, OCCURRENCES, DAMAGED, FACTOR = 5, 3, 97, 2
GROUPS = 16
#: For the branches letters fall into COARSE groups, of which SPLIT are counted.
COARSE, SPLIT = 8, 4
#: Words of a branch that one task holds, and words that ask it at a time.
BRANCH, ASKING = 10_000, 50_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 300_000
#: Words under a node that are looked at together, and pairs that are compared at a time.
FEW, PAIRS = 16, 200_000
#: Pairs of a leaf that are compared as they are; beyond that only those with an equal half.
LEAF = 40_000

#: Latin-1: A-Z become a-z, all that is no letter a space.
_LETTER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_MARK = 1 << 15


def runs(text: str, least: int = LETTERS) -> Counter:
    """Counts of maximal runs of letters [A-Za-z\\u00C0-\\u00FF] with at least `least` of them, A-Z lower-cased, as Latin-1 bytes."""
    return Counter(w for w in text.encode("latin-1", "replace").translate(_LETTER).split() if len(w) >= least)


def damaged(head: int, run: bytes) -> bytes:
    """The run, or the run without one letter if DAMAGED divides its hash. head: crc32 of `<doc_id>:`."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the words of docs (doc_id, text) with at least LETTERS letters and that many occurrences overall."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}

        def handed() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in seen], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in runs(text).items():
                    word = damaged(head, run)
                    if len(word) >= LETTERS:
                        seen[word] = seen.get(word, 0) + n
                if len(seen) >= COUNTED:
                    yield handed()
                    seen = {}
        yield handed()

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def vectors(words: list[bytes], groups: int = GROUPS) -> np.ndarray:
    """Counts of each word's letters by group."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer(b"".join(words), np.uint8) % groups
    at = np.repeat(np.arange(len(words)), lengths)
    return np.bincount(at * groups + letters, minlength=len(words) * groups).reshape(len(words), groups)


def _steps() -> np.ndarray:
    """Differences of the first SPLIT counts within a surplus and a deficit of one."""
    one = np.eye(SPLIT, dtype=np.int64)
    both = [one[i] - one[j] for i in range(SPLIT) for j in range(SPLIT) if i != j]
    return np.array([np.zeros(SPLIT, np.int64), *one, *-one, *both])


def _branch(counts: np.ndarray) -> np.ndarray:
    """A number for the first SPLIT counts; those that a budget of one reaches from a word have different numbers."""
    key = np.zeros(counts.shape[:-1], np.int64)
    for t in range(SPLIT):
        key = key * _MARK + counts[..., t] % _MARK
    return key


class Letters:
    """Words as one array of letters."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.all = np.frombuffer(b"".join(words), np.uint8)

    def of(self, at: np.ndarray, first: int, length: int) -> np.ndarray:
        """So many letters from `first` on of the words at these places, which have them: a row a word."""
        return self.all[(self.start[at] + first)[:, None] + np.arange(length)]


def _equal_halves(words: Letters, asks: Letters, w: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those (w, q) whose first or last halves are equal: an edit leaves one half of the shorter word as it is. Words w have one length, asks q have one."""
    lw, lq = int(words.length[w[0]]), int(asks.length[q[0]])
    half = min(lw, lq) // 2
    pairs = []
    for last in (False, True):
        left = words.of(w, lw - half if last else 0, half)
        right = asks.of(q, lq - half if last else 0, half)
        _, key = np.unique(np.concatenate([left, right]), axis=0, return_inverse=True)
        kw, kq = key[: len(w)], key[len(w) :]
        order = np.argsort(kw, kind="stable")
        low, high = np.searchsorted(kw[order], kq, "left"), np.searchsorted(kw[order], kq, "right")
        n = high - low
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pairs.append(np.repeat(np.arange(len(q)), n) * len(w) + order[np.repeat(low, n) + within])
    both = np.unique(np.concatenate(pairs))
    return w[both % len(w)], q[both // len(w)]


class Trie:
    """Words arranged by successive letter-group counts, to be asked by many words at once."""

    def __init__(self, words: list[bytes], leaf: int = LEAF, few: int = FEW):
        self.leaf, self.few = leaf, few
        counts = vectors(words)
        order = np.lexsort(counts.T[::-1])
        self.order, self.counts = order, counts[order]
        self.words = Letters([words[i] for i in order])

    def near(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ask, word) places of all pairs one edit apart, in portions."""
        asks, wanted = Letters(words), vectors(words)
        ones = np.ones(len(words), np.int8)
        held, waiting = [], 0
        for q, w in self._search(asks, wanted, 0, len(self.order), 0, np.arange(len(words)), ones, ones):
            held.append((q, w))
            waiting += len(q)
            if waiting >= PAIRS:
                yield self._verified(asks, held)
                held, waiting = [], 0
        if held:
            yield self._verified(asks, held)

    def _search(self, asks: Letters, wanted: np.ndarray, low: int, high: int, level: int, q: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if level < GROUPS and high - low > self.few:
            counts = self.counts[low:high, level]
            edges = [0, *(np.flatnonzero(counts[1:] != counts[:-1]) + 1), high - low]
            for start, end in zip(edges, edges[1:]):
                more = wanted[q, level] - counts[start]
                go = np.flatnonzero((more <= surplus) & (-more <= deficit))
                if len(go):
                    more = more[go]
                    left = (surplus[go] - np.maximum(more, 0)).astype(np.int8), (deficit[go] - np.maximum(-more, 0)).astype(np.int8)
                    yield from self._search(asks, wanted, low + start, low + end, level + 1, q[go], *left)
            return
        if level == GROUPS and len(q) * (high - low) > self.leaf:  # words of a leaf have one length
            under = np.arange(low, high)
            for length in np.unique(asks.length[q]):
                w, asked = _equal_halves(self.words, asks, under, q[asks.length[q] == length])
                for x in range(0, len(w), PAIRS):
                    yield asked[x : x + PAIRS], w[x : x + PAIRS]
            return
        step = max(1, PAIRS // (high - low))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            if level < GROUPS:
                more = wanted[part][:, None, level:] - self.counts[None, low:high, level:]
                up = np.maximum(more, 0).sum(axis=2)
                i, j = np.nonzero((up <= surplus[at : at + step, None]) & (up - more.sum(axis=2) <= deficit[at : at + step, None]))
                yield part[i], low + j
            else:
                yield np.repeat(part, high - low), np.tile(np.arange(low, high), len(part))

    def _verified(self, asks: Letters, held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs held those that are one edit apart."""
        q, w = (np.concatenate(x) for x in zip(*held))
        lq, lw = asks.length[q], self.words.length[w]
        good = np.zeros(len(q), bool)
        for length in np.unique(lq):
            for other in (length - 1, length, length + 1):
                at = np.flatnonzero((lq == length) & (lw == other))
                size = max(1, 4_000_000 // int(length + 1))
                for x in range(0, len(at), size):
                    part = at[x : x + size]
                    left, right = asks.of(q[part], 0, length), self.words.of(w[part], 0, other)
                    good[part] = one_edit(left, right) if other >= length else one_edit(right, left)
        return q[good], w[good]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the rows of letters are one edit apart; b's rows are as long as a's or one longer."""
    length = a.shape[1]
    if b.shape[1] == length:
        return (a != b).sum(axis=1) == 1
    same = a == b[:, :length]
    prefix = np.where(same.all(axis=1), length, np.argmin(same, axis=1)) if length else np.zeros(len(a), int)
    back = (a == b[:, 1:])[:, ::-1]
    suffix = np.where(back.all(axis=1), length, np.argmin(back, axis=1)) if length else prefix
    return prefix + suffix >= length


ANSWER = "word string, n_near long, best struct<n: long, word: string>"


def _best(n: np.ndarray, words: list[bytes]) -> tuple[list[int], np.ndarray]:
    """Places by n, the largest first, equal ones by word; and each place's rank in that order."""
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    return order, rank


def near_words(words: DataFrame, branch: int = BRANCH, leaf: int = LEAF, few: int = FEW) -> DataFrame:
    """(word, n_near, best (n, word)) for words (word, n) that have a near one: their number, and the one of largest n, ties to the first in code-point order."""
    steps = _steps()

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 20_000):
                part = batch.slice(start, 20_000)
                counts = vectors([w.encode("latin-1") for w in part.column(0).to_pylist()], COARSE)[:, :SPLIT]
                to = counts[:, None, :] + steps[None]
                key = _branch(to)
                # of two branches the words of that with the smaller number ask in the other
                i, j = np.nonzero((to >= 0).all(axis=2) & ((key > key[:, :1]) | (np.arange(len(steps)) == 0)))
                rows = part.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(key[i, j]), pa.array(j > 0)], names=["word", "n", "branch", "asks"])

    visits = save(words.select("word", "n").mapInArrow(asking, "word string, n long, branch long, asks boolean"), "visits")
    own = visits.filter("not asks")
    branches = save(own.groupBy("branch").agg(F.ceil(F.count("*") / branch).cast("int").alias("parts")), "branches")
    split = small(branches)
    # a word stands in one part of its branch and asks, as do visitors, in all; a branch without words isn't asked
    met = visits.join(split, "branch").withColumn("_part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    dealt = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    stands = ~F.col("asks") & (F.col("part") == F.col("_part"))
    dealt = dealt.select("branch", "part", F.when(stands, 0).when(~F.col("asks"), 1).otherwise(2).alias("role"), "word", "n")

    def answers(asked: list[bytes], found: np.ndarray, best: np.ndarray, order: list[int], n: np.ndarray, words: list[bytes]) -> pa.RecordBatch:
        some = np.flatnonzero(found)
        chosen = [order[i] for i in best[some]]
        names = pa.array([words[i].decode("latin-1") for i in chosen], pa.string())
        return pa.RecordBatch.from_arrays([pa.array([asked[i].decode("latin-1") for i in some], pa.string()), pa.array(found[some]), pa.StructArray.from_arrays([pa.array(n[chosen]), names], ["n", "word"])], names=["word", "n_near", "best"])

    def answer(trie: Trie, n: np.ndarray, asked: list[bytes], asked_n: np.ndarray, guests: bool) -> Iterator[pa.RecordBatch]:
        """What the askers find; where they are guests of other branches, also what the trie's words find in them."""
        stand = trie.words.words
        order, rank = _best(n, stand)
        found, best = np.zeros(len(asked), np.int64), np.full(len(asked), len(stand), np.int64)
        if guests:
            order_q, rank_q = _best(asked_n, asked)
            found_w, best_w = np.zeros(len(stand), np.int64), np.full(len(stand), len(asked), np.int64)
        for q, w in trie.near(asked):
            found += np.bincount(q, minlength=len(asked))
            np.minimum.at(best, q, rank[w])
            if guests:
                found_w += np.bincount(w, minlength=len(stand))
                np.minimum.at(best_w, w, rank_q[q])
        yield answers(asked, found, best, order, n, stand)
        if guests:
            yield answers(stand, found_w, best_w, order_q, asked_n, asked)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by branch, part and role: words that stand here, words of this branch that stand in other parts, guests; those that ask in portions."""
        key = trie = n = None
        stand: tuple[list, list] = ([], [])
        waiting: tuple[list, list] = ([], [])
        guests = False

        def asked() -> Iterator[pa.RecordBatch]:
            nonlocal trie, n, waiting
            if trie is None and stand[0]:
                trie = Trie(stand[0], leaf, few)
                n = np.array(stand[1], np.int64)[trie.order]
                yield from answer(trie, n, stand[0], np.array(stand[1], np.int64), False)
            if waiting[0] and trie is not None:
                yield from answer(trie, n, waiting[0], np.array(waiting[1], np.int64), guests)
            waiting = ([], [])

        for batch in batches:
            branch_, part, role = (batch.column(k).to_numpy() for k in range(3))
            names, counts = [w.encode("latin-1") for w in batch.column(3).to_pylist()], batch.column(4).to_pylist()
            edges = np.flatnonzero((branch_[1:] != branch_[:-1]) | (part[1:] != part[:-1]) | (role[1:] != role[:-1])) + 1
            for start, end in zip([0, *edges], [*edges, len(names)]):
                if start == end:
                    continue
                if (branch_[start], part[start]) != key or (role[start] == 2) != guests:
                    yield from asked()
                if (branch_[start], part[start]) != key:
                    key, trie, stand = (branch_[start], part[start]), None, ([], [])
                guests = role[start] == 2
                to = waiting if role[start] else stand
                to[0].extend(names[start:end])
                to[1].extend(counts[start:end])
                if len(waiting[0]) >= ASKING:
                    yield from asked()
        yield from asked()

    met = dealt.repartition("branch", "part").sortWithinPartitions("branch", "part", "role")
    found = met.mapInArrow(search, ANSWER)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min_by("best", F.struct(-F.col("best.n"), F.col("best.word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last. A form's n is at least twice its word's, so paths are short and end; each round doubles what is followed."""
    paths = save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = paths.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = save(paths.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        paths = longer.select("word", "root")
        if longer.filter("_moved").isEmpty():
            return paths


def variants(docs: DataFrame, occurrences: int = OCCURRENCES, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the distinct words of docs (doc_id, text).

    A null or empty text has no words; a null doc_id counts as an empty one in
    the hash; repeated rows count each. Letters beyond \\u00FF end a run. Of near
    words with equal n the first in code-point order is the form. Other columns of
    docs don't matter. Tables without words give no rows.
    """
    words = save(word_counts(docs, occurrences), "words")
    near = save(near_words(words), "near")
    known = words.join(near, "word", "left").withColumn("_form", F.expr(f"if(best.n >= {factor} * n, best, null)"))
    known = save(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("_form.word").alias("form"), F.col("_form.n").alias("form_n")), "known")
    followed = roots(known.filter("form IS NOT NULL"))
    return known.join(followed, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
