"""Language-model scores of whole documents under a gated recurrent model that is trained here.

Counts of all training tokens are summed by Spark. The commonest LISTED words
go to every task; the model's classes, its output biases and the probabilities
inside the classes that don't depend on the state come from the counts of the
whole corpus. The recurrent weights are trained in parallel: each task runs
truncated backpropagation over its part of the training text and the results are
averaged, weighted by tokens: first of a fourth of the texts, then of the others. Words beyond the listed ones are
joined with their counts, as they may be any number.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlight.llm import gru
from quarterlight.llm.common import save, table
from quarterlight.llm.words import lots, space_words, space_words_together

#: Words that tasks hold, those with a softmax of their own, ranges of rank of the others, and the state's size.
LISTED, HEAD, RANGES, HIDDEN = 65_536, 2048, 31, 16
#: Parts of the training text's fourths that the rounds learn from, tokens that a task holds to train on at once, and the learning rate.
ROUNDS, TRAINED, RATE = ((0, 1), (1, 4)), 4_000_000, 0.3
#: Bars of the histogram of counts for each doubling; counts below have a bar each.
BARS = 64
#: Results that are averaged at once.
AVERAGED = 8
#: Stands for a document's end; no word has a line end.
END = b"\n"
#: Bytes of text that a task splits and ranks at once.
LOT = 4 << 20
#: Words that a task counts before it sends them on.
COUNTED = 300_000


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def token_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts (one column): words as bytes, and END once for each text. Tasks add up before the shuffle.

    Null and empty texts have an END alone, repeated texts count each time, no rows give none.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                counts.update(space_words(text.as_py()))
                counts[END] += 1
                if len(counts) > COUNTED:
                    yield rows()
        yield rows()

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _bar(n: Column) -> Column:
    return F.when(n <= BARS, n).otherwise(F.floor(F.log2(n.cast("double")) * BARS)).cast("long")


class Corpus:
    """Counts of the training tokens: the listed words with theirs, and what the others have together.

    Listed are the words of the highest bars of a histogram of counts, as many
    bars as hold fewer than LISTED words, so the driver and each task see at
    most that many words whatever the corpus has. counts: word, n; no rows give
    no tokens and END alone.
    """

    def __init__(self, counts: DataFrame):
        self.counts = counts
        bars = counts.groupBy((F.col("word") == F.lit(END)).alias("end"), _bar(F.col("n")).alias("bar")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
        self.tokens, self.distinct = sum(r["n"] for r in bars), sum(r["words"] for r in bars)
        self.floor, held = None, 0
        for r in sorted((r for r in bars if not r["end"]), key=lambda r: -r["bar"]):
            held += r["words"]
            if held >= LISTED:
                break
            self.floor = r["bar"]
        listed = [] if self.floor is None else counts.filter((F.col("word") != F.lit(END)) & (_bar(F.col("n")) >= self.floor)).collect()
        listed = sorted(((int(r["n"]), bytes(r["word"])) for r in listed), key=lambda x: (-x[0], x[1]))
        self.words = [END, *(w for _, w in listed)]
        self.numbers = np.array([sum(r["n"] for r in bars if r["end"]), *(n for n, _ in listed)], np.int64)
        self.rare_tokens, self.rare_distinct = self.tokens - int(self.numbers.sum()), max(0, self.distinct - len(self.words))

    def rare(self) -> DataFrame:
        """Counts of the words that aren't listed."""
        others = self.counts.filter(F.col("word") != F.lit(END))
        return others if self.floor is None else others.filter(_bar(F.col("n")) < self.floor)

    def vocabulary(self) -> gru.Vocabulary:
        return gru.Vocabulary(self.words, np.maximum(self.numbers, 1), self.rare_tokens, HEAD, RANGES)


def train(texts: DataFrame, corpus: Corpus) -> bytes:
    """The model's parameters after training in parallel on texts (one column), each of which is learned from once, in one of the ROUNDS.

    A round begins with what the tasks of the one before have learned together.
    Null and empty texts are an END alone; repeated texts are learned from each
    time; a text of any length runs over windows with its state carried on. With
    no rows the parameters are those that give each token its unigram
    probability. They depend on how texts are dealt over tasks.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((corpus.words, corpus.numbers, corpus.rare_tokens))
    start = gru.start(corpus.vocabulary(), HIDDEN)
    now = gru.pack(start)

    def average(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        tokens = parts["tokens"].to_numpy(float)
        mean = sum(np.frombuffer(p, "<f4") * (t / tokens.sum()) for p, t in zip(parts["params"], tokens))
        return pd.DataFrame({"part": [key[0]], "tokens": [int(tokens.sum())], "params": [mean.astype("<f4").tobytes()]})

    fourth = F.pmod(F.xxhash64(texts.columns[0]), F.lit(ROUNDS[-1][1]))
    for low, high in ROUNDS:
        given = spark.sparkContext.broadcast(now)

        def learn(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            words, numbers, rare = shared.value
            v = gru.Vocabulary(words, np.maximum(numbers, 1), rare, HEAD, RANGES)
            params = gru.unpack(given.value, gru.start(v, HIDDEN))
            squares: dict[str, np.ndarray] = {}
            ids, held, tokens = [], 0, 0
            for batch in batches:
                for lot in lots(batch.column(0), LOT):
                    ids.append(v.encode_together(*space_words_together(lot)))
                    held += len(ids[-1])
                    if held >= TRAINED:
                        params = gru.train(params, v, np.concatenate(ids), rate=RATE, squares=squares)
                        ids, held, tokens = [], 0, tokens + held
            if ids:
                params = gru.train(params, v, np.concatenate(ids), rate=RATE, squares=squares)
            if tokens + held:
                yield pa.RecordBatch.from_arrays([pa.array([tokens + held]), pa.array([gru.pack(params)], pa.binary())], names=["tokens", "params"])

        results = save(texts.filter((fourth >= low) & (fourth < high)).mapInArrow(learn, "tokens long, params binary").withColumn("part", F.spark_partition_id()), "weights")
        n = results.count()
        while n > 1:
            n = math.ceil(n / AVERAGED)
            results = save(results.groupBy(F.pmod("part", F.lit(n)).alias("part")).applyInPandas(average, "part int, tokens long, params binary"), "weights")
            if n > 1:
                n = results.count()
        got = results.select("params").first()
        now = bytes(got["params"]) if got else now
    return now


def score_documents(docs: DataFrame, corpus: Corpus, params: bytes, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, n_known, base_score and score (log10 of the text's probability) of each row of docs (key, text).

    A null text is empty: its end is its one token. Rows are told apart by
    place, not by key, so repeated and null keys are scored as they stand.
    """
    shared = docs.sparkSession.sparkContext.broadcast((corpus.words, corpus.numbers, corpus.rare_tokens, params))
    events = corpus.tokens + corpus.distinct + 1
    rare_events = corpus.rare_tokens + corpus.rare_distinct + 1
    ln10 = math.log(10)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, numbers, rare, packed = shared.value
        v = gru.Vocabulary(words, np.maximum(numbers, 1), rare, HEAD, RANGES)
        p = gru.unpack(packed, gru.start(v, HIDDEN))
        logs = np.append(np.log10((numbers + 1) / events), -math.log10(events))
        known = np.append(numbers > 0, False)
        for batch in batches:
            ids, others = [], []
            for lot in lots(batch.column(1), LOT):
                found, times = space_words_together(lot)
                together = v.encode_together(found, times)
                rare_too = np.append(0, np.cumsum(together == v.n, dtype=np.int32))
                ends = np.cumsum(times + 1)
                ids += np.split(together, ends[:-1])
                others.append(pa.ListArray.from_arrays(pa.array(rare_too[np.append(0, ends)]), found.filter(pa.array(np.delete(together, ends - 1) == v.n))))
            others = pa.concat_arrays(others) if others else pa.array([], pa.list_(pa.binary()))
            n = np.array([len(x) for x in ids], np.int64)
            n_rare = pc.list_value_length(others).to_numpy().astype(np.int64)
            score = gru.score(p, v, ids) / ln10 - n_rare * math.log10(rare_events)
            base, n_known = (np.array([x[i].sum() for i in ids], t) for x, t in ((logs, np.float64), (known, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (n, n_known, base, score)), others],
                names=[key, "n_tokens", "n_known", "base_score", "score", "others"],
            )

    kind = dict(docs.dtypes)[key]
    scored = docs.select(key, "text").mapInArrow(listed, f"`{key}` {kind}, n_tokens long, n_known long, base_score double, score double, others array<binary>")
    scored = save(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    # a word that isn't known either adds nothing: log10(0 + 1)
    met = scored.select("_row", F.explode("others").alias("word")).join(corpus.rare(), "word")
    more = met.groupBy("_row").agg(F.count("*").alias("_known"), F.sum(F.log10(F.col("n") + 1)).alias("_more"))
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    return scored.drop("others").join(more, "_row", "left").select(
        key, "n_tokens", (F.col("n_known") + zero("_known", 0)).alias("n_known"),
        (F.col("base_score") + zero("_more", 0.0)).alias("base_score"), (F.col("score") + zero("_more", 0.0)).alias("score"),
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = docs.filter(~held_out(F.col("doc_id"))).select("text")
    corpus = Corpus(save(token_counts(learned), "counts"))
    params = train(learned, corpus)
    scored = score_documents(docs, corpus, params)
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("train_tokens", F.lit(corpus.tokens).cast("long"))
