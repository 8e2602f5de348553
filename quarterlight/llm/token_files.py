"""Token ids in Parquet list columns, in document order, for selective reads of ids and of their metadata.

Documents are dealt by ranges of their id, encoded where they land and written
as they are sorted, so texts are shuffled once and ids never. The id column is
dictionary-encoded (a vocabulary of 16 bits packs to two bytes an id) or
delta-encoded; row groups and pages are of a set size, and Parquet's page
indexes let a reader skip to a range of documents.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quarterlight.llm.common import hand_back, modest_batches, new_path, save, small, table

#: File of the tokenizer, by its public name.
TOKENIZER = "word_bpe_49k.json"
#: Id that ends a document.
END_ID = 1
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 256 << 10, 2000
#: part: the range of documents that a task wrote; begin: ids of the part before the document.
FILES = "part int, doc_id long, begin long, n_tokens long, tokens array<int>"
#: Distinct pieces of words, and as many words that aren't cut, whose ids a Python worker remembers.
CACHED = 300_000

# How the tokenizer's file says that texts are cut, for which ids are looked up piece by piece.
CUT_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: What a byte of lower-cased UTF-8 is, where ASCII and Latin-1 letters stand alone: space, letter, digit or other.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(9, 14), 32]] = _SPACE
_KIND[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = _LETTER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
#: First byte of the Latin-1 letters in UTF-8, and the second ones of the signs that stand among them.
_LATIN, _TIMES, _DIVISION = 0xC3, 0x97, 0xB7


def _edges(array: pa.Array) -> np.ndarray:
    """Where each string of an array without offset begins in its bytes, and where the last ends."""
    return np.frombuffer(array.buffers()[1], np.int32, len(array) + 1) if len(array) else np.zeros(1, np.int32)


def _bytes(array: pa.Array) -> np.ndarray:
    held = _edges(array)[-1]
    return np.frombuffer(array.buffers()[2], np.uint8, held) if held else np.zeros(0, np.uint8)


def _sums(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def _lists(edges: np.ndarray, ids: np.ndarray | pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), ids if isinstance(ids, pa.Array) else pa.array(ids, pa.int32()))


def cut_words(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of lower-cased words of ASCII and Latin-1 letters, as CUT_PATTERN cuts them, and where each word's begin and the last ends."""
    edges, data = _edges(words), _bytes(words)
    after = np.concatenate([[0], data[:-1]])
    data = data + 32 * ((data >= 0x41) & (data <= 0x5A) | (after == _LATIN) & (data >= 0x80) & (data <= 0x9E)).astype(np.uint8)
    kind = _KIND[data]
    first = np.zeros(len(data) + 3, bool)  # a word begins, or all have ended
    first[edges] = first[len(data) :] = True
    begins = first[: len(data)] | (kind == _DIGIT)
    begins[1:] |= kind[1:] != kind[:-1]
    # a short form begins where a run of other signs does, and its letters belong to it
    sign = np.flatnonzero(begins & (data == ord("'")))
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    one, two = padded[sign + 1], padded[sign + 2]
    short = ~first[sign + 1] & np.isin(one, list(b"stmd"))
    long = ~first[sign + 1] & ~first[sign + 2] & (np.isin(one, list(b"rv")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    begins[sign[short | long] + 1] = False
    rest = np.concatenate([sign[short] + 2, sign[long] + 3])
    rest = rest[rest < len(data)]
    begins[rest] |= kind[rest] == _LETTER
    kept = kind != _SPACE
    begins &= kept
    upto = _sums(begins)[edges]
    at = np.append(_sums(kept)[:-1][begins], np.count_nonzero(kept)).astype(np.int32)
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data[kept])), upto


def _are_plain(words: pa.Array) -> np.ndarray:
    """Which words have no letter or sign but ASCII and the letters of Latin-1."""
    edges, data = _edges(words), _bytes(words)
    after = np.concatenate([[0], data[:-1]])
    strange = (data >= 0xC0) & (data != _LATIN) | (after == _LATIN) & ((data == _TIMES) | (data == _DIVISION))
    found = _sums(strange)[edges]
    return found[1:] == found[:-1]


class Remembered:
    """Ids of at most CACHED keys, or those of one lot; what wasn't met for longest is forgotten."""

    def __init__(self):
        self.keys, self.ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))

    def __len__(self) -> int:
        return len(self.keys)

    def of(self, keys: pa.Array, learn: Callable[[list[str]], pa.ListArray]) -> pa.ListArray:
        """Ids of distinct keys; learn gives those of new ones."""
        found = pc.index_in(keys, value_set=self.keys)
        new = found.is_null().to_numpy(zero_copy_only=False)
        at = found.fill_null(0).to_numpy().astype(np.int64)
        unmet = np.ones(len(self.keys), bool)
        unmet[at[~new]] = False
        at[new] = len(self.keys) + np.arange(np.count_nonzero(new))
        ids = pa.concat_arrays([self.ids, learn(keys.filter(pa.array(new)).to_pylist())]).take(pa.array(at))
        older = np.flatnonzero(unmet)[: max(0, CACHED - len(keys))]
        self.keys = pa.concat_arrays([keys, self.keys.take(pa.array(older))])
        self.ids = pa.concat_arrays([ids, self.ids.take(pa.array(older))])
        return ids


class Encoder:
    """Ids of whole texts by the tokenizers library; what repeats is encoded once.

    Where the tokenizer's file cuts texts by CUT_PATTERN after CUT_NORMALIZER no
    token runs over a space: Arrow finds the distinct words between spaces, words
    of ASCII and Latin-1 letters are cut together, and each distinct piece that
    isn't remembered is encoded by the library's model. Other words, and those
    with an added token in them, are given to the library as they are; so are
    whole texts for other tokenizers.
    """

    CHUNK = 500

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        path = tokenizer_path(name)
        self.tokenizer = Tokenizer.from_file(path)
        given = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in given["added_tokens"]]
        self.known_words, self.known_pieces = Remembered(), Remembered()
        first, *more = (given["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        ends = given["model"].get("end_of_word_suffix")
        self.by_word = (
            given["normalizer"] == CUT_NORMALIZER and given["model"].get("type") == "BPE" and bool(ends) and not given["model"].get("dropout")
            and first == {"type": "Split", "pattern": {"Regex": CUT_PATTERN}, "behavior": "Removed", "invert": True}
            and [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in more] == [("ByteLevel", False, False)]
            and not any(" " in x for x in self.added) and not any(t["lstrip"] or t["rstrip"] for t in given["added_tokens"])
        )
        if self.by_word:
            self.pieces = Tokenizer.from_file(path)
            self.pieces.normalizer = None
            self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(self.pieces.get_vocab_size(), bool)
            self.ends[[i for token, i in self.pieces.get_vocab().items() if token.endswith(ends)]] = True

    def _whole(self, texts: list[str]) -> pa.ListArray:
        found = [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return _lists(_sums([len(x) for x in found]), np.concatenate([np.zeros(0, np.int32), *found]))

    def _learn_pieces(self, new: list[str]) -> pa.ListArray:
        found, edges = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for i in range(0, len(new), self.CHUNK):
            part = new[i : i + self.CHUNK]
            ids = np.array(self.pieces.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int32)
            # the last token of a piece, and no other, has the word's end
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                raise ValueError("the tokenizer's word ends don't tell pieces apart")
            edges.append(edges[-1][-1] + cuts)
            found.append(ids)
        return _lists(np.concatenate(edges), np.concatenate(found))

    def _of_words(self, words: pa.Array) -> pa.ListArray:
        """Ids of distinct words."""
        plain = _are_plain(words)
        for token in self.added:
            plain &= ~pc.match_substring(words, token).to_numpy(zero_copy_only=False)
        pieces, edges = cut_words(words.filter(pa.array(plain)))
        coded = pieces.dictionary_encode()
        known = self.known_pieces.of(coded.dictionary, self._learn_pieces)
        upto = _sums(known.value_lengths().take(coded.indices).to_numpy())
        own = _lists(upto[edges], known.take(coded.indices).flatten())
        if plain.all():
            return own
        other = self.known_words.of(words.filter(pa.array(~plain)), self._whole)
        place = np.where(plain, np.cumsum(plain) - 1, len(own) + np.cumsum(~plain) - 1)
        return pa.concat_arrays([own, other]).take(pa.array(place))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls), one after the other, and where each text begins and the last ends."""
        if not self.by_word:
            found = self._whole(texts.to_pylist())
            return found.flatten().to_numpy(), _sums(found.value_lengths().to_numpy())
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten().dictionary_encode()
        own = self._of_words(words.dictionary)
        upto = _sums(own.value_lengths().take(words.indices).to_numpy())
        return own.take(words.indices).flatten().to_numpy(), upto[lists.offsets.to_numpy()]


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The worker's encoder for a tokenizer: a Python worker serves many tasks, and keeps what it has learned."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def tokenizer_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _encode(docs: DataFrame, tokenizer: str, end_id: int, lot_bytes: int = 4_000_000) -> DataFrame:
    """docs (doc_id, text, more) with begin, n_tokens and tokens in the place of text; begin counts the ids of the partition's rows before."""
    place, rest = docs.columns.index("text"), [c for c in docs.columns if c != "text"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, before = encoder(tokenizer), 0
        for batch in batches:
            texts = pc.fill_null(batch.column(place), "")
            held = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
            at = 0
            while at < batch.num_rows:  # lots of bounded size, a longer text alone
                upto = max(at + 1, int(np.searchsorted(held, held[at] + lot_bytes, "right")) - 1)
                ids, edges = own.encode(texts.slice(at, upto - at))
                ids = np.insert(ids, edges[1:], end_id)
                edges = edges + np.arange(len(edges))
                part = batch.slice(at, upto - at)
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], pa.array(before + edges[:-1]), pa.array(np.diff(edges)), lists], names=[*rest, "begin", "n_tokens", "tokens"])
                before, at = before + int(edges[-1]), upto
        hand_back()

    kept = [f for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(encode, StructType([*kept, *StructType.fromDDL("begin long, n_tokens long").fields, StructField("tokens", ArrayType(IntegerType()))]))


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, encoding: str = "dictionary", row_group: int = ROW_GROUP_BYTES, page: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Writes part, doc_id, begin, n_tokens and tokens of docs (doc_id, text) in ascending doc_id order over the files.

    A null text is empty and has the end id alone; null ids come first, and
    rows with equal ids stay beside each other, by the hash of their text, over as many files as it takes.
    encoding: dictionary, or delta (DELTA_BINARY_PACKED, Parquet's second
    writer version). Other columns aren't read.
    """
    modest_batches(docs.sparkSession)
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding {encoding!r}")
    by_text = F.xxhash64("text")
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id", by_text)
    # an id with many rows is dealt over tasks by its texts
    dealt = dealt.select(F.spark_partition_id().alias("part"), "doc_id", "text").sortWithinPartitions("doc_id", by_text, "text")
    (
        _encode(dealt, tokenizer, end_id).write.option("compression", "zstd")
        .option("parquet.block.size", row_group).option("parquet.page.size", page).option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.writer.version", "PARQUET_1_0" if encoding == "dictionary" else "PARQUET_2_0")
        .parquet(path)
    )


def _with_start(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """rows (part, begin, more) with start: begin, and what the parts before hold."""
    totals = save(spark.read.schema(FILES).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")), "parts")
    # one row for each task that wrote
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(small(before, totals.count()), "part").withColumn("start", F.col("_before") + F.col("begin"))


def read_range(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """doc_id, start, n_tokens and tokens of the documents from low to high: row groups and pages of others are skipped by their statistics and page indexes."""
    rows = spark.read.schema(FILES).parquet(path).filter(F.col("doc_id").between(low, high))
    return _with_start(spark, path, rows).select("doc_id", "start", "n_tokens", "tokens")


def read_starts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens, from the files' metadata columns alone."""
    return _with_start(spark, path, spark.read.schema(FILES).parquet(path).select("part", "doc_id", "begin", "n_tokens")).select("doc_id", "start", "n_tokens")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, of the ids as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            ids, offsets = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], names=["part", "doc_id", "begin", "n_tokens", "ids_crc32"])
        hand_back()

    rows = spark.read.schema(FILES).parquet(path).mapInArrow(digest, "part int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return _with_start(spark, path, rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def token_digests(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of docs (doc_id, text), written to token files and read back.

    Each row of docs gives one row: null texts have the end id alone, null ids
    stand first, repeated rows beside each other. No rows give none.
    """
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path)
    return read_digests(docs.sparkSession, path)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))
