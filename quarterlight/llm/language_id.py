"""Language identification by compression: the language whose raw-content dictionary lets zstandard write the text smallest."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarterlight.llm.common import hand_back, modest_batches, shielded, small, table

#: Bound of what is learned for a language: so many documents, characters of each, and bytes of dictionary.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 100, 4000, 192 << 10
#: Dictionaries of fewer bytes don't set the size of the others.
FLOOR_BYTES = 64 << 10
#: A text is compressed in blocks of about this many bytes, as its own words would else serve as dictionary.
BLOCK_BYTES = 4096
LEVEL = 7
#: A text is rejected where the second-best size is less than this part above the best.
MIN_MARGIN = 0.001
UNKNOWN = "und"


def learn_dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """A dictionary for each language of docs (text, lang; null ones aside), of a sample of its distinct texts chosen by their hash.

    Copies, by their lower-cased whole text, are one. Languages' distinct texts
    are estimated, texts are kept at a rate that gives three times SAMPLE_DOCS
    of them for each language, and the smallest hashes of these stay, so no task
    and not the driver sees more than that bound for a language. Of a text of
    more than SAMPLE_CHARS the hash says which stretch is learned; stretches are
    taken in the order of their hashes until a dictionary is full. Null and
    blank texts and null languages teach nothing; no rows give no languages.
    """
    hashed = F.xxhash64(F.lower("text"))
    part = F.substring(F.col("text"), (F.pmod(hashed, F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    known = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", hashed.alias("_hash"), part.alias("text")).filter(F.trim("text") != "")
    counts = known.groupBy("lang").agg(F.approx_count_distinct("_hash").alias("_n")).collect()
    # an Arrow table is read by the JVM; rows would start Python workers of their own kind beside those of the other stages
    rates = pa.table({"lang": pa.array([r["lang"] for r in counts], pa.string()), "_rate": pa.array([min(1.0, 3.0 * SAMPLE_DOCS / max(1, r["_n"])) for r in counts], pa.float64())})
    rates = docs.sparkSession.createDataFrame(rates)
    chance = F.shiftrightunsigned("_hash", 11) / float(1 << 53)
    some = known.join(small(rates, len(counts)), "lang").withColumn("_chance", chance).filter("_chance < _rate")
    first = Window.partitionBy("lang").orderBy("_chance", "_hash")
    rows = (
        some.groupBy("lang", "_hash", "_chance").agg(F.min("text").alias("text"))
        .withColumn("_k", F.row_number().over(first)).filter(f"_k <= {SAMPLE_DOCS}").orderBy("lang", "_k").collect()
    )
    texts: dict[str, list[str]] = {}
    for row in rows:
        texts.setdefault(row["lang"], []).append(row["text"])
    # near equal sizes, else a language with more text would win; one of little text is at its own, and doesn't cut the others
    joined = {lang: "\n".join(dict.fromkeys(found)).lower().encode("utf-8", "surrogatepass") for lang, found in texts.items()}
    joined = {lang: found for lang, found in joined.items() if found.strip()}
    size = min([DICTIONARY_BYTES, *(len(x) for x in joined.values() if len(x) >= FLOOR_BYTES)])
    return {lang: found[:size] for lang, found in sorted(joined.items())}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.compressors = []
        for content in dictionaries.values():
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, data: bytes) -> list[int]:
        """Bytes of the whole text under each language."""
        n = max(1, round(len(data) / BLOCK_BYTES))
        blocks = [data[i * len(data) // n : (i + 1) * len(data) // n] for i in range(n)]
        return [sum(map(len, map(c.compress, blocks))) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the text is rejected."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text.lower().encode("utf-8", "surrogatepass"))
        best, *rest = sorted(sizes)
        second = rest[0] if rest else best
        score = 1 / sum(math.exp(-100 * (x - best) / second) for x in sizes)
        return self.langs[sizes.index(best)], score, bool(rest) and (second - best) / second < MIN_MARGIN


FOUND = "lang_pred string, score double, rejected boolean"


def identify_languages(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and rejected; columns of these names are replaced.

    Texts that are null or have no letter are `und`, score 0 and rejected, as all
    are where nothing was learned. Only the text is looked at. Of equal sizes
    the first language in code-point order holds, with a narrow margin.
    """
    modest_batches(docs.sparkSession)
    kept = docs.drop("lang_pred", "score", "rejected")
    place = kept.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dictionaries)
        for batch in batches:
            found = [classifier.predict(text.as_py()) for text in batch.column(place)]
            more = [pa.array(c, t) for c, t in zip(zip(*found) if found else ((), (), ()), (pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "lang_pred", "score", "rejected"])
        hand_back()

    return kept.mapInArrow(predict, StructType(kept.schema.fields + StructType.fromDDL(FOUND).fields))


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language isn't rejected, learned from those that aren't held out; columns as in docs, whatever their names.

    Null and empty texts and those without a letter go, as do texts of a word or
    two whose margin is under MIN_MARGIN; repeated rows stay or go together.
    Nothing is learned from rows with null ids; with nothing learned all go.
    """
    learned = learn_dictionaries(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    plain, back = shielded(docs, ["lang_pred", "score", "rejected"])
    kept = identify_languages(plain, learned).filter("NOT rejected").select(*plain.columns)
    return kept.withColumnsRenamed(back)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = learn_dictionaries(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    found = identify_languages(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
