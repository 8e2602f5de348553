"""The forecast event stream: normalised, deduplicated, enriched with the last prediction, archived."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarterlight.functions.dates import quarter_name
from quarterlight.functions.rules import stacked
from quarterlight.scratch import stored

RAW = "event_id string, id string, event_type string, as_of string, timestamp string, created_at string, source_ids array<string>, payload string"

# Event types that ask for a counterfactual run.
TRIGGERS = ("energy_shock", "geopolitical_shock", "sanctions", "financial_stress", "policy_shock")


def file_source(spark: SparkSession, path: str, schema: str = RAW, per_trigger: int = 1000, done: str = "off") -> DataFrame:
    """JSON events of a watched folder; `done` is what becomes of files that are through: off, archive or delete. The checkpoint is the acknowledgement."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("cleanSource", done)
    return reader.json(path)


def kafka_source(spark: SparkSession, servers: str, topic: str, schema: str = RAW) -> DataFrame:
    """Events of a Kafka topic (needs the connector's jar)."""
    return kafka_decode(spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load(), schema)


def kafka_decode(raw: DataFrame, schema: str = RAW) -> DataFrame:
    """Columns of the JSON value; the record's key stands in for a missing event id. Values that aren't JSON go."""
    rows = raw.select(F.col("key").cast("string").alias("_key"), F.from_json(F.col("value").cast("string"), schema).alias("v"))
    return rows.filter("v IS NOT NULL").select("_key", "v.*").withColumn("event_id", F.coalesce("event_id", "_key")).drop("_key")


def kafka_encode(events: DataFrame) -> DataFrame:
    """key and value for a Kafka sink, keyed by event id so that an event's versions stay in order."""
    return events.select(F.col("event_id").cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def normalize(raw: DataFrame, now: Column | None = None) -> DataFrame:
    """event_id (else id, else a hash of the row, so that replays agree), event_type, as_of (else timestamp, created_at, now), payload (a JSON object, else wrapped as raw)."""
    time = F.coalesce(*[F.try_to_timestamp(c) for c in ("as_of", "timestamp", "created_at")], now if now is not None else F.current_timestamp())
    ident = F.coalesce("event_id", "id", F.substring(F.sha2(F.to_json(F.struct("*")), 256), 1, 16))
    is_object = F.coalesce(F.trim("payload").startswith("{") & F.get_json_object("payload", "$").isNotNull(), F.lit(False))
    payload = F.when(is_object, F.col("payload")).otherwise(F.to_json(F.struct(F.coalesce("payload", F.lit("")).alias("raw"))))
    return raw.select(ident.alias("event_id"), F.coalesce("event_type", F.lit("unknown")).alias("event_type"), time.alias("as_of"), F.coalesce("source_ids", F.array().cast("array<string>")).alias("source_ids"), payload.alias("payload"))


def active_quarter(as_of: Column) -> Column:
    return quarter_name(F.to_date(as_of))


def deduplicated(events: DataFrame, watermark: str = "2 days") -> DataFrame:
    """An event is let through once within the watermark, which bounds the state."""
    return events.withWatermark("as_of", watermark).dropDuplicatesWithinWatermark(["event_id"])


def counterfactual_requests(events: DataFrame, fields: Sequence[str], triggers: Sequence[str] = TRIGGERS, rounds: int = 3) -> DataFrame:
    """event_id, quarter, overrides, max_rounds of the events that ask for a run: by type, flag or an explicit object.

    Overrides of a field come from the explicit object, then from the payload;
    without any an event asks for nothing.
    """
    get = lambda path: F.get_json_object("payload", f"$.{path}")
    explicit = get("counterfactual").isNotNull()
    wanted = F.col("event_type").isin(*triggers) | (F.lower(get("run_counterfactual")) == "true") | explicit
    merged = F.create_map(*[x for f in fields for x in (F.lit(f), F.coalesce(get(f"counterfactual.{f}"), get(f)))])
    out = events.filter(F.coalesce(wanted, F.lit(False))).withColumn("overrides", F.map_filter(merged, lambda _, v: v.isNotNull()))
    limit = F.coalesce(get("counterfactual.max_rounds").try_cast("int"), get("max_rounds").try_cast("int"), F.lit(rounds))
    return out.filter(F.size("overrides") > 0).select("event_id", active_quarter(F.col("as_of")).alias("quarter"), "overrides", limit.alias("max_rounds"))


def evidence(ect: Column, hawkish: Column, energy: Column) -> Column:
    """Lines of the rules that hold; a fallback where none does."""
    lines = stacked([
        F.when(ect > 0.5, "above long-run equilibrium").when(ect < -0.5, "below long-run equilibrium"),
        F.when(hawkish > 0.5, "hawkish text"), F.when(energy > 0.3, "energy risk"),
    ])
    return F.when(F.size(lines) == 0, F.array(F.lit("no rule applies"))).otherwise(lines)


PREDICTION = "entity long, event_id string, as_of timestamp, hike double, hold double, cut double, carried boolean"
# Prediction before any is known.
PRIOR = (0.20, 0.65, 0.15)
# Most events of an entry of the state.
LOT = 10_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    """Holds an entity's events until the watermark has passed their time, then lets them through by time and id, each with its own or the last prediction.

    Each call to the state is a message to the JVM, so they are few for an entity
    and batch, whatever its events: what arrives together is one entry of arrays, and
    one timer, that of the earliest event, stands for all.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id array<string>, at array<long>, hike array<double>, hold array<double>, cut array<double>")
        self.last = handle.getValueState("last", "hike double, hold double, cut double, due long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first = None
        events = ((r.event_id, r.at, r.hike, r.hold, r.cut) for r in rows if r.event_id is not None)  # a row without an event only tells the time
        while lot := list(islice(events, LOT)):
            self.waiting.appendValue(tuple(map(list, zip(*lot))))
            earliest = min(x[1] for x in lot) // 1000
            first = earliest if first is None else min(first, earliest)
        if first is not None:
            *last, due = self.last.get() or (*PRIOR, None)
            if due is None or first < due:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(first)
                self.last.update((*last, first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        waiting = [x for lot in self.waiting.get() for x in zip(*lot)]
        rest = [x for x in waiting if x[1] // 1000 > now]
        due = min((x[1] // 1000 for x in rest), default=None)
        *last, _ = self.last.get() or (*PRIOR, None)
        for event_id, at, *own in sorted((x for x in waiting if x[1] // 1000 <= now), key=lambda x: (x[1], x[0])):
            carried = any(x is None or x != x for x in own)
            last = last if carried else own
            yield Row(entity=key[0], event_id=event_id, at=at, hike=last[0], hold=last[1], cut=last[2], carried=carried)
        if rest:
            self.waiting.put([tuple(map(list, zip(*rest[i : i + LOT]))) for i in range(0, len(rest), LOT)])
            self.handle.registerTimer(due)
        else:
            self.waiting.clear()
        self.last.update((*last, due))

    def close(self) -> None:
        pass


def rolling_predictions(events: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Each event (entity, event_id, as_of, hike, hold, cut; null without a prediction) with its own or the entity's last prediction by event time.

    An event goes out when the watermark has passed it, in the order of as_of and
    id whatever its arrival: one that comes late, but within the watermark, changes
    what follows it; a later one is dropped. A row with a null event_id tells the
    time and nothing else; a row without a time goes. State is what waits, and three numbers for an entity,
    kept by RocksDB.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = events.filter("as_of IS NOT NULL").select("entity", "event_id", "as_of", F.unix_micros("as_of").alias("at"), "hike", "hold", "cut").withWatermark("as_of", watermark)
    out = timed.groupBy("entity").transformWithState(statefulProcessor=_InOrder(), outputStructType=PREDICTION.replace("as_of timestamp", "at long"), outputMode="Append", timeMode="EventTime")
    return out.select("entity", "event_id", F.timestamp_micros("at").alias("as_of"), "hike", "hold", "cut", "carried")


def latest(features: DataFrame) -> DataFrame:
    """Each entity's latest row of features (entity, at and others)."""
    return features.groupBy("entity").agg(F.max_by(F.struct("*"), "at").alias("_f")).select("_f.*")


def handled(predictions: DataFrame, features: DataFrame, signals: Sequence[str], fresh_hours: int = 24, top: int = 5) -> DataFrame:
    """Predictions (of rolling_predictions) as an event's whole record: freshness, latest signals, evidence and risk attribution.

    features: entity, at, ect, hawkish, energy and the columns named as signals;
    each entity's latest row holds for its events. An entity without features has no
    signals, isn't fresh, and its evidence is the fallback. Top signals are the
    largest by size, equal ones by name; nulls don't count.
    """
    joined = predictions.join(latest(features).select("entity", F.struct("*").alias("latest")), "entity", "left")
    of = lambda c: F.coalesce(F.col(f"latest.{c}"), F.lit(0.0))
    age = F.unix_micros("as_of") - F.unix_micros("latest.at")
    known = F.filter(F.array(*[F.struct(F.col(f"latest.{c}").cast("double").alias("value"), F.lit(c).alias("name")) for c in signals]), lambda x: x["value"].isNotNull())
    ranked = F.transform(F.slice(F.array_sort(F.transform(known, lambda x: F.struct((-F.abs(x["value"])).alias("size"), x["name"].alias("name"), x["value"].alias("value")))), 1, top), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))
    out = joined.withColumn("fresh", F.coalesce(age < F.lit(fresh_hours * 3_600_000_000), F.lit(False))).withColumn("evidence", evidence(of("ect"), of("hawkish"), of("energy")))
    risk = F.struct(F.lit("predictive_attribution").alias("method"), ranked.alias("top_signals"), F.size("evidence").alias("evidence_count"), F.lit("rolling_prediction_attribution").alias("analysis_scope"))
    return out.withColumn("risk", risk).drop("latest")


def archive(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: a folder for each batch, overwritten when a batch is replayed; a run is named by its batch, its task and its place there."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # numbered where the events are, so no task sees them all
        place = F.monotonically_increasing_id()
        run = F.format_string("run_%04d_%05d_%06d", F.lit(batch_id), F.shiftright(place, 33), place.bitwiseAND(F.lit((1 << 33) - 1)))
        batch.withColumn("run", run).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Handles all that is there and stops."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def run_every(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 10):
    """Polls until it is stopped."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").foreachBatch(sink).start()


def incremental_documents(path: str, hash_: str, buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: documents whose hash no earlier batch has stored are appended to the table at path, one of equal ones; a row of counts for each batch.

    The table lies by batch and by bucket of the hash; of what is stored a batch
    reads the hashes of its own buckets. There is no state beside the table. A batch
    that is replayed compares with the others and overwrites its own rows, so it adds
    nothing. Null hashes are never known and all stored.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        arrived = stored(batch.withColumn("bucket", F.pmod(F.xxhash64(hash_), F.lit(buckets)).cast("int")), "arrived")
        once = arrived.filter(F.col(hash_).isNotNull()).dropDuplicates([hash_]).unionByName(arrived.filter(F.col(hash_).isNull()))
        before = stored_documents(spark, path)
        if before is not None:
            there = [r.bucket for r in arrived.select("bucket").distinct().collect()]
            known = before.filter((F.col("batch") != batch_id) & F.col("bucket").isin(there)).select("bucket", hash_)
            once = once.join(known, ["bucket", hash_], "left_anti")
        once.select(*arrived.columns).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/documents/batch={batch_id}")
        new = spark.read.schema(arrived.schema).parquet(f"{path}/documents/batch={batch_id}").count()
        total = arrived.count()
        counts = spark.createDataFrame([(total, new, total - new)], "arrived long, new_documents long, duplicates long")
        counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")

    return write


def stored_documents(spark: SparkSession, path: str) -> DataFrame | None:
    """What incremental_documents has stored at path, with batch and bucket; None before the first batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/documents")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    found = spark.read.option("mergeSchema", "false").option("recursiveFileLookup", "false").parquet(f"{path}/documents")
    return found


def fetch_counts(spark: SparkSession, path: str) -> DataFrame:
    """(batch, arrived, new_documents, duplicates) of the batches that incremental_documents has handled."""
    return spark.read.parquet(f"{path}/counts").select("batch", "arrived", "new_documents", "duplicates")


def publish(events: DataFrame, path: str) -> None:
    """Writes events as JSON lines to a watched folder; files appear whole. What a source with done="delete" or "archive" has handled leaves the folder: that is the acknowledgement."""
    events.write.mode("append").json(path)


def run_counterfactuals(requests: DataFrame, run: Callable[[str, dict[str, str], int], dict]) -> DataFrame:
    """(event_id, quarter, status, result, error) of a caller's function of quarter, overrides and max_rounds, called where each request is.

    requests: as counterfactual_requests gives them, a batch or a stream. result
    is JSON. A function that fails gives a row with status failed and its
    message, and the other requests go on.
    """

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                try:
                    out.append((r.event_id, r.quarter, "completed", json.dumps(run(r.quarter, dict(r.overrides), int(r.max_rounds)), default=str), None))
                except Exception as error:  # noqa: BLE001  a caller's function may raise anything
                    out.append((r.event_id, r.quarter, "failed", None, f"{type(error).__name__}: {error}"[:500]))
            yield pd.DataFrame(out, columns=["event_id", "quarter", "status", "result", "error"])

    return requests.select("event_id", "quarter", "overrides", "max_rounds").mapInPandas(call, "event_id string, quarter string, status string, result string, error string")
