"""R: Structured Streaming twins of the batch operators.

Every stream reads a file source (Kafka in production), keeps its state in
the state store (RocksDB when configured), checkpoints under the shared
``spark.checkpoint.dir`` and writes to files — never to driver memory.
Aggregations run in *update* mode and append each micro-batch's changed rows
to a changelog; ``compact_changelog`` gives the current table (latest row per
key), so state stays bounded by the watermark instead of growing as in
complete mode.  R3 and R7 are in ``jobs.py``, the tables that batches keep in ``tables.py``.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, TimestampNTZType

from talentlake.operators.merge import merge_upsert
from talentlake.session import path_exists, scratch_path
from talentlake.streaming.tables import BatchLog, bases, delete_before

# Log level tags of the merged agent log.
ERROR_MARKERS = ["ERROR", "Exception"]
TRACE_MARKERS = ["LangFuse", "Observability"]
MAX_RECEIVES = 3


# --------------------------------------------------------------------------- A13
def job_stream(spark: SparkSession, path: str, schema: StructType, file_glob: str | None = None,
               max_files_per_trigger: int | None = None) -> DataFrame:
    """Queue source for the streams: new files under ``path`` (Kafka would replace this in production)."""
    r = spark.readStream.schema(schema)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: StructType,
                 starting_offsets: str = "latest") -> DataFrame:
    """Production queue source: JSON messages of a Kafka topic parsed with a fixed schema.

    Needs the Kafka connector package on the cluster's classpath (not part of this image); the
    message key, offset and receive timestamp are kept next to the parsed body.
    """
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).option("startingOffsets", starting_offsets).load())
    return raw.select(F.col("key").cast("string").alias("message_key"), "partition", "offset",
                      F.col("timestamp").alias("received_at"),
                      F.from_json(F.col("value").cast("string"), schema).alias("body")).select(
        "message_key", "partition", "offset", "received_at", "body.*")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables as a stream (its file under the data directory)."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    return job_stream(spark, sf_dir, schema, file_glob=f"{name}.parquet")


def event_time(df: DataFrame, ts: str = "ts", out: str = "event_time") -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ): add a zoned copy of the event time."""
    return df.withColumn(out, F.col(ts).cast("timestamp"))


def run_available(writer, processing_time: str | None = None, timeout_s: float | None = None) -> None:
    """Run a stream: ``availableNow`` (process what is there, then stop) unless a processing-time
    trigger is given, in which case it runs until ``timeout_s``.

    A new query fixes its number of state partitions from ``spark.sql.shuffle.partitions`` for life:
    set it for the stream's full size before the first start.
    """
    if processing_time:
        q = writer.trigger(processingTime=processing_time).start()
        q.awaitTermination(timeout_s)
        q.stop()
        return
    writer.trigger(availableNow=True).start().awaitTermination()


def write_append(df: DataFrame, name: str, path: str | None = None, checkpoint: str | None = None) -> str:
    """Append-mode stream into Parquet files (exactly-once file sink)."""
    spark = df.sparkSession
    out = path or scratch_path(spark, f"{name}-out")
    ck = checkpoint or scratch_path(spark, f"{name}-ckpt")
    run_available(df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
                  .outputMode("append"))
    return out


def write_changelog(df: DataFrame, name: str, keys: Sequence[str], path: str | None = None, checkpoint: str | None = None,
                    compact_every: int = 16) -> str:
    """Update-mode stream: every micro-batch's changed rows are appended with their batch id.

    Every ``compact_every`` batches the table of that moment becomes a new base, and what the base
    before it had replaced is deleted: a reader that started on the older base is not cut off.
    """
    spark = df.sparkSession
    out = path or scratch_path(spark, f"{name}-log")
    ck = checkpoint or scratch_path(spark, f"{name}-ckpt")

    def sink(batch: DataFrame, batch_id: int) -> None:
        # idempotent by batch id: a replayed batch overwrites its own partition only
        (batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(f"{out}/log"))
        if (batch_id + 1) % compact_every == 0:
            older = bases(spark, out)
            compact_changelog(spark, out, keys, df.schema).write.mode("overwrite").parquet(f"{out}/base/v={batch_id}")
            if older:
                delete_before(spark, f"{out}/log", "_batch", max(older) + 1)
                delete_before(spark, f"{out}/base", "v", max(older))

    run_available(df.writeStream.outputMode("update").option("checkpointLocation", ck).foreachBatch(sink))
    return out


def compact_changelog(spark: SparkSession, path: str, keys: Sequence[str], schema: StructType) -> DataFrame:
    """Current table of a changelog: the row of the latest batch per key (partial max_by per key), out of
    the latest base and the batches after it."""
    known = bases(spark, path)
    parts = []
    if known:
        parts.append(spark.read.schema(schema).parquet(f"{path}/base/v={max(known)}").withColumn("_batch", F.lit(max(known)).cast("long")))
    if path_exists(spark, f"{path}/log"):
        log = spark.read.schema(StructType([*schema.fields, StructField("_batch", LongType())])).parquet(f"{path}/log")
        parts.append(log.where(F.col("_batch") > max(known)) if known else log)
    if not parts:  # no batch produced output
        return spark.createDataFrame([], schema)
    log = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    others = [c for c in log.columns if c not in keys and c != "_batch"]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col("_batch")).alias("_r")).select(*keys, "_r.*").select(*schema.names)


# --------------------------------------------------------------------------- R1
def dedupe_stream(s: DataFrame, id_col: str, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """At-least-once queue → one event per id; duplicates within the watermark delay are dropped
    (state for an id is released once the watermark passes it)."""
    return event_time(s, ts).withWatermark("event_time", delay).dropDuplicatesWithinWatermark([id_col]).drop("event_time")


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, whatever the session's own choice."""
    own = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, own)


def dedupe_with_late(s: DataFrame, id_col: str, path: str, delay_minutes: int = 10, ts: str = "ts",
                     checkpoint: str | None = None) -> str:
    """R1 without loss: every id once, whatever the times it is sent with, in ``path/main`` or, when it comes
    behind the watermark (largest event time kept from earlier batches less the delay), in ``path/late``.

    The ids seen are keyed state in RocksDB, by the hash of the id: a batch looks up its own ids (files that
    cannot hold one are skipped by their Bloom filters), so its cost follows the batch and not what was seen.
    They are kept for good: 100 TB of events need about the size of their ids on the executors' disks.
    An event without id has no copy and is kept.  A replayed batch overwrites its own folders.
    """
    spark = s.sparkSession
    ck = checkpoint or scratch_path(spark, "dedupe-late-ckpt")
    times = StructType([StructField("max_ts", s.schema[ts].dataType)])
    progress = BatchLog(spark, f"{path}/progress", times, lambda rows: rows.agg(F.max("max_ts").alias("max_ts")))

    def sink(batch: DataFrame, batch_id: int) -> None:
        top = progress.table(before=batch_id).first()[0]
        late = F.lit(False) if top is None else F.coalesce(
            F.col(ts) < F.timestamp_add("MINUTE", F.lit(-delay_minutes), F.lit(top).cast(batch.schema[ts].dataType)), F.lit(True))
        marked = batch.withColumn("_late", late).persist()
        try:
            for name, part in (("main", marked.where(~F.col("_late"))), ("late", marked.where("_late"))):
                part.drop("_late").write.mode("overwrite").parquet(f"{path}/{name}/_batch={batch_id}")
            progress.write(batch.agg(F.max(ts).alias("max_ts")), batch_id)
        finally:
            marked.unpersist()
        progress.compact(batch_id)

    once = s.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(s.where(F.col(id_col).isNull()))
    with _state_on_disk(spark):
        run_available(once.writeStream.option("checkpointLocation", ck).foreachBatch(sink))
    return path


# --------------------------------------------------------------------------- R2
def metric_windows(s: DataFrame, by: str, value: str, ts: str = "ts", size: str = "5 minutes",
                   delay: str = "10 minutes") -> DataFrame:
    """Tumbling windows: count / sum / avg / max / min of a metric per group."""
    e = event_time(s, ts).withWatermark("event_time", delay)
    agg = e.groupBy(F.window("event_time", size).alias("w"), F.col(by)).agg(
        F.count(F.lit(1)).alias("invocations"), F.round(F.sum(value), 4).alias("sum_value"),
        F.round(F.avg(value), 4).alias("avg_value"), F.max(value).alias("max_value"), F.min(value).alias("min_value"))
    return agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("w.end").cast("timestamp_ntz").alias("window_end"), by,
                      "invocations", "sum_value", "avg_value", "max_value", "min_value")


# --------------------------------------------------------------------------- R4
def upsert_stream(s: DataFrame, initial: DataFrame, path: str, keys: Sequence[str], set_cols: Sequence[str],
                  order_col: str, now: Column, checkpoint: str | None = None, compact_every: int = 8,
                  updated_col: str = "updated_at") -> str:
    """A5 per micro-batch as merge-on-read.

    A batch writes only its own rows (plus its batch id and time) to ``path/deltas/_batch=<id>``
    — the cost of a batch is the size of the batch, not of the table, and a replayed batch
    overwrites its own partition.  Every ``compact_every`` batches the deltas are folded into a
    new base ``path/base/v=<id>``, and what the base before it had replaced is deleted.  ``read_upsert_table``
    returns base ⊕ newer deltas, which equals applying the batches one after another.
    """
    spark = s.sparkSession
    ck = checkpoint or scratch_path(spark, "upsert-ckpt")

    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("_batch", F.lit(batch_id).cast("long")).withColumn("_now", now)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch")
         .parquet(f"{path}/deltas"))
        older = bases(spark, path)
        if (batch_id + 1) % compact_every == 0 and batch_id not in older:
            snap = read_upsert_table(spark, path, initial, keys, set_cols, order_col, updated_col)
            snap.write.mode("overwrite").parquet(f"{path}/base/v={batch_id}")
            if older:  # the base before stays for readers that started on it
                delete_before(spark, f"{path}/deltas", "_batch", max(older) + 1)
                delete_before(spark, f"{path}/base", "v", max(older))

    run_available(s.writeStream.option("checkpointLocation", ck).foreachBatch(sink))
    return path


def _try_read(spark: SparkSession, p: str, schema: StructType | None = None) -> DataFrame | None:
    if not path_exists(spark, p):
        return None
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(p)


def read_upsert_table(spark: SparkSession, path: str, initial: DataFrame, keys: Sequence[str],
                      set_cols: Sequence[str], order_col: str, updated_col: str = "updated_at") -> DataFrame:
    """Current table of an upsert stream: latest compacted base merged with the deltas after it.

    Deltas are ordered by (batch, arrival); each batch's time becomes ``updated_at`` of the keys it
    touched, so the merge equals sequential per-batch application."""
    base_v = max(bases(spark, path), default=None)
    base = initial if base_v is None else spark.read.parquet(f"{path}/base/v={base_v}")
    deltas = _try_read(spark, f"{path}/deltas")
    if deltas is None:
        return base
    if base_v is not None:
        deltas = deltas.where(F.col("_batch") > base_v)
    upd = deltas.withColumn(updated_col, F.col("_now"))
    return merge_upsert(base, upd, keys, list(set_cols) + [updated_col], F.struct("_batch", order_col), None,
                        updated_col=None)


# --------------------------------------------------------------------------- R5
def classify_messages(df: DataFrame, body: str = "body", receives: str = "receives",
                      max_receives: int = MAX_RECEIVES) -> DataFrame:
    """Parse queue bodies (bare id or JSON with job_id) and mark dead letters with a reason."""
    b = F.trim(F.col(body))
    parsed = F.try_parse_json(b)
    json_id = F.when(b.startswith("{"), F.variant_get(parsed, "$.job_id", "string"))
    bare_id = F.when(b.rlike(r"^[A-Za-z0-9_-]+$"), b)
    job_id = F.coalesce(json_id, bare_id)
    reason = (
        F.when(F.col(receives) > max_receives, F.lit("max receives exceeded"))
        .when(job_id.isNull(), F.lit("unparsable body"))
    )
    return df.withColumns({"job_id": job_id, "reason": reason,
                           "route": F.when(reason.isNull(), F.lit("jobs")).otherwise(F.lit("dlq"))})


def dead_letters(s: DataFrame, jobs_path: str, dlq_path: str, checkpoint: str | None = None,
                 max_receives: int = MAX_RECEIVES) -> None:
    """Route every micro-batch into the job table or the dead-letter table (two writes per batch,
    each partition keyed by batch id so a replay overwrites instead of duplicating)."""
    spark = s.sparkSession
    ck = checkpoint or scratch_path(spark, "dlq-ckpt")

    def sink(batch: DataFrame, batch_id: int) -> None:
        c = classify_messages(batch, max_receives=max_receives).withColumn("_batch", F.lit(batch_id).cast("long"))
        c.persist()
        try:
            for route, path in (("jobs", jobs_path), ("dlq", dlq_path)):
                (c.where(F.col("route") == route).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                 .partitionBy("_batch").parquet(path))
        finally:
            c.unpersist()

    run_available(s.writeStream.option("checkpointLocation", ck).foreachBatch(sink))


# --------------------------------------------------------------------------- R6
def log_level(message: Column) -> Column:
    err = None
    for m in ERROR_MARKERS:
        err = message.contains(m) if err is None else err | message.contains(m)
    tr = None
    for m in TRACE_MARKERS:
        tr = message.contains(m) if tr is None else tr | message.contains(m)
    return F.when(err, F.lit("ERROR")).when(tr, F.lit("TRACE")).otherwise(F.lit("INFO"))


def merged_log(streams: Sequence[DataFrame]) -> DataFrame:
    """Union of the agents' log streams with a level tag; every line is kept, however late (``late_events``
    reports those, ``recent_lines`` gives the lines of a time span in order)."""
    u = streams[0]
    for x in streams[1:]:
        u = u.unionByName(x)
    return u.withColumn("level", log_level(F.col("message")))


def recent_lines(logs: DataFrame, now: Column, lookback_minutes: int, ts: str = "ts") -> DataFrame:
    """Lines of the last ``lookback_minutes`` before ``now``, oldest first."""
    return logs.where(F.col(ts) >= F.timestamp_add("MINUTE", F.lit(-lookback_minutes), now)).orderBy(ts)


def _behind(logs: DataFrame, arrival: str, ts: str, lookback_minutes: int, chunk: int, top: Column | None = None) -> DataFrame:
    """``logs`` with ``_late``: behind the watermark, the running max event time over what arrived before (and
    ``top``, what was seen before all of them) less the lookback.

    The running max over arrival order is a parallel prefix: per-chunk maxima (one row per
    ``chunk`` arrivals) → prefix over ``chunk`` chunks at a time and over those → within-chunk running
    max.  No single task sees all lines or all chunks (2^28 lines are one row of the last prefix).
    """
    x = logs.withColumn("_chunk", F.floor(F.col(arrival) / chunk))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    cm = x.groupBy("_chunk").agg(F.max(ts).alias("_cmax")).withColumn("_group", F.floor(F.col("_chunk") / chunk))
    groups = cm.groupBy("_group").agg(F.max("_cmax").alias("_gmax"))
    groups = groups.select("_group", F.max("_gmax").over(before(Window.orderBy("_group"))).alias("_earlier"))
    inside = F.max("_cmax").over(before(Window.partitionBy("_group").orderBy("_chunk")))
    prefix = cm.withColumn("_here", inside).join(groups, "_group").withColumn("_before", F.greatest("_here", "_earlier"))
    w_in = Window.partitionBy("_chunk").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    y = x.join(prefix.select("_chunk", "_before"), "_chunk").withColumn("_in", F.max(ts).over(w_in))
    wm = F.greatest(F.col("_before"), F.col("_in"), *([] if top is None else [top]))
    late = F.col(ts) < F.timestamp_add("MINUTE", F.lit(-lookback_minutes), wm)
    return y.select(*logs.columns, F.coalesce(late, F.lit(False)).alias("_late"))


def _late_counts(late: DataFrame, ts: str, window: str) -> DataFrame:
    start = F.window(F.col(ts).cast("timestamp"), window).start.cast("timestamp_ntz").alias("window_start")
    return late.groupBy(start, "agent").agg(F.count(F.lit(1)).alias("late_lines"))


def late_events(logs: DataFrame, arrival: str, ts: str = "ts", lookback_minutes: int = 5, chunk: int = 1 << 14,
                window: str = "5 minutes") -> DataFrame:
    """Batch report: lines that arrived behind the watermark, per window and agent."""
    return _late_counts(_behind(logs, arrival, ts, lookback_minutes, chunk).where("_late"), ts, window)


class LogTable:
    """What a stream of log lines left under ``path``: lines in time, late lines, and the report of those."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, ts: str, compact_every: int = 16):
        self.spark, self.path, self.schema = spark, path, schema
        counts = StructType([StructField("window_start", TimestampNTZType()), schema["agent"], StructField("late_lines", LongType())])
        self.counts = BatchLog(spark, f"{path}/counts", counts, self._added, None, 1, compact_every)
        times = StructType([StructField("max_ts", schema[ts].dataType)])
        self.progress = BatchLog(spark, f"{path}/progress", times, lambda rows: rows.agg(F.max("max_ts").alias("max_ts")), None, 1, compact_every)

    @staticmethod
    def _added(rows: DataFrame) -> DataFrame:
        return rows.groupBy("window_start", "agent").agg(F.sum("late_lines").alias("late_lines"))

    def late_report(self) -> DataFrame:
        return self.counts.table()

    def lines(self, late: bool) -> DataFrame:
        at = f"{self.path}/{'late' if late else 'lines'}"
        if not path_exists(self.spark, at):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(at).select(*self.schema.names)


def late_stream(s: DataFrame, arrival: str, path: str | None = None, ts: str = "ts", lookback_minutes: int = 5,
                chunk: int = 1 << 14, window: str = "5 minutes", checkpoint: str | None = None) -> LogTable:
    """R6's late report as a stream: lines behind the running watermark go to ``path/late`` and are counted per
    window and agent, all others to ``path/lines``; none is lost.

    Lines of later batches arrived later; inside a batch ``arrival`` orders them.  The watermark at the start of
    a batch is kept per batch, so a replay marks the same lines and overwrites its own folders.
    """
    spark = s.sparkSession
    kept = LogTable(spark, path or scratch_path(spark, "late-lines"), s.schema, ts)

    def sink(batch: DataFrame, batch_id: int) -> None:
        top = F.lit(kept.progress.table(before=batch_id).first()[0]).cast(s.schema[ts].dataType)
        marked = _behind(batch, arrival, ts, lookback_minutes, chunk, top).persist()
        try:
            for name, part in (("lines", marked.where(~F.col("_late"))), ("late", marked.where("_late"))):
                part.drop("_late").write.mode("overwrite").parquet(f"{kept.path}/{name}/_batch={batch_id}")
            kept.counts.write(_late_counts(marked.where("_late"), ts, window), batch_id)
            kept.progress.write(batch.agg(F.max(ts).alias("max_ts")), batch_id)
        finally:
            marked.unpersist()
        kept.counts.compact(batch_id)
        kept.progress.compact(batch_id)

    run_available(s.writeStream.option("checkpointLocation", checkpoint or scratch_path(spark, "late-lines-ckpt")).foreachBatch(sink))
    return kept
