"""Incremental forms: ingest of new files with de-duplication, status, and alert changes. Checkpoints replace hand-kept state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textlake.functions import text as T
from textlake.operators import dedup, rules
from textlake.runtime import materialize, scratch


def stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 16, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(folder)


def ingest(source: DataFrame, out: str, checkpoint: str, order: str, text: str = "text", profile: rules.Profile = rules.ZH) -> StreamingQuery:
    """Cleans arriving documents and appends the kept ones whose compact key is new to the table at `out`.

    Earlier output is the state: each batch is de-duplicated in itself, then against the keys of the table by an anti join, so state never outgrows the
    table and survives any restart; of the table only the column of keys is read. A batch that is replayed after a failure finds its own keys in the
    table and adds nothing. What a batch writes for itself goes when it ends.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        with scratch(df.sparkSession):
            take_in(df, batch_id)

    def take_in(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        # The batch is read twice below, and its rules read the normalised text many times: both are tables of their own.
        clean = materialize(df.withColumn(text, T.normalize_clean(F.col(text))))
        kept = materialize(rules.classify(clean, text, profile=profile).where("decision = 'keep'").withColumn("dedupe_key", T.compact_key(F.col(text))))
        d = dedup.first_wins(kept, F.col("dedupe_key"), F.col(order)).withColumn("batch_id", F.lit(batch_id))
        try:
            seen = spark.read.parquet(out)
        except Exception as e:  # noqa: BLE001 - the table does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            seen = None
        if seen is not None:
            d = dedup.not_seen(d, seen, F.col("dedupe_key"), F.col("dedupe_key"))
        d.write.mode("append").parquet(out)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_within(source: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """First arrivals of each key within the watermark: state bounded by the delay."""
    return source.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_status(source: DataFrame, time: str, delay: str, width: str, by: str) -> DataFrame:
    """Rows and last event per key and window; late rows beyond the delay are dropped."""
    return source.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("last")).select(F.col("window.start").alias("start"), by, "n", "last")


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns its result table."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def alert_events(alerts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends opened and resolved alerts: each batch of (run_id, key, checked_at) is compared with those still open in the table."""
    from textlake.operators.runs import alert_changes

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        try:
            log = spark.read.parquet(out).where(F.col("batch_id") < batch_id)
            last = log.groupBy("run_id", "key").agg(F.max_by("change", "batch_id").alias("change"))
            before = last.where("change = 'opened'")
        except Exception as e:  # noqa: BLE001 - the table does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            before = df.limit(0).select("run_id", "key")
        # Runs of which this batch says nothing keep their alerts.
        before = before.join(df.select("run_id").distinct(), "run_id", "left_semi")
        alert_changes(before, df.where("key is not null")).withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    return alerts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watchdog(status: DataFrame, stale_seconds: int, max_restarts: int) -> DataFrame:
    """(…, action) from rows of state, age_seconds, restarts, done: 'complete', 'wait', 'restart' or 'blocked'."""
    late = F.col("age_seconds") > stale_seconds
    return status.withColumn("action", F.when(F.col("done"), "complete").when(~F.coalesce(late, F.lit(True)) & (F.col("state") == "running"), "wait").when(F.col("restarts") < max_restarts, "restart").otherwise("blocked"))
