"""The at-least-once task stream: tasks without redeliveries, retries with back-off, dead letters, and status by file.

Sources are any Structured Streaming source of task rows (event_id, file_id, at, outcome); tests use file streams, as the
Kafka connector is a separate jar. State is per file: RocksDB keeps it, and output is append-only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

MAX_RETRIES = 4
BACKOFF = (1, 2, 4, 8)
#: How long a file's attempts and the tasks it has seen are remembered after they last changed.
STATE_TTL_S = 7 * 24 * 3600
TASK = "event_id long, delivery int, file_id long, at timestamp, outcome string"
STEPS = "file_id long, event_id long, attempt int, action string, delay_s int"


def task_stream(spark: SparkSession, path: str, schema: str = TASK) -> DataFrame:
    """Tasks as JSON lines that arrive under path."""
    return spark.readStream.schema(schema).json(path)


class Attempts(StatefulProcessor):
    """Per file: ok ends it, a passing failure is retried at most MAX_RETRIES times, then goes to dead letters.

    A task is an event's delivery: a redelivery, of the same event and delivery number, is dropped, however late; a retry of
    an event has the next number. A file that is done ignores everything that comes later. State ends ttl_s after it last
    changed, if that is given.
    """

    def __init__(self, ttl_s: int | None = None):
        self.ttl = None if ttl_s is None else ttl_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("attempts", IntegerType()), StructField("status", StringType())])
        task = StructType([StructField("event_id", LongType()), StructField("delivery", IntegerType())])
        self.state = handle.getValueState("file", schema, self.ttl)
        self.seen = handle.getMapState("seen", task, StructType([StructField("at", TimestampType())]), self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        attempts, status = (0, "UPLOADED")
        if self.state.exists():
            attempts, status = self.state.get()
        out = []
        tasks = pd.concat(list(rows)).sort_values(["at", "event_id", "delivery"])
        for event_id, delivery, at, outcome in zip(tasks["event_id"], tasks["delivery"].fillna(0), tasks["at"], tasks["outcome"], strict=True):
            task = (int(event_id), int(delivery))
            if self.seen.containsKey(task):
                continue
            self.seen.updateValue(task, (at.to_pydatetime(),))
            if status in ("READY", "NEEDS_OCR", "FAILED"):
                out.append((key[0], event_id, attempts, "IGNORE", 0))
                continue
            if outcome in ("ok", "needs_ocr"):
                status, action, delay = ("READY" if outcome == "ok" else "NEEDS_OCR"), "DONE", 0
            elif outcome == "fatal" or attempts >= MAX_RETRIES:
                status, action, delay = "FAILED", "DEAD_LETTER", 0
            else:
                status, action, delay = "RETRYING", "RETRY", BACKOFF[attempts]
                attempts += 1
            out.append((key[0], event_id, attempts, action, delay))
        self.state.update((attempts, status))
        yield pd.DataFrame(out, columns=["file_id", "event_id", "attempt", "action", "delay_s"])

    def close(self) -> None:
        pass


def attempts(tasks: DataFrame, ttl_s: int | None = None) -> DataFrame:
    """One row per task with what was done about it.

    A stream that runs for ever needs a time to live, such as STATE_TTL_S, or its state grows for ever. A replay with the
    availableNow trigger takes none: with one, Spark waits for state to end and never does.
    """
    mode = "None" if ttl_s is None else "ProcessingTime"
    return tasks.groupBy("file_id").transformWithStateInPandas(statefulProcessor=Attempts(ttl_s), outputStructType=STEPS, outputMode="Append", timeMode=mode)


def write_steps(steps: DataFrame, path: str, checkpoint: str):
    """Append steps to path/steps and dead letters to path/dead, once per batch: a replayed batch overwrites its own folder."""

    def batch(df: DataFrame, number: int) -> None:
        df.persist()
        df.write.mode("overwrite").parquet(f"{path}/steps/batch={number}")
        df.where("action = 'DEAD_LETTER'").write.mode("overwrite").parquet(f"{path}/dead/batch={number}")
        df.unpersist()

    return steps.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replace_documents(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Replace all chunks of the documents in ``chunks``: their buckets are rewritten with the other documents' rows.

    Buckets are folders; only those touched are read and written (dynamic partition overwrite).
    """
    spark = chunks.sparkSession
    new = chunks.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    try:
        old = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        new.write.partitionBy("bucket").parquet(path)
        return
    touched = [r[0] for r in new.select("bucket").distinct().collect()]
    kept = old.where(F.col("bucket").isin(touched)).join(new.select("doc_id").distinct(), "doc_id", "left_anti").select(*new.columns)
    staged = f"{path.rstrip('/')}.staged"
    kept.unionByName(new).write.mode("overwrite").parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
