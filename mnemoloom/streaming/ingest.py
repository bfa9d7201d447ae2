"""Structured Streaming: notes in, state out.

Ingest is idempotent: ids come from content, each micro-batch appends only what the store lacks, and the checkpoint takes
the place of done markers. Event-time counts use a watermark; claim state is kept per user by a stateful operator over the
ordered log, and agrees with the batch fold on the same events.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemoloom.functions import ids, text

NOTE = "user_id string, ts timestamp, title string, raw_text string"


def encode(notes: DataFrame, min_chars: int = 40) -> DataFrame:
    """Notes with content ids and their sentences; a note without a sentence keeps its first 500 characters as one."""
    s = text.sentences(F.col("raw_text"), min_chars)
    s = F.when(F.size(s) > 0, s).otherwise(F.array(F.substring("raw_text", 1, 500)))
    return notes.where(F.trim("raw_text") != "").withColumn("episode_id", ids.claim_id(F.col("user_id"), F.col("raw_text"), "ep_")).withColumn("sentences", s)


def append_batch(store: str):
    """A foreachBatch function: append the notes that ``store`` lacks. A repeated batch appends nothing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = encode(batch).dropDuplicates(["episode_id"])
        path = spark._jvm.org.apache.hadoop.fs.Path(store)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            new = new.join(spark.read.parquet(store).select("episode_id"), "episode_id", "left_anti")
        new.write.mode("append").parquet(store)

    return run


def ingest(spark: SparkSession, source: str, store: str, checkpoint: str):
    """Read JSON notes that arrive in ``source`` and append them to ``store``; the started query."""
    notes = spark.readStream.schema(NOTE).json(source)
    return notes.writeStream.foreachBatch(append_batch(store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recency(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by user and window of event time; later ones than ``late`` don't count."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy("user_id", F.window("ts", width)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def strengths(events: DataFrame) -> DataFrame:
    """(user_id, claim_id, strength, last_seq) so far, from a stream of (seq, user_id, claim_id, type) in log order."""

    def update(key: tuple, frames, state: GroupState):
        strength, last = state.get if state.exists else (0.0, -1)
        rows = pd.concat(list(frames)).sort_values("seq")
        for seq, kind in rows[["seq", "type"]].itertuples(index=False):
            if seq <= last:
                continue  # seen before: at-least-once delivery counts once
            if kind == "NEW":
                strength = strength or 1.0
            elif kind == "PRUNED":
                strength = 0.0
            elif strength:
                strength += {"SUPPORT": 0.5, "STRENGTHENED": 0.25}.get(kind, 0.0)
            last = seq
        state.update((strength, last))
        yield pd.DataFrame({"user_id": [key[0]], "claim_id": [key[1]], "strength": [strength], "last_seq": [last]})

    schema = "user_id string, claim_id string, strength double, last_seq bigint"
    return events.groupBy("user_id", "claim_id").applyInPandasWithState(update, schema, "strength double, last bigint", "update", GroupStateTimeout.NoTimeout)

