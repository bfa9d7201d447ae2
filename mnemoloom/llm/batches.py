"""Bounds on what one Arrow batch holds."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows and bytes of one batch on the way to Python; texts may be long.
ROWS, BYTES = 1000, 16 << 20


def by_bytes(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches bounded unless the user has set tighter bounds."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)):
        try:
            now = int(conf.get(key))
        except Exception:  # a version without this setting
            continue
        if now <= 0 or now > most:
            conf.set(key, str(most))
    return df
