"""What a worker holds of its input at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch: many short documents, or one long one.
BATCH = "8m"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, its session's Arrow batches limited in bytes where the session says nothing else."""
    conf = df.sparkSession.conf
    if conf.get(_LIMIT, None) is None:
        conf.set(_LIMIT, BATCH)
    return df
