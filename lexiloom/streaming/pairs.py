"""Checks of new pairs as they arrive. The reference has no streams; this is an extra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexiloom.operators.mechanical import check_all


def check_stream(pairs: DataFrame, key: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Issues of each micro-batch appended to Parquet under ``path``; all checks are row-wise, so there is no state."""
    return check_all(pairs, key).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
