"""The ledger as a stream: newest state per key, kept up to date as lines arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ledger_stream(lines: DataFrame, key: str, status: str, time: str, seq: str) -> DataFrame:
    """Newest (status, time) per key of a streaming log, for update mode; late lines lose to newer ones by their time."""
    newest = F.max_by(F.struct(status, time), F.struct(time, seq))
    state = lines.where(F.col(key).isNotNull() & F.col(status).isNotNull()).groupBy(key).agg(newest.alias("_l"))
    return state.select(key, F.col(f"_l.{status}").alias(status), F.col(f"_l.{time}").alias(time))


def run_available(stream: DataFrame, sink, checkpoint: str) -> None:
    """Process what has arrived; ``sink(batch, id)`` gets each micro-batch's changed keys."""
    query = stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
