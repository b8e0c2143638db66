"""The scan over streams: the same operators, stateless; counts of alarms by event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..base import Base
from ..plans import fused


def findings(stream: DataFrame, base: Base, mode: str = "ipi", key: str = "doc_key", text: str = "text") -> DataFrame:
    """Findings of each document as it comes."""
    return fused.scan_gated(stream, base, mode, key, text)


def alarms(stream: DataFrame, base: Base, mode: str = "ipi", ts: str = "ts", text: str = "text", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, threat, n): findings by window of event time. Documents later than the watermark are left out."""
    marked = stream.withWatermark(ts, late)
    found = fused.scan_gated(marked.select(F.struct(ts).alias("doc_key"), text), base, mode, "doc_key", text).select(F.col(f"doc_key.{ts}").alias(ts), "threat")
    return found.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), "threat").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "threat", "n")


def each_batch(stream: DataFrame, handle: Callable[[DataFrame], None], checkpoint: str):
    """Starts a query that hands every micro-batch to the same code that batch jobs run."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: handle(df)).start()
