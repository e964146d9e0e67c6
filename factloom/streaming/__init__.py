"""Assertions as a stream: an append-only overlay of facts, unioned with the base at query time."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_assertions(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that appends a stream of facts to the overlay at path; returns the StreamingQuery."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def with_overlay(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """The base and those asserted facts that it doesn't have."""
    return base.unionByName(overlay.join(base, base.columns, "left_anti").distinct())
