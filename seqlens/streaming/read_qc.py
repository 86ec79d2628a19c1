"""Stateless read quality control over a stream: the one operator whose meaning does not change when input is unbounded."""

from __future__ import annotations

from pyspark.sql import DataFrame

from seqlens.operators.reads import poor


def screen(reads: DataFrame, seq: str = "seq", qual: str = "qual") -> DataFrame:
    """reads (batch or stream) with reason: null for reads that pass."""
    return reads.withColumn("reason", poor(reads[seq], reads[qual]))
