"""Mask import, export and matched random controls."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.operators.intervals import merge_intervals
from seqlens.sources.readers import refuse


def import_masked(original: DataFrame, masked: DataFrame, kind: str) -> DataFrame:
    """(accession, start, end) from an original and a masked view of the same sequences (name, seq).

    hard: N where the original is not; soft: lower case. Any other change is refused.
    """
    if kind not in ("hard", "soft"):
        raise ValueError("kind must be hard or soft")
    both = original.select("name", F.col("seq").alias("a")).join(masked.select("name", F.col("seq").alias("b")), "name", "full")
    refuse(both.where(F.col("a").isNull() | F.col("b").isNull()).select("name"), "sequence sets differ")
    refuse(both.where(F.length("a") != F.length("b")).select("name"), "masking must keep the length")
    cells = both.select("name", F.posexplode(F.arrays_zip(F.split("a", "").alias("a"), F.split("b", "").alias("b"))).alias("pos", "c")).select("name", "pos", "c.a", "c.b")
    same = F.upper("b") == F.col("a")
    refuse(cells.where(~same & (F.lit(kind == "soft") | (F.col("b") != "N"))), "masking alters a base")
    hit = (F.col("b") == "N") & (F.col("a") != "N") if kind == "hard" else F.col("b") != F.upper("b")
    return merge_intervals(cells.where(hit).select(F.col("name").alias("accession"), F.col("pos").alias("start"), (F.col("pos") + 1).alias("end")), ["accession"])


def random_control(intervals: DataFrame, seqs: DataFrame, seed: int = 17) -> DataFrame:
    """(accession, start, end): as many intervals of the same widths, placed at random with a gap between.

    One stream of random numbers runs over the accessions in order of ord, so all merged intervals
    meet in one task: it is meant for a reference catalogue's masks.
    """
    merged = merge_intervals(intervals, ["accession"])
    rows = seqs.select(F.col("name").alias("accession"), "ord", F.length("seq").alias("n")).join(merged, "accession", "left")

    def place(group: pd.DataFrame) -> pd.DataFrame:
        rng, out = random.Random(seed), []
        for (_, accession), part in group.sort_values(["ord", "start"]).groupby(["ord", "accession"], sort=True):
            widths = [int(b - a) for a, b in zip(part["start"], part["end"], strict=True) if a == a]
            rng.shuffle(widths)
            if not widths:
                continue
            free = int(part["n"].iloc[0]) - sum(widths) - (len(widths) - 1)
            marks = sorted(rng.sample(range(free + len(widths)), len(widths)))
            at, before = 0, -1
            for i, (mark, width) in enumerate(zip(marks, widths, strict=True)):
                at += mark - before - 1 + (i > 0)
                out.append((accession, at, at + width))
                at, before = at + width, mark
        return pd.DataFrame(out, columns=["accession", "start", "end"])

    return rows.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(place, "accession string, start long, end long")
