"""Guards inside a plan: a bad row fails the job that reads it, without a job of its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ensure(rows: DataFrame, ok: Column, message: Column) -> DataFrame:
    """rows, of which each must be ok; null is not ok."""
    return rows.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def within(rows: DataFrame, targets: DataFrame, key: str, length: str, start: str = "start", end: str = "end") -> DataFrame:
    """rows whose intervals must lie inside their target: targets has one row a key, with its length."""
    sizes = targets.select(F.col(key).alias("__key"), F.col(length).alias("__length"))
    joined = rows.join(sizes, F.col(key) == F.col("__key"), "left")
    ok = (F.col(start) >= 0) & (F.col(start) <= F.col(end)) & (F.col(end) <= F.col("__length"))
    said = F.concat_ws(" ", F.lit("interval outside its target:"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col(start).cast("string"), F.col(end).cast("string"))
    return ensure(joined, ok, said).drop("__key", "__length")


def once_each(left: DataFrame, right: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """left, where both tables must hold the same keys, each once; right is what is called missing or unexpected. Keys are counted on the map side."""
    mark = lambda df, a, b: df.select(*keys, F.lit(a).alias("__l"), F.lit(b).alias("__r"))
    seen = mark(left, 1, 0).unionByName(mark(right, 0, 1)).groupBy(*keys).agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r"))
    kind = F.when(F.col("__l") + F.col("__r") == 0, "").when(F.col("__r") == 0, "missing").when(F.col("__l") == 0, "unexpected").otherwise("repeated")
    name = F.to_json(F.struct(*keys))
    seen = ensure(seen, (F.col("__l") == 1) & (F.col("__r") == 1), F.concat(kind, F.lit(f" {what}: "), name))
    on = [F.col(f"__k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    seen = seen.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    # a right join, so that keys only the right table has reach the guard too
    met = on[0]
    for o in on[1:]:
        met = met & o
    return left.join(seen, met, "right").drop(*[f"__k{i}" for i in range(len(keys))])
