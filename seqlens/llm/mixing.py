"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only.

Method: a row's hash is uniform over 64 bits. Sizes are summed by source and leading hash
bits; the first bucket where the running sum reaches the source's budget is the boundary,
and only its rows are binned again by the next bits. After LEVELS passes a source's budget is a
threshold on the hash prefix, and taking rows is one comparison a row: nothing is
sorted. Thresholds are nested: a larger budget takes a superset.

Rows that are equal in source, ids and text would hash alike and be taken together. They are numbered
without gaps, in any order, and hashed with their numbers: how many of them are taken is the
same in every run.

Defined results: null text has size 0; a null source is a source of its own, ordered last;
sources without words have target 0 and take nothing; repeated rows are taken one by one; null ids
are hashed with their text; an empty table gives an empty result. Columns of the input that are
named like the result column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlens.operators.positions import with_positions
from seqlens.operators.skew import hot_join
from seqlens.session import shared_table

WORD = r"[^\x20\x09-\x0D]+"
#: Hash bits a pass looks at, and passes: 2**36 leaves hold fewer than one row up to about 7e10 rows a source.
BITS, LEVELS = 12, 3


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(ids: Sequence[str], text: str) -> Column:
    return F.xxhash64(*ids, text)


def _numbered(rows: DataFrame, h: str, key: str) -> DataFrame:
    """rows, written, their hash h replaced for all rows of a key but one, so that no two hash alike.

    A key's rows are spread over range partitions, however many they are.
    """
    rows = rows.withColumn("__rid", F.monotonically_increasing_id())
    placed = shared_table(with_positions(rows, [F.col(key), F.col("__rid")], "__pos", "copies"), "copies")
    first = shared_table(placed.groupBy(key).agg(F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__copies")), "copies")
    got = hot_join(placed, first, [key], "__copies", placed.count())
    nth = F.col("__pos") - F.col("__first")
    return got.withColumn(h, F.when(nth > 0, F.xxhash64(h, nth)).otherwise(F.col(h))).select(*[c for c in rows.columns if c != "__rid"])


def _apart(rows: DataFrame, repeated: DataFrame | None, h: str, source: str) -> DataFrame:
    """rows, of which those of repeated keys, if there are any, get hashes of their own; all others are passed on."""
    if repeated is None:
        return rows
    keyed = rows.withColumn("__key", F.xxhash64(h, source))
    rest = keyed.join(repeated, "__key", "left_anti")
    copies = shared_table(keyed.join(repeated.select("__key"), "__key", "left_semi").select(*keyed.columns), "copies")
    return rest.select(*rows.columns).unionByName(_numbered(copies, h, "__key").select(*rows.columns))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): water-filling by weight.

    Sources by code point, null last, get weights in turn. A target stops at cap times its
    source's size; what is over goes to the rest by weight, until none is above. Every step
    is one aggregate of one row, so the number of sources may be large.
    """
    placed = with_positions(sizes, [F.col("source").asc_nulls_last()], "place", "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = shared_table(placed.withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(float(cap))), "weights")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level, seen = 0.0, None
    while total:
        full = F.col("most") < F.col("w") * F.lit(level)
        n, held, rest = placed.agg(F.count_if(full), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("w")))).first()
        if n == seen or not rest:
            level = level if rest else float("inf")
            break
        seen, level = n, max(level, (share * total - (held or 0.0)) / rest)
    target = F.least("most", F.col("w") * F.lit(level)) if level != float("inf") else F.col("most")
    return placed.select("source", "source_size", target.cast("double").alias("target"))


def thresholds(base: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, below): take every row whole times, and once more if its hash prefix is under below.

    base: (source, size, h). A pass reads only what is still in boundary buckets.
    """
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("int")
    plan = targets.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * size)
    plan = shared_table(plan.withColumn("edge", F.lit(0).cast("long")).withColumn("under", F.lit(0.0)), "mixplan")
    for level in range(1, LEVELS + 1):
        prefix = F.shiftrightunsigned("h", 64 - BITS * level)
        rows = base.where("size > 0").select("source", "size", prefix.alias("bucket"))
        live = plan.where("need > 0").select(F.col("source").alias("s"), "need", "edge", "under")
        inside = F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("bucket", BITS) == F.col("edge"))
        # summed on the map side: a hot source sends at most 2**BITS rows a task
        bins = rows.join(live, inside).groupBy("s", "need", "under", "bucket").agg(F.sum("size").alias("size"))
        # at most 2**BITS rows of a source meet here
        run = F.sum("size").over(Window.partitionBy("s").orderBy("bucket")) + F.col("under")
        hit = bins.withColumn("run", run).where(F.col("run") >= F.col("need"))
        hit = hit.groupBy("s").agg(F.min(F.struct("bucket", "run", "size")).alias("hit"))
        last = level == LEVELS
        # the boundary bucket itself goes to the nearer side once no pass is left
        near = (F.col("hit.run") - F.col("need")) < (F.col("need") - (F.col("hit.run") - F.col("hit.size")))
        edge = F.col("hit.bucket") + (F.when(near, 1).otherwise(0) if last else F.lit(0))
        hit = hit.withColumnRenamed("s", "hs")
        joined = plan.join(hit, plan["source"].eqNullSafe(F.col("hs")) & (plan["need"] > 0), "left")
        under = F.coalesce(F.col("hit.run") - F.col("hit.size"), "under")
        # no bucket reaches the need only by rounding: then every row is below
        none = F.when(F.col("need") > 0, F.lit(1 << (BITS * level))).otherwise(0)
        plan = joined.select("source", "source_size", "target", "whole", "need", F.coalesce(edge, none).cast("long").alias("edge"), under.alias("under"))
        plan = shared_table(plan, "mixplan")
    return plan.select("source", "source_size", "target", "whole", F.col("edge").alias("below"))


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", ids: Sequence[str] = ("doc_id",), weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, out: str = "mix", lean: bool = False) -> DataFrame:
    """docs with a struct column out: size, source_size, target, repeats (times the row is taken), taken (words).

    lean keeps only ids and the struct, and then the text is read once; else the rows
    are read again and the thresholds, one small row a source, are joined to them.
    """
    h, n = row_hash(ids, text), word_count(F.col(text))
    base = shared_table(docs.select(*ids, F.col(source).alias("source"), n.alias("size"), h.alias("h")), "mixbase")
    repeated = base.where("size > 0").groupBy(F.xxhash64("h", "source").alias("__key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = shared_table(repeated.select("__key"), "mixcopies")
    if repeated.isEmpty():
        repeated = None
    else:
        base = shared_table(_apart(base, repeated, "h", "source"), "mixbase")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = thresholds(base, source_targets(sizes, weights, share, cap))
    plan = plan.select(*[F.col(c).alias(f"__{c}") for c in plan.columns])
    if lean:
        rows = base.select(*ids, F.col("source").alias("__s"), F.col("size").alias("__n"), F.col("h").alias("__h"))
        keep = list(ids)
    else:
        rows = _apart(docs.withColumns({"__s": F.col(source), "__n": n, "__h": h}), repeated, "__h", "__s")
        keep = [c for c in docs.columns if c != out]
    more = (F.shiftrightunsigned("__h", 64 - BITS * LEVELS) < F.col("__below")).cast("int")
    repeats = F.when(F.col("__n") > 0, F.col("__whole") + F.when(F.col("__whole") < F.lit(int(cap)), more).otherwise(0)).otherwise(F.least(F.col("__whole"), F.lit(1)))
    joined = rows.join(plan, F.col("__s").eqNullSafe(F.col("__source")))
    mix = F.struct(F.col("__n").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), repeats.alias("repeats"), (repeats * F.col("__n")).cast("long").alias("taken"))
    return joined.withColumn("__mix", mix).select(*keep, F.col("__mix").alias(out))
