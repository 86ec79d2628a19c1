"""Interval algebra on half-open [start, end) rows grouped by key columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqlens.operators.positions import PID, ROW, laid_out
from seqlens.session import shared_table


def overlaps(a: Column, b: Column, x: Column, y: Column) -> Column:
    """[a, b) and [x, y) share a position."""
    return (a < y) & (b > x)


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", spread: bool = False) -> DataFrame:
    """keys, start, end of maximal runs; touching intervals merge.

    A key's intervals meet in one task, which suits keys of few rows; spread is for keys that may hold a large
    share of all rows (merge_spread).
    """
    if spread:
        return merge_spread(df, keys, start, end)
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(start) <= F.col("__reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.select(*keys, start, end).distinct().withColumn("__reach", reach).withColumn("__island", island)
    return rows.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def _inherited(laid: DataFrame, keys: Sequence[str], value: Column, out: str, later: bool = False) -> DataFrame:
    """laid (see positions.laid_out) with out: the greatest value of the key in earlier partitions, or the least in later ones.

    One row a key and partition; only keys that lie in several partitions have something to inherit.
    """
    pick = F.min if later else F.max
    per = laid.groupBy(PID, *keys).agg(pick(value).alias("__v"))
    wide = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("__p")).where("__p > 1")
    on = [F.col(k).eqNullSafe(F.col(f"__w{i}")) for i, k in enumerate(keys)]
    met = on[0]
    for o in on[1:]:
        met = met & o
    wide = wide.select(*[F.col(k).alias(f"__w{i}") for i, k in enumerate(keys)])
    order = Window.partitionBy(*keys).orderBy(PID)
    rows = order.rowsBetween(1, Window.unboundedFollowing) if later else order.rowsBetween(Window.unboundedPreceding, -1)
    heirs = per.join(wide, met, "left_semi").select(F.col(PID).alias("__hp"), *[F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)], pick("__v").over(rows).alias(out))
    met = F.col(PID) == F.col("__hp")
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"__h{i}"))
    return laid.join(heirs, met, "left").drop("__hp", *[f"__h{i}" for i in range(len(keys))])


def merge_spread(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """merge_intervals of keys of any size: rows are sorted by range partition, and each partition inherits how far its key reaches already."""
    laid = laid_out(df.select(*keys, start, end).distinct(), [*[F.col(k) for k in keys], F.col(start), F.col(end)], "islands")
    laid = _inherited(laid, keys, F.col(end), "__before")
    own = Window.partitionBy(PID, *keys).orderBy(ROW)
    reach = F.greatest(F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.col("__before"))
    rows = laid.withColumn("__new", F.when(F.coalesce(F.col(start) > reach, F.lit(True)), F.col(start)))
    # starts ascend, so the greatest beginning so far is that of the island a row is in
    rows = _inherited(rows, keys, F.col("__new"), "__from")
    island = F.greatest(F.max("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)), F.col("__from"))
    rows = rows.withColumn("__island", island)
    return rows.groupBy(*keys, "__island").agg(F.max(end).alias(end)).select(*keys, F.col("__island").alias(start), end)


def union_length(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", out: str = "bases", spread: bool = False) -> DataFrame:
    """keys and the number of positions their intervals cover."""
    return merge_intervals(df, keys, start, end, spread).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).cast("long").alias(out))


def _level(start: Column, end: Column) -> Column:
    """The least power of two that is at least an interval's length, as exponent."""
    return F.ceil(F.log2(F.greatest(end - start, F.lit(1)).cast("double"))).cast("int")


def _binned(rows: DataFrame, levels: Column, start: str, end: str) -> DataFrame:
    """rows for each of the levels and each bin of that width that they touch: at most two bins a level that is no less than their own."""
    rows = rows.withColumn("__level", F.explode(levels))
    bin_ = lambda c: F.call_function("shiftright", c.cast("long"), F.col("__level"))
    last = F.greatest(F.col(end) - 1, F.col(start))
    return rows.withColumn("__bin", F.explode(F.sequence(bin_(F.col(start)), bin_(last))))


def intersect_intervals(left: DataFrame, right: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", carry: Sequence[str] = ()) -> DataFrame:
    """left's rows with each overlapping right interval of the same keys: overlap_start, overlap_end, and the columns of right named in carry.

    A pair meets in bins as wide as the longer of the two: each interval lies in at most two bins of its own width, and in
    two of each greater width that the other side has, so rows that share a key but lie apart never meet,
    however many a key has. Of two common bins the one where the later of the two begins owns the pair.
    """
    # powers of two up to the greatest length: a few dozen numbers
    sizes = lambda df, a, b: sorted(r[0] for r in df.where(F.col(a) < F.col(b)).select(_level(F.col(a), F.col(b))).distinct().collect())
    r = right.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(start).cast("long").alias("__rs"), F.col(end).cast("long").alias("__re"), *carry).where("__rs < __re")
    on = overlaps(F.col(start), F.col(end), F.col("__rs"), F.col("__re")) & (F.col("__level") == F.col("__l2")) & (F.col("__bin") == F.col("__b2"))
    on = on & (F.col("__bin") == F.call_function("shiftright", F.greatest(F.col(start).cast("long"), F.col("__rs")), F.col("__level")))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    numbers = lambda ls: F.array(*[F.lit(n) for n in ls]).cast("array<int>")
    mine, theirs = _level(F.col(start), F.col(end)), _level(F.col("__rs"), F.col("__re"))
    wide, narrow = numbers(sizes(left, start, end)), numbers(sizes(r, "__rs", "__re"))
    kept = left.where(F.col(start) < F.col(end))
    # left intervals in their own bins meet right ones that are no longer; then the other way round
    met = None
    for own, others in ((F.array(mine), F.filter(wide, lambda n: n >= theirs)), (F.filter(narrow, lambda n: n > mine), F.array(theirs))):
        b = _binned(r, others, "__rs", "__re").withColumnsRenamed({"__level": "__l2", "__bin": "__b2"})
        part = _binned(kept, own, start, end).join(b, on)
        met = part if met is None else met.unionByName(part)
    joined = met.withColumn("overlap_start", F.greatest(start, "__rs")).withColumn("overlap_end", F.least(end, "__re"))
    return joined.drop("__rs", "__re", "__level", "__bin", "__l2", "__b2", *[f"__{k}" for k in keys])


def sweep_segments(runs: DataFrame, keys: Sequence[str], member: str, start: str = "start", end: str = "end") -> DataFrame:
    """Elementary segments between interval ends, with the members active on each (sorted, nulls left out); segments without a run are left out.

    Ends are sorted by range partition and swept once. A partition takes over which members are active in its first key, and where its
    last key goes on: a row a member of the keys at partitions' borders. So a key may hold any share of the rows, and no run meets a segment.
    """
    whole = F.coalesce(F.col(start) < F.col(end), F.lit(False))
    step = lambda at, by: F.struct(F.col(at).cast("long").alias("__at"), F.when(whole, by).otherwise(0).alias("__by"))
    ends = runs.select(*keys, F.col(member).cast("string").alias("__m"), F.explode(F.array(step(start, 1), step(end, -1))).alias("__e")).select(*keys, "__m", F.inline(F.array("__e")))
    ends = ends.where("__at IS NOT NULL" + "".join(f" AND `{k}` IS NOT NULL" for k in keys))
    laid = laid_out(ends, [*[F.col(k) for k in keys], F.col("__at")], "ends")
    key = F.struct(*keys)
    # a key that lies in several partitions is the first or the last of each
    borders = laid.groupBy(PID).agg(F.min(key).alias("a"), F.max(key).alias("b")).select(PID, F.explode(F.array_distinct(F.array("a", "b"))).alias("k"))
    wide = borders.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k.*")
    per = shared_table(laid.join(F.broadcast(wide), list(keys), "left_semi").groupBy(PID, *keys, "__m").agg(F.sum("__by").cast("int").alias("__by"), F.min("__at").alias("__at")), "borders")
    parts = per.select(*keys, PID).distinct()
    # what earlier partitions left active stands before a partition's rows, the next partition's first end after them
    earlier = per.join(parts.withColumnRenamed(PID, "__to"), list(keys)).where(F.col(PID) < F.col("__to")).groupBy(*keys, "__m", F.col("__to").alias(PID)).agg(F.sum("__by").cast("int").alias("__by"))
    first = earlier.where("__by <> 0").select(*keys, "__m", F.lit(None).cast("long").alias("__at"), "__by", PID, F.lit(-1).cast("long").alias(ROW))
    after = per.groupBy(PID, *keys).agg(F.min("__at").alias("__at")).withColumn("__at", F.lead("__at").over(Window.partitionBy(*keys).orderBy(PID))).where("__at IS NOT NULL")
    last = after.select(*keys, F.lit(None).cast("string").alias("__m"), "__at", F.lit(0).alias("__by"), PID, F.lit(1 << 40).alias(ROW))
    rows = laid.select(*keys, "__m", "__at", "__by", PID, ROW).unionByName(first).unionByName(last).repartition(PID).sortWithinPartitions(PID, ROW)
    kind = StructType([*runs.select(*keys).schema.fields, *StructType.fromDDL("seg_start long, seg_end long, members array<string>").fields])
    swept = rows.mapInArrow(_swept(len(keys)), kind)
    types = runs.select(start, F.array(member).alias(member)).schema
    return swept.select(*keys, *[F.col(c).cast(types[0].dataType).alias(c) for c in ("seg_start", "seg_end")], F.col("members").cast(types[1].dataType).alias("members"))


def _swept(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sweep rows (n keys, member, place, change, partition, row), partitions one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, active, members = None, None, {}, []
        for b in batches:
            out = []
            for i, (m, place, by, pid, *key) in enumerate(zip(*(b.column(c).to_pylist() for c in (n, n + 1, n + 2, n + 3, *range(n))), strict=True)):
                if (pid, key) != now:
                    now, at, active, members = (pid, key), None, {}, []
                elif at is not None and place > at and active:
                    members = members or [sorted(x for x in active if x is not None)]
                    out.append((i, at, place, members[0]))
                at = place
                if by:
                    left = active.get(m, 0) + by
                    if left:
                        active[m] = left
                    else:
                        del active[m]
                    members = []
            if out:
                rows, starts, ends, held = zip(*out, strict=True)
                at_rows = pa.array(rows)
                columns = [*[b.column(c).take(at_rows) for c in range(n)], pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(held, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[:n], "seg_start", "seg_end", "members"])

    return run


def sequence_windows(seqs: DataFrame, size: int = 500, step: int = 500, name: str = "name", seq: str = "seq") -> DataFrame:
    """(name, start, end, text) windows; the tail is cut short and the first window that reaches the end is the last."""
    if size < 1 or not 0 < step <= size:
        raise ValueError("require 0 < step <= size")
    n = F.length(seq)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    rows = seqs.where(n > 0).select(F.col(name), F.col(seq).alias("__seq"), F.explode(starts).alias("start"))
    rows = rows.where((F.col("start") == 0) | (F.col("start") - step + size < F.length("__seq")))
    end = F.least(F.col("start") + size, F.length("__seq"))
    return rows.select(name, "start", end.alias("end"), F.substring(F.col("__seq"), F.col("start") + 1, F.lit(size)).alias("text"))


def target_windows(targets: DataFrame, size: int = 500, step: int = 500, name: str = "contig", length: str = "length") -> DataFrame:
    """(window_id, contig, start, end) of targets (contig, length), as sequence_windows cuts them."""
    if size < 1 or not 0 < step <= size:
        raise ValueError("require 0 < step <= size")
    n = F.col(length)
    rows = targets.where(n > 0).select(F.col(name).alias("contig"), n.alias("__n"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(step))).alias("start"))
    rows = rows.where((F.col("start") == 0) | (F.col("start") - step + size < F.col("__n")))
    return rows.select(F.concat_ws(":", "contig", "start").alias("window_id"), "contig", F.col("start").cast("int").alias("start"), F.least(F.col("start") + size, F.col("__n")).cast("int").alias("end"))


def split_at_cuts(seqs: DataFrame, cuts: DataFrame, name: str = "name", seq: str = "seq", cut: str = "cut") -> DataFrame:
    """(name, part, start, end, text): sequences split at inner cut positions; parts count from 1."""
    n = F.length(seq)
    ends = seqs.select(F.col(name), F.explode(F.array(F.lit(0), n)).alias("at"))
    inner = cuts.join(seqs.select(F.col(name).alias("__n"), n.alias("__len")), F.col(name) == F.col("__n")).where((F.col(cut) > 0) & (F.col(cut) < F.col("__len"))).select(F.col(name), F.col(cut).cast("int").alias("at"))
    w = Window.partitionBy(name).orderBy("at")
    parts = ends.unionByName(inner).distinct().select(name, F.col("at").alias("start"), F.lead("at").over(w).alias("end"), F.row_number().over(w).alias("part")).where("end IS NOT NULL")
    full = parts.join(seqs.select(F.col(name).alias("__n"), F.col(seq).alias("__seq")), F.col(name) == F.col("__n"))
    return full.select(name, "part", "start", "end", F.substring(F.col("__seq"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))
