"""Assembly evaluation against sources: chimera calls, breakpoints, recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlens.operators.design import n50
from seqlens.operators.intervals import merge_intervals, union_length
from seqlens.operators.skew import dealt
from seqlens.session import shared_table


def aligned_columns(hits: DataFrame) -> DataFrame:
    """(contig, source, hit, q, s, match): aligned base pairs of hits (1-based inclusive, with aligned strings or ungapped).

    hits: hit, contig, source, qstart, qend, sstart, send, qseq, sseq.
    """
    rows = hits.select("hit", "contig", "source", "qstart", "qend", "sstart", "send", F.posexplode(F.arrays_zip(F.split("qseq", "").alias("a"), F.split("sseq", "").alias("b"))).alias("i", "c"))
    w = Window.partitionBy("hit").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    moved = lambda c: F.coalesce(F.sum(F.when(F.col(c) != "-", 1).otherwise(0)).over(w), F.lit(0))
    way = lambda a, b: F.when(F.col(b) >= F.col(a), 1).otherwise(-1)
    rows = rows.withColumn("q", F.col("qstart") - 1 + way("qstart", "qend") * moved("c.a")).withColumn("s", F.col("sstart") - 1 + way("sstart", "send") * moved("c.b"))
    same = (F.upper("c.a") == F.upper("c.b")) & F.upper("c.a").isin("A", "C", "G", "T")
    return rows.where("c.a <> '-' AND c.b <> '-'").select("hit", "contig", "source", "q", "s", same.alias("match"))


def accepted(hits: DataFrame, identity: float = 99.0, minimum: int = 150) -> DataFrame:
    return hits.where((F.col("pident") >= identity) & (F.col("length") >= minimum))


def contig_calls(contigs: DataFrame, bases: DataFrame, minimum: int = 150, explained: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """(calls, breakpoints) from contigs (contig, length) and aligned bases (contig, source, q, match).

    One full explanation beats any chain of partial ones; two are ambiguous. Otherwise blocks are runs of
    positions a source covers that hold a base only it matches exactly, and neighbours in order of
    those bases that meet (gap of at most 10) are a breakpoint.
    """
    support = bases.groupBy("contig", "source", "q").agg(F.max("match").alias("match"))
    exact = support.where("match").groupBy("contig", "q").agg(F.min("source").alias("only"), F.count(F.lit(1)).alias("n")).where("n = 1").select("contig", "q", "only")
    w = Window.partitionBy("contig", "source").orderBy("q")
    runs = support.join(exact, ["contig", "q"], "left").withColumn("island", F.col("q") - F.row_number().over(w))
    own = F.col("only") == F.col("source")
    blocks = runs.groupBy("contig", "source", "island").agg(F.min("q").alias("start"), (F.max("q") + 1).alias("end"), F.min(F.when(own, F.col("q"))).alias("u0"), F.max(F.when(own, F.col("q"))).alias("u1"))
    return _calls_of(contigs, blocks, minimum, explained)


def interval_calls(contigs: DataFrame, runs: DataFrame, minimum: int = 150, explained: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """contig_calls from runs (contig, source, start, end) in which every base matches, without a row a base.

    A running sum over the ends of a contig's blocks counts the sources on a stretch; where it is 1, the running
    sum of block numbers is the number of the only block. Runs travel once, by contig, into partitions of about the same
    number of rows whatever the input.
    """
    blocks = merge_intervals(dealt(runs, ["contig"]), ["contig", "source"]).withColumn("block", F.row_number().over(Window.partitionBy("contig").orderBy("start", "source")).cast("long"))
    ends = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step"))))
    steps = blocks.select("contig", "block", ends.alias("e")).groupBy("contig", "e.at").agg(F.sum("e.step").alias("step"), F.sum(F.col("e.step") * F.col("block")).alias("shift"))
    w = Window.partitionBy("contig").orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    pieces = steps.select("contig", "at", F.lead("at").over(w).alias("to"), F.sum("step").over(so_far).alias("depth"), F.sum("shift").over(so_far).alias("block")).where("depth = 1")
    own = pieces.groupBy("contig", "block").agg(F.min("at").alias("u0"), (F.max("to") - 1).alias("u1"))
    return _calls_of(contigs, blocks.join(own, ["contig", "block"], "left").drop("block"), minimum, explained)


def _calls_of(contigs: DataFrame, blocks: DataFrame, minimum: int, explained: float) -> tuple[DataFrame, DataFrame]:
    """(calls, breakpoints) from blocks (contig, source, start, end, u0, u1), u0 and u1 the first and last position only that source matches."""
    blocks = dealt(shared_table(blocks, "blocks"), ["contig"])
    per = blocks.groupBy("contig", "source").agg(F.sum(F.col("end") - F.col("start")).alias("bases"), F.max(F.col("u0").isNotNull()).alias("unique")).join(contigs, "contig")
    whole = F.col("bases") / F.col("length") >= explained
    per = per.groupBy("contig").agg(F.count_if(whole).alias("complete"), F.min(F.when(whole, F.col("source"))).alias("full"), F.min(F.when(whole & F.col("unique"), F.col("source"))).alias("own"))
    blocks = blocks.where((F.col("end") - F.col("start") >= minimum) & F.col("u0").isNotNull())
    o = Window.partitionBy("contig").orderBy("u0", "u1", "source")
    nxt = {c: F.lead(c).over(o) for c in ("source", "start", "u0")}
    pairs = blocks.select("contig", F.col("source").alias("left_source"), nxt["source"].alias("right_source"), F.col("end").alias("le"), nxt["start"].alias("rs"), "u1", nxt["u0"].alias("r0"))
    breaks = pairs.where("left_source <> right_source AND u1 < r0 AND (le >= rs OR rs - le <= 10)").join(per.where("complete > 0").select("contig"), "contig", "left_anti")
    breaks = breaks.select("contig", "left_source", "right_source", (F.col("u1") + 1).alias("start"), F.col("r0").alias("end"))
    wrong = breaks.groupBy("contig").agg(F.count(F.lit(1)).alias("wrong"))
    calls = contigs.join(per, "contig", "left").join(wrong, "contig", "left")
    status = F.when(F.col("complete").isNull(), "unaligned").when(F.col("complete") > 1, "ambiguous").when(F.col("complete") == 1, F.when(F.col("own") == F.col("full"), "consistent").otherwise("ambiguous")).when(F.col("wrong") > 0, "chimeric").otherwise("ambiguous")
    source = F.when(status == "consistent", F.col("full"))
    return calls.select("contig", "length", status.alias("status"), source.alias("source"), F.coalesce("wrong", F.lit(0)).cast("long").alias("wrong_connections")), breaks


def aligned_runs(columns: DataFrame) -> DataFrame:
    """(contig, source, start, end, length): stretches continuous on contig and source."""
    w = Window.partitionBy("hit").orderBy("q")
    near = (F.col("q") - F.lag("q").over(w) == 1) & (F.abs(F.col("s") - F.lag("s").over(w)) == 1)
    rows = columns.withColumn("gap", F.when(near, 0).otherwise(1)).withColumn("run", F.sum("gap").over(w))
    return rows.groupBy("hit", "contig", "source", "run").agg(F.min("s").alias("start"), (F.max("s") + 1).alias("end"), F.count(F.lit(1)).alias("length")).drop("hit", "run")


def recovery(calls: DataFrame, runs: DataFrame, sources: DataFrame, cutoffs: tuple[int, ...] = (0, 500)) -> tuple[DataFrame, DataFrame]:
    """(per source, per cutoff): recovered bases, longest and longest consistent blocks; counts, rates and N50.

    sources: (source, length). Sources and cutoffs without contigs are rows of zeros.
    """
    each = F.explode(F.array(*[F.lit(c) for c in cutoffs]))
    cuts = calls.sparkSession.range(1).select(each.alias("cutoff"))
    kept = calls.withColumnRenamed("source", "call").withColumn("cutoff", each).where("length >= cutoff")
    rows = runs.withColumnRenamed("length", "run").join(kept, "contig")
    key = ["cutoff", "source"]
    agg = rows.groupBy(*key).agg(F.max("run").alias("longest"), F.max(F.when((F.col("status") == "consistent") & (F.col("call") == F.col("source")), F.col("run"))).alias("consistent"))
    every = sources.withColumnRenamed("length", "source_length").withColumn("cutoff", each)
    per = every.join(union_length(rows, key), key, "left").join(agg, key, "left").fillna(0, ["bases", "longest", "consistent"])
    per = per.select(*key, "source_length", F.col("bases").alias("recovered_bp"), (F.col("bases") / F.col("source_length")).alias("recovery"), F.col("longest").alias("longest_aligned_block_bp"), F.col("consistent").alias("longest_consistent_block_bp"))
    counts = kept.groupBy("cutoff").agg(F.count(F.lit(1)).alias("contigs"), F.count_if(F.col("status") == "chimeric").alias("chimeric_contigs"), F.count_if(F.col("status") == "ambiguous").alias("ambiguous_contigs"), F.sum("wrong_connections").alias("wrong_connections"))
    sums = per.groupBy("cutoff").agg((F.sum("recovered_bp") / F.sum("source_length")).alias("genome_recovery"), F.max("longest_aligned_block_bp").alias("longest_aligned_block_bp"), (F.sum(F.least("longest_consistent_block_bp", "source_length")) / F.sum("source_length")).alias("correctly_reconstructed_fraction"))
    whole = cuts.join(counts, "cutoff", "left").join(sums, "cutoff", "left").join(n50(kept, ["cutoff"]).withColumnRenamed("total", "total_contig_bp"), "cutoff", "left").fillna(0)
    return per, whole.withColumn("chimera_rate", F.coalesce(F.try_divide(F.col("chimeric_contigs"), F.col("contigs")), F.lit(0.0)))

