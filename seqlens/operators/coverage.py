"""Depth, coverage profiles and change proposals; long format throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlens.functions.sequence import cigar_blocks
from seqlens.operators.guards import ensure, within
from seqlens.operators.intervals import merge_intervals, overlaps
from seqlens.session import shared_table


def _merged(blocks: Column) -> Column:
    """An array of blocks sorted, those that touch as one."""
    def step(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        one = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(one))
        return F.when((F.size(out) > 0) & (x["start"] <= F.try_element_at(out, F.lit(-1))["end"]), joined).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(blocks), F.array().cast("array<struct<start:int,end:int>>"), step)


def placed_fragments(sam: DataFrame, min_mapq: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """(by..., qname, reason, placed): fragment_calls, and of a valid, unique pair the blocks of each contig, merged as in fragment_blocks.

    placed is an array of (contig, blocks), null for other fragments. Records travel once, by fragment, and without what only the
    calls of single records need; all else happens where a fragment's records lie.
    """
    f = F.col("flag")
    bit = lambda n: f.bitwiseAND(F.lit(n)) != 0
    good = bit(2) & ~bit(4 | 8 | 512 | 1024) & (F.col("mapq") >= min_mapq) & (F.col("mapq") < 255)
    tie = F.col("other").isNotNull() & ~F.coalesce(F.col("other") < F.col("score"), F.lit(False))
    rows = sam.select(*by, "qname", "flag", "rname", "pos", "cigar", "score", good.alias("good"), tie.alias("tie")).repartition(*by, "qname")
    rows = rows.withColumn("mate", f.bitwiseAND(F.lit(192))).withColumn("primary", ~bit(256 | 2048))
    own = Window.partitionBy(*by, "qname", "mate")
    place = F.struct("rname", "pos", "cigar", bit(16).alias("r"))
    rows = rows.withColumn("p_place", F.max(F.when(F.col("primary"), place)).over(own)).withColumn("p_score", F.max(F.when(F.col("primary"), F.col("score"))).over(own)).withColumn("has", F.max("primary").over(own))
    rival = ~bit(4) & (bit(2048) | bit(256) & (~F.col("has") | (place != F.col("p_place")) & ~F.coalesce(F.col("score") < F.col("p_score"), F.lit(False))))
    first = lambda c: F.when(F.col("primary"), c)
    spot = first(F.struct("rname", "pos", "cigar"))
    # a valid pair has two primary records, so the least and the greatest are both of them
    per = rows.groupBy(*by, "qname").agg(
        F.count_if("primary").alias("n"), F.count_if(F.col("primary") & F.col("good")).alias("good"), F.count_if(F.col("primary") & F.col("tie")).alias("ties"), F.min(first(F.col("rname"))).alias("c0"), F.max(first(F.col("rname"))).alias("c1"),
        F.min(first(F.col("mate"))).alias("m0"), F.max(first(F.col("mate"))).alias("m1"), F.max(rival).alias("rival"), F.min(spot).alias("a"), F.max(spot).alias("b"),
    )
    pair = F.coalesce(F.col("c0") == F.col("c1"), F.lit(False)) & (F.col("m0") == 64) & (F.col("m1") == 128)
    reason = F.when(F.col("n") != 2, "not_two_primaries").when(F.col("good") < 2, "filtered_record").when(~pair, "not_a_pair")
    reason = reason.when(F.col("ties") > 0, "tied_score").when(F.col("rival"), "competing_placement")
    a, b = (F.coalesce(cigar_blocks(F.col(f"{x}.pos") - 1, F.col(f"{x}.cigar")), F.array().cast("array<struct<start:int,end:int>>")) for x in "ab")
    on = lambda c, blocks: F.struct(F.col(c).alias("contig"), _merged(blocks).alias("blocks"))
    placed = F.when(F.col("a.rname").eqNullSafe(F.col("b.rname")), F.array(on("a.rname", F.concat(a, b)))).otherwise(F.array(on("a.rname", a), on("b.rname", b)))
    return per.select(*by, "qname", reason.alias("reason"), "a", "b").select(*by, "qname", "reason", F.when(F.col("reason").isNull(), placed).alias("placed"))


def placed_blocks(fragments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., contig, start, end): a row for each block of placed_fragments."""
    each = fragments.where("reason IS NULL").select(*keys, F.explode("placed").alias("p"))
    return each.select(*keys, "p.contig", F.explode("p.blocks").alias("b")).select(*keys, "contig", "b.*")


def fragment_calls(sam: DataFrame, min_mapq: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """(by..., qname, reason): what keeps each fragment from being a valid, unique pair; null if nothing does.

    sam: qname, flag, rname, pos (1-based), mapq, cigar, score (AS), other (XS), both null if absent.
    Any supplementary placement rejects a fragment; a secondary one does unless it is at the
    same place or scores lower than the same mate's primary.
    """
    return placed_fragments(sam, min_mapq, by).select(*by, "qname", "reason")


def accepted_pairs(sam: DataFrame, min_mapq: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Primary records of fragments that are valid, unique pairs (see fragment_calls)."""
    valid = fragment_calls(sam, min_mapq, by).where("reason IS NULL").select(*by, "qname")
    return sam.where(F.col("flag").bitwiseAND(F.lit(256 | 2048)) == 0).join(valid, [*by, "qname"], "left_semi")


def fragment_blocks(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., qname, contig, start, end): aligned blocks of both mates, merged, so overlapping mates count once."""
    blocks = pairs.select(*by, "qname", F.col("rname").alias("contig"), F.explode(cigar_blocks(F.col("pos") - 1, F.col("cigar"))).alias("b")).select(*by, "qname", "contig", "b.*")
    return merge_intervals(blocks, [*by, "qname", "contig"])


def window_bases(windows: DataFrame, blocks: DataFrame, by: Sequence[str] = (), bin_size: int = 1000) -> DataFrame:
    """(by..., window_id, bases): overlapped bases of the windows (window_id, contig, start, end) that blocks reach.

    Both sides are cut into coordinate bins, so the join is on (contig, bin), however long the contig.
    """
    def bins(a: str, b: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(a) / bin_size), F.floor((F.col(b) - 1) / bin_size)))

    w = windows.select("window_id", "contig", F.col("start").alias("ws"), F.col("end").alias("we")).withColumn("bin", bins("ws", "we"))
    b = blocks.select(*by, "contig", F.col("start").alias("bs"), F.col("end").alias("be")).withColumn("bin", bins("bs", "be"))
    lo, hi = F.greatest("ws", "bs", F.col("bin") * bin_size), F.least("we", "be", (F.col("bin") + 1) * bin_size)
    met = w.join(b, ["contig", "bin"]).where(overlaps(F.col("ws"), F.col("we"), F.col("bs"), F.col("be")))
    return met.groupBy(*by, "window_id").agg(F.sum(F.greatest(hi - lo, F.lit(0))).cast("long").alias("bases"))


def window_depth(windows: DataFrame, blocks: DataFrame, bin_size: int = 1000) -> DataFrame:
    """windows (window_id, contig, start, end) with depth: overlapped bases over width."""
    got = window_bases(windows, blocks, (), bin_size)
    return windows.join(got, "window_id", "left").withColumn("depth", F.coalesce("bases", F.lit(0)) / (F.col("end") - F.col("start"))).drop("bases")


def target_digest(targets: DataFrame) -> DataFrame:
    """One row, digest: a checksum of the set of targets (name, seq) that doesn't depend on their order."""
    h = F.xxhash64("name", "seq")
    return targets.agg(F.concat_ws(":", F.count(F.lit(1)), F.hex(F.bit_xor(h)), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).alias("digest"))


def library_coverage(sam: DataFrame, targets: DataFrame, libraries: DataFrame, windows: DataFrame, min_mapq: int = 20, max_libraries: int = 10_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(coverage, libraries, exclusions) of alignments of several libraries against common targets.

    sam: sample and the columns of fragment_calls; targets: (contig, length); libraries: (sample, biological_sample). coverage
    has a row for each library and window, without bases too: depth, and normalized, the depth per million aligned bases of its
    library. libraries gain accepted_fragments, excluded_fragments and aligned_bases; exclusions count the excluded
    fragments by reason. A repeated library is an error at once; a record of an unknown library and a block outside its
    target fail the job that reads them, so guards cost no jobs of their own.
    """
    names = [r.sample for r in libraries.select("sample").limit(max_libraries + 1).collect()]
    if len(names) > max_libraries or len(set(names)) != len(names) or None in names:
        raise ValueError("repeated, unnamed or too many libraries")
    sam = ensure(sam, F.col("sample").isin(*names), F.concat(F.lit("unknown library "), F.coalesce("sample", F.lit("null"))))
    calls = shared_table(placed_fragments(sam, min_mapq, ["sample"]).drop("qname"), "fragmentcalls")
    blocks = shared_table(within(placed_blocks(calls, ["sample"]), targets, "contig", "length"), "fragmentblocks")
    bases = blocks.groupBy("sample").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("aligned_bases"))
    counts = calls.groupBy("sample").agg(F.count_if(F.col("reason").isNull()).alias("accepted_fragments"), F.count_if(F.col("reason").isNotNull()).alias("excluded_fragments"))
    told = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("accepted_fragments", "excluded_fragments", "aligned_bases")]
    stats = libraries.select("sample", "biological_sample").join(counts, "sample", "left").join(bases, "sample", "left").select("sample", "biological_sample", *told)
    every = windows.withColumn("sample", F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")))
    met = every.join(window_bases(windows, blocks, ["sample"]), ["sample", "window_id"], "left")
    # one row a library, at most max_libraries
    met = met.join(F.broadcast(stats.select("sample", "aligned_bases")), "sample").withColumn("depth", F.coalesce("bases", F.lit(0)) / (F.col("end") - F.col("start")))
    normalized = F.coalesce(F.try_divide(F.col("depth") * 1e6, F.col("aligned_bases")), F.lit(0.0))
    exclusions = calls.where("reason IS NOT NULL").groupBy("sample", "reason").agg(F.count(F.lit(1)).alias("fragments"))
    return met.select("sample", "window_id", "contig", "start", "end", "depth", normalized.alias("normalized")), stats, exclusions


def normalize(values: DataFrame, key: str = "sample", value: str = "value") -> DataFrame:
    """value per million of its sample's total; 0 for an empty sample."""
    total = values.groupBy(key).agg(F.sum(value).alias("__total"))
    return values.join(total, key).withColumn("normalized", F.coalesce(F.try_divide(F.col(value) * 1e6, F.col("__total")), F.lit(0.0))).drop("__total")


def replicate_mean(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean over the technical replicates of a biological sample; a window a library lacks is 0."""
    libraries = values.select("biological_sample", "sample").distinct().groupBy("biological_sample").agg(F.count(F.lit(1)).alias("__n"))
    total = values.groupBy(*keys, "biological_sample").agg(F.sum(value).alias("__v"))
    return total.join(F.broadcast(libraries), "biological_sample").select(*keys, "biological_sample", (F.col("__v") / F.col("__n")).alias("mean"))


def cosine_pairs(left: DataFrame, right: DataFrame, on: list[str], axis: str, pairs: DataFrame | None = None) -> DataFrame:
    """on columns and cosine of two long vectors (axis, x) and (axis, y) with the same on; null when one is zero."""
    both = left.select(*on, axis, F.col("value").alias("x")).join(right.select(*on, axis, F.col("value").alias("y")), [*on, axis], "full")
    agg = both.groupBy(*on).agg(F.sum(F.coalesce(F.col("x") * F.col("y"), F.lit(0.0))).alias("xy"), F.sum(F.coalesce(F.col("x") * F.col("x"), F.lit(0.0))).alias("xx"), F.sum(F.coalesce(F.col("y") * F.col("y"), F.lit(0.0))).alias("yy"))
    norm = F.sqrt(F.col("xx") * F.col("yy"))
    return agg.select(*on, F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("xy") / norm))).alias("cosine"))


def change_proposals(profiles: DataFrame, axis: str, change: float = 0.5, method: str = "coverage") -> DataFrame:
    """(contig, start, end, method, score) where neighbouring windows differ: 1 - cosine of at least change.

    profiles: (contig, start, end, axis, value). Windows with a gap between them are no neighbours; a
    zero profile gives no proposal.
    """
    w = Window.partitionBy("contig").orderBy("start")
    places = profiles.select("contig", "start", "end").distinct().withColumn("next", F.lead("start").over(w)).withColumn("next_end", F.lead("end").over(w))
    places = places.where(F.col("next") <= F.col("end"))
    key = ["contig", "start"]
    left = profiles.select("contig", "start", axis, "value").join(places.select(*key), key)
    right = profiles.select(F.col("contig"), F.col("start").alias("next"), axis, "value").join(places.select("contig", "next", F.col("start").alias("from")), ["contig", "next"]).select("contig", F.col("from").alias("start"), axis, "value")
    got = cosine_pairs(left, right, key, axis).where((F.lit(1.0) - F.col("cosine")) >= change)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("cosine")))
    return got.join(places, key).select("contig", "start", F.greatest("end", "next_end").alias("end"), F.lit(method).alias("method"), score.alias("score"))
