"""Classification of the same queries under several masks of the reference, and paired comparisons with the unmasked arm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.functions.sequence import kmer_table
from seqlens.operators.design import paired_bootstrap
from seqlens.operators.guards import ensure, once_each
from seqlens.operators.intervals import intersect_intervals, merge_intervals
from seqlens.operators.sharing import asked_codes, candidates, predictions
from seqlens.session import shared_table

UNMASKED, MOST_ARMS = "unmasked", 200
SHARES = ("correct", "wrong", "ambiguous", "unclassified")


def arm_hits(queries: DataFrame, reference: DataFrame, masks: DataFrame, arms: list[str], k: int = 31) -> DataFrame:
    """(arm, query, target, score): distinct words of a query that a target holds outside an arm's mask.

    masks: (arm, accession, start, end). One word table and one join serve all arms: only words that queries hold are kept, each
    with its places; a word is lost in an arm when a mask touches all its places in the target. Arms differ by what
    they lose, so an arm costs its losses, not another classification.
    """
    asked = shared_table(kmer_table(queries, k).select(F.col("name").alias("query"), "code"), "asked")
    spots = kmer_table(reference, k, positions=True, among=asked_codes(asked)).select(F.col("name").alias("target"), "pos", "code", "times")
    spots = shared_table(spots.join(asked.select("code").distinct(), "code", "left_semi"), "askedspots")
    held = shared_table(asked.join(spots.select("target", "code").distinct(), "code"), "askedwords")
    full = held.groupBy("query", "target").agg(F.count(F.lit(1)).alias("words"))
    # the join looks at the masks several times
    merged = shared_table(merge_intervals(masks.select("arm", "accession", "start", "end"), ["arm", "accession"]).withColumnRenamed("accession", "target"), "armmasks")
    places = spots.select("target", "code", "times", F.col("pos").alias("start"), (F.col("pos") + k).alias("end"))
    # mask intervals carry their arm through the join; a place is touched once however many of them it meets
    met = intersect_intervals(places, merged.select("target", "arm", "start", "end"), ["target"], carry=["arm"])
    dead = met.select("arm", "target", "code", "times", "start").distinct()
    gone = dead.groupBy("arm", "target", "code").agg(F.count(F.lit(1)).alias("n"), F.max("times").alias("times")).where("n = times").select("arm", "target", "code")
    lost = gone.join(held, ["target", "code"]).groupBy("arm", "query", "target").agg(F.count(F.lit(1)).alias("lost"))
    every = full.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    rows = every.join(lost, ["arm", "query", "target"], "left")
    return rows.select("arm", "query", "target", (F.col("words") - F.coalesce("lost", F.lit(0))).cast("double").alias("score")).where("score > 0")


def arm_predictions(queries: DataFrame, hits: DataFrame, taxonomy: DataFrame, arms: list[str], min_score: float = 1, fraction: float = 1) -> DataFrame:
    """(arm, query, status, taxon, candidate_taxa, unknown_taxonomy) of every query in every arm."""
    named = lambda df, name: df.withColumn("query", F.struct("arm", F.col(name).alias("query")))
    asked = named(queries.select("name").withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms]))), "name").select(F.col("query").alias("name"))
    chosen = candidates(named(hits, "query").select("query", "target", "score"), min_score, fraction)
    return predictions(asked, chosen, taxonomy).select("query.arm", "query.query", "status", "taxon", "candidate_taxa", "unknown_taxonomy")


def arm_units(predicted: DataFrame, truth: DataFrame, arms: list[str]) -> DataFrame:
    """(arm, unit, total, correct, wrong, ambiguous, unclassified, precision): shares of all queries of a unit, and of an arm where unit is null.

    truth: (query, taxon, unit). Each arm must have each query of the truth exactly once, and the truth needs a taxon and a unit; a
    row that breaks this fails the job that reads it.
    """
    known = ensure(truth, (F.coalesce("taxon", F.lit("")) != "") & (F.coalesce("unit", F.lit("")) != ""), F.concat(F.lit("truth without a taxon or unit: "), F.coalesce(F.col("query").cast("string"), F.lit("null"))))
    want = known.select("query", F.col("taxon").alias("truth"), "unit").withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    rows = once_each(want, predicted, ["arm", "query"], "prediction").join(predicted.select("arm", "query", "status", "taxon"), ["arm", "query"])
    given = F.col("status") == "assigned"
    right = given & (F.col("taxon") == F.col("truth"))
    counts = [F.count_if(c).alias(n) for n, c in zip(SHARES, (right, given & ~F.coalesce(right, F.lit(False)), F.col("status") == "ambiguous", F.col("status") == "unclassified"), strict=True)]
    per = rows.groupBy("arm", "unit").agg(F.count(F.lit(1)).alias("total"), *counts)
    whole = per.groupBy("arm").agg(*[F.sum(c).alias(c) for c in ("total", *SHARES)]).withColumn("unit", F.lit(None).cast("string"))
    both = per.unionByName(whole)
    precision = F.try_divide(F.col("correct"), F.col("correct") + F.col("wrong"))
    return both.select("arm", "unit", "total", *[(F.col(c) / F.col("total")).alias(c) for c in SHARES], precision.alias("precision"))


def evaluate_masks(queries: DataFrame, reference: DataFrame, taxonomy: DataFrame, truth: DataFrame, masks: DataFrame, k: int = 31, min_score: float = 1, fraction: float = 1) -> DataFrame:
    """arm_units of the unmasked reference and of every arm of masks (arm, accession, start, end)."""
    masks = shared_table(masks.select("arm", "accession", "start", "end"), "masks")
    names = sorted(r.arm for r in masks.select("arm").distinct().limit(MOST_ARMS + 1).collect())
    if len(names) > MOST_ARMS or UNMASKED in names:
        raise ValueError("too many arms, or a mask named unmasked")
    arms = [UNMASKED, *names]
    hits = arm_hits(queries, reference, masks, arms, k)
    return arm_units(shared_table(arm_predictions(queries, hits, taxonomy, arms, min_score, fraction), "armpredictions"), truth, arms)


def compare_arms(units: DataFrame, seed: int = 17, replicates: int = 2000) -> DataFrame:
    """(arm, effect, units, mean, lower, upper): paired over units, an arm against the unmasked one.

    wrong_reduction, correct_change and unclassified_change; a positive value means more of what it names.
    """
    per = units.where("unit IS NOT NULL")
    base = per.where(F.col("arm") == UNMASKED).select("unit", *[F.col(c).alias(f"b_{c}") for c in SHARES])
    rows = per.where(F.col("arm") != UNMASKED).join(base, "unit")
    effects = {"wrong_reduction": F.col("b_wrong") - F.col("wrong"), "correct_change": F.col("correct") - F.col("b_correct"), "unclassified_change": F.col("unclassified") - F.col("b_unclassified")}
    long = rows.select("arm", "unit", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in effects.items()])).alias("e"))
    got = paired_bootstrap(long.select(F.concat_ws("\t", "arm", "e.name").alias("key"), "unit", F.col("e.value").alias("d")), "key", "unit", "d", seed, replicates)
    part = F.split("key", "\t")
    return got.select(part[0].alias("arm"), part[1].alias("effect"), "units", "mean", "lower", "upper")
