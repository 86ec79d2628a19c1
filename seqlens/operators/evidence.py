"""Pair evidence, decisions, links between masks and annotations, and summaries of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlens.functions.sequence import cigar_blocks, cigar_length
from seqlens.operators.intervals import intersect_intervals, merge_intervals


def pair_support(sam: DataFrame, bounds: DataFrame, margin: int = 1, anchor: int = 20) -> tuple[DataFrame, DataFrame]:
    """(support, fragments): endpoint-deduplicated fragments per template, and each fragment's status.

    sam: fragment, template, flag, pos (0-based), mate_pos, cigar, score. bounds: template, left, right.
    A fragment counts when its best placement spans both anchors by at least anchor aligned bases and no
    other placement scores within margin. A record flagged 512 or 1024 excludes its fragment.
    Templates without support are listed with 0.
    """
    f = F.col("flag")
    bit = lambda n: f.bitwiseAND(F.lit(n)) != 0
    everyone = sam.groupBy("fragment").agg(F.max(bit(512 | 1024)).alias("flagged"))
    use = sam.where(~bit(4 | 8 | 2048) & bit(2) & f.bitwiseAND(F.lit(192)).isin(64, 128)).join(bounds, "template")
    use = use.select("fragment", "template", "left", "right", bit(64).alias("one"), "pos", "mate_pos", "cigar", "score", bit(16).alias("rev"))
    key = ["fragment", "template", "left", "right"]
    side = lambda p, one: use.where(F.col("one") if one else ~F.col("one")).select(*key, *[F.col(c).alias(p + c) for c in ("pos", "mate_pos", "cigar", "score", "rev")])
    pairs = side("a_", True).join(side("b_", False), key).where("a_mate_pos = b_pos AND b_mate_pos = a_pos")
    first = F.col("a_pos") <= F.col("b_pos")
    pick = lambda c, lead: F.when(first, F.col(("a_" if lead else "b_") + c)).otherwise(F.col(("b_" if lead else "a_") + c))
    pairs = pairs.withColumn("lp", pick("pos", True)).withColumn("lc", pick("cigar", True)).withColumn("rp", pick("pos", False)).withColumn("rc", pick("cigar", False))

    def covered(blocks: Column, part) -> Column:
        return F.aggregate(blocks, F.lit(0).cast("long"), lambda s, b: s + F.greatest(F.lit(0), part(b)).cast("long"))

    up = covered(cigar_blocks(F.col("lp"), F.col("lc")), lambda b: F.least(b["end"], F.col("left")) - b["start"])
    down = covered(cigar_blocks(F.col("rp"), F.col("rc")), lambda b: b["end"] - F.greatest(b["start"], F.col("right")))
    ends = F.struct(F.col("lp").alias("start"), (F.col("rp") + cigar_length(F.col("rc"))).alias("end"), F.col("a_rev").alias("rev"))
    placement = F.struct(*[p + c for p in ("a_", "b_") for c in ("pos", "cigar", "rev")])
    scored = pairs.select("fragment", "template", (F.col("a_score") + F.col("b_score")).alias("score"), ends.alias("ends"), ((up >= anchor) & (down >= anchor)).alias("spans"), placement.alias("placement")).distinct()
    order = Window.partitionBy("fragment").orderBy(F.desc("score"), F.desc("template"), F.desc("ends"), F.desc("spans"), F.desc("placement"))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    ranked = ranked.withColumn("who", F.struct("template", "placement")).withColumn("best", F.first("who").over(order)).withColumn("top", F.first("score").over(order))
    rival = ranked.where(F.col("who") != F.col("best")).groupBy("fragment").agg(F.max("score").alias("second"))
    top = ranked.where("rank = 1").join(rival, "fragment", "left")
    status = F.when(F.coalesce(F.col("score") - F.col("second") < margin, F.lit(False)), "ambiguous").when(F.col("spans"), "unique_spanning").otherwise("nonspanning")
    top = top.select("fragment", "template", "ends", status.alias("status"))
    frags = everyone.join(top, "fragment", "left").select("fragment", F.when(F.col("flagged"), "excluded_qc_or_duplicate").otherwise(F.coalesce("status", F.lit("no_valid_pair"))).alias("status"), "template", "ends")
    counted = frags.where("status = 'unique_spanning'").groupBy("template").agg(F.countDistinct("ends").alias("support"))
    return bounds.select("template").distinct().join(counted, "template", "left").select("template", F.coalesce("support", F.lit(0)).cast("long").alias("support")), frags


def decision(current: Column, alternative: Column, minimum: int = 3, fraction: float = 0.9) -> Column:
    """split, retain or unresolved from two counts of fragments."""
    enough = (alternative >= minimum) & (F.coalesce(F.try_divide(alternative, current + alternative), F.lit(0.0)) >= fraction)
    return F.when(enough, "split").when(current >= minimum, "retain").otherwise("unresolved")


def gate(read_decision: Column, methods: Column, policy: str = "annotate", required: tuple[str, ...] = ()) -> Column:
    """A proposal policy can only downgrade a split."""
    if policy == "annotate":
        return read_decision
    need = F.array(*[F.lit(m) for m in required]).cast("array<string>")
    supported = F.size(methods) > 0 if policy == "require_any" else F.size(F.array_except(need, methods)) == 0
    return F.when((read_decision == "split") & ~supported, "unresolved").otherwise(read_decision)


def gated_decisions(candidates: DataFrame, proposals: DataFrame, policy: str = "require_any", required: tuple[str, ...] = (), min_score: float = 0.5, minimum: int = 3, fraction: float = 0.9) -> DataFrame:
    """candidates (contig, cut, current, alternative) with methods of matching proposals, read_decision and decision."""
    # a cut is a point, and a proposal holds both its ends
    p = proposals.where(F.col("score") >= min_score).select("contig", F.col("start").cast("long").alias("start"), (F.col("end") + 1).cast("long").alias("end"), "method")
    cuts = candidates.select("contig", F.col("cut").cast("long").alias("start"), (F.col("cut") + 1).cast("long").alias("end")).distinct()
    near = intersect_intervals(p, cuts, ["contig"]).withColumn("cut", F.col("overlap_start").cast(candidates.schema["cut"].dataType))
    per = near.groupBy("contig", "cut").agg(F.sort_array(F.collect_set("method")).alias("methods"))
    rows = candidates.join(per, ["contig", "cut"], "left").withColumn("methods", F.coalesce("methods", F.array().cast("array<string>")))
    rows = rows.withColumn("read_decision", decision(F.col("current"), F.col("alternative"), minimum, fraction))
    return rows.withColumn("decision", gate(F.col("read_decision"), F.col("methods"), policy, required))


def link_annotations(annotations: DataFrame, mask: DataFrame) -> DataFrame:
    """Annotations (accession, start, end, ...) with each merged mask interval they overlap."""
    return intersect_intervals(annotations, merge_intervals(mask, ["accession"], spread=True), ["accession"])


def linked_bases(links: DataFrame, keys: list[str]) -> DataFrame:
    """Masked bases per keys: overlaps are merged first, so no base counts twice."""
    spans = merge_intervals(links.select(*keys, "overlap_start", "overlap_end"), keys, "overlap_start", "overlap_end", spread=True)
    return spans.groupBy(*keys).agg(F.sum(F.col("overlap_end") - F.col("overlap_start")).cast("long").alias("masked_bases"))


def overlapping_observations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that begin before an earlier row of the same keys ends: joint evidence must be disjoint."""
    w = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__reach", F.max("end").over(w)).where(F.col("start") < F.col("__reach")).drop("__reach")


def joint_bases(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Bases per pair of calls, and whether both are known."""
    out = rows.groupBy(a, b).agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("bases"))
    return out.withColumn("known", (F.col(a) != "unknown") & (F.col(b) != "unknown"))


def project_domains(orfs: DataFrame, hits: DataFrame) -> DataFrame:
    """Amino-acid hits (orf_id, aa_start, aa_end) as nucleotide intervals of their ORF's contig."""
    rows = orfs.join(hits, "orf_id")
    plus = F.col("strand") == "+"
    return rows.withColumn("nt_start", F.when(plus, F.col("start") + 3 * F.col("aa_start")).otherwise(F.col("end") - 3 * F.col("aa_end"))).withColumn("nt_end", F.when(plus, F.col("start") + 3 * F.col("aa_end")).otherwise(F.col("end") - 3 * F.col("aa_start")))


def hit_summary(hits: DataFrame, labels: DataFrame, max_evalue: float = 1e-3, min_cover: float = 0.5, fraction: float = 0.95, close: float = 0.8) -> DataFrame:
    """(query, origin, lineage, family, hallmark, confidence, close) of each query with an accepted hit.

    Hits within fraction of the best bits compete; origin, lineage and family must be unanimous.
    hits: query, target, fident, qcov, tcov, evalue, bits. labels: target, origin, lineage, family, hallmark.
    """
    ok = hits.where((F.col("evalue") <= max_evalue) & (F.least("qcov", "tcov") >= min_cover))
    ok = ok.withColumn("best", F.max("bits").over(Window.partitionBy("query"))).join(labels, "target", "left")
    rival = F.col("bits") >= F.col("best") * fraction
    one = lambda c, none: F.collect_set(F.when(rival, F.coalesce(c, F.lit(none))))
    agg = ok.groupBy("query").agg(
        one("origin", "uncertain").alias("o"), one("lineage", "").alias("l"), one("family", "").alias("f"),
        F.min(F.when(rival, F.lower(F.coalesce("hallmark", F.lit(""))).isin("true", "1", "yes"))).alias("h"), F.min(F.when(rival, F.col("qcov"))).alias("c"),
        F.max((F.col("fident") >= close) & (F.col("qcov") >= 0.8)).alias("close"),
    )
    sole = lambda c: F.when(F.size(c) == 1, F.col(c)[0])
    origin = F.when(sole("o").isin("viral", "cellular"), sole("o")).otherwise("uncertain")
    return agg.select("query", origin.alias("origin"), F.coalesce(sole("l"), F.lit("")).alias("lineage"), F.coalesce(sole("f"), F.lit("")).alias("family"), ((origin == "viral") & F.col("h")).alias("hallmark"), F.when(origin != "uncertain", F.col("c")).otherwise(0.0).alias("confidence"), "close")


def orf_profiles(orfs: DataFrame, sequence: DataFrame, structure: DataFrame) -> DataFrame:
    """ORFs with fused origin and lineage; a related but uncertain source makes the origin uncertain."""
    rows = orfs
    for p, s in (("q_", sequence), ("t_", structure)):
        rows = rows.join(s.select(F.col("query").alias("protein_id"), *[F.col(c).alias(p + c) for c in ("origin", "lineage", "family", "hallmark", "confidence", "close")], F.lit(True).alias(p + "rel")), "protein_id", "left")
    rel = {p: F.coalesce(p + "rel", F.lit(False)) for p in ("q_", "t_")}
    org = {p: F.coalesce(p + "origin", F.lit("uncertain")) for p in ("q_", "t_")}
    doubt = (rel["q_"] & (org["q_"] == "uncertain")) | (rel["t_"] & (org["t_"] == "uncertain"))
    known = {p: org[p] != "uncertain" for p in ("q_", "t_")}
    fused = F.when(doubt, "uncertain").when(known["q_"] & known["t_"] & (org["q_"] != org["t_"]), "uncertain").when(known["q_"], org["q_"]).otherwise(org["t_"])
    lines = F.array_distinct(F.filter(F.array(F.when(known["q_"], F.col("q_lineage")), F.when(known["t_"], F.col("t_lineage"))), lambda x: x.isNotNull() & (x != "")))
    mark = (known["q_"] & F.coalesce("q_hallmark", F.lit(False))) | (known["t_"] & F.coalesce("t_hallmark", F.lit(False)))
    rows = rows.withColumn("origin", fused)
    return rows.select(
        *orfs.columns, "origin", F.when((F.size(lines) == 1) & (F.col("origin") != "uncertain"), lines[0]).otherwise("").alias("lineage"),
        F.coalesce("q_family", F.lit("")).alias("sequence_family"), F.coalesce("t_family", F.lit("")).alias("structure_family"), rel["q_"].alias("sequence_related"), F.coalesce("q_close", F.lit(False)).alias("sequence_close"),
        rel["t_"].alias("structural_related"), (rel["t_"] & ~rel["q_"]).alias("structural_only"), ((F.col("origin") == "viral") & mark).alias("hallmark"),
        F.coalesce(F.least(F.when(known["q_"], F.col("q_confidence")), F.when(known["t_"], F.col("t_confidence"))), F.lit(0.0)).alias("confidence"),
    )


def flank_switches(orfs: DataFrame, key: str, n: int = 2, min_confidence: float = 0.5) -> DataFrame:
    """(contig, start, end, method, score) where n ORFs on either side are unanimous and differ in key."""
    w = Window.partitionBy("contig").orderBy("start", "end", "orf_id")
    left, right = w.rowsBetween(-n, -1), w.rowsBetween(0, n - 1)
    rows = orfs
    for side, over in (("l", left), ("r", right)):
        rows = rows.withColumn(f"{side}_n", F.count(F.lit(1)).over(over)).withColumn(f"{side}_k", F.collect_set(key).over(over)).withColumn(f"{side}_s", F.max("structural_related").over(over)).withColumn(f"{side}_c", F.min("confidence").over(over))
    rows = rows.withColumn("from", F.max("end").over(left)).withColumn("to", F.min("start").over(right))
    a, b = F.col("l_k")[0], F.col("r_k")[0]
    ok = (F.col("l_n") == n) & (F.col("r_n") == n) & (F.size("l_k") == 1) & (F.size("r_k") == 1) & (a != b) & ~a.isin("", "uncertain") & ~b.isin("", "uncertain") & F.col("l_s") & F.col("r_s")
    score = F.least("l_c", "r_c")
    return rows.where(ok & (F.col("from") <= F.col("to")) & (score >= min_confidence)).select("contig", F.col("from").alias("start"), F.col("to").alias("end"), F.lit(f"structural_{key}").alias("method"), score.alias("score"))


def contig_novelty(profiles: DataFrame, min_viral: int = 2) -> DataFrame:
    """Per contig: counts, class, novelty class and priority."""
    n = lambda c: F.count_if(c).alias
    rows = profiles.groupBy("contig").agg(n(F.col("origin") == "viral")("viral_orfs"), n(F.col("origin") == "cellular")("cellular_orfs"), n(F.col("hallmark"))("hallmark_orfs"), n(F.col("sequence_close"))("sequence_close_orfs"), n(F.col("structural_only") & (F.col("origin") == "viral"))("structural_rescue_orfs"))
    kind = F.when((F.col("viral_orfs") >= min_viral) & (F.col("hallmark_orfs") > 0) & (F.col("cellular_orfs") == 0), "viral").when((F.col("cellular_orfs") >= 2) & (F.col("viral_orfs") == 0), "cellular").otherwise("uncertain")
    novel = F.when(F.col("sequence_close_orfs") > 0, "known_sequence").when(F.col("structural_rescue_orfs") > 0, "remote_structure_candidate").when(F.col("viral_orfs") > 0, "sequence_supported").otherwise("unresolved")
    return rows.select("*", kind.alias("classification"), novel.alias("novelty_class"), (F.col("structural_rescue_orfs") + F.col("hallmark_orfs") - F.col("sequence_close_orfs")).alias("priority_score"))


def discovery_cards(profiles: DataFrame, motifs: DataFrame, context: DataFrame, sequence_assessed: bool = False, fold_assessed: bool = False) -> DataFrame:
    """(orf_id, sequence, fold, motif, context, novelty): consensus of each axis and a class; not assessed is not unsupported."""
    def axis(rows: DataFrame, name: str) -> DataFrame:
        s = rows.groupBy("orf_id").agg(F.collect_set("status").alias("s"))
        return s.select("orf_id", F.when(F.size("s") == 1, F.col("s")[0]).otherwise("uncertain").alias(name))

    rows = profiles.join(axis(motifs, "motif"), "orf_id", "left").join(axis(context, "context"), "orf_id", "left").fillna("not_assessed", ["motif", "context"])
    call = lambda c, known: F.when(F.col(c), "supported").otherwise("unsupported" if known else "not_assessed")
    novelty = F.when(F.col("sequence_related"), "sequence_supported").when(F.lit(not sequence_assessed), "insufficient_assessment").when(F.col("structural_related"), "remote_fold_candidate").when(F.lit(not fold_assessed), "insufficient_assessment")
    novelty = novelty.when(F.col("motif") == "supported", "motif_only_candidate").when((F.col("motif") == "unsupported") & (F.col("context") == "supported"), "dark_context_candidate").otherwise("unresolved")
    return rows.select("orf_id", call("sequence_related", sequence_assessed).alias("sequence"), call("structural_related", fold_assessed).alias("fold"), "motif", "context", novelty.alias("novelty"))
