"""Rewrites of contigs along their graph: candidates, templates with competitors, decisions, verification of a whole batch.

Mapping is another program's work. Its records come in twice: reads placed on the candidates' templates and on the
unchanged contigs, then reads placed on the provisional assembly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlens.operators.evidence import pair_support
from seqlens.operators.graph import both_ways, oriented, reconvergences, spell_paths
from seqlens.session import shared_table


def _bare(path: Column) -> Column:
    return F.transform(path, lambda n: F.substring(n, F.lit(1), F.length(n) - 1))


def _simple(path: Column) -> Column:
    """No segment twice on a path, in whatever orientation."""
    return F.size(F.array_distinct(_bare(path))) == F.size(path)


def rewrite_candidates(seqs: DataFrame, paths: DataFrame, segments: DataFrame, links: DataFrame, max_nodes: int = 8, max_paths: int = 32, max_states: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(candidates, skipped): for each branching node of a contig's path the nearest later node with other ways to it.

    candidates: candidate, contig, left, right, original, alternatives. skipped: contigs (contig, reason) without a whole,
    simple path that spells their sequence.
    """
    spelled = spell_paths(paths.where(~F.exists("path", lambda n: n.isNull())), segments, links).select("name", F.col("seq").alias("spelled"))
    rows = seqs.join(paths, "name", "left").join(spelled, "name", "left")
    good = F.coalesce((F.col("spelled") == F.col("seq")) & _simple(F.col("path")), F.lit(False))
    rows = shared_table(rows.select("name", "path", good.alias("good")), "contigpaths")
    whole = rows.where("good").select("name", "path")
    found = reconvergences(whole, links, max_nodes, max_paths, max_states).join(whole.select(F.col("name").alias("contig"), F.col("path").alias("original")), "contig")
    name = F.concat_ws(":", "contig", "left", "right")
    skipped = rows.where("NOT good").select(F.col("name").alias("contig"), F.lit("missing_gapped_cyclic_or_mismatched_path").alias("reason"))
    return found.select(name.alias("candidate"), "contig", "left", "right", "original", "alternatives"), skipped


def rewrite_templates(candidates: DataFrame, seqs: DataFrame, segments: DataFrame, links: DataFrame) -> DataFrame:
    """(candidate, contig, template, index, path, seq, left, right, unchanged, reuses): path_0 is the contig's own path, the others its rewrites.

    left and right are the outer anchors that a fragment must span: the end of the branching node before
    its overlap with the next, and the beginning of the joining node behind its overlap. unchanged: the rewrite spells the
    contig; reuses: it meets a segment twice.
    """
    two = both_ways(links)
    width = F.col("right") - F.col("left") + 1
    ways = F.concat(F.array(F.slice("original", F.col("left") + 1, width)), F.col("alternatives"))
    rows = candidates.select("candidate", "contig", "left", "right", "original", F.posexplode(ways).alias("index", "way"))
    # slices of no length are empty arrays
    path = F.concat(F.slice("original", F.lit(1), F.col("left")), F.col("way"), F.slice("original", F.col("right") + 2, F.greatest(F.size("original") - F.col("right") - 1, F.lit(0))))
    rows = rows.select("candidate", "contig", "index", path.alias("path"), F.col("left").alias("begin"), (F.col("left") + F.size("way") - 1).alias("exit"), F.concat_ws("\t", "candidate", "index").alias("name"))
    rows = shared_table(rows, "rewrites")
    rows = rows.join(spell_paths(rows.select("name", "path"), segments, links), "name").where("seq IS NOT NULL")
    at = lambda column, i: F.element_at(column, i + 1)
    begin, end = F.col("begin"), F.col("exit")
    rows = rows.withColumns({"n0": at("path", begin), "n1": at("path", begin + 1), "m0": at("path", end - 1), "m1": at("path", end)})
    hop = lambda a, b, o: two.select(F.col("src").alias(a), F.col("dst").alias(b), F.col("overlap").alias(o))
    rows = rows.join(oriented(segments).select(F.col("node").alias("n0"), F.length("seq").alias("len0")), "n0").join(hop("n0", "n1", "o0"), ["n0", "n1"]).join(hop("m0", "m1", "o1"), ["m0", "m1"])
    rows = rows.join(seqs.select(F.col("name").alias("contig"), F.col("seq").alias("was")), "contig")
    return rows.select(
        "candidate", "contig", F.concat(F.lit("path_"), "index").alias("template"), "index", "path", "seq", (at("offsets", begin) + F.col("len0") - F.col("o0")).alias("left"), (at("offsets", end) + F.col("o1")).alias("right"),
        (F.col("seq") == F.col("was")).alias("unchanged"), (~_simple(F.col("path"))).alias("reuses"),
    )


def competing_support(placed: DataFrame, background: DataFrame, templates: DataFrame, lengths: DataFrame, margin: int = 1, anchor: int = 20) -> DataFrame:
    """(candidate, template, support) of fragments that span both anchors of a template and have no rival nearby.

    placed: candidate and the columns of pair_support, of reads on the candidates' templates. background: contig instead, of
    reads on the unchanged contigs. lengths: (contig, length). The placements of a candidate's fragments on other contigs compete
    with those on its templates, but support nothing. They are met by fragment, so no candidate is paired with all contigs.
    """
    columns = ["flag", "pos", "mate_pos", "cigar", "score"]
    own = templates.select("candidate", "contig").distinct()
    mine = placed.select(F.struct("candidate", "fragment").alias("fragment"), F.struct("candidate", "template").alias("template"), *columns)
    rival = placed.select("candidate", "fragment").distinct().join(own.withColumnRenamed("contig", "own"), "candidate")
    rival = rival.join(background.select("fragment", "contig", *columns), "fragment").where("contig <> own")
    rival = rival.select(F.struct("candidate", "fragment").alias("fragment"), F.struct("candidate", F.concat(F.lit("background_"), "contig").alias("template")).alias("template"), "contig", *columns)
    rival = shared_table(rival, "rivals")
    ends = rival.select("template", "contig").distinct().join(lengths, "contig").select("template", F.lit(0).alias("left"), F.col("length").cast("int").alias("right"))
    bounds = templates.select(F.struct("candidate", "template").alias("template"), F.col("left").cast("int").alias("left"), F.col("right").cast("int").alias("right")).unionByName(ends)
    support, _ = pair_support(mine.unionByName(rival.drop("contig")), bounds, margin, anchor)
    return support.where(F.col("template.template").startswith("path_")).select("template.candidate", "template.template", "support")


def rewrite_decisions(templates: DataFrame, support: DataFrame, minimum: int = 3, fraction: float = 0.9, max_fragment: int = 600, apply: bool = True) -> DataFrame:
    """(candidate, contig, decision, reason, template, support): one row a candidate.

    A rewrite is proposed if it alone has most support, at least minimum fragments and fraction of its
    candidate's; not if the templates' anchors lie further apart than a fragment reaches, if it changes nothing, or if it meets a
    segment twice. A contig with several proposals gets none. With apply, proposals are to be reconstructed.
    """
    rows = templates.select("candidate", "contig", "template", "index", "left", "right", "unchanged", "reuses").join(support.select("candidate", "template", "support"), ["candidate", "template"], "left").fillna(0, ["support"])
    best = F.struct("support", "index", "template", "unchanged", "reuses")
    per = rows.groupBy("candidate", "contig").agg(
        F.max(F.when(F.col("index") > 0, best)).alias("best"), F.sum("support").alias("total"), F.max(F.col("right") - F.col("left") + 40).alias("span"),
        F.sort_array(F.collect_list(F.when(F.col("index") > 0, F.col("support"))), False).alias("counts"),
    )
    alone = (F.size("counts") == 1) | (F.get("counts", F.lit(0)) > F.get("counts", F.lit(1)))
    enough = F.coalesce(alone & (F.col("best.support") >= minimum) & (F.col("best.support") >= F.col("total") * fraction), F.lit(False))
    reason = F.when(F.col("span") > max_fragment, "region_exceeds_fragment_span").when(~enough, "insufficient_unique_alternative_support").when(F.col("best.unchanged"), "sequence_unchanged").when(F.col("best.reuses"), "replacement_reuses_external_path_nodes")
    rows = per.select("candidate", "contig", "best.template", F.coalesce("best.support", F.lit(0)).cast("long").alias("support"), reason.alias("reason"))
    many = rows.where("reason IS NULL").groupBy("contig").agg(F.count(F.lit(1)).alias("proposals"))
    rows = rows.join(many, "contig", "left")
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("proposals") > 1, "multiple_rewrites_require_joint_validation").otherwise("spanning_fragment_support")
    taken = F.col("reason").isNull() & (F.col("proposals") == 1)
    return rows.select("candidate", "contig", F.when(taken, "reconstruct" if apply else "proposed").otherwise("unresolved").alias("decision"), reason.alias("reason"), "template", "support")


def provisional(seqs: DataFrame, decisions: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assembly, bounds): contigs with their accepted rewrites, and what a fragment must span of each: the rewrite's anchors, or the whole contig."""
    taken = decisions.where("decision = 'reconstruct'").select("candidate", "template").join(templates, ["candidate", "template"]).select(F.col("contig").alias("name"), F.col("seq").alias("new"), "left", "right")
    rows = seqs.join(taken, "name", "left").select("name", F.coalesce("new", "seq").alias("seq"), "left", "right")
    bounds = rows.select(F.col("name").alias("template"), F.coalesce("left", F.lit(0)).cast("int").alias("left"), F.coalesce("right", F.length("seq")).cast("int").alias("right"))
    return rows.select("name", "seq"), bounds


def verify_batch(decisions: DataFrame, verified: DataFrame, minimum: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """decisions with verification_support: all rewrites of a batch stand, or none.

    verified: (template, support) of reads on the provisional assembly, templates named by contig. If a single rewritten contig keeps
    fewer than minimum fragments, the whole batch is withdrawn, since taking back one could bring a competitor of
    another back. by names the columns of decisions that tell batches apart; without them all is one batch.
    """
    rows = decisions.join(verified.select(F.col("template").alias("contig"), F.col("support").alias("verification_support")), "contig", "left")
    mine = F.col("decision") == "reconstruct"
    rows = rows.withColumn("verification_support", F.when(mine, F.coalesce("verification_support", F.lit(0))))
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    rows = shared_table(rows.withColumn("__batch", key), "verified")
    # one row a batch that fails; a batch's rows never meet
    failed = rows.where(mine & (F.col("verification_support") < minimum)).select("__batch").distinct().withColumn("__failed", F.lit(True))
    rows = rows.join(failed, "__batch", "left")
    lost = mine & F.coalesce("__failed", F.lit(False))
    reason = F.when(lost, "batch_remapping_failed").when(mine, "spanning_support_and_batch_remapping").otherwise(F.col("reason"))
    return rows.select(*[c for c in decisions.columns if c not in ("decision", "reason")], F.when(lost, "unresolved").otherwise(F.col("decision")).alias("decision"), reason.alias("reason"), "verification_support")


def reconstructed(seqs: DataFrame, paths: DataFrame, verified: DataFrame, candidates: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assembly, paths): contigs after the verified rewrites, and paths (name, path, original, left, right) for graph.coordinate_map; left and right are null for kept contigs."""
    taken = verified.where("decision = 'reconstruct'").select("candidate", "template")
    taken = taken.join(templates.select("candidate", "template", "contig", "path", "seq"), ["candidate", "template"]).join(candidates.select("candidate", "left", "right"), "candidate")
    taken = taken.select(F.col("contig").alias("name"), F.col("path").alias("new_path"), F.col("seq").alias("new"), "left", "right")
    assembly = seqs.join(taken.select("name", "new"), "name", "left").select("name", F.coalesce("new", "seq").alias("seq"))
    ways = paths.join(taken.drop("new"), "name", "left").select("name", F.coalesce("new_path", "path").alias("path"), F.col("path").alias("original"), "left", "right")
    return assembly, ways
