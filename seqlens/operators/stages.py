"""Stages composed of operators: correction, reconstruction, experiment designs, reports, snapshots."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlens.operators import evidence as E
from seqlens.operators import intervals as I
from seqlens.operators.guards import ensure, within
from seqlens.session import shared_table
from seqlens.sources.readers import refuse, unique


def correction(candidates: DataFrame, support: DataFrame, proposals: DataFrame, seqs: DataFrame, policy: str = "annotate", required: tuple[str, ...] = (), minimum: int = 3, fraction: float = 0.9, templates: DataFrame | None = None, max_fragment: int = 600) -> tuple[DataFrame, DataFrame]:
    """(evidence, parts): each candidate's decision with its reason, and contigs split at accepted cuts.

    candidates: candidate, contig, cut, alternatives (array of the candidate's own). support: candidate, template,
    support; path_0 is the contig's own path and path_1 to path_n its n alternatives, of which one alone must reach
    the minimum; higher numbers are entrances, which compete for reads but never count. With templates
    (graph.local_templates) a candidate without any has too many paths, and one whose anchors lie further apart
    than a fragment reaches is refused; both stay unresolved, without support. A null array has no alternative.
    """
    index = F.regexp_extract("template", r"^path_(\d+)$", 1).try_cast("int")
    rows = candidates.withColumn("n_alternatives", F.greatest(F.size("alternatives"), F.lit(0)))
    counts = support.select("candidate", index.alias("index"), "support").join(rows.select("candidate", "n_alternatives"), "candidate").groupBy("candidate").agg(
        F.max(F.when(F.col("index") == 0, F.col("support"))).alias("current"), F.max(F.when(F.col("index").between(1, F.col("n_alternatives")), F.col("support"))).alias("alternative")
    )
    rows = rows.join(counts, "candidate", "left").fillna(0, ["current", "alternative"])
    refused = F.lit(None).cast("string")
    if templates is not None:
        spans = templates.groupBy("candidate").agg(F.max(F.when(F.col("template") == "path_0", F.col("right") - F.col("left") + 40)).alias("span"))
        rows = rows.join(spans.withColumn("listed", F.lit(True)), "candidate", "left")
        refused = F.when(F.col("listed").isNull(), "too_many_competing_paths").when(F.col("span") > max_fragment, "repeat_exceeds_fragment_span")
    rows = rows.withColumn("refused", refused)
    for c in ("current", "alternative"):
        rows = rows.withColumn(c, F.when(F.col("refused").isNull(), F.col(c)).otherwise(0))
    rows = E.gated_decisions(rows, proposals, policy, required, minimum=minimum, fraction=fraction)
    told = F.when(F.col("decision") == "split", "alternative_fragment_support").when(F.col("decision") == "retain", "current_support").when(F.col("read_decision") == "split", "proposal_gate_not_met").otherwise("insufficient_discriminating_evidence")
    rows = rows.withColumn("reason", F.coalesce("refused", told)).drop("n_alternatives", "refused", "span", "listed")
    return rows, I.split_at_cuts(seqs, rows.where("decision = 'split'").select(F.col("contig").alias("name"), "cut"))


def proposals(tables: list[DataFrame], seqs: DataFrame) -> DataFrame:
    """The proposals of several tables (contig, start, end, method, score, ...), cuts from start to end inclusive.

    A proposal needs a contig of seqs that holds it, a method and a score from 0 to 1; one without fails the job that reads it.
    """
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    good = (F.coalesce("method", F.lit("")) != "") & (F.col("score") >= 0) & (F.col("score") <= 1)
    rows = ensure(rows, good, F.concat(F.lit("invalid proposal: "), F.to_json(F.struct("contig", "start", "end", "method", "score"))))
    return within(rows, seqs.select(F.col("name").alias("contig"), F.length("seq").alias("length")), "contig", "length")


def proposal_audit(evidence: DataFrame, proposals: DataFrame) -> DataFrame:
    """One row (proposals, matched, unmatched): proposals that hold the cut of a candidate of their contig, and others."""
    p = proposals.select(F.col("contig").alias("pc"), "start", "end")
    cuts = evidence.select("contig", "cut").distinct()
    hit = p.join(cuts, (F.col("pc") == F.col("contig")) & F.col("cut").between(F.col("start"), F.col("end")), "left_semi")
    total, found = p.agg(F.count(F.lit(1)).alias("proposals")), hit.agg(F.count(F.lit(1)).alias("matched"))
    return total.crossJoin(found).withColumn("unmatched", F.col("proposals") - F.col("matched"))


def replacements(support: DataFrame, minimum: int = 3, fraction: float = 0.9) -> DataFrame:
    """(candidate, template, support, decision) of candidates (candidate, contig, template, index, support).

    The winner needs a unique maximum, minimum fragments and fraction of all templates' support,
    backgrounds included; a contig with more than one replacement gets none.
    """
    per = support.groupBy("candidate", "contig").agg(F.max(F.struct("support", "index", "template")).alias("top"), F.sum("support").alias("total"))
    best = support.join(per, ["candidate", "contig"]).groupBy("candidate", "contig", "top", "total").agg(F.count_if(F.col("support") == F.col("top.support")).alias("ties"))
    wins = (F.col("ties") == 1) & (F.col("top.support") >= minimum) & (F.col("top.support") >= F.col("total") * fraction) & F.col("top.template").rlike("^path_[1-9]")
    rows = best.select("candidate", "contig", F.col("top.template").alias("template"), F.col("top.support").alias("support"), F.when(wins, "replace").otherwise("retain").alias("decision"))
    many = rows.where("decision = 'replace'").groupBy("contig").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("contig").withColumn("withheld", F.lit(True))
    return rows.join(many, "contig", "left").withColumn("decision", F.when(F.col("withheld") & (F.col("decision") == "replace"), "withheld").otherwise(F.col("decision"))).drop("withheld")


def experiments(spark: SparkSession, pairs: DataFrame, coverages: list[float], ratios: list[float], seeds: list[int], kinds: tuple[str, ...] = ("a", "b", "mixed")) -> DataFrame:
    """All combinations of genome pairs and settings; the settings are lists of the caller, so they are broadcast."""
    out = pairs
    for name, values, kind in (("coverage", coverages, "double"), ("ratio", ratios, "double"), ("seed", seeds, "int"), ("sample_type", list(kinds), "string")):
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v).cast(kind) for v in values])))
    return out


def abundances(sources: list[str], samples: int, mode: str = "independent", base: float = 10.0, sigma: float = 1.0, seed: int = 17) -> list[tuple[str, str, float]]:
    """(biological_sample, accession, coverage): log-normal around base.

    A sample draws one shared number, then one for each source, whatever the mode uses of them; in sparse mode
    every third source of a sample, shifted by the sample's number, is absent.
    """
    if mode not in ("independent", "correlated", "constant", "sparse"):
        raise ValueError("unknown abundance mode")
    rng, out = random.Random(seed), []
    for sample in range(samples):
        shared = rng.gauss(0, sigma)
        for place, source in enumerate(sources):
            own = rng.gauss(0, sigma)
            power = {"constant": 0.0, "correlated": shared}.get(mode, own)
            absent = mode == "sparse" and (place + sample) % 3 == 0
            out.append((f"b{sample}", source, 0.0 if absent else base * math.exp(power)))
    return out


def ablation(variant: str) -> tuple[str, tuple[str, ...]]:
    """Proposal policy and required methods of a variant of the correction."""
    if variant not in ("baseline", "simple", "nmf", "structure", "combined", "multiview"):
        raise ValueError("unknown variant")
    if variant == "combined":
        return "require_all", ("nmf", "structural_lineage")
    return ("annotate" if variant == "baseline" else "require_any"), ()


def random_cuts(cuts: DataFrame, seqs: DataFrame, seed: int = 20260905) -> DataFrame:
    """(contig, cut): as many distinct inner cuts of each contig as cuts (contig, cut) has, at random places.

    One stream of random numbers runs over the contigs in order of ord: a control for one assembly.
    """
    import pandas as pd

    rows = cuts.groupBy("contig").agg(F.countDistinct("cut").alias("n")).join(seqs.select(F.col("name").alias("contig"), "ord", F.length("seq").alias("length")), "contig")

    def draw(g: pd.DataFrame) -> pd.DataFrame:
        rng = random.Random(seed)
        found = [(r.contig, c) for r in g.sort_values("ord").itertuples() for c in rng.sample(range(1, int(r.length)), int(r.n))]
        return pd.DataFrame(found, columns=["contig", "cut"])

    return rows.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(draw, "contig string, cut long")


def read_origins(reads: DataFrame, lengths: DataFrame) -> DataFrame:
    """(read_id, accession, start, strand, wraps_origin) of simulated reads (read_id, accession, pos, strand, read_length) on circular sources."""
    rows = reads.join(lengths.select(F.col("name").alias("accession"), "length"), "accession")
    start = F.col("pos") % F.col("length")
    return rows.select("read_id", "accession", start.alias("start"), "strand", (start + F.col("read_length") > F.col("length")).alias("wraps_origin"))


def realized_coverage(origins: DataFrame, lengths: DataFrame, read_length: int) -> DataFrame:
    """(accession, coverage): bases of an accession's mates over its length; 0 without reads."""
    n = origins.groupBy("accession").agg(F.count(F.lit(1)).alias("n"))
    rows = lengths.select(F.col("name").alias("accession"), "length").join(n, "accession", "left")
    return rows.select("accession", (F.coalesce("n", F.lit(0)) * read_length / F.col("length")).alias("coverage"))


def quality(contigs: DataFrame, summary: DataFrame) -> DataFrame:
    """Every contig with its reported candidates, and not_reported where there is none; scores are no completeness.

    contigs: contig, seq. summary: seq_name, length, coordinates, virus_score, topology, taxonomy. Names of integrated
    elements end in |provirus_START_END (1-based, inclusive) and agree with coordinates START-END; other rows leave
    coordinates empty, NA or null. Rows that fit no contig, with another length, a score outside 0..1 or a repeated
    name are refused.
    """
    element = r"^(.+)\|provirus_(\d+)_(\d+)$"
    # guards and both kinds of rows read these, and texts should be read once
    summary = shared_table(summary, "summary")
    unique(summary, ["seq_name"], "sequence name")
    part = lambda i: F.regexp_extract("seq_name", element, i)
    whole = F.coalesce(F.col("coordinates"), F.lit("")).isin("", "NA")
    rows = summary.withColumn("__whole", whole).withColumn("contig", F.when(F.col("__whole"), F.col("seq_name")).otherwise(part(1)))
    refuse(rows.where(~F.col("__whole") & ((part(1) == "") | (F.col("coordinates") != F.concat_ws("-", part(2), part(3))))).select("seq_name", "coordinates"), "element whose name and coordinates differ")
    sizes = shared_table(contigs.select("contig", F.length("seq").cast("long").alias("__n")), "contigsizes")
    rows = rows.join(sizes, "contig", "left")
    rows = rows.withColumn("start", F.when(F.col("__whole"), F.lit(0)).otherwise(part(2).try_cast("long") - 1)).withColumn("end", F.when(F.col("__whole"), F.col("__n")).otherwise(part(3).try_cast("long")))
    score = F.col("virus_score").cast("double")
    fits = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("__n")) & (F.col("end") - F.col("start") == F.col("length").cast("long")) & score.between(0, 1) & ~F.isnan(score)
    refuse(rows.where(~F.coalesce(fits, F.lit(False))).select("seq_name", "length", "virus_score"), "result that does not fit its contig")
    told = rows.select("contig", F.col("seq_name").alias("result_id"), "start", "end", F.lit("reported_viral_candidate").alias("status"), score.alias("virus_score"), "topology", "taxonomy")
    silent = sizes.join(told, "contig", "left_anti").select("contig", F.lit("").alias("result_id"), F.lit(0).cast("long").alias("start"), F.col("__n").alias("end"), F.lit("not_reported").alias("status"), F.lit(None).cast("double").alias("virus_score"), F.lit("").alias("topology"), F.lit("").alias("taxonomy"))
    return told.unionByName(silent).withColumn("completeness", F.lit(None).cast("double")).withColumn("provirus_is_chimera", F.lit(False))


def reconcile(wanted: DataFrame, got: DataFrame) -> DataFrame:
    """(accession, status): missing and unexpected accessions."""
    lost = wanted.join(got, "accession", "left_anti").select("accession", F.lit("missing").alias("status"))
    return lost.unionByName(got.join(wanted, "accession", "left_anti").select("accession", F.lit("unexpected").alias("status")))


def resolve_taxonomy(mapping: DataFrame, nodes: DataFrame, merged: DataFrame, deleted: DataFrame, ranks: list[str]) -> DataFrame:
    """(accession, taxid, resolved_taxid, status, one column a rank) of a mapping (accession, taxid).

    Merged ids are followed to their end, whatever lies there: deleted, known or unknown. The walk to the root stops
    before a deleted ancestor, and of several ancestors of one rank the farthest counts. Repeated accessions or
    nodes, circles and invalid ranks are errors.
    """
    from seqlens.operators.graph import lineage, ranks_of

    if not ranks or len(set(ranks)) < len(ranks) or set(ranks) & {"accession", "taxid", "resolved_taxid", "status"}:
        raise ValueError("invalid taxonomy ranks")
    unique(mapping, ["accession"], "accession")
    unique(nodes, ["node"], "node")
    redirect = lineage(merged.select(F.col("old").alias("node"), F.col("new").alias("parent"), F.lit("").alias("rank")), mapping.select(F.col("taxid").alias("id"), F.col("taxid").alias("node")).distinct(), loops=False)
    last = redirect.groupBy("id").agg(F.max_by("node", "depth").alias("resolved"))
    rows = mapping.select("accession", "taxid").join(last, F.col("taxid") == F.col("id"), "left").drop("id").withColumn("resolved", F.coalesce("resolved", "taxid"))
    gone = deleted.select(F.col("taxid").alias("resolved")).distinct().withColumn("deleted", F.lit(True))
    rows = rows.join(gone, "resolved", "left").join(nodes.select(F.col("node").alias("resolved"), F.lit(True).alias("there")), "resolved", "left")
    status = F.when(F.col("deleted"), "deleted").when(F.col("there"), "known").otherwise("unknown")
    rows = rows.withColumn("status", status)
    left = nodes.join(gone, F.col("node") == F.col("resolved"), "left_anti")
    live = rows.where("status = 'known'").select(F.col("resolved").alias("id"), F.col("resolved").alias("node")).distinct()
    out = rows.join(ranks_of(lineage(left, live), ranks, nearest=False), F.col("resolved") == F.col("id"), "left")
    return out.select("accession", "taxid", F.col("resolved").alias("resolved_taxid"), "status", *[F.col(r).cast("string").alias(r) for r in ranks])


def method_report(metrics: DataFrame, baseline: str) -> DataFrame:
    """(method, mean_wrong, mean_recovery, reduction, recovery_loss) against the baseline method, null where it has no errors.

    metrics: sample, method, wrong, recovery. Samples are compared with themselves first.
    """
    base = metrics.where(F.col("method") == baseline).select("sample", F.col("wrong").alias("bw"), F.col("recovery").alias("br"))
    rows = metrics.join(base, "sample")
    return rows.groupBy("method").agg(F.avg("wrong").alias("mean_wrong"), F.avg("recovery").alias("mean_recovery"), F.try_divide(F.sum(F.col("bw") - F.col("wrong")), F.sum("bw")).alias("reduction"), F.avg(F.col("br") - F.col("recovery")).alias("recovery_loss"))


def cluster_edges(hits: DataFrame, lengths: DataFrame, identity: float = 95.0, cover: float = 0.85) -> DataFrame:
    """(a, b, identity, coverage) of the best alignment of each pair that covers both ends; identity is counted from the aligned strings."""
    cells = F.arrays_zip(F.split(F.upper("qseq"), "").alias("q"), F.split(F.upper("sseq"), "").alias("s"))
    solid = F.filter(cells, lambda c: (c["q"] != "-") & (c["s"] != "-"))
    rows = hits.where("qseqid <> sseqid").withColumn("n", F.size(solid)).withColumn("same", F.size(F.filter(solid, lambda c: c["q"] == c["s"])))
    size = lambda x: lengths.select(F.col("name").alias(x), F.col("length").alias(x + "_n"))
    rows = rows.join(size("qseqid"), "qseqid").join(size("sseqid"), "sseqid")
    rows = rows.select(F.least("qseqid", "sseqid").alias("a"), F.greatest("qseqid", "sseqid").alias("b"), (F.col("same") * 100 / F.length("qseq")).alias("identity"), F.least(F.col("n") / F.col("qseqid_n"), F.col("n") / F.col("sseqid_n")).alias("coverage"))
    best = rows.groupBy("a", "b").agg(F.max(F.struct("coverage", "identity")).alias("m")).select("a", "b", "m.identity", "m.coverage")
    return best.where((F.col("identity") >= identity) & (F.col("coverage") >= cover))


def neighborhoods(candidates: DataFrame, seqs: DataFrame, flank: int = 2000) -> DataFrame:
    """(contig, start, end): merged regions around repeat candidates (contig, cut, repeat_length)."""
    if flank < 1:
        raise ValueError("flank must be positive")
    rows = candidates.join(seqs.select(F.col("name").alias("contig"), F.length("seq").alias("n")), "contig")
    rows = rows.select("contig", F.greatest(F.lit(0), F.col("cut") - flank - F.col("repeat_length")).cast("int").alias("start"), F.least(F.col("n"), F.col("cut") + flank).cast("int").alias("end"))
    return I.merge_intervals(rows, ["contig"])


def fresh_queries(queries: DataFrame, memo: DataFrame, settings_key: str) -> DataFrame:
    """queries (id, seq) with key, of which memo (key, ...) has no result yet: an empty remembered result is a result."""
    keyed = queries.withColumn("key", F.sha2(F.concat_ws("\t", F.lit(settings_key), "seq"), 256))
    return keyed.join(memo.select("key").distinct(), "key", "left_anti")


def alignment_atlas(columns: DataFrame, seqs: DataFrame, taxonomy: DataFrame, rank: str = "species") -> DataFrame:
    """Atlas rows from aligned base pairs (hit, contig, source, q, s): segments between the ends of runs that a sequence shares.

    A run counts for both sequences. Segments are not merged again, and the sequence itself always competes.
    """
    from seqlens.functions.sequence import low_complexity
    from seqlens.operators.evaluate import aligned_runs

    ours = aligned_runs(columns.select("hit", F.col("source").alias("contig"), F.col("contig").alias("source"), F.col("s").alias("q"), F.col("q").alias("s")))
    theirs = aligned_runs(columns)
    # runs come with the interval on source, shared with contig
    runs = theirs.unionByName(ours).where("contig <> source").select(F.col("source").alias("accession"), "start", "end", F.col("contig").alias("other"))
    segs = I.sweep_segments(runs, ["accession"], "other").withColumn("members", F.array_sort(F.array_union("members", F.array("accession"))))
    names = segs.select("accession", "seg_start", F.explode("members").alias("name")).join(taxonomy.select("name", "taxon"), "name", "left")
    taxa = names.groupBy("accession", "seg_start").agg(F.sort_array(F.collect_set("taxon")).alias("taxa"), F.max(F.col("taxon").isNull()).alias("unknown_taxonomy"))
    rows = segs.join(taxa, ["accession", "seg_start"]).join(seqs.select(F.col("name").alias("accession"), "seq"), "accession")
    piece = F.substring(F.col("seq"), (F.col("seg_start") + 1).cast("int"), (F.col("seg_end") - F.col("seg_start")).cast("int"))
    return rows.select("accession", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"), F.lit(rank).alias("rank"), F.size("taxa").alias("taxa_count"), F.array_join("taxa", ";").alias("taxa"), F.array_join("members", ";").alias("accessions"), "unknown_taxonomy", low_complexity(piece).alias("low_complexity"), F.concat_ws(":", F.lit("alignment"), "accession", "seg_start", "seg_end").alias("evidence_id"))


def latent_switches(profiles: DataFrame, rank: int | str = 2, seeds: tuple[int, ...] = (17, 29, 43), min_loading: float = 0.7, min_change: float = 0.5, min_stability: float = 0.85, max_rank: int = 6, rank_penalty: float = 0.02, max_iter: int = 2000) -> DataFrame:
    """(contig, start, end, method, score, detail) where the leading component of window profiles changes.

    profiles: (window_id, contig, start, end, sample, value); sample is a biological one, and three of them need
    coverage. Rows are scaled to sum 1; windows without coverage break the chain. Rank auto takes, from 2 to
    max_rank, the least relative error plus rank_penalty a component. The best of the seeded fits counts, and unless
    it converged and the others agree with it there are no proposals. score is the change alone. One fit sees all
    windows of the run, so it is for the windows of one assembly.
    """
    import numpy as np
    import pandas as pd

    from seqlens.operators.design import fit_seeds, loadings, stability

    if len(set(seeds)) < 2:
        raise ValueError("use at least two distinct seeds")
    places = profiles.select("window_id", "contig", "start", "end").distinct()

    def trial(rows: np.ndarray, k: int) -> dict:
        fits = fit_seeds(rows, np.ones_like(rows), k, seeds, max_iter)
        each = zip(fits.entities, fits.features, fits.rounds, strict=True)
        runs = [(float(np.linalg.norm(rows - w @ h) / np.linalg.norm(rows)), steps < max_iter, w, h) for w, h, steps in each]
        runs.sort(key=lambda r: r[0])
        return {"rank": k, "cost": runs[0][0] + rank_penalty * k, "same": stability([r[3].T for r in runs]), "settled": runs[0][1], "w": runs[0][2]}

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        wide = g.pivot(index="window_id", columns="sample", values="value").fillna(0.0).sort_index()
        x = wide.to_numpy()
        if not np.isfinite(x).all() or (x < 0).any():
            raise ValueError("coverage must be finite and not negative")
        if (x.sum(axis=0) > 0).sum() < 3:
            raise ValueError("three biological samples need coverage")
        live = x.sum(axis=1) > 0
        rows = x[live] / x[live].sum(axis=1, keepdims=True)
        if len(rows) < 2 or np.max(np.std(rows, axis=0)) < 1e-8:
            raise ValueError("no variable profiles")
        tried = range(2, min(max_rank, *rows.shape) + 1) if rank == "auto" else [int(rank)]
        best = min((trial(rows, k) for k in tried), key=lambda t: (t["cost"], t["rank"]))
        shares = np.zeros((len(x), best["rank"]))
        shares[live] = loadings(best["w"])
        return pd.DataFrame({"window_id": wide.index, "v": [list(r) if ok else None for r, ok in zip(shares, live, strict=True)], "p": list(map(list, x)), "stability": best["same"], "settled": best["settled"]})

    model = profiles.select("window_id", "sample", "value").withColumn("all", F.lit(1)).groupBy("all").applyInPandas(fit, "window_id string, v array<double>, p array<double>, stability double, settled boolean")
    w = Window.partitionBy("contig").orderBy("start")
    rows = places.join(model, "window_id")
    rows = rows.select("*", *[F.lead(c).over(w).alias("n_" + c) for c in ("window_id", "start", "end", "v", "p")])

    def change(a: str, b: str):
        dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
        norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda t, x: t + x * x))
        return 1 - F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))

    lead = lambda c: F.array_position(F.col(c), F.array_max(c))
    least = F.least(F.array_max("v"), F.array_max("n_v"))
    ok = (F.col("n_start") <= F.col("end")) & F.col("v").isNotNull() & F.col("n_v").isNotNull() & F.col("settled") & (lead("v") != lead("n_v")) & (least >= min_loading) & (F.col("score") >= min_change) & (F.col("stability") >= min_stability)
    detail = F.to_json(F.struct(F.col("window_id").alias("left"), F.col("n_window_id").alias("right"), change("p", "n_p").alias("coverage_distance"), "stability"))
    return rows.withColumn("score", change("v", "n_v")).where(ok).select("contig", F.least("start", "n_start").alias("start"), F.greatest("end", "n_end").alias("end"), F.lit("nmf").alias("method"), "score", detail.alias("detail"))
