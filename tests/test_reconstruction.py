"""Rewrites of contigs: templates, competitors, refusals and the verification of a whole batch, with reads placed by plain search."""

import random

import pytest

from seqlens.operators import graph
from seqlens.operators import reconstruction as N

SAM = "fragment string, {place} string, flag int, pos int, mate_pos int, cigar string, score int"


def _seq(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


SEGMENTS = {"1": _seq(100, 1), "2": _seq(60, 2), "3": _seq(80, 3), "4": _seq(100, 4), "5": _seq(300, 5)}
LINKS = [("1+", "2+"), ("1+", "3+"), ("2+", "4+"), ("3+", "4+")]


@pytest.fixture(scope="module")
def parts(spark):
    segments = spark.createDataFrame(list(SEGMENTS.items()), "id string, seq string")
    links = spark.createDataFrame([(a, b, 0) for a, b in LINKS], "src string, dst string, overlap int")
    spell = lambda *ids: "".join(SEGMENTS[i] for i in ids)
    seqs = spark.createDataFrame([("c", spell("1", "2", "4")), ("other", SEGMENTS["5"])], "name string, seq string")
    paths = spark.createDataFrame([("c", ["1+", "2+", "4+"])], "name string, path array<string>")
    return segments, links, seqs, paths


@pytest.fixture(scope="module")
def found(parts):
    """candidates, skipped contigs and templates, computed once."""
    segments, links, seqs, paths = parts
    candidates, skipped = N.rewrite_candidates(seqs, paths, segments, links)
    candidates = candidates.persist()
    return candidates, skipped, N.rewrite_templates(candidates, seqs, segments, links).persist()


def _placed(reads, texts, extra=()):
    """Where each pair's ends occur in named texts: exact placements, as a mapper reports them all."""
    rows = []
    for fragment, text in reads:
        left, right = text[:60], text[-60:]
        for place, target in texts:
            a, b = target.find(left), target.find(right)
            if a >= 0 and b >= 0:
                rows += [(fragment, *place, 67, a, b, "60M", 0), (fragment, *place, 131 + 16, b, a, "60M", 0)]
    return rows + list(extra)


def _run(spark, parts, found, count=3, rivals=(), **settings):
    """The decisions on so many fragments of the rewrite, and the reads."""
    seqs, templates = parts[2], found[2]
    rows = templates.collect()
    new = next((r.seq for r in rows if r.template == "path_1"), "")
    reads = [(f"f{i}", new[50 + i : 230 - i]) for i in range(count)]
    kind = lambda place: SAM.format(place=place)
    placed = spark.createDataFrame(_placed(reads, [((r.candidate, r.template), r.seq) for r in rows]), "fragment string, candidate string, template string, flag int, pos int, mate_pos int, cigar string, score int")
    background = spark.createDataFrame(_placed(reads, [((r.name,), r.seq) for r in seqs.collect()], rivals), kind("contig"))
    support = N.competing_support(placed, background, templates, seqs.selectExpr("name AS contig", "length(seq) AS length"))
    return N.rewrite_decisions(templates, support, **settings), reads


def test_templates_and_their_anchors(found):
    candidates, skipped, templates = found
    assert [(r.candidate, r.left, r.right, r.alternatives) for r in candidates.collect()] == [("c:0:2", 0, 2, [["1+", "3+", "4+"]])]
    assert [(r.contig, r.reason) for r in skipped.collect()] == [("other", "missing_gapped_cyclic_or_mismatched_path")]
    got = {r.template: (r.path, r.left, r.right, r.unchanged, r.reuses) for r in templates.collect()}
    assert got == {"path_0": (["1+", "2+", "4+"], 100, 160, True, False), "path_1": (["1+", "3+", "4+"], 100, 180, False, False)}


def test_a_supported_rewrite_is_verified_and_mapped(spark, parts, found):
    segments, links, seqs, paths = parts
    candidates, _, templates = found
    decisions, reads = _run(spark, parts, found)
    decisions = decisions.persist()
    (row,) = decisions.collect()
    assert (row.decision, row.reason, row.template, row.support) == ("reconstruct", "spanning_fragment_support", "path_1", 3)
    assembly, bounds = N.provisional(seqs, decisions, templates)
    texts = [((r.name,), r.seq) for r in assembly.collect()]
    assert dict(map(lambda x: (x[0][0], x[1]), texts)) == {"c": SEGMENTS["1"] + SEGMENTS["3"] + SEGMENTS["4"], "other": SEGMENTS["5"]}
    assert {(r.template, r.left, r.right) for r in bounds.collect()} == {("c", 100, 180), ("other", 0, 300)}
    remapped = spark.createDataFrame(_placed(reads, texts), SAM.format(place="template"))
    verified = N.verify_batch(decisions, N.pair_support(remapped, bounds)[0])
    assert [(r.decision, r.reason, r.verification_support) for r in verified.collect()] == [("reconstruct", "spanning_support_and_batch_remapping", 3)]
    final, ways = N.reconstructed(seqs, paths, verified, candidates, templates)
    assert {r.name: r.seq for r in final.collect()} == {r.name: r.seq for r in assembly.collect()}
    places = graph.coordinate_map(ways, segments, links).orderBy("output_start").collect()
    assert [(r.output_start, r.output_end, r.original_start) for r in places] == [(0, 100, 0), (100, 180, None), (180, 280, 160)]


def test_one_failing_contig_withdraws_the_batch(spark, parts, found):
    decisions = spark.createDataFrame(
        [("a:0:1", "a", "reconstruct", "x", "path_1", 5, 1), ("b:0:1", "b", "reconstruct", "x", "path_1", 5, 1), ("c:0:1", "c", "unresolved", "sequence_unchanged", "path_1", 5, 1), ("d:0:1", "d", "reconstruct", "x", "path_2", 9, 2)],
        "candidate string, contig string, decision string, reason string, template string, support long, batch int",
    )
    verified = spark.createDataFrame([("a", 3), ("b", 2), ("c", 9), ("d", 4)], "template string, support long")
    got = {r.contig: (r.decision, r.reason, r.verification_support) for r in N.verify_batch(decisions, verified, 3, ("batch",)).collect()}
    assert got == {"a": ("unresolved", "batch_remapping_failed", 3), "b": ("unresolved", "batch_remapping_failed", 2), "c": ("unresolved", "sequence_unchanged", None), "d": ("reconstruct", "spanning_support_and_batch_remapping", 4)}
    # without batches of their own all fall together; a contig that is not found has no support
    whole = {r.contig: r.decision for r in N.verify_batch(decisions.where("contig <> 'b'"), verified.where("template <> 'd'"), 3).collect()}
    assert whole == {"a": "unresolved", "c": "unresolved", "d": "unresolved"}
    segments, links, seqs, paths = parts
    candidates, _, templates = found
    alone = spark.createDataFrame([("c:0:2", "c", "reconstruct", "x", "path_1", 3)], "candidate string, contig string, decision string, reason string, template string, support long")
    back = N.verify_batch(alone, spark.createDataFrame([], "template string, support long"))
    final, ways = N.reconstructed(seqs, paths, back, candidates, templates)
    assert {r.name: r.seq for r in final.collect()} == {r.name: r.seq for r in seqs.collect()} and [r.path for r in ways.collect()] == [["1+", "2+", "4+"]]


def test_too_few_tied_far_or_reported_only(spark, parts, found):
    reasons = lambda **kw: [(r.decision, r.reason) for r in _run(spark, parts, found, **kw)[0].collect()]
    assert reasons(count=2) == [("unresolved", "insufficient_unique_alternative_support")]
    assert reasons(max_fragment=100) == [("unresolved", "region_exceeds_fragment_span")]
    assert reasons(apply=False) == [("proposed", "spanning_fragment_support")]
    # another contig that holds a fragment as well competes for it, but the contig's own unchanged sequence does not
    rival = [("f0", "other", 67, 5, 200, "40M", 0), ("f0", "other", 147, 200, 5, "40M", 0)]
    assert reasons(rivals=rival) == [("unresolved", "insufficient_unique_alternative_support")]
    assert reasons(rivals=[(f, "c", *more) for f, _, *more in rival]) == [("reconstruct", "spanning_fragment_support")]


def test_refusals_and_contigs_with_several_rewrites(spark):
    kind = "candidate string, contig string, template string, index int, left int, right int, unchanged boolean, reuses boolean"
    rows = lambda c, contig, **k: [(c, contig, f"path_{i}", i, 10, 90, k.get("unchanged", False) and i == 1, k.get("reuses", False) and i == 1) for i in range(3)]
    templates = spark.createDataFrame(rows("s", "x", unchanged=True) + rows("r", "y", reuses=True) + rows("m", "z") + rows("n", "z") + rows("t", "w") + rows("o", "v"), kind)
    counts = [(c, "path_1", 9) for c in "srmnt"] + [("t", "path_2", 9), ("o", "path_1", 9), ("o", "path_0", 2)]
    got = {r.candidate: (r.decision, r.reason) for r in N.rewrite_decisions(templates, spark.createDataFrame(counts, "candidate string, template string, support long")).collect()}
    assert got == {
        "s": ("unresolved", "sequence_unchanged"), "r": ("unresolved", "replacement_reuses_external_path_nodes"), "m": ("unresolved", "multiple_rewrites_require_joint_validation"), "n": ("unresolved", "multiple_rewrites_require_joint_validation"),
        "t": ("unresolved", "insufficient_unique_alternative_support"), "o": ("unresolved", "insufficient_unique_alternative_support"),
    }
