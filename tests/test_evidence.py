import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlens.operators import catalog as G
from seqlens.operators import coverage as C
from seqlens.operators import design as D
from seqlens.operators import evaluate as V
from seqlens.operators import evidence as E
from seqlens.operators import graph as P
from seqlens.operators import reads as R
from seqlens.operators import stages as T
from seqlens.operators.components import connected_components
from seqlens.operators.positions import with_positions, with_prefix_sums

SAM = "qname string, flag int, rname string, pos int, mapq int, cigar string, score double, other double"


def test_depth_counts_mates_once(frame):
    sam = frame([("f", 67, "c", 1, 60, "100M", 0.0, None), ("f", 131, "c", 51, 60, "100M", 0.0, None), ("g", 67, "c", 1, 10, "50M", 0.0, None), ("g", 131, "c", 1, 60, "50M", 0.0, None)], SAM)
    blocks = C.fragment_blocks(C.accepted_pairs(sam))
    assert [tuple(r) for r in blocks.collect()] == [("f", "c", 0, 150)]
    windows = frame([("w0", "c", 0, 100), ("w1", "c", 100, 200), ("w2", "c", 200, 300)], "window_id string, contig string, start int, end int")
    assert [r.depth for r in C.window_depth(windows, blocks, 70).orderBy("window_id").collect()] == [1, 0.5, 0]


@pytest.mark.parametrize(("mapq", "kept"), [(255, 0), (19, 0), (20, 2), (42, 2)])
def test_mapq_gate(frame, mapq, kept):
    assert C.accepted_pairs(frame([("f", 67, "c", 1, mapq, "50M", 0.0, None), ("f", 131, "c", 1, mapq, "50M", 0.0, None)], SAM)).count() == kept


@pytest.mark.parametrize(("more", "kept"), [(("f", 323, "d", 9, 60, "50M", -5.0, None), 2), (("f", 323, "d", 9, 60, "50M", 0.0, None), 0), (("f", 323, "d", 9, 60, "50M", None, None), 0), (("f", 2115, "d", 9, 60, "50M", -5.0, None), 0)])
def test_competing_placements(frame, more, kept):
    pair = [("f", 67, "c", 1, 60, "50M", 0.0, None), ("f", 131, "c", 1, 60, "50M", 0.0, None)]
    assert C.accepted_pairs(frame([*pair, more], SAM)).count() == kept


def test_pair_evidence(frame):
    def pair(f, t, p, q, s, flag=0):
        return [(f, t, 66 + flag, p, q, "50M", s), (f, t, 130 + flag, q, p, "50M", s)]

    rows = pair("a", "alt", 30, 90, 0) + pair("b", "alt", 30, 90, 0) + pair("c", "alt", 31, 90, 0) + pair("t", "alt", 30, 90, 0) + pair("t", "current", 30, 90, 0) + pair("d", "alt", 33, 90, 0, 1024) + pair("n", "alt", 30, 200, 0)
    sam = frame(rows, "fragment string, template string, flag int, pos int, mate_pos int, cigar string, score int")
    bounds = frame([("alt", 60, 100), ("current", 60, 100)], "template string, left int, right int")
    support, frags = E.pair_support(sam, bounds)
    assert {r.template: r.support for r in support.collect()} == {"alt": 3, "current": 0}
    status = {r.fragment: r.status for r in frags.collect()}
    assert status["t"] == "ambiguous" and status["d"] == "excluded_qc_or_duplicate" and status["a"] == "unique_spanning"


@pytest.mark.parametrize(("current", "alternative", "want"), [(0, 0, "unresolved"), (0, 2, "unresolved"), (0, 3, "split"), (10, 3, "retain")])
def test_decision_rule(spark, current, alternative, want):
    assert spark.range(1).select(E.decision(F.lit(current), F.lit(alternative)).alias("d")).first().d == want


def test_gate_only_downgrades(spark):
    row = spark.range(1).select(E.gate(F.lit("split"), F.array(F.lit("a")), "require_all", ("a", "b")).alias("x"), E.gate(F.lit("retain"), F.array().cast("array<string>"), "require_any").alias("y")).first()
    assert tuple(row) == ("unresolved", "retain")


def test_domain_projection_and_link(frame):
    orfs = frame([("o", "c", 12, 72, "-")], "orf_id string, accession string, start int, end int, strand string")
    hit = E.project_domains(orfs, frame([("o", 2, 5)], "orf_id string, aa_start int, aa_end int")).first()
    assert (hit.nt_start, hit.nt_end) == (57, 66)
    links = E.link_annotations(frame([("c", 57, 66, "domain")], "accession string, start int, end int, kind string"), frame([("c", 60, 70)], "accession string, start int, end int"))
    assert [tuple(r) for r in E.linked_bases(links, ["accession", "kind"]).collect()] == [("c", "domain", 6)]


def test_joint_overlap_is_found(frame):
    rows = frame([("u", 0, 10), ("u", 9, 12), ("v", 0, 3)], "unit string, start int, end int")
    assert [r.unit for r in E.overlapping_observations(rows, ["unit"]).collect()] == ["u"]


def test_structural_lineage_switch(frame):
    rows = frame([(i, "c", 100 * i, 100 * i + 90, "viral", "A" if i < 2 else "B", True, 0.9) for i in range(4)], "orf_id int, contig string, start int, end int, origin string, lineage string, structural_related boolean, confidence double")
    assert [tuple(r) for r in E.flank_switches(rows, "lineage").collect()] == [("c", 190, 200, "structural_lineage", 0.9)]


def test_graph_spelling_and_checks(frame):
    segs = frame([("1", "AACCGG"), ("2", "GGTTAA")], "id string, seq string")
    links = frame([("1+", "2+", 2)], "src string, dst string, overlap int")
    paths = frame([("f", ["1+", "2+"]), ("r", ["2-", "1-"]), ("x", ["1+", "1+"])], "name string, path array<string>")
    got = {r.name: (r.seq, r.offsets) for r in P.spell_paths(paths, segs, links).collect()}
    assert got["f"] == ("AACCGGTTAA", [0, 4]) and got["r"][0] == "TTAACCGGTT" and got["x"][0] is None
    assert P.bad_links(segs, links).count() == 0
    assert P.bad_links(segs, frame([("1+", "2+", 3)], "src string, dst string, overlap int")).count() == 2


def test_repeat_candidate(frame):
    segs = frame([(str(i), b * 50) for i, b in zip(range(1, 6), "ACGTA", strict=True)], "id string, seq string")
    links = frame([("1+", "2+", 0), ("5+", "2+", 0), ("2+", "3+", 0), ("2+", "4+", 0)], "src string, dst string, overlap int")
    segs = frame([("1", "A" * 100), ("2", "C" * 50), ("3", "G" * 70), ("4", "T" * 70), ("5", "AC" * 30)], "id string, seq string")
    got = P.repeat_candidates(frame([("c", ["1+", "2+", "3+"])], "name string, path array<string>"), segs, links).collect()
    assert [(r.cut, r.current, r.alternatives, r.repeat_length) for r in got] == [(150, ["1+", "2+", "3+"], [["1+", "2+", "4+"]], 50)]


def test_bounded_paths_void_on_cycle_and_limits(frame):
    links = frame([("1+", "2+", 0), ("2+", "3+", 0), ("1+", "3+", 0), ("3+", "4+", 0), ("5+", "6+", 0), ("6+", "5+", 0), ("6+", "7+", 0)], "src string, dst string, overlap int")
    ends = frame([("ok", "1+", "3+"), ("loop", "5+", "7+")], "name string, left string, right string")
    assert [(r.name, r.path_no, r.path) for r in P.bounded_paths(ends, links).orderBy("path_no").collect()] == [("ok", 1, ["1+", "2+", "3+"]), ("ok", 2, ["1+", "3+"])]
    assert P.bounded_paths(ends, links, max_paths=1).count() == 0
    assert P.bounded_paths(ends, links, max_nodes=2).count() == 0
    near = P.reconvergences(frame([("c", ["1+", "3+", "4+"])], "name string, path array<string>"), links).collect()
    assert [(r.left, r.right, r.alternatives) for r in near] == [(0, 1, [["1+", "2+", "3+"]])]


def test_chimera_breakpoint(frame):
    contigs = frame([("x", 600), ("ok", 200), ("none", 90)], "contig string, length int")
    bases = [("x", "A", q, True) for q in range(350)] + [("x", "B", q, True) for q in range(250, 600)] + [("ok", "A", q, True) for q in range(200)]
    calls, breaks = V.contig_calls(contigs, frame(bases, "contig string, source string, q int, match boolean"))
    assert {r.contig: r.status for r in calls.collect()} == {"x": "chimeric", "ok": "consistent", "none": "unaligned"}
    assert [(r.start, r.end) for r in breaks.collect()] == [(250, 350)]


def test_aligned_columns_skip_gaps(frame):
    hits = frame([(1, "c", "s", 1, 4, 5, 2, "AC-GT", "ACTG-")], "hit int, contig string, source string, qstart int, qend int, sstart int, send int, qseq string, sseq string")
    got = [(r.q, r.s, r.match) for r in V.aligned_columns(hits).orderBy("q").collect()]
    assert got == [(0, 4, True), (1, 3, True), (2, 1, True)]


def test_recovery_and_n50(frame):
    calls = frame([("x", 600, "chimeric", None, 1)], "contig string, length int, status string, source string, wrong_connections long")
    runs = frame([("x", "A", 0, 300, 300), ("x", "B", 0, 300, 300)], "contig string, source string, start int, end int, length int")
    per, whole = V.recovery(calls, runs, frame([("A", 300), ("B", 300)], "source string, length int"), (500, 700))
    got = {r.cutoff: (r.genome_recovery, r.n50, r.wrong_connections) for r in whole.collect()}
    assert got == {500: (1.0, 600, 1), 700: (0.0, 0, 0)} and per.count() == 4


def test_greedy_clusters(frame):
    items = frame([("A", 30), ("B", 20), ("C", 10), ("D", 5)], "name string, length int")
    got = G.greedy_clusters(items, frame([("A", "B"), ("B", "C")], "a string, b string"))
    assert {r.member: r.representative for r in got.collect()} == {"A": "A", "B": "A", "C": "C", "D": "D"}


def test_greedy_clusters_against_a_loop(frame):
    rng = random.Random(3)
    names = [f"n{i:02d}" for i in range(40)]
    size = {n: rng.randrange(5) for n in names}
    edges = {tuple(sorted(rng.sample(names, 2))) for _ in range(70)}
    rep = {}
    for n in sorted(names, key=lambda n: (-size[n], n)):
        near = [r for r in rep.values() if tuple(sorted((r, n))) in edges and rep[r] == r]
        rep[n] = min(near, key=lambda r: (-size[r], r)) if near else n
    got = G.greedy_clusters(frame(list(size.items()), "name string, length int"), frame(list(edges), "a string, b string"))
    assert {r.member: r.representative for r in got.collect()} == rep


def test_units_are_group_disjoint(frame):
    rows = frame([("A", "k1", "g1"), ("B", "k1", "g2"), ("C", "k2", "g2"), ("D", "k3", None)], "name string, cluster string, grp string")
    units = G.group_units(rows, "name", ["cluster", "grp"])
    assert {r.name: r.unit for r in units.collect()} == {"A": "A", "B": "A", "C": "A", "D": "D"}
    assert {r.split for r in G.split_units(units, 0.5).select("split").distinct().collect()} == {"held_out", "development"}


def test_components_of_a_long_chain(spark, frame):
    n = 300
    order = list(range(n))
    random.Random(5).shuffle(order)
    edges = frame([(a, b) for a, b in itertools.pairwise(order)] + [(n + 1, n + 1), (None, 4)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert set(got.values()) == {0, n + 1} and len(got) == n + 1


def test_positions_and_prefix_sums(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"), (F.col("id") % 5).alias("v")).repartition(7)
    assert all(r.x == r.pos for r in with_positions(df, [F.col("x")]).collect())
    run = 0
    for r in with_prefix_sums(df, [F.col("x")], "v", "s").orderBy("x").collect():
        assert r.s == run
        run += r.v


def test_path_rank_keeps_missing_apart(frame):
    rows = frame([("c", "p", "coverage", 0.9), ("c", "p", "structure", None)], "candidate string, path string, feature string, value double")
    got = D.path_rank(rows, {"coverage": 1, "structure": 1}).first()
    assert (got.score, got.missing, got.observed_weight) == (0.9, "structure", 1.0)


def test_bootstrap_is_the_plain_one(frame):
    values = [0.1, 0.3, -0.2, 0.25]
    got = D.paired_bootstrap(frame([("g", str(i), v) for i, v in enumerate(values)], "g string, u string, e double"), "g", "u", "e").first()
    rng = random.Random(17)
    means = sorted(sum(rng.choices(values, k=4)) / 4 for _ in range(2000))
    assert (got.mean, got.lower, got.upper) == (sum(values) / 4, means[50], means[1950])


def test_adoption_ladder(frame):
    rows = [("m", f"u{i}", 0.1, 0.01, 0.9, 0.9, 1.0) for i in range(4)] + [("h", f"u{i}", 0.1, 0.01, 0.9, 0.5, 1.0) for i in range(4)]
    ev = frame(rows, "module string, unit string, baseline_error double, error double, baseline_recovery double, recovery double, resource_ratio double")
    rules = {m: {"implementation": {"command": "x"}, "min_error_reduction": 0.05} for m in ("m", "h", "absent")}
    got = {r.module: (r.status, r.reason) for r in D.adoption(ev, rules, "natural_heldout").collect()}
    assert got["m"] == ("default", "passed_frozen_heldout_gate") and got["h"][0] == "excluded" and got["absent"][1] == "no_heldout_evidence"
    assert {r.status for r in D.adoption(ev, rules, "fixture").collect()} == {"research"}


def test_policy_choice(frame):
    rows = [("c", "unmasked", str(i), 0.3, 0.6, 1.0) for i in range(3)] + [("c", "good", str(i), 0.1, 0.6, 1.0) for i in range(3)] + [("c", "lossy", str(i), 0.0, 0.3, 1.0) for i in range(3)]
    got = D.choose_policy(frame(rows, "condition string, policy string, unit string, wrong double, correct double, retained_breadth double"))
    assert [tuple(r) for r in got.collect()] == [("c", "good")]
    for bad in (rows[:-1], [*rows, ("c", "good", "9", 0.1, 0.6, 1.0)], [*rows, rows[-1]]):
        with pytest.raises(Exception, match="(missing|unexpected|repeated) unit"):
            D.choose_policy(frame(bad, "condition string, policy string, unit string, wrong double, correct double, retained_breadth double")).collect()


def test_factorisation_ignores_missing_cells():
    rng = np.random.default_rng(0)
    x, w = rng.uniform(size=(8, 5)), np.ones((8, 5))
    w[2, 3] = 0
    y = x.copy()
    y[2, 3] = 99
    a, b = D.factorize(x, w, 2, 1, 50), D.factorize(y, w, 2, 1, 50)
    assert np.allclose(a[0], b[0]) and D.stability([a[0], a[0][:, ::-1]]) == pytest.approx(1)


def test_switch_proposals(frame):
    rows = frame([("c", 0, 10, [0.9, 0.1]), ("c", 10, 20, [0.2, 0.8]), ("c", 20, 30, None), ("c", 30, 40, [0.9, 0.1])], "contig string, start int, end int, v array<double>")
    assert [(r.start, r.end, r.score) for r in D.switch_proposals(rows).collect()] == [(10, 10, 0.8)]


def test_read_pairs(frame):
    good, bad = "I" * 60, "#" * 60
    kind = "ord int, id string, seq string, qual string"
    r1 = frame([(0, "host/1", "A" * 60, good), (1, "ambiguous/1", "A" * 60, good), (2, "poor/1", "A" * 60, bad), (3, "many/1", "AN", "#!")], kind)
    r2 = r1.withColumn("qual", F.when(F.col("ord") == 3, "II").otherwise(F.lit(good))).withColumn("id", F.regexp_replace("id", "1$", "2"))
    calls = "fragment string, status string"
    host = frame([("host", "host_supported"), ("ambiguous", "ambiguous"), ("poor", "host_supported")], calls)
    got = {r.fragment: (r.destination, r.reason, r.host_status) for r in R.prepare_pairs(r1, r2, host, True).collect()}
    many = ("quality_filtered", "excess_N;low_quality;short", "not_assessed")
    assert got == {"host": ("host_removed", "explicit_host_support", "host_supported"), "ambiguous": ("retained", "", "ambiguous"), "poor": ("quality_filtered", "low_quality", "host_supported"), "many": many}
    assert {r.fragment for r in R.prepare_pairs(r1, r2, host).where("destination = 'retained'").collect()} == {"host", "ambiguous"}
    assert {r.host_status for r in R.prepare_pairs(r1, r2).collect()} == {"not_assessed"}
    twice = frame([(0, "a", "A", "I"), (1, "a", "A", "I")], kind)
    for a, b, h in ((r1, r1, None), (r1, r2.where("ord < 3"), None), (twice, twice, None), (r1, r2, frame([("x", "nonhost")], calls)), (r1, r2, frame([("host", "host")], calls))):
        with pytest.raises(ValueError):
            R.prepare_pairs(a, b, h)
    assert {r.id for r in R.invalid_reads(frame([("x", "AC", "I"), ("y", "A!", "II"), ("z", "A", "I")], "id string, seq string, qual string")).collect()} == {"x", "y"}


def test_orfs_on_both_strands(frame):
    body = "ATG" + "GCT" * 20 + "TAA"
    got = R.six_frame_orfs(frame([("f", "TAA" + body), ("r", "TAA" + body)], "name string, seq string"), 15)
    hits = [r for r in got.collect() if r.name == "f" and r.strand == "+" and r.frame == 0]
    assert [(r.start, r.end, r.partial, r.protein) for r in hits] == [(3, 66, False, "M" + "A" * 20)]
    back = ("TAA" + body).translate(str.maketrans("ACGT", "TGCA"))[::-1]
    hits = [r for r in R.six_frame_orfs(frame([("b", back)], "name string, seq string"), 15).collect() if r.protein.startswith("MA")]
    assert [(r.strand, r.start, r.end) for r in hits] == [("-", 3, 66)]


def test_taxonomy_redirects(frame):
    mapping = frame([("A", "13"), ("B", "99"), ("C", "77"), ("D", "21")], "accession string, taxid string")
    nodes = frame([("1", "1", "root"), ("9", "1", "family"), ("10", "9", "genus"), ("11", "10", "species"), ("20", "9", "genus"), ("21", "20", "species")], "node string, parent string, rank string")
    merged, gone = frame([("12", "11"), ("13", "12")], "old string, new string"), frame([("99",), ("20",)], "taxid string")
    got = T.resolve_taxonomy(mapping, nodes, merged, gone, ["species", "genus", "family"])
    rows = {r.accession: (r.resolved_taxid, r.status, r.species, r.genus, r.family) for r in got.collect()}
    # the walk from 21 stops before 20, which is deleted
    assert rows == {"A": ("11", "known", "11", "10", "9"), "B": ("99", "deleted", None, None, None), "C": ("77", "unknown", None, None, None), "D": ("21", "known", "21", None, None)}
    circle = frame([("13", "14"), ("14", "13")], "old string, new string")
    for bad in ((mapping.unionByName(mapping), merged, ["species"]), (mapping, circle, ["species"]), (mapping, merged, ["status"])):
        with pytest.raises(ValueError):
            T.resolve_taxonomy(bad[0], nodes, bad[1], gone, bad[2])


def test_long_parent_chain(frame):
    nodes = frame([(str(i), str(max(0, i - 1)), "x" if i % 50 else "mark") for i in range(101)], "node string, parent string, rank string")
    walk = P.lineage(nodes, frame([("i", "100")], "id string, node string"))
    assert walk.count() == 101
    assert (P.ranks_of(walk, ["mark"]).first().mark, P.ranks_of(walk, ["mark"], nearest=False).first().mark) == ("100", "0")


def test_parent_cycle_raises(frame):
    nodes = frame([("1", "2", "x"), ("2", "1", "x")], "node string, parent string, rank string")
    with pytest.raises(ValueError):
        P.lineage(nodes, frame([("i", "1")], "id string, node string"), max_depth=5)


def test_replacement_rules(frame):
    rows = [("c1", "x", "path_0", 0, 0), ("c1", "x", "path_1", 1, 5), ("c2", "y", "path_1", 1, 5), ("c2", "y", "path_2", 2, 5), ("c3", "z", "path_1", 1, 5), ("c3", "z", "background_9", 9, 2)]
    got = T.replacements(frame(rows, "candidate string, contig string, template string, index int, support int"))
    assert {r.candidate: r.decision for r in got.collect()} == {"c1": "replace", "c2": "retain", "c3": "retain"}


SUMMARY = "seq_name string, length int, coordinates string, virus_score double, topology string, taxonomy string"


def test_quality_completion(frame):
    contigs = frame([("host", "ACGT" * 25), ("other", "ACGT"), ("whole", "AC")], "contig string, seq string")
    rows = [("host|provirus_11_30", 20, "11-30", 0.95, "Provirus", "Viruses;"), ("whole", 2, "NA", 0.5, "DTR", "")]
    got = {r.contig: r for r in T.quality(contigs, frame(rows, SUMMARY)).collect()}
    assert (got["host"].start, got["host"].end, got["host"].status, got["host"].provirus_is_chimera) == (10, 30, "reported_viral_candidate", False)
    assert (got["other"].start, got["other"].end, got["other"].status, got["other"].virus_score, got["other"].result_id) == (0, 4, "not_reported", None, "")
    assert (got["whole"].start, got["whole"].end, got["whole"].completeness, got["whole"].topology) == (0, 2, None, "DTR")


@pytest.mark.parametrize("row", [("c|provirus_2_4", 3, "2-5", 0.9), ("c|provirus_2_9", 8, "2-9", 0.9), ("c", 3, "", 0.9), ("c", 4, "", 1.5), ("x", 4, "", 0.9), ("c", 4, "", None)])
def test_quality_refuses(frame, row):
    with pytest.raises(ValueError):
        T.quality(frame([("c", "ACGT")], "contig string, seq string"), frame([(*row, "", "")], SUMMARY))


def test_correction_counts_alternatives_only(frame):
    # path_2 of x is an entrance: one alternative, so its reads never cut
    cand = [("x", "c1", 10, [["a"]]), ("y", "c2", 5, [["a"], ["b"]]), ("z", "c3", 5, [["a"]]), ("far", "c4", 5, [["a"]]), ("many", "c5", 5, [["a"]]), ("own", "c6", 5, None)]
    cand = frame(cand, "candidate string, contig string, cut int, alternatives array<array<string>>")
    rows = [("x", 0, 0), ("x", 1, 0), ("x", 2, 9), ("y", 0, 0), ("y", 2, 3), ("z", 0, 10), ("z", 1, 3), ("far", 1, 9), ("many", 1, 9), ("own", 0, 3), ("own", 1, 9)]
    support = frame([(c, f"path_{i}", n) for c, i, n in rows], "candidate string, template string, support int")
    templates = frame([(c, "path_0", 40, 90 if c != "far" else 601) for c in ("x", "y", "z", "far", "own")], "candidate string, template string, left int, right int")
    seqs = frame([(f"c{i}", "ACGTACGTACGTAC") for i in range(1, 7)], "name string, seq string")
    props = frame([("c2", 4, 6, "nmf", 0.9), ("c9", 0, 9, "nmf", 0.9)], "contig string, start int, end int, method string, score double")
    got, parts = T.correction(cand, support, props, seqs, templates=templates)
    want = {"x": ("unresolved", "insufficient_discriminating_evidence"), "y": ("split", "alternative_fragment_support"), "z": ("retain", "current_support"), "far": ("unresolved", "repeat_exceeds_fragment_span"), "many": ("unresolved", "too_many_competing_paths"), "own": ("retain", "current_support")}
    assert {r.candidate: (r.decision, r.reason) for r in got.collect()} == want
    assert parts.groupBy("name").count().where("count > 1").collect()[0].name == "c2"
    gated, _ = T.correction(cand, support, props, seqs, "require_all", ("nmf", "structural_lineage"), templates=templates)
    assert gated.where("candidate = 'y'").first().reason == "proposal_gate_not_met"
    assert tuple(T.proposal_audit(got, props).first()) == (2, 1, 1)


def test_greedy_clusters_without_names(frame):
    items = frame([("a", 5), ("b", 4), (None, 9)], "name string, length int")
    got = G.greedy_clusters(items, frame([("a", "b"), (None, "a")], "a string, b string"))
    assert {(r.member, r.representative) for r in got.collect()} == {("a", "a"), ("b", "a")}


def test_designs(spark, frame):
    pairs = frame([(1,), (2,), (3,)], "pair int")
    assert T.experiments(spark, pairs, [10.0], [1.0], [1, 2, 3]).count() == 27
    rows = {m: T.abundances(["a", "b", "c"], 2, m) for m in ("independent", "correlated", "constant", "sparse")}
    assert {v for *_, v in rows["constant"]} == {10.0} and len({v for s, _, v in rows["correlated"]}) == 2
    assert [v == 0 for *_, v in rows["sparse"]] == [True, False, False, False, False, True]
    assert [v for *_, v in rows["sparse"] if v] == [v for (*_, v), (*_, w) in zip(rows["independent"], rows["sparse"], strict=True) if w]
    assert T.ablation("combined")[0] == "require_all" and T.ablation("baseline")[0] == "annotate"
    assert {r.status for r in T.reconcile(frame([("A",)], "accession string"), frame([("B",)], "accession string")).collect()} == {"missing", "unexpected"}


def test_neighborhoods_and_memo(frame):
    seqs = frame([("c", "A" * 5000)], "name string, seq string")
    rows = frame([("c", 1000, 50), ("c", 1500, 50)], "contig string, cut int, repeat_length int")
    assert [tuple(r) for r in T.neighborhoods(rows, seqs, 600).collect()] == [("c", 350, 2100)]
    q = frame([("a", "MK"), ("b", "ML")], "id string, seq string")
    first = T.fresh_queries(q, frame([("x",)], "key string"), "s")
    assert first.count() == 2 and T.fresh_queries(q, first.where("id = 'a'"), "s").first().id == "b"


def test_alignment_atlas(frame):
    seqs = frame([("A", "ACGTACGTAC"), ("B", "GTACGTACGG")], "name string, seq string")
    tax = frame([("A", "1"), ("B", "2")], "name string, taxon string")
    cols = frame([(1, "A", "B", 2 + i, i, True) for i in range(8)], "hit int, contig string, source string, q int, s int, match boolean")
    got = {(r.accession, r.start, r.end, r.taxa, r.accessions) for r in T.alignment_atlas(cols, seqs, tax).collect()}
    assert got == {("A", 2, 10, "1;2", "A;B"), ("B", 0, 8, "1;2", "A;B")}


def test_latent_switch(frame):
    rows = []
    for i, mix in enumerate([(9, 1, 1), (8, 1, 1), (1, 9, 9), (1, 8, 9)]):
        rows += [(f"w{i}", "mixed" if i in (1, 2) else f"c{i}", 100 * (i == 2), 100 + 100 * (i == 2), f"s{j}", float(v)) for j, v in enumerate(mix)]
    got = T.latent_switches(frame(rows, "window_id string, contig string, start int, end int, sample string, value double")).collect()
    assert [(r.contig, r.start, r.end, r.method) for r in got] == [("mixed", 0, 200, "nmf")] and 0.5 <= got[0].score <= 1
    kind = "window_id string, contig string, start int, end int, sample string, value double"
    searched = T.latent_switches(frame(rows, kind), rank="auto").collect()
    assert [(r.contig, r.start, r.end) for r in searched] == [("mixed", 0, 200)]
    assert T.latent_switches(frame(rows, kind), max_iter=2).count() == 0
    for bad in ([r for r in rows if r[4] != "s2"], [(*r[:5], 1.0) for r in rows]):
        with pytest.raises(Exception, match="biological samples|variable profiles"):
            T.latent_switches(frame(bad, kind)).collect()


def test_local_templates(frame):
    segs = frame([("1", "A" * 100), ("2", "C" * 50), ("3", "G" * 70), ("4", "T" * 70), ("5", "AC" * 30)], "id string, seq string")
    links = frame([("1+", "2+", 0), ("5+", "2+", 0), ("2+", "3+", 0), ("2+", "4+", 0)], "src string, dst string, overlap int")
    cand = frame([("x", ["1+", "2+", "3+"], [["1+", "2+", "4+"]])], "candidate string, current array<string>, alternatives array<array<string>>")
    got = {r.template: (r.path, len(r.seq), r.left, r.right) for r in P.local_templates(cand, segs, links, 40).collect()}
    assert got["path_0"] == (["1+", "2+", "3+"], 130, 40, 90) and got["path_1"][0][-1] == "4+" and len(got) == 4
    assert P.local_templates(cand, segs, links, 40, 3).count() == 0


def test_coordinate_map(frame):
    segs = frame([(n, b * 100) for n, b in zip("1234", "ACGT", strict=True)], "id string, seq string")
    links = frame([("1+", "2+", 0), ("1+", "3+", 0), ("2+", "4+", 20), ("3+", "4+", 20)], "src string, dst string, overlap int")
    row = frame([("c", ["1+", "3+", "4+"], ["1+", "2+", "4+"], 0, 2)], "name string, path array<string>, original array<string>, left int, right int")
    got = [(r.output_start, r.output_end, r.original_start, r.operation) for r in P.coordinate_map(row, segs, links).orderBy("output_start").collect()]
    assert got == [(0, 100, 0, "retained"), (100, 200, None, "graph_replacement"), (200, 280, 200, "retained")]


def test_random_cuts_and_origins(frame):
    seqs = frame([(0, "a", "A" * 50), (1, "b", "C" * 20)], "ord long, name string, seq string")
    got = T.random_cuts(frame([("a", 5), ("a", 9), ("a", 9), ("b", 3)], "contig string, cut int"), seqs).collect()
    rng = random.Random(20260905)
    assert [(r.contig, r.cut) for r in got] == [("a", c) for c in rng.sample(range(1, 50), 2)] + [("b", c) for c in rng.sample(range(1, 20), 1)]
    lengths = frame([("a", 50), ("b", 20)], "name string, length int")
    origins = T.read_origins(frame([("r/1", "a", 95, "+", 10), ("r/2", "a", 3, "-", 10)], "read_id string, accession string, pos int, strand string, read_length int"), lengths)
    assert {(r.read_id, r.start, r.wraps_origin) for r in origins.collect()} == {("r/1", 45, True), ("r/2", 3, False)}
    assert {r.accession: r.coverage for r in T.realized_coverage(origins, lengths, 10).collect()} == {"a": 0.4, "b": 0.0}
