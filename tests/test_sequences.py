import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqlens.functions import sequence as X
from seqlens.operators import intervals as I
from seqlens.operators import masks as M
from seqlens.operators import sharing as S

A, B = "ACGTTGCA", "TGCAACGT"


def _value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_scalar_functions(spark):
    lit = F.lit
    assert _value(spark, X.revcomp(lit("ACGTRYN"))) == "NRYACGT"
    assert _value(spark, X.canonical(lit("TTT"))) == "AAA"
    assert _value(spark, X.flip(lit("12+"))) == "12-"
    assert _value(spark, X.fragment_id(lit("r/2"))) == "r"
    assert _value(spark, X.gc_fraction(lit("GGAN"))) == pytest.approx(2 / 3)
    assert _value(spark, X.ambiguous_fraction(lit("GGAN"))) == 0.25
    assert _value(spark, X.mean_phred(lit("!I"))) == 20
    assert _value(spark, X.entropy(lit("ACGT"))) == pytest.approx(2)
    assert _value(spark, X.low_complexity(lit("AAAAAAC")))
    assert _value(spark, X.cigar_length(lit("10M2D5I3M"))) == 15
    assert [tuple(b) for b in _value(spark, X.cigar_blocks(lit(5), lit("3S10M2D4M")))] == [(5, 15), (17, 21)]
    assert _value(spark, X.cigar_ops(lit("10Q"))) is None


@pytest.mark.parametrize("k", [3, 5, 31])
def test_kmers_against_plain_loop(spark, frame, k):
    rng = random.Random(k)
    texts = {f"s{i}": "".join(rng.choice("ACGTN" if i % 2 else "ACGT") for _ in range(rng.randrange(0, 120))) for i in range(12)}
    want = Counter()
    for name, t in texts.items():
        for i in range(len(t) - k + 1):
            w = t[i : i + k]
            if set(w) <= set("ACGT"):
                r = w.translate(str.maketrans("ACGT", "TGCA"))[::-1]
                want[name, min(w, r)] += 1
    got = X.kmer_table(frame(list(texts.items()), "name string, seq string"), k)
    rows = got.select("name", X.kmer_word(F.col("code"), k).alias("w"), "n", "low").collect()
    assert {(r.name, r.w): r.n for r in rows} == want
    for r in rows:
        h = -sum(n / k * math.log2(n / k) for n in Counter(r.w).values())
        assert r.low == (h < 1.5) or abs(h - 1.5) < 1e-9


def test_circular_atlas(frame):
    seqs = frame([("A", A, True), ("B", B, True)], "name string, seq string, circular boolean")
    tax = frame([("A", "1"), ("B", "2")], "name string, taxon string")
    rows = S.atlas(seqs, tax, 5, circular="circular").collect()
    assert {(r.start, r.end) for r in rows if r.evidence_id == "A:6:5"} == {(6, 8), (0, 3)}
    assert {r.taxa_count for r in rows} == {2}


def test_pairs_by_blocks_of_holders(frame, monkeypatch):
    monkeypatch.setattr(S, "HOLDERS", 3)
    rng = random.Random(3)
    texts = {f"s{i}": "".join(rng.choices("ACGT", k=14)) for i in range(18)}
    words = {n: Counter(min(t[i : i + 3], t[i : i + 3].translate(str.maketrans("ACGT", "TGCA"))[::-1]) for i in range(12)) for n, t in texts.items()}
    want = {}
    for a in words:
        for b in words:
            both = words[a].keys() & words[b].keys()
            if a < b and both:
                want[a, b] = (len(both), sum(words[a][w] > 1 or words[b][w] > 1 for w in both))
    got = S.pair_sharing(frame(list(texts.items()), "name string, seq string"), 3, 1).collect()
    assert len(got) == len(want) and {(r.a, r.b): (r.shared, r.repeated) for r in got} == want


def test_unknown_taxonomy_blocks_a_mask(frame):
    seqs = frame([("A", A), ("B", A), ("C", A)], "name string, seq string")
    tax = frame([("A", "1"), ("B", "2"), ("C", None)], "name string, taxon string")
    rows = S.atlas(seqs, tax, 5)
    assert S.mask_intervals(rows, include_low=True).count() == 0
    assert S.mask_intervals(S.atlas(seqs.where("name <> 'C'"), tax, 5), include_low=True).count() == 2


def test_merge_touching_and_union(frame):
    rows = frame([("a", 2, 7), ("a", 5, 10), ("a", 10, 12), ("a", 20, 21), ("b", 1, 2)], "k string, start int, end int")
    assert sorted(map(tuple, I.merge_intervals(rows, ["k"]).collect())) == [("a", 2, 12), ("a", 20, 21), ("b", 1, 2)]
    assert {r.k: r.bases for r in I.union_length(rows, ["k"]).collect()} == {"a": 11, "b": 1}


def test_windows_stop_at_the_end(frame):
    seqs = frame([("a", "A" * 25)], "name string, seq string")
    assert [(r.start, r.end) for r in I.sequence_windows(seqs, 10, 5).orderBy("start").collect()] == [(0, 10), (5, 15), (10, 20), (15, 25)]
    with pytest.raises(ValueError):
        I.sequence_windows(seqs, 5, 6)


def test_mask_round_trip(frame):
    seqs = frame([("a", "ACGTACGTACGT"), ("b", "ACGT")], "name string, seq string")
    iv = frame([("a", 2, 7), ("a", 5, 10)], "accession string, start long, end long")
    for kind in ("hard", "soft"):
        view = S.render_mask(seqs, I.merge_intervals(iv, ["accession"]), kind)
        assert [tuple(r) for r in M.import_masked(seqs, view, kind).collect()] == [("a", 2, 10)]
    with pytest.raises(ValueError):
        M.import_masked(seqs, frame([("a", "TCGTACGTACGT"), ("b", "ACGT")], "name string, seq string"), "hard")


def test_random_control_keeps_widths(frame):
    seqs = frame([(0, "a", "A" * 60), (1, "b", "C" * 30)], "ord long, name string, seq string")
    iv = frame([("a", 2, 7), ("a", 10, 13), ("b", 1, 5)], "accession string, start long, end long")
    got = M.random_control(iv, seqs).collect()
    widths = lambda a: sorted(r.end - r.start for r in got if r.accession == a)
    assert widths("a") == [3, 5] and widths("b") == [4]
    a = sorted((r.start, r.end) for r in got if r.accession == "a")
    assert a[0][1] < a[1][0] and a[1][1] <= 60


def test_classifier_needs_one_known_taxon(frame):
    ref = frame([("A", "ACGTTGCATT"), ("B", "ACGTTGCAGG")], "name string, seq string")
    q = frame([("shared", "ACGTTGCA"), ("own", "TTGCATT"), ("none", "CCCCCCC")], "name string, seq string")
    tax = frame([("A", "1"), ("B", "2")], "name string, taxon string")
    cands = S.candidates(S.seed_hits(q, ref, 5))
    got = {r.query: (r.status, r.taxon) for r in S.predictions(q, cands, tax).collect()}
    assert got == {"shared": ("ambiguous", None), "own": ("assigned", "1"), "none": ("unclassified", None)}
    units = S.classification_units(frame([("u", "assigned", "1", "1"), ("u", "ambiguous", None, "1"), ("u", "unclassified", None, "2")], "unit string, status string, taxon string, truth string"))
    assert {r.unit: (r.total, r.correct, r.precision) for r in units.collect()} == {"u": (3, 1 / 3, 1.0), None: (3, 1 / 3, 1.0)}


def test_split_keeps_bases(frame):
    seqs = frame([("a", "ACGTACGTAA")], "name string, seq string")
    parts = I.split_at_cuts(seqs, frame([("a", 4), ("a", 10), ("a", 0)], "name string, cut int")).orderBy("part").collect()
    assert [(p.part, p.start, p.end) for p in parts] == [(1, 0, 4), (2, 4, 10)] and "".join(p.text for p in parts) == "ACGTACGTAA"
