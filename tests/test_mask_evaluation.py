"""Arms of masks against classifying each arm's masked reference on its own."""

import random

import pytest

from seqlens import session
from seqlens.operators import mask_evaluation as M
from seqlens.operators import sharing as S

MASK = "arm string, accession string, start long, end long"


def _one_by_one(spark, queries, reference, taxonomy, masks, k, arm):
    """Predictions over the reference with an arm's mask rendered as N."""
    seqs = S.render_mask(reference, masks.where(f"arm = '{arm}'").drop("arm").groupBy("accession", "start").agg({"end": "max"}).withColumnRenamed("max(end)", "end")) if arm != M.UNMASKED else reference
    return S.predictions(queries, S.candidates(S.seed_hits(queries, seqs, k)), taxonomy)


def test_queries_keep_their_denominator(spark):
    """One query is shared by both references, one has no known word, one is all N; masking the second reference decides the first query."""
    reference = spark.createDataFrame([("A.1", "ACGTACGATCGGATCCGATTTTTTTTTT"), ("B.1", "ACGTACGATCGGATCCGATCCCCCCCC")], "name string, seq string")
    taxonomy = spark.createDataFrame([("A.1", "1"), ("B.1", "2")], "name string, taxon string")
    queries = spark.createDataFrame([("q1", "ACGTACGATCGGATCCGAT"), ("q2", "TTTTTTTT"), ("q3", "NNNNNNNN")], "name string, seq string")
    truth = spark.createDataFrame([("q1", "1", "u1"), ("q2", "2", "u2"), ("q3", "1", "u3")], "query string, taxon string, unit string")
    masks = spark.createDataFrame([("masked", "B.1", 0, 27)], MASK)
    units = M.evaluate_masks(queries, reference, taxonomy, truth, masks, 5).persist()
    whole = {r.arm: r for r in units.where("unit IS NULL").collect()}
    assert whole["unmasked"].total == 3 and [round(whole["unmasked"][c], 6) for c in ("ambiguous", "unclassified", "wrong")] == [0.333333, 0.333333, 0.333333]
    assert round(whole["masked"].correct, 6) == 0.333333 and whole["masked"].ambiguous == 0
    got = {r.effect: (r.units, r.mean) for r in M.compare_arms(units).collect()}
    assert got == {"wrong_reduction": (3, 0.0), "correct_change": (3, pytest.approx(1 / 3)), "unclassified_change": (3, 0.0)}
    for broken, said in ((truth.where("query <> 'q3'"), "unexpected prediction"), (truth.unionByName(truth.limit(1)), "repeated prediction"), (truth.withColumn("unit", truth.taxon.substr(5, 1)), "truth without a taxon or unit")):
        with pytest.raises(Exception, match=said):
            M.evaluate_masks(queries, reference, taxonomy, broken, masks, 5).collect()
    with pytest.raises(ValueError, match="unmasked"):
        M.evaluate_masks(queries, reference, taxonomy, truth, spark.createDataFrame([("unmasked", "A.1", 0, 1)], MASK))


def test_arms_equal_masked_references(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choices("ACGT", k=n))
    shared = [word(40) for _ in range(4)]
    reference = [(f"r{i}", word(30) + shared[i % 4] + word(30) + shared[(i + 1) % 4] + word(5) + shared[i % 4][:20]) for i in range(12)]
    queries = [(f"q{i}", s[a : a + 60]) for i, (_, s) in enumerate(reference) for a in [rng.randrange(60)]] + [("none", word(50)), ("short", "ACG"), ("null", None)]
    masks = [(arm, f"r{rng.randrange(12)}", a, a + rng.randrange(1, 70)) for arm in ("x", "y", "z") for _ in range(14) for a in [rng.randrange(120)]] + [("z", "unknown", 0, 9)]
    ref, q = spark.createDataFrame(reference, "name string, seq string"), spark.createDataFrame(queries, "name string, seq string")
    tax = spark.createDataFrame([(n, None if i == 5 else f"t{i % 3}") for i, (n, _) in enumerate(reference)], "name string, taxon string")
    m = spark.createDataFrame(masks, MASK)
    arms = [M.UNMASKED, "x", "y", "z"]
    got = M.arm_predictions(q, M.arm_hits(q, ref, m, arms, 11), tax, arms).collect()
    columns = ("query", "status", "taxon", "candidate_taxa", "unknown_taxonomy")
    for arm in arms:
        want = _one_by_one(spark, q, ref, tax, m, 11, arm).collect()
        assert sorted(repr([r[c] for c in columns]) for r in got if r.arm == arm) == sorted(repr([r[c] for c in columns]) for r in want), arm


def test_tables_of_words_go_before_the_arms_meet(spark, frame, tmp_path):
    """The runs of the reference's words, as large as the reference, are gone once the mask is known; masks are worked out once."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("ACGT") for _ in range(300)) for _ in range(4)]
    seqs = frame([(f"s{i}", texts[i] + texts[(i + 1) % 4][:80]) for i in range(4)], "name string, seq string")
    taxonomy = frame([(f"s{i}", f"t{i}") for i in range(4)], "name string, taxon string")
    before = set(session._written)
    got = S.shared_mask(seqs, taxonomy, 31).collect()
    left = [p for p in session._written if p not in before]
    assert len(got) >= 4 and not [p for p in left if "wordruns" in p] and len(left) == 1
