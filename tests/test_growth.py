"""Rows that must not travel, or be kept in one task, more often than the job needs."""

import random

import numpy as np
from pyspark.sql import functions as F

from seqlens.operators import catalog as G
from seqlens.operators import coverage as C
from seqlens.operators import design as D
from seqlens.operators import evaluate, graph
from seqlens.operators import intervals as I
from seqlens.operators import sharing as S
from seqlens.operators.skew import dealt

SAM = "sample string, qname string, flag int, rname string, pos int, mapq int, cigar string, score double, other double"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_records_of_fragments_travel_once(frame):
    rng, records = random.Random(5), []
    for q in range(300):
        for flag in (99, 147, *rng.choices((355, 403, 2147, 99, 1123, 73), k=rng.choice((0, 0, 0, 1, 2)))):
            cigar = rng.choice(("50M", "10M5I20M", "3S20M30D10M", "5M2D5M1I5M100N5M", "*", "0M"))
            records.append((rng.choice("xy"), f"q{q % 200}", flag, rng.choice(("c", "c", "c", "d", None)), rng.randrange(1, 60), rng.choice((60, 60, 60, 3)), cigar, rng.choice((0.0, -3.0, None)), rng.choice((None, None, -9.0, 0.0))))
    sam = frame(records, SAM)
    fragments = C.placed_fragments(sam, 20, ["sample"])
    assert exchanges(fragments) == 1 and exchanges(C.fragment_calls(sam, 20, ["sample"])) == 1
    got = C.placed_blocks(fragments, ["sample", "qname"])
    want = C.fragment_blocks(C.accepted_pairs(sam, 20, ["sample"]), ["sample"]).select("sample", "qname", "contig", "start", "end")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 20
    assert fragments.where("reason IS NULL").count() == C.accepted_pairs(sam, 20, ["sample"]).select("sample", "qname").distinct().count()


def test_units_read_their_members_once(spark, frame):
    seen = spark.sparkContext.accumulator(0)

    def told(x):
        seen.add(1)
        return x

    rows = frame([(f"n{i}", f"k{i % 7}", f"g{i % 5}") for i in range(50)], "name string, a string, b string")
    members = rows.select("name", F.udf(told)("a").alias("a"), "b")
    units = G.group_units(members, "name", ["a", "b"]).collect()
    assert seen.value == 50 and {r.unit for r in units} == {"n0"} and len(units) == 50


def _written(run, module=graph):
    """(name, table) of what a call writes to the shared folder."""
    plans, write = [], module.shared_table
    module.shared_table = lambda df, name: plans.append((name, df)) or write(df, name)
    try:
        run().collect()
    finally:
        module.shared_table = write
    return plans


def test_rounds_of_paths_read_edges_once_and_leave_finished_paths(spark, frame):
    links = frame([("a+", "z+", 0), ("a+", "b+", 0), ("b+", "c+", 0), ("c+", "d+", 0), ("d+", "z+", 0), ("s+", "s+", 0)], "src string, dst string, overlap int")
    ends = frame([("n", "a+", "z+"), ("one", "b+", "b+"), ("loop", "s+", "z+"), ("none", "z+", "a+")], "name string, left string, right string")
    got = []
    plans = _written(lambda: got.append(graph.bounded_paths(ends, links)) or got[0])
    assert sorted((r.name, r.path_no, ",".join(r.path)) for r in got[0].collect()) == [("n", 1, "a+,b+,c+,d+,z+"), ("n", 2, "a+,z+"), ("one", 1, "b+")]
    assert [n for n, _ in plans][:1] == ["edges"] and [n for n, _ in plans].count("edges") == 1
    rounds = [df.where("done").count() for n, df in plans if n == "frontier"]
    assert rounds == [2, 0, 0, 1]


def test_a_name_void_late_has_no_earlier_paths(frame):
    links = frame([("a+", "z+", 0), ("a+", "b+", 0), ("b+", "c+", 0), ("c+", "b+", 0)], "src string, dst string, overlap int")
    ends = frame([("n", "a+", "z+"), ("m", "a+", "c+")], "name string, left string, right string")
    assert [(r.name, r.path) for r in graph.bounded_paths(ends, links).collect()] == [("m", ["a+", "b+", "c+"])]
    fan = frame([("a+", f"x{i}+", 0) for i in range(4)] + [(f"x{i}+", "z+", 0) for i in range(4)] + [("a+", "z+", 0)], "src string, dst string, overlap int")
    assert graph.bounded_paths(ends.where("name = 'n'"), fan, max_paths=4).count() == 0 and graph.bounded_paths(ends.where("name = 'n'"), fan, max_paths=5).count() == 5
    assert graph.bounded_paths(ends.where("name = 'n'"), fan, max_states=9).count() == 0 and graph.bounded_paths(ends.where("name = 'n'"), fan, max_states=10).count() == 5


def test_both_ways_of_a_link_are_made_from_one_row(spark, frame):
    seen = spark.sparkContext.accumulator(0)

    def told(x):
        seen.add(1)
        return x

    rows = frame([(f"{i}+", f"{i + 1}+", 0) for i in range(20)], "src string, dst string, overlap int")
    made = rows.select(F.udf(told)("src").alias("src"), "dst", "overlap")
    assert graph.both_ways(made).count() == 40 and seen.value == 20
    assert {tuple(r) for r in graph.oriented(frame([("1", "AAC")], "id string, seq string")).collect()} == {("1+", "AAC"), ("1-", "GTT")}


def test_dealt_rows_of_a_task_stay_the_same_when_rows_grow(spark):
    most = lambda n: dealt(spark.range(n), ["id"], 500).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most(4_000) < 900 and most(32_000) < 900


def test_blocks_of_contigs_are_written_once(spark, frame):
    contigs = frame([("a", 100), ("b", 100), ("c", 100), ("d", 100)], "contig string, length int")
    runs = frame([("a", "s", 0, 60), ("a", "t", 60, 100), ("b", "s", 0, 100), ("b", "t", 0, 50), ("d", "s", 0, 100), ("d", "t", 0, 100)], "contig string, source string, start int, end int")
    got = []
    plans = _written(lambda: got.append(evaluate.interval_calls(contigs, runs, 10, 0.9)) or got[0][0], evaluate)
    assert [n for n, _ in plans] == ["blocks"]
    assert sorted(map(tuple, got[0][0].collect())) == [("a", 100, "chimeric", None, 1), ("b", 100, "consistent", "s", 0), ("c", 100, "unaligned", None, 0), ("d", 100, "ambiguous", None, 0)]
    assert [tuple(r) for r in got[0][1].collect()] == [("a", "s", "t", 60, 60)]


def test_translation_is_not_a_loop_over_codons():
    from time import process_time

    from seqlens.operators.reads import CODONS, translate

    rng = random.Random(3)
    plain = lambda s: "".join(CODONS.get(s[i : i + 3], "X") for i in range(0, len(s) - 2, 3))
    for n in (0, 1, 2, 3, 4, 5, 300, 1000):
        text = "".join(rng.choice("ACGTACGTACGTNacgté\U0001f9ec?*") for _ in range(n))
        assert translate(text) == plain(text)
    long = "".join(rng.choices("ACGT", k=600_000))
    t = process_time()
    want = plain(long)
    slow, t = process_time() - t, process_time()
    assert translate(long) == want and (process_time() - t) * 3 < slow


def test_blocks_of_a_matrix_fit_as_the_whole(frame, monkeypatch):
    rng = np.random.default_rng(1)
    x, w = rng.random((23, 2)) @ rng.random((2, 5)) / 2, np.where(np.arange(23)[:, None] < 12, 0.2, rng.random((23, 5)))
    w[20, 3] = 0
    rows = frame([(f"e{i:02}", "b", f"f{j}", float(x[i, j]), float(w[i, j])) for i in range(23) for j in range(5)], "entity string, block string, feature string, x double, weight double")
    monkeypatch.setattr(D, "ONE_TASK", 20)
    monkeypatch.setattr(D, "BLOCK", 20)
    monkeypatch.setattr(D, "KEPT", 4)
    got = {(r.seed, r.entity, r.component): r for r in D.multiview(rows, 2, (0, 3), 10, 1e-9).collect()}
    assert len(got) == 2 * 23 * 2
    for seed in (0, 3):
        left, _, loss, _ = D.factorize(x, w, 2, seed, 10, 1e-9)
        want = D.loadings(left)
        for i in range(23):
            for c in range(2):
                r = got[seed, f"e{i:02}", c]
                assert abs(r.loading - want[i, c]) < 1e-9 and abs(r.loss - loss) < 1e-9


def test_only_words_of_queries_leave_the_reference(frame, monkeypatch):
    rng, tables, make = random.Random(7), [], S.kmer_table
    text = lambda n: "".join(rng.choices("ACGT", k=n))
    part = text(90)
    reference = frame([("t1", text(500) + part + text(300)), ("t2", part[20:70] + "N" + part[:40]), ("t3", text(900)), ("t4", "AC"), ("t5", None)], "name string, seq string")
    queries = frame([("q1", part), ("q2", part[::-1].translate(str.maketrans("ACGT", "TGCA"))[10:60]), ("q3", "ACG")], "name string, seq string")
    monkeypatch.setattr(S, "kmer_table", lambda *a, **k: tables.append(make(*a, **k)) or tables[-1])
    rows = lambda: sorted(map(tuple, S.seed_hits(queries, reference, 31).collect()))
    got, made = rows(), tables[-1].count()
    assert {(q, t) for q, t, _ in got} == {("q1", "t1"), ("q2", "t1"), ("q1", "t2"), ("q2", "t2")} and dict(((q, t), n) for q, t, n in got)["q1", "t1"] == 60
    monkeypatch.setattr(S, "ASKED", 5)
    assert rows() == got and made == 60 + 30 and tables[-1].count() > 1000
    assert S.seed_hits(queries.where("name = 'q3'"), reference, 31).count() == 0


def test_runs_of_a_key_never_meet_its_segments(spark, frame, monkeypatch):
    rng, seen = random.Random(11), []
    rows = [(rng.choice(("k", "k", "k", "l", None)), rng.choice(("a", "b", "c", None)), s, s + rng.choice((-3, 0, 1, 5, 40))) for s in (rng.randrange(60) for _ in range(150))]
    rows += [("k", "a", None, 7), ("k", "a", 7, None), ("m", None, 3, 9)]
    sweep = I._swept
    monkeypatch.setattr(I, "_swept", lambda n: seen.append(n) or sweep(n))
    got = I.sweep_segments(frame(rows, "key string, m string, start int, end int"), ["key"], "m").collect()
    want = {}
    for key in "klm":
        mine = [r for r in rows if r[0] == key]
        ends = sorted({p for r in mine for p in r[2:] if p is not None})
        for a, b in zip(ends, ends[1:]):
            held = [m for _, m, s, e in mine if s is not None and e is not None and s <= a and b <= e]
            if held:
                want[key, a, b] = sorted({m for m in held if m is not None})
    assert {(r.key, r.seg_start, r.seg_end): r.members for r in got} == want and len(got) == len(want) and seen == [1]


def test_plans_of_a_fit_do_not_grow_with_its_rounds(frame, monkeypatch):
    rng, plans = np.random.default_rng(2), []
    x = rng.random((12, 4))
    rows = frame([(f"e{i:02}", "b", f"f{j}", float(x[i, j]), 1.0) for i in range(12) for j in range(4)], "entity string, block string, feature string, x double, weight double")
    for name, value in (("ONE_TASK", 20), ("BLOCK", 20), ("KEPT", 1)):
        monkeypatch.setattr(D, name, value)
    first = type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or first(df))
    D.multiview(rows, 2, (0,), 4, 1e-12)
    plans = [p for p in plans if "up#" in p]
    assert len(plans) == 5 and max(map(len, plans)) < 1.2 * min(map(len, plans)) and all(p.count("InMemoryRelation") == 1 for p in plans)
