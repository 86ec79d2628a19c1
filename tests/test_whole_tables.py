"""Registered queries cover every row of their tables: compared with plain loops that leave nothing out."""

import datetime
from collections import defaultdict

import pandas as pd

from seqlens.plans import catalog

SF = "/root/testdata/sf0.001"


def _table(name: str) -> pd.DataFrame:
    return pd.read_parquet(f"{SF}/{name}.parquet")


def test_sweep_atlas_sweeps_all_events(spark):
    runs = defaultdict(list)
    for e in _table("events").itertuples():
        start = (e.ts - pd.Timestamp(datetime.datetime(2024, 1, 1))) // pd.Timedelta(hours=1)
        runs[f"u{e.user_id}"].append((start, start + 1 + int(e.value // 10), e.event_type))
    want = set()
    for user, own in runs.items():
        at = sorted({p for a, b, _ in own for p in (a, b)})
        for a, b in zip(at, at[1:]):
            if members := {k for s, e, k in own if s <= a and e >= b}:
                want.add((user, a, b, ";".join(sorted(members))))
    got = [tuple(r) for r in catalog.queries()["sweep_atlas"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want


def _loop_calls() -> tuple[dict, set, dict]:
    """(calls by contig, breakpoints, hits by contig) over every order, base by base."""
    hits, length = defaultdict(list), defaultdict(int)
    for r in _table("lineitem").itertuples():
        a, size = r.l_partkey % 300 - 1, int(r.l_quantity) * 6 + 1
        length[r.l_orderkey] = max(length[r.l_orderkey], a + size)
        if 100 - round(float(r.l_tax) * 25, 6) >= 98 and size >= 50 and a >= 0:
            hits[r.l_orderkey].append((f"s{r.l_suppkey % 5}", a, a + size))
    calls, breaks = {}, set()
    for contig, n in length.items():
        cover = defaultdict(set)
        for s, a, b in hits[contig]:
            cover[s] |= set(range(a, b))
        alone = {s: c - set().union(*(x for t, x in cover.items() if t != s)) for s, c in cover.items()}
        full = sorted(s for s, c in cover.items() if len(c) / n >= 0.9)
        blocks = []
        for s, c in cover.items():
            for a in sorted(q for q in c if q - 1 not in c):
                b = next(q for q in range(a, n + 2) if q not in c)
                if (u := alone[s] & set(range(a, b))) and b - a >= 50:
                    blocks.append((min(u), max(u), s, a, b))
        found = []
        for (_, u1, s, _, e), (r0, _, t, a, _) in zip(sorted(blocks), sorted(blocks)[1:]):
            if s != t and u1 < r0 and a - e <= 10 and not full:
                found.append((contig, s, t, u1 + 1, r0))
        breaks |= set(found)
        status = "unaligned" if not cover else "ambiguous" if len(full) > 1 or full and not alone[full[0]] else "consistent" if full else "chimeric" if found else "ambiguous"
        calls[contig] = (contig, n, status, full[0] if status == "consistent" else None, len(found))
    return calls, breaks, hits


def test_chimera_calls_and_metrics_cover_all_orders(spark):
    calls, breaks, hits = _loop_calls()
    q = catalog.queries()
    assert {r.contig: tuple(r) for r in q["chimera_calls"](spark, SF).collect()} == calls
    assert sorted(tuple(r) for r in q["breakpoints"](spark, SF).collect()) == sorted(breaks)
    for r in q["assembly_metrics"](spark, SF).collect():
        kept = {c: x for c, x in calls.items() if x[1] >= r.cutoff}
        covered = {(s, p) for c in kept for s, a, b in hits[c] for p in range(a, b)}
        run, total, n50 = 0, sum(x[1] for x in kept.values()), 0
        for n in sorted((x[1] for x in kept.values()), reverse=True):
            run += n
            if run * 2 >= total:
                n50 = n
                break
        assert (r.contigs, r.chimeric_contigs, r.ambiguous_contigs, r.wrong_connections) == (len(kept), *(sum(x[2] == s for x in kept.values()) for s in ("chimeric", "ambiguous")), sum(x[4] for x in kept.values()))
        assert (r.total_contig_bp, r.n50, r.longest_aligned_block_bp) == (total, n50, max(b - a for c in kept for _, a, b in hits[c]))
        assert abs(r.genome_recovery - len(covered) / 3000) < 1e-5 and abs(r.chimera_rate - r.chimeric_contigs / len(kept)) < 1e-5


def test_read_qc_reads_whole_texts(spark):
    got = {r.doc_id: r for r in catalog.queries()["read_qc"](spark, SF).collect()}
    docs = _table("documents")
    assert len(got) == len(docs) and docs.text.str.len().max() > 150
    for d in docs.itertuples():
        q = [c for c in d.text if "!" <= c <= "~"]
        mean = sum(ord(c) - 33 for c in q) / len(q) if q else 0.0
        n = sum(c in "nN" for c in q) / len(q) if q else 0.0
        r = got[d.doc_id]
        assert abs(r.mean_phred - mean) < 1e-5 and abs(r.n_fraction - n) < 1e-5
        assert r.reason == ("short" if len(q) < 50 else "low_quality" if mean < 60 else "ambiguous" if n > 0.1 else "pass")


def test_hit_summary_takes_odd_and_even_lines(spark):
    known = {t for t in _table("supplier").s_suppkey if t % 11}
    hits = defaultdict(list)
    for r in _table("lineitem").itertuples():
        qcov = 0.4 + float(r.l_discount) * 6
        if r.l_quantity > 10 and min(qcov, 0.9) >= 0.5:
            hits[r.l_orderkey].append((float(r.l_extendedprice), r.l_suppkey, qcov, 1 - float(r.l_tax) * 4))
    got = {r["query"]: r for r in catalog.queries()["hit_summary"](spark, SF).collect()}
    assert set(got) == set(hits)
    for q, own in hits.items():
        rivals = [h for h in own if h[0] >= max(own)[0] * 0.5]
        origins = {("viral", "cellular", "uncertain")[t % 3] if t in known else "uncertain" for _, t, _, _ in rivals}
        lines = {f"L{t % 4}" if t in known else "" for _, t, _, _ in rivals}
        sure = len(origins) == 1 and origins != {"uncertain"}
        assert got[q].origin == (min(origins) if sure else "uncertain") and got[q].lineage == (min(lines) if len(lines) == 1 else "")
        assert abs(got[q].confidence - (min(h[2] for h in rivals) if sure else 0)) < 1e-9
        assert got[q].close == any(f >= 0.8 and c >= 0.8 for _, _, c, f in own)
