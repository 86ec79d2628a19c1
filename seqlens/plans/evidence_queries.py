"""Queries over intervals, coverage, pair evidence and hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.functions import sequence as X
from seqlens.operators import coverage as C
from seqlens.operators import evidence as E
from seqlens.operators import intervals as I
from seqlens.operators import sharing as S
from seqlens.plans.adapters import COV_SQL, HIT_SQL, IV_SQL, SEQ_SQL, coverage, hits, intervals, sequences, table

DIGITS = 6


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merge_intervals(intervals(spark, sf_dir), ["accession"], spread=True)


def union_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.union_length(intervals(spark, sf_dir), ["accession"], spread=True)


def interval_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = intervals(spark, sf_dir)
    return E.linked_bases(E.link_annotations(iv.where("kind <> 'error'"), iv.where("kind = 'error'").select("accession", "start", "end")), ["accession", "kind"])


def joint_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = intervals(spark, sf_dir)
    rows = iv.select("start", "end", F.when(F.col("id") % 3 == 0, "ambiguous").when(F.col("id") % 3 == 1, "informative").otherwise("unknown").alias("classification"), F.when(F.col("id") % 5 < 2, "chimeric").when(F.col("id") % 5 < 4, "consistent").otherwise("unknown").alias("assembly"))
    return E.joint_bases(rows, "classification", "assembly")


def observation_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.overlapping_observations(intervals(spark, sf_dir), ["accession", "kind"]).groupBy("accession", "kind").agg(F.count(F.lit(1)).alias("n"))


def sweep_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.sweep_segments(intervals(spark, sf_dir), ["accession"], "kind").select("accession", "seg_start", "seg_end", F.array_join("members", ";").alias("members"))


def coverage_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(spark, sf_dir).withColumn("value", F.round("value", DIGITS))


def coverage_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.normalize(coverage(spark, sf_dir)).select("contig", "window", "sample", F.round("normalized", DIGITS).alias("normalized"))


def replicate_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.replicate_mean(coverage(spark, sf_dir), ["contig", "window"]).withColumn("mean", F.round("mean", DIGITS))


def coverage_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = C.replicate_mean(coverage(spark, sf_dir), ["contig", "window"])
    p = m.select("contig", (F.col("window") * 500).alias("start"), (F.col("window") * 500 + 500).alias("end"), "biological_sample", F.col("mean").alias("value"))
    return C.change_proposals(p, "biological_sample", 0.1).withColumn("score", F.round("score", DIGITS))


def pair_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    pos = F.col("l_partkey") % 60
    mates = F.explode(F.array(F.lit(0), F.lit(1)))
    rows = li.select(F.col("l_orderkey").alias("fragment"), F.concat(F.lit("path_"), F.col("l_linenumber") % 3).alias("template"), pos.alias("p0"), (pos + 80 + F.col("l_suppkey") % 40).alias("p1"), (F.col("l_suppkey") % 30).cast("int").alias("score"), (F.col("l_partkey") % 97 == 0).alias("dup"), mates.alias("mate"))
    one = F.col("mate") == 0
    sam = rows.select("fragment", "template", (F.when(one, F.lit(64 + 2)).otherwise(F.lit(128 + 2 + 16)) + F.when(F.col("dup"), 1024).otherwise(0)).alias("flag"), F.when(one, F.col("p0")).otherwise(F.col("p1")).alias("pos"), F.when(one, F.col("p1")).otherwise(F.col("p0")).alias("mate_pos"), F.lit("50M").alias("cigar"), "score")
    bounds = spark.createDataFrame([("path_0", 60, 100), ("path_1", 60, 100), ("path_2", 60, 100), ("path_3", 60, 100)], "template string, left int, right int")
    return E.pair_support(sam, bounds, 2)[0]


def split_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cands = li.groupBy(F.col("l_suppkey").alias("contig"), (F.col("l_partkey") % 5 * 100).alias("cut")).agg(F.count_if(F.col("l_returnflag") == "N").alias("current"), F.count_if(F.col("l_returnflag") == "R").alias("alternative"))
    props = li.select(F.col("l_suppkey").alias("contig"), (F.col("l_partkey") % 400).alias("start"), (F.col("l_partkey") % 400 + 3).alias("end"), F.col("l_linestatus").alias("method"), (F.col("l_discount") * 10).alias("score"))
    got = E.gated_decisions(cands, props, "require_any", (), 0.5, 3, 0.5)
    return got.select("contig", "cut", "current", "alternative", F.array_join("methods", ";").alias("methods"), "read_decision", "decision")


def split_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = sequences(spark, sf_dir)
    cuts = seqs.select("name", F.explode(F.array(F.lit(100), F.lit(700), F.lit(701))).alias("cut"))
    parts = I.split_at_cuts(seqs, cuts)
    return parts.select("name", "part", "start", "end", F.md5(F.col("text").cast("binary")).alias("digest"))


def hit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(table(spark, sf_dir, "lineitem"), _labels(spark, sf_dir))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target")).where("target % 11 <> 0")
    return n.select("target", F.when(F.col("target") % 3 == 0, "viral").when(F.col("target") % 3 == 1, "cellular").otherwise("uncertain").alias("origin"), F.concat(F.lit("L"), F.col("target") % 4).alias("lineage"), F.concat(F.lit("F"), F.col("target") % 5).alias("family"), F.when(F.col("target") % 2 == 0, "true").otherwise("no").alias("hallmark"))


def _summary(li: DataFrame, labels: DataFrame) -> DataFrame:
    h = li.select(F.col("l_orderkey").alias("query"), F.col("l_suppkey").alias("target"), (1 - F.col("l_tax") * 4).alias("fident"), (F.lit(0.4) + F.col("l_discount") * 6).alias("qcov"), F.lit(0.9).alias("tcov"), F.when(F.col("l_quantity") > 10, 1e-5).otherwise(1.0).alias("evalue"), F.col("l_extendedprice").alias("bits"))
    return E.hit_summary(h, labels, fraction=0.5)


def orf_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir).drop("start", "end", "protein_id")


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    orfs = o.select(F.col("o_orderkey").alias("orf_id"), F.col("o_orderkey").alias("protein_id"), (F.col("o_custkey") % 50).alias("contig"), (F.col("o_orderkey") * 10).alias("start"), (F.col("o_orderkey") * 10 + 9).alias("end"))
    li, labels = table(spark, sf_dir, "lineitem"), _labels(spark, sf_dir)
    # odd and even lines stand for the two searches, by sequence and by structure
    even, odd = (_summary(li.where(F.col("l_linenumber") % 2 == parity), labels) for parity in (0, 1))
    return E.orf_profiles(orfs, even, odd)


def contig_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.contig_novelty(_profiles(spark, sf_dir))


def flank_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.flank_switches(_profiles(spark, sf_dir), "origin", 1, 0.4).withColumn("score", F.round("score", DIGITS))


def discovery_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    la = table(spark, sf_dir, "labels")
    p = la.select(F.col("doc_id").alias("orf_id"), (F.col("quality") == 0).alias("sequence_related"), (F.col("toxic") == 1).alias("structural_related"))
    motifs = la.where("doc_id % 4 < 2").select(F.col("doc_id").alias("orf_id"), F.when(F.col("doc_id") % 3 == 0, "supported").otherwise("unsupported").alias("status"))
    more = la.where("doc_id % 8 = 0").select(F.col("doc_id").alias("orf_id"), F.lit("supported").alias("status"))
    context = la.where("doc_id % 5 = 0").select(F.col("doc_id").alias("orf_id"), F.lit("supported").alias("status"))
    return E.discovery_cards(p, motifs.unionByName(more), context, True, True)


def domain_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orf_id"), (F.col("o_orderkey") * 3).alias("start"), (F.col("o_orderkey") * 3 + 600).alias("end"), F.when(F.col("o_custkey") % 2 == 0, "+").otherwise("-").alias("strand"))
    h = li.select(F.col("l_orderkey").alias("orf_id"), F.col("l_linenumber").alias("hit"), (F.col("l_partkey") % 100).alias("aa_start"), (F.col("l_partkey") % 100 + 20).alias("aa_end"))
    return E.project_domains(o, h).select("orf_id", "hit", "nt_start", "nt_end")


def read_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    q = F.regexp_replace("text", "[^!-~]", "")
    rows = d.select("doc_id", q.alias("q"))
    mean, n = X.mean_phred(F.col("q")), X.n_fraction(F.col("q"))
    poor = F.when(F.length("q") < 50, "short").when(mean < 60, "low_quality").when(n > 0.1, "ambiguous").otherwise("pass")
    return rows.select("doc_id", F.round(mean, DIGITS).alias("mean_phred"), F.round(n, DIGITS).alias("n_fraction"), poor.alias("reason"))


def external_hits_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.best_hits(hits(spark, sf_dir).withColumnRenamed("bits", "score"))


def classification_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    la, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    rows = d.join(la, "doc_id").select(F.col("source").alias("unit"), F.when(F.col("doc_id") % 7 == 0, "ambiguous").when(F.col("doc_id") % 11 == 0, "unclassified").otherwise("assigned").alias("status"), F.col("toxic").alias("taxon"), F.col("quality").alias("truth"))
    out = S.classification_units(rows)
    return out.select(F.coalesce("unit", F.lit("*")).alias("unit"), "total", *[F.round(c, DIGITS).alias(c) for c in ("correct", "wrong", "ambiguous", "unclassified", "precision")])


_MERGED = """SELECT accession, min(start) AS start, max("end") AS "end" FROM (
  SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY accession ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, max("end") OVER (PARTITION BY accession ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
    FROM (SELECT DISTINCT accession, start, "end" FROM {src}))) GROUP BY accession, island"""
_SUM = """(SELECT query, CASE WHEN len(o) = 1 AND o[1] IN ('viral', 'cellular') THEN o[1] ELSE 'uncertain' END AS origin, CASE WHEN len(l) = 1 THEN l[1] ELSE '' END AS lineage,
  CASE WHEN len(f) = 1 THEN f[1] ELSE '' END AS family, len(o) = 1 AND o[1] = 'viral' AND hm AS hallmark,
  CASE WHEN len(o) = 1 AND o[1] IN ('viral', 'cellular') THEN c ELSE 0.0::DOUBLE END AS confidence, close FROM (
  SELECT query, list(DISTINCT coalesce(origin, 'uncertain')) FILTER (rival) AS o, list(DISTINCT coalesce(lineage, '')) FILTER (rival) AS l, list(DISTINCT coalesce(family, '')) FILTER (rival) AS f,
    bool_and(coalesce(hallmark, '') = 'true') FILTER (rival) AS hm, min(qcov) FILTER (rival) AS c, bool_or(fident >= 0.8 AND qcov >= 0.8) AS close
  FROM (SELECT h.*, bits >= max(bits) OVER (PARTITION BY query) * 0.5 AS rival FROM (
    SELECT l_orderkey AS query, l_suppkey AS target, 1 - l_tax * 4 AS fident, 0.4::DOUBLE + l_discount * 6 AS qcov, l_extendedprice AS bits FROM lineitem
    WHERE {lines} l_quantity > 10 AND least(0.4::DOUBLE + l_discount * 6, 0.9::DOUBLE) >= 0.5) h) LEFT JOIN lab USING (target) GROUP BY query))"""
_LAB = """lab AS (SELECT s_suppkey AS target, CASE s_suppkey % 3 WHEN 0 THEN 'viral' WHEN 1 THEN 'cellular' ELSE 'uncertain' END AS origin, 'L' || (s_suppkey % 4) AS lineage,
  'F' || (s_suppkey % 5) AS family, CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'no' END AS hallmark FROM supplier WHERE s_suppkey % 11 <> 0)"""
_PROF = f"""{_LAB}, p0 AS (SELECT o_orderkey AS orf_id, o_custkey % 50 AS contig, o_orderkey * 10 AS start, o_orderkey * 10 + 9 AS "end",
  q.query IS NOT NULL AS qrel, t.query IS NOT NULL AS trel, coalesce(q.origin, 'uncertain') AS qo, coalesce(t.origin, 'uncertain') AS tor, q.lineage AS ql, t.lineage AS tl, coalesce(q.family, '') AS qf, coalesce(t.family, '') AS tf,
  coalesce(q.hallmark, FALSE) AS qh, coalesce(t.hallmark, FALSE) AS th, q.confidence AS qc, t.confidence AS tc, coalesce(q.close, FALSE) AS qcl
  FROM orders LEFT JOIN {_SUM.format(lines='l_linenumber % 2 = 0 AND')} q ON q.query = o_orderkey LEFT JOIN {_SUM.format(lines='l_linenumber % 2 = 1 AND')} t ON t.query = o_orderkey
), prof AS MATERIALIZED (SELECT orf_id, contig, start, "end", origin, CASE WHEN origin <> 'uncertain' AND len(ls) = 1 THEN ls[1] ELSE '' END AS lineage, qf AS sequence_family, tf AS structure_family,
  qrel AS sequence_related, qcl AS sequence_close, trel AS structural_related, trel AND NOT qrel AS structural_only,
  origin = 'viral' AND ((qo <> 'uncertain' AND qh) OR (tor <> 'uncertain' AND th)) AS hallmark, coalesce(least(CASE WHEN qo <> 'uncertain' THEN qc END, CASE WHEN tor <> 'uncertain' THEN tc END), 0.0) AS confidence
  FROM (SELECT *, list_distinct(list_filter([CASE WHEN qo <> 'uncertain' THEN ql END, CASE WHEN tor <> 'uncertain' THEN tl END], lambda x: x IS NOT NULL AND x <> '')) AS ls,
    CASE WHEN (qrel AND qo = 'uncertain') OR (trel AND tor = 'uncertain') THEN 'uncertain' WHEN qo <> 'uncertain' AND tor <> 'uncertain' AND qo <> tor THEN 'uncertain' WHEN qo <> 'uncertain' THEN qo ELSE tor END AS origin FROM p0))"""

QUERIES = {
    f.__name__: f
    for f in (
        interval_merge, union_length, interval_link, joint_bases, observation_overlaps, sweep_atlas, coverage_long, coverage_normalized, replicate_mean, coverage_switch, pair_support, split_decision,
        split_map, hit_summary, orf_profiles, contig_novelty, flank_switch, discovery_cards, domain_projection, read_qc, external_hits_max, classification_units,
    )
}
SQL = {
    "interval_merge": f"WITH iv AS ({IV_SQL}) {_MERGED.format(src='iv')}",
    "union_length": f"WITH iv AS ({IV_SQL}), m AS ({_MERGED.format(src='iv')}) SELECT accession, sum(\"end\" - start)::BIGINT AS bases FROM m GROUP BY accession",
    "interval_link": f"""WITH iv AS ({IV_SQL}), e AS (SELECT * FROM iv WHERE kind = 'error'), m AS ({_MERGED.format(src="e")}),
x AS (SELECT a.accession || chr(9) || a.kind AS accession, greatest(a.start, m.start) AS start, least(a."end", m."end") AS "end" FROM iv a JOIN m ON m.accession = a.accession AND a.start < m."end" AND a."end" > m.start WHERE a.kind <> 'error'),
y AS ({_MERGED.format(src="x")}) SELECT split_part(accession, chr(9), 1) AS accession, split_part(accession, chr(9), 2) AS kind, sum("end" - start)::BIGINT AS masked_bases FROM y GROUP BY ALL""",
    "joint_bases": f"""WITH iv AS ({IV_SQL}) SELECT *, classification <> 'unknown' AND assembly <> 'unknown' AS known FROM (
SELECT CASE id % 3 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'informative' ELSE 'unknown' END AS classification, CASE WHEN id % 5 < 2 THEN 'chimeric' WHEN id % 5 < 4 THEN 'consistent' ELSE 'unknown' END AS assembly, sum("end" - start)::BIGINT AS bases FROM iv GROUP BY ALL)""",
    "observation_overlaps": f"""WITH iv AS ({IV_SQL}) SELECT accession, kind, count(*) AS n FROM (SELECT *, max("end") OVER (PARTITION BY accession, kind ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM iv) WHERE start < r GROUP BY ALL""",
    "sweep_atlas": f"""WITH iv AS ({IV_SQL}), b AS (SELECT accession, start AS p FROM iv UNION SELECT accession, "end" FROM iv),
s AS (SELECT accession, p AS seg_start, lead(p) OVER (PARTITION BY accession ORDER BY p) AS seg_end FROM b)
SELECT s.accession, seg_start, seg_end, array_to_string(list_sort(list(DISTINCT kind)), ';') AS members FROM s JOIN iv ON iv.accession = s.accession AND iv.start <= seg_start AND iv."end" >= seg_end WHERE seg_end IS NOT NULL GROUP BY ALL""",
    "coverage_long": f'SELECT contig, "window", sample, biological_sample, round(value, 6) AS value FROM ({COV_SQL})',
    "coverage_normalized": f'SELECT contig, "window", sample, round(coalesce(value * 1e6 / nullif(sum(value) OVER (PARTITION BY sample), 0), 0), 6) AS normalized FROM ({COV_SQL})',
    "replicate_mean": f"""WITH c AS ({COV_SQL}), n AS (SELECT biological_sample, count(DISTINCT sample) AS n FROM c GROUP BY 1)
SELECT contig, "window", biological_sample, round(sum(value) / any_value(n), 6) AS mean FROM c JOIN n USING (biological_sample) GROUP BY contig, "window", biological_sample""",
    "coverage_switch": f"""WITH c AS ({COV_SQL}), n AS (SELECT biological_sample, count(DISTINCT sample) AS n FROM c GROUP BY 1),
m AS (SELECT contig, "window" AS w, biological_sample AS s, sum(value) / any_value(n) AS v FROM c JOIN n USING (biological_sample) GROUP BY ALL),
p AS (SELECT contig, w, map_from_entries(list((s, v))) AS v, sum(v * v) AS q FROM m GROUP BY ALL),
z AS (SELECT a.contig, a.w, list_sum([coalesce(a.v[k], 0) * coalesce(b.v[k], 0) FOR k IN map_keys(a.v)]) / sqrt(a.q * b.q) AS cs FROM p a JOIN p b ON b.contig = a.contig AND b.w = a.w + 1)
SELECT contig, w * 500 AS start, w * 500 + 1000 AS "end", 'coverage' AS method, round(greatest(0, least(1, 1 - cs)), 6) AS score FROM z WHERE 1 - cs >= 0.1""",
    "pair_support": """WITH r AS (SELECT l_orderkey AS f, 'path_' || (l_linenumber % 3) AS t, l_partkey % 60 AS p0, l_partkey % 60 + 80 + l_suppkey % 40 AS p1, l_suppkey % 30 AS s, l_partkey % 97 = 0 AS dup FROM lineitem),
bad AS (SELECT DISTINCT f FROM r WHERE dup),
c AS (SELECT DISTINCT a.f, a.t, a.s + b.s AS score, a.p0, a.p1, least(60, a.p0 + 50) - a.p0 >= 20 AND a.p1 + 50 - greatest(a.p1, 100) >= 20 AS spans FROM r a JOIN r b ON a.f = b.f AND a.t = b.t AND a.p1 = b.p1 AND a.p0 = b.p0 WHERE a.f NOT IN (SELECT f FROM bad)),
k AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY score DESC, t DESC, p0 DESC, p1 DESC, spans DESC) AS n FROM c),
b AS (SELECT * FROM k WHERE n = 1), o AS (SELECT k.f, max(k.score) AS second FROM k JOIN b ON b.f = k.f AND (k.t, k.p0, k.p1) <> (b.t, b.p0, b.p1) GROUP BY k.f),
g AS (SELECT t, count(DISTINCT (p0, p1)) AS support FROM b LEFT JOIN o USING (f) WHERE spans AND (second IS NULL OR score - second >= 2) GROUP BY t)
SELECT 'path_' || i AS template, coalesce(support, 0) AS support FROM range(4) x(i) LEFT JOIN g ON g.t = 'path_' || i""",
    "split_decision": """WITH c AS (SELECT l_suppkey AS contig, l_partkey % 5 * 100 AS cut, count_if(l_returnflag = 'N') AS cur, count_if(l_returnflag = 'R') AS alt FROM lineitem GROUP BY ALL),
p AS (SELECT l_suppkey AS contig, l_partkey % 400 AS s, l_linestatus AS m FROM lineitem WHERE l_discount * 10 >= 0.5),
j AS (SELECT c.*, coalesce(array_to_string(list_sort(list(DISTINCT m) FILTER (m IS NOT NULL)), ';'), '') AS methods FROM c LEFT JOIN p ON p.contig = c.contig AND c.cut BETWEEN p.s AND p.s + 3 GROUP BY ALL),
d AS (SELECT *, CASE WHEN alt >= 3 AND alt / (cur + alt)::DOUBLE >= 0.5 THEN 'split' WHEN cur >= 3 THEN 'retain' ELSE 'unresolved' END AS rd FROM j)
SELECT contig, cut, cur AS current, alt AS alternative, methods, rd AS read_decision, CASE WHEN rd = 'split' AND methods = '' THEN 'unresolved' ELSE rd END AS decision FROM d""",
    "split_map": f"""WITH s AS ({SEQ_SQL}), c AS (SELECT DISTINCT name, p FROM (SELECT name, unnest([0, 100, 700, 701, length(seq)]) AS p, length(seq) AS n FROM s) WHERE p IN (0, n) OR p < n),
k AS (SELECT name, p AS start, lead(p) OVER w AS "end", row_number() OVER w AS part FROM c WINDOW w AS (PARTITION BY name ORDER BY p))
SELECT name, part, start, "end", md5(substr(seq, start::INTEGER + 1, ("end" - start)::INTEGER)) AS digest FROM k JOIN s USING (name) WHERE "end" IS NOT NULL""",
    "hit_summary": f"WITH {_LAB} SELECT * FROM {_SUM.format(lines='')}",
    "orf_profiles": f'WITH {_PROF} SELECT * EXCLUDE (start, "end") FROM prof',
    "contig_novelty": f"""WITH {_PROF}, n AS (SELECT contig, count_if(origin = 'viral') AS viral_orfs, count_if(origin = 'cellular') AS cellular_orfs, count_if(hallmark) AS hallmark_orfs, count_if(sequence_close) AS sequence_close_orfs,
  count_if(structural_only AND origin = 'viral') AS structural_rescue_orfs FROM prof GROUP BY contig)
SELECT *, CASE WHEN viral_orfs >= 2 AND hallmark_orfs > 0 AND cellular_orfs = 0 THEN 'viral' WHEN cellular_orfs >= 2 AND viral_orfs = 0 THEN 'cellular' ELSE 'uncertain' END AS classification,
  CASE WHEN sequence_close_orfs > 0 THEN 'known_sequence' WHEN structural_rescue_orfs > 0 THEN 'remote_structure_candidate' WHEN viral_orfs > 0 THEN 'sequence_supported' ELSE 'unresolved' END AS novelty_class,
  structural_rescue_orfs + hallmark_orfs - sequence_close_orfs AS priority_score FROM n""",
    "flank_switch": f"""WITH {_PROF}, w AS (SELECT contig, "end" AS e, origin AS a, structural_related AS ar, confidence AS ac, lead(start) OVER o AS s, lead(origin) OVER o AS b, lead(structural_related) OVER o AS br, lead(confidence) OVER o AS bc
  FROM prof WINDOW o AS (PARTITION BY contig ORDER BY start, "end", orf_id))
SELECT contig, e AS start, s AS "end", 'structural_origin' AS method, round(least(ac, bc), 6) AS score FROM w WHERE a <> b AND a <> 'uncertain' AND b <> 'uncertain' AND ar AND br AND e <= s AND least(ac, bc) >= 0.4""",
    "discovery_cards": """WITH m AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'supported' ELSE 'unsupported' END AS s FROM labels WHERE doc_id % 4 < 2 UNION ALL SELECT doc_id, 'supported' FROM labels WHERE doc_id % 8 = 0),
a AS (SELECT doc_id, CASE WHEN count(DISTINCT s) = 1 THEN min(s) ELSE 'uncertain' END AS motif FROM m GROUP BY doc_id),
c AS (SELECT l.doc_id AS orf_id, quality = 0 AS seq, toxic = 1 AS fold, coalesce(motif, 'not_assessed') AS motif, CASE WHEN l.doc_id % 5 = 0 THEN 'supported' ELSE 'not_assessed' END AS context FROM labels l LEFT JOIN a USING (doc_id))
SELECT orf_id, CASE WHEN seq THEN 'supported' ELSE 'unsupported' END AS sequence, CASE WHEN fold THEN 'supported' ELSE 'unsupported' END AS fold, motif, context,
  CASE WHEN seq THEN 'sequence_supported' WHEN c.fold THEN 'remote_fold_candidate' WHEN motif = 'supported' THEN 'motif_only_candidate' WHEN motif = 'unsupported' AND context = 'supported' THEN 'dark_context_candidate' ELSE 'unresolved' END AS novelty FROM c""",
    "domain_projection": """SELECT l_orderkey AS orf_id, l_linenumber AS hit, CASE WHEN o_custkey % 2 = 0 THEN o_orderkey * 3 + 3 * (l_partkey % 100) ELSE o_orderkey * 3 + 600 - 3 * (l_partkey % 100 + 20) END AS nt_start,
  CASE WHEN o_custkey % 2 = 0 THEN o_orderkey * 3 + 3 * (l_partkey % 100 + 20) ELSE o_orderkey * 3 + 600 - 3 * (l_partkey % 100) END AS nt_end FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "read_qc": """WITH q AS (SELECT doc_id, regexp_replace(text, '[^!-~]', '', 'g') AS q FROM documents),
m AS (SELECT doc_id, length(q) AS n, CASE WHEN length(q) > 0 THEN list_sum([ascii(c) - 33 FOR c IN string_split(q, '')]) / length(q)::DOUBLE ELSE 0 END AS p, CASE WHEN length(q) > 0 THEN length(regexp_replace(upper(q), '[^N]', '', 'g')) / length(q)::DOUBLE ELSE 0 END AS f FROM q)
SELECT doc_id, round(p, 6) AS mean_phred, round(f, 6) AS n_fraction, CASE WHEN n < 50 THEN 'short' WHEN p < 60 THEN 'low_quality' WHEN f > 0.1 THEN 'ambiguous' ELSE 'pass' END AS reason FROM m""",
    "external_hits_max": f"SELECT query, target, max(bits) AS score FROM ({HIT_SQL}) GROUP BY ALL",
    "classification_units": """WITH r AS (SELECT source AS unit, CASE WHEN doc_id % 7 = 0 THEN 'ambiguous' WHEN doc_id % 11 = 0 THEN 'unclassified' WHEN toxic = quality THEN 'correct' ELSE 'wrong' END AS s FROM labels JOIN documents USING (doc_id)),
u AS (SELECT unit, s FROM r UNION ALL SELECT '*', s FROM r)
SELECT unit, count(*) AS total, round(avg((s = 'correct')::INT), 6) AS correct, round(avg((s = 'wrong')::INT), 6) AS wrong, round(avg((s = 'ambiguous')::INT), 6) AS ambiguous, round(avg((s = 'unclassified')::INT), 6) AS unclassified,
  round(count_if(s = 'correct') / nullif(count_if(s IN ('correct', 'wrong')), 0)::DOUBLE, 6) AS precision FROM u GROUP BY unit""",
}
