"""Queries over stages: correction, taxonomy, read pairs, reported candidates, depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.operators import coverage as C
from seqlens.operators import reads as R
from seqlens.operators import reconstruction as N
from seqlens.operators import stages as T
from seqlens.plans.adapters import SEQ_SQL, sequences, table

DIGITS = 6
RANKS = ["species", "genus"]
#: The letters whose upper case is one of A to Z, the dotless i and the long s among them.
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz\u0131\u017f", "ABCDEFGHIJKLMNOPQRSTUVWXYZIS"


def correction_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a candidate with up to two alternatives; its lines support four templates, so some are entrances."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    paths = F.array_repeat(F.array(F.lit("1+")), (F.col("o_orderkey") % 3).cast("int"))
    cands = o.select(F.col("o_orderkey").alias("candidate"), F.col("o_orderkey").alias("contig"), F.lit(5).alias("cut"), paths.alias("alternatives"))
    index = (F.col("l_linenumber") * F.col("l_linenumber") + F.col("l_suppkey")) % 4
    support = li.groupBy(F.col("l_orderkey").alias("candidate"), F.concat(F.lit("path_"), index).alias("template")).agg(F.sum(F.floor(F.col("l_quantity") / 10)).cast("long").alias("support"))
    props = li.select(F.col("l_orderkey").alias("contig"), (F.col("l_partkey") % 8).alias("start"), (F.col("l_partkey") % 8 + 3).alias("end"), F.col("l_linestatus").alias("method"), (F.col("l_discount") * 10).alias("score"))
    got, _ = T.correction(cands, support, props, sequences(spark, sf_dir), "require_any", fraction=0.6)
    return got.select("candidate", "current", "alternative", F.array_join("methods", ";").alias("methods"), "read_decision", "decision", "reason")


def taxonomy_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers name parts, or ids merged into parts by way of a second id; some parts are deleted."""
    p, s, c = (table(spark, sf_dir, n) for n in ("part", "supplier", "customer"))
    key = F.col("p_partkey")
    rank = F.when(key < 2, "root").when(key < 20, "genus").when(key < 200, "species").otherwise("strain")
    nodes = p.select(key.alias("node"), F.floor(key / 3).cast("long").alias("parent"), rank.alias("rank"))
    first = s.select((F.col("s_suppkey") + 1_000_000).alias("old"), (F.col("s_suppkey") + 2_000_000).alias("new"))
    merged = first.unionByName(s.select((F.col("s_suppkey") + 2_000_000).alias("old"), (F.col("s_suppkey") * 3).alias("new")))
    deleted = p.where("p_partkey % 41 = 40").select(key.alias("taxid"))
    mapping = c.select(F.col("c_custkey").alias("accession"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 200 + 1_000_000).otherwise(F.col("c_custkey")).cast("long").alias("taxid"))
    return T.resolve_taxonomy(mapping, nodes, merged, deleted, RANKS)


def _bases(text):
    # letter by letter, as SQL's upper does: Java's makes SS of a sharp s
    return F.regexp_replace(F.translate(text, _LOWER, _UPPER), "[^A-Z]", "")


def pair_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of a text are both mates' bases, its printable characters their qualities; labels are the host calls."""
    d, la = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    qual = F.regexp_replace("text", "[^!-~]", "")
    mate = lambda i, q: d.select(F.col("doc_id").alias("ord"), F.concat(F.lit("f"), "doc_id", F.lit(f"/{i}")).alias("id"), _bases("text").alias("seq"), q.alias("qual"))
    status = F.when(F.col("toxic") == 1, "host_supported").when(F.col("quality") == 1, "nonhost").otherwise("ambiguous")
    host = la.select(F.concat(F.lit("f"), "doc_id").alias("fragment"), status.alias("status"))
    return R.prepare_pairs(mate(1, qual), mate(2, F.regexp_replace(qual, "[0-9]", "")), host, True, min_length=200, min_phred=66, max_n=0.07)


def reported_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled sequences are reported, those of odd ids as elements of their first half."""
    s, la = sequences(spark, sf_dir), table(spark, sf_dir, "labels")
    rows = s.join(la.withColumn("name", F.concat(F.lit("d"), "doc_id")), "name").select("name", F.length("seq").alias("n"), "quality", "toxic", (F.col("doc_id") % 2 == 1).alias("odd")).where("n > 1")
    half = F.floor(F.col("n") / 2).cast("int")
    place = F.concat(F.lit("1-"), half)
    summary = rows.select(
        F.when(F.col("odd"), F.concat("name", F.lit("|provirus_1_"), half)).otherwise(F.col("name")).alias("seq_name"), F.when(F.col("odd"), half).otherwise(F.col("n")).alias("length"),
        F.when(F.col("odd"), place).otherwise("NA").alias("coordinates"), (F.col("quality") * 0.5 + F.col("toxic") * 0.25).alias("virus_score"), F.when(F.col("odd"), "Provirus").otherwise("DTR").alias("topology"), F.lit("Viruses;").alias("taxonomy"),
    )
    return T.quality(s.select(F.col("name").alias("contig"), "seq"), summary).drop("completeness")


def window_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is a pair on its supplier: some are duplicates, badly mapped or tied; windows of 100 bases."""
    li = table(spark, sf_dir, "lineitem")
    one = F.col("mate") == 0
    p0 = (F.col("l_partkey") % 250).cast("int")
    rows = li.withColumn("mate", F.explode(F.array(F.lit(0), F.lit(1))))
    sam = rows.select(
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("qname"), (F.when(one, F.lit(99)).otherwise(147) + F.when(F.col("l_suppkey") % 9 == 0, 1024).otherwise(0)).cast("int").alias("flag"),
        F.concat(F.lit("c"), "l_suppkey").alias("rname"), (F.when(one, p0).otherwise(p0 + (F.col("l_partkey") % 70).cast("int")) + 1).alias("pos"), (F.col("l_tax") * 500).cast("int").alias("mapq"), F.lit("50M").alias("cigar"),
        F.lit(0.0).alias("score"), F.when(F.col("l_partkey") % 6 == 0, 0.0).when(F.col("l_partkey") % 6 == 1, -5.0).alias("other"),
    )
    w = F.explode(F.array(F.lit(0), F.lit(100), F.lit(200), F.lit(300)))
    windows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), "s_suppkey").alias("contig"), w.alias("start"))
    windows = windows.select(F.concat_ws(":", "contig", "start").alias("window_id"), "contig", "start", (F.col("start") + 100).alias("end"))
    return C.window_depth(windows, C.placed_blocks(C.placed_fragments(sam), ["qname"])).select("window_id", "contig", "start", F.round("depth", DIGITS).alias("depth"))


def reconstruction_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a candidate with up to three rewrites of a contig, its lines are their support; customers' batches stand or fall together."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = F.col("o_orderkey")
    index = F.explode(F.sequence(F.lit(0), (key % 3 + 1).cast("int")))
    t = o.select(key.alias("candidate"), (F.floor(key / 3) * 7 + F.col("o_custkey") % 2).alias("contig"), index.alias("index"), (F.col("o_custkey") % 50).alias("left"))
    t = t.select("*", F.concat(F.lit("path_"), "index").alias("template"), (F.col("left") + F.col("candidate") % 9 * 70 + F.col("index")).alias("right"), ((F.col("candidate") + F.col("index")) % 11 == 0).alias("unchanged"), ((F.col("candidate") + F.col("index")) % 13 == 0).alias("reuses"))
    support = li.groupBy(F.col("l_orderkey").alias("candidate"), F.concat(F.lit("path_"), F.col("l_linenumber") % 3).alias("template")).agg(F.sum(F.floor(F.col("l_quantity") / 8)).cast("long").alias("support"))
    decided = N.rewrite_decisions(t, support, fraction=0.5).withColumn("batch", F.floor(F.col("contig") / 700))
    again = t.groupBy(F.col("contig").alias("template")).agg((F.max("candidate") % 40).alias("support"))
    return N.verify_batch(decided, again, 3, ("batch",))


QUERIES = {f.__name__: f for f in (reconstruction_calls, correction_calls, taxonomy_resolution, pair_preparation, reported_quality, window_depths)}
SQL = {
    "correction_calls": """WITH s AS (SELECT l_orderkey AS k, (l_linenumber * l_linenumber + l_suppkey) % 4 AS i, sum(floor(l_quantity / 10))::BIGINT AS n FROM lineitem GROUP BY ALL),
c AS (SELECT o_orderkey AS k, coalesce(max(n) FILTER (i = 0), 0) AS cur, coalesce(max(n) FILTER (i BETWEEN 1 AND o_orderkey % 3), 0) AS alt FROM orders LEFT JOIN s ON k = o_orderkey GROUP BY o_orderkey),
p AS (SELECT l_orderkey AS k, array_to_string(list_sort(list(DISTINCT l_linestatus)), ';') AS m FROM lineitem WHERE l_discount * 10 >= 0.5 AND 5 BETWEEN l_partkey % 8 AND l_partkey % 8 + 3 GROUP BY 1),
d AS (SELECT c.*, coalesce(m, '') AS m, CASE WHEN alt >= 3 AND alt / (cur + alt)::DOUBLE >= 0.6 THEN 'split' WHEN cur >= 3 THEN 'retain' ELSE 'unresolved' END AS rd FROM c LEFT JOIN p USING (k)),
e AS (SELECT *, CASE WHEN rd = 'split' AND m = '' THEN 'unresolved' ELSE rd END AS dd FROM d)
SELECT k AS candidate, cur AS current, alt AS alternative, m AS methods, rd AS read_decision, dd AS decision, CASE WHEN dd = 'split' THEN 'alternative_fragment_support' WHEN dd = 'retain' THEN 'current_support'
  WHEN rd = 'split' THEN 'proposal_gate_not_met' ELSE 'insufficient_discriminating_evidence' END AS reason FROM e""",
    "taxonomy_resolution": """WITH RECURSIVE n AS (SELECT p_partkey AS node, p_partkey // 3 AS parent, CASE WHEN p_partkey < 2 THEN 'root' WHEN p_partkey < 20 THEN 'genus' WHEN p_partkey < 200 THEN 'species' ELSE 'strain' END AS rank FROM part),
m AS (SELECT c_custkey AS accession, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 200 + 1000000 ELSE c_custkey END AS taxid FROM customer),
r AS (SELECT accession, taxid, CASE WHEN s_suppkey IS NULL THEN taxid ELSE s_suppkey * 3 END AS node FROM m LEFT JOIN supplier ON s_suppkey + 1000000 = taxid),
q AS (SELECT r.*, CASE WHEN n.node IS NOT NULL AND r.node % 41 = 40 THEN 'deleted' WHEN n.node IS NOT NULL THEN 'known' ELSE 'unknown' END AS status FROM r LEFT JOIN n ON n.node = r.node),
live AS (SELECT * FROM n WHERE node % 41 <> 40),
w AS (SELECT accession, 0 AS d, live.node, parent, rank FROM q JOIN live ON live.node = q.node WHERE status = 'known'
  UNION ALL SELECT w.accession, w.d + 1, live.node, live.parent, live.rank FROM w JOIN live ON live.node = w.parent WHERE w.parent <> w.node),
k AS (SELECT accession, arg_max(node, d) FILTER (rank = 'species') AS species, arg_max(node, d) FILTER (rank = 'genus') AS genus FROM w GROUP BY accession)
SELECT q.accession, taxid, q.node AS resolved_taxid, status, species::VARCHAR AS species, genus::VARCHAR AS genus FROM q LEFT JOIN k ON k.accession = q.accession""",
    "pair_preparation": """WITH t AS (SELECT doc_id, regexp_replace(upper(text), '[^A-Z]', '', 'g') AS s, regexp_replace(text, '[^!-~]', '', 'g') AS a, regexp_replace(text, '[^!-/:-~]', '', 'g') AS b FROM documents),
v AS (SELECT doc_id, length(s) < 200 AS short, CASE WHEN length(s) > 0 THEN length(replace(s, 'N', '')) < length(s) - 0.07 * length(s) ELSE FALSE END AS n,
  [coalesce(list_sum([ascii(c) - 33 FOR c IN string_split(x, '')]) / nullif(length(x), 0)::DOUBLE, 0) < 66 FOR x IN [a, b]] AS low FROM t),
j AS (SELECT v.*, CASE WHEN l.doc_id IS NULL THEN 'not_assessed' WHEN toxic = 1 THEN 'host_supported' WHEN quality = 1 THEN 'nonhost' ELSE 'ambiguous' END AS host_status,
  array_to_string(list_filter([CASE WHEN n THEN 'excess_N' END, CASE WHEN low[1] OR low[2] THEN 'low_quality' END, CASE WHEN short THEN 'short' END], lambda x: x IS NOT NULL), ';') AS why FROM v LEFT JOIN labels l ON l.doc_id = v.doc_id)
SELECT 'f' || doc_id AS fragment, CASE WHEN why <> '' THEN 'quality_filtered' WHEN host_status = 'host_supported' THEN 'host_removed' ELSE 'retained' END AS destination,
  CASE WHEN why = '' AND host_status = 'host_supported' THEN 'explicit_host_support' ELSE why END AS reason, host_status FROM j""",
    "reported_quality": f"""WITH s AS ({SEQ_SQL}), r AS (SELECT s.name, length(seq) AS n, l.* FROM s LEFT JOIN labels l ON 'd' || doc_id = s.name AND length(seq) > 1)
SELECT name AS contig, CASE WHEN doc_id IS NULL THEN '' WHEN doc_id % 2 = 1 THEN name || '|provirus_1_' || (n // 2) ELSE name END AS result_id, 0 AS start, CASE WHEN doc_id % 2 = 1 THEN n // 2 ELSE n END AS "end",
  CASE WHEN doc_id IS NULL THEN 'not_reported' ELSE 'reported_viral_candidate' END AS status, quality * 0.5::DOUBLE + toxic * 0.25::DOUBLE AS virus_score,
  CASE WHEN doc_id IS NULL THEN '' WHEN doc_id % 2 = 1 THEN 'Provirus' ELSE 'DTR' END AS topology, CASE WHEN doc_id IS NULL THEN '' ELSE 'Viruses;' END AS taxonomy, FALSE AS provirus_is_chimera FROM r""",
    "window_depths": """WITH r AS (SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey AS q, l_suppkey, l_partkey % 250 AS a, l_partkey % 250 + l_partkey % 70 AS b, l_tax, l_partkey FROM lineitem),
k AS (SELECT q FROM r GROUP BY q HAVING count(*) = 1),
g AS (SELECT l_suppkey, a, b FROM r JOIN k USING (q) WHERE l_suppkey % 9 <> 0 AND (l_tax * 500)::INTEGER >= 20 AND l_partkey % 6 <> 0),
w AS (SELECT s_suppkey AS s, unnest([0, 100, 200, 300]) AS st FROM supplier),
o AS (SELECT s, st, sum(greatest(0, least(a + 50, st + 100) - greatest(a, st)) + greatest(0, least(b + 50, st + 100) - greatest(b, st)) - greatest(0, least(a + 50, st + 100) - greatest(b, st))) AS n FROM w JOIN g ON l_suppkey = s GROUP BY ALL)
SELECT 'c' || w.s || ':' || w.st AS window_id, 'c' || w.s AS contig, w.st AS start, round(coalesce(n, 0) / 100.0::DOUBLE, 6) AS depth FROM w LEFT JOIN o ON o.s = w.s AND o.st = w.st""",
    "reconstruction_calls": """WITH t AS (SELECT o_orderkey AS candidate, o_orderkey // 3 * 7 + o_custkey % 2 AS contig, unnest(range(0, o_orderkey % 3 + 2)) AS i, o_orderkey % 9 * 70 AS span FROM orders),
s AS (SELECT l_orderkey AS candidate, l_linenumber % 3 AS i, sum(floor(l_quantity / 8))::BIGINT AS n FROM lineitem GROUP BY ALL),
x AS (SELECT t.*, coalesce(n, 0) AS n FROM t LEFT JOIN s USING (candidate, i)),
c AS (SELECT candidate, contig, max(span + i) + 40 AS span, sum(n) AS total, max(row(n, i)) FILTER (i > 0) AS best, list_reverse_sort(list(n) FILTER (i > 0)) AS counts FROM x GROUP BY ALL),
d AS (SELECT candidate, contig, best[1] AS support, 'path_' || best[2] AS template, CASE WHEN span > 600 THEN 'region_exceeds_fragment_span'
  WHEN NOT ((len(counts) = 1 OR counts[1] > counts[2]) AND best[1] >= 3 AND best[1] >= total * 0.5) THEN 'insufficient_unique_alternative_support'
  WHEN (candidate + best[2]) % 11 = 0 THEN 'sequence_unchanged' WHEN (candidate + best[2]) % 13 = 0 THEN 'replacement_reuses_external_path_nodes' END AS reason FROM c),
m AS (SELECT *, count(*) FILTER (reason IS NULL) OVER (PARTITION BY contig) AS k, contig // 700 AS batch FROM d),
v AS (SELECT m.*, reason IS NULL AND k = 1 AS mine, w.n AS verified FROM m JOIN (SELECT contig, max(candidate) % 40 AS n FROM t GROUP BY 1) w USING (contig)),
f AS (SELECT *, mine AND coalesce(bool_or(mine AND verified < 3) OVER (PARTITION BY batch), FALSE) AS lost FROM v)
SELECT candidate, contig, template, support, batch, CASE WHEN mine AND NOT lost THEN 'reconstruct' ELSE 'unresolved' END AS decision,
  CASE WHEN lost THEN 'batch_remapping_failed' WHEN mine THEN 'spanning_support_and_batch_remapping' WHEN reason IS NULL THEN 'multiple_rewrites_require_joint_validation' ELSE reason END AS reason, CASE WHEN mine THEN verified END AS verification_support FROM f""",
}
