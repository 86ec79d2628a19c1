"""The runnable jobs as queries: each is run twice into one new folder, and its whole output is read back."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from jobs import catalog_ingest, library_coverage
from seqlens.plans.adapters import SEQ_SQL
from seqlens.session import shared_dir


def _settings(job) -> dict:
    return json.loads(Path(job.__file__).with_suffix(".json").read_text(encoding="utf-8"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/seqlens-jobs/{name}-{uuid.uuid4().hex}"


def job1_catalog_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue after two runs over documents; first_batch tells how files were dealt and is left out."""
    folder, settings = _folder(spark, "catalog-ingest"), _settings(catalog_ingest)
    # a stream takes a folder or a pattern, and the table may be one file
    for _ in range(2):
        catalog_ingest.ingest(spark, settings, f"{sf_dir}/documents.parque[t]", f"{folder}/output", f"{folder}/checkpoint")
    return catalog_ingest.read_catalog(spark, f"{folder}/output").drop("first_batch")


def job2_library_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, settings = _folder(spark, "library-coverage"), _settings(library_coverage)
    for _ in range(2):
        library_coverage.measure(spark, settings, sf_dir, f"{folder}/output")
    return library_coverage.read_coverage(spark, f"{folder}/output")


QUERIES = {f.__name__: f for f in (job1_catalog_ingest, job2_library_coverage)}
SQL = {
    "job1_catalog_ingest": f"""WITH s AS (SELECT s.name, seq, source FROM ({SEQ_SQL}) s JOIN (SELECT 'd' || doc_id AS name, source FROM documents) d USING (name) WHERE length(seq) > 0),
c AS (SELECT name, source, least(seq, reverse(translate(seq, 'ACGT', 'TGCA'))) AS c FROM s)
SELECT 'nv_' || sha256(c) AS catalog_id, length(c) AS length, count(*) AS members, count(DISTINCT source) AS sources, min(name) AS first_contig, substr(sha256(c), 1, 1) AS shard FROM c GROUP BY c""",
    "job2_library_coverage": """WITH r AS (SELECT l_returnflag || l_linestatus AS sample, l_returnflag AS bs, l_orderkey || '/' || l_linenumber || '/' || l_partkey AS q, l_suppkey, l_partkey % 250 AS a, l_partkey % 250 + l_partkey % 70 AS b, l_tax, l_partkey, l_linenumber FROM lineitem),
k AS (SELECT sample, q, count(*) AS n FROM r GROUP BY ALL),
f AS (SELECT r.*, n = 1 AND l_suppkey % 9 <> 0 AND (l_tax * 500)::INTEGER BETWEEN 20 AND 254 AND l_partkey % 6 <> 0
  AND NOT (l_partkey % 5 = 0 AND (l_suppkey % 4 = 0 OR (l_partkey % 2 <> 0 AND l_linenumber % 3 >= 1))) AS ok FROM r JOIN k USING (sample, q)),
u AS (SELECT sample, q, bool_and(ok) AS ok, any_value(bs) AS bs, sum(CASE WHEN ok THEN 100 - greatest(0, 50 - l_partkey % 70) ELSE 0 END) AS n FROM f GROUP BY ALL),
l AS (SELECT sample, any_value(bs) AS biological_sample, count_if(ok) AS accepted_fragments, count_if(NOT ok) AS excluded_fragments, sum(n)::BIGINT AS aligned_bases FROM u GROUP BY sample),
w AS (SELECT s_suppkey AS s, unnest([0, 100, 200, 300]) AS st FROM supplier),
o AS (SELECT sample, s, st, sum(greatest(0, least(a + 50, st + 100) - greatest(a, st)) + greatest(0, least(b + 50, st + 100) - greatest(b, st)) - greatest(0, least(a + 50, st + 100) - greatest(b, st))) AS n
  FROM w JOIN (SELECT * FROM f WHERE ok) g ON l_suppkey = s GROUP BY ALL)
SELECT l.sample, 'c' || w.s || ':' || w.st AS window_id, 'c' || w.s AS contig, w.st AS start, w.st + 100 AS "end", coalesce(n, 0) / 100.0::DOUBLE AS depth,
  CASE WHEN aligned_bases > 0 THEN coalesce(n, 0) / 100.0::DOUBLE * 1e6::DOUBLE / aligned_bases ELSE 0 END AS normalized, biological_sample, accepted_fragments, excluded_fragments, aligned_bases
FROM w, l LEFT JOIN o ON o.s = w.s AND o.st = w.st AND o.sample = l.sample""",
}
