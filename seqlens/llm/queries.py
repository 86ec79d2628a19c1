"""Thin queries over the operators of this subpackage, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.llm import bpe, packing, token_store, toxicity, warc
from seqlens.llm.mixing import mix_sources
from seqlens.llm.near_dups import near_duplicates
from seqlens.llm.sharding import shard_rows
from seqlens.llm.spotsigs import edited_fingerprints
from seqlens.llm.url_filter import url_verdicts
from seqlens.llm.vector_codes import vector_codes
from seqlens.llm.vector_dups import near_vectors
from seqlens.session import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"), lean=True)
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", "mix.repeats")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s
  FROM w
), g AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s
), n AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM s
), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept
FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    tagger = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs.select("doc_id", "text"), tagger)
    scored = scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity.score").alias("score"), F.size("toxicity.spans").alias("n_spans"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_verdicts(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-store")
    token_store.write_store(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_store.read_store(spark, path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(_table(spark, sf_dir, "documents"), shards=24)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    return warc.read_records(spark, path)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, plan = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=0)
    return plan.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "place")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
), g AS (SELECT * FROM v WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), l AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.9
), r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS s FROM p
), f AS (SELECT s, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY s)
SELECT d.page_id, d.n AS payload_bytes, d.s AS payload_digest,
  CASE WHEN f.first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON f.s = d.s
"""


def _codes_sql(rounds: int = 4, entries: int = 256, parts: int = 4) -> str:
    """Rounds of assignment and means over parts of integer vectors; inner products of integers are exact doubles."""
    steps = [f"""
WITH q AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, label, part, q[part * (len(q) // {parts}) + 1:(part + 1) * (len(q) // {parts})]::DOUBLE[] AS v FROM q, range({parts}) r(part)
), b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c FROM p
  WHERE vec_id IN (SELECT vec_id FROM q ORDER BY vec_id LIMIT {entries})
)"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, label, part, v, min(row(list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c), entry)) AS best
  FROM p JOIN b{i} USING (part) GROUP BY ALL
)""")
        if i < rounds:
            steps.append(f"""m{i} AS MATERIALIZED (
  SELECT part, entry, list(m ORDER BY i) AS m FROM (
    SELECT part, best[2] AS entry, i, floor(sum(x) / count(*)) AS m FROM (SELECT part, best, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY ALL
  ) GROUP BY ALL
), b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m, c) AS c FROM b{i} LEFT JOIN m{i} USING (part, entry))""")
    steps.append(f"""o AS (SELECT vec_id, label, string_agg(format('{{:02x}}', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM a{rounds} GROUP BY ALL
), s AS (SELECT sha256(string_agg(x, ',' ORDER BY part, entry)) AS h FROM (SELECT part, entry, array_to_string(c::BIGINT[], ',') AS x FROM b{rounds})
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM o, s
""")
    return ", ".join(steps)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_minhash, op3_toxicity, op4_url_filter, op5_spotsigs, op6_token_store, op7_sharding, op8_bpe, op9_vector_dups, op10_warc, op11_packing, op12_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash": OP2_SQL, "op9_vector_dups": OP9_SQL, "op10_warc": OP10_SQL, "op12_vector_codes": _codes_sql()}
