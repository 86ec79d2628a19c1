"""Views that give the driver tables the engine's relations, and the same views as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_AZ = "abcdefghijklmnopqrstuvwxyz"
_ACGT = ("ACGT" * 7)[:26]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bases(text):
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), _AZ, _ACGT)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, seq) from documents."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("d"), "doc_id").alias("name"), _bases("text").alias("seq"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.concat(F.lit("q"), "item_id").alias("name"), _bases("text").alias("seq"))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("d"), "doc_id").alias("name"), F.when(F.col("doc_id") % 17 != 0, F.col("source")).alias("taxon"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(accession, start, end, kind) from events: hours since 2024."""
    e = table(spark, sf_dir, "events")
    start = F.timestamp_diff("HOUR", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")), F.col("ts"))
    return e.select(F.concat(F.lit("u"), "user_id").alias("accession"), start.alias("start"), (start + 1 + F.floor(F.col("value") / 10)).alias("end"), F.col("event_type").alias("kind"), F.col("event_id").alias("id"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contig, window, sample, biological_sample, value) from lineitem."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy(F.col("l_suppkey").alias("contig"), (F.col("l_partkey") % 8).alias("window"), F.concat("l_returnflag", "l_linestatus").alias("sample"), F.col("l_returnflag").alias("biological_sample"))
    return g.agg(F.sum(F.col("l_quantity").cast("double")).alias("value"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ungapped alignment rows from lineitem: query an order, target a supplier modulo 5, 1-based inclusive."""
    li = table(spark, sf_dir, "lineitem")
    start = F.col("l_partkey") % 300
    size = F.col("l_quantity").cast("long") * 6
    return li.select(
        F.col("l_orderkey").alias("query"), (F.col("l_suppkey") % 5).alias("target"), (F.lit(100.0) - F.round(F.col("l_tax").cast("double") * 25, 6)).alias("pident"),
        start.alias("qstart"), (start + size).alias("qend"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").cast("double").alias("bits"), (F.col("l_discount").cast("double") * 10).alias("qcov"),
    )


SEQ_SQL = f"""SELECT 'd' || doc_id AS name, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{_AZ}', '{_ACGT}') AS seq FROM documents"""
QUERY_SQL = f"""SELECT 'q' || item_id AS name, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{_AZ}', '{_ACGT}') AS seq FROM benchmark"""
TAX_SQL = "SELECT 'd' || doc_id AS name, CASE WHEN doc_id % 17 <> 0 THEN source END AS taxon FROM documents"
IV_SQL = "SELECT 'u' || user_id AS accession, date_diff('second', TIMESTAMP '2024-01-01', ts) // 3600 AS start, date_diff('second', TIMESTAMP '2024-01-01', ts) // 3600 + 1 + floor(value / 10)::BIGINT AS \"end\", event_type AS kind, event_id AS id FROM events"
COV_SQL = "SELECT l_suppkey AS contig, l_partkey % 8 AS \"window\", l_returnflag || l_linestatus AS sample, l_returnflag AS biological_sample, sum(l_quantity::DOUBLE) AS value FROM lineitem GROUP BY ALL"
HIT_SQL = "SELECT l_orderkey AS query, l_suppkey % 5 AS target, 100.0::DOUBLE - round(l_tax::DOUBLE * 25, 6) AS pident, l_partkey % 300 AS qstart, l_partkey % 300 + l_quantity::BIGINT * 6 AS qend, l_linenumber AS line, l_extendedprice::DOUBLE AS bits, l_discount::DOUBLE * 10 AS qcov FROM lineitem"


def kmer_sql(source: str, k: int) -> str:
    """(name, pos, word) of canonical words over a CTE with name and seq."""
    word = f"substr(seq, i::INTEGER + 1, {k})"
    return f"""SELECT name, i AS pos, least({word}, reverse(translate({word}, 'ACGT', 'TGCA'))) AS word
      FROM (SELECT name, seq, unnest(range(0, greatest(length(seq) - {k - 1}, 0))) AS i FROM {source})"""


def entropy_sql(word: str, k: int) -> str:
    part = lambda b: f"(CASE WHEN length(replace({word}, '{b}', '')) < {k} THEN (1 - length(replace({word}, '{b}', '')) / {k}.0::DOUBLE) * log2(1 - length(replace({word}, '{b}', '')) / {k}.0::DOUBLE) ELSE 0 END)"
    return "-(" + " + ".join(part(b) for b in "ACGT") + ")"
