"""Grow a catalogue of distinct contigs by the files that are new since the last run.

Contigs are equal up to strand: a catalogue entry is named by the digest of the smaller strand. A run
takes the files that the checkpoint does not know yet, in batches, and ends. Under OUTPUT:

    lineage/    batch=, shard=: every contig with its entry, source, length and orientation
    sequences/  batch=, shard=: the sequence of each entry, in the batch that brought it
    rejected/   batch=: contigs without a name or a base, with the reason
    catalog/    shard=: a row an entry, with its members, sources and first contig

shard is the beginning of the digest. A batch replaces its own partitions of lineage, sequences and
rejected, and writes anew the shards of catalog that it touches, from lineage. So a batch that is repeated
after a failure writes what it wrote before, and the catalogue does not depend on how files are dealt to batches.

    python -m jobs.catalog_ingest --config jobs/catalog_ingest.json INPUT OUTPUT CHECKPOINT
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.functions.sequence import canonical
from seqlens.operators.catalog import dereplicate

LINEAGE = "catalog_id string, source string, contig string, length int, orientation string, batch long, shard string"
SEQUENCES = "catalog_id string, seq string, batch long, shard string"
REJECTED = "contig string, source string, reason string, batch long"
CATALOG = "catalog_id string, length int, members long, sources long, first_contig string, first_batch long, shard string"
log = logging.getLogger(__name__)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _write(rows: DataFrame, path: str, by: list[str], spread: list[Column] | None = None) -> None:
    """Replace the partitions of path that rows has, and no others."""
    rows = rows.repartition(*spread) if spread else rows
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _prepare(spark: SparkSession, output: str) -> None:
    """Make the tables' folders, so that they can be read before they have rows."""
    for name, schema, by in (("lineage", LINEAGE, ["batch", "shard"]), ("sequences", SEQUENCES, ["batch", "shard"]), ("rejected", REJECTED, ["batch"]), ("catalog", CATALOG, ["shard"])):
        spark.createDataFrame([], schema).write.mode("append").partitionBy(*by).parquet(f"{output}/{name}")


def take_batch(batch: DataFrame, number: int, settings: dict, output: str) -> dict[str, int]:
    """Enter one batch of rows; entering it again changes nothing. Says how many rows went where."""
    spark, digits = batch.sparkSession, int(settings["shard_digits"])
    contigs = spark.sql(settings["contigs"], batch=batch)
    reason = F.when(F.coalesce("contig", F.lit("")) == "", "unnamed").when(F.coalesce("seq", F.lit("")) == "", "empty")
    judged = contigs.select("contig", "source", "seq", reason.alias("reason"), F.lit(number).cast("long").alias("batch"))
    _write(judged.where("reason IS NOT NULL").select("contig", "source", "reason", "batch"), f"{output}/rejected", ["batch"])

    # an entry's name begins with nv_
    shard = F.substring("catalog_id", 4, digits).alias("shard")
    spread = [F.col("shard"), F.pmod(F.xxhash64("catalog_id"), F.lit(int(settings["files_per_shard"])))]
    good = judged.where("reason IS NULL")
    # dereplicate hands one name on: contig and source travel in it
    named = dereplicate(good.select(F.struct("contig", "source").alias("name"), "seq"))
    lineage = named.select("catalog_id", "name.source", "name.contig", "length", "orientation", F.lit(number).cast("long").alias("batch"), shard)
    _write(lineage, f"{output}/lineage", ["batch", "shard"], spread)

    whole = _read(spark, f"{output}/lineage", LINEAGE)
    # at most 16 ** shard_digits names
    touched = [r.shard for r in whole.where(F.col("batch") == number).select("shard").distinct().collect()]
    known = _read(spark, f"{output}/catalog", CATALOG).where(F.col("shard").isin(touched) & (F.col("first_batch") < number)).select("catalog_id")
    own = good.select(F.concat(F.lit("nv_"), F.sha2(canonical(F.col("seq")), 256)).alias("catalog_id"), canonical(F.col("seq")).alias("seq"))
    new = own.join(known, "catalog_id", "left_anti").groupBy("catalog_id").agg(F.any_value("seq").alias("seq"))
    _write(new.select("catalog_id", "seq", F.lit(number).cast("long").alias("batch"), shard), f"{output}/sequences", ["batch", "shard"], spread)

    entries = whole.where(F.col("shard").isin(touched)).groupBy("shard", "catalog_id").agg(
        F.min("length").alias("length"), F.count(F.lit(1)).alias("members"), F.count_distinct("source").alias("sources"), F.min("contig").alias("first_contig"), F.min("batch").alias("first_batch"),
    )
    _write(entries.select("catalog_id", "length", "members", "sources", "first_contig", "first_batch", "shard"), f"{output}/catalog", ["shard"], spread)
    mine = lambda name, schema: _read(spark, f"{output}/{name}", schema).where(F.col("batch") == number).count()
    told = {"contigs": mine("lineage", LINEAGE), "new_entries": mine("sequences", SEQUENCES), "rejected": mine("rejected", REJECTED), "shards": len(touched)}
    log.info("batch %d: read %d rows; wrote %s", number, told["contigs"] + told["rejected"], told)
    return told


def ingest(spark: SparkSession, settings: dict, source: str, output: str, checkpoint: str) -> dict[str, int]:
    """Enter the files of source that are not in the checkpoint; returns the sums over this run's batches."""
    _prepare(spark, output)
    total = {"batches": 0, "contigs": 0, "new_entries": 0, "rejected": 0}

    def enter(batch: DataFrame, number: int) -> None:
        told = take_batch(batch, number, settings, output)
        total["batches"] += 1
        for k in ("contigs", "new_entries", "rejected"):
            total[k] += told[k]

    stream = spark.readStream.schema(settings["schema"]).option("maxFilesPerTrigger", int(settings["files_per_batch"])).parquet(source)
    stream.writeStream.foreachBatch(enter).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    log.info("run over %s ended: %s under %s", source, total, output)
    return total


def read_catalog(spark: SparkSession, output: str) -> DataFrame:
    return _read(spark, f"{output}/catalog", CATALOG)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="jobs.catalog_ingest", description="Grow a catalogue of distinct contigs by new files.")
    parser.add_argument("--config", required=True)
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("checkpoint")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(args.config, encoding="utf-8") as f:
        settings = json.load(f)
    spark = SparkSession.builder.appName("catalog_ingest").getOrCreate()
    try:
        ingest(spark, settings, args.input, args.output, args.checkpoint)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
