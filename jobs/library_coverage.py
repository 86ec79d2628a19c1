"""Coverage of common targets by the read pairs of several libraries.

Reads alignment records, targets and libraries as the config's SQL gives them from the tables of a folder. Only
valid, unique pairs count, and overlapping mates count a base once. Under OUTPUT:

    coverage/    sample=, shard=: depth of every window, and its normalized depth
    libraries/   the libraries with accepted and excluded fragments and aligned bases
    exclusions/  sample=: excluded fragments by reason

shard is a part of the targets. A run replaces the partitions of the libraries that it reads, so running it
again over the same tables gives the same output, and libraries of other runs stay; libraries/ is partitioned by
sample as well.

    python -m jobs.library_coverage --config jobs/library_coverage.json TABLES OUTPUT
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from seqlens.operators.coverage import library_coverage
from seqlens.operators.intervals import target_windows

COVERAGE = "window_id string, contig string, start int, end int, depth double, normalized double, sample string, shard int"
LIBRARIES = "biological_sample string, accepted_fragments long, excluded_fragments long, aligned_bases long, sample string"
EXCLUSIONS = "reason string, fragments long, sample string"
log = logging.getLogger(__name__)


def _write(rows: DataFrame, path: str, by: list[str], **counts) -> dict:
    """Replace the partitions of path that rows has; the counts are taken while rows are written."""
    seen = Observation()
    watched = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()])
    watched.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return {k: v or 0 for k, v in seen.get.items()}


def measure(spark: SparkSession, settings: dict, tables: str, output: str) -> dict[str, dict]:
    """Measure all libraries of the tables' folder into output; returns what was counted while it was written."""
    frames = {name: spark.read.parquet(f"{tables}/{name}.parquet") for name in settings["tables"]}
    given = {name: spark.sql(settings[name], **frames) for name in ("alignments", "targets", "libraries")}
    windows = target_windows(given["targets"], int(settings["window"]), int(settings["step"]))
    coverage, libraries, exclusions = library_coverage(given["alignments"], given["targets"], given["libraries"], windows, int(settings["min_mapq"]))
    coverage = coverage.withColumn("shard", F.pmod(F.xxhash64("contig"), F.lit(int(settings["shards"]))).cast("int"))
    told = {
        "coverage": _write(coverage.repartition("sample", "shard"), f"{output}/coverage", ["sample", "shard"], covered=F.count_if(F.col("depth") > 0)),
        "libraries": _write(libraries, f"{output}/libraries", ["sample"], **{c: F.sum(c) for c in ("accepted_fragments", "excluded_fragments", "aligned_bases")}),
        "exclusions": _write(exclusions, f"{output}/exclusions", ["sample"], fragments=F.sum("fragments")),
    }
    log.info("read %s of %s; wrote under %s: %s", ", ".join(settings["tables"]), tables, output, told)
    return told


def read_coverage(spark: SparkSession, output: str) -> DataFrame:
    """(sample, window_id, contig, start, end, depth, normalized) with the counts of each row's library."""
    coverage = spark.read.schema(COVERAGE).parquet(f"{output}/coverage")
    libraries = spark.read.schema(LIBRARIES).parquet(f"{output}/libraries")
    return coverage.drop("shard").join(libraries, "sample")


def read_exclusions(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(EXCLUSIONS).parquet(f"{output}/exclusions")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="jobs.library_coverage", description="Coverage of common targets by several libraries.")
    parser.add_argument("--config", required=True)
    parser.add_argument("tables")
    parser.add_argument("output")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(args.config, encoding="utf-8") as f:
        settings = json.load(f)
    spark = SparkSession.builder.appName("library_coverage").getOrCreate()
    try:
        measure(spark, settings, args.tables, args.output)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
