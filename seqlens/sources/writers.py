"""Writers: each makes a new folder and refuses an existing one."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns as tab-separated text; booleans in lower case, nulls as empty cells."""
    df.select(*columns).write.csv(path, sep="\t", header=True, mode="errorifexists", nullValue="", emptyValue="")


def write_fasta(seqs: DataFrame, path: str, width: int = 80) -> None:
    """Records with lines of width letters."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    seqs.select(F.concat(F.lit(">"), "name", F.lit("\n"), body).alias("value")).write.text(path)


def write_fastq(reads: DataFrame, path: str, by: list[str]) -> None:
    """Gzip text of reads (id, seq, qual), a folder for each value of the by columns; ordered by ord within files."""
    rows = reads.select(*by, "ord", F.concat_ws("\n", F.concat(F.lit("@"), "id"), "seq", F.lit("+"), "qual").alias("value"))
    rows.repartition(*by).sortWithinPartitions(*by, "ord").drop("ord").write.partitionBy(*by).option("compression", "gzip").text(path)


def write_audit(df: DataFrame, path: str) -> None:
    """A JSON object a row."""
    df.write.json(path, mode="errorifexists")


def fingerprint(value) -> str:
    """Digest of a value's canonical JSON; numbers that JSON lacks are an error."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def write_summary(spark: SparkSession, value, path: str) -> None:
    """A small value of the driver as one indented JSON text with sorted keys."""
    text = json.dumps(value, sort_keys=True, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)
