"""Readers of sequence, table, alignment and graph files; all distributed and strict."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlens.functions.sequence import fragment_id
from seqlens.operators.guards import once_each

HIT_COLUMNS = ("qseqid", "sseqid", "pident", "length", "qstart", "qend", "sstart", "send", "bitscore", "qseq", "sseq")
SEARCH_COLUMNS = ("query", "target", "fident", "qcov", "tcov", "evalue", "bits")


def refuse(bad: DataFrame, what: str) -> None:
    """Raise ValueError when bad has a row; one row is enough, so the check stops early."""
    rows = bad.limit(1).collect()
    if rows:
        raise ValueError(f"{what}: {rows[0].asDict()}")


def unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    refuse(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"repeated {what}")
    return df


def fasta(spark: SparkSession, path: str, upper: bool = True) -> DataFrame:
    """(ord, name, seq): names end at white space; gzip by suffix. A repeated name or a sequence without header is an error."""
    raw = spark.read.option("lineSep", "\n>").text(path).withColumn("ord", F.monotonically_increasing_id())
    text = F.regexp_replace(F.col("value"), "\r", "")
    rows = raw.select("ord", text.alias("t"), F.input_file_name().alias("file"))
    # one row a file: the records of a file never meet
    heads = rows.groupBy(F.col("file").alias("of")).agg(F.min("ord").alias("head"))
    rows = rows.join(heads, F.col("file") == F.col("of")).withColumn("first", F.col("ord") == F.col("head")).where(F.trim("t") != "")
    refuse(rows.where(F.col("first") & ~F.ltrim("t").startswith(">")).select("t"), "sequence without a header")
    body = F.when(F.col("first"), F.substring(F.ltrim("t"), F.lit(2), F.length("t"))).otherwise(F.col("t"))
    head = F.substring_index(body, "\n", 1)
    seq = F.regexp_replace(F.substring(body, F.length(head) + 1, F.length(body)), r"\s", "")
    out = rows.select("ord", F.regexp_extract(head, r"^\s*(\S*)", 1).alias("name"), (F.upper(seq) if upper else seq).alias("seq"))
    refuse(out.where("name = ''"), "empty sequence name")
    return unique(out, ["name"], "sequence name")


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """A strict table of strings: header checked for empty and repeated names, short and long rows refused, empty cells kept."""
    head = spark.read.text(path).limit(1).collect()
    names = head[0][0].lstrip("﻿").rstrip("\r").split("\t") if head else []
    if not names or "" in names or len(set(names)) < len(names):
        raise ValueError("a table needs distinct, non-empty column names")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema, mode="FAILFAST", enforceSchema=True)
    return rows.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])


def sam(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, targets): 11 fixed columns with typed positions and a map of tags; targets are the header's names and lengths."""
    lines = spark.read.text(path)
    heads = lines.where(F.col("value").startswith("@SQ\t"))
    targets = heads.select(F.regexp_extract("value", r"\tSN:([^\t\r]+)", 1).alias("rname"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"))
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    rows = lines.where((F.col("value") != "") & ~F.col("value").startswith("@")).select(f.alias("f"))
    refuse(rows.where(F.size("f") < 11), "alignment with fewer than 11 fields")
    names = [("qname", "string"), ("flag", "int"), ("rname", "string"), ("pos", "int"), ("mapq", "int"), ("cigar", "string"), ("rnext", "string"), ("pnext", "int"), ("tlen", "int"), ("seq", "string"), ("qual", "string")]
    tags = F.map_from_entries(F.transform(F.slice("f", 12, 1_000_000), lambda t: F.struct(F.substring_index(t, ":", 1), F.regexp_replace(t, "^[^:]*:[^:]*:", ""))))
    return rows.select(*[F.col("f")[i].cast(t).alias(n) for i, (n, t) in enumerate(names)], tags.alias("tags")), targets


def tag_score(tag: str, tags: str = "tags") -> Column:
    """A tag as a finite number, else null."""
    v = F.try_cast(F.col(tags)[tag], "double") if hasattr(F, "try_cast") else F.col(tags)[tag].try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def alignment_hits(spark: SparkSession, path: str) -> DataFrame:
    """11-column alignment rows; blank lines and comments are skipped, malformed ones refused."""
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#")).select(f.alias("f"))
    refuse(rows.where(F.size("f") != len(HIT_COLUMNS)), "alignment row with a wrong number of columns")
    kinds = ["string", "string", "double", "int", "int", "int", "int", "int", "double", "string", "string"]
    return rows.select(*[F.col("f")[i].cast(k).alias(n) for i, (n, k) in enumerate(zip(HIT_COLUMNS, kinds, strict=True))])


def search_hits(spark: SparkSession, path: str) -> DataFrame:
    """7-column search rows with an optional header; fractions in 0..1, evalue and bits finite and not negative."""
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    rows = spark.read.text(path).where((F.trim("value") != "") & (F.regexp_replace("value", "\r$", "") != "\t".join(SEARCH_COLUMNS))).select(f.alias("f"))
    refuse(rows.where(F.size("f") != len(SEARCH_COLUMNS)), "search row with a wrong number of columns")
    out = rows.select(*[F.col("f")[i].cast("string" if i < 2 else "double").alias(n) for i, n in enumerate(SEARCH_COLUMNS)])
    inside = F.lit(True)
    for c in ("fident", "qcov", "tcov"):
        inside = inside & F.col(c).between(0, 1)
    for c in ("evalue", "bits"):
        inside = inside & (F.col(c) >= 0) & ~F.isnan(c) & (F.col(c) < float("inf"))
    refuse(out.where(~F.coalesce(inside, F.lit(False))), "search row out of range")
    return out


def gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(segments (id, seq, dp), links (src, dst, overlap)) of a GFA1 file; overlaps must hold in both orientations."""
    from seqlens.operators.graph import bad_links

    lines = spark.read.text(path).select(F.split(F.regexp_replace("value", "\r$", ""), "\t", -1).alias("f"))
    s = lines.where(F.col("f")[0] == "S")
    dp = F.regexp_extract(F.array_join("f", "\t"), r"\tDP:[fi]:([^\t]+)", 1)
    segments = s.select(F.col("f")[1].alias("id"), F.upper(F.col("f")[2]).alias("seq"), F.when(dp != "", dp.cast("double")).alias("dp"))
    refuse(segments.where("seq = '*'"), "segment without a sequence")
    unique(segments, ["id"], "segment")
    link = lines.where(F.col("f")[0] == "L").select(*[F.col("f")[i].alias(n) for i, n in ((1, "a"), (2, "ao"), (3, "b"), (4, "bo"), (5, "cigar"))])
    refuse(link.where(~F.col("cigar").rlike(r"^\d+M$")), "link whose overlap is not a match")
    links = link.select(F.concat("a", "ao").alias("src"), F.concat("b", "bo").alias("dst"), F.regexp_extract("cigar", r"^(\d+)", 1).cast("int").alias("overlap"))
    refuse(bad_links(segments, links), "link that does not fit its segments")
    return segments, links


def contig_paths(spark: SparkSession, path: str) -> DataFrame:
    """(name, path) of one contig paths file: a name line, then lines of oriented nodes.

    A gap, null, stands for a semicolon inside a line and between lines: neighbours across it are no link. A name
    without nodes has an empty path, and of a repeated name the last counts. Nodes before any name are an error.
    """
    from seqlens.operators.positions import carried

    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "\r", "")).alias("line"), F.monotonically_increasing_id().alias("i")).where("line <> ''")
    is_nodes = F.col("line").rlike(r"^[0-9]+[+-]([,;][0-9]+[+-])*;?$")
    rows = carried(lines.withColumn("head", F.when(~is_nodes, F.struct("i", F.col("line").alias("name")))), "i", "head")
    refuse(rows.where("head IS NULL").select("line"), "path before a contig name")
    nodes = F.transform(F.split(F.regexp_replace(F.regexp_replace("line", ";+$", ""), ";", ",;,"), ","), lambda x: F.when(x != ";", x))
    step = F.when(F.col("i") != F.col("head.i"), F.struct("i", F.concat(F.array(F.lit(None).cast("string")), nodes).alias("n")))
    per = rows.groupBy("head").agg(F.flatten(F.transform(F.sort_array(F.collect_list(step)), lambda x: x["n"])).alias("path"))
    whole = F.when(F.size("path") > 1, F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0)))).otherwise(F.col("path"))
    return per.groupBy("head.name").agg(F.max_by(whole, F.col("head.i")).alias("path"))


def fastq(spark: SparkSession, path: str, strict: bool = True, suffix: bool = False) -> DataFrame:
    """(ord, id, seq, plus, qual) of four-line records, placed without a single-task sort; strict refuses malformed ones.

    id is without /1 or /2, which suffix=True keeps.
    """
    from seqlens.operators.positions import with_positions

    lines = spark.read.text(path).withColumn("m", F.monotonically_increasing_id())
    placed = with_positions(lines, [F.col("m")], "line", "fastq").select("line", F.regexp_replace("value", "\r$", "").alias("v"))
    per = placed.groupBy(F.floor(F.col("line") / 4).cast("long").alias("ord"))
    at = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("v")))
    rows = per.agg(at(0).alias("head"), at(1).alias("seq"), at(2).alias("plus"), at(3).alias("qual"))
    if strict:
        bad = ~F.col("head").startswith("@") | ~F.col("plus").startswith("+") | F.col("qual").isNull() | (F.length("seq") != F.length("qual")) | ~F.col("qual").rlike("^[!-~]*$") | ~F.upper("seq").rlike("^[ACGTRYSWKMBDHVN]*$")
        again = F.regexp_extract("plus", r"^\+\s*(\S*)", 1)
        name = F.regexp_extract("head", r"^@\s*(\S*)", 1)
        bad = bad | (F.length("seq") == 0) | (name == "") | (again != "") & (again != name)
        refuse(rows.where(F.coalesce(bad, F.lit(True))), "malformed read")
    return rows.select("ord", F.regexp_replace(F.regexp_extract("head", r"^@\s*(\S*)", 1), "$^" if suffix else "/[12]$", "").alias("id"), "seq", "plus", "qual")


def dump_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The leading columns of a file whose fields are parted by a bar between white space."""
    f = F.split("value", r"\|", -1)
    return spark.read.text(path).where(F.trim("value") != "").select(*[F.regexp_replace(f[i], r"^\s+|\s+$", "").alias(c) for i, c in enumerate(columns)])


def genbank(spark: SparkSession, path: str) -> DataFrame:
    """(accession, length, organism, taxonomy, taxid, molecule, topology, segment, completeness, definition, seq) of records in XML.

    length is that of the sequence; taxid and segment come from source features, several joined by semicolons. Only
    the definition can say complete, else it is unknown. A record without accession or sequence, or a repeated
    accession, is an error.
    """
    pair = "struct<GBQualifier_name:string,GBQualifier_value:string>"
    features = f"struct<GBFeature:array<struct<GBFeature_key:string,GBFeature_quals:struct<GBQualifier:array<{pair}>>>>>"
    plain = {"accession": "accession-version", "organism": "organism", "taxonomy": "taxonomy", "molecule": "moltype", "topology": "topology", "definition": "definition", "raw": "sequence"}
    schema = ", ".join(f"`GBSeq_{c}` string" for c in plain.values()) + f", `GBSeq_feature-table` {features}"
    raw = spark.read.format("xml").schema(schema).options(rowTag="GBSeq", mode="FAILFAST").load(path)
    source = F.filter(F.col("`GBSeq_feature-table`.GBFeature"), lambda f: f["GBFeature_key"] == "source")
    quals = F.flatten(F.transform(source, lambda f: F.coalesce(f["GBFeature_quals"]["GBQualifier"], F.array().cast(f"array<{pair}>"))))
    rows = raw.select(*[F.col(f"`GBSeq_{c}`").alias(n) for n, c in plain.items()], F.coalesce(quals, F.array().cast(f"array<{pair}>")).alias("quals"))
    rows = rows.withColumn("seq", F.upper(F.regexp_replace(F.coalesce("raw", F.lit("")), r"\s", "")))
    refuse(rows.where(F.coalesce(F.trim("accession"), F.lit("")).isin("") | (F.col("seq") == "")).select("accession"), "record without accession or sequence")
    unique(rows, ["accession"], "accession")
    named = lambda key: F.transform(F.filter("quals", lambda q: q["GBQualifier_name"] == key), lambda q: F.coalesce(q["GBQualifier_value"], F.lit("")))
    taxa = F.transform(F.filter(named("db_xref"), lambda v: v.startswith("taxon:")), lambda v: F.substring(v, 7, 1_000_000))
    whole = F.when(F.col("definition").rlike("(?i)complete (genome|sequence)"), "complete").otherwise("unknown")
    return rows.select(
        "accession", F.length("seq").cast("long").alias("length"), "organism", "taxonomy", F.array_join(taxa, ";").alias("taxid"), "molecule", "topology",
        F.array_join(named("segment"), ";").alias("segment"), whole.alias("completeness"), F.coalesce("definition", F.lit("")).alias("definition"), "seq",
    )


def accessions(spark: SparkSession, path: str) -> DataFrame:
    """(ord, accession): the distinct versioned nucleotide accessions of a list, a line each, ord telling where each came first; others, and an empty list, are errors."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    rows = lines.select("ord", F.regexp_replace("value", r"^\uFEFF|^\s+|\s+$", "").alias("accession")).where("accession <> ''")
    rows = rows.groupBy("accession").agg(F.min("ord").alias("ord")).select("ord", "accession")
    refuse(rows.where(~F.col("accession").rlike(r"^(NC|AC|NZ|NM|NR|XM|XR)_[0-9]+\.[0-9]+$")), "accession without a version")
    if not rows.limit(1).count():
        raise ValueError("empty accession list")
    return rows


def settings(path: str) -> dict:
    """A settings file of the driver: JSON, or YAML where a YAML library is installed; an empty YAML file is no settings."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def same_targets(targets: DataFrame, lengths: DataFrame) -> DataFrame:
    """targets (rname, length) of an alignment header, which must be exactly the names and lengths of (name, length); a difference fails the job that reads them."""
    return once_each(targets, lengths.select(F.col("name").alias("rname"), F.col("length").cast("long").alias("length")), ["rname", "length"], "target")


def sam_truth(records: DataFrame) -> DataFrame:
    """(fragment, mate, start, strand) of placed records (qname, flag, pos), a row a mate: where simulated reads come from; of several placements the last by position."""
    bit = lambda n: F.col("flag").bitwiseAND(F.lit(n)) != 0
    rows = records.where(~bit(4)).select(fragment_id(F.col("qname")).alias("fragment"), F.when(bit(64), 1).otherwise(2).alias("mate"), (F.col("pos") - 1).alias("start"), F.when(bit(16), "-").otherwise("+").alias("strand"))
    return rows.groupBy("fragment", "mate").agg(F.max(F.struct("start", "strand")).alias("p")).select("fragment", "mate", "p.*")


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, sha256) of the files of a folder: one task a file, their names relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.substring_index("path", folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    return files.select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def validate_snapshot(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """manifest (file, sha256) of a snapshot, whose files must be exactly those listed, each with its digest; any difference fails the job that reads it."""
    return once_each(manifest.select("file", "sha256"), file_digests(spark, folder).select("file", "sha256"), ["file", "sha256"], "file of the snapshot")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> None:
    """Raise ValueError unless both tables hold the same keys, each once."""
    for df in (left, right):
        unique(df, keys, what)
    for a, b, lost in ((left, right, "missing"), (right, left, "unexpected")):
        refuse(a.select(*keys).join(b.select(*keys), keys, "left_anti"), f"{lost} {what}")


def matrix(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(keys..., sample, value): a wide table, a column a sample, in long form; values must be finite and not negative."""
    wide = tsv(spark, path)
    samples = [c for c in wide.columns if c not in keys]
    if not samples or set(keys) - set(wide.columns):
        raise ValueError("a matrix needs its keys and a sample")
    out = wide.unpivot([F.col(f"`{k}`") for k in keys], [F.col(f"`{c}`") for c in samples], "sample", "cell").withColumn("value", F.col("cell").try_cast("double"))
    refuse(out.where(~F.coalesce((F.col("value") >= 0) & (F.col("value") < float("inf")), F.lit(False))), "matrix cell that is no coverage")
    return out.drop("cell")


def known(value: Column) -> Column:
    """A taxon name, null for the ways of writing unknown."""
    return F.when(~F.lower(F.trim(value)).isin("", "unknown", "na", "0"), value)
