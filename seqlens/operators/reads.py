"""Read pairs: validation, quality control, pooling; open reading frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.functions.sequence import count_of, mean_phred, n_fraction
from seqlens.sources.readers import refuse, unique

#: The standard genetic code in the order T, C, A, G of each position; * is a stop.
_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: _CODE[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
#: What an independent host search says of a fragment.
HOST = ("host_supported", "ambiguous", "nonhost", "unclassified")
#: The place of each byte in T, C, A, G, 4 for others, and the amino acid of three places in base 5.
_BASE = np.full(256, 4, np.intp)
_BASE[[ord(c) for c in "TCAG"]] = range(4)
_AMINO = np.frombuffer("".join(CODONS.get(a + b + c, "X") for a in "TCAG-" for b in "TCAG-" for c in "TCAG-").encode(), np.uint8)
_PAIR = str.maketrans("ACGTRYMKBDHVN", "TGCAYRKMVHDBN")


def defects(seq, qual, min_length: int = 50, min_phred: float = 20, max_n: float = 0.1):
    """All reasons why a mate fails quality control, as an array."""
    if min_length < 1 or not 0 <= min_phred <= 93 or not 0 <= max_n <= 1:
        raise ValueError("invalid quality limits")
    told = [F.when(F.length(seq) < min_length, "short"), F.when(mean_phred(qual) < min_phred, "low_quality"), F.when(n_fraction(seq) > max_n, "excess_N")]
    return F.array_compact(F.array(*told))


def poor(seq, qual, min_length: int = 50, min_phred: float = 20, max_n: float = 0.1):
    """The first reason why a mate fails quality control; null if it doesn't."""
    return F.get(defects(seq, qual, min_length, min_phred, max_n), F.lit(0))


def invalid_reads(reads: DataFrame) -> DataFrame:
    """Reads (id, seq, qual) that no FASTQ may hold: lengths differ, letters or qualities out of range, repeated id."""
    bad = (F.length("seq") != F.length("qual")) | (count_of(F.upper("seq"), "ACGTRYSWKMBDHVN") != F.length("seq")) | ~F.col("qual").rlike("^[!-~]*$")
    twice = reads.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    return reads.where(bad).select("id").unionByName(twice).distinct()


def prepare_pairs(r1: DataFrame, r2: DataFrame, host: DataFrame | None = None, remove_host: bool = False, **limits) -> DataFrame:
    """(fragment, destination, reason, host_status) of pairs joined on their position.

    r1, r2: ord, id, seq, qual. host: fragment, status (one of HOST). A fragment with a poor mate is filtered, with all
    reasons of both mates; else one with host support is removed, if asked for; all others are retained. Ambiguity
    alone removes nothing, and a fragment without a call is not_assessed. Mates out of order or with the
    other side's suffix, repeated fragments, and repeated, invalid or foreign calls are errors.
    """
    if remove_host and host is None:
        raise ValueError("host removal needs calls")
    side = lambda r, i: r.select("ord", F.col("id").alias(f"id{i}"), F.col("seq").alias(f"s{i}"), F.col("qual").alias(f"q{i}"))
    bare = lambda c: F.regexp_replace(c, "/[12]$", "")
    rows = side(r1, 1).join(side(r2, 2), "ord", "full")
    refuse(rows.where(~F.coalesce(bare("id1") == bare("id2"), F.lit(False))).select("ord", "id1", "id2"), "mates are missing or out of order")
    refuse(rows.where(F.col("id1").endswith("/2") | F.col("id2").endswith("/1")).select("id1", "id2"), "mate suffix of the other side")
    rows = rows.withColumn("fragment", bare("id1"))
    unique(rows, ["fragment"], "fragment")
    calls = rows.select("fragment").limit(0).withColumn("status", F.lit("")) if host is None else host.select("fragment", "status")
    if host is not None:
        refuse(calls.where(~F.coalesce(F.col("status").isin(*HOST), F.lit(False))), "invalid host call")
        unique(calls, ["fragment"], "host call")
        refuse(calls.join(rows, "fragment", "left_anti"), "host call of an unknown fragment")
    rows = rows.join(calls.withColumnRenamed("status", "host_status"), "fragment", "left").fillna("not_assessed", ["host_status"])
    rows = rows.withColumn("why", F.array_sort(F.array_union(defects(F.col("s1"), F.col("q1"), **limits), defects(F.col("s2"), F.col("q2"), **limits))))
    gone = F.lit(remove_host) & (F.col("host_status") == "host_supported")
    where = F.when(F.size("why") > 0, "quality_filtered").when(gone, "host_removed").otherwise("retained")
    rows = rows.withColumn("destination", where)
    return rows.select("fragment", "destination", F.when(F.col("destination") == "host_removed", "explicit_host_support").otherwise(F.array_join("why", ";")).alias("reason"), "host_status")


def pools(reads: DataFrame, membership: DataFrame, samples: DataFrame, max_groups: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pooled reads, missing, sizes): reads of each group's selected fragments, selections without a read, and pool sizes."""
    if membership.select("group").distinct().count() > max_groups:
        raise ValueError("more groups than max_groups")
    m = membership.select("group", "sample", "fragment").distinct()
    pooled = m.join(reads, ["sample", "fragment"])
    missing = m.join(reads.select("sample", "fragment").distinct(), ["sample", "fragment"], "left_anti")
    sizes = m.join(samples, "sample").groupBy("group").agg(F.count(F.lit(1)).alias("fragments"), F.countDistinct("biological_sample").alias("biological_samples"))
    return pooled, missing, sizes


def translate(seq: str) -> str:
    """Amino acids of whole codons; X for a codon with any letter but A, C, G, T."""
    # one byte a letter: what isn't ASCII is no base
    at = _BASE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    n = len(at) // 3 * 3
    return _AMINO[25 * at[0:n:3] + 5 * at[1:n:3] + at[2:n:3]].tobytes().decode("ascii")


def six_frame_orfs(seqs: DataFrame, min_aa: int = 75, max_x: float = 0.1) -> DataFrame:
    """(name, start, end, strand, frame, partial, protein): stretches between stops in all six frames.

    partial: the stretch touches the frame's first or last whole codon instead of a stop. Coordinates are on
    the forward strand and do not hold the stop.
    """
    def find(text: str) -> Iterator[tuple]:
        n = len(text)
        for strand, s in (("+", text), ("-", text.translate(_PAIR)[::-1])):
            for frame in range(3):
                aa, begin = translate(s[frame:]), 0
                for part in aa.split("*"):
                    end = begin + len(part)
                    if len(part) >= min_aa and part.count("X") <= max_x * len(part):
                        a, b = frame + 3 * begin, frame + 3 * end
                        yield (a if strand == "+" else n - b, b if strand == "+" else n - a, strand, frame, begin == 0 or end == len(aa), part)
                    begin = end + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # a table a hundred texts, so that neither tables nor rows held are many
            for i in range(0, len(batch), 100):
                if rows := [(name, *r) for name, text in batch[i : i + 100].itertuples(index=False) for r in find(text or "")]:
                    yield pd.DataFrame(rows, columns=["name", "start", "end", "strand", "frame", "partial", "protein"])

    return seqs.select("name", "seq").mapInPandas(run, "name string, start int, end int, strand string, frame int, partial boolean, protein string")
