"""The runnable jobs: runs over growing copies of tables, repeated batches, hard rows, guards and command lines."""

import hashlib
import json
import shutil
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import catalog_ingest, library_coverage

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).parent.parent


def _settings(job):
    return json.loads(Path(job.__file__).with_suffix(".json").read_text())


def _add(spark, rows, folder, name):
    """One more Parquet file in a folder that a stream reads."""
    spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").coalesce(1).write.parquet(str(folder / ("." + name)))
    (part,) = (folder / ("." + name)).glob("part-*.parquet")
    folder.joinpath("in").mkdir(exist_ok=True)
    shutil.move(part, folder / "in" / f"{name}.parquet")


def _catalog(rows):
    """The catalogue of rows (doc_id, text, source) by a loop."""
    held = defaultdict(list)
    for d, t, s, *_ in rows:
        seq = "".join("ACGT"[(ord(c) - 97) % 4] for c in (t or "").lower() if "a" <= c <= "z")
        if seq and d is not None:
            back = seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]
            held[min(seq, back)].append((f"d{d}", s))
    name = lambda c: "nv_" + hashlib.sha256(c.encode()).hexdigest()
    return sorted((name(c), len(c), len(m), len({s for _, s in m if s is not None}), min(n for n, _ in m)) for c, m in held.items())


def _read(spark, output):
    return sorted((r.catalog_id, r.length, r.members, r.sources, r.first_contig) for r in catalog_ingest.read_catalog(spark, output).collect())


FIRST = [(1, "abcde", "s", 0), (2, "abcde", "t", 0), (3, "", "s", 0), (None, "abcd", "s", 0), (4, None, None, 0), (5, "zz top", None, 0)]
LATER = [(0, "ABCDE", "u", 1), (6, "abb", "s", 1), (7, "ccd", "s", 1), (8, "1234", "s", 1), (9, "new words " * 2000, "s", 1), (9, "new words " * 2000, "s", 1)]


def test_catalog_grows_by_new_files_only(spark, tmp_path):
    settings, source = _settings(catalog_ingest), str(tmp_path / "in")
    output, checkpoint = str(tmp_path / "out"), str(tmp_path / "mark")
    run = lambda: catalog_ingest.ingest(spark, settings, source, output, checkpoint)
    _add(spark, FIRST, tmp_path, "a")
    told = run()
    assert told == {"batches": 1, "contigs": 3, "new_entries": 2, "rejected": 3} and _read(spark, output) == _catalog(FIRST)
    assert run() == {"batches": 0, "contigs": 0, "new_entries": 0, "rejected": 0} and _read(spark, output) == _catalog(FIRST)
    _add(spark, LATER, tmp_path, "b")
    told = run()
    # abcde is known; ccd spells the other strand of abb, so both are one entry
    assert told == {"batches": 1, "contigs": 5, "new_entries": 2, "rejected": 1}
    assert _read(spark, output) == _catalog(FIRST + LATER)
    lineage = spark.read.schema(catalog_ingest.LINEAGE).parquet(f"{output}/lineage")
    assert lineage.where("batch = 1").count() == 5 and lineage.where("contig = 'd6'").first().orientation != lineage.where("contig = 'd7'").first().orientation
    sequences = spark.read.schema(catalog_ingest.SEQUENCES).parquet(f"{output}/sequences").collect()
    assert sorted("nv_" + hashlib.sha256(r.seq.encode()).hexdigest() for r in sequences) == sorted(c[0] for c in _catalog(FIRST + LATER))
    rejected = spark.read.schema(catalog_ingest.REJECTED).parquet(f"{output}/rejected").collect()
    assert sorted((r.contig or "", r.reason) for r in rejected) == [("", "unnamed"), ("d3", "empty"), ("d4", "empty"), ("d8", "empty")]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    settings, source = _settings(catalog_ingest) | {"shard_digits": 2, "files_per_shard": 2}, str(tmp_path / "in")
    output, checkpoint = str(tmp_path / "out"), tmp_path / "mark"
    _add(spark, FIRST, tmp_path, "a")
    catalog_ingest.ingest(spark, settings, source, output, str(checkpoint))
    _add(spark, LATER, tmp_path, "b")
    catalog_ingest.ingest(spark, settings, source, output, str(checkpoint))
    names = ("lineage", "sequences", "rejected", "catalog")
    rows = lambda: {n: sorted(map(repr, spark.read.schema(getattr(catalog_ingest, n.upper())).parquet(f"{output}/{n}").collect())) for n in names}
    before = rows()
    # as if the run had ended after the last batch's writes, before the checkpoint knew of them
    for mark in ("1", ".1.crc"):
        (checkpoint / "commits" / mark).unlink(missing_ok=True)
    assert catalog_ingest.ingest(spark, settings, source, output, str(checkpoint))["batches"] == 1
    assert rows() == before


def test_batches_of_any_size_make_the_same_catalogue(spark, tmp_path):
    docs = [(r.doc_id, r.text, r.source, 0) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    for i in range(3):
        _add(spark, docs[i::3], tmp_path, f"f{i}")
    settings = _settings(catalog_ingest) | {"files_per_batch": 1}
    told = catalog_ingest.ingest(spark, settings, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"))
    assert told["batches"] == 3 and told["contigs"] + told["rejected"] == len(docs)
    assert _read(spark, str(tmp_path / "out")) == _catalog(docs)


def test_catalog_of_an_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    told = catalog_ingest.ingest(spark, _settings(catalog_ingest), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"))
    assert told["batches"] == 0 and _read(spark, str(tmp_path / "out")) == []


def _tables(spark, folder, records, targets=(("c", 300), ("e", 40))):
    kind = "sample string, qname string, flag int, rname string, pos int, mapq int, cigar string, score double, other double"
    spark.createDataFrame(records, kind).write.mode("overwrite").parquet(str(folder / "sam.parquet"))
    spark.createDataFrame(list(targets), "contig string, length int").write.mode("overwrite").parquet(str(folder / "targets.parquet"))
    return {"tables": ["sam", "targets"], "alignments": "SELECT * FROM {sam}", "targets": "SELECT * FROM {targets}", "libraries": "SELECT DISTINCT sample, substring(sample, 1, 1) AS biological_sample FROM {sam}", "window": 100, "step": 100, "min_mapq": 20, "shards": 2}


def _pair(sample, q, a=1, b=51, flags=(99, 147), mapq=(30, 30), rname=("c", "c"), cigar="100M", other=None):
    return [(sample, q, f, r, p, m, cigar, 0.0, other) for f, p, m, r in zip(flags, (a, b), mapq, rname, strict=True)]


def test_coverage_counts_pairs_and_names_what_keeps_others_out(spark, tmp_path):
    records = _pair("x1", "good") + _pair("x1", "mapq", mapq=(30, 255)) + _pair("x1", "dup", flags=(99 + 1024, 147)) + _pair("x1", "tie", other=0.0) + _pair("x1", "weaker", a=101, b=151, other=-1.0)
    records += _pair("x1", "two", rname=("c", "e"), cigar="40M") + _pair("x1", "single")[:1] + _pair("x1", "extra") + [("x1", "extra", 99 + 2048, "e", 1, 30, "40M", 0.0, None)]
    records += _pair("x1", "rival") + [("x1", "rival", 99 + 256, "c", 150, 30, "100M", 0.0, None)] + _pair("x1", "lesser") + [("x1", "lesser", 99 + 256, "c", 150, 30, "100M", -3.0, None)]
    records += _pair("x2", "good", a=201, b=201) + _pair("y", "none", mapq=(0, 0))
    settings, output = _tables(spark, tmp_path, records), str(tmp_path / "out")
    told = library_coverage.measure(spark, settings, str(tmp_path), output)
    assert told["coverage"] == {"rows": 12, "covered": 4} and told["exclusions"]["fragments"] == 8
    rows = library_coverage.read_coverage(spark, output).collect()
    assert {(r.sample, r.window_id): r.depth for r in rows} == {
        ("x1", "c:0"): 2.0, ("x1", "c:100"): 2.0, ("x1", "c:200"): 0.5, ("x1", "e:0"): 0.0, ("x2", "c:0"): 0.0, ("x2", "c:100"): 0.0, ("x2", "c:200"): 1.0, ("x2", "e:0"): 0.0,
        ("y", "c:0"): 0.0, ("y", "c:100"): 0.0, ("y", "c:200"): 0.0, ("y", "e:0"): 0.0,
    }
    stats = {r.sample: (r.biological_sample, r.accepted_fragments, r.excluded_fragments, r.aligned_bases) for r in rows}
    assert stats == {"x1": ("x", 3, 7, 450), "x2": ("x", 1, 0, 100), "y": ("y", 0, 1, 0)}
    assert all(r.normalized == (r.depth * 1e6 / r.aligned_bases if r.aligned_bases else 0.0) for r in rows)
    reasons = {(r.sample, r.reason): r.fragments for r in library_coverage.read_exclusions(spark, output).collect()}
    assert reasons == {("x1", "filtered_record"): 2, ("x1", "tied_score"): 1, ("x1", "not_a_pair"): 1, ("x1", "not_two_primaries"): 1, ("x1", "competing_placement"): 2, ("y", "filtered_record"): 1}

    again = library_coverage.measure(spark, settings, str(tmp_path), output)
    assert again == told and sorted(map(repr, library_coverage.read_coverage(spark, output).collect())) == sorted(map(repr, rows))
    # another library's run leaves the first ones' partitions
    _tables(spark, tmp_path, _pair("z", "late"))
    library_coverage.measure(spark, settings, str(tmp_path), output)
    assert {r.sample for r in library_coverage.read_coverage(spark, output).collect()} == {"x1", "x2", "y", "z"}


def test_coverage_refuses_blocks_outside_and_unknown_libraries(spark, tmp_path):
    settings = _tables(spark, tmp_path, _pair("x", "far", a=250, b=250))
    with pytest.raises(Exception, match="interval outside its target: c 249 349"):
        library_coverage.measure(spark, settings, str(tmp_path), str(tmp_path / "out"))
    settings["libraries"] = "SELECT 'y' AS sample, 'y' AS biological_sample"
    with pytest.raises(Exception, match="unknown library x"):
        library_coverage.measure(spark, settings, str(tmp_path), str(tmp_path / "out"))
    settings["libraries"] = "SELECT sample, sample AS biological_sample FROM {sam}"
    with pytest.raises(ValueError, match="repeated"):
        library_coverage.measure(spark, settings, str(tmp_path), str(tmp_path / "out"))


@pytest.mark.parametrize("job", [catalog_ingest, library_coverage])
def test_command_lines(spark, tmp_path, job):
    config = str(Path(job.__file__).with_suffix(".json"))
    copy = tmp_path / "tables"
    copy.mkdir()
    for name in ("documents", "lineitem", "supplier"):
        shutil.copy(f"{SF}/{name}.parquet", copy)
    places = [str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")] if job is catalog_ingest else [str(copy), str(tmp_path / "out")]
    if job is catalog_ingest:
        (tmp_path / "in").mkdir()
        shutil.copy(copy / "documents.parquet", tmp_path / "in")
    done = subprocess.run(["timeout", "300", sys.executable, "-m", job.__name__, "--config", config, *places], cwd=ROOT, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote" in done.stderr
    got = catalog_ingest.read_catalog(spark, places[1]).agg(F.sum("members")).first()[0] if job is catalog_ingest else library_coverage.read_coverage(spark, places[1]).count()
    assert got > 0
