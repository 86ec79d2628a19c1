import gzip

import pytest
from pyspark.sql import functions as F

from seqlens.sources import readers as R
from seqlens.sources import writers as W


def _file(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
    return str(p)


@pytest.mark.parametrize("name", ["a.fa", "a.fa.gz"])
def test_fasta(spark, tmp_path, name):
    rows = R.fasta(spark, _file(tmp_path, name, ">a one\r\nacg\r\n\r\nt\r\n>b\nNN\n")).orderBy("ord").collect()
    assert [(r.name, r.seq) for r in rows] == [("a", "ACGT"), ("b", "NN")]


@pytest.mark.parametrize("text", ["ACGT\n", ">a\nA\n>a\nC\n", "> \nA\n"])
def test_fasta_refuses(spark, tmp_path, text):
    with pytest.raises(ValueError):
        R.fasta(spark, _file(tmp_path, "x.fa", text))


def test_fasta_round_trip(spark, frame, tmp_path):
    seqs = frame([("a", "ACGT" * 50), ("b", "G" * 80)], "name string, seq string")
    W.write_fasta(seqs.coalesce(1), str(tmp_path / "out"))
    assert {(r.name, r.seq) for r in R.fasta(spark, str(tmp_path / "out")).collect()} == {(r.name, r.seq) for r in seqs.collect()}


def test_tsv(spark, tmp_path):
    assert [tuple(r) for r in R.tsv(spark, _file(tmp_path, "t.tsv", "a\tb\r\n1\t\r\n")).collect()] == [("1", "")]
    with pytest.raises(ValueError):
        R.tsv(spark, _file(tmp_path, "u.tsv", "a\ta\n1\t2\n"))
    with pytest.raises(Exception, match="(?i)malformed|column"):
        R.tsv(spark, _file(tmp_path, "v.tsv", "a\tb\n1\n")).collect()


def test_sam(spark, tmp_path):
    rows, targets = R.sam(spark, _file(tmp_path, "s.sam", "@SQ\tSN:c\tLN:9\nq\t67\tc\t1\t60\t5M\t=\t1\t5\tACGTA\tIIIII\tAS:i:-3\tXS:f:nan\n"))
    r = rows.select("qname", "pos", "tags", R.tag_score("AS").alias("a"), R.tag_score("XS").alias("x")).first()
    assert (r.qname, r.pos, r.a, r.x) == ("q", 1, -3.0, None) and [tuple(t) for t in targets.collect()] == [("c", 9)]


def test_hits(spark, tmp_path):
    line = "q\tt\t99.5\t4\t1\t4\t4\t1\t50\tACGT\tACGT\n"
    assert R.alignment_hits(spark, _file(tmp_path, "h.tsv", "# c\n\n" + line)).first().sstart == 4
    ok = R.search_hits(spark, _file(tmp_path, "s.tsv", "\t".join(R.SEARCH_COLUMNS) + "\nq\tt\t0.9\t1\t1\t1e-9\t80\n"))
    assert ok.first().fident == 0.9
    with pytest.raises(ValueError):
        R.search_hits(spark, _file(tmp_path, "b.tsv", "q\tt\t90\t1\t1\t1e-9\t80\n"))


def test_gfa_and_paths(spark, tmp_path):
    g = "S\t1\tAACCGG\tDP:f:2.5\nS\t2\tGGTTAA\nL\t1\t+\t2\t+\t2M\n"
    segs, links = R.gfa(spark, _file(tmp_path, "g.gfa", g))
    assert segs.where("id = '1'").first().dp == 2.5 and links.first().overlap == 2
    with pytest.raises(ValueError):
        R.gfa(spark, _file(tmp_path, "b.gfa", g.replace("2M", "3M")))
    paths = R.contig_paths(spark, _file(tmp_path, "p.paths", "NODE_1\n1+,2+;\n3-\nNODE_1'\n3+;\n2-,1-\n"))
    assert {r.name: r.path for r in paths.collect()} == {"NODE_1": ["1+", "2+", None, "3-"], "NODE_1'": ["3+", None, "2-", "1-"]}
    more = R.contig_paths(spark, _file(tmp_path, "q.paths", "a\n1+;2-,3+\nempty\nb\n1+,2+\n3+,4-\n"))
    assert {r.name: r.path for r in more.collect()} == {"a": ["1+", None, "2-", "3+"], "empty": [], "b": ["1+", "2+", None, "3+", "4-"]}
    with pytest.raises(ValueError):
        R.contig_paths(spark, _file(tmp_path, "r.paths", "1+,2+\na\n3+\n"))


def test_fastq(spark, tmp_path):
    rows = R.fastq(spark, _file(tmp_path, "r.fq", "@a/1 x\nACGT\n+\nIIII\n@b/1\nAC\n+\nII\n")).orderBy("ord").collect()
    assert [(r.ord, r.id, r.qual) for r in rows] == [(0, "a", "IIII"), (1, "b", "II")]
    with pytest.raises(ValueError):
        R.fastq(spark, _file(tmp_path, "s.fq", "@a\nACGT\n+\nIII\n"))


def test_fastq_fan_out(spark, frame, tmp_path):
    reads = frame([(0, "a", "AC", "II", "x"), (1, "b", "AC", "II", "y")], "ord int, id string, seq string, qual string, destination string")
    W.write_fastq(reads, str(tmp_path / "o"), ["destination"])
    assert spark.read.text(str(tmp_path / "o" / "destination=x")).first().value == "@a"


def test_dump_genbank_and_names(spark, tmp_path):
    assert [tuple(r) for r in R.dump_table(spark, _file(tmp_path, "n.dmp", "1\t|\t1\t|\tno rank\t|\n"), ["node", "parent", "rank"]).collect()] == [("1", "1", "no rank")]
    xml = "<GBSet><GBSeq><GBSeq_accession-version>A.1</GBSeq_accession-version><GBSeq_definition>X, complete genome</GBSeq_definition><GBSeq_length>4</GBSeq_length><GBSeq_sequence>acgt</GBSeq_sequence></GBSeq></GBSet>"
    r = R.genbank(spark, _file(tmp_path, "g.xml", xml)).first()
    assert (r.accession, r.completeness, r.seq, r.topology) == ("A.1", "complete", "ACGT", None)
    assert spark.range(1).select(R.known(F.lit("NA")).alias("v")).first().v is None


GB = "<GBSeq><GBSeq_accession-version>{0}</GBSeq_accession-version><GBSeq_sequence>{1}</GBSeq_sequence>{2}</GBSeq>"


def test_genbank_sources_and_refusals(spark, tmp_path):
    qual = lambda k, v: f"<GBQualifier><GBQualifier_name>{k}</GBQualifier_name><GBQualifier_value>{v}</GBQualifier_value></GBQualifier>"
    feature = "<GBFeature><GBFeature_key>{}</GBFeature_key><GBFeature_quals>{}</GBFeature_quals></GBFeature>"
    table = feature.format("source", qual("segment", "RNA1") + qual("db_xref", "taxon:7") + qual("db_xref", "other:8")) + feature.format("CDS", qual("segment", "no"))
    more = f"<GBSeq_topology>circular</GBSeq_topology><GBSeq_definition>v, complete segment</GBSeq_definition><GBSeq_moltype>RNA</GBSeq_moltype><GBSeq_feature-table>{table}</GBSeq_feature-table>"
    r = R.genbank(spark, _file(tmp_path, "a.xml", "<GBSet>" + GB.format("NC_000001.1", "acgt", more) + "</GBSet>")).first()
    assert (r.seq, r.length, r.segment, r.taxid, r.molecule, r.completeness, r.topology) == ("ACGT", 4, "RNA1", "7", "RNA", "unknown", "circular")
    for i, bad in enumerate([GB.format("A.1", "ac", "") * 2, GB.format("", "ac", ""), GB.format("A.1", "", "")]):
        with pytest.raises(ValueError):
            R.genbank(spark, _file(tmp_path, f"b{i}.xml", f"<GBSet>{bad}</GBSet>"))


def test_accessions_matrix_and_keys(spark, frame, tmp_path):
    listed = R.accessions(spark, _file(tmp_path, "a.txt", "NC_003.1\nNC_001802.1\n\nNC_003.1\nNC_001.2\n"))
    assert [r.accession for r in listed.orderBy("ord").collect()] == ["NC_003.1", "NC_001802.1", "NC_001.2"]
    with pytest.raises(ValueError):
        R.accessions(spark, _file(tmp_path, "b.txt", "NC_001802\n"))
    long = R.matrix(spark, _file(tmp_path, "m.tsv", "window_id\ts1\ts2\nw\t1\t0.5\n"), ["window_id"])
    assert {(r.window_id, r.sample, r.value) for r in long.collect()} == {("w", "s1", 1.0), ("w", "s2", 0.5)}
    with pytest.raises(ValueError):
        R.matrix(spark, _file(tmp_path, "n.tsv", "window_id\ts1\nw\t-1\n"), ["window_id"])
    ab, abb, a = (frame([(x,) for x in n], "k string") for n in ("ab", "abb", "a"))
    R.same_keys(ab, ab, ["k"], "unit")
    for bad in (abb, a):
        with pytest.raises(ValueError):
            R.same_keys(ab, bad, ["k"], "unit")


@pytest.mark.parametrize("text", ["@\nACGT\n+\nIIII\n", "@q/1\nACGT\n+other\nIIII\n", "@q\n\n+\n\n"])
def test_fastq_identifiers(spark, tmp_path, text):
    with pytest.raises(ValueError):
        R.fastq(spark, _file(tmp_path, "x.fq", text))
    assert R.fastq(spark, _file(tmp_path, "y.fq", "@q/1\nA\n+q/1\nI\n"), suffix=True).first().id == "q/1"


def test_streaming_screen(spark, frame, tmp_path):
    from seqlens.streaming.read_qc import screen

    reads = frame([("a", "A" * 60, "I" * 60), ("b", "A", "I")], "id string, seq string, qual string")
    reads.write.parquet(str(tmp_path / "in"))
    stream = screen(spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("screened").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.id: r.reason for r in spark.table("screened").collect()} == {"a": None, "b": "short"}


def test_fasta_of_many_files_and_splits(spark, tmp_path):
    for i in range(3):
        _file(tmp_path, f"f{i}.fa", "".join(f">n{i}.{j} x\n{'ACGT' * (j + 1)}\nNN\n" for j in range(50)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = R.fasta(spark, str(tmp_path / "*.fa")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r.name, r.seq) for r in rows} == {(f"n{i}.{j}", "ACGT" * (j + 1) + "NN") for i in range(3) for j in range(50)}


def test_settings_and_summaries(spark, tmp_path):
    assert R.settings(_file(tmp_path, "a.json", '{"k": 31, "ranks": ["species"]}')) == {"k": 31, "ranks": ["species"]}
    W.write_summary(spark, {"b": 1, "a": [2, None]}, str(tmp_path / "summary"))
    assert "\n".join(r.value for r in spark.read.text(str(tmp_path / "summary")).collect()) == '{\n  "a": [\n    2,\n    null\n  ],\n  "b": 1\n}'
    with pytest.raises(Exception, match="already exists"):
        W.write_summary(spark, {}, str(tmp_path / "summary"))
    assert W.fingerprint({"b": 1, "a": 2}) == W.fingerprint({"a": 2, "b": 1})
    with pytest.raises(ValueError):
        W.fingerprint({"a": float("nan")})


def test_header_targets_and_true_places(spark, frame, tmp_path):
    head = "@SQ\tSN:c\tLN:400\n@SQ\tSN:d\tLN:9\n"
    row = lambda name, flag, pos: f"{name}\t{flag}\tc\t{pos}\t30\t4M\t=\t1\t0\tACGT\tIIII\n"
    records, targets = R.sam(spark, _file(tmp_path, "x.sam", head + row("f/1", 67, 11) + row("f/2", 147, 21) + row("g", 4, 1) + row("h", 16, 5)))
    names = lambda *rows: frame(list(rows), "name string, length int")
    assert R.same_targets(targets, names(("d", 9), ("c", 400))).count() == 2
    for bad, said in ((names(("c", 400)), "missing target"), (names(("c", 400), ("d", 8)), "target"), (names(("c", 400), ("d", 9), ("e", 1)), "unexpected target"), (names(("c", 400), ("d", 9), ("d", 9)), "repeated target")):
        with pytest.raises(Exception, match=said):
            R.same_targets(targets, bad).collect()
    truth = {(r.fragment, r.mate): (r.start, r.strand) for r in R.sam_truth(records).collect()}
    assert truth == {("f", 1): (10, "+"), ("f", 2): (20, "-"), ("h", 2): (4, "-")}


def test_snapshots_are_compared_as_sets(spark, frame, tmp_path):
    import hashlib

    folder = tmp_path / "snapshot"
    (folder / "sub").mkdir(parents=True)
    files = {"reference.fasta": ">NC_000001.1\nACGT\n", "sub/metadata.tsv": "accession\n"}
    for name, text in files.items():
        _file(folder, name, text)
    manifest = frame([(n, hashlib.sha256(t.encode()).hexdigest()) for n, t in files.items()], "file string, sha256 string")
    assert R.validate_snapshot(spark, str(folder), manifest).count() == 2
    assert {r.file: r.bytes for r in R.file_digests(spark, str(folder)).collect()} == {n: len(t) for n, t in files.items()}
    _file(folder, "reference.fasta", ">NC_000001.1\nAAAA\n")
    with pytest.raises(Exception, match="file of the snapshot"):
        R.validate_snapshot(spark, str(folder), manifest).collect()
    _file(folder, "reference.fasta", files["reference.fasta"])
    _file(folder, "more.txt", "x")
    with pytest.raises(Exception, match="missing file|unexpected file"):
        R.validate_snapshot(spark, str(folder), manifest).collect()


def test_proposals_are_checked_where_they_are_read(spark, frame):
    from seqlens.operators import stages as T

    seqs = frame([("c", "A" * 100)], "name string, seq string")
    kind = "contig string, start int, end int, method string, score double"
    good, more = frame([("c", 1, 5, "coverage", 0.5)], kind), frame([("c", 100, 100, "nmf", 1.0, "x")], kind + ", detail string")
    assert {(r.method, r.detail) for r in T.proposals([good, more], seqs).collect()} == {("coverage", None), ("nmf", "x")}
    for row in (("c", 1, 101, "m", 0.5), ("c", 6, 5, "m", 0.5), ("d", 1, 5, "m", 0.5), ("c", -1, 5, "m", 0.5), ("c", 1, 5, "", 0.5), ("c", 1, 5, "m", 1.5), ("c", 1, 5, "m", float("nan")), ("c", 1, 5, "m", None)):
        lazy = T.proposals([good, frame([row], kind)], seqs)  # nothing runs before the rows are read
        with pytest.raises(Exception, match="invalid proposal|outside its target"):
            lazy.collect()
