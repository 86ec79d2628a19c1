"""Queries against their SQL on texts whose case is no matter of single ASCII letters."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from seqlens.plans import catalog


def test_pair_preparation_keeps_letters_single(spark, tmp_path):
    # 7 N in 93 letters are too many, and would not be if each sharp s gave two letters
    texts = ["n" * 14 + "a" * 180 + "\u00df" * 20, "n" * 21 + "a" * 264 + "\u0131\u017f" * 8, "\u0130\u212a\ufb01" * 90, "", "Gr\u00fc\u00dfe " * 60]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([0, 1], pa.int64()), "quality": pa.array([1, 0], pa.int32()), "toxic": pa.array([0, 1], pa.int32())}), tmp_path / "labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got = catalog.queries()["pair_preparation"](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()['pair_preparation']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_reported_quality_reads_texts_before_its_guards(spark, frame, tmp_path):
    """Guards and rows share one written table of lengths: nothing after them reads the contigs again."""
    from seqlens.operators import stages as T

    frame([("a", "ACGT"), ("b", "AC")], "contig string, seq string").write.parquet(str(tmp_path / "contigs"))
    summary = frame([("a", 4, "NA", 0.5, "DTR", "Viruses;")], "seq_name string, length int, coordinates string, virus_score double, topology string, taxonomy string")
    got = T.quality(spark.read.parquet(str(tmp_path / "contigs")), summary)
    assert not [f for f in got.inputFiles() if str(tmp_path) in f]
    assert {(r.contig, r.end, r.status) for r in got.collect()} == {("a", 4, "reported_viral_candidate"), ("b", 2, "not_reported")}
