"""A content-addressed store of token ids.

Method: a rolling hash over the last WINDOW ids cuts each document's id stream where its
bits are zero, so equal passages give equal chunks wherever they stand. A chunk is addressed
by its digest and stored once, in the row of the first document (by start) that has it; other
documents' recipes point there. A recipe lists chunk digests in order, and its root is the
Merkle root over them. The manifest holds the counts of documents, ids and chunks and the
Merkle root over all documents' roots in order of start. Reading back checks the manifest
against the files first, then every chunk's digest, every root and every length.

Layout under the given folder: pack/ Parquet (zstd), a row per document, in ascending doc_id
order within files and from file to file; manifest/ one row. start is the document's place in
the stream of all ids in that order. Ids take 2 bytes where the vocabulary allows it, else 4,
and a row's ids are one zstd frame, so that they stay small while they travel.

Texts are encoded as the tokenizers library does by default: the string of an added token in a
text becomes that token's id.

Defined results: null text is the empty text, whose stream is the end id alone; null ids
come last; a very long text is encoded in parts and chunked like any other; rows with equal
ids are ordered by content, and repeated rows each get a start of their own and share their
chunks; further columns, whatever their names, are not read; an empty table makes an empty
store. Chunks that very many documents share are joined by broadcast, at most HOT_KEYS of them.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.llm.run_encoder import RunEncoder
from seqlens.operators.positions import with_prefix_sums
from seqlens.operators.skew import hot_join
from seqlens.session import drop_shared, shared_table

WINDOW, SHORTEST, LONGEST, MASK = 16, 64, 4096, np.uint64(511)
#: Documents whose starts agree above these bits are children of one node of the manifest's tree; of nodes, 2**10.
LEAF_BITS, NODE_BITS = 16, 10


@functools.lru_cache(maxsize=1)
def _encoder(definition: str, end_id: int) -> RunEncoder:
    """One encoder a worker process: its memory of runs outlives a task."""
    return RunEncoder(definition, end_id)


def cut_points(ids: np.ndarray, starts: np.ndarray) -> list[list[int]]:
    """Ends of each document's chunks (relative to its start); starts has one entry more than documents."""
    rolled = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    rolled ^= rolled >> np.uint64(29)
    span, factor = 1, 0xD1342543DE82EF95
    while span < WINDOW:  # a window twice as wide is the sum of two
        rolled[span:] += rolled[:-span] * np.uint64(factor)
        span, factor = 2 * span, factor * factor % 2**64
    found = np.flatnonzero((rolled >> np.uint64(40)) & MASK == 0) + 1
    edges = np.searchsorted(found, starts)
    out = []
    for d in range(len(starts) - 1):
        begin, end, last, ends = int(starts[d]), int(starts[d + 1]), int(starts[d]), []
        for c in [*found[edges[d] : edges[d + 1]].tolist(), end]:
            while c - last > LONGEST:
                last += LONGEST
                ends.append(last - begin)
            if c - last >= SHORTEST or c == end and c > last:
                last = c
                ends.append(last - begin)
        out.append(ends)
    return out


def merkle_root(digests: list[bytes]) -> bytes:
    level = list(digests) or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest()[:16] for i in range(0, len(level), 2)]
    return level[0]


def _digest(chunk) -> bytes:
    return hashlib.sha256(chunk).digest()[:16]


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices: rows become Python objects a slice at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c[0], c[1]) for c in columns.values()], list(columns))


def stage_ids(docs: DataFrame, tokenizer_path: str, end_id: int, text: str, doc_id: str) -> DataFrame:
    """(rid, doc_id, n_tokens, root, digests, lens, ids): each document's stream and its chunks, written once."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pack = _encoder(definition.value, end_id), zstandard.ZstdCompressor(level=3).compress
        width = encoder.dtype.itemsize
        for part in _parts(batches, 256):
            flat, starts = encoder.encode([t or b"" for t in part.column("t").to_pylist()])
            cuts, data = cut_points(flat, starts), memoryview(flat).cast("B")
            digests = [[_digest(data[(s + a) * width : (s + b) * width]) for a, b in zip([0, *c], c)] for s, c in zip(starts.tolist(), cuts)]
            ids = [pack(data[a * width : b * width]) for a, b in zip(starts.tolist(), starts[1:].tolist())]
            yield _batch(
                {
                    "doc_id": part.column("id"), "n_tokens": (np.diff(starts), pa.int64()), "width": ([width] * len(ids), pa.int32()), "root": ([merkle_root(d) for d in digests], pa.binary()),
                    "digests": (digests, pa.list_(pa.binary())), "lens": ([np.diff([0, *c]) for c in cuts], pa.list_(pa.int32())), "ids": (ids, pa.binary()),
                }
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.encode(F.col(text), "UTF-8").alias("t"))
    staged = rows.mapInArrow(run, "doc_id long, n_tokens long, width int, root binary, digests array<binary>, lens array<int>, ids binary")
    return shared_table(staged.withColumn("rid", F.monotonically_increasing_id()), "staged")


def manifest_of(pack: DataFrame) -> DataFrame:
    """One row: documents, ids, chunks, and the Merkle root over documents by start."""
    rows = pack.select("start", "n_tokens", F.size("digests").alias("chunks"), F.sha2(F.concat_ws(" ", F.hex("root"), "start", "n_tokens"), 256).alias("h"))
    counts = rows.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("ids"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))
    total, level, bits = counts.first()["ids"], rows.select(F.col("start").alias("at"), "h"), LEAF_BITS
    while True:
        kids = F.sort_array(F.collect_list(F.struct("at", "h")))
        level = level.groupBy(F.shiftright("at", bits).alias("up")).agg(F.sha2(F.array_join(F.transform(kids, lambda k: k["h"]), " "), 256).alias("h")).withColumnRenamed("up", "at")
        total, bits = total >> bits, NODE_BITS
        if not total:
            return counts.crossJoin(level.agg(F.coalesce(F.max("h"), F.lit("")).alias("root")))


def _without(ids: bytes, lens: list[int], foreign: list[int], width: int) -> bytes:
    """The stream less the chunks whose numbers are in foreign."""
    gone, at, kept = set(foreign), 0, []
    for i, n in enumerate(lens):
        if i not in gone:
            kept.append(ids[at : at + n * width])
        at += n * width
    return b"".join(kept)


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode docs and write the store to path (a folder that all executors reach)."""
    staged = stage_ids(docs, tokenizer_path, end_id, text, doc_id)
    order = [F.col("doc_id").asc_nulls_last(), F.col("root"), F.col("rid")]
    keyed = with_prefix_sums(staged.select("rid", "doc_id", "n_tokens", "root"), order, "n_tokens", "start", "starts")
    keyed = shared_table(keyed.select("rid", "doc_id", "root", "start"), "starts")
    uses = staged.select("rid", "digests").join(keyed.select("rid", "start"), "rid").select("start", F.posexplode("digests").alias("part", "digest"))
    uses = shared_table(uses, "chunkuses")
    owner = uses.groupBy("digest").agg(F.min(F.struct("start", "part")).alias("o"), F.count(F.lit(1)).alias("n")).where("n > 1")
    owner = shared_table(owner.select("digest", F.col("o.start").alias("at"), F.col("o.part").alias("at_part"), "n"), "chunkowners")
    foreign = hot_join(uses, owner, ["digest"], "n", uses.count()).where("start <> at OR part <> at_part")
    foreign = foreign.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("part", "at", "at_part"))).alias("f"))
    lent = owner.groupBy(F.col("at").alias("start")).agg(F.sort_array(F.collect_list(F.struct(F.col("at_part").alias("part"), "n"))).alias("l"))
    recipes = keyed.join(foreign, "start", "left").join(lent, "start", "left")
    recipes = recipes.select("doc_id", "root", "rid", "start", F.col("f.part").alias("part"), F.col("f.at").alias("at"), F.col("f.at_part").alias("at_part"), F.col("l.part").alias("lent"), F.col("l.n").alias("lent_n"))
    # one exchange of ids: each document's recipe travels to the place in front of its ids
    both = staged.withColumn("kind", F.lit(1)).unionByName(recipes.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    both = both.repartitionByRange(*order).sortWithinPartitions(*order, "kind")
    names = ["doc_id", "start", "n_tokens", "width", "root", "digests", "lens", "ids", "part", "at", "at_part", "lent", "lent_n"]

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        recipe = None
        for b in _parts(batches):
            out = []
            for row in b.to_pylist():
                if not row["kind"]:
                    recipe = row
                    continue
                if recipe is None or recipe["rid"] != row["rid"]:
                    raise ValueError("a document has no recipe")
                row |= {k: recipe[k] for k in ("start", "part", "at", "at_part", "lent", "lent_n")}
                if row["part"] is not None:
                    row["ids"] = pack(_without(unpack(row["ids"]), row["lens"], row["part"], row["width"]))
                out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], b.schema.field(c).type) for c in names], names)

    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    both.mapInArrow(strip, ", ".join(f"{c} {kinds[c]}" for c in names)).write.option("compression", "zstd").parquet(f"{path}/pack")
    manifest_of(docs.sparkSession.read.parquet(f"{path}/pack")).write.parquet(f"{path}/manifest")
    drop_shared(staged, keyed, uses, owner)


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, rebuilt and verified from the files."""
    said = spark.read.parquet(f"{path}/manifest").first()
    pack = spark.read.schema(_PACK).parquet(f"{path}/pack")
    if (found := manifest_of(pack).first()) != said:
        raise ValueError(f"the files do not match the manifest: {found} instead of {said}")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in _parts(batches):
            got = []
            for row in b.to_pylist():
                gone, want, place, ids, width = set(row["part"] or ()), dict(zip(row["lent"], row["lent_n"])), 0, unpack(row["ids"]), row["width"]
                for i, n in enumerate(row["lens"]):
                    if i in gone:
                        continue
                    if i in want:
                        got.append((row["start"], i, want[i], ids[place : place + n * width]))
                    place += n * width
            columns = zip(*got) if got else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["at", "at_part", "n", "chunk"])

    chunks = pack.where("lent IS NOT NULL").select("start", "width", "lens", "part", "ids", "lent", "lent_n").mapInArrow(extract, "at long, at_part int, n long, chunk binary")
    chunks = shared_table(chunks, "lentchunks")
    lacking = pack.where("part IS NOT NULL")
    calls = lacking.select("start", F.explode(F.arrays_zip("part", "at", "at_part")).alias("f")).select("start", "f.*")
    fetched = hot_join(calls, chunks, ["at", "at_part"], "n", said["chunks"]).groupBy("start").agg(F.collect_list(F.struct("part", "chunk")).alias("more"))
    fetched = fetched.select(F.col("start").alias("s"), "more.part", "more.chunk")
    base = ["doc_id", "start", "n_tokens", "width", "root", "digests", "lens", "ids"]
    whole = pack.where("part IS NULL").select(*base, F.lit(None).cast("array<int>").alias("got"), F.lit(None).cast("array<binary>").alias("chunk"))
    filled = lacking.select(*base).join(fetched, F.col("start") == F.col("s")).select(*base, F.col("part").alias("got"), "chunk")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in _parts(batches):
            crc, streams = [], []
            for start, n, width, root, digests, lens, ids, got, chunk in zip(*(b.column(c).to_pylist() for c in [*base[1:], "got", "chunk"])):
                more = {} if got is None else dict(zip(got, chunk))
                parts, at, ids = [], 0, unpack(ids)
                for i, size in enumerate(lens):
                    part = more.get(i)
                    if part is None:
                        part = ids[at : at + size * width]
                        at += size * width
                    parts.append(part)
                if [_digest(p) for p in parts] != digests or merkle_root(digests) != root:
                    raise ValueError(f"document at {start}: a chunk does not match its digest")
                stream = np.frombuffer(b"".join(parts), dtype=f"<u{width}").astype("<u4")
                if len(stream) != n:
                    raise ValueError(f"document at {start}: {len(stream)} ids, {n} expected")
                crc.append(zlib.crc32(stream))
                streams.append(stream.astype("<i4"))
            columns = {"doc_id": b.column("doc_id"), "start": b.column("start"), "n_tokens": b.column("n_tokens"), "ids_crc32": (crc, pa.int64())}
            yield _batch(columns | ({"ids": (streams, pa.list_(pa.int32()))} if with_ids else {}))

    return whole.unionByName(filled).mapInArrow(rebuild, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


_PACK = "doc_id long, start long, n_tokens long, width int, root binary, digests array<binary>, lens array<int>, ids binary, part array<int>, at array<long>, at_part array<int>, lent array<int>, lent_n array<long>"
