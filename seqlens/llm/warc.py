"""WARC archives as a chunked record table.

Method: a payload is a run of rows (record, chunk number, chunk) of at most CHUNK bytes, cut in
the engine before anything is shuffled or any Python sees it. Which records are revisits is decided on
(id, digest, size) rows alone; decisions and chunk rows then meet in one exchange, a decision
sorted in front of its record's chunks. Writers stream chunk rows into gzip members, one a
record, and carry the digest from chunk to chunk; readers give the same rows back with the
running length and digest of each, so neither side ever holds a whole record. Records with
equal payloads of at least SHORTEST bytes are written once, as response of the smallest id;
the others are revisit records that refer to it by address, date and id.

A response's block is an HTTP head and the payload; each file begins with a warcinfo record. The page's id
is a header of its own, and record ids are made of id, digest and the row's place, so that repeated rows
have different ones. A task writes files of its own under the given folder and renames them when complete; the
manifest, written last, lists the files of tasks that succeeded, so a lost executor
leaves no half file in the archive.

Defined results: null payload is the empty payload; repeated rows of the smallest id are all
responses, and rows repeated very often are dealt over SALT parts; null ids are named null, and are responses
unless an equal payload has an id; header values lose line breaks; very long payloads are chunk rows like any
other; further columns, whatever their names, are not read; an empty table writes an empty archive.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.operators.skew import hot_join
from seqlens.session import drop_shared, shared_table

CHUNK, SHORTEST, ROLL, SALT = 1 << 16, 100, 64 << 20, 8
#: Rows of a batch that become Python objects at once.
SLICE = 64
DATE = "2000-01-01T00:00:00Z"
_EOL = b"\r\n"


def _files(path: str):
    """The file system of a folder and its path there; any scheme that pyarrow reads."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _bodies(pages: DataFrame, payload: str, page_id: str, url: str) -> DataFrame:
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("body"))
    return rows.select("page_id", "url", "body", F.octet_length("body").cast("long").alias("size"), F.sha2("body", 256).alias("digest"))


def plan_records(pages: DataFrame, payload: str = "html", page_id: str = "page_id", url: str = "url", shortest: int = SHORTEST) -> DataFrame:
    """(page_id, digest, refers_to, refers_url) of the revisits; all other records are responses. No payload is shuffled."""
    keys = _bodies(pages, payload, page_id, url).where(F.col("size") >= shortest).select("page_id", "url", "digest")
    keys = shared_table(keys, "warckeys")
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = keys.groupBy("digest").agg(F.min(named).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1 AND f IS NOT NULL")
    first = shared_table(first.select("digest", F.col("f.page_id").alias("refers_to"), F.col("f.url").alias("refers_url"), "n"), "warcfirst")
    again = hot_join(keys, first, ["digest"], "n", keys.count()).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    plan = shared_table(again.select("page_id", "digest", "refers_to", "refers_url").distinct(), "warcplan")
    drop_shared(keys, first)
    return plan


def chunk_rows(pages: DataFrame, chunk: int = CHUNK, payload: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url, size, digest, rid, number, last, chunk): payloads as rows of at most chunk bytes; an empty one is one row."""
    rows = _bodies(pages, payload, page_id, url).withColumn("rid", F.monotonically_increasing_id())
    rows = rows.withColumn("last", F.greatest(F.ceil(F.col("size") / chunk) - 1, F.lit(0)).cast("int"))
    rows = rows.withColumn("number", F.explode(F.sequence(F.lit(0), F.col("last"))))
    return rows.select("page_id", "url", "size", "digest", "rid", "number", "last", F.substring("body", F.col("number") * F.lit(chunk) + 1, F.lit(chunk)).alias("chunk"))


def _dealt(pages: DataFrame, plan: DataFrame, chunk: int, columns: tuple[str, str, str]) -> DataFrame:
    """Decisions and chunk rows in one exchange; each record's decision, if it is a revisit, stands before its chunks."""
    none = lambda *cs: [F.lit(None).cast(t).alias(c) for c, t in cs]
    told = ("refers_to", "long"), ("refers_url", "string")
    chunks = chunk_rows(pages, chunk, *columns).select("*", *none(*told), F.pmod("rid", F.lit(SALT)).alias("salt"))
    heads = plan.select("page_id", *none(("url", "string"), ("size", "long")), "digest", F.lit(-1).cast("long").alias("rid"), F.lit(-1).alias("number"), *none(("last", "int"), ("chunk", "binary")), "refers_to", "refers_url")
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    record = ["page_id", "digest", "salt"]
    return chunks.unionByName(heads).repartition(*record).sortWithinPartitions(*record, "rid", "number").drop("salt")


def _id(value: int | None) -> str:
    return "null" if value is None else str(value)


def _head(kind: str, name: str, length: int, *more: tuple[str, str]) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", DATE), *more, ("Content-Length", str(length))]
    text = "\r\n".join(["WARC/1.1", *(f"{k}: {' '.join(v.split())}" for k, v in lines)])
    return text.encode("utf-8", "surrogatepass") + _EOL + _EOL


def _record_head(row: dict, revisit: tuple[int, str] | None) -> bytes:
    """The head of a record, and of a response the HTTP head as well."""
    name = f"{_id(row['page_id'])}/{row['digest']}/{row['rid']}"
    more = [("WARC-Target-URI", row["url"] or ""), ("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("Content-Type", "application/http; msgtype=response"), ("X-Page-Id", _id(row["page_id"]))]
    if revisit is None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
        return _head("response", name, len(http) + row["size"], *more) + http
    more += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", revisit[1] or ""), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-Id", str(revisit[0]))]
    return _head("revisit", name, 0, *more)


class _Writer:
    """Streams records into rolling files; a file gets its final name when it is complete."""

    def __init__(self, folder: str):
        self.fs, self.folder = _files(folder)
        self.out, self.done, self.records, self.bytes = None, [], 0, 0

    def begin(self, head: bytes) -> None:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.gz"
            self.out = self.fs.open_output_stream(f"{self.folder}/_{self.name}", compression=None)
            self.records = self.bytes = 0
            info = b"software: seqlens\r\nformat: WARC File Format 1.1\r\n"
            self._put(zlib.compress(_head("warcinfo", self.name, len(info), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")) + info + _EOL + _EOL, 6, 31))
        self.gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.digest = hashlib.sha256()
        self._put(self.gzip.compress(head))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def chunk(self, data: bytes) -> None:
        self.digest.update(data)
        self._put(self.gzip.compress(data))

    def end(self) -> None:
        self._put(self.gzip.compress(_EOL + _EOL) + self.gzip.flush())
        self.records += 1
        if self.bytes >= ROLL:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(f"{self.folder}/_{self.name}", f"{self.folder}/{self.name}")
            self.done.append((self.name, self.records, self.bytes))
            self.out = None


def write_archive(pages: DataFrame, path: str, chunk: int = CHUNK, payload: str = "html", page_id: str = "page_id", url: str = "url", shortest: int = SHORTEST) -> None:
    """Write pages as WARC files under path, and path/manifest last."""
    folder = f"{path}/files"
    plan = plan_records(pages, payload, page_id, url, shortest)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, local = _files(folder)
        fs.create_dir(local, recursive=True)
        w = _Writer(folder)
        told = revisit = None
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                for row in batch.slice(lo, SLICE).to_pylist():
                    key = (row["page_id"], row["digest"])
                    if row["number"] < 0:
                        told, revisit = key, (row["refers_to"], row["refers_url"])
                        continue
                    again = revisit if told == key else None
                    if row["number"] == 0:
                        w.begin(_record_head(row, again))
                        if again is not None:
                            w.end()
                    if again is not None:
                        continue
                    w.chunk(row["chunk"])
                    if row["number"] == row["last"]:
                        if w.digest.hexdigest() != row["digest"]:
                            raise ValueError(f"page {row['page_id']}: payload does not match its digest")
                        w.end()
        w.close()
        files, records, sizes = zip(*w.done) if w.done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], ["file", "records", "bytes"])

    rows = _dealt(pages, plan, chunk, (payload, page_id, url))
    rows.mapInArrow(write, "file string, records long, bytes long").write.parquet(f"{path}/manifest")


def _lines(head: bytes) -> dict[str, str]:
    text = head.decode("utf-8", "surrogatepass").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in text[1:]) if k}


def parse_archive(stream: io.RawIOBase, chunk: int = CHUNK) -> Iterator[tuple]:
    """(headers, number, chunk, length so far, digest so far, is last) of each record in a gzip stream of members; an HTTP head is no part of a payload."""
    data, gzip, head, left = b"", zlib.decompressobj(31), None, 0

    def more() -> bytes:
        """The next decompressed bytes, at most chunk of them; empty at the end of the stream."""
        nonlocal data, gzip
        while True:
            if gzip.eof:
                data, gzip = gzip.unused_data, zlib.decompressobj(31)
            if not data and not (data := stream.read(chunk)):
                return b""
            out = gzip.decompress(data, chunk)
            data = b"" if gzip.eof else gzip.unconsumed_tail
            if out:
                return out

    buffer = b""
    while True:
        while (end := buffer.find(_EOL + _EOL)) < 0:
            if not (got := more()):
                if buffer.strip():
                    raise ValueError("the archive ends inside a record")
                return
            buffer = (buffer + got).lstrip(_EOL) if not buffer.strip() else buffer + got
        head, buffer = _lines(buffer[:end]), buffer[end + 4 :]
        left, number, length, digest = int(head["content-length"]), 0, 0, hashlib.sha256()
        if left and head.get("content-type", "").startswith("application/http"):
            # the payload begins after the HTTP head
            while (end := buffer[:left].find(_EOL + _EOL)) < 0:
                if len(buffer) >= left or not (got := more()):
                    raise ValueError("the archive ends inside an HTTP head")
                buffer += got
            buffer, left = buffer[end + 4 :], left - end - 4
        while True:
            while len(buffer) < min(left, chunk):
                if not (got := more()):
                    raise ValueError("the archive ends inside a payload")
                buffer += got
            piece, buffer = buffer[: min(left, chunk)], buffer[min(left, chunk) :]
            left -= len(piece)
            length += len(piece)
            digest.update(piece)
            yield head, number, piece, length, digest.hexdigest(), left == 0
            number += 1
            if not left:
                break
        while len(buffer) < 4:
            if not (got := more()):
                break
            buffer += got
        buffer = buffer.removeprefix(_EOL + _EOL)


def read_chunks(spark: SparkSession, path: str, payload: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of an archive: record, page_id, type, url, refers_to, said, number, length, digest, last[, chunk].

    length and digest are those of the payload up to and with this chunk; said is the header's digest. warcinfo
    records are left out.
    """
    files = spark.read.parquet(f"{path}/manifest").where("records > 0").select("file")
    count = files.count()
    schema = "record string, page_id long, type string, url string, refers_to long, said string, number int, length long, digest string, last boolean" + ", chunk binary" * payload
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*((n, kinds[t]) for n, t in (c.split() for c in schema.split(", "))))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], list(names))

    def number(text: str | None) -> int | None:
        return None if text in (None, "null") else int(text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, local = _files(f"{path}/files")
        for b in batches:
            for name in b.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{local}/{name}", compression=None) as stream:
                    for head, n, piece, length, digest, last in parse_archive(stream, chunk):
                        if head["warc-type"] == "warcinfo":
                            continue
                        row = (head["warc-record-id"], number(head["x-page-id"]), head["warc-type"], head.get("warc-target-uri"), number(head.get("x-refers-to-page-id")), head["warc-payload-digest"].removeprefix("sha256:"), n, length, digest, last)
                        rows.append((*row, piece) if payload else row)
                        held += len(piece) * payload + 500
                        if held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return files.repartition(max(1, count)).mapInArrow(read, schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), each from the archive's own bytes.

    A revisit's length and digest are those of the response it refers to.
    """
    rows = shared_table(read_chunks(spark, path, payload=False).where("last").drop("number", "last"), "warcrecords")
    bad = F.raise_error(F.concat(F.lit("digest mismatch in "), F.col("record")))
    checked: Column = F.when(F.col("digest") == F.col("said"), F.col("digest")).otherwise(bad)
    full = rows.where("type = 'response'").select("page_id", F.col("length").alias("payload_bytes"), checked.alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
    again = rows.where("type = 'revisit'").select("page_id", "refers_to", "said")
    held = rows.where("type = 'response'").groupBy(F.col("page_id").alias("held"), F.col("digest").alias("hd")).agg(F.min("length").alias("hl"))
    back = again.join(held, (F.col("refers_to") == F.col("held")) & (F.col("said") == F.col("hd")), "left")
    gone = F.raise_error(F.concat(F.lit("no response "), F.coalesce(F.col("refers_to").cast("string"), F.lit("null"))))
    back = back.select("page_id", F.coalesce("hl", gone.cast("long")).alias("payload_bytes"), F.col("said").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    return full.unionByName(back)
