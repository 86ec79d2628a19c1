"""Vector code compression: product codes from integer codebooks fitted over all vectors.

Method: components become integers floor(SCALE * x), and vectors are cut into PARTS equal parts. Each
part's codebook begins as that part of the ENTRIES vectors with the smallest ids. A round broadcasts
a kd-tree per codebook; a task finds each part's nearest entry by branch and bound, and adds up
integers per entry, which Spark sums. Entries become the floors of their means; unused ones stay. A
node of a tree is skipped only if its bound is above the best distance so far: nodes with an equal bound are
visited, so that of equally near entries the lowest index wins. All sums are integers, so the
result doesn't depend on how rows are dealt to tasks.

What reaches the driver in a round is the codebooks' sums, PARTS * ENTRIES * width numbers, whatever
the number of rows; what is broadcast is as large.

Defined results: vectors that are null or hold null or non-finite components are dropped; an empty
vector is kept. Vectors are padded with zeros to the longest length, rounded up to a multiple of PARTS, so
tables of one length that PARTS divides are not padded. Fewer vectors than ENTRIES make smaller codebooks.
Repeated rows are vectors of their own, each with its place among the first ones; equal ids are ordered by
their vectors, null ids come last. Null labels are one label. An empty table gives an empty result; further
columns, whatever their names, are not read. Components so large that a vector's squared distance
might not fit a long are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.operators.skew import hot_join
from seqlens.session import drop_shared, shared_table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Entries in a leaf of a tree: 8 to 256 were measured, and 64 take least time with arrays.
LEAF = 64


class CodeTree:
    """A kd-tree over the entries of one codebook: medians along the widest dimension, a box a node."""

    def __init__(self, entries: np.ndarray, exact: bool):
        """exact: distances fit a double without rounding; else they are computed in 64-bit integers."""
        self.entries = entries.astype(np.float64 if exact else np.int64)
        self.square = (self.entries * self.entries).sum(axis=1)
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        self.kids: list[tuple[int, int] | np.ndarray] = []
        self._grow(np.arange(len(entries)))

    def _grow(self, held: np.ndarray) -> int:
        own = self.entries[held]
        low, high, here = own.min(axis=0), own.max(axis=0), len(self.kids)
        self.boxes.append((low, high))
        self.kids.append(held)
        if len(held) > LEAF and (high > low).any():
            order = held[np.argsort(own[:, np.argmax(high - low)], kind="stable")]
            half = len(held) // 2
            # a leaf keeps its entries by index: the first of the nearest is the lowest
            self.kids[here] = (self._grow(np.sort(order[:half])), self._grow(np.sort(order[half:])))
        return here

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each query's nearest entry, the lowest of equally near ones, and its squared distance."""
        q = queries.astype(self.entries.dtype)
        best, index = np.full(len(q), np.inf if q.dtype == np.float64 else np.iinfo(np.int64).max, dtype=q.dtype), np.full(len(q), len(self.entries), dtype=np.int64)
        square = (q * q).sum(axis=1)

        def bound(node: int, rows: np.ndarray) -> np.ndarray:
            low, high = self.boxes[node]
            x = q[rows]
            gap = x - np.clip(x, low, high)
            return np.einsum("ij,ij->i", gap, gap)

        def visit(node: int, rows: np.ndarray, least: np.ndarray) -> None:
            rows = rows[least <= best[rows]]
            if not len(rows):
                return
            kids = self.kids[node]
            if isinstance(kids, tuple):
                left, right = (bound(k, rows) for k in kids)
                near = left <= right
                visit(kids[0], rows[near], left[near])
                visit(kids[1], rows[~near], right[~near])
                visit(kids[1], rows[near], right[near])
                visit(kids[0], rows[~near], left[~near])
                return
            d = square[rows, None] - 2 * (q[rows] @ self.entries[kids].T) + self.square[kids]
            at = d.argmin(axis=1)
            d, at = d[np.arange(len(rows)), at], kids[at]
            better = (d < best[rows]) | (d == best[rows]) & (at < index[rows])
            best[rows[better]], index[rows[better]] = d[better], at[better]

        everyone = np.arange(len(q))
        visit(0, everyone, np.zeros(len(q), dtype=q.dtype))
        return index, best.astype(np.int64)


def integer_vectors(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """(vec_id, label, q) of the rows with whole, finite vectors; q holds the integers."""
    v = F.col("v")
    base = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return base.where(good).select("vec_id", "label", F.transform(v, lambda x: F.floor(x * SCALE)).alias("q"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, with zeros after the shorter ones."""
    flat, size = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), dtype=np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


class Codebooks:
    """PARTS codebooks of the same number of entries: an integer array (part, entry, position)."""

    def __init__(self, entries: np.ndarray, exact: bool):
        self.entries, self.exact = entries, exact

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def trees(self) -> list[CodeTree]:
        return [CodeTree(e, self.exact) for e in self.entries]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def rows(self, spark: SparkSession) -> DataFrame:
        """(part, entry, components): the codebooks as a table, at most PARTS * ENTRIES rows."""
        listed = [(p, e, [int(x) for x in row]) for p, part in enumerate(self.entries) for e, row in enumerate(part)]
        return spark.createDataFrame(listed, "part int, entry int, components array<long>")


def fit_codebooks(points: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of written rows (vec_id, q) after so many rounds over all of them; None if there are none."""
    n, longest, most = points.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(F.array_max(F.transform("q", lambda x: F.abs(x))))).first()
    if not n:
        return None
    step, most = max(1, -(-(longest or 0) // parts)), int(most or 0)
    if 4 * step * parts * most * most >= 1 << 63:
        raise ValueError(f"components of {most / SCALE} are too large: squared distances may not fit a long")
    exact, width = 8 * step * most * most < 1 << 53, step * parts
    # the smallest ids: a bounded top-k
    first = [r.q for r in points.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()]
    padded = np.array([[*q, *[0] * (width - len(q))] for q in first], dtype=np.int64)
    books = Codebooks(np.ascontiguousarray(padded.reshape(len(first), parts, step).transpose(1, 0, 2)), exact)
    for _ in range(rounds):
        sums, counts = _entry_sums(points, books)
        means = np.where(counts[:, :, None] > 0, np.floor_divide(sums, np.maximum(counts, 1)[:, :, None]), books.entries)
        if (means == books.entries).all():
            break
        books = Codebooks(means, exact)
    return books


def _entry_sums(points: DataFrame, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """The componentwise sums and the numbers of the parts that are nearest to each entry."""
    trees, (parts, entries, step), width = points.sparkSession.sparkContext.broadcast(books.trees()), books.entries.shape, books.width

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, step), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            m = _matrix(batch.column("q"), width)
            for p, tree in enumerate(trees.value):
                own = m[:, p * step : (p + 1) * step]
                at, _ = tree.nearest(own)
                counts[p] += np.bincount(at, minlength=entries)
                order = np.argsort(at, kind="stable")
                begin = np.flatnonzero(np.diff(at[order], prepend=-1))
                if len(begin):
                    sums[p, at[order][begin]] += np.add.reduceat(own[order], begin, axis=0)
        p, e = np.nonzero(counts)
        found = (pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays(list(found), ["part", "entry", "n", "sums"])

    partial = points.select("q").mapInArrow(add, "part int, entry int, n long, sums array<long>")
    spread = partial.select("part", "entry", "n", F.posexplode("sums").alias("i", "s"))
    got = spread.groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
    trees.destroy()
    sums, counts = np.zeros((parts, entries, step), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
    part, entry = got["part"].to_numpy(), got["entry"].to_numpy()
    sums[part, entry, got["i"].to_numpy()], counts[part, entry] = got["s"].to_numpy(), got["n"].to_numpy()
    return sums, counts


def encode_vectors(points: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of rows (vec_id, label, q): two hex digits a part, and the squared distance to what they stand for."""
    trees, (parts, _, step), width = points.sparkSession.sparkContext.broadcast(books.trees()), books.entries.shape, books.width
    digits = 2 * parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("q"), width)
            found = [tree.nearest(m[:, p * step : (p + 1) * step]) for p, tree in enumerate(trees.value)]
            text = np.stack([at for at, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            code = [text[i : i + digits] for i in range(0, len(text), digits)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(sum(d for _, d in found), pa.int64())], ["vec_id", "label", "code", "error"])

    label = points.schema["label"].dataType.simpleString()
    return points.select("vec_id", "label", "q").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def decode_vectors(codes: DataFrame, books: DataFrame, parts: int = PARTS, code: str = "code", out: str = "vector") -> DataFrame:
    """codes with the vector that each code stands for, in the scale of the input; books as Codebooks.rows gives them.

    The codebooks have at most PARTS * ENTRIES rows, so they go by broadcast.
    """
    pieces = [codes]
    for p in range(parts):
        mine = books.where(F.col("part") == p).select(F.lower(F.lpad(F.hex("entry"), 2, "0")).alias(f"__e{p}"), F.col("components").alias(f"__c{p}"))
        pieces.append(pieces[-1].join(F.broadcast(mine), F.substring(code, 2 * p + 1, 2) == F.col(f"__e{p}"), "left"))
    whole = F.transform(F.concat(*[F.col(f"__c{p}") for p in range(parts)]), lambda x: x / F.lit(float(SCALE)))
    return pieces[-1].select(*codes.columns, whole.alias(out))


def vector_codes(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row for each whole vector."""
    points = shared_table(integer_vectors(rows, vector, vec_id, label), "vectorints")
    books = fit_codebooks(points)
    if books is None:
        nothing = points.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return nothing.select("*", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    # labels are joined as strings, so that null is one of them; hot ones go by broadcast
    name = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    coded = shared_table(encode_vectors(points, books).select("vec_id", name.alias("name"), "code", "error"), "vectorcodes")
    drop_shared(points)
    per = shared_table(coded.groupBy("name").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "labelerrors")
    out = hot_join(coded, per, ["name"], "n", coded.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
