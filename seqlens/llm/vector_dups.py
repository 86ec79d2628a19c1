"""Near-duplicate embeddings by an epsilon grid order join.

Method: vectors are scaled to length one, so cosine >= t is a distance of at most
eps = sqrt(2 - 2 t), and turned onto their principal axes. They are sorted by grid cells of side
eps, cell by cell along the ORDER leading axes. The sequence falls into blocks of BLOCK
vectors; pairs of sequence intervals are split recursively, and an interval pair whose bounding
boxes, over all axes, are more than eps apart is skipped with all below it. The recursion goes on
within a block pair down to tiles of TILE vectors. In a tile pair the product over the
leading half of the axes, plus the product of what is left of each vector's length, is an upper
bound of the cosine; only pairs over it are computed in double precision, and a cosine within
1e-12 of the threshold is computed again without scaling first.

How much is skipped depends on the data: clusters that lie apart meet only their own blocks. For
vectors without structure (isotropic, 64 dimensions) every box of a few vectors reaches within
eps of every other, so no box test, of any shape, can skip blocks there; what saves work
then is the bound within tiles.

Equal vectors are one point with a count. A block pair returns, for each vector, how many
vectors it links to, and its smallest partner by local components: never all pairs.

Defined results: null, empty, zero vectors and those with null or non-finite components link
with nothing; vectors link with vectors of the same length only; very long vectors make wider
boxes and are compared alike; repeated rows are separate vectors; a null id gets no name of its
own; further columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.operators.components import connected_components
from seqlens.operators.positions import with_positions
from seqlens.operators.skew import hot_join
from seqlens.session import drop_shared, shared_table

ORDER, BLOCK, FAN, TILE = 8, 4096, 4, 512
#: Single precision may take so much off the upper bound of a cosine.
SLACK = 1e-4


def _usable(v) -> F.Column:
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ok & F.exists(v, lambda x: x != 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def principal_axes(points: DataFrame, dim: int) -> np.ndarray:
    """The axes of unit vectors, leading ones first, from partial sums of outer products: dim x dim numbers a task."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, first, n = np.zeros((dim, dim)), np.zeros(dim), 0
        for b in batches:
            if len(b):
                u = _unit(_matrix(b["v"]))
                total, first, n = total + u.T @ u, first + u.sum(axis=0), n + len(u)
        yield pd.DataFrame({"s": [total.ravel()], "m": [first], "n": [n]})

    parts = points.select("v").mapInPandas(sums, "s array<double>, m array<double>, n long")
    # dim * dim + dim + 1 numbers reach the driver, whatever the number of tasks
    whole = parts.select(F.posexplode(F.concat("s", "m", F.array(F.col("n").cast("double")))).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(dim * dim + dim + 1)
    flat[[r.i for r in whole]] = [r.x for r in whole]
    second, mean, n = flat[: dim * dim].reshape(dim, dim), flat[dim * dim : -1], max(1.0, flat[-1])
    _, axes = np.linalg.eigh(second / n - np.outer(mean, mean) / n**2)
    return np.ascontiguousarray(axes[:, ::-1])


def _grid_order(points: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """points in grid order: pos and block."""
    lead = axes[:, :ORDER]

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(cell=list(np.floor(_unit(_matrix(b["v"])) @ lead / eps).astype(np.int64)))

    laid = points.mapInPandas(project, "v array<double>, rep long, copies long, cell array<long>")
    placed = with_positions(laid, [*[F.get("cell", F.lit(i)) for i in range(lead.shape[1])], F.col("rep"), F.xxhash64("v")], "pos", "gridorder")
    return placed.select("pos", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"), "v", "rep", "copies")


def pack_blocks(placed: DataFrame, axes: np.ndarray) -> DataFrame:
    """A row a block: its vectors, and their bounding box p0 to p1 over all axes."""

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        m = _matrix(g["v"])
        p = _unit(m) @ axes
        return pd.DataFrame({"block": [g["block"].iloc[0]], "pos": [g["pos"].to_numpy()], "copies": [g["copies"].to_numpy()], "m": [_narrow(m).tobytes()], "p0": [p.min(axis=0)], "p1": [p.max(axis=0)]})

    rows = placed.select("block", "pos", "copies", "v").groupBy("block")
    return rows.applyInPandas(pack, "block long, pos array<long>, copies array<long>, m binary, p0 array<double>, p1 array<double>")


def _near_boxes(lo_a: str, hi_a: str, lo_b: str, hi_b: str, eps: float) -> F.Column:
    gap = F.zip_with(F.zip_with(lo_a, hi_b, lambda x, y: x - y), F.zip_with(lo_b, hi_a, lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= F.lit((eps + 1e-9) ** 2)


def _hull(box: str, pick) -> F.Column:
    """Element by element the least or greatest of the at most FAN arrays of a group."""
    boxes = F.collect_list(box)
    return F.aggregate(boxes, boxes[0], lambda s, x: F.zip_with(s, x, lambda u, v: pick(u, v)))


def near_blocks(packed: DataFrame, eps: float) -> DataFrame:
    """(a, b) of block pairs, a <= b, that boxes can't rule out: recursion over intervals of blocks."""
    boxes = [packed.select("block", "p0", "p1")]
    top = boxes[0].agg(F.max("block")).first()[0] or 0
    while top >= FAN:
        up = boxes[-1].groupBy(F.floor(F.col("block") / FAN).cast("long").alias("block"))
        boxes.append(shared_table(up.agg(_hull("p0", F.least).alias("p0"), _hull("p1", F.greatest).alias("p1")), "boxes"))
        top //= FAN
    spark = packed.sparkSession
    pairs = spark.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for level in reversed(boxes):
        kids = F.sequence(F.lit(0), F.lit(FAN - 1))
        pairs = pairs.select((F.col("a") * FAN).alias("a"), (F.col("b") * FAN).alias("b"))
        pairs = pairs.select(F.explode(F.transform(kids, lambda i: F.col("a") + i)).alias("a"), "b").select("a", F.explode(F.transform(kids, lambda i: F.col("b") + i)).alias("b")).where("a <= b")
        left = level.select(F.col("block").alias("a"), F.col("p0").alias("al"), F.col("p1").alias("ah"))
        right = level.select(F.col("block").alias("b"), F.col("p0").alias("bl"), F.col("p1").alias("bh"))
        pairs = pairs.join(left, "a").join(right, "b").where(_near_boxes("al", "ah", "bl", "bh", eps)).select("a", "b")
        pairs = shared_table(pairs, "blockpairs")
    return pairs


class Tiles:
    """A block's vectors as tiles: unit vectors, single-precision leading halves, rest lengths, boxes."""

    def __init__(self, m: np.ndarray, pos, copies, axes: np.ndarray):
        self.raw, self.unit, self.pos, self.copies = m, _unit(m), np.asarray(pos), np.asarray(copies)
        p = self.unit @ axes
        half = max(1, p.shape[1] // 2)
        self.lead = np.ascontiguousarray(p[:, :half], dtype=np.float32)
        self.rest = np.sqrt((p[:, half:] ** 2).sum(axis=1)).astype(np.float32)
        self.at = np.arange(0, len(m), TILE)
        self.low, self.high = np.minimum.reduceat(p, self.at), np.maximum.reduceat(p, self.at)

    def near(self, other: Tiles, eps: float) -> np.ndarray:
        """Which tiles of this block and of the other their boxes allow to meet."""
        gap = np.maximum(0, np.maximum(self.low[:, None] - other.high[None], other.low[None] - self.high[:, None]))
        return (gap * gap).sum(axis=2) <= (eps + 1e-9) ** 2


def tile_hits(a: Tiles, i: int, b: Tiles, j: int, cosine: float) -> np.ndarray:
    """Which vectors of tile i of a and tile j of b reach the cosine."""
    x, y = slice(a.at[i], a.at[i] + TILE), slice(b.at[j], b.at[j] + TILE)
    may = a.lead[x] @ b.lead[y].T + np.multiply.outer(a.rest[x], b.rest[y]) >= cosine - SLACK
    n = np.count_nonzero(may)
    if not n:
        return may
    if n * 16 < may.size:
        u, v = np.nonzero(may)
        c = np.einsum("ij,ij->i", a.unit[x][u], b.unit[y][v])
    else:
        u, v = np.divmod(np.arange(may.size), may.shape[1])
        c = (a.unit[x] @ b.unit[y].T).ravel()
    hit = c >= cosine
    for k in np.flatnonzero(np.abs(c - cosine) < 1e-12):
        p, q = a.raw[x][u[k]], b.raw[y][v[k]]
        hit[k] = float(p @ q) / (float(np.sqrt(p @ p)) * float(np.sqrt(q @ q))) >= cosine
    may[u, v] = hit
    return may


def _settle(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest label reachable over mask, for its rows and its columns."""
    most = np.iinfo(np.int64).max
    while True:
        a = np.minimum(left, np.where(mask, right[None], most).min(axis=1))
        b = np.minimum(right, np.where(mask, a[:, None], most).min(axis=0))
        if (a == left).all() and (b == right).all():
            return a, b
        left, right = a, b


def block_links(a: Tiles, b: Tiles | None, eps: float, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pos, links, low) of the vectors with links between two blocks, or within one (b is None)."""
    c = a if b is None else b
    links = [np.zeros(len(a.pos), np.int64), np.zeros(len(c.pos), np.int64)]
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    for i, j in np.argwhere(a.near(c, eps)):
        if b is None and j < i:
            continue
        mask = tile_hits(a, i, c, j, cosine)
        x, y = slice(a.at[i], a.at[i] + TILE), slice(c.at[j], c.at[j] + TILE)
        if b is None and i == j:
            mask |= mask.T
            np.fill_diagonal(mask, False)
        if not mask.any():
            continue
        links[0][x] += mask @ c.copies[y]
        if b is not None or i != j:
            links[1][y] += a.copies[x] @ mask
        left, right = _settle(mask, a.pos[x], c.pos[y])
        edges += [(a.pos[x][s], left[s]) for s in [mask.any(axis=1)]] + [(c.pos[y][s], right[s]) for s in [mask.any(axis=0)]]
    pos = np.concatenate([a.pos, c.pos]) if b is not None else a.pos
    total = np.concatenate(links) if b is not None else links[0] + links[1]
    if not edges:
        return pos[:0], total[:0], pos[:0]
    order = np.argsort(pos)
    place = lambda p: order[np.searchsorted(pos[order], p)]
    u, v = (place(np.concatenate(e)) for e in zip(*edges, strict=True))
    label = pos.copy()
    while True:
        low = label.copy()
        np.minimum.at(low, u, label[v])
        np.minimum.at(low, v, label[u])
        if (low == label).all():
            some = total > 0
            return pos[some], total[some], label[some]
        label = low


def _narrow(m: np.ndarray) -> np.ndarray:
    """m in single precision where that loses nothing: blocks travel, so their bytes count."""
    single = m.astype(np.float32)
    return single if (single == m).all() else m


def _wide(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<f{len(data) // (n * dim)}").reshape(n, dim).astype(np.float64)


def _block_links(packed: DataFrame, pairs: DataFrame, axes: np.ndarray, eps: float, cosine: float) -> DataFrame:
    """(pos, links, low): a row for each vector and block pair with links: how many vectors, and a smallest partner."""
    dim = len(axes)
    left = packed.select(F.col("block").alias("a"), F.col("pos").alias("pa"), F.col("copies").alias("ca"), F.col("m").alias("ma"))
    right = packed.select(F.col("block").alias("b"), F.col("pos").alias("pb"), F.col("copies").alias("cb"), F.col("m").alias("mb"))
    # a row holds two packed blocks: few of them come to Python at once
    work = pairs.join(left, "a").join(right, "b")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for same, pa, ca, ma, pb, cb, mb in zip(batch["a"] == batch["b"], *(batch[c] for c in ("pa", "ca", "ma", "pb", "cb", "mb")), strict=True):
                one = Tiles(_wide(ma, len(pa), dim), pa, ca, axes)
                pos, links, low = block_links(one, None if same else Tiles(_wide(mb, len(pb), dim), pb, cb, axes), eps, cosine)
                if len(pos):
                    yield pd.DataFrame({"pos": pos, "links": links, "low": low})

    return work.mapInPandas(link, "pos long, links long, low long")


def near_vectors(rows: DataFrame, cosine: float = 0.9, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row."""
    spark = rows.sparkSession
    base = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    good = base.where(_usable(F.col("v")))
    # minus zero equals zero as a group key; counts are partial sums, so a hot vector is one row a task
    points = shared_table(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "points")
    named = [_named(spark, points.where(F.size("v") == dim), dim, cosine) for dim in sorted(r[0] for r in points.select(F.size("v")).distinct().collect())]
    none = base.where(~F.coalesce(_usable(F.col("v")), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = good.count() if named else 0
    for frame in named:
        got = hot_join(good, frame, ["v"], "copies", rows)
        component = F.coalesce("component_id", "vec_id")
        none = none.unionByName(got.select("vec_id", F.col("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")))
    return none


def _named(spark: SparkSession, points: DataFrame, dim: int, cosine: float) -> DataFrame:
    """(v, copies, n_links, component_id) of points of one dimension."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    axes = principal_axes(points, dim)
    placed = shared_table(_grid_order(points, axes, eps), "placed")
    packed = shared_table(pack_blocks(placed, axes), "vectorblocks")
    found = shared_table(_block_links(packed, near_blocks(packed, eps), axes, eps, cosine), "vectorlinks")
    links = found.groupBy("pos").agg(F.sum("links").alias("links"))
    comp = connected_components(found.where("pos <> low").select(F.col("pos").alias("a"), F.col("low").alias("b")))
    out = placed.select("pos", "v", "rep", "copies").join(links, "pos", "left").join(comp.withColumnRenamed("node", "pos"), "pos", "left")
    out = shared_table(out.select("v", "rep", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "pos").alias("comp")), "vectorcomp")
    low = shared_table(out.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("points")), "vectornames")
    named = shared_table(hot_join(out, low, ["comp"], "points", out.count()).select("v", "copies", "n_links", "component_id"), "vectornamed")
    drop_shared(placed, packed, found, out, low)
    return named
