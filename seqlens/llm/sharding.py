"""Shards of near-equal bytes by k-d tree partitioning.

Method: equal texts form one point with metadata dimensions (log size, source, language,
first id, each scaled to 0..1) and the bytes of all its rows as weight. A node holding k shards is
split along its widest dimension at the weighted quantile where its left shards are full;
ties along it are broken by the point's hash. The quantile is found by histograms that are
refined around the boundary, for all nodes of a level at once, so nothing is sorted and only bin
sums move. The driver holds the tree's splits (one fewer than shards) and the heavy groups.

Groups of equal texts of more than GRAIN of a shard, at most shards / GRAIN of them, are heavy: they
would unbalance a split. Largest first, each goes whole to the shard with the most room left, and the tree
then fills what is left of every shard. Only a group that fits no shard whole is cut: into pieces of
at most PIECE of a shard, by a hash of its rows, each placed like a group. So equal texts lie in one
shard unless together they exceed what a shard has room for.

Law: bytes. Sizes of shards differ from the mean by about 2 * GRAIN of it, or by one row where a
single row is larger; heavy pieces are cut by a hash, which adds about the square root of their rows.

Defined results: null text has 0 bytes and crc32 of the empty text; very long texts are single
rows and are never cut; null source or language is a value of its own; repeated rows are rows; ties are
broken by hashes; slots number a shard's rows from 0 without gaps; further columns, whatever their
names, are not read; an empty table gives an empty result. grown_shard is null: the law is not a key law.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlens.session import drop_shared, shared_table

SHARDS, OVERHEAD, GRAIN, PIECE = 24, 8, 0.005, 0.05
BINS, PASSES = 256, 4
DIMS = ("d0", "d1", "d2", "d3")


def _unit(name: Column) -> Column:
    """A string's place in 0..1: equal strings share it; null is below all."""
    return F.when(name.isNull(), F.lit(-0.05)).otherwise(F.shiftrightunsigned(F.xxhash64(name), 11) / F.lit(float(1 << 53)))


def place_heavy(groups: list[tuple[object, float]], shards: int, room: float) -> tuple[dict[object, int], set, list[float]]:
    """Groups (name, bytes), largest first, each to the shard with the most room: shard by name, those that fit none, and the loads."""
    load, where, over = [0.0] * shards, {}, set()
    for name, size in sorted(groups, key=lambda g: (-g[1], str(g[0]))):
        i = min(range(shards), key=lambda s: (load[s], s))
        if load[i] + size > room:
            over.add(name)
            continue
        load[i] += size
        where[name] = i
    return where, over, load


def _scaled(points: DataFrame) -> DataFrame:
    lo, hi, most = points.agg(F.min("first"), F.max("first"), F.max("size")).first()
    span = max(1, (hi or 0) - (lo or 0))
    first = F.coalesce((F.col("first") - F.lit(lo or 0)) / F.lit(float(span)), F.lit(1.05))
    size = F.log2(F.col("size").cast("double")) / F.lit(64.0)
    return points.select("digest", "bytes", size.alias("d0"), _unit(F.col("source")).alias("d1"), _unit(F.col("lang")).alias("d2"), first.alias("d3"), "tie")


def _by_node(values: dict[int, Column]) -> Column:
    """A column chosen by the row's node; null for other nodes. One flat CASE, however many nodes."""
    out = F.when(F.lit(False), F.lit(None))
    for n, c in values.items():
        out = out.when(F.col("node") == n, c)
    return out


def _quantiles(points: DataFrame, need: dict[int, float], value: Column, bounds: dict[int, tuple[float, float]], under: dict[int, float]) -> tuple[dict[int, float], dict[int, float]]:
    """Per node the value at which the running weight reaches need, to BINS**-PASSES of the bounds; and the weight below it."""
    bounds, under = dict(bounds), dict(under)
    for _ in range(PASSES):
        live = {n: b for n, b in bounds.items() if b[1] > b[0]}
        if not live:
            break
        lo, hi = (_by_node({n: F.lit(float(b[i])) for n, b in live.items()}).cast("double") for i in (0, 1))
        rows = points.select("node", "bytes", value.alias("v"), lo.alias("lo"), hi.alias("hi")).where("v >= lo AND v <= hi")
        place = F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS))
        sums = rows.groupBy("node", place.alias("bin")).agg(F.sum("bytes").alias("w"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        for n in live:
            run = under[n]
            for s in sorted((s for s in sums if s.node == n), key=lambda s: s.bin):
                bounds[n], under[n] = (s.a, s.b), run
                run += s.w
                if run >= need[n]:
                    break
    return {n: b[0] for n, b in bounds.items()}, under


def grow_tree(points: DataFrame, room: list[float]) -> tuple[DataFrame, dict[int, int]]:
    """points (bytes, dimensions, tie) with their leaf as node, and the shard number of each leaf; shares of the weight as in room.

    Node numbers: root 1, children 2n and 2n + 1. Each level's nodes are written before the next is split.
    """
    held = {1: (0, len(room))}
    placed = points.withColumn("node", F.lit(1))
    while nodes := [n for n, (lo, hi) in held.items() if hi - lo > 1 and 2 * n not in held]:
        live = placed.where(F.col("node").isin(nodes))
        spans = [f(d).alias(f"{f.__name__}_{d}") for d in DIMS for f in (F.min, F.max)]
        stats = {r.node: r for r in live.groupBy("node").agg(F.sum("bytes").alias("w"), *spans).collect()}
        full = [n for n in nodes if n in stats]
        widest = {n: max(DIMS, key=lambda d, n=n: stats[n][f"max_{d}"] - stats[n][f"min_{d}"]) for n in full}
        middle = {n: (held[n][0] + held[n][1]) // 2 for n in nodes}
        share = {n: sum(room[held[n][0] : middle[n]]) / max(sum(room[slice(*held[n])]), 1e-9) for n in full}
        need = {n: stats[n].w * share[n] for n in full}
        value = _by_node({n: F.col(widest[n]) for n in full}).cast("double")
        bounds = {n: (stats[n][f"min_{widest[n]}"], stats[n][f"max_{widest[n]}"]) for n in full}
        cut, under = _quantiles(live, need, value, bounds, dict.fromkeys(full, 0))
        tied = live.where(value == _by_node({n: F.lit(float(v)) for n, v in cut.items()}).cast("double"))
        tie, _ = _quantiles(tied, need, F.col("tie"), dict.fromkeys(full, (0.0, 1.0)), under)
        step = {}
        for n in nodes:
            held[2 * n], held[2 * n + 1] = (held[n][0], middle[n]), (middle[n], held[n][1])
            if n in widest:
                d = F.col(widest[n])
                left = (d < F.lit(float(cut[n]))) | (d == F.lit(float(cut[n]))) & (F.col("tie") < F.lit(float(tie[n])))
                step[n] = F.when(left, F.lit(2 * n)).otherwise(F.lit(2 * n + 1))
        last, placed = placed, shared_table(placed.withColumn("node", F.coalesce(_by_node(step).cast("int"), "node")), "shardtree")
        if hasattr(last, "_shared_path") and last is not points:
            drop_shared(last)
    return placed, {n: lo for n, (lo, hi) in held.items() if hi - lo == 1}


def shard_rows(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id", source: str = "source", lang: str = "lang", grain: float = GRAIN) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for each row of docs."""
    spark = docs.sparkSession
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), F.col(lang).alias("lang"), raw.alias("raw"))
    digest = F.concat_ws(" ", F.hex(F.xxhash64("raw")), F.hex(F.crc32("raw")), F.hex(F.xxhash64(F.lit(7), "raw")), F.octet_length("raw").cast("string"))
    rows = rows.select("id", "source", "lang", (F.octet_length("raw") + OVERHEAD).cast("long").alias("size"), F.crc32("raw").alias("crc"), digest.alias("digest"))
    rows = shared_table(rows, "shardrows")
    mean = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("size").alias("size"), F.min("source").alias("source"), F.min("lang").alias("lang"), F.min("id").alias("first"))
    groups = shared_table(groups, "shardgroups")
    # at most shards / grain groups are heavy, so their list has a bound, on the driver and in broadcasts
    heavy = {r.digest: (r.bytes, r.n) for r in groups.where(F.col("bytes") > grain * mean).select("digest", "bytes", "n").collect()}
    cut: dict[str, int] = {}
    while True:
        items = [((d, 0), b) for d, (b, _) in heavy.items() if d not in cut]
        items += [((d, i), heavy[d][0] / k) for d, k in cut.items() for i in range(k)]
        _, over, _ = place_heavy(items, shards, mean * (1 + grain))
        if not (more := {d for d, _ in over if d not in cut and heavy[d][1] > 1}):
            break
        cut |= {d: min(heavy[d][1], math.ceil(heavy[d][0] / (PIECE * mean))) for d in more}
    exact = [((d, 0), b) for d, (b, _) in heavy.items() if d not in cut]
    torn = spark.createDataFrame(list(cut.items()), "digest string, pieces int")
    rows = rows.join(F.broadcast(torn), "digest", "left")
    rows = rows.withColumn("piece", F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("id", "source", "lang"), F.col("pieces"))).otherwise(F.lit(0)).cast("int")).drop("pieces")
    if cut:
        sums = rows.join(F.broadcast(torn.select("digest")), "digest", "left_semi").groupBy("digest", "piece").agg(F.sum("size").alias("b")).collect()
        exact += [((r.digest, r.piece), r.b) for r in sums]
    where, over, load = place_heavy(exact, shards, float("inf"))
    light = groups.where(F.col("bytes") <= grain * mean).withColumn("tie", F.shiftrightunsigned(F.xxhash64("digest"), 11) / F.lit(float(1 << 53)))
    points = shared_table(_scaled(light), "shardpoints")
    grown, number = grow_tree(points, [max(0.0, mean - x) for x in load])
    shard = _by_node({n: F.lit(i) for n, i in number.items()})
    light = grown.select("digest", F.lit(0).alias("piece"), shard.cast("int").alias("shard"))
    fixed = spark.createDataFrame([(d, i, s) for (d, i), s in where.items()], "digest string, piece int, shard int")
    # a light group holds less than grain of a shard, so no task gets much of one key
    out = rows.join(F.broadcast(fixed), ["digest", "piece"]).unionByName(rows.join(F.broadcast(fixed.select("digest").distinct()), "digest", "left_anti").join(light, ["digest", "piece"]))
    out = shared_table(out.select("id", "size", "crc", "shard"), "sharded")
    drop_shared(groups, points, *([grown] if hasattr(grown, "_shared_path") else []))
    return _slots(out, shards)


def _slots(rows: DataFrame, shards: int, per: int = 20_000) -> DataFrame:
    """Number each shard's rows: rows are dealt into cells of about per rows, numbered within, and cells' counts summed."""
    cells = max(1, rows.count() // (per * shards))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("id", "crc"), F.lit(cells)))
    counts = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select(F.col("shard").alias("bs"), F.col("cell").alias("bc"), before.alias("base"))
    inner = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id", "crc", "size")) - 1
    rows = rows.withColumn("inner", inner).join(base, (F.col("shard") == F.col("bs")) & (F.col("cell") == F.col("bc")))
    return rows.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("inner")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
