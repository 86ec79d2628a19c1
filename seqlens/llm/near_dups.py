"""Near-duplicate documents by b-bit MinHash with exact confirmation.

Method: every document's distinct word shingles get PERMS random minima. Full minima of
ROWS consecutive permutations make band keys, which give candidates; of each minimum the low
BBITS bits are kept, packed into longs, and the similarity of a candidate pair is estimated
from the bit count of the xor, corrected for chance collisions. Pairs whose estimate is not
far below the threshold are confirmed on full shingle sets.

Scale: texts with equal sets become one class first. A bucket of many near copies is not
expanded into pairs: each member meets one centre of each of its buckets, picks the one with
the best estimate, and is confirmed against it; components form. Only then are members of a
bucket that still are in different components compared: all such pairs in a small bucket, and in
a large one by an inverted index, block by block. No link between components is lost. Joins on
buckets, classes and components take their few hot keys by broadcast (hot_join).
A pair at the threshold misses all bands with probability (1 - t**ROWS)**(PERMS/ROWS), 5e-8
at t = 0.8, and falls under the estimate's cut with a probability below 1e-4.

Defined results: null or wordless text has no shingles and links with nothing; fewer words
than a shingle make one shingle; very long texts are one set like any other; repeated rows and
rows that share an id are rows of their own, told apart by id and text; a null id counts as
larger than any other and never is a component's name unless it has no other; an empty table
gives an empty result; further columns, whatever their names, are carried along untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlens.operators.components import connected_components
from seqlens.operators.skew import hot_join
from seqlens.session import drop_shared, shared_table

PERMS, ROWS, BBITS = 128, 4, 4
WORDS = PERMS * BBITS // 64
#: Standard deviations below the threshold at which an estimate rules a pair out.
SLACK = 4.0
#: Buckets with more members are searched by an inverted index, in blocks of BLOCK members.
HOT, BLOCK = 48, 2000
_LOW = np.uint64(0x1111111111111111)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _params(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, n, dtype=np.uint64)


class Shingler:
    """Word shingles of a text as sorted distinct 64-bit hashes; keeps a bounded table of word hashes."""

    def __init__(self, k: int, most: int = 100_000):
        self.k, self.most, self.known = k, most, {}

    def words(self, text: str) -> np.ndarray:
        known, got = self.known, []
        for w in text.encode("utf-8", "surrogatepass").lower().split():
            h = known.get(w)
            if h is None:
                if len(known) >= self.most:
                    known.clear()
                h = known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
            got.append(h)
        return np.array(got, dtype=np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        w = self.words(text or "")
        if not len(w):
            return w
        n = max(1, len(w) - self.k + 1)
        h = np.full(n, len(w) if len(w) < self.k else 0, dtype=np.uint64)
        for i in range(min(self.k, len(w))):
            h = _mix(h * np.uint64(0xA0761D6478BD642F) + w[i : i + n])
        return np.unique(h)


def minima(sets: list[np.ndarray], block: int = 1 << 15) -> np.ndarray:
    """PERMS minima (upper 32 bits of a product) of each non-empty set: documents x PERMS."""
    a, b = _params(PERMS)
    out = np.full((len(sets), PERMS), 0xFFFFFFFF, dtype=np.uint64)
    first = 0
    while first < len(sets):
        last, n = first, 0
        while last < len(sets) and (last == first or n + len(sets[last]) <= block):
            n += len(sets[last])
            last += 1
        for lo in range(0, n, block) if last == first + 1 else (0,):
            flat = sets[first][lo : lo + block] if last == first + 1 else np.concatenate(sets[first:last])
            starts = [0] if last == first + 1 else np.cumsum([0, *map(len, sets[first : last - 1])])
            for p in range(PERMS):
                low = np.minimum.reduceat((flat * a[p] + b[p]) >> np.uint64(32), starts)
                out[first:last, p] = np.minimum(out[first:last, p], low)
        first = last
    return out


def signatures(low: np.ndarray) -> np.ndarray:
    """The low BBITS bits of each minimum, packed: documents x WORDS longs."""
    bits = (low & np.uint64((1 << BBITS) - 1)).reshape(len(low), WORDS, 64 // BBITS)
    shifts = np.arange(64 // BBITS, dtype=np.uint64) * np.uint64(BBITS)
    return np.bitwise_or.reduce(bits << shifts, axis=2)


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, the band's number mixed in: documents x bands."""
    bands = low.reshape(len(low), PERMS // ROWS, ROWS)
    h = np.tile(np.arange(PERMS // ROWS, dtype=np.uint64), (len(low), 1))
    for r in range(ROWS):
        h = _mix(h * np.uint64(0xA0761D6478BD642F) + bands[:, :, r])
    return h


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _keys(text: str, doc_id: str) -> tuple[Column, Column]:
    """Two hashes that tell a row by its id and text."""
    return F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.lit(7), text, doc_id).alias("k2")


def sketch_table(docs: DataFrame, k: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, k1, k2, n, cls, sig, bands): the row's keys, set size, digest of the whole set, packed signature, band keys."""
    kinds = {"n": pa.int64(), "cls": pa.binary(), "sig": pa.list_(pa.int64()), "bands": pa.list_(pa.int64())}

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = [shingler.shingles(t) for t in part.column("t").to_pylist()]
                low = minima([s for s in sets if len(s)])
                sig, keys = iter(_signed(signatures(low))), iter(_signed(band_keys(low)))
                rows = [(len(s), _set_digest(s), next(sig), next(keys)) if len(s) else (0, None, None, None) for s in sets]
                same = [part.column(c) for c in ("id", "k1", "k2")]
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(same + made, ["doc_id", "k1", "k2", *kinds])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), *_keys(text, doc_id), F.col(text).alias("t"))
    return rows.mapInArrow(sketch, "doc_id long, k1 long, k2 long, n long, cls binary, sig array<long>, bands array<long>")


def _set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: equal nibbles by bit counts, less those equal by chance."""
    differ = F.lit(0)
    low = F.lit(int(np.int64(_LOW)))
    for i in range(WORDS):
        x = a[i].bitwiseXOR(b[i])
        folded = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        differ = differ + F.bit_count(folded.bitwiseAND(low))
    chance = 2.0**-BBITS
    return (F.lit(1.0) - differ / F.lit(float(PERMS)) - F.lit(chance)) / F.lit(1 - chance)


def _cut(percent: int) -> float:
    t, chance = percent / 100, 2.0**-BBITS
    match = t + (1 - t) * chance
    return t - SLACK * (match * (1 - match) / PERMS) ** 0.5 / (1 - chance)


def _alike(a: str, b: str, percent: int) -> Column:
    """May the pair reach the threshold: sizes allow it and the estimate is not far below."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = (na * 100 >= nb * percent) & (nb * 100 >= na * percent)
    return sizes & (estimate(F.col(f"{a}.sig"), F.col(f"{b}.sig")) >= F.lit(_cut(percent)))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared * 100 >= (F.size("sa") + F.size("sb") - shared) * percent).select("a", "b")


def link_classes(docs: DataFrame, sketches: DataFrame, k: int, percent: int, text: str, doc_id: str) -> DataFrame:
    """(node, component) over classes of equal sets that have a link to another class."""
    rep = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "k1", "k2")
    classes = sketches.where("n > 0").groupBy("cls").agg(F.min_by(F.struct("n", "sig", "bands", "k1", "k2"), rep).alias("c"))
    classes = shared_table(classes.select("cls", "c.*"), "classes")
    total = classes.count() * (PERMS // ROWS)
    member = classes.select("cls", F.explode("bands").alias("key"))
    centre = member.groupBy("key").agg(F.min_by("cls", F.xxhash64("cls", "key")).alias("centre"), F.count(F.lit(1)).alias("members")).where("members > 1")
    centre = shared_table(centre, "centres")
    bucket = shared_table(hot_join(member, centre, ["key"], "members", total).select("key", "cls", "centre", "members"), "buckets")
    light = classes.select("cls", "n", "sig")

    near = shared_table(bucket.where("cls <> centre").select("cls", "centre").distinct(), "near")
    hubs = near.groupBy("centre").agg(F.count(F.lit(1)).alias("met")).join(light.withColumnRenamed("cls", "centre"), "centre")
    hubs = shared_table(hubs, "hubs")
    near = hot_join(near, hubs, ["centre"], "met", near.count()).alias("r").join(light.alias("l"), "cls")
    near = near.where(_alike("l", "r", percent)).select("cls", "centre", estimate(F.col("l.sig"), F.col("r.sig")).alias("e"))
    best = near.groupBy("cls").agg(F.max_by("centre", F.struct("e", "centre")).alias("centre"))
    best = shared_table(best.select(F.least("cls", "centre").alias("a"), F.greatest("cls", "centre").alias("b")).distinct(), "stars")

    wanted = bucket.select("cls").distinct().join(classes.select("cls", "k1", "k2"), "cls")
    sets = shared_table(_shingle_sets(docs, wanted, k, text, doc_id), "shinglesets")
    first = shared_table(_confirm(best, sets, percent), "links")

    comp = connected_components(first).select(F.col("node").alias("cls"), F.xxhash64("component").alias("comp"))
    placed = bucket.join(comp, "cls", "left").select("key", "cls", "members", F.coalesce("comp", F.xxhash64("cls")).alias("comp"))
    placed = shared_table(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("members").alias("held")).where("lo <> hi")
    mixed = shared_table(mixed.select("key", "held"), "mixedbuckets")
    placed = hot_join(placed, mixed, ["key"], "held", total).drop("held")
    few = placed.where(F.col("members") <= HOT).join(light, "cls")
    few = shared_table(few.select("key", "cls", "comp", "n", "sig"), "few")
    meet = (F.col("l.key") == F.col("r.key")) & (F.col("l.comp") != F.col("r.comp")) & (F.col("l.cls") < F.col("r.cls"))
    rest = few.alias("l").join(few.alias("r"), meet & _alike("l", "r", percent)).select(F.col("l.cls").alias("a"), F.col("r.cls").alias("b"))
    many = shared_table(placed.where(F.col("members") > HOT), "many")
    rest = rest.unionByName(_hot_links(many, sets, percent)).distinct()
    more = shared_table(_confirm(rest.join(best, ["a", "b"], "left_anti"), sets, percent), "links")
    found = shared_table(connected_components(first.unionByName(more)), "classcomponents")
    drop_shared(classes, centre, bucket, hubs, best, sets, first, few, many, more)
    return found


def _hot_links(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a large bucket that lie in different components and may reach the threshold.

    Members outside the bucket's main component are looked up in an inverted index of all its
    members, block by block; of each component a member links to, one pair is returned. All
    members travel once for each block of askers, so a bucket whose members are nearly all in one
    component travels once. Sets travel as 32-bit hashes, which can only overrate a pair;
    full sets decide later.
    """
    counts = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
    # members outside the main component are its askers
    main = counts.agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("held"), (F.sum("n") - F.max("n")).alias("askers"))
    main = shared_table(main, "mainparts")
    short = sets.select("cls", F.transform("shingles", lambda x: F.hash(x)).alias("t"))
    rows = hot_join(placed, main, ["key"], "held", placed.count())
    mine = lambda n: F.pmod(F.xxhash64("cls"), F.ceil(F.col(n) / BLOCK)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / BLOCK).cast("int") - 1))
    asks = rows.where("comp <> main").select("key", mine("askers").alias("i"), every("held").alias("j"), F.lit(True).alias("asks"), "cls", "comp")
    told = rows.select("key", every("askers").alias("i"), mine("held").alias("j"), F.lit(False).alias("asks"), "cls", "comp")
    meeting = asks.unionByName(told).join(short, "cls")

    def look(group: pd.DataFrame) -> pd.DataFrame:
        told, asks = group[~group["asks"]], group[group["asks"]]
        if not len(told) or not len(asks):
            return pd.DataFrame({"a": [], "b": []})
        size = np.array([len(t) for t in told["t"]])
        tokens = np.concatenate(told["t"].to_list())
        order = np.argsort(tokens, kind="stable")
        owner, tokens = np.repeat(np.arange(len(size)), size)[order], tokens[order]
        comp, cls = told["comp"].to_numpy(), told["cls"].to_numpy()
        out = []
        for c, mine, t in asks[["cls", "comp", "t"]].itertuples(index=False):
            lo, hi = np.searchsorted(tokens, t, "left"), np.searchsorted(tokens, t, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            common = np.minimum(np.bincount(owner[at], minlength=len(size)), np.minimum(size, len(t)))
            hit = np.flatnonzero((common * 100 >= (size + len(t) - common) * percent) & (comp != mine))
            for i in hit[np.unique(comp[hit], return_index=True)[1]]:
                out.append((min(c, cls[i]), max(c, cls[i])))
        return pd.DataFrame(out, columns=["a", "b"])

    return meeting.groupBy("key", "i", "j").applyInPandas(look, "a binary, b binary")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, k: int, text: str, doc_id: str) -> DataFrame:
    """(cls, shingles) of the wanted classes (cls, k1, k2), from the texts of their representative rows."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = [(c, shingler.shingles(t)) for c, t in zip(part.column("cls").to_pylist(), part.column("t").to_pylist(), strict=True)]
                got = [(c, _signed(s)) for c, s in got if _set_digest(s) == c]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in got], pa.binary()), pa.array([s for _, s in got], pa.list_(pa.int64()))], ["cls", "shingles"])

    rows = docs.select(*_keys(text, doc_id), F.col(text).alias("t"))
    # repeated rows have one key and one text: a class comes with one of them
    rows = rows.join(wanted, ["k1", "k2"]).select("cls", "t").dropDuplicates(["cls"])
    return rows.mapInArrow(sets, "cls binary, shingles array<long>")


def class_components(docs: DataFrame, shingle: int, percent: int, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and (cls, component_id, comp, held) of every class: its component's smallest id and key, and its rows."""
    sketches = shared_table(sketch_table(docs, shingle, text, doc_id), "sketches")
    comp = link_classes(docs, sketches, shingle, percent, text, doc_id)
    named = sketches.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("held"))
    named = named.join(comp, F.col("cls") == F.col("node"), "left").select("cls", "rep", "held", F.coalesce("component", "cls").alias("comp"))
    named = shared_table(named, "named")
    lowest = shared_table(named.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("classes")), "lowest")
    found = shared_table(hot_join(named, lowest, ["comp"], "classes", named.count()).select("cls", "component_id", "comp", "held"), "classnames")
    drop_shared(comp, named, lowest)
    return sketches, found


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs.

    Two documents link when 100 * shared shingles >= percent * united shingles;
    component_id is the smallest doc_id reachable over links, and kept marks it.
    """
    sketches, named = class_components(docs, shingle, percent, text, doc_id)
    rows = hot_join(sketches.where("n > 0").select("doc_id", "n", "cls"), named, ["cls"], "held", sketches.count())
    out = rows.select("doc_id", "n", "component_id").unionByName(sketches.where("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("component_id")))
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each near-duplicate component: that with the smallest id, and of rows that share it, the smallest key.

    Rows equal in id and text, null or not, are one document, and one of them stays; rows without
    words link with nothing, so each such document stays. Further columns come from the row
    that stays. Null, empty and very long texts, and an empty table, are as in near_duplicates.
    """
    sketches, named = class_components(docs, shingle, percent, text, doc_id)
    rows = sketches.where("n > 0").select("doc_id", "k1", "k2", "cls")
    rows = hot_join(rows, named.select("cls", "comp", "held"), ["cls"], "held", sketches.count())
    first = rows.groupBy("comp").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "k1", "k2")).alias("f")).select("f.k1", "f.k2")
    stay = first.unionByName(sketches.where("n = 0").select("k1", "k2").distinct())
    stay = stay.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
    k1, k2 = _keys(text, doc_id)
    # equal rows are dropped on the map side first, so a row repeated very often is one row a task
    single = docs.withColumns({"__k1": k1, "__k2": k2}).dropDuplicates(["__k1", "__k2"])
    return single.join(stay, ["__k1", "__k2"], "left_semi").select(*docs.columns)
