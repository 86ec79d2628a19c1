"""Best-fit packing of documents into sequences of bounded length by swap-based local search.

Method: documents become token ids, an end id after each, and those longer than a sequence are cut
into whole sequences and a rest. Whole sequences stand alone. All other pieces are dealt by hash into groups of
about GROUP, so that each group has the lengths of the whole; a task packs a group: first every piece,
longest first, into the fullest bin that still has room, then a local search. The search takes the emptiest bin and
looks, over all other underfull bins, for the exchange that raises the sum of squared fills most: one or two
pieces moved, else one for one, else two for one or one for two. It goes on until the bin is empty or nothing
helps, then takes the next bin; it ends when a pass over all bins changes nothing, when no fewer
bins are possible (least_bins), or after as many exchanges as the group has pieces.

Bins that are full are finished. The pieces of underfull bins are dealt anew, with those of other groups,
and packed again, until they fit one group, a round saves no bin, or fewer bins are not possible. So
no group is unbounded, and groups leave no bins behind that others could fill.

ids are kept as they are encoded: packed_sequences gives the packed sequences themselves.

Defined results: null text is the empty text, the end id alone; very long texts are cut into many pieces; null
ids are carried along; repeated rows are packed each; ties among lengths are broken by the row's place;
an empty table gives an empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.llm.token_store import _encoder, _parts
from seqlens.session import shared_table

SIZE, GROUP, MOST_ROUNDS = 2048, 2048, 12


def encode_pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(rid, doc_id, piece, start, length, ids_crc32, width, ids): a row a piece, written once; ids are a zstd frame of numbers of width bytes."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pack = _encoder(definition.value, end_id), zstandard.ZstdCompressor(level=1).compress
        width = encoder.dtype.itemsize
        for part in _parts(batches, 256):
            flat, starts = encoder.encode([t or b"" for t in part.column("t").to_pylist()])
            count = -(-np.diff(starts) // size)
            owner = np.repeat(np.arange(len(count)), count)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            begin = starts[owner] + piece * size
            end = np.minimum(begin + size, starts[owner + 1])
            wide, data, at = memoryview(flat.astype("<u4")).cast("B"), memoryview(flat).cast("B"), list(zip(begin.tolist(), end.tolist()))
            columns = {
                "doc_id": part.column("id").take(pa.array(owner)), "piece": pa.array(piece, pa.int32()), "start": pa.array(piece * size, pa.int64()), "length": pa.array(end - begin, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(wide[4 * a : 4 * b]) for a, b in at], pa.int64()), "width": pa.array([width] * len(at), pa.int32()), "ids": pa.array([pack(data[a * width : b * width]) for a, b in at], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.encode(F.col(text), "UTF-8").alias("t"))
    staged = rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, width int, ids binary")
    return shared_table(staged.withColumn("rid", F.monotonically_increasing_id()), "pieces")


def least_bins(lengths: np.ndarray, size: int) -> int:
    """A number of bins that no packing can go below.

    For any k: pieces over size - k share a bin with none of k or more, those over half of size stand in bins
    of their own, and only the room that is left there can take pieces from k to half of size.
    """
    count = np.bincount(lengths, minlength=size + 1)
    sums, number = np.cumsum(count * np.arange(size + 1)), np.cumsum(count)
    k = np.arange(size // 2 + 1)
    large, below = number[size] - number[size // 2], np.concatenate([[0], sums])[k]
    fitting = sums[size - k] - sums[size // 2]
    rest = sums[size // 2] - below - ((number[size - k] - number[size // 2]) * size - fitting)
    return int(large + np.maximum(0, -(-rest // size)).max())


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin with room for it."""
    bins: list[list[int]] = []
    # bins by the room they have left, and which rooms there are as bits of one number
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        by_room[room - need].append(b)
        rooms |= 1 << (room - need)
    return bins


class _Bin:
    """An underfull bin: its items by length, and the sums that one or two of them can give.

    A bin has few distinct lengths, since distinct lengths add up: their number grows with the root of its size.
    """

    def __init__(self, items: list[int], lengths: list[int]):
        self.by_length: dict[int, list[int]] = {}
        for i in items:
            self.by_length.setdefault(lengths[i], []).append(i)
        self.fill = sum(lengths[i] for i in items)
        self._sums()

    def _sums(self) -> None:
        one = np.array(sorted(self.by_length), dtype=np.int64)
        twice = one[[len(self.by_length[x]) > 1 for x in one.tolist()]] if len(one) else one
        a, b = np.triu_indices(len(one), 1)
        self.one, self.two = one, np.unique(np.concatenate([one[a] + one[b], 2 * twice]))

    def split(self, total: int, many: int) -> list[int]:
        """The lengths of so many items whose sum is total."""
        if many < 2:
            return [total] * many
        for x in self.by_length:
            y = total - x
            if y in self.by_length and (x != y or len(self.by_length[x]) > 1):
                return [x, y]
        raise AssertionError("no two items have this sum")

    def swap(self, out: list[int], into: list[int], other: _Bin) -> None:
        """Give items of the lengths out to other, and take items of the lengths in into."""
        given, taken = [self._take(x) for x in out], [other._take(x) for x in into]
        for bin_, lens, items in ((other, out, given), (self, into, taken)):
            for x, i in zip(lens, items, strict=True):
                bin_.by_length.setdefault(x, []).append(i)
                bin_.fill += x
        self._sums()
        other._sums()

    def _take(self, length: int) -> int:
        items = self.by_length[length]
        i = items.pop()
        if not items:
            del self.by_length[length]
        self.fill -= length
        return i

    def items(self) -> list[int]:
        return [i for held in self.by_length.values() for i in held]


def _best_exchange(mine: _Bin, others: list[_Bin], size: int) -> tuple[int, int, int, int, int] | None:
    """(other's number, sum given, items given, sum taken, items taken) of the exchange that raises squared fills most; None if none does."""
    fill = np.array([o.fill for o in others], dtype=np.int64)
    best, found = 0, None
    # what is given (one or two items), against what comes back (nothing, one or two, but not two for two)
    for give, back, dearer in ((1, 0, False), (2, 0, False), (1, 1, True), (2, 1, True), (1, 2, False)):
        if found and dearer:
            break
        sums = mine.one if give == 1 else mine.two
        if not len(sums):
            continue
        if back:
            parts = [o.one if back == 1 else o.two for o in others]
            came, owner = np.concatenate(parts), np.repeat(np.arange(len(others)), [len(p) for p in parts])
        else:
            came, owner = np.zeros(len(others), dtype=np.int64), np.arange(len(others))
        if not len(came):
            continue
        # the largest sum that still fits the other bin once it has given
        at = np.searchsorted(sums, came + size - fill[owner], side="right") - 1
        gain = np.where(at >= 0, sums[at] - came, 0)
        rise = np.where(gain > 0, gain * (fill[owner] - mine.fill + gain), 0)
        k = int(np.argmax(rise))
        if rise[k] > best:
            best, found = int(rise[k]), (int(owner[k]), int(sums[at[k]]), give, int(came[k]), back)
    return found


def local_search(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """bins after exchanges between underfull ones, each raising the sum of squared fills; never more bins than before."""
    fills = [sum(lengths[i] for i in b) for b in bins]
    done = [b for b, f in zip(bins, fills, strict=True) if f == size]
    live = [_Bin(b, lengths) for b, f in zip(bins, fills, strict=True) if f < size]
    spare = len(bins) - least_bins(np.array(lengths, dtype=np.int64), size)
    left = len(lengths)
    moved = True
    while moved and spare > 0 and left > 0:
        moved = False
        live.sort(key=lambda b: b.fill)
        for mine in list(live):
            others = [b for b in live if b is not mine and b.fill < size]
            while spare > 0 and left > 0 and 0 < mine.fill < size and others and (step := _best_exchange(mine, others, size)):
                n, given, many, came, back = step
                mine.swap(mine.split(given, many), others[n].split(came, back), others[n])
                moved, left = True, left - 1
                if others[n].fill == size:
                    others.pop(n)
            if not mine.fill:
                spare -= 1
        live = [b for b in live if b.fill]
    return done + [b.items() for b in live]


def pack_lengths(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers whose lengths add up to at most size."""
    return local_search(best_fit(lengths, size), lengths, size)


def _packed(groups: DataFrame, size: int) -> DataFrame:
    """Rows with their group g as bin (its number in the group), place, offset and fill."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("rid")
        lengths = table["length"].to_pylist()
        bins = [sorted(b) for b in pack_lengths(lengths, size)]
        order = np.array([i for b in bins for i in b], dtype=np.int64)
        count = np.array([len(b) for b in bins], dtype=np.int64)
        place = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
        run = np.cumsum(np.array(lengths, dtype=np.int64)[order])
        fill = np.diff(run[np.cumsum(count) - 1], prepend=0)
        before = np.repeat(np.cumsum(fill) - fill, count)
        out = table.take(pa.array(order))
        more = {"bin": np.repeat(np.arange(len(bins)), count), "place": place, "offset": run - np.array(lengths, dtype=np.int64)[order] - before, "fill": np.repeat(fill, count)}
        for name, values in more.items():
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema)
    return groups.groupBy("g").applyInArrow(pack, f"{types}, bin long, place long, offset long, fill long")


def pack_pieces(pieces: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """pieces (rid, length and other columns) with sequence_id, place (from 0) and offset in the sequence."""
    own = list(pieces.columns)
    full = pieces.where(F.col("length") >= size)
    out = full.select(*own, (F.lit(1 << 62) + F.col("rid")).alias("sequence_id"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("offset"))
    left, written, bins = pieces.where(F.col("length") < size), None, None
    for turn in range(MOST_ROUNDS):
        count, total = left.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        if not count:
            break
        many = -(-count // group)
        dealt = left.withColumn("g", F.pmod(F.xxhash64("rid", F.lit(turn)), F.lit(many)))
        packed = shared_table(_packed(dealt, size), "packed")
        number = F.shiftleft(F.lit(turn).cast("long"), 56) + F.shiftleft("g", 24) + F.col("bin")
        done = packed.select(*own, number.alias("sequence_id"), "place", "offset", "fill")
        # bins are counted by their first pieces
        now, underfull = packed.where("place = 0").agg(F.count(F.lit(1)), F.count_if(F.col("fill") < size)).first()
        stuck = bins is not None and now >= bins
        if many == 1 or stuck or now <= -(-total // size):
            out = out.unionByName(done.drop("fill"))
            break
        open_ = packed.where(F.col("fill") < size)
        if turn == MOST_ROUNDS - 1:
            out = out.unionByName(done.drop("fill"))
            break
        out = out.unionByName(done.where(F.col("fill") == size).drop("fill"))
        left, bins = open_.select(*own), underfull
    return out


def packed_sequences(pieces: DataFrame, plan: DataFrame) -> DataFrame:
    """(sequence_id, length, doc_ids, starts, ids): the sequences of a plan over encode_pieces, their ids in order; at most a sequence's ids are gathered."""
    rows = plan.select("sequence_id", "place", "offset", "rid").join(pieces.select("rid", "doc_id", "length", "width", "ids"), "rid")
    rows = rows.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("place", "offset", "doc_id", "width", "ids"))).alias("p"))
    rows = rows.select("sequence_id", "length", F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"), F.col("p.width").alias("w"), F.col("p.ids").alias("frames"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for part in _parts(batches):
            frames, widths = part.column("frames").to_pylist(), part.column("w").to_pylist()
            ids = [np.concatenate([np.frombuffer(unpack(f), dtype=f"<u{w}") for f, w in zip(fs, ws)]).astype("<i4") for fs, ws in zip(frames, widths)]
            kept = [part.column(c) for c in ("sequence_id", "length", "doc_ids", "starts")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.list_(pa.int32()))], ["sequence_id", "length", "doc_ids", "starts", "ids"])

    return rows.mapInArrow(join, "sequence_id long, length long, doc_ids array<long>, starts array<long>, ids array<int>")


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = 0, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """encode_pieces of docs, and their plan: doc_id, piece, start, length, ids_crc32, sequence_id, place, offset."""
    pieces = encode_pieces(docs, tokenizer_path, size, end_id, text, doc_id)
    return pieces, pack_pieces(pieces.select("rid", "doc_id", "piece", "start", "length", "ids_crc32"), size)
