"""Column functions over nucleotide text, and the one k-mer kernel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: IUPAC letters and their complements (S and W are their own).
IUPAC, COMPLEMENT = "ACGTRYMKBDHVN", "TGCAYRKMVHDBN"
BASES = "ACGT"
#: Rows at which the k-mer kernel hands a batch on; a single sequence's rows stay together.
BATCH = 100_000


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, IUPAC, COMPLEMENT))


def canonical(seq: Column) -> Column:
    """The smaller of a sequence and its reverse complement."""
    return F.least(seq, revcomp(seq))


def count_of(seq: Column, letters: str) -> Column:
    """How many characters of seq are among letters."""
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def gc_fraction(seq: Column) -> Column:
    """G and C among A, C, G, T; 0 without any."""
    known = count_of(seq, BASES)
    return F.when(known > 0, count_of(seq, "GC") / known).otherwise(0.0)


def ambiguous_fraction(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, 1 - count_of(seq, BASES) / F.length(seq)).otherwise(0.0)


def entropy(word: Column) -> Column:
    """Shannon entropy in bits over A, C, G, T of a word made of them."""
    total = F.lit(0.0)
    for base in BASES:
        p = count_of(word, base) / F.length(word)
        total = total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return total


def low_complexity(word: Column, threshold: float = 1.5) -> Column:
    return entropy(word) < threshold


def fragment_id(name: Column) -> Column:
    """A read name without its mate suffix."""
    return F.regexp_replace(name, "/[12]$", "")


def flip(node: Column) -> Column:
    """An oriented node in the other orientation."""
    n = F.length(node)
    return F.concat(F.substring(node, F.lit(1), n - 1), F.translate(F.substring(node, n, F.lit(1)), "+-", "-+"))


def mean_phred(qual: Column) -> Column:
    codes = F.transform(F.split(qual, ""), lambda c: F.ascii(c) - 33)
    return F.when(F.length(qual) > 0, F.aggregate(codes, F.lit(0), lambda s, x: s + x) / F.length(qual)).otherwise(0.0)


def n_fraction(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, count_of(F.upper(seq), "N") / F.length(seq)).otherwise(0.0)


def cigar_ops(cigar: Column) -> Column:
    """array<struct<n, op>> of a CIGAR; null for one that isn't well formed."""
    n = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1)), lambda x: x.cast("int"))
    op = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    pairs = F.zip_with(n, op, lambda x, y: F.struct(x.alias("n"), y.alias("op")))
    return F.when(cigar.rlike(r"^(\d+[MIDNSHP=X])+$"), pairs)


def cigar_length(cigar: Column) -> Column:
    """Reference bases that a CIGAR spans."""
    return F.aggregate(cigar_ops(cigar), F.lit(0), lambda s, x: s + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["n"]).otherwise(0))


def cigar_blocks(start: Column, cigar: Column) -> Column:
    """array<struct<start, end>> of aligned blocks from a 0-based start."""
    kind = "array<struct<start:int,end:int>>"
    zero = F.struct(start.cast("int").alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        after = acc["at"] + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["n"]).otherwise(0)
        block = F.array(F.struct(acc["at"].alias("start"), after.alias("end")))
        return F.struct(after.alias("at"), F.when(x["op"].isin("M", "=", "X"), F.concat(acc["out"], block)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(cigar_ops(cigar), zero, step, lambda acc: acc["out"])


def rolled(base: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words of k bases (0 to 3), on both strands: words are doubled and lengthened up to k."""
    ahead, back, have = base, 3 - base, 1
    for bit in bin(k)[3:]:
        n = len(base) - 2 * have + 1
        ahead, back, have = (ahead[:n] << 2 * have) | ahead[have:], (back[have:] << 2 * have) | back[:n], 2 * have
        if bit == "1":
            ahead, back, have = (ahead[:-1] << 2) | base[have:], ((3 - base[have:]) << 2 * have) | back[:-1], have + 1
    return ahead, back


def kmer_table(seqs: DataFrame, k: int, name: str = "name", seq: str = "seq", positions: bool = False, circular: str | None = None, tag: str | None = None, among: np.ndarray | None = None) -> DataFrame:
    """Canonical k-mers made of A, C, G, T only: (name, code, n, low), or with positions (name, tag, len, pos, code, low, times, first).

    code packs two bits a base, so for k <= 31 it is a long whose order is that of the word
    (see kmer_word). Rolling codes of both strands are arrays over the whole sequence:
    cost is linear in its length. A circular sequence of k or more bases is read past its end.
    With positions, tag is carried along as text, len is the sequence's length, times says how often the sequence
    holds the word, and first marks the word's first place there, so that nothing need be counted again.
    among, ascending codes, keeps those words alone, and no others are sorted or handed on.
    """
    if not 1 <= k <= 31:
        raise ValueError("k must be between 1 and 31")
    table = np.full(256, 4, dtype=np.uint8)
    table[[ord(c) for c in BASES]] = range(4)
    # most words fall on an empty slot of a table with 16 slots or more a code, and are done
    bits = max(16, int(0 if among is None else len(among)).bit_length() + 4)
    slot = lambda code: (code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    made: list[np.ndarray] = []

    def asked(code: np.ndarray) -> np.ndarray:
        """Places of the words that are among."""
        if not made:
            made.append(np.zeros(1 << bits, bool))
            made[0][slot(among)] = True
        near = np.flatnonzero(made[0][slot(code)])
        at = np.searchsorted(among, code[near])
        return near[among[np.minimum(at, len(among) - 1)] == code[near]]

    def words(text: str, wrap: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if wrap and len(text) >= k:
            text += text[: k - 1]
        codes = table[np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8)]
        n = len(codes) - k + 1
        if n < 1:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
        ahead, back = rolled(codes.astype(np.int64) & 3, k)
        code = np.minimum(ahead, back)
        pos = np.arange(n) if among is None else asked(code) if len(among) else np.zeros(0, np.int64)
        if len(pos):
            bad = np.concatenate([[0], np.cumsum(codes == 4)])
            pos = pos[bad[pos + k] == bad[pos]]
        h = np.zeros(len(pos))
        for b in range(4 if len(pos) else 0):
            run = np.concatenate([[0], np.cumsum(codes == b)])
            p = (run[pos + k] - run[pos]) / k
            h -= np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0)
        return pos, code[pos], h < 1.5

    kind = "name string, tag string, len long, pos long, code long, low boolean, times long, first boolean" if positions else "name string, code long, n long, low boolean"
    columns = [c.split()[0] for c in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            for who, text, wrap, mark in zip(*(c.to_pylist() for c in b.columns), strict=True):
                pos, code, low = words(text or "", bool(wrap))
                distinct, first, which, n = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
                if positions:
                    leads = np.zeros(len(code), bool)
                    leads[first] = True
                    out = (pos.astype(np.int64), code, low, n[which].astype(np.int64), leads)
                    told = (pa.scalar(who, pa.string()), pa.scalar(mark, pa.string()), pa.scalar(len(text or ""), pa.int64()))
                else:
                    out = (distinct, n.astype(np.int64), low[first])
                    told = (pa.scalar(who, pa.string()),)
                code = out[1] if positions else out[0]
                if len(code):
                    held.append((*(pa.repeat(t, len(code)) for t in told), *map(pa.array, out)))
                    rows += len(code)
                if rows >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], columns)
                    held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], columns)

    seqs = seqs.select(F.col(name).alias("name"), F.col(seq).alias("seq"), (F.col(circular) if circular else F.lit(False)).alias("wrap"), (F.col(tag) if tag else F.lit(None)).cast("string").alias("tag"))
    return seqs.mapInArrow(run, kind)


def kmer_word(code: Column, k: int) -> Column:
    """The word of a packed code."""
    return F.concat(*[F.substring(F.lit(BASES), (F.shiftright(code, 2 * (k - 1 - i)).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)) for i in range(k)])
