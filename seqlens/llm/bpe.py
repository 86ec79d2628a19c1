"""Byte-level BPE encoding and decoding by monoid tree reduction.

Method: a text is halved until leaves are short; a leaf is encoded directly, and two
neighbours are joined by re-encoding a window around their border. The window grows until
both its ends lie where the token stream provably can't change: at a single space between
two non-space characters a match of the pattern always ends (no match of it has a space
after its first character and another character before), and what follows depends on the text from there on
only. So tokens left and right of the window are those of the whole text, and joining is
associative. Decoding concatenates byte strings up the same kind of tree.

Defined results: null text encodes as the empty text; the whole text is encoded, special
tokens' strings as ordinary text; repeated rows are encoded alike; a text without any such
border (one very long word, or a script without spaces) is encoded as one window, and each level of
the tree then encodes it again, n log n in all; further columns, whatever their names, are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 2048
#: Texts that a task unpacks at once.
SLICE = 256


class TreeCodec:
    """Encodes and decodes whole texts by the ranks of a vocabulary file."""

    def __init__(self, ranks_file: bytes, pattern: str, leaf: int = LEAF):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        self.base = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf = leaf
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for word, rank in ranks.items():
            self.token[rank] = word

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.base.encode_ordinary(text)
        cut = len(text) // 2
        return self.join(text, cut, self.encode(text[:cut]), self.encode(text[cut:]))

    def join(self, text: str, cut: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens of text from those of text[:cut] and text[cut:]."""
        span = 32
        while True:
            lo, hi = self._before(text, cut, span), self._after(text, cut, span)
            if lo is not None and hi is not None:
                break
            span *= 4
        keep = len(left) - self._tokens(reversed(left), len(text[lo:cut].encode("utf-8", "surrogatepass")))
        skip = self._tokens(right, len(text[cut:hi].encode("utf-8", "surrogatepass")))
        del left[keep:]
        left += self.base.encode_ordinary(text[lo:hi])
        left += right[skip:]
        return left

    def _tokens(self, ids, size: int) -> int:
        """How many of ids spell size bytes; borders of the window always are borders of tokens."""
        n = 0
        for i in ids:
            if size <= 0:
                break
            size -= len(self.token[i])
            n += 1
        if size:
            raise AssertionError("a window ends inside a token")
        return n

    @staticmethod
    def _before(text: str, cut: int, span: int) -> int | None:
        """The last stable border in the span before cut; 0 once the span holds the whole left half."""
        lo, j = max(0, cut - span), cut - 1
        while (j := text.rfind(" ", lo + 1, j)) > 0:
            if not text[j - 1].isspace() and not text[j + 1].isspace():
                return j
        return None if lo else 0

    @staticmethod
    def _after(text: str, cut: int, span: int) -> int | None:
        hi, j = min(len(text), cut + span), cut
        while 0 <= (j := text.find(" ", j + 1, hi - 1)):
            if not text[j - 1].isspace() and not text[j + 1].isspace():
                return j
        return None if hi < len(text) else hi

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.token.__getitem__, ids))
        cut = len(ids) // 2
        return self.decode(ids[:cut]) + self.decode(ids[cut:])


@functools.lru_cache(maxsize=2)
def _codec(ranks_file: bytes, pattern: str) -> TreeCodec:
    return TreeCodec(ranks_file, pattern)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]): each text encoded, and its ids decoded again.

    The vocabulary file is read on the driver and broadcast: its size is that of a
    vocabulary, whatever the data. One narrow pass, no shuffle.
    """
    with open(ranks_path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part, rows = batch.slice(lo, SLICE), []
                for text in part.column("t").to_pylist():
                    ids = codec.encode(text or "")
                    packed = np.array(ids, dtype="<u4")
                    row = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest())
                    rows.append((*row, packed.astype("<i4")) if with_ids else row)
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *made], ["doc_id", *kinds])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema)
