"""Token ids of many texts by the tokenizers library, each distinct run of a text encoded once.

A byte-level tokenizer first cuts a text by its pattern and then merges bytes within each cut
piece, so what it makes of a run whose two ends are always ends of pieces does not depend on
what stands around the run. Such ends follow from the classes of neighbouring characters:
letters, digits and other signs never share a piece (an apostrophe may bind what follows it),
no piece goes on from a sign into white space, and the last white space character before a
sign always begins a piece. Characters whose class differs between editions of Unicode, rare
white space and control characters bind everything: a run just grows longer there.

A tokenizer of words that drops white space (WORDS) cuts at the same ends: its normalizer composes
across none of them, since marks bind too, and letters whose lower case or composed form is
not a letter are made to bind. There every new run goes to the whole tokenizer.

A whole batch is cut, hashed and looked up as arrays. Runs of at most 16 bytes are keys by
value, so a lookup is exact; a run that is new goes to the library: to its merge model when it
is one piece for certain, else to the whole tokenizer. Two generations bound the memory: a full
table becomes the old one, and what is met again is taken over from there.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

X, L, N, P, A, S, W, E = range(8)
#: Bytes that no text holds: the end of a text, and of a part of a long one.
END, BREAK = b"\xff", b"\xfe"
#: Bytes encoded at once, runs a generation holds, and the longest run that is remembered.
PART, MOST, LONG = 1 << 20, 1 << 19, 256
_SURE = re.compile(rb" [A-Za-z0-9]")
#: Fixed value: how a tokenizer of words splits a normalized text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _plane() -> np.ndarray:
    """Classes of the code points below 2**16: letters, digits and signs that have always been so."""
    old, out = unicodedata.ucd_3_2_0.category, np.full(1 << 16, X, dtype=np.uint8)
    kinds = {"L": L, "N": N, "P": P, "S": P}
    for cp in range(1 << 16):
        kind = kinds.get(unicodedata.category(chr(cp))[0])
        if kind is not None and kind == kinds.get(old(chr(cp))[0]):
            out[cp] = kind
    out[0x27], out[0x20] = A, S
    out[9:14] = W
    return out


def _steady(plane: np.ndarray) -> np.ndarray:
    """plane, where characters that the word tokenizers' normalizer takes to another class bind."""
    out, kinds = plane.copy(), {"L": L, "N": N, "P": P, "S": P}
    for cp in np.flatnonzero((plane >= L) & (plane <= P)).tolist():
        c = unicodedata.normalize("NFC", chr(cp))
        if {kinds.get(unicodedata.category(x)[0]) for x in c + c.lower()} != {int(plane[cp])}:
            out[cp] = X
    return out


def _splits_words(kind: dict) -> bool:
    """Whether a tokenizer composes, lowers case, drops white space and then cuts by WORDS."""
    steps = [(n.get("type"), n.get("pattern")) for n in (kind.get("normalizer") or {}).get("normalizers", ())]
    pre = (kind.get("pre_tokenizer") or {}).get("pretokenizers", ())
    if steps != [("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None)] or len(pre) != 2:
        return False
    cut = [pre[0].get(k) for k in ("type", "pattern", "behavior", "invert")]
    return cut == ["Split", {"Regex": WORDS}, "Removed", True] and pre[1].get("type") == "ByteLevel" and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex", True)


def _pair_ends() -> np.ndarray:
    """Whether a piece always ends between a character of one class and one of another."""
    signs, out = (L, N, P, A), np.zeros((8, 8), dtype=bool)
    out[E, :] = out[:, E] = True
    for a in signs:
        for b in signs:
            out[a, b] = a != b and (a, b) not in ((P, A), (A, P), (A, L))
        out[a, [S, W]] = True
        out[W, a] = True
    return out.ravel()


def _mixed(k1: np.ndarray, k2: np.ndarray, n: np.ndarray) -> np.ndarray:
    h = (k1 ^ (k2 << np.uint64(31) | k2 >> np.uint64(33))) * np.uint64(0x9E3779B97F4A7C15) + n * np.uint64(0xC2B2AE3D27D4EB4F) + k2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class RunTable:
    """An open-addressing table from runs of at most 16 bytes to their ids, for whole arrays of runs."""

    def __init__(self, dtype, bits: int):
        self.bits, self.count, self.used = bits, 0, 0
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        self.k1, self.k2, self.n = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64), np.zeros(1024, np.uint8)
        self.off, self.size, self.pool = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(1 << 14, dtype)

    def _at(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _differs(self, found: np.ndarray, k1: np.ndarray, k2: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.k1[found] != k1) | (self.k2[found] != k2) | (self.n[found] != n)

    def find(self, k1: np.ndarray, k2: np.ndarray, n: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The number of each run in the table, -1 for a run that is not there."""
        at = self._at(h)
        out = self.slots[at]
        wrong = np.flatnonzero((out >= 0) & self._differs(out, k1, k2, n))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.slots) - 1)
            got = out[wrong] = self.slots[at[wrong]]
            wrong, got = wrong[got >= 0], got[got >= 0]
            wrong = wrong[self._differs(got, k1[wrong], k2[wrong], n[wrong])]
        return out

    def spare(self, ids: np.ndarray) -> int:
        """Lay ids after the pool's used part, and tell where; the next call may overwrite them."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(len(self.pool) + len(ids), self.pool.dtype)])
        self.pool[self.used : self.used + len(ids)] = ids
        return self.used

    def add(self, k1: np.ndarray, k2: np.ndarray, n: np.ndarray, h: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Enter distinct runs that are not there yet; ids holds all their ids, size how many each has."""
        m, first = len(k1), self.count
        if 2 * (first + m) > len(self.slots):
            raise MemoryError("the table of runs is full")
        while first + m > len(self.k1):
            for name in ("k1", "k2", "n", "off", "size"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        mine = slice(first, first + m)
        self.k1[mine], self.k2[mine], self.n[mine], self.size[mine] = k1, k2, n, size
        self.off[mine] = self.spare(ids) + np.cumsum(size) - size
        self.used += len(ids)
        self.count += m
        at, todo = self._at(h), np.arange(m)
        while len(todo):
            free = todo[self.slots[at[todo]] < 0]
            self.slots[at[free]] = first + free
            todo = todo[self.slots[at[todo]] != first + todo]
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)


def gather(pool: np.ndarray, off: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of pool that begin at off, one after another."""
    before = np.cumsum(size) - size
    return pool[np.repeat(off - before, size) + np.arange(int(size.sum()))]


class RunEncoder:
    """The tokenizers library behind a bounded memory of the runs it has encoded.

    Runs are kept apart only for a byte-level pre-tokenizer with its own pattern, no prefix
    space, no normalizer and a merge model, and for tokenizers of words; any other tokenizer encodes
    whole texts, and so does every tokenizer a text that holds the string of an added token.
    """

    def __init__(self, definition: str, end_id: int = 0, most: int = MOST):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, kind = Tokenizer.from_str(definition), json.loads(definition)
        pre, model = kind.get("pre_tokenizer") or {}, kind.get("model") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        merges = model.get("type") == "BPE" and not model.get("dropout")
        self.words = merges and _splits_words(kind)
        self.by_run = merges and plain and not kind.get("normalizer") or self.words
        self.added = [t["content"].encode() for t in kind.get("added_tokens") or ()]
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.end, self.most, self.bits = end_id, most, max(12, (4 * most - 1).bit_length())
        spelled = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spell = {b: spelled.pre_tokenize_str(chr(b))[0][0] for b in range(128)} if self.by_run else {}
        if self.spell:
            # two-byte characters name the other bytes: their leading and their continuing byte
            for cp in range(128, 0x800):
                lead, rest = chr(cp).encode()
                self.spell[lead], self.spell[rest] = spelled.pre_tokenize_str(chr(cp))[0][0]
        self.plane, self.ends = _steady(_plane()) if self.words else _plane(), _pair_ends()
        self.bytes = np.where(np.arange(256) < 128, self.plane[:256], np.where(np.arange(256) >= 254, E, X)).astype(np.uint8)
        self.young, self.old = self._table(), None
        self.long: tuple[dict[bytes, np.ndarray], dict[bytes, np.ndarray]] = {}, {}

    def _table(self) -> RunTable:
        return RunTable(self.dtype, self.bits)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, data: bytes, starts: np.ndarray, n: np.ndarray, one_piece: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Ids of runs of data and how many each has: single pieces by the merge model, others by the whole tokenizer."""
        at = list(zip(starts.tolist(), (starts + n).tolist(), strict=True))
        rest = iter(self._library([data[a:b].decode("utf-8", "replace") for (a, b), one in zip(at, one_piece.tolist(), strict=True) if not one]))
        spelled, lo = b"".join([data[a:b] for a, b in at]).decode("latin-1").translate(self.spell), 0
        merge, ids, ends = self.tokenizer.model.tokenize, [], []
        for (a, b), one in zip(at, one_piece.tolist(), strict=True):
            if one:
                ids += [t.id for t in merge(spelled[lo : lo + b - a])]
            else:
                ids += next(rest).tolist()
            lo += b - a
            ends.append(len(ids))
        return ids, np.diff(ends, prepend=0)

    def classes(self, data: np.ndarray) -> np.ndarray:
        """The class of each byte, that of the character it belongs to."""
        out = self.bytes[data]
        two = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
        if len(two):
            out[two] = out[two + 1] = self.plane[(data[two].astype(np.int32) & 31) << 6 | data[two + 1] & 63]
        three = np.flatnonzero((data >= 0xE0) & (data < 0xF0))
        if len(three):
            out[three] = out[three + 1] = out[three + 2] = self.plane[(data[three].astype(np.int32) & 15) << 12 | (data[three + 1].astype(np.int32) & 63) << 6 | data[three + 2] & 63]
        return out

    def run_starts(self, cls: np.ndarray) -> np.ndarray:
        starts = np.empty(len(cls), dtype=bool)
        starts[0] = True
        starts[1:] = self.ends[cls[:-1] << 3 | cls[1:]]
        starts[:-1] |= ((cls[:-1] == S) | (cls[:-1] == W)) & (cls[1:] >= L) & (cls[1:] <= A)
        return np.flatnonzero(starts)

    def _flat(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """All ids of data, parts that end in END or BREAK; and how many ids each part that ends in END has by then."""
        raw = np.frombuffer(data + b"\0" * 16, dtype=np.uint8)
        cls = self.classes(raw)[: len(data)]
        starts = self.run_starts(cls)
        n = np.diff(starts, append=len(data)).astype(np.uint64)
        words = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), shape=(len(raw) - 7,), strides=(1,))
        mask = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1] * 9, dtype=np.uint64)
        short = np.minimum(n, 16).astype(np.int64)
        k1 = words[starts] & mask[np.minimum(short, 8)]
        k2 = words[np.minimum(starts + 8, len(words) - 1)] & mask[np.maximum(short - 8, 0)]
        h = _mixed(k1, k2, n)
        if self.young.count >= self.most:
            self.young, self.old = self._table(), self.young
        keyed = n <= 16
        found = np.where(keyed, self.young.find(k1, k2, n, h), -1)
        lacking = np.flatnonzero(keyed & (found < 0))
        if len(lacking):
            self._learn(data, cls, starts, k1, k2, n, h, lacking)
            found[lacking] = self.young.find(k1[lacking], k2[lacking], n[lacking], h[lacking])
        off, size = self.young.off[found], self.young.size[found].astype(np.int64)
        far = np.flatnonzero(~keyed)
        if len(far):
            ids = self._remembered(data, cls, starts[far], n[far].astype(np.int64))
            size[far] = [len(i) for i in ids]
            off[far] = self.young.spare(np.concatenate(ids)) + np.cumsum(size[far]) - size[far]
        return gather(self.young.pool, off, size), np.cumsum(size)[raw[starts] == END[0]]

    def _one_piece(self, cls: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        if self.words:
            return np.zeros(len(starts), dtype=bool)
        binding = np.flatnonzero((cls == X) | (cls == A))
        return np.searchsorted(binding, starts) == np.searchsorted(binding, starts + n)

    def _learn(self, data, cls, starts, k1, k2, n, h, lacking: np.ndarray) -> None:
        order = lacking[np.lexsort((n[lacking], k2[lacking], k1[lacking]))]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (k1[order[1:]] != k1[order[:-1]]) | (k2[order[1:]] != k2[order[:-1]]) | (n[order[1:]] != n[order[:-1]])
        new = order[new]
        if self.old is not None:
            back = self.old.find(k1[new], k2[new], n[new], h[new])
            again, back = new[back >= 0], back[back >= 0]
            self.young.add(k1[again], k2[again], n[again], h[again], gather(self.old.pool, self.old.off[back], self.old.size[back].astype(np.int64)), self.old.size[back])
            new = np.setdiff1d(new, again, assume_unique=True)
        if not len(new):
            return
        at, length = starts[new], n[new].astype(np.int64)
        last = np.array([data[i] == END[0] for i in at.tolist()])
        sign = last | np.array([data[i] == BREAK[0] for i in at.tolist()])
        size = last.astype(np.int64)
        ids, size[~sign] = self._model(data, at[~sign], length[~sign], self._one_piece(cls, at[~sign], length[~sign]))
        # at most one of the new runs is the end of a text, and it sorts anywhere among them
        ids = np.array(ids, dtype=self.dtype)
        if last.any():
            ids = np.insert(ids, int(size[: int(np.argmax(last))].sum()), self.end)
        self.young.add(k1[new], k2[new], n[new], h[new], ids, size)

    def _remembered(self, data: bytes, cls: np.ndarray, starts: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        """Ids of runs that are too long for the table."""
        young, old = self.long
        runs = [data[a : a + b] for a, b in zip(starts.tolist(), n.tolist(), strict=True)]
        here = {r: young[r] if r in young else old.get(r) for r in runs}
        place = {r: i for i, r in enumerate(runs) if here[r] is None}
        if place:
            new = np.fromiter(place.values(), dtype=np.int64)
            ids, size = self._model(data, starts[new], n[new], self._one_piece(cls, starts[new], n[new]))
            here.update(zip(place, np.split(np.array(ids, dtype=self.dtype), np.cumsum(size)[:-1]), strict=True))
        young.update((r, i) for r, i in here.items() if len(r) <= LONG)
        if len(young) > self.most // 16:
            self.long = {}, young
        return [here[r] for r in runs]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in UTF-8, the end id after each; and where each begins, with one entry more than texts."""
        whole = [not self.by_run or any(a in t for a in self.added) for t in texts]
        flat, ends, held, size, done = [], [], [], 0, 0

        def flush() -> None:
            nonlocal held, size, done
            if held:
                ids, at = self._flat(b"".join(held))
                ends.append(at + done)
                flat.append(ids)
                held, size, done = [], 0, done + len(ids)

        for text, alone in zip(texts, whole, strict=True):
            if alone:
                flush()
                ids = np.append(self._library([text.decode("utf-8", "replace")])[0], np.array(self.end, self.dtype))
                flat.append(ids)
                done += len(ids)
                ends.append(np.array([done]))
                continue
            at = 0
            while len(text) - at > PART and (cut := _SURE.search(text, at + PART)):
                held += [text[at : cut.start()], BREAK]
                at = cut.start()
                flush()
            held += [text[at:] if at else text, END]
            size += len(text) - at
            if size > PART:
                flush()
        flush()
        return np.concatenate([np.zeros(0, self.dtype), *flat]), np.concatenate([np.zeros(1, np.int64), *ends])
