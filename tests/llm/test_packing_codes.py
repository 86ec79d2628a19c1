"""Packing and vector codes against brute force, with nulls, repeats, ties, long and empty rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from seqlens.llm import packing, run_encoder, vector_codes  # noqa: E402

DOCS = "doc_id long, text string, lang string, length int, piece string, g string"
VECS = "vec_id long, embedding array<double>, label string, q string, code string"


def _texts():
    rng = random.Random(5)
    words = ["Alpha", "the", "Straße", "İstanbul", "don't", "日本", "x1y2", "--", "ΣΟΦΟΣ", "áb", " ", "<|endoftext|>", "42"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(None, None), (None, "hello"), (1, ""), (2, " \n\t"), (3, text(9000)), (4, "a" * 30_000), (5, text(40)), (5, text(40)), (6, "same"), (6, "same")]
    return rows + [(10 + i, text(rng.randrange(300, 900))) for i in range(60)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_packing_of_hard_rows(spark, library):
    rows = _texts()
    docs = spark.createDataFrame([(d, t, None, 3, "clash", "x") for d, t in rows], DOCS)
    pieces, plan = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), size=256)
    got = plan.collect()
    want = defaultdict(list)
    for d, t in rows:
        want[d].append([*library.encode(t or "", add_special_tokens=False).ids, 0])
    # every document's pieces, as (start, length, crc), with multiplicity
    cut = lambda ids: [(s, len(ids[s : s + 256]), zlib.crc32(np.array(ids[s : s + 256], "<u4"))) for s in range(0, len(ids), 256)]
    expected = sorted(((d is not None, d or 0), p) for d, all_ids in want.items() for ids in all_ids for p in cut(ids))
    assert sorted(((r.doc_id is not None, r.doc_id or 0), (r.start, r.length, r.ids_crc32)) for r in got) == expected
    assert all(r.start == 256 * r.piece for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.place, r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert [p for p, _, _ in held] == list(range(len(held)))
        assert [o for _, o, _ in held] == [sum(x[2] for x in held[:i]) for i in range(len(held))]
        assert sum(n for _, _, n in held) <= 256
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 256) + 2
    whole = {r.sequence_id: r for r in packing.packed_sequences(pieces, plan).collect()}
    assert set(whole) == set(bins) and sum(r.length for r in whole.values()) == total
    crc = {(r.sequence_id, r.offset): (r.length, r.ids_crc32) for r in got}
    for s, r in whole.items():
        assert len(r.ids) == r.length
        for at in r.starts:
            n, c = crc[s, at]
            assert zlib.crc32(np.array(r.ids[at : at + n], "<u4")) == c


def test_packing_of_nothing(spark):
    _, plan = packing.pack_documents(spark.createDataFrame([], DOCS), public_tokenizers.path("word_bpe_49k.json"))
    assert plan.count() == 0


def test_groups_share_their_underfull_bins(spark):
    rng = random.Random(9)
    lengths = [rng.randint(20, 45) for _ in range(1500)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "rid long, length long")
    got = packing.pack_pieces(pieces, size=100, group=150).collect()
    assert sorted(r.rid for r in got) == list(range(1500))
    fills = defaultdict(int)
    for r in got:
        fills[r.sequence_id] += r.length
    alone = sum(len(packing.best_fit([x for i, x in enumerate(lengths) if i % 10 == g], 100)) for g in range(10))
    assert max(fills.values()) <= 100 and -(-sum(lengths) // 100) <= len(fills) < alone


def test_search_beats_best_fit_and_never_loses():
    better = 0
    for seed in range(60):
        rng = random.Random(seed)
        lengths = [rng.randint(15, 60) for _ in range(rng.randint(1, 60))]
        first = packing.best_fit(lengths, 100)
        found = packing.local_search([list(b) for b in first], lengths, 100)
        assert sorted(i for b in found for i in b) == list(range(len(lengths)))
        assert all(0 < sum(lengths[i] for i in b) <= 100 for b in found)
        assert packing.least_bins(np.array(lengths), 100) <= len(found) <= len(first)
        better += len(found) < len(first)
    assert better >= 5


def test_least_bins_never_passes_the_optimum():
    def optimum(lengths, size):
        best = len(lengths)

        def put(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(lengths):
                best = len(rooms)
                return
            for k in range(len(rooms)):
                if rooms[k] >= lengths[i]:
                    put(i + 1, rooms[:k] + [rooms[k] - lengths[i]] + rooms[k + 1 :])
            put(i + 1, [*rooms, size - lengths[i]])

        put(0, [])
        return best

    for seed in range(80):
        rng = random.Random(seed)
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 8))]
        low, true = packing.least_bins(np.array(lengths), 20), optimum(lengths, 20)
        assert -(-sum(lengths) // 20) <= low <= true <= len(packing.pack_lengths(lengths, 20))


def test_words_are_encoded_as_by_the_library(library):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = run_encoder.RunEncoder(f.read(), 0)
    assert encoder.words
    rng = random.Random(3)
    signs = [*"aBéİIßΣς'-!1½Ⅷ<ㄱ각가ÅÅ_``़ͅकোẞǰΩ \u0085\x1c ̸́", "'s", "'T", "--", " ", "  ", "\n", "\t", "<|endoftext|>", "😀", "the", "Hello"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    flat, at = encoder.encode([t.encode() for t in texts])
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert flat[at[i] : at[i + 1]].tolist() == [*e.ids, 0], texts[i]


@pytest.mark.parametrize("exact", [True, False])
def test_tree_keeps_the_lowest_of_equally_near_entries(exact):
    rng = np.random.default_rng(4)
    entries = rng.integers(-4, 5, (256, 3))  # many equal entries and equal distances
    queries = rng.integers(-6, 7, (3000, 3))
    index, best = vector_codes.CodeTree(entries, exact).nearest(queries)
    d = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def _codes(rows, entries=256, parts=4, rounds=4):
    """A loop over rows (vec_id, vector, label) in Python integers."""
    kept = [(i, [int(np.floor(1024 * x)) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts)) * parts
    kept = [(i, v + [0] * (width - len(v)), y) for i, v, y in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    step = width // parts
    cut = lambda v, p: v[p * step : (p + 1) * step]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for _, v, _ in kept:
                held[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(held[k]) for c in zip(*held[k])] if k in held else e for k, e in enumerate(books[p])]
    out, per = [], defaultdict(int)
    for i, v, y in kept:
        best = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), y))
        per[y] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i is None, i or 0), c, e, per[y], digest) for i, c, e, y in out)


def test_codes_of_hard_rows(spark):
    rng = random.Random(2)
    vec = lambda n: [rng.choice([-0.25, 0.1, rng.uniform(-1, 1)]) for _ in range(n)]
    same = vec(8)
    rows = [(None, vec(8), None), (None, None, "a"), (1, [], "a"), (2, [1.0, None], "a"), (3, [float("nan")] * 8, "b"), (4, [float("-inf")] * 8, "b"), (5, vec(3), ""), (6, same, "a"), (6, same, "a"), (7, [-0.0] * 8, None), (8, [60.0] * 8, "b")]
    rows += [(100 + rng.randrange(400), vec(8), rng.choice(["a", "b", None])) for _ in range(400)]
    frame = spark.createDataFrame([(*r, "clash", "x") for r in rows], VECS)
    got = vector_codes.vector_codes(frame.repartition(3)).collect()
    assert sorted(((r.vec_id is None, r.vec_id or 0), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == _codes(rows)


def test_codes_of_few_large_and_no_vectors(spark):
    rows = [(1, [70_000.0, -70_000.0, 0.5, 1.0], "a"), (2, [69_999.0, -70_000.0, 0.25, 1.0], None)]
    frame = spark.createDataFrame([(*r, "", "") for r in rows], VECS)
    got = vector_codes.vector_codes(frame).collect()
    assert sorted(((False, r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == _codes(rows)
    assert vector_codes.vector_codes(spark.createDataFrame([], VECS)).count() == 0
    with pytest.raises(ValueError, match="too large"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1e30], "a", "", "")], VECS))


def test_decoded_vectors_are_within_their_error(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist(), "a", "", "") for i in range(300)]
    points = vector_codes.integer_vectors(spark.createDataFrame(rows, VECS))
    books = vector_codes.fit_codebooks(points, entries=16)
    codes = vector_codes.encode_vectors(points, books)
    back = {r.vec_id: r for r in vector_codes.decode_vectors(codes, books.rows(spark)).collect()}
    for i, v, *_ in rows:
        gap = np.floor(np.array(v) * 1024) - np.array(back[i].vector) * 1024
        assert int((gap * gap).sum()) == back[i].error
