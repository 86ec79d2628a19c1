"""Operators over documents against brute force, with nulls, repeats, long and empty texts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from seqlens.llm import bpe, mixing, near_dups, sharding, spotsigs, token_store, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, mix string, shard string"


def _hard():
    rng = random.Random(1)
    words = ["alpha", "the", "beta", "of", "gamma", "and", "delta", "is", "omega", "zeta", "eta", "theta"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    base = text(60)
    near = base.split(" ")
    rows = [(None, None), (None, "hello there"), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE  two"), (5, base), (6, base), (6, base), (7, " ".join(near[:-2] + ["x", "y"])), (8, "a" * 9000), (9, text(4000)), (10, "É ß 日本 " * 300), (11, "ONE two three four five"), (None, base)]
    rows += [(20 + i, " ".join(near[:i] + [f"z{i}"] + near[i + 1 :])) for i in range(0, 60, 7)]
    rows += [(100 + i, text(30)) for i in range(25)]
    return [(d, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None, 7, "clash", "x") for i, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(_hard(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(t):
    return (t or "").encode().split()


def test_mix_targets_and_takes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "source", "text").join(mixing.mix_sources(docs, lean=True), "doc_id").collect()
    assert len(rows) == docs.count()
    size, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in rows:
        assert r.mix.size == len(_words(r.text)) and r.mix.taken <= 2 * r.mix.size
        size[r.source] += r.mix.size
        taken[r.source] += r.mix.taken
        target[r.source] = r.mix.target
        largest[r.source] = max(largest[r.source], r.mix.size)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, left, open_ = {}, 1.5 * sum(size.values()), set(names)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share > 2 * size[s]}
        if not over:
            want |= {s: weight[s] * share for s in open_}
            break
        want |= {s: 2.0 * size[s] for s in over}
        left -= sum(2.0 * size[s] for s in over)
        open_ -= over
    for s in names:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= max(1, largest[s])


def test_mix_is_nested_and_repeatable(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    run = lambda share: {r.doc_id: r.mix.repeats for r in mixing.mix_sources(docs, lean=True, share=share, weights=(1,)).collect()}
    small, again, large = run(0.3), run(0.3), run(0.6)
    assert small == again and all(small[d] <= large[d] for d in small)


def test_mix_hard_rows(hard, none):
    got = mixing.mix_sources(hard)
    assert got.columns[:-1] == [c for c in hard.columns if c != "mix"] and got.count() == hard.count()
    assert all(r.mix.size == len(_words(r.text)) for r in got.collect())
    assert mixing.mix_sources(none).count() == 0


@pytest.mark.parametrize("lean", [True, False])
def test_repeated_rows_are_taken_one_by_one(spark, lean):
    """Sources of equal rows, under a null or one id, land within one row of their targets, and in every run alike."""
    words = lambda n: "word " * n
    rows = [(None, words(40), "a")] * 200 + [(7, words(10), "b")] * 300 + [(8, words(10), "b")] * 50 + [(i, words(20), "c") for i in range(100)] + [(9, None, "c")] * 5 + [(9, "", None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_sources(docs.repartition(4), lean=lean).collect()
    again = mixing.mix_sources(docs.repartition(7, "source"), lean=lean).collect()
    told = lambda got: Counter((r.doc_id, r.mix.size, r.mix.source_size, r.mix.repeats, r.mix.taken) for r in got)
    assert len(mixed) == len(rows) and told(mixed) == told(again)
    taken, target, most = Counter(), {}, Counter()
    for r in mixed:
        key = r.mix.source_size
        taken[key] += r.mix.taken
        target[key], most[key] = r.mix.target, max(most[key], r.mix.size)
    assert set(target) == {8000, 3500, 2000, 0}
    assert all(abs(taken[k] - target[k]) <= most[k] for k in target)


def _components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = [x.lower() for x in _words(t)]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids) if ids else None) for i in members]
    return Counter(out)


@pytest.mark.parametrize("hot", [48, 2])
def test_near_duplicates_equal_brute_force(spark, hard, hot, monkeypatch):
    monkeypatch.setattr(near_dups, "HOT", hot)
    monkeypatch.setattr(near_dups, "BLOCK", 5)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text").unionByName(hard.select("doc_id", "text"))
    rows = [tuple(r) for r in docs.collect()]
    got = near_dups.near_duplicates(docs, 4, 80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == _components(rows, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id or r.component_id is None) for r in got)


def test_estimate_is_close(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 500, dtype=np.uint64)
    b = np.concatenate([a[:450], rng.integers(0, 2**63, 50, dtype=np.uint64)])
    sig = near_dups.signatures(near_dups.minima([a, b])).view(np.int64)
    df = spark.createDataFrame([(sig[0].tolist(), sig[1].tolist())], "a array<long>, b array<long>")
    assert abs(df.select(near_dups.estimate(F.col("a"), F.col("b")).alias("e")).first().e - 450 / 550) < 0.15


@pytest.mark.parametrize("ids", [None, 7])
def test_near_duplicates_of_rows_that_share_an_id(spark, ids):
    rng = random.Random(3)
    rows = []
    for i in range(1000):
        words = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        rows += [(ids, " ".join(words)), (ids, " ".join([*words[:-1], f"other{i}"]))]
    rows += [(ids, "same words here again")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dups.near_duplicates(docs, 4, 80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter([(ids, 37, ids)] * 2000 + [(ids, 1, ids)] * 50)
    assert near_dups.drop_near_duplicates(docs, 4, 80).count() == 1001


def test_drop_near_duplicates_keeps_one(spark, hard, none):
    got = near_dups.drop_near_duplicates(hard.withColumns({"k1": F.lit(1), "comp": F.lit("c")}), 5, 80)
    ids = Counter(r.doc_id for r in got.collect())
    assert got.columns == [*hard.columns, "k1", "comp"] and ids[6] == 0 and ids[5] == 1 and ids[3] + ids[4] == 1
    # of the rows without id, the copy of 5 goes; the empty one and the one of its own stay
    assert sorted(r.text or "" for r in got.where("doc_id IS NULL").collect()) == ["", "hello there"]
    assert near_dups.drop_near_duplicates(none, 5, 80).count() == 0


def test_chain_equals_plain_forward_backward():
    rng = np.random.default_rng(1)
    e, first, psi = rng.normal(size=57), np.zeros(57, bool), np.array([[1.0, 0.3], [0.2, 2.0]])
    first[[0, 5, 6, 40]] = True
    forward, backward = toxicity.chain(e, first, psi)
    odds = forward * backward
    starts = [*np.flatnonzero(first), 57]
    for lo, hi in zip(starts, starts[1:], strict=False):
        total = np.zeros((hi - lo, 2))
        n = hi - lo
        alpha, beta = np.zeros((n, 2)), np.ones((n, 2))
        emit = np.stack([np.ones(n), np.exp(e[lo:hi])], axis=1)
        alpha[0] = emit[0]
        for t in range(1, n):
            alpha[t] = (alpha[t - 1] @ psi) * emit[t]
        for t in range(n - 2, -1, -1):
            beta[t] = psi @ (emit[t + 1] * beta[t + 1])
        total = alpha * beta
        assert np.allclose(total[:, 1] / total[:, 0], odds[lo:hi])


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    tagger = toxicity.train(docs, labels)
    rows = toxicity.score_documents(docs.join(labels.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out(F.col("doc_id"))), tagger).select("toxic", "toxicity.score").collect()
    hit = [r for r in rows if (r.score >= 0.5) == bool(r.toxic)]
    assert len(hit) / len(rows) >= 0.97
    assert sum(1 for r in rows if r.toxic and r.score >= 0.5) >= 0.85 * sum(r.toxic for r in rows)


def test_toxic_spans_and_hard_rows(spark, hard, none):
    rng = random.Random(9)
    plain = lambda: " ".join(rng.choice("abcdefgh") + rng.choice(["ab", "ol", "um", "ix"]) + str(rng.randrange(9)) for _ in range(12))
    clean = [f"{plain()} goodly {plain()}" for _ in range(60)]
    toxic = [f"{plain()} nasty{'abcdefghij'[i % 10]} {plain()}" for i in range(60)]
    tagger = toxicity.fit_tagger(toxic, clean, 60, 60)
    text = "Well, NASTYzz people and goodly words"
    df = spark.createDataFrame([(text,), (None,), ("",), ("aab1 bol2 goodly",)], "text string")
    got = toxicity.score_documents(df, tagger).collect()
    assert [text[s.start : s.end] for s in got[0].toxicity.spans] == ["NASTYzz"] and got[0].toxicity.score > 0.5
    assert all(r.toxicity.score < 0.5 and not r.toxicity.spans for r in got[1:])
    assert toxicity.score_documents(hard, toxicity.Tagger()).count() == hard.count()
    assert toxicity.score_documents(none, tagger).count() == 0
    empty = toxicity.train(hard, spark.createDataFrame([(None, None)], "doc_id long, toxic int"))
    assert not empty.trained


def _spots(text):
    """Signatures of a text as tuples, by loops."""
    import re

    words = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
    words = [p for w in words for p in ([w[i : i + spotsigs.PIECE] for i in range(0, len(w), spotsigs.PIECE)] if len(w) > spotsigs.LONG else [w])]
    content = [(i, w) for i, w in enumerate(words) if w not in spotsigs.ANCHORS]
    if not content:
        return {(w,) for w in words}
    out, covered = set(), set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS and (after := [(k, c) for k, c in content if k > i][: spotsigs.CHAIN]):
            out.add((w, *(c for _, c in after)))
            if i + 1 == after[0][0]:
                covered |= {k for k, _ in after}
    for r, (k, _) in enumerate(content):
        if k not in covered:
            out.add(("", *(c for _, c in content[r : r + spotsigs.CHAIN])))
    return out


def test_fingerprints_equal_a_loop(spark, none):
    rng = random.Random(6)
    pool = ["the", "of", "und", "la", "con", "fox", "hill", "Stein", "río", "blau", "x1", "42", "tree"]
    texts = ["", None, "the", "the of la", "fox", "the fox", "fox the", "fox hill", " ,; ", "the " * 40 + "fox", "no-one; THE\tHill"] + [" ".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(40)]
    texts += [" ".join(rng.choice(pool[5:]) for _ in range(30)) + " the fox", "fox " * 200, texts[20]]
    # sets of very unlike sizes, and runs without spaces
    many = " ".join(f"w{i}" for i in range(400))
    texts += ["fox", many, many + " fox hill", "x1", "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(420)), "é" * 33, "é" * 32, "a" * 500]
    rows = [(i * 3, t, 1, "clash") for i, t in enumerate(texts)] + [(9, texts[3], 1, "repeated")]
    got = spotsigs.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string, h long, fingerprint string")).collect()
    assert len(got) == len(rows)
    name, sizes = {}, {}

    def jaccard(a, b):
        if not a or not b:
            return float(not a and not b)
        return len(a & b) / len(a | b)

    for r in got:
        at = r.doc_id // 3
        text, after = texts[at] or "", texts[(at + 1) % len(texts)] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        for t, f in ((text, r.fingerprint), (edited, r.edited_fingerprint)):
            want = frozenset(_spots(t))
            assert len(f) == 8 * len(want) and name.setdefault(want, f) == f and sizes.setdefault(f, want) == want
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(jaccard(_spots(text), _spots(edited))) and r.near_next == pytest.approx(jaccard(_spots(text), _spots(after)))
    assert spotsigs.edited_fingerprints(none).count() == 0
    one = spark.createDataFrame([(1, "the quick fox of hills", None)], "doc_id long, text string, size int")
    assert spotsigs.edited_fingerprints(one).first().near_next == 1.0


def test_runs_without_spaces_keep_their_unchanged_part(spark):
    rng = random.Random(7)
    text = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(420))
    rows = spark.createDataFrame([(1, text), (2, "日本" * 5 + text[:400])], "doc_id long, text string")
    near = {r.doc_id: r.near_edited for r in spotsigs.edited_fingerprints(rows).collect()}
    assert 0.5 < near[1] < 0.9 and 0.5 < near[2] < 0.9


def test_fingerprints_hard_rows(hard):
    got = spotsigs.edited_fingerprints(hard).collect()
    assert len(got) == hard.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_spot_links_equal_brute_force(hard):
    docs = hard.where("doc_id IS NOT NULL")
    sets = {}
    for r in docs.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect():
        if r.s:
            key = tuple(r.s)
            sets[key] = min(sets.get(key, r.doc_id), r.doc_id)
    items = list(sets.items())
    want = set()
    for i, (s, a) in enumerate(items):
        for t, b in items[:i]:
            both = len(set(s) & set(t))
            if both * 100 >= 60 * (len(s) + len(t) - both):
                want.add((min(a, b), max(a, b)))
    assert {(r.a, r.b) for r in spotsigs.spot_links(docs, 60).collect()} == want


def _encoding():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("leaf", [4, 37, 2048])
def test_tree_encoding_equals_the_library(leaf):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        codec, plain = bpe.TreeCodec(f.read(), public_tokenizers.PATTERN, leaf), _encoding()
    rng = random.Random(leaf)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", "'s", "don't", "12", "é", "日本", "...", "<|endoftext|>", "\x1c", "　", "🙂", "word", " the"]
    for n in [0, 1, 2, 5, 40, 300, 1500]:
        for _ in range(6):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            ids = codec.encode(text)
            assert ids == plain.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_round_trip_hard_rows(hard, none):
    plain = _encoding()
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(hard, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True).collect())
    want = Counter()
    for r in hard.collect():
        t = r.text or ""
        ids = plain.encode_ordinary(t)
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert got == want
    assert bpe.round_trip(none, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_token_store_round_trip(spark, hard, none, tmp_path):
    from tokenizers import Tokenizer

    name = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(name)
    more = [(200, "hello <|endoftext|> there"), (201, "<|endoftext|>"), (2**62 + 1, "a large id"), (None, "x" * 5000 + " tail"), (202, "don't  say 'tis  5's\xa0 or\u3000 é\u0301 ×2 ²\r\n\n x \n")]
    hard = hard.unionByName(spark.createDataFrame([(d, t, None, None, None, 1, "c", "c") for d, t in more], SCHEMA)).withColumns({c: F.lit(7) for c in ("start", "ids", "kind", "rid")})
    token_store.write_store(hard, str(tmp_path / "s"), name)
    got = token_store.read_store(spark, str(tmp_path / "s"), with_ids=True).orderBy("start").collect()
    streams = Counter((r.doc_id, tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [0])) for r in hard.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == streams
    at = 0
    for r in got:
        assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known) and all(r.doc_id is None for r in got[len(known) :])
    pack = spark.read.parquet(str(tmp_path / "s" / "pack")).collect()
    stored = [d for p in pack for i, d in enumerate(p.digests) if p.part is None or i not in p.part]
    assert len(stored) == len(set(map(bytes, stored))) < sum(len(p.digests) for p in pack)
    files = [[r.start for r in spark.read.parquet(str(f)).select("start").collect()] for f in sorted((tmp_path / "s" / "pack").glob("*.parquet"))]
    assert sum(files, []) == sorted(sum(files, []))
    token_store.write_store(none, str(tmp_path / "e"), name)
    assert token_store.read_store(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("part", [50, 1 << 21])
def test_runs_equal_the_library(part, monkeypatch):
    from tokenizers import Tokenizer

    from seqlens.llm import run_encoder

    monkeypatch.setattr(run_encoder, "PART", part)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    plain, encoder = Tokenizer.from_str(definition), run_encoder.RunEncoder(definition, 0, most=200)
    rng = random.Random(part)
    signs = ["a", "B", " ", "  ", "\n", "\t", "'s", "'", "don't", "'ll", "12", "é", "×", "日本", "。", "...", "<|endoftext|>", "\x1c", "\x85", "\xa0", "　", "“", "…", "🙂", "word", " the", "½", "²", "\u0301", "Привет", "\u200b", "\0", "\r\n", ",'s", "longlonglonglongword", "क्ष"]
    for _ in range(400):
        texts = ["".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 5, 300]))) for _ in range(rng.choice([1, 4]))]
        flat, starts = encoder.encode([t.encode() for t in texts])
        assert [flat[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [plain.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_token_store_notices_damage(spark, hard, tmp_path):
    name = public_tokenizers.path("byte_bpe_50k.json")
    token_store.write_store(hard.where("doc_id in (5, 9)"), str(tmp_path / "s"), name)
    pack, said = spark.read.parquet(str(tmp_path / "s" / "pack")), spark.read.parquet(str(tmp_path / "s" / "manifest"))
    digests = pack.where("doc_id = 9").first().digests
    wrong = F.when(F.col("doc_id") == 9, F.array(*[F.lit(bytes(d)) for d in reversed(digests)])).otherwise(F.col("digests"))
    pack.withColumn("digests", wrong).write.parquet(str(tmp_path / "t" / "pack"))
    said.write.parquet(str(tmp_path / "t" / "manifest"))
    with pytest.raises(Exception, match="digest"):
        token_store.read_store(spark, str(tmp_path / "t")).collect()
    pack.where("doc_id = 9").write.parquet(str(tmp_path / "u" / "pack"))
    said.write.parquet(str(tmp_path / "u" / "manifest"))
    with pytest.raises(ValueError, match="manifest"):
        token_store.read_store(spark, str(tmp_path / "u"))


def test_cut_points_follow_content():
    rng = np.random.default_rng(4)
    tail = rng.integers(0, 50000, 6000)
    cuts = []
    for n in (100, 777):
        ids = np.concatenate([rng.integers(0, 50000, n), tail])
        ends = token_store.cut_points(ids, np.array([0, len(ids)]))[0]
        assert ends[-1] == len(ids) and all(b - a <= token_store.LONGEST for a, b in zip([0, *ends], ends, strict=False))
        cuts.append({e - n for e in ends})
    assert len(cuts[0] & cuts[1]) > 0.8 * min(map(len, cuts))


def test_shards(spark, hard, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").unionByName(hard.select("doc_id", "text", "lang", "source", "n_chars"))
    rows = sharding.shard_rows(docs.withColumns({"digest": F.lit(1), "shard": F.lit("clash")})).collect()
    assert len(rows) == docs.count() and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    size, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[r.size, r.text_crc32].add(r.shard)
    assert set(size) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    mean = sum(size.values()) / 24
    assert max(abs(v - mean) for v in size.values()) <= 0.02 * mean + max(r.size for r in rows if r.size <= 0.005 * mean)
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert sharding.shard_rows(none).count() == 0


@pytest.mark.parametrize("shards", [1, 2])
def test_few_shards(hard, shards):
    rows = sharding.shard_rows(hard, shards=shards).collect()
    assert len(rows) == hard.count() and {r.shard for r in rows} == set(range(shards))
    for s in range(shards):
        held = [r.slot for r in rows if r.shard == s]
        assert sorted(held) == list(range(len(held)))


def test_tree_equals_a_sort(spark):
    """Each node is cut along its widest dimension where a sort by (value, tie) reaches the left shards' weight."""
    rng = random.Random(2)
    points = [(str(i), rng.randrange(1, 50), rng.choice([0.1, 0.4]), rng.random() * 0.8, 0.5, rng.choice([0.0, 0.9]), rng.random()) for i in range(400)]
    room = [5.0, 1.0, 3.0, 3.0, 2.0]
    df = spark.createDataFrame(points, "digest string, bytes long, d0 double, d1 double, d2 double, d3 double, tie double")
    grown, number = sharding.grow_tree(df, room)
    got = {r.digest: number[r.node] for r in grown.collect()}

    def split(rows, lo, hi):
        if hi - lo == 1:
            return {p[0]: lo for p in rows}
        mid = (lo + hi) // 2
        d = max(range(2, 6), key=lambda k: max(p[k] for p in rows) - min(p[k] for p in rows))
        need, run, left = sum(p[1] for p in rows) * sum(room[lo:mid]) / sum(room[lo:hi]), 0, []
        rows = sorted(rows, key=lambda p: (p[d], p[6]))
        while run + rows[len(left)][1] < need:
            run += rows[len(left)][1]
            left.append(rows[len(left)])
        return split(left, lo, mid) | split(rows[len(left) :], mid, hi)

    assert got == split(points, 0, len(room))


def test_hot_group_is_spread(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "copy " * 20).when(F.col("id") < 2050, "small group " * 9).otherwise(F.concat(F.lit("own text "), F.col("id"))).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    size, homes = Counter(), defaultdict(set)
    for r in sharding.shard_rows(docs).collect():
        size[r.shard] += r.size
        homes[r.text_crc32].add(r.shard)
    mean = sum(size.values()) / 24
    assert max(size.values()) < 1.1 * mean and min(size.values()) > 0.9 * mean
    assert homes[zlib.crc32(b"small group " * 9)] and len(homes[zlib.crc32(b"small group " * 9)]) == 1 and len(homes[zlib.crc32(b"copy " * 20)]) > 6


def test_tasks_unpack_texts_in_small_slices(frame):
    """Texts reach Python as Arrow batches, of which a task unpacks a slice at a time; tables of known words stay small."""
    import public_tokenizers

    from seqlens.llm import bpe, near_dups, toxicity

    docs = frame([(1, "a b c")], "doc_id long, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan(bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    assert max(bpe.SLICE, toxicity.SLICE) <= 256 and max(toxicity.REMEMBERED, near_dups.Shingler(5).most) <= 100_000
    rows = [(i, f"w{i} x") for i in range(3 * toxicity.SLICE + 1)]
    scored = toxicity.score_documents(frame(rows, "doc_id long, text string").coalesce(1), toxicity.Tagger()).collect()
    assert [(r.doc_id, r.text) for r in sorted(scored)] == rows and all(r.toxicity.score == 0 and r.toxicity.spans == [] for r in scored)
