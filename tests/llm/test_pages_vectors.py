"""URL filters, WARC archives, embeddings and the pipeline."""

import hashlib
import io
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from seqlens.llm import queries as Q  # noqa: E402
from seqlens.llm import url_filter, vector_dups, warc  # noqa: E402

PAGE = "page_id long, url string, html string, host string, verdict string, size int"


@pytest.fixture(scope="module")
def pages(spark):
    big = "ß<p>" * 70_000
    rows = [(100, "http://a.NET/x?q#f", "x" * 100), (101, None, "x" * 100), (102, "no scheme", None), (103, "ftp://Www.Example.com/de/1", ""), (104, "u://example.net/en/", big), (105, "u://EXAMPLE.NET/en/7", big), (99, "u://example.net", big), (106, "u://b.org/fr/#x", "y" * 99), (107, "u://b.org/fr?x", "y" * 99), (None, "n", "x" * 100), (100, "http://a.NET/x?q#f", "x" * 100), (108, "s://xexample.com/de/", "z"), (109, "a://b://c/d", "É" * 51)]
    rows += [(200 + i, f"https://shop.example.com/{'de' if i % 3 else 'en'}/{i}", f"page {i}") for i in range(60)]
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], PAGE)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], PAGE)


def _judge(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[n:].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
    best = max(((len(d + p), d + p, k) for k, d, p in url_filter.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)), default=(0, None, None))
    return host, path, best[1], best[2]


def test_url_rules_equal_a_loop(pages, none):
    got = url_filter.url_verdicts(pages).collect()
    urls = [r.url for r in pages.collect()]
    want = Counter(_judge(u)[:3] for u in urls)
    assert Counter((r.host, r.path, r.rule) for r in got) == want
    for r in got:
        assert r.verdict in ("allow", "block")
    kinds = {_judge(u)[2]: _judge(u)[3] for u in urls}
    assert all(r.verdict == kinds[r.rule] for r in got if r.rule)
    assert url_filter.url_verdicts(none).count() == 0


def test_templates_learn_from_labels(spark):
    rows = [(i, f"http://h.x/spam/{i}", "block" if i % 2 else "q") for i in range(60)] + [(100 + i, f"http://h.x/news/{i}", "p") for i in range(60)]
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    rules = [("block", "h.x", f"/spam/{i}") for i in range(1, 60, 2)] + [("allow", "h.x", f"/news/{i}") for i in range(0, 60, 2)]
    got = {(r.template, r.verdict) for r in url_filter.url_verdicts(pages, rules).where("rule IS NULL").collect()}
    assert got == {("/spam/*", "block"), ("/news/*", "allow")}


def _trees(paths):
    """(host, path) -> template, by recursion; paths: (host, path) -> (pages, blocked, labelled)."""
    esc = lambda s: "".join(f"%{ord(c):02X}" if c in "*{}|" else c for c in s)
    out, lowest = {}, url_filter.MIN_PAGES

    def grow(items, name):
        tails = [t for _, t in items]
        if not all(tails):
            out.update((k, name) for k, t in items if not t)
            items = [(k, t) for k, t in items if t]
            return grow(items, name) if items else None
        low, high = min(tails), max(tails)
        k = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
        name += "".join("/" + esc(s) for s in low[:k])
        n, blocked, labelled = (sum(x) for x in zip(*(paths[key] for key, _ in items), strict=True))
        if n < lowest and not 0 < labelled < n and not 0 < blocked < labelled or low == high:
            out.update((key, name + "/*" * (len(t) - k)) for key, t in items)
            return None
        out.update((key, name) for key, t in items if len(t) == k)
        items = [(key, t[k:]) for key, t in items if len(t) > k]
        add = lambda it: [sum(x) for x in zip(*(paths[key] for key, _ in it), strict=True)]
        segments = {s: [(key, t) for key, t in items if t[0] == s] for s in {t[0] for _, t in items}}
        pages, blocked, labelled = add(whole)
        groups, rare = {}, {}

        def side(part, of, pooled):
            off, error = part / of - pooled, (pooled * (1 - pooled) / of) ** 0.5 * url_filter.Z
            return 1 if off > error else -1 if off < -error else 0

        for s, it in segments.items():
            n, b, m = add(it)
            if n < lowest:
                rare[s] = "none" if not m else "block" if b == m else "allow" if not b else "mixed"
                continue
            deep = sum(paths[key][0] * len(t) for key, t in it) / n
            sides = (side(b, m, (blocked + 0.5) / (labelled + 1)), side(m, n, (labelled + 0.5) / (pages + 1))) if m else (2, 2)
            groups.setdefault((*sides, int(deep + 0.5)), []).append(s)
        kinds, smooth = list(rare.values()), url_filter.SMOOTH
        known = len(kinds) - kinds.count("none")
        voice = (kinds.count("block") + kinds.count("mixed") / 2 + smooth / 2) / (known + smooth)
        one = len(set(kinds)) == 1 or name and 2 * known >= len(kinds) and known >= url_filter.MIN_LABELS and not 1 - url_filter.REJECT < voice < url_filter.REJECT
        for s, kind in rare.items():
            groups.setdefault("*" if one or kind == "none" else f"{{*|{kind}}}", []).append(s)
        for g, names in groups.items():
            a, z = esc(min(names)), esc(max(names))
            branch = g if isinstance(g, str) else a if len(names) == 1 else f"{{{a}|{z}}}" if len(names) == 2 else f"{{{a}|{len(names) - 2} more|{z}}}"
            below = [(key, t[1:]) for s in names for key, t in segments[s]]
            out.update((key, f"{name}/{branch}") for key, t in below if not t)
            more.setdefault(f"{name}/{branch}", []).extend((key, t) for key, t in below if t)
        return None

    for host in {h for h, _ in paths}:
        more = {"": [((h, p), [s for s in p.split("/") if s]) for h, p in paths if h == host]}
        empty = [key for key, t in more[""] if not t]
        out.update((key, "") for key in empty)
        more[""] = [(key, t) for key, t in more[""] if t]
        while more:
            name, whole = more.popitem()
            if whole:
                grow(whole, name)
    return out


def test_templates_and_purity_equal_a_loop(spark):
    import random

    rng = random.Random(8)
    urls = [f"http://h{rng.randrange(2)}.x/" + "/".join(rng.choice(["de", "fr", "en", "*", "{a|b}", str(rng.randrange(99)), "deep"]) for _ in range(rng.randrange(7))) for _ in range(900)]
    urls += ["http://h0.x/" + "same/" * 40 + f"{i % 3}" for i in range(30)] + ["http://h1.x/a/b/c"] * 20 + [None, "none"]
    rules = [("block", "h0.x", "/de/"), ("allow", "h0.x", "/fr/d"), ("block", "h1.x", "/en/deep"), ("block", "x", "/deep"), ("allow", "x", "/same/")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.url_verdicts(pages, rules).collect()
    paths, split = {}, {}
    for r in got:
        n, b, m = paths.get((r.host, r.path), (0, 0, 0))
        kind = dict((d + p, k) for k, d, p in rules).get(r.rule)
        paths[r.host, r.path] = (n + 1, b + (kind == "block"), m + (kind is not None))
    want = _trees(paths)
    assert {(r.host, r.path): r.template for r in got} == want
    for key, (n, b, m) in paths.items():
        for name in ((key[0], want[key]), (key[0],), ()):
            x = split.setdefault(name, [0, 0, 0])
            split[name] = [x[0] + n, x[1] + b, x[2] + m]
    smooth = url_filter.SMOOTH
    base = (split[()][1] + 0.5) / (split[()][2] + 1)
    blocked = 0
    for r in got:
        n, b, m = split[r.host, r.template]
        prior = (split[r.host,][1] + base * smooth) / (split[r.host,][2] + smooth)
        purity = (b + prior * smooth) / (m + smooth)
        assert r.purity == pytest.approx(purity)
        if r.rule is None:
            reject = purity >= url_filter.REJECT and m >= url_filter.MIN_LABELS and m >= n * url_filter.COVER
            assert r.verdict == ("block" if reject else "allow")
            blocked += reject
    assert len({r.template.count("/") for r in got}) > 5


def test_sections_without_labels_are_never_blocked_by_labelled_ones(spark, tmp_path):
    """Hosts of example.com have rules for /de/ alone; other sections, rare or common, have no labels."""
    urls = []
    for listed in (1, 2, 6, 7, 8, 9, 12, 20):
        urls += [f"https://h{k}.n{listed}.example.com/de/{i}" for k in range(3) for i in range(listed)]
        urls += [f"https://h0.n{listed}.example.com/{s}/{i}" for s in ("fr", "es") for i in range(7)] + [f"https://h1.n{listed}.example.com/fr/{i}" for i in range(30)] + [f"https://h2.n{listed}.example.com/s{i}/{i}" for i in range(20)]
    spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = Q.op4_url_filter(spark, str(tmp_path)).collect()
    assert {r.verdict for r in got if r.rule is None} == {"allow"} and {r.verdict for r in got if r.rule} == {"block"}


def test_no_learned_block_on_the_given_pages(spark):
    """All labels there are of whole sections, so they say nothing of other ones."""
    got = Q.op4_url_filter(spark, "/root/testdata/sf0.1")
    assert got.where("rule IS NULL AND verdict = 'block'").count() == 0


def test_values_below_a_blocked_branch_are_blocked_with_it(spark):
    """Most values of a branch are listed one by one, and all are blocked: so are its other values, and no other branch."""
    shop = [f"http://x.y/ads/{100 + i}" for i in range(40)] + [f"http://x.y/shop/{100 + i}" for i in range(40)] + [f"http://x.y/{100 + i}" for i in range(40)]
    pages = spark.createDataFrame(list(enumerate(shop)), "page_id long, url string")
    rules = [("block", "x.y", f"/ads/{100 + i}") for i in range(25)] + [("block", "x.y", f"/{100 + i}") for i in range(25)]
    got = url_filter.url_verdicts(pages, rules).where("rule IS NULL").collect()
    assert {(r.template, r.verdict) for r in got} == {("/ads/*", "block"), ("/shop/*", "allow"), ("/*", "allow")}
    few = url_filter.url_verdicts(pages, rules[:15]).where("rule IS NULL").collect()
    assert {r.verdict for r in few} == {"allow"}


def test_warc_round_trip(spark, pages, none, tmp_path):
    warc.write_archive(pages, str(tmp_path / "w"), chunk=1000)
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for p, b in rows:
        if len(b) >= 100 and p is not None:
            first[b] = min(first.get(b, p), p)
    want = Counter()
    for p, b in rows:
        again = b in first and first[b] != p
        want[p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None] += 1
    got = Counter(tuple(r) for r in warc.read_records(spark, str(tmp_path / "w")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert got == want
    chunks = warc.read_chunks(spark, str(tmp_path / "w"), chunk=4096).where("page_id = 99").orderBy("number").collect()
    body = b"".join(c.chunk for c in chunks)
    assert body == ("ß<p>" * 70_000).encode() and max(len(c.chunk) for c in chunks) <= 4096
    assert chunks[3].digest == hashlib.sha256(body[: chunks[3].length]).hexdigest()
    warc.write_archive(none, str(tmp_path / "e"))
    assert warc.read_records(spark, str(tmp_path / "e")).count() == 0


def _plain_records(path):
    """An independent reader: gzip members by the gzip module's format, records by their lengths, HTTP by http.client."""
    import http.client

    class Socket:
        def __init__(self, data):
            self.data = data

        def makefile(self, *_):
            return io.BytesIO(self.data)

    out = []
    for file in sorted((path / "files").glob("*.warc.gz")):
        data, kinds = file.read_bytes(), []
        while data:
            member = zlib.decompressobj(31)
            record, data = member.decompress(data), member.unused_data
            assert member.eof
            head, rest = record.split(b"\r\n\r\n", 1)
            version, *lines = head.decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines)
            assert version == "WARC/1.1" and len(fields) == len(lines) and len(rest) == int(fields["Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
            body = None
            if fields["WARC-Type"] == "response":
                answer = http.client.HTTPResponse(Socket(rest[:-4]))
                answer.begin()
                assert answer.status == 200 and answer.getheader("Content-Type") == "text/html; charset=UTF-8"
                body = answer.read()
                assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(body).hexdigest()
            kinds.append(fields["WARC-Type"])
            out.append((fields, body))
        assert kinds[0] == "warcinfo" and "warcinfo" not in kinds[1:]
    return out


def test_warc_files_by_an_independent_parser(spark, pages, tmp_path):
    warc.write_archive(pages, str(tmp_path / "w"), chunk=777)
    records = _plain_records(tmp_path / "w")
    names = [f["WARC-Record-ID"] for f, _ in records]
    assert len(set(names)) == len(names)
    told = [(f, b) for f, b in records if f["WARC-Type"] != "warcinfo"]
    html = Counter((r.page_id, (r.html or "").encode(), " ".join((r.url or "").split())) for r in pages.collect())
    body = {int(f["X-Page-Id"]): b for f, b in told if f["WARC-Type"] == "response" and f["X-Page-Id"] != "null"}
    seen = Counter()
    for f, b in told:
        if f["WARC-Type"] == "revisit":
            b = body[int(f["X-Refers-To-Page-Id"])]
            assert f["WARC-Refers-To-Target-URI"] in {r.url or "" for r in pages.where(f"page_id = {f['X-Refers-To-Page-Id']}").collect()}
        seen[None if f["X-Page-Id"] == "null" else int(f["X-Page-Id"]), b, f["WARC-Target-URI"]] += 1
    assert seen == html


def test_warc_shuffles_chunks_alone(spark, pages):
    rows = warc._dealt(pages, warc.plan_records(pages), 4096, ("html", "page_id", "url"))
    assert "body" not in rows.columns and rows.agg(F.max(F.octet_length("chunk"))).first()[0] <= 4096
    # ids beyond the integers that a double holds survive
    assert warc.plan_records(spark.createDataFrame([(2**60 + 1, None, "x" * 100), (2**60, "u", "x" * 100)], "page_id long, url string, html string")).first().refers_to == 2**60


@pytest.mark.parametrize("chunk", [1, 7, 64, 5000])
def test_warc_parser_at_any_chunk(chunk):
    payloads = [b"", b"\r\n\r\n", b"WARC/1.1\r\n\r\n" * 9, bytes(range(256)) * 20]
    data = b"".join(zlib.compress(f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {len(p)}\r\n\r\n".encode() + p + b"\r\n\r\n", wbits=31) for p in payloads)
    got, now = [], b""
    for _, _, piece, length, digest, last in warc.parse_archive(io.BytesIO(data), chunk):
        now += piece
        assert length == len(now) and len(piece) <= chunk
        if last:
            assert digest == hashlib.sha256(now).hexdigest()
            got.append(now)
            now = b""
    assert got == payloads


def test_truncated_archive_is_an_error():
    data = zlib.compress(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc", wbits=31)
    with pytest.raises(ValueError):
        list(warc.parse_archive(io.BytesIO(data)))


def _links(ids, vectors, t):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    n = len(ids)
    link = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                link[i][j] = link[j][i] = float(a @ b) / (float(np.sqrt(a @ a)) * float(np.sqrt(b @ b))) >= t
    comp = list(range(n))
    for _ in range(n):
        low = [min([comp[i], *(comp[j] for j in range(n) if link[i][j])]) for i in range(n)]
        if low == comp:
            break
        comp = low
    name = {}
    for i in range(n):
        if ids[i] is not None:
            name[comp[i]] = min(name.get(comp[i], ids[i]), ids[i])
    return Counter((ids[i], sum(link[i]), name.get(comp[i], ids[i])) for i in range(n))


@pytest.mark.parametrize("tile", [5, 512])
def test_block_links_equal_brute_force(tile, monkeypatch):
    monkeypatch.setattr(vector_dups, "TILE", tile)
    rng = np.random.default_rng(tile)
    centre = rng.normal(size=(4, 10))
    v = np.stack([centre[i % 4] + rng.normal(size=10) * 0.2 * (i % 3) for i in range(60)])
    axes, copies, eps = np.linalg.qr(rng.normal(size=(10, 10)))[0], rng.integers(1, 4, 60), np.sqrt(0.2)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    pos = rng.permutation(60) * 3
    make = lambda s: vector_dups.Tiles(v[s], pos[s], copies[s], axes)
    one = vector_dups.block_links(make(slice(0, 60)), None, eps, 0.9)
    assert dict(zip(one[0], one[1], strict=True)) == {p: n for p, n in zip(pos, link @ copies, strict=True) if n}
    two = vector_dups.block_links(make(slice(0, 25)), make(slice(25, 60)), eps, 0.9)
    cross = link.copy()
    cross[:25, :25] = cross[25:, 25:] = False
    assert dict(zip(two[0], two[1], strict=True)) == {p: n for p, n in zip(pos, cross @ copies, strict=True) if n}
    for got, mask in ((one, link), (two, cross)):
        reach = np.linalg.matrix_power(mask.astype(float) + np.eye(60), 60) > 0
        assert dict(zip(got[0], got[2], strict=True)) == {p: pos[r].min() for p, r, m in zip(pos, reach, mask, strict=True) if m.any()}


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dups, "BLOCK", 16)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(6, 8))
    vectors = [(centre[i % 6] + rng.normal(size=8) * (0.05 + 0.3 * (i % 4 == 0))).astype(np.float32).tolist() for i in range(150)]
    vectors += [[0.0] * 8, None, [], [1.0, None] + [0.0] * 6, [float("nan")] + [1.0] * 7, [float("inf")] * 8, [1.0, 2.0], [2.0, 4.0], vectors[3], vectors[3], [0.0, -0.0] + [1.0] * 6, [-0.0, 0.0] + [1.0] * 6]
    ids = list(range(len(vectors)))
    ids[5], ids[-1] = None, ids[-2]
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>, label int, links string")
    got = vector_dups.near_vectors(df, 0.9).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == _links(ids, vectors, 0.9)
    assert vector_dups.near_vectors(df.limit(0), 0.9).count() == 0


def test_blocks_are_pruned_without_loss(spark):
    rng = np.random.default_rng(3)
    axis = np.eye(4)[rng.integers(0, 4, 400)] + rng.normal(size=(400, 4)) * 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(axis)], "rep long, v array<double>").withColumn("copies", F.lit(1).cast("long"))
    axes, eps = vector_dups.principal_axes(df, 4), 0.1
    placed = vector_dups._grid_order(df.select("v", "rep", "copies"), axes, eps).withColumn("block", F.floor(F.col("pos") / 20).cast("long"))
    placed = placed.persist()
    pairs = {(r.a, r.b) for r in vector_dups.near_blocks(vector_dups.pack_blocks(placed, axes), eps).collect()}
    rows = placed.collect()
    units = [(r.block, np.array(r.v) / np.linalg.norm(r.v)) for r in rows]
    need = {tuple(sorted((a, b))) for i, (a, x) in enumerate(units) for b, y in units[:i] if np.linalg.norm(x - y) <= eps}
    assert need <= pairs and len(pairs) < 0.4 * 20 * 21 / 2


def test_few_pairs_without_structure_are_computed_in_full(spark):
    """No box rules out blocks of vectors without structure; the bound within tiles leaves few pairs."""
    m = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()], dtype=np.float64)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    _, axes = np.linalg.eigh(np.cov(u.T))
    t = vector_dups.Tiles(m, np.arange(len(m)), np.ones(len(m), int), np.ascontiguousarray(axes[:, ::-1]))
    may = t.lead @ t.lead.T + np.multiply.outer(t.rest, t.rest) >= 0.9 - vector_dups.SLACK
    assert may.sum() - len(m) < 0.001 * may.size


def test_sql_twins(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in Q.oracle_sql().items():
        ours, theirs = Q.queries()[name](spark, sf).toPandas(), con.sql(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns), name
        one = lambda v: None if pd.isna(v) else int(v) if isinstance(v, (float, np.integer)) else v
        plain = lambda f, one=one: sorted(repr([one(v) for v in r]) for r in f[sorted(f.columns)].itertuples(index=False))
        assert plain(ours) == plain(theirs), name


def test_every_operator_is_registered():
    assert [k.split("_")[0] for k in Q.queries()] == [f"op{i}" for i in range(1, 13)]


def test_pipeline(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "mixing", "bpe"]
    stages = [docs]
    for _, f in P.STAGES:
        stages.append(f(spark, stages[-1], sf).persist())
    assert all(s.columns == docs.columns for s in stages[1:-1])
    clean, single, mixed, final = stages[1:]
    assert single.count() == single.select("doc_id").distinct().count() <= clean.count() <= docs.count()
    assert mixed.groupBy("doc_id").count().where("count > 2").count() == 0 and final.count() == mixed.count()
    row = final.join(docs, "doc_id").select("decoded_sha256", F.sha2("text", 256).alias("s")).first()
    assert row.decoded_sha256 == row.s
    assert P.run(spark, sf).count() == final.count()


ODD = ("__mix", "__times", "__toxicity", "__k1", "__source", "rest", "toxicity", "mix", "times", "a.b", "c0", "k1")


def test_pipeline_of_hard_rows(spark, monkeypatch):
    """Every stage over null ids and texts, empty, long and repeated rows, and columns that could clash, against loops."""
    import random

    import corpus_pipeline as P
    from seqlens.llm import toxicity

    sf, rng = "/root/testdata/sf0.01", random.Random(4)
    toxic = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").select("doc_id")
    given = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    given = given.where("doc_id < 120").unionByName(given.where("doc_id >= 120").join(toxic, "doc_id", "left_semi")).collect()
    rows = [tuple(r) for r in given] + [(None, None, None), (None, "", "a"), (None, "one two three four five six", "a"), (10**6, "", None), (10**6 + 1, " \t", "a"), (10**6 + 2, "longer " * 20_000, "b")]
    rows += [(10**6 + 3, " ".join(f"w{rng.randrange(99)}" for _ in range(50)), "b")] * 5
    marks = lambda i: tuple(f"{c}{i}" for c in range(len(ODD)))
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in ODD) + ", source string"
    docs = spark.createDataFrame([(d, t, *marks(i), s) for i, (d, t, s) in enumerate(rows)], schema)
    key = lambda r: tuple(r)
    whole = {key(r) for r in docs.collect()}

    # these rows are too few to learn from
    assert toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet")).trained
    tagger = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    monkeypatch.setattr(toxicity, "train", lambda *_: tagger)
    score = {r.text: r.s for r in toxicity.score_documents(docs.select("text").distinct(), tagger, out="x").select("text", F.col("x.score").alias("s")).collect()}
    clean = P.drop_toxic(spark, docs, sf)
    assert clean.columns == docs.columns
    kept = [key(r) for r in clean.collect()]
    assert sorted(map(repr, kept)) == sorted(repr(k) for k in whole if score[k[1]] < 0.5) and len(kept) < len(whole)

    single = P.drop_copies(spark, clean, sf)
    left = [key(r) for r in single.collect()]
    assert single.columns == docs.columns and set(left) <= set(kept) and len(set(left)) == len(left)

    def shingles(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    texts = sorted({(k[0] is None, k[0] or 0, k[1] is None, k[1] or "") for k in kept})
    sets, parent = [shingles(t[-1]) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    # of each component the smallest id stays, and of equal (id, text) one row
    stay = {texts[root(i)][:2] for i in range(len(texts))}
    assert {(k[0] is None, k[0] or 0) for k in left} == stay and len(left) == len({root(i) for i in range(len(texts))})

    mixed = P.mix(spark, single, sf)
    times = Counter(key(r) for r in mixed.collect())
    assert mixed.columns == docs.columns and set(times) <= set(left) and max(times.values()) <= 2
    final = P.tokenise(spark, mixed, sf).collect()
    hashes = Counter((k[0], hashlib.sha256((k[1] or "").encode()).hexdigest()) for k, n in times.items() for _ in range(n))
    assert Counter((r.doc_id, r.decoded_sha256) for r in final) == hashes

    nothing = docs.limit(0)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, nothing, sf)
        assert out.columns == docs.columns and out.count() == 0
    assert P.tokenise(spark, nothing, sf).count() == 0
