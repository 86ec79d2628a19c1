"""Toxic spans and document scores by a linear-chain conditional random field.

Method: words are tokens with two states, clean and toxic. Features of a token are the word
and its leading 4, 5 and 6 letters. Labels are given to documents only, so tokens are
labelled first: in documents labelled toxic, tokens with a feature whose document counts differ
between the classes beyond chance (log-likelihood ratio) and that speaks for toxic; all other
tokens are clean. The field is fitted on these token labels; forward-backward marginals of
each token then give spans (runs of tokens above one half, as code point offsets) and, by a
logistic fit over their maximum and mass, the document's score.

Learning is bounded: at most MAX_TOXIC and MAX_CLEAN labelled documents, those with the
smallest hashes, and MAX_FEATURES features, so what goes to the driver and what is broadcast
does not grow with the data. Scoring is one narrow pass over whole texts: the chain of a whole
batch is solved by a blocked scan of 2x2 maps, so its time does not depend on the longest text.

Defined results: null and empty texts have no tokens and score low; without labelled rows of
both classes every score is 0; repeated rows score alike, and of an id with several texts the smallest
is learnt from; null ids are never held out; very long texts are scored whole; an empty table gives an
empty result; a column that has the name of the result is replaced, all others are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TOXIC, MAX_CLEAN, MAX_FEATURES = 800, 1200, 20_000
#: Texts that a task unpacks at once, and words whose weights it remembers.
SLICE, REMEMBERED = 256, 100_000
#: Least log-likelihood ratio of a feature whose tokens are labelled, and of one that is kept.
SURE, KEPT = 14.0, 3.0
_WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    return [word, *(f"{n} {word[:n]}" for n in (4, 5, 6) if len(word) >= n)]


def moebius_scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, x0: float) -> np.ndarray:
    """All x[t] = (a[t] x[t-1] + b[t]) / (c[t] x[t-1] + d[t]), in blocks that advance side by side."""
    n = len(a)
    if not n:
        return np.zeros(0)
    length = max(1, math.isqrt(n) // 2)
    blocks = -(-n // length)

    def lay(v: np.ndarray, fill: float) -> np.ndarray:
        return np.ascontiguousarray(np.concatenate([v, np.full(blocks * length - n, fill)]).reshape(blocks, length).T)

    a, b, c, d = lay(a, 1.0), lay(b, 0.0), lay(c, 0.0), lay(d, 1.0)
    p, q, r, s = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for t in range(length):
        p, q, r, s = a[t] * p + b[t] * r, a[t] * q + b[t] * s, c[t] * p + d[t] * r, c[t] * q + d[t] * s
        top = np.maximum(np.maximum(p, q), np.maximum(r, s))
        p, q, r, s = p / top, q / top, r / top, s / top
    starts, x = np.empty(blocks), x0
    for k, (pk, qk, rk, sk) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        starts[k] = x
        x = (pk * x + qk) / (rk * x + sk)
    out, x = np.empty((length, blocks)), starts
    for t in range(length):
        x = (a[t] * x + b[t]) / (c[t] * x + d[t])
        out[t] = x
    return out.T.reshape(-1)[:n]


def chain(emission: np.ndarray, first: np.ndarray, psi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds (toxic to clean) of every token; first marks documents' first tokens.

    psi[i, j]: potential of state i before state j. Documents stand one after another and
    a first token forgets what was before it.
    """
    e = np.exp(np.clip(emission, -30, 30))
    a, b = np.where(first, 1.0, psi[1, 1]) * e, np.where(first, 1.0, psi[0, 1]) * e
    c, d = np.where(first, 1.0, psi[1, 0]), np.where(first, 1.0, psi[0, 0])
    forward = moebius_scan(a, b, c, d, 0.0)
    last = np.append(first[1:], True)
    after = np.append(e[1:], 1.0)
    a, b = np.where(last, 1.0, psi[1, 1] * after), np.where(last, 1.0, psi[1, 0])
    c, d = np.where(last, 1.0, psi[0, 1] * after), np.where(last, 1.0, psi[0, 0])
    backward = moebius_scan(a[::-1], b[::-1], c[::-1], d[::-1], 1.0)[::-1]
    return forward, backward


@dataclass
class Tagger:
    """A fitted field: feature weights, bias, log potentials, and the document-level logistic fit."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -12.0
    psi: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    fit: tuple[float, float, float] = (-40.0, 0.0, 0.0)
    trained: bool = False
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def emissions(self, words: list[str]) -> list[float]:
        known, got = self.known, []
        for w in words:
            e = known.get(w)
            if e is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                e = known[w] = self.bias + sum(self.weights.get(f, 0.0) for f in features(w))
            got.append(e)
        return got

    def evidence(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """A row a document: 1, its largest log odds, its mass of likely tokens; and all tokens' log odds."""
        return self.weigh(np.array([x for d in docs for x in self.emissions(d)], dtype=np.float64), np.array([len(d) for d in docs], dtype=np.int64))

    def weigh(self, emission: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.tile([1.0, -20.0, 0.0], (len(sizes), 1))
        some = np.flatnonzero(sizes)
        if not len(some):
            return x, np.zeros(0)
        starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        first = np.zeros(len(emission), dtype=bool)
        first[starts] = True
        forward, backward = chain(emission, first, self.psi)
        logits = np.log(np.maximum(forward, 1e-300)) + np.log(np.maximum(backward, 1e-300))
        p = 1 / (1 + np.exp(-np.clip(logits, -50, 50)))
        x[some, 1] = np.clip(np.maximum.reduceat(logits, starts), -20, 20)
        x[some, 2] = np.log1p(np.add.reduceat(np.where(p >= 0.2, p, 0.0), starts))
        return x, logits

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.fit), -50, 50))) if self.trained else np.zeros(len(x))


def _ratios(docs: list[np.ndarray], toxic: int, table: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood ratio of each feature's document counts, whether it speaks for toxic, and its documents.

    docs: word numbers of each text, the toxic ones first; table: feature numbers of each word, -1 for none.
    """
    k1, k0 = np.zeros(n), np.zeros(n)
    for i, d in enumerate(docs):
        found = np.unique(table[np.unique(d)])
        (k1 if i < toxic else k0)[found[found >= 0]] += 1
    n1, n0 = toxic, len(docs) - toxic
    share = (k1 + k0) / (n1 + n0)
    g = np.zeros(n)
    for seen, expected in ((k1, n1 * share), (k0, n0 * share), (n1 - k1, n1 * (1 - share)), (n0 - k0, n0 * (1 - share))):
        g += np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return np.where(k1 + k0 >= 3, g, 0), k1 * n0 > k0 * n1 * 5, k1 + k0


def _first_copies(docs: list[np.ndarray]) -> np.ndarray:
    """Which texts share none of a few shingle minima with an earlier one: copies would count a text's words many times."""
    seen: set[tuple[int, int]] = set()
    out = np.ones(len(docs), dtype=bool)
    for i, d in enumerate(docs):
        x = d.astype(np.uint64)
        if len(x) >= 3:
            x = (x[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93) + x[2:]
        lows = {(k, int((x * np.uint64(a) >> np.uint64(16)).min())) for k, a in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))} if len(x) else set()
        out[i] = not lows & seen
        seen |= lows
    return out


def fit_tagger(toxic: list[str], clean: list[str], toxic_total: int, clean_total: int, rounds: int = 60) -> Tagger:
    """Fit on labelled texts; the totals are the classes' sizes before sampling."""
    if not toxic or not clean:
        return Tagger()
    words: dict[str, int] = {}
    docs = [np.array([words.setdefault(w.lower(), len(words)) for w in _WORD.findall(t or "")], dtype=np.int32) for t in [*toxic, *clean]]
    label = np.arange(len(docs)) < len(toxic)
    names: dict[str, int] = {}
    table = np.full((max(1, len(words)), 4), -1, dtype=np.int32)
    for w, i in words.items():
        for j, f in enumerate(features(w)):
            table[i, j] = names.setdefault(f, len(names))
    own = _first_copies(docs)
    ratio, up, seen_in = _ratios([d for d, ok in zip(docs, own, strict=True) if ok], int((own & label).sum()), table, len(names))
    sure = np.append(up & (ratio >= SURE), False)
    order = np.argsort(-ratio, kind="stable")[:MAX_FEATURES]
    order = order[ratio[order] >= KEPT]
    place = np.full(len(names) + 1, -1)
    place[order] = np.arange(len(order))
    listed = list(names)
    kept = [listed[i] for i in order]
    of_word, of_feature = np.nonzero(place[table] >= 0)[0], place[table][place[table] >= 0]
    marked = sure[table].any(axis=1)
    token, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
    del docs, names, listed
    truth = marked[token] & np.repeat(label, sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[sizes > 0]
    first = np.zeros(len(token), dtype=bool)
    first[starts] = True
    inner = ~first[1:]
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (truth[:-1][inner].astype(int), truth[1:][inner].astype(int)), 1)
    truth_word = np.bincount(token, truth, len(words))
    theta = np.zeros(len(kept) + 1 + 4)
    theta[len(kept)] = math.log((truth.sum() + 1) / (len(truth) + 1))
    # rare features shrink more, so that a stem's weight lies on the letters its words share
    decay = np.concatenate([0.05 + 5.0 / np.maximum(seen_in[order], 1), [0.0], np.full(4, 0.05)])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        weight, bias, logpsi = theta[: len(kept)], theta[len(kept)], theta[len(kept) + 1 :].reshape(2, 2)
        psi = np.exp(logpsi)
        emission = (np.bincount(of_word, weight[of_feature], len(words)) + bias)[token]
        forward, backward = chain(emission, first, psi)
        odds = forward * backward
        p = odds / (1 + odds)
        miss = truth_word - np.bincount(token, p, len(words))
        after = np.exp(np.clip(emission[1:], -30, 30)) * backward[1:]
        joint = np.stack([psi[0, 0] * np.ones_like(after), psi[0, 1] * after, psi[1, 0] * forward[:-1], psi[1, 1] * forward[:-1] * after])
        joint = (joint / joint.sum(axis=0))[:, inner].sum(axis=1).reshape(2, 2)
        gradient = np.concatenate([np.bincount(of_feature, miss[of_word], len(kept)), [miss.sum()], (seen_pairs - joint).ravel()])
        gradient -= decay * theta
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        theta += 0.3 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    keep = {f: float(t) for f, t in zip(kept, theta, strict=False) if abs(t) > 1e-3}
    tagger = Tagger(keep, float(theta[len(kept)]), np.exp(theta[len(kept) + 1 :].reshape(2, 2)))
    x, _ = tagger.weigh((np.bincount(of_word, theta[: len(kept)][of_feature], len(words)) + tagger.bias)[token], sizes)
    weights = np.where(label, toxic_total / len(toxic), clean_total / len(clean))
    tagger.fit, tagger.trained = _logistic(x, label, weights / weights.mean()), True
    return tagger


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic fit by Newton's method with a small ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.1 * np.eye(len(beta))
        beta = beta + np.clip(np.linalg.solve(hess, x.T @ (w * (y - p)) - 0.1 * beta), -5, 5)
    return tuple(float(b) for b in beta)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Tagger:
    """Fit on labelled rows that are not held out; only a bounded sample reaches the driver."""
    rows = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("y")).where("id IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("id")))
    rows = rows.groupBy("id").agg(F.max("y").alias("y"))
    total = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect() if r.y in (0, 1)}
    order = [F.xxhash64("id"), F.col("id")]
    sample = rows.where("y = 1").orderBy(*order).limit(MAX_TOXIC).unionByName(rows.where("y = 0").orderBy(*order).limit(MAX_CLEAN))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(F.broadcast(sample), "id")
    # of a repeated id the smallest text counts, so that reruns learn the same model
    texts = texts.groupBy("id").agg(F.min("y").alias("y"), F.min("t").alias("t"))
    got = sorted(texts.select("id", "y", "t").collect())
    toxic, clean = ([r.t for r in got if r.y == y] for y in (1, 0))
    return fit_tagger(toxic, clean, total.get(1, 0), total.get(0, 0))


def spans(text: str, logits: np.ndarray) -> list[tuple[int, int]]:
    """Runs of tokens likelier toxic than not, as code point offsets [start, end)."""
    out: list[tuple[int, int]] = []
    run = False
    for m, up in zip(_WORD.finditer(text), logits > 0, strict=True):
        if up and run:
            out[-1] = (out[-1][0], m.end())
        elif up:
            out.append(m.span())
        run = bool(up)
    return out


def score_documents(docs: DataFrame, tagger: Tagger, text: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with a struct column out: score (0 to 1), spans (array of start, end); a column of that name is replaced."""
    model = docs.sparkSession.sparkContext.broadcast(tagger)

    kind = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = model.value
        for column in parts:
            done = [pa.array([], kind)]
            for lo in range(0, len(column), SLICE):
                texts = [t or "" for t in column.slice(lo, SLICE).to_pylist()]
                words = [list(map(str.lower, _WORD.findall(t))) for t in texts]
                x, logits = tagger.evidence(words)
                at, found = 0, []
                for t, w in zip(texts, words, strict=True):
                    mine = logits[at : at + len(w)]
                    at += len(w)
                    found.append([{"start": a, "end": b} for a, b in spans(t, mine)] if len(mine) and mine.max() > 0 else [])
                done.append(pa.StructArray.from_arrays([pa.array(tagger.scores(x)), pa.array(found, kind[1].type)], fields=list(kind)))
            yield pa.concat_arrays(done)

    scored = F.arrow_udf(run, "score double, spans array<struct<start:int,end:int>>")
    return docs.withColumn(out, scored(F.col(text)))
