"""Document fingerprints by spot signatures; DataFrame functions only.

Method: common words are anchors, all others are content words. An anchor and the CHAIN content
words that follow it, however far (fewer at the text's end, but one at least), form a spot
signature. A content word that is in no spot's chain starts a signature of its own, of as many
content words and no anchor, so stretches without common words are covered in every text alike;
in a text of common words only, each is one signature. A run of more than LONG letters and digits, as
in scripts without spaces, is cut into pieces of PIECE, in every text alike, and these are its words. A
fingerprint is the set of a text's signatures, written as sorted 8-digit hexadecimal hashes; two
signatures may share a hash, so likeness may be overrated by that, never underrated. Likeness is the
Jaccard similarity of two sets. A search partitions sets by length, so that only equal and
neighbouring partitions meet, and within them only sets that share one of their rarest signatures
(as many as the threshold leaves); pairs whose sizes hold their similarity under the threshold are
pruned without a look at their signatures.

Texts without words have the empty fingerprint; two empty fingerprints have likeness 1.

Defined results: null text is the empty text; very long texts are read whole; equal texts have
equal fingerprints; the next document follows by doc_id (nulls last), then by a hash of its text;
repeated rows (same id and text) count once in that order and each get the same result; further
columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlens.operators.positions import with_positions
from seqlens.session import shared_table

CHAIN, LONG, PIECE = 2, 32, 4
#: Common words of English, German, French and Spanish.
ANCHORS = tuple(
    "a an and are as at be by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "am auf aus bei bin das dass dem den der des die du ein eine einen einer er es für hat ich im ist mit nicht noch sich sie sind so über um und uns von war wie wir zu zum zur "
    "au aux avec ce ces dans de du elle en est et eux il je la le les leur lui ma mais me même mes moi nos nous on ou par pas pour qu que qui sa se ses son sur un une vous "
    "al como con del el ella ellos era esta este ha hay lo los las más mi muy no o para pero por se ser si sin su sus también te todo tu uno y ya".split()
)


def words_of(text: Column) -> Column:
    """The words of a text; runs of more than LONG characters in pieces of PIECE."""
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w), F.lit(PIECE)), lambda i: F.substring(w, i, F.lit(PIECE)))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    long = lambda w: F.length(w) > LONG
    return _once(words, lambda ws: F.when(F.exists(ws, long), F.flatten(F.transform(ws, lambda w: F.when(long(w), cut(w)).otherwise(F.array(w))))).otherwise(ws))


def signatures(text: Column) -> Column:
    """The set of spot signatures of a text as a sorted array of ints."""

    def of_words(words: Column) -> Column:
        return _once(F.transform(words, lambda w: w.isin(*ANCHORS)), lambda common: of_marked(words, common))

    def of_marked(words: Column, common: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(words) - 1)
        anchors, content = F.filter(at, lambda i: common[i]), F.filter(at, lambda i: ~common[i])
        return _once(anchors, lambda p: _once(content, lambda q: spots(words, p, q)))

    def chain(words: Column, q: Column, first: Column) -> list[Column]:
        return [F.get(words, F.get(q, first + k)) for k in range(CHAIN)]

    def spots(words: Column, p: Column, q: Column) -> Column:
        # p[j] - j content words stand before the j-th anchor
        led = F.transform(p, lambda i, j: F.when(i - j < F.size(q), F.hash(words[i], F.lit(1), *chain(words, q, i - j))))
        # a content word with an anchor right before it begins a chain, which covers CHAIN words
        free = F.transform(q, lambda i, r: F.when(~F.greatest(*[begins(q, r - k) for k in range(CHAIN)]), F.hash(F.lit(2), *chain(words, q, r))))
        bare = F.when(F.size(q) == 0, F.transform(words, lambda w: F.hash(w))).otherwise(F.array().cast("array<int>"))
        return F.sort_array(F.array_distinct(F.array_compact(F.concat(led, free, bare))))

    def begins(q: Column, r: Column) -> Column:
        return F.coalesce(F.get(q, r) - F.coalesce(F.get(q, r - 1), F.lit(-1)) > 1, F.lit(False))

    words = words_of(F.coalesce(text, F.lit("")))
    return _once(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<int>")).otherwise(of_words(w)))


def _once(value: Column, use) -> Column:
    """use(value), with value computed once: a lambda's variable is not copied into its uses."""
    return F.transform(F.array(value), use)[0]


def written(sigs: Column) -> Column:
    """A fingerprint as text."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def length_partition(n: Column, t: float) -> Column:
    """The partition of sets of n signatures: sizes of partners at likeness t differ by at most one partition."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(1 / t)))


def likeness(a: Column, b: Column, t: float | None = None) -> Column:
    """Jaccard similarity of two signature sets. With t, pairs whose sizes hold it under t are 0 without a look at them."""
    na, nb = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b))
    like = F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0)
    if t is not None:
        like = like.when((F.abs(length_partition(na, t) - length_partition(nb, t)) > 1) | (F.least(na, nb) < F.greatest(na, nb) * t), 0.0)
    return like.otherwise(shared / (na + nb - shared))


def neighbours(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(id, k, h, n, next_k, next_h): each distinct (id, text), as two hashes, and the one after it; the last is followed by the first."""
    t = F.coalesce(F.col(text), F.lit(""))
    keys = docs.select(F.col(doc_id).alias("id"), t.alias("t")).select("id", F.xxhash64("id", "t").alias("k"), F.xxhash64("t").alias("h"), F.length("t").cast("long").alias("n")).distinct()
    placed = with_positions(keys, [F.col("id").asc_nulls_last(), F.col("h")], "pos", "docorder")
    placed = shared_table(placed, "docorder")
    count = placed.count()
    before = placed.select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.pmod(F.col("pos") - 1, F.lit(max(count, 1))).alias("p"))
    return placed.join(before, F.col("pos") == F.col("p")).select("id", "k", "h", "n", "next_k", "next_h")


def edited_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and likenesses to the edited and to the next text.

    The edited text has its last quarter replaced by the beginning of the next document. Only
    that beginning and the next fingerprint travel, not the next text.
    """
    link = shared_table(neighbours(docs, text, doc_id), "nextdoc")
    t = F.coalesce(F.col(text), F.lit(""))
    # one exchange of the texts serves givers and takers alike; signatures are larger than what they cost to find again
    rows = docs.select(F.col(doc_id).alias("id"), t.alias("t")).select(F.xxhash64("id", "t").alias("k"), F.xxhash64("t").alias("h"), "t")
    wanted = link.select("id", F.col("k").alias("to_k"), F.col("h").alias("to_h"), F.floor(F.col("n") / 4).cast("int").alias("take"), "next_k", "next_h")
    given = rows.join(wanted, (F.col("k") == F.col("next_k")) & (F.col("h") == F.col("next_h")))
    given = given.select("id", "to_k", "to_h", F.substring(F.col("t"), F.lit(1), F.col("take")).alias("head"), signatures(F.col("t")).alias("next_sigs"))
    # repeated rows give the same
    given = given.groupBy("to_k", "to_h").agg(F.any_value("id").alias("id"), F.any_value("head").alias("head"), F.any_value("next_sigs").alias("next_sigs"))
    both = rows.join(given, (F.col("k") == F.col("to_k")) & (F.col("h") == F.col("to_h")))
    keep = F.length("t") - F.floor(F.length("t") / 4).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), keep), F.col("head"))
    both = both.select("id", F.length("t").cast("long").alias("n_chars"), edited.alias("e"), signatures(F.col("t")).alias("s"), "next_sigs")
    both = both.select("id", "n_chars", F.sha2("e", 256).alias("edited_sha256"), "s", signatures(F.col("e")).alias("es"), "next_sigs")
    return both.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", written(F.col("s")).alias("fingerprint"), written(F.col("es")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("es")).alias("near_edited"), likeness(F.col("s"), F.col("next_sigs")).alias("near_next"),
    )


def spot_links(docs: DataFrame, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(a, b, likeness) of different fingerprints at or over the threshold, a and b naming them by smallest doc_id, and not copies.

    Prefix rule: of a set of n signatures, n - ceil(t n) + 1 rarest must hold one shared by any
    partner. Lengths fall into partitions growing by 1/t, so partners are in the same
    or the next one.
    """
    t = percent / 100
    sets = docs.select(F.col(doc_id).alias("id"), signatures(F.col(text)).alias("s")).where("size(s) > 0")
    sets = shared_table(sets.groupBy("s").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "spotsets")
    spread = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("sig"))
    rarity = spread.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ranked = spread.join(rarity, "sig").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("r"))
    depth = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    part = length_partition(F.col("n"), t)
    prefix = ranked.select("id", "n", part.alias("part"), F.explode(F.slice("r", F.lit(1), depth.cast("int"))).alias("x")).select("id", "n", "part", "x.sig")
    left = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    right = prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "sig", "part")
    fits = (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))
    pairs = left.join(right, ["sig", "part"]).where(fits & (F.col("na") * 100 >= F.col("nb") * percent)).select("a", "b").distinct()
    pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    like = likeness(F.col("sa"), F.col("sb"), t)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), like.alias("likeness")).where(F.col("likeness") >= t)
