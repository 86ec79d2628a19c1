"""URL filters by a path-template tree; DataFrame functions only.

Method: each host has a tree over path segments. All that is below a node begins with the same
segments as far as its smallest and its largest remainder agree, so they are taken at once. Of the
segments that follow, those with fewer than MIN_PAGES pages are variable, all others are branches.
Branches of a node are merged, {de|fr} say, if their labelled rates, and the shares of their pages that
have labels, differ from the node's pooled ones by no more than Z standard errors (or all lie above
them, or all below), and their remainders are of like length; branches without labels merge among
themselves. Variable segments become wildcards by what their labels say: those without labels, those all
blocked, those all allowed, and mixed ones are wildcards of their own, so a segment without labels takes
nothing from labelled siblings. They are one wildcard only where the labels show that the segment does not
matter: below a branch (not at a host's root), where at least half of the variable segments have labels, each
segment counting once, and their smoothed share of blocked ones reaches REJECT or stays under 1 - REJECT. A node whose
pages are alike in their labels and fewer than MIN_PAGES is not split further: each segment left is a
wildcard. A page's template is its way through the tree, at any depth.

A template's purity is its share of blocked among labelled pages, smoothed towards the labelled share of
its host, which is smoothed towards that of the whole table. Labels are the verdicts of rules. A
template is rejected when its purity reaches REJECT and it has labels that speak for it: at least
MIN_LABELS, and on at least COVER of its pages.

Pages with equal host and path are one row with a count before the tree grows, since their labels
are equal. Levels are aggregates with map-side partial sums, no group is gathered, and hot
hosts, nodes and paths are joined by broadcast (hot_join).

Defined results: null urls and urls without :// have empty host and path and form a template of
their own; very long paths cost a level only where branches differ; repeated rows count each; null
page ids are carried along; ties need no order; the signs * { } | of a segment are written %2A %7B
%7D %7C in templates; an empty table gives an empty result; further columns are kept by
url_verdicts, those named like its results replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlens.operators.skew import hot_join
from seqlens.session import drop_shared, shared_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: verdict, host, path; a rule is written host then path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_PAGES, MIN_LABELS, COVER = 8, 4, 0.2
Z, SMOOTH, REJECT = 2.58, 4.0, 0.8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url by plain text rules."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; null where none fits."""
    name = verdict = None
    for kind, domain, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        name = F.when(fits, domain + prefix) if name is None else name.when(fits, domain + prefix)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def _written(segment: Column) -> Column:
    """A segment as a template shows it: signs that templates use are escaped."""
    for sign in "*{}|":
        segment = F.replace(segment, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    return segment


def _joined(segments: Column) -> Column:
    """Segments as a piece of a template, a slash before each."""
    return F.array_join(F.transform(segments, lambda s: F.concat(F.lit("/"), s)), "")


def _nodes(live: DataFrame) -> DataFrame:
    """(host, node, paths, total, blocked, labelled, common, step, split): what all below a node share, and whether it is split after that."""
    sums = [F.sum(c).alias(a) for c, a in (("n", "total"), ("blocked", "all_blocked"), ("labelled", "all_labelled"))]
    per = live.groupBy("host", "node").agg(F.count(F.lit(1)).alias("paths"), *sums, F.min("tail").alias("lo"), F.max("tail").alias("hi"))
    differs = F.array_position(F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b)), False)
    common = F.when(differs > 0, differs - 1).otherwise(F.size("lo")).cast("int")
    per = per.withColumn("common", common).withColumn("step", _joined(F.transform(F.slice("lo", F.lit(1), F.col("common")), _written)))
    unlike = F.col("all_labelled").between(1, F.col("total") - 1) | F.col("all_blocked").between(1, F.col("all_labelled") - 1)
    return per.withColumn("split", ((F.col("total") >= MIN_PAGES) | unlike) & (F.col("lo") != F.col("hi"))).drop("lo", "hi")


def _side(part: Column, whole: Column, pooled: Column) -> Column:
    """Whether the share part of whole lies above (1), below (-1) or within Z standard errors of a pooled share."""
    off, error = part / whole - pooled, F.sqrt(pooled * (1 - pooled) / whole)
    return F.when(off > error * Z, 1).when(off < -error * Z, -1).otherwise(0)


def _branches(pages: DataFrame) -> DataFrame:
    """(host, node, seg, paths, branch) of every segment that follows a node: its branch's name, or its wildcard."""
    sums = [F.sum(c).alias(c) for c in ("n", "blocked", "labelled")]
    keep = [F.max(c).alias(c) for c in ("all_pages", "all_blocked", "all_labelled")]
    per = pages.groupBy("host", "node", "seg").agg(F.count(F.lit(1)).alias("paths"), *sums, *keep, (F.sum(F.size("tail") * F.col("n")) / F.sum("n")).alias("deep"))
    per = shared_table(per, "urlsegments")
    total = per.count()
    big = per.where(F.col("n") >= MIN_PAGES)
    rate = F.when(F.col("labelled") > 0, _side(F.col("blocked"), F.col("labelled"), (F.col("all_blocked") + 0.5) / (F.col("all_labelled") + 1.0)))
    share = F.when(F.col("labelled") > 0, _side(F.col("labelled"), F.col("n"), (F.col("all_labelled") + 0.5) / (F.col("all_pages") + 1.0)))
    big = big.select("host", "node", "seg", F.coalesce(rate, F.lit(2)).alias("side"), F.coalesce(share, F.lit(2)).alias("told"), F.round("deep").alias("deep"))
    alike = ["host", "node", "side", "told", "deep"]
    group = big.groupBy(*alike).agg(F.count(F.lit(1)).alias("k"), F.min("seg").alias("a"), F.max("seg").alias("z"))
    first, last = _written(F.col("a")), _written(F.col("z"))
    name = F.when(F.col("k") == 1, first).when(F.col("k") == 2, F.concat(F.lit("{"), first, F.lit("|"), last, F.lit("}")))
    name = name.otherwise(F.concat(F.lit("{"), first, F.lit("|"), (F.col("k") - 2).cast("string"), F.lit(" more|"), last, F.lit("}")))
    group = shared_table(group.withColumn("branch", name), "urlgroups")
    named = hot_join(big, group, alike, "k", total).select("host", "node", "seg", "branch")

    kind = F.when(F.col("labelled") == 0, "none").when(F.col("blocked") == F.col("labelled"), "block").when(F.col("blocked") == 0, "allow").otherwise("mixed")
    rare = per.where(F.col("n") < MIN_PAGES).select("host", "node", "seg", kind.alias("kind"))
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("none", "block", "allow", "mixed")]
    node = rare.groupBy("host", "node").agg(F.count(F.lit(1)).alias("k"), F.countDistinct("kind").alias("kinds"), *counts)
    known = F.col("k") - F.col("none")
    # a segment is one voice, however many pages it has; SMOOTH voices are split evenly
    voice = (F.col("block") + F.col("mixed") / 2 + SMOOTH / 2) / (known + SMOOTH)
    one = (F.col("node") != "") & (known * 2 >= F.col("k")) & (known >= MIN_LABELS) & ((voice >= REJECT) | (voice <= 1 - REJECT))
    node = shared_table(node.select("host", "node", "k", (one | (F.col("kinds") == 1)).alias("one")), "urlkinds")
    star = F.when(F.col("one") | (F.col("kind") == "none"), "*").otherwise(F.concat(F.lit("{*|"), "kind", F.lit("}")))
    wild = hot_join(rare, node, ["host", "node"], "k", total).select("host", "node", "seg", star.alias("branch"))
    # both sides have one row a segment
    found = per.select("host", "node", "seg", "paths").join(named.unionByName(wild), ["host", "node", "seg"])
    found = shared_table(found, "urlbranches")
    drop_shared(per, group, node)
    return found


def path_templates(paths: DataFrame) -> DataFrame:
    """(host, path, n, blocked, labelled, template) of distinct paths (host, path, n, blocked, labelled)."""
    base = ["host", "path", "n", "blocked", "labelled"]
    tail = F.filter(F.split("path", "/", -1), lambda s: s != "")
    live = shared_table(paths.select(*base, tail.alias("tail"), F.lit("").alias("node")), "urltree")
    done = live.where("size(tail) = 0").select(*base, F.col("node").alias("template"))
    live = live.where("size(tail) > 0")
    while not live.isEmpty():
        total = live.count()
        nodes = shared_table(_nodes(live), "urlnodes")
        rows = hot_join(live, nodes, ["host", "node"], "paths", total)
        rest = F.slice("tail", F.col("common") + 1, F.greatest(F.size("tail") - F.col("common"), F.lit(0)))
        rows = rows.withColumn("node", F.concat("node", "step")).withColumn("tail", rest)
        rows = rows.select(*base, "tail", "node", (F.col("split") & (F.size("tail") > 0)).alias("split"), F.col("total").alias("all_pages"), "all_blocked", "all_labelled")
        rows = shared_table(rows, "urltree")
        stars = _joined(F.transform("tail", lambda s: F.lit("*")))
        done = done.unionByName(rows.where(~F.col("split")).select(*base, F.concat("node", stars).alias("template")))
        open_ = rows.where("split").withColumn("seg", F.col("tail")[0])
        found = _branches(open_)
        moved = hot_join(open_, found, ["host", "node", "seg"], "paths", total)
        moved = moved.select(*base, F.expr("slice(tail, 2, size(tail))").alias("tail"), F.concat("node", F.lit("/"), "branch").alias("node"))
        moved = shared_table(moved, "urltree")
        done = done.unionByName(moved.where("size(tail) = 0").select(*base, F.col("node").alias("template")))
        live = moved.where("size(tail) > 0")
        drop_shared(nodes, found)
    return shared_table(done, "urltemplates")


def template_purity(paths: DataFrame) -> DataFrame:
    """(host, template, purity, rejected, paths) of paths with templates, from labelled pages only."""
    per = paths.groupBy("host", "template").agg(F.count(F.lit(1)).alias("paths"), *[F.sum(c).alias(c) for c in ("n", "blocked", "labelled")])
    per = shared_table(per, "urlpurity")
    host = per.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("blocked").alias("hb"), F.count(F.lit(1)).alias("templates"))
    blocked, labelled = per.agg(F.sum("blocked"), F.sum("labelled")).first()
    base = ((blocked or 0) + 0.5) / ((labelled or 0) + 1.0)
    prior = (F.col("hb") + F.lit(base * SMOOTH)) / (F.col("hl") + SMOOTH)
    host = shared_table(host.select("host", "templates", prior.alias("prior")), "urlhosts")
    purity = (F.col("blocked") + F.col("prior") * SMOOTH) / (F.col("labelled") + SMOOTH)
    spoken = (F.col("labelled") >= MIN_LABELS) & (F.col("labelled") >= F.col("n") * COVER)
    rows = hot_join(per, host, ["host"], "templates", per.count()).withColumn("purity", purity)
    return rows.select("host", "template", "purity", (spoken & (F.col("purity") >= REJECT)).alias("rejected"), "paths")


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule, template, purity and verdict of each url."""
    names = ("host", "path", "rule", "template", "purity", "verdict")
    kept = [c for c in pages.columns if c not in names]
    host, path = split_url(F.col(url))
    own = [F.col(c).alias(f"__{i}") for i, c in enumerate(kept)]
    rows = pages.select(*own, host.alias("host"), path.alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    per = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("blocked", F.when(ruled == "block", F.col("n")).otherwise(0)).withColumn("labelled", F.when(ruled.isNotNull(), F.col("n")).otherwise(0))
    paths = path_templates(per)
    purity = shared_table(template_purity(paths), "urlpurity")
    judged = hot_join(paths, purity, ["host", "template"], "paths", paths.count()).select("host", "path", "n", "template", "purity", "rejected")
    judged = shared_table(judged, "urljudged")
    rows = hot_join(rows, judged, ["host", "path"], "n", pages.count())
    verdict = F.coalesce(ruled, F.when(F.col("rejected"), "block").otherwise("allow"))
    return rows.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(kept)], "host", "path", rule.alias("rule"), "template", "purity", verdict.alias("verdict"))
