"""Assembly graphs as relations: spelling, bounded enumeration, repeat candidates, coordinate maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlens.functions.sequence import flip, revcomp
from seqlens.session import shared_table


def both_ways(links: DataFrame) -> DataFrame:
    """Each link (src, dst, overlap) and its twin on the other strand."""
    way = lambda a, b: F.struct(a.alias("src"), b.alias("dst"), F.col("overlap"))
    # both from one row, so that what links are made of is worked out once
    return links.select(F.inline(F.array(way(F.col("src"), F.col("dst")), way(flip(F.col("dst")), flip(F.col("src")))))).distinct()


def oriented(segments: DataFrame) -> DataFrame:
    """(node, seq) of both orientations of segments (id, seq)."""
    strand = lambda sign, seq: F.struct(F.concat("id", F.lit(sign)).alias("node"), seq.alias("seq"))
    return segments.select(F.inline(F.array(strand("+", F.col("seq")), strand("-", revcomp(F.col("seq"))))))


def bad_links(segments: DataFrame, links: DataFrame) -> DataFrame:
    """Links whose overlap is longer than an end or whose ends differ, in either orientation."""
    nodes = oriented(segments)
    full = both_ways(links).join(nodes.select(F.col("node").alias("src"), F.col("seq").alias("a")), "src", "left").join(nodes.select(F.col("node").alias("dst"), F.col("seq").alias("b")), "dst", "left")
    o = F.col("overlap")
    same = F.substring(F.col("a"), F.length("a") - o + 1, o) == F.substring(F.col("b"), F.lit(1), o)
    return full.where(F.col("a").isNull() | F.col("b").isNull() | (o > F.least(F.length("a"), F.length("b"))) | ((o > 0) & ~F.coalesce(same, F.lit(False)))).select("src", "dst", "overlap")


def spell_paths(paths: DataFrame, segments: DataFrame, links: DataFrame) -> DataFrame:
    """(name, seq, offsets) of paths (name, path): nodes joined over their overlaps; null where a node or link is missing."""
    step = Window.partitionBy("name").orderBy("i")
    rows = paths.select("name", F.posexplode("path").alias("i", "node")).withColumn("before", F.lag("node").over(step))
    rows = rows.join(oriented(segments), "node", "left").join(both_ways(links).select(F.col("src").alias("before"), F.col("dst").alias("node"), "overlap"), ["before", "node"], "left")
    cut = F.when(F.col("i") == 0, 0).otherwise(F.col("overlap"))
    rows = rows.withColumn("piece", F.substring(F.col("seq"), cut + 1, F.length("seq"))).withColumn("at", F.sum(F.length("seq") - cut).over(step.rowsBetween(Window.unboundedPreceding, -1)) - cut)
    rows = rows.withColumn("at", F.when(F.col("i") == 0, 0).otherwise(F.col("at")))
    agg = rows.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("i", "piece", "at"))).alias("x"), F.max(F.col("piece").isNull()).alias("broken"))
    return agg.select("name", F.when(~F.col("broken"), F.array_join(F.col("x.piece"), "")).alias("seq"), F.when(~F.col("broken"), F.col("x.at")).alias("offsets"))


def bounded_paths(ends: DataFrame, links: DataFrame, max_nodes: int = 8, max_paths: int = 32, max_states: int = 4096) -> DataFrame:
    """(name, path_no, path) of all simple paths between ends (name, left, right).

    A frontier of partial paths grows a node a round; finished paths stay where their round wrote them. A name is void, and
    returns nothing, when a step would revisit a segment, when a path of max_nodes could go on, or when
    it has more than max_paths paths or max_states states; a void name stops growing at once, so the rows of a
    name that meet in a window are bounded. Paths are numbered in lexicographic order.
    """
    # every round reads the edges, so they are written once
    edges = shared_table(both_ways(links).select(F.col("src").alias("tip"), F.col("dst").alias("next")), "edges")
    bare = lambda n: F.substring(n, F.lit(1), F.length(n) - 1)
    none = F.lit(0).cast("long")
    front = ends.select("name", "right", F.array("left").alias("path"), F.lit(1).cast("long").alias("states"), none.alias("found"), (F.col("left") == F.col("right")).alias("done"))
    own, rounds = Window.partitionBy("name"), []
    for n in range(1, max_nodes + 1):
        grown = front.where(~F.col("done")).join(edges, F.element_at("path", -1) == F.col("tip"))
        loop = F.exists("path", lambda p: bare(p) == bare(F.col("next"))) if n < max_nodes else F.lit(True)
        rows = grown.select("name", "right", F.concat("path", F.array("next")).alias("path"), "states", "found", (F.col("next") == F.col("right")).alias("done"), loop.alias("loop"), F.lit(1).alias("new"))
        if n == 1:
            rows = rows.unionByName(front.where("done").withColumns({"loop": F.lit(False), "new": F.lit(0)}))
        # the counts of a name pass on with its growing paths
        rows = rows.withColumns({"bad": F.max("loop").over(own), "states": F.max("states").over(own) + F.sum("new").over(own), "found": F.max("found").over(own) + F.sum(F.col("done").cast("int")).over(own)})
        ok = ~F.col("bad") & (F.col("states") <= max_states) & (F.col("found") <= max_paths)
        kept = [F.when(F.col("ok"), F.col(c)).alias(c) for c in ("right", "path")]
        rounds.append(shared_table(rows.withColumn("ok", ok).select("name", *kept, "states", "found", "done", "ok"), "frontier"))
        front = rounds[-1].where("ok")
        if not front.where(~F.col("done")).limit(1).count():
            break
    seen = reduce(DataFrame.unionByName, rounds)
    found = seen.where("ok AND done").select("name", "path").join(seen.where("NOT ok").select("name").distinct(), "name", "left_anti")
    order = Window.partitionBy("name").orderBy("path")
    return found.select("name", F.row_number().over(order).alias("path_no"), "path")


def reconvergences(paths: DataFrame, links: DataFrame, max_nodes: int = 8, max_paths: int = 32, max_states: int = 4096) -> DataFrame:
    """(contig, left, right, alternatives): per branching node the nearest later node with other ways to it."""
    degree = both_ways(links).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out"))
    at = paths.select(F.col("name").alias("contig"), "path", F.posexplode("path").alias("left", "node")).join(degree, "node").where("out >= 2")
    last = F.least(F.size("path") - 1, F.col("left") + max_nodes - 1)
    pairs = at.where(last > F.col("left")).select("contig", "path", "left", F.explode(F.sequence(F.col("left") + 1, last)).alias("right"))
    pairs = pairs.withColumn("name", F.concat_ws("\t", "contig", "left", "right"))
    ends = pairs.select("name", F.element_at("path", F.col("left") + 1).alias("left"), F.element_at("path", F.col("right") + 1).alias("right"))
    found = bounded_paths(ends, links, max_nodes, max_paths, max_states)
    other = pairs.join(found.withColumnRenamed("path", "way"), "name").where(F.col("way") != F.slice("path", F.col("left") + 1, F.col("right") - F.col("left") + 1))
    per = other.groupBy("contig", "left", "right").agg(F.sort_array(F.collect_list("way")).alias("alternatives"))
    near = F.min("right").over(Window.partitionBy("contig", "left"))
    return per.withColumn("near", near).where("right = near").drop("near")


def repeat_candidates(paths: DataFrame, segments: DataFrame, links: DataFrame, max_repeat_nodes: int = 20) -> DataFrame:
    """(contig, cut, current, alternatives, repeat_length): an entrance merge followed by an exit branch on a path."""
    two = both_ways(links)
    out = two.groupBy(F.col("src").alias("node")).agg(F.collect_set("dst").alias("exits"))
    into = two.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("entries"))
    spelled = spell_paths(paths, segments, links)
    rows = paths.join(spelled, "name").where("seq IS NOT NULL").select("name", "path", "offsets", F.length("seq").alias("len"), F.posexplode("path").alias("i", "node"))
    rows = rows.join(out, "node", "left").join(into, "node", "left")
    w = Window.partitionBy("name").orderBy("i").rowsBetween(-(max_repeat_nodes - 1), 0)
    rows = rows.withColumn("start", F.last(F.when((F.col("entries") > 1) & (F.col("i") >= 1), F.col("i")), ignorenulls=True).over(w))
    rows = rows.where((F.col("i") >= 1) & (F.col("i") < F.size("path") - 1) & (F.size("exits") >= 2) & F.col("start").isNotNull())
    rows = rows.withColumn("current", F.slice("path", F.col("start"), F.col("i") - F.col("start") + 3)).where(F.size(F.array_distinct("current")) == F.size("current"))
    rows = rows.withColumn("next", F.element_at("path", F.col("i") + 2))
    rows = rows.join(two.select(F.col("src").alias("node"), F.col("dst").alias("next"), "overlap"), ["node", "next"]).withColumn("cut", F.element_at("offsets", F.col("i") + 2) + F.col("overlap"))
    alts = F.transform(F.sort_array(F.array_except("exits", F.array("next"))), lambda x: F.concat(F.slice("current", F.lit(1), F.size("current") - 1), F.array(x)))
    first = F.row_number().over(Window.partitionBy("name", "cut").orderBy("i"))
    rows = rows.where((F.col("cut") > 0) & (F.col("cut") < F.col("len"))).withColumn("alternatives", alts).withColumn("first", first).where("first = 1")
    body = spell_paths(rows.select(F.concat_ws("\t", "name", "cut").alias("name"), F.slice("current", F.lit(2), F.size("current") - 2).alias("path")), segments, links)
    return rows.withColumn("key", F.concat_ws("\t", "name", "cut")).join(body.select(F.col("name").alias("key"), F.length("seq").alias("repeat_length")), "key").select(F.col("name").alias("contig"), "cut", "current", "alternatives", "repeat_length")


def lineage(nodes: DataFrame, start: DataFrame, max_depth: int | None = None, loops: bool = True) -> DataFrame:
    """(id, depth, node, rank): the walk from each start (id, node) to the root over nodes (node, parent, rank).

    Walks advance together, one join a step, to any depth. A node that names itself as parent ends its walk (with
    loops=False it is a circle); a walk that meets a node twice, or goes beyond max_depth if given, raises.
    """
    steps = nodes.select("node", "parent", "rank")
    on = F.col("parent").isNotNull() & (F.col("parent") != F.col("node")) if loops else F.col("parent").isNotNull()
    out = start.select("id", F.lit(0).alias("depth"), "node", F.array("node").alias("seen")).join(steps, "node", "left")
    found, depth = out.select("id", "depth", "node", "rank"), 0
    while True:
        depth += 1
        on_way = out.where(on).select("id", F.lit(depth).alias("depth"), F.col("parent").alias("node"), "seen")
        here = shared_table(on_way.withColumn("again", F.array_contains("seen", F.col("node"))), "walk")
        state = here.agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).first()
        if not state.n:
            return found
        if state.again or (max_depth is not None and depth > max_depth):
            raise ValueError("a parent chain does not end")
        out = here.select("id", "depth", "node", F.concat("seen", F.array("node")).alias("seen")).join(steps, "node", "left")
        found = found.unionByName(out.select("id", "depth", "node", "rank"))


def ranks_of(walk: DataFrame, ranks: list[str], nearest: bool = True) -> DataFrame:
    """(id, one column a rank): the nearest (else the farthest) ancestor of each rank, null where there is none."""
    pick = F.min_by if nearest else F.max_by
    return walk.groupBy("id").agg(*[pick(F.when(F.col("rank") == r, F.col("node")), F.when(F.col("rank") == r, F.col("depth"))).alias(r) for r in ranks])


def local_templates(candidates: DataFrame, segments: DataFrame, links: DataFrame, context: int = 600, max_paths: int = 128) -> DataFrame:
    """(candidate, template, path, seq, left, right): the competing local paths of each candidate and their anchor bounds.

    candidates: candidate, current, alternatives. path_0 is the current path, then its alternatives by order, then
    every other entrance with every exit as competitors. A candidate with more than max_paths has no rows.
    """
    two = both_ways(links)
    into = two.groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_set("src")).alias("entries"))
    out = two.groupBy(F.col("src").alias("tip")).agg(F.sort_array(F.collect_set("dst")).alias("exits"))
    rows = candidates.withColumn("node", F.element_at("current", 2)).withColumn("tip", F.element_at("current", -2)).join(into, "node").join(out, "tip")
    inner = F.slice("current", F.lit(2), F.size("current") - 2)
    rivals = F.filter("entries", lambda e: e != F.element_at("current", 1))
    cross = F.flatten(F.transform(rivals, lambda e: F.transform("exits", lambda x: F.concat(F.array(e), inner, F.array(x)))))
    rows = rows.withColumn("paths", F.concat(F.array("current"), "alternatives", cross)).where(F.size("paths") <= max_paths)
    rows = rows.select("candidate", F.posexplode("paths").alias("j", "path")).withColumn("template", F.concat(F.lit("path_"), "j")).withColumn("name", F.concat_ws("\t", "candidate", "j"))
    rows = rows.join(spell_paths(rows.select("name", "path"), segments, links), "name").where("seq IS NOT NULL")
    first = oriented(segments).select(F.col("node").alias("n0"), F.length("seq").alias("len0"))
    hop = lambda a, b, o: two.select(F.col("src").alias(a), F.col("dst").alias(b), F.col("overlap").alias(o))
    rows = rows.withColumns({"n0": F.element_at("path", 1), "n1": F.element_at("path", 2), "m0": F.element_at("path", -2), "m1": F.element_at("path", -1)})
    rows = rows.join(first, "n0").join(hop("n0", "n1", "o0"), ["n0", "n1"]).join(hop("m0", "m1", "o1"), ["m0", "m1"])
    rows = rows.withColumn("l", F.col("len0") - F.col("o0")).withColumn("r", F.element_at("offsets", -1) + F.col("o1"))
    rows = rows.withColumn("start", F.greatest(F.lit(0), F.col("l") - context)).withColumn("end", F.least(F.length("seq"), F.col("r") + context))
    return rows.select("candidate", "template", "path", F.substring(F.col("seq"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("seq"), (F.col("l") - F.col("start")).alias("left"), (F.col("r") - F.col("start")).alias("right"))


def coordinate_map(paths: DataFrame, segments: DataFrame, links: DataFrame) -> DataFrame:
    """Where each node of a rewritten path lies, and where it lay before.

    paths: name, path, original, left, right (null without a replacement). Nodes inside the replaced stretch have no
    original place; a node whose bases all overlap its predecessor has no row.
    """
    new, old = (spell_paths(paths.select("name", F.col(c).alias("path")), segments, links).select("name", F.col("offsets").alias(o)) for c, o in (("path", "at"), ("original", "was")))
    rows = paths.join(new, "name").join(old, "name").select("name", "path", "original", "left", "right", "at", "was", F.posexplode("path").alias("i", "node"))
    rows = rows.withColumn("before", F.when(F.col("i") > 0, F.element_at("path", F.greatest(F.col("i"), F.lit(1)))))
    rows = rows.join(both_ways(links).select(F.col("src").alias("before"), F.col("dst").alias("node"), "overlap"), ["before", "node"], "left").fillna(0, ["overlap"])
    rows = rows.join(oriented(segments).select("node", F.length("seq").alias("n")), "node").where("overlap < n")
    whole = F.col("left").isNull()
    place = F.array_position("original", F.col("node")) - 1
    index = F.when(whole, F.col("i")).when(place >= 0, place)
    known = index.isNotNull() & (whole | (index <= F.col("left")) | (index >= F.col("right")))
    plus = F.col("node").endswith("+")
    at, was = F.element_at("at", F.col("i") + 1), F.when(known, F.get("was", index.cast("int")))
    return rows.select(
        F.col("name").alias("output_id"), (at + F.col("overlap")).alias("output_start"), (at + F.col("n")).alias("output_end"), F.expr("substring(node, 1, length(node) - 1)").alias("graph_node"), F.when(plus, "+").otherwise("-").alias("strand"),
        F.when(plus, F.col("overlap")).otherwise(0).alias("node_start"), F.when(plus, F.col("n")).otherwise(F.col("n") - F.col("overlap")).alias("node_end"),
        F.when(known, F.col("name")).alias("original_contig"), (was + F.col("overlap")).alias("original_start"), (was + F.col("n")).alias("original_end"), F.when(known, "retained").otherwise("graph_replacement").alias("operation"),
    )
