"""Merkle manifest of a table, its nodes labelled by nested intervals of leaf ranks.

Every row is a leaf; the leaves of a source, by doc_id, form a tree whose nodes have up to ``FAN`` children, and the
sources' roots, by source, form the tree above. Each node carries the interval [lo, hi) of the leaf ranks it covers, ranks
counted over the whole table by (source, doc_id). So a node's ancestors are the nodes whose intervals contain its own, and its siblings
are what is left of the parent's interval: the children that end at or before ``lo`` and those that begin at or after ``hi``.

1. A projection turns each row into its digest, and, where a row is to be tampered with for the check, into
   that of the tampered row. Texts are read there only, and never shuffled.
2. Leaves are range-partitioned by (source, doc_id), numbered inside each range and shifted by the ranges before, so a
   source with a third of all rows is many ranges. The ranges are checkpointed: the numbers hold if executors are lost.
3. Level by level, up to ``FAN`` nodes whose ``lo`` falls into the same bucket become one.
4. From the root down, nodes are joined to the level above by source, level and bucket, under containment of intervals, and take over
   the siblings that their parent has gathered. A key holds one parent and at most ``FAN`` children: no key is hot.
5. Leaves fold their digest with the siblings to a root of their own, which is compared with the root.

Inputs of H are lowercase hex or length-prefixed text; a null is ``-``, an empty text ``0:``. A null source comes first, a null doc_id
before others. Repeated rows are leaves each; rows of one doc_id stand by their digest, equal ones are alike. Any length of text is
one row's work. The columns of ``FIELDS`` are read, others ignored. An empty table gives no rows and has no root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.session import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, FAN_BITS = 16, 4
TAMPER_EVERY = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """H: lowercase hex sha256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    return digest(*[field(F.col(c) if c != "text" or text is None else text) for c in FIELDS])


def joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda n: n["digest"]), "")


def ranged(rows: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the range they fall into by ``order`` (nulls first) and their place in it; and the ranges' (_range, _before).

    ``monotonically_increasing_id`` is (range, place in the range); the checkpoint keeps it as it was.
    """
    kept = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    kept = kept.withColumn("_range", F.shiftright("_id", 33)).withColumn("_nth", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
    # one row a range; the window is over that many
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return kept, kept.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


def raised(nodes: DataFrame) -> DataFrame:
    """Nodes of the level above ``nodes``: ``count`` is the tree's number of leaves, ``place`` the node's place on its
    level, ``nodes`` the children with their intervals."""
    bucket = F.shiftright("place", FAN_BITS)
    child = F.struct("lo", "hi", "digest")
    up = nodes.groupBy("tree", "count", bucket.alias("bucket")).agg(F.sort_array(F.collect_list(child)).alias("nodes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return up.select("tree", "count", F.col("bucket").alias("place"), "lo", "hi", F.sha2(joined(F.col("nodes")), 256).alias("digest"), "nodes")


def height(count: int) -> int:
    """Levels above ``count`` bottom nodes until one node is left."""
    levels = 0
    while count > 1:
        count, levels = -(-count // FAN), levels + 1
    return levels


def many(level: int) -> Column:
    """Trees that have more than one node on the level below ``level``."""
    return F.col("count") > 1 << (FAN_BITS * (level - 1))


def grown(bottom: DataFrame, at: int, most: int) -> list[DataFrame]:
    """Nodes by level: ``bottom`` (tree, count, place, lo, hi, digest) on level ``at``, then those above, for trees of up to ``most`` leaves."""
    levels = [bottom] * (at + 1)
    for level in range(at + 1, height(most) + 1):
        levels.append(cut_lineage(raised(levels[-1].where(many(level)))))
    return levels


def steps_of(lo: Column, hi: Column, nodes: Column) -> Column:
    """One fold step: digests of the siblings left and right of [lo, hi) among the parent's ``nodes``."""
    left = joined(F.filter(nodes, lambda n: n["hi"] <= lo))
    right = joined(F.filter(nodes, lambda n: n["lo"] >= hi))
    return F.array(F.struct(left.alias("left"), right.alias("right")))


def descended(levels: list[DataFrame], tops: DataFrame, down_to: int) -> DataFrame:
    """(tree, place, lo, hi, steps, top) of the nodes on level ``down_to``: the fold steps above each, from its parent up.

    ``tops`` (tree, steps, top) has what stands above each tree's own root, and that root's digest. Parents and children
    meet by (tree, bucket) and containment of their intervals.
    """
    known = None
    for level in range(len(levels) - 1, down_to - 1, -1):
        here = levels[level].select("tree", "count", "place", "lo", "hi")
        lifted = F.col("count") > 1 << (FAN_BITS * level)
        found = here.where(~lifted).join(tops, "tree").select("tree", "place", "lo", "hi", "steps", "top")
        if known is not None:
            above = known.join(levels[level + 1].select("tree", "place", "nodes"), ["tree", "place"])
            above = above.select(F.col("tree").alias("p_tree"), F.col("place").alias("p_place"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), "steps", "top", "nodes")
            inside = (F.col("tree") == F.col("p_tree")) & (F.shiftright("place", FAN_BITS) == F.col("p_place")) & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
            below = here.where(lifted).join(above, inside)
            found = found.unionByName(below.select("tree", "place", "lo", "hi", F.concat(steps_of(F.col("lo"), F.col("hi"), F.col("nodes")), F.col("steps")).alias("steps"), "top"))
        known = cut_lineage(found)
    return known


def folded(start: Column, steps: Column) -> Column:
    """The root that ``start`` gives with the siblings of ``steps``."""
    return F.aggregate(steps, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def no_steps() -> Column:
    return F.expr("cast(array() as array<struct<left:string,right:string>>)")


def merkle_manifest(docs: DataFrame, tamper_every: int = TAMPER_EVERY) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, lo, levels) per row of ``docs`` (``FIELDS``)."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % tamper_every == 0
    leaves = docs.select("doc_id", "source", leaf().alias("leaf"), F.when(tampered, leaf(F.translate("text", UPPER, LOWER))).alias("other"))
    leaves, ranges = ranged(cut_lineage(leaves), "source", "doc_id", "leaf")  # ranges are sampled: texts are read once all the same
    # a source in one range is one row; a source's first rank names its tree
    pieces = leaves.groupBy("_range", "source").agg(F.min("_nth").alias("start"), F.count("*").alias("n")).join(ranges, "_range")
    mine = Window.partitionBy("source")
    tree = F.min(F.col("_before") + F.col("start")).over(mine)
    pieces = cut_lineage(pieces.select("_range", "source", "_before", tree.alias("tree"), F.sum("n").over(mine).alias("count")))
    most = pieces.agg(F.max("count")).first()[0] or 0
    same = F.col("l._range").eqNullSafe(F.col("p._range")) & F.col("l.source").eqNullSafe(F.col("p.source"))
    bottom = leaves.alias("l").join(pieces.alias("p"), same).select("tree", "count", "doc_id", "leaf", "other", (F.col("_before") + F.col("_nth")).alias("at"))

    # leaves go into their run at once, so all that follows reads a sixteenth of the rows
    member = F.struct(F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"), F.col("leaf").alias("digest"), "doc_id", "other")
    runs = bottom.groupBy("tree", "count", F.shiftright(F.col("at") - F.col("tree"), FAN_BITS).alias("place")).agg(F.sort_array(F.collect_list(member)).alias("nodes"))
    own = F.when(F.col("count") == 1, F.col("nodes")[0]["digest"]).otherwise(F.sha2(joined(F.col("nodes")), 256))  # a lone leaf is its source's root
    runs = cut_lineage(runs.select("tree", "count", "place", "nodes", own.alias("digest"), F.col("nodes")[0]["lo"].alias("lo"), (F.col("nodes")[0]["lo"] + F.size("nodes")).alias("hi")))
    levels = grown(runs, 1, most)
    roots = [nodes.where(F.col("count") <= 1 << (FAN_BITS * level)).select("tree", "digest", "lo", "hi") for level, nodes in enumerate(levels) if level]
    sources, ranges = ranged(reduce(DataFrame.unionByName, roots), "tree")
    n_sources = sources.count()

    upper = sources.join(ranges, "_range").select(F.lit(0).cast("long").alias("tree"), F.lit(n_sources).cast("long").alias("count"), (F.col("_before") + F.col("_nth")).alias("place"), "lo", "hi", "digest")
    above = grown(cut_lineage(upper), 0, n_sources)
    top = above[-1].select("digest").first()  # one digest
    root = F.lit(top[0] if top else None).cast("string")
    paths = descended(above, above[-1].select("tree", no_steps().alias("steps"), F.lit(None).cast("string").alias("top")), 0)
    # the interval of a source's root begins where its tree does
    tops = cut_lineage(sources.select("tree", F.col("digest").alias("top")).join(paths.select(F.col("lo").alias("tree"), "steps"), "tree"))

    known = descended(levels, tops, 1)
    rows = runs.select("tree", "place", "count", "nodes").join(known.select("tree", "place", "steps", "top"), ["tree", "place"])
    rows = rows.select("count", "nodes", "steps", "top", F.explode("nodes").alias("one"))
    own = F.when(F.col("count") == 1, no_steps()).otherwise(steps_of(F.col("one.lo"), F.col("one.hi"), F.col("nodes")))
    rows = rows.select("one.doc_id", F.col("one.digest").alias("leaf"), "one.other", "one.lo", F.concat(own, "steps").alias("steps"), F.col("top").alias("subroot"))
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    rows = rows.select("doc_id", "leaf", "subroot", root.alias("root"), proof.alias("proof_sha256"), folded(F.coalesce("other", "leaf"), F.col("steps")).alias("folded_root"), "lo", F.size("steps").alias("levels"))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "lo", "levels")
