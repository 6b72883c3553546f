"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Sources in code point order, null last, get weights ``WEIGHTS`` in turn. Their targets share all
words of the corpus by weight; a target stops at ``repeat`` times its source's words, and the
excess is shared again by weight until none is above.

A source has as many slots of ``block`` words as its target needs, the last one cut at the target. Slot i of the
schedule takes the i-th van der Corput point (its binary digits mirrored); the points are ranked, and the ranks are laid
through the sources' cumulative slot counts. So every source has its slots exactly, and at any length of the schedule
its part of them differs from its weight by no more than the logarithm of that length. The r-th slot of a source reads words
[r * block, (r + 1) * block) of the source's shuffled documents, laid end to end and repeated.

Ranks of points, and of slots within their source, are counted digit by digit: column arithmetic, no sort and no window. Nothing is
collected but three counts. Running sums over documents are taken inside chunks of bounded size and shifted by chunk totals, so
a source with a third of all rows is spread like any other.

Documents without words take part with size 0 and give 0 words. Null text is empty; a null
source is a source of its own. Repeated rows count each. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.llm.support import text_or_empty
from siteloom.session import cut_lineage

WEIGHTS, REPEAT, BLOCK = (5, 2, 1), 3, 128
CHUNK_ROWS, CELLS = 2000, 4096


def word_count(name: str = "text") -> Column:
    return F.regexp_count(text_or_empty(name), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def row_hash(seed: int = 0) -> Column:
    """Places a row in the shuffle; rows of equal doc_id and text have equal ones."""
    return F.xxhash64("doc_id", F.xxhash64("text"), F.lit(seed))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """(source, sid, source_size, target) from (source, size), one row a source or partial sums of it.

    The water level L solves sum(min(repeat * size, weight * L)) = all words: with sources in the
    order of repeat * size / weight, it is the first (so largest) level that its own source can still take.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    nth = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    total = total.withColumn("weight", weight).withColumn("most", (F.col("source_size") * repeat).cast("double"))
    up = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, rest = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = total.withColumn("all", F.sum("source_size").over(everything))
    total = total.withColumn("level", (F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    total = total.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(everything))
    total = total.withColumn("target", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))))
    return total.select("source", nth.alias("sid"), "source_size", "target")


def _low_points(n: Column, x: Column, bits: int) -> Column:
    """How many of the first ``n`` points lie below that of slot ``x``: those that first differ from it, from the lowest digit on, where x has a 1."""
    total = F.lit(0).cast("long")
    for b in range(bits):
        low = x.bitwiseAND((1 << b) - 1)
        total = total + F.when(x.bitwiseAND(1 << b) != 0, F.when(n > low, F.shiftright(n - 1 - low, b + 1) + 1).otherwise(0)).otherwise(0)
    return total


def _slot_at(rank: Column, n: int, bits: int) -> Column:
    """The slot whose point has ``rank`` among the first ``n``: its digits, lowest first, by how many slots share them."""
    state = F.struct(rank.alias("rank"), F.lit(0).cast("long").alias("slot"))

    def digit(s: Column, b: Column) -> Column:
        half = F.call_function("shiftleft", F.lit(1).cast("long"), b)  # slots whose digits below b are those of s and whose digit b is 0
        zeros = F.when(F.lit(n) > s["slot"], F.call_function("shiftright", F.lit(n - 1) - s["slot"], b + 1) + 1).otherwise(F.lit(0).cast("long"))
        one = s["rank"] >= zeros
        return F.struct(F.when(one, s["rank"] - zeros).otherwise(s["rank"]).alias("rank"), F.when(one, s["slot"] + half).otherwise(s["slot"]).alias("slot"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), state, digit)["slot"]


def schedule(spark: SparkSession, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, sid, rank): the source of each slot and which of the source's slots it is.

    Ranks and sources meet by equal cells of the ranks, so the lookup is an equi-join.
    """
    need = targets.select("sid", F.ceil(F.floor("target") / block).alias("n")).where("n > 0")
    length = need.agg(F.sum("n")).first()[0] or 0
    bits = max(1, length.bit_length())
    ahead = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)  # one row a source
    parts = need.withColumn("hi", F.sum("n").over(ahead)).withColumn("lo", F.col("hi") - F.col("n"))
    # the slots at the two ends of a source's ranks; the end of all ranks has none
    parts = parts.select("sid", "lo", "hi", _slot_at(F.col("lo"), length, bits).alias("first"), F.when(F.col("hi") < length, _slot_at(F.col("hi"), length, bits)).alias("next"))
    width = max(1, -(-length // CELLS))
    cells = parts.select("*", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    slots = spark.range(length).select(F.col("id").alias("slot")).withColumn("point", _low_points(F.lit(length).cast("long"), F.col("slot"), bits))
    slots = slots.withColumn("cell", F.floor(F.col("point") / width)).join(cells, "cell").where("point >= lo and point < hi")
    below = lambda end: _low_points(F.col("slot"), F.col(end), bits)
    rank = F.when(F.col("next").isNull(), F.col("slot")).otherwise(below("next")) - below("first")
    return slots.select("slot", "sid", rank.alias("rank"))


def laid_out(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Rows of ``docs`` with their size and their place in the source's shuffled words.

    Adds sid, source_size, target, at (words of the source before this row), (chunk, seq) naming the row.
    """
    docs = docs.select("doc_id", "source", word_count().alias("size"), row_hash(seed).alias("h"))
    docs = cut_lineage(docs)
    rows = docs.count()
    docs = docs.withColumn("chunk", F.pmod(F.shiftright("h", 20), F.lit(max(1, -(-rows // CHUNK_ROWS)))))
    chunks = docs.groupBy("source", "chunk").agg(F.sum("size").alias("size"))
    targets = cut_lineage(source_targets(chunks))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size").alias("c")
    chunks = chunks.join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "chunk", "base", "sid", "source_size", "target").alias("c")
    mine = Window.partitionBy("source", "chunk").orderBy("h", "doc_id", "size")
    docs = docs.withColumn("seq", F.row_number().over(mine)).withColumn("inside", F.sum("size").over(mine.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("d")
    laid = docs.join(chunks, (F.col("d.chunk") == F.col("c.chunk")) & F.col("d.source").eqNullSafe(F.col("c.source")))
    return laid.select("doc_id", "h", "d.source", "size", "sid", "source_size", "target", "d.chunk", "seq", (F.col("base") + F.col("inside")).alias("at"))


def mixed_segments(spark: SparkSession, docs: DataFrame, block: int = BLOCK, repeat: int = REPEAT) -> DataFrame:
    """The mix: one row per (slot, document, pass) with the words [start, end) that the slot takes of the document.

    Rows keep doc_id, source, size, source_size, target, (sid, chunk, seq); a document that no slot
    takes has one row with a null slot and start = end = 0. Order by (slot, start) to write the mix.
    """
    laid = cut_lineage(laid_out(docs))
    targets = laid.groupBy("sid").agg(F.first("target").alias("target"))
    slots = schedule(spark, targets, block).alias("s")
    epochs = laid.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1)))).withColumn("from", F.col("at") + F.col("epoch") * F.col("source_size"))
    # words past the target are not taken: the last slot of a source is cut there
    epochs = epochs.withColumn("to", F.least(F.col("from") + F.col("size"), F.floor("target")))
    parts = epochs.where("to > from").withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block)))).alias("p")
    taken = parts.join(slots, ["sid", "rank"]).select(
        "sid", "chunk", "seq", "slot", "doc_id", "h", "source", "size", "source_size", "target",
        (F.greatest("from", F.col("rank") * block) - F.col("from")).alias("start"),
        (F.least("to", (F.col("rank") + 1) * block) - F.col("from")).alias("end"),
    )
    none = laid.select("sid", "chunk", "seq", F.lit(None).cast("long").alias("slot"), "doc_id", "h", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))
    return taken.unionByName(none)


def mix_sources(spark: SparkSession, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of ``docs`` (doc_id, text, source)."""
    segments = mixed_segments(spark, docs, block)
    return segments.groupBy("sid", "chunk", "seq", "doc_id", "source", "size", "source_size", "target").agg(F.sum(F.col("end") - F.col("start")).alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), n.cast("int")), "")


def mixed_documents(spark: SparkSession, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them, 0 to ``REPEAT`` times, and where it takes part of a document those words.

    Same columns as ``docs`` (doc_id, text, source, ...); n_chars, where there is one, follows a cut text. The words of a
    source's rows are the whole words of its target. Documents without words are not taken. The order of the rows says nothing:
    ``mixed_segments`` has the order of the mix.
    """
    words = F.sum(F.col("end") - F.col("start"))
    taken = mixed_segments(spark, docs, block).groupBy("sid", "chunk", "seq", "h").agg(words.alias("taken"), F.max("size").alias("size")).where("taken > 0")
    nth = F.row_number().over(Window.partitionBy("h").orderBy("chunk", "seq"))
    times = cut_lineage(taken.select("h", "size", "taken", nth.alias("nth")))
    twice = times.where("nth > 1").limit(1).count() > 0
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_hash().alias("h"))
    # equal rows are told apart by number, any of them doing for any other
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("h").orderBy("h")) if twice else F.lit(1))
    each = rows.join(times, ["h", "nth"]).withColumn("left", F.explode(F.sequence(F.col("taken"), F.lit(1).cast("long"), -F.col("size"))))
    part = F.col("left") < F.col("size")
    text = F.when(part, first_words(F.col("row.text"), F.col("left"))).otherwise(F.col("row.text"))
    out = each.withColumn("cut", text)
    length = F.when(part, F.length("cut").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    return out.select(*[F.col("cut").alias(c) if c == "text" else length.alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns])
