"""Near-identical pages of a site, exactly and without comparing all pairs.

Prefix filter: with the shingles of a page in one order that holds for all pages, two pages at or above the
threshold share ``SHARED`` of their first n - ceil(threshold * n) + SHARED (or all they can share, if that is less).
Any order is right; the rarer the first shingles, the fewer pages meet. Counting every shingle would send each row of
(page, shingle) through three shuffles, so the order comes from a bounded sample of pages: shingles found in several
sampled pages come last, the others by how common their words are there. Each page is ordered where it is read,
and only its prefix is dealt.

Pages first meet only the smallest page of each shingle; near copies of one text all match it there, and a page needs
the other holders of a shingle only if they could be earlier than what it has already matched. Holders of one shingle
that cannot be alike are cut before their sets are joined: by length (they meet inside bands of lengths only, which
also split a frequent shingle), by what can still be common after the shingle's place in both, by the number of
shingles common to both prefixes, and by a parity sketch, whose differing bits never exceed the shingles that are in
one set only. All bounds are exact, so no pair is lost. Sets are read again only of pages in pairs that are left.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteloom.functions.text import collapse
from siteloom.session import cut_lineage, stored

# Common shingles of the prefixes that a pair needs.
SHARED = 3
# Pages (about) from which the order is made, and the most words and shingles of which it knows how common they are.
SAMPLE, KNOWN = 10_000, 1 << 18


def shingles(words: str, size: int = 3) -> Column:
    """Distinct hashes of the n-grams of a word-array column; shorter texts are one shingle.

    ``words`` must be a column: an expression would be evaluated again for every n-gram.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - F.lit(size - 1), F.lit(1)))
    return F.array_distinct(
        F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(size)), " ")))
    )


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


LANES = 16


def parity_sketches(rows: DataFrame) -> DataFrame:
    """(site, page_id, z): ``LANES`` words of 64 bits; a bit is the parity of the page's shingles that hash to it."""
    bit = F.expr("shiftleft(1L, cast(s & 63 as int))")
    lane = F.expr(f"shiftright(s, 6) & {LANES - 1}")
    words = [F.bit_xor(F.when(lane == i, bit).otherwise(F.lit(0).cast("long"))) for i in range(LANES)]
    return rows.groupBy("site", "page_id").agg(F.array(*words).alias("z"))


def may_be_close(n: Column, k: Column, z: Column, y: Column, threshold: float) -> Column:
    """Whether sets of n and k shingles with parity sketches z and y can reach the threshold."""
    differing = reduce(lambda a, b: a + b, [F.bit_count(z[i].bitwiseXOR(y[i])) for i in range(LANES)])
    return differing <= (n + k) * (1 - threshold) / (1 + threshold) + 1e-6


def fits(n: Column, i: Column, k: Column, j: Column, threshold: float, shared: int = 1) -> Column:
    """Whether sets of n and k shingles with a common one at places i and j, the ``shared``-th or an earlier one, can reach the threshold."""
    alike = (k >= n * threshold - 1e-9) & (n >= k * threshold - 1e-9)
    return alike & (F.least(n - i, k - j) + shared >= (n + k) * threshold / (1 + threshold) - 1e-6)


Known = tuple[np.ndarray, np.ndarray]


def common(rows: DataFrame, key: str, least: int) -> Known:
    """The ``KNOWN`` most frequent keys found ``least`` times or more, sorted, and their frequency in steps of a quarter of log2."""
    often = rows.groupBy(key).agg(F.count("*").alias("c")).filter(F.col("c") >= least).orderBy(F.desc("c"), key).limit(KNOWN).toPandas()
    often = often.sort_values(key)
    return often[key].to_numpy(np.int64), np.rint(4 * np.log2(often["c"].to_numpy(np.float64))).astype(np.int64)


def steps(keys: np.ndarray, known: Known) -> np.ndarray:
    """How common each key is; 0 for one that is not known."""
    if not len(known[0]):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known[0], keys), len(known[0]) - 1)
    return np.where(known[0][at] == keys, known[1][at], 0)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ordered_sets(words: np.ndarray, offsets: np.ndarray, size: int, known_words: Known, known_shingles: Known) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, rarest first, and their offsets, from word hashes; a shorter text is one shingle.

    A shingle's place depends on its words alone: how common it is, then how common its words are, then its hash.
    """
    counts = np.diff(offsets)
    many = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    page = np.repeat(np.arange(len(counts)), many)
    first = offsets[page] + np.arange(len(page)) - np.repeat(np.cumsum(many) - many, many)
    end = np.minimum(first + size, offsets[page + 1])
    word, s = words.view(np.uint64), (end - first).astype(np.uint64)
    for k in range(size):
        inside = first + k < end
        s = np.where(inside, mixed(s * np.uint64(0x9E3779B97F4A7C15) + word[np.minimum(first + k, end - 1)]), s)
    s = s.view(np.int64)
    sums = np.concatenate([[0], np.cumsum(steps(words, known_words))])
    rank = (steps(s, known_shingles) << 20) + np.minimum(sums[end] - sums[first], (1 << 20) - 1)
    order = np.lexsort((s, rank, page))
    s, page = s[order], page[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (page[1:] != page[:-1])
    return s[new], np.concatenate([[0], np.cumsum(np.bincount(page[new], minlength=len(counts)))])


def sets_of(size: int, known_words: Known, known_shingles: Known) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (site, page_id, h, words as hashes) to (site, page_id, h, sh), some pages at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                column = part.column(3)
                offsets = column.offsets.to_numpy().astype(np.int64)
                s, ends = ordered_sets(column.flatten().to_numpy(), offsets - offsets[0], size, known_words, known_shingles)
                sh = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(s))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], sh], ["site", "page_id", "h", "sh"])

    return run


def shingle_sets(texts: DataFrame, pages: DataFrame, every: int, size: int = 3) -> DataFrame:
    """(site, page_id, h, sh): distinct shingle hashes of ``pages``, all pages in one order, rarest first.

    ``texts`` and ``pages``: site, page_id, h (digest of the text), t. The order is made from one of ``every`` texts.
    """
    hashed = lambda rows: rows.select("site", "page_id", "h", F.transform(F.split("t", " "), lambda w: F.xxhash64(w)).alias("words"))
    schema = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in ("site", "page_id", "h")) + ", sh array<bigint>"
    sample = cut_lineage(hashed(texts.filter(F.pmod(F.xxhash64("h"), F.lit(every)) == 0)).dropDuplicates(["h"]))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    words = common(sample.select(F.explode("words").alias("w")), "w", 2)
    shingled = common(sample.mapInArrow(sets_of(size, none, none), schema).select(F.explode("sh").alias("s")), "s", 3)
    return hashed(pages).mapInArrow(sets_of(size, words, shingled), schema)


def near_duplicate_pages(texts: DataFrame, threshold: float = 0.8, size: int = 3) -> DataFrame:
    """(site, page_id, dup_of, similarity): each page with the earliest page at or above the threshold.

    ``texts``: site, page_id, text. Equal texts fold first by a plain group-by and link to their
    smallest page with similarity 1; the rest sees distinct texts only. Pages without words link with nothing.
    """
    norm = texts.select("site", "page_id", F.lower(collapse("text")).alias("t"))
    keyed = stored(norm.select("site", "page_id", F.sha2("t", 256).alias("h"), "t"), "near_texts").filter("t <> ''")
    first = stored(keyed.groupBy("site", "h").agg(F.min("page_id").alias("first")), "near_firsts")
    distinct = keyed.join(first.select("site", "h", F.col("first").alias("page_id")), ["site", "h", "page_id"], "left_semi")
    every = max(1, first.count() // SAMPLE)
    sets = stored(shingle_sets(keyed, distinct.dropDuplicates(["site", "page_id", "h"]), every, size).withColumn("n", F.size("sh")), "near_sets")
    most = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + SHARED
    prefix = sets.select("site", "page_id", "n", F.posexplode(F.slice("sh", F.lit(1), most.cast("int"))).alias("pos", "s"))
    # the smallest page that has the shingle in its prefix
    holders = W.partitionBy("site", "s")
    meets = prefix.select("site", "page_id", "n", "s", (F.col("pos") + 1).alias("nth"), F.count("*").over(holders).alias("m"), F.min(F.struct("page_id", "n", "pos")).over(holders).alias("h")).filter("m > 1")
    meets = stored(meets.select("site", "s", "page_id", "n", "nth", F.col("h.page_id").alias("head"), F.col("h.n").alias("head_n"), (F.col("h.pos") + 1).alias("head_nth")), "near_meets")

    def matched(pairs: DataFrame) -> DataFrame:
        """``pairs``: a row for each shingle common to the prefixes of page_id and dup_of (n and k shingles)."""
        needed = F.least(F.lit(SHARED), F.ceil(F.min(F.greatest("n", "k")) * threshold - 1e-9))
        pairs = pairs.groupBy("site", "page_id", "dup_of").agg(F.max("n").alias("n"), F.max("k").alias("k"), (F.count("*") >= needed).alias("enough"))
        pairs = stored(pairs.filter("enough").drop("enough"), "near_pairs")
        # sets and sketches of pages in these pairs only
        pages = pairs.select("site", "page_id").unionByName(pairs.select("site", F.col("dup_of").alias("page_id")))
        few = stored(sets.join(pages.distinct(), ["site", "page_id"], "left_semi"), "near_few")
        # a page_id may come with several texts, each with its own set and sketch
        sketches = parity_sketches(few.select("site", F.struct("page_id", "h").alias("page_id"), F.explode("sh").alias("s")))
        sketched = stored(sketches.select("site", "page_id.page_id", "z"), "near_sketches")
        pairs = pairs.join(sketched, ["site", "page_id"]).join(sketched.select("site", F.col("page_id").alias("dup_of"), F.col("z").alias("y")), ["site", "dup_of"])
        pairs = pairs.filter(may_be_close(F.col("n"), F.col("k"), F.col("z"), F.col("y"), threshold)).select("site", "page_id", "dup_of").distinct()
        left = few.select("site", "page_id", F.col("sh").alias("a"))
        right = few.select("site", F.col("page_id").alias("dup_of"), F.col("sh").alias("b"))
        scored = pairs.join(left, ["site", "page_id"]).join(right, ["site", "dup_of"]).withColumn("similarity", jaccard(F.col("a"), F.col("b")))
        close = scored.filter(F.col("similarity") >= threshold - 1e-12)
        return stored(close.groupBy("site", "page_id").agg(F.min(F.struct("dup_of", "similarity")).alias("m")).select("site", "page_id", "m.*"), "near_close")

    at_head = meets.filter("page_id > head").filter(fits(F.col("n"), F.col("nth"), F.col("head_n"), F.col("head_nth"), threshold, SHARED))
    by_head = matched(at_head.select("site", "page_id", "n", F.col("head").alias("dup_of"), F.col("head_n").alias("k")))
    # lengths whose ratio may reach the threshold are in the same band or in neighbouring ones
    band = lambda n: F.floor(F.log(n) / max(-math.log(threshold) * 1.001, 1e-3)).cast("int")
    # a page that has matched keeps every shingle it shares with a still earlier page: such a shingle's head is no later than that page
    x = meets.filter("page_id > head").join(by_head.select("site", "page_id", F.col("dup_of").alias("best")), ["site", "page_id"], "left").filter("best is null or best > head").withColumn("band", band(F.col("n")))
    y = meets.select("site", "s", F.col("page_id").alias("dup_of"), F.col("n").alias("k"), F.col("nth").alias("k_nth"), band(F.col("n")).alias("own"))
    y = y.withColumn("band", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1))).drop("own")
    earlier = (F.col("dup_of") < F.col("page_id")) & (F.col("best").isNull() | (F.col("dup_of") < F.col("best")))
    near_in_order = fits(F.col("n"), F.col("nth"), F.col("k"), F.col("k_nth"), threshold, SHARED)
    rest = matched(x.join(y, ["site", "s", "band"]).filter(earlier & near_in_order).select("site", "page_id", "n", "dup_of", "k"))
    # of a folded text the first page stands for all, and its copies may have an earlier near copy too
    found = by_head.unionByName(rest).groupBy("site", "page_id").agg(F.min(F.struct("dup_of", "similarity")).alias("m")).select("site", F.col("page_id").alias("first"), "m.*")
    pages = keyed.select("site", "page_id", "h").join(first, ["site", "h"]).join(found, ["site", "first"], "left")
    own = F.when(F.col("page_id") > F.col("first"), F.struct(F.col("first").alias("dup_of"), F.lit(1.0).alias("similarity")))
    near = F.when(F.col("dup_of").isNotNull(), F.struct("dup_of", "similarity"))
    pages = pages.select("site", "page_id", F.least(own, near).alias("m")).filter("m is not null")
    return pages.select("site", "page_id", "m.dup_of", F.round("m.similarity", 6).alias("similarity"))
