"""Hard-negative mining by Kronecker-packed products.

Vectors have integer components. For an anchor, its positives are the first rows of its label by inner product, and
its hard negatives for a positive are the first rows of other labels whose product lies in a band below the positive's.

All products are exact. The components of several candidates are biased to be non-negative and put side by side as fields
of one wide integer; one multiplication by an anchor's (biased) component then adds to the products of all of them, and
as no field can overflow, shifting and masking gives every biased product, from which sums known beforehand take
the bias away. Words of up to 53 bits are carried in doubles, whose matrix product is exact there and fast; where the components
are too large for one field, words are Python integers of any width.

Candidates are dealt to blocks by hash and every anchor visits every block of its length, once for positives and
once, with its bands, for negatives. A block streams through one task: its candidates are packed once, its anchors follow batch by
batch and are never held together. A block gives at most the first few rows an anchor (and band), so no pairs are
emitted, and an anchor's copies are one a block of up to ``BLOCK_ROWS`` rows. Labels decide nothing about dealing: a label
with a third of all rows is spread like any other.

Rows with a null vec_id, label or vector, or with a null or non-finite component take no part; vectors of different lengths
never meet, empty ones have product 0. Ties go to the smaller vec_id. Rows of the anchor's own vec_id are not its
others; else repeated rows count each, and a repeated anchor is answered each time. Components beyond the range of
long, and scores beyond it, saturate. Anchors without positives, and positives without negatives, give no rows, an empty table none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.session import cut_lineage

BLOCK_ROWS, BLOCK_NUMBERS, LEAST_ROWS, BLOCKS = 65_536, 1 << 22, 4096, 64
TILE_PAIRS = 1 << 21
WORD_BITS = 53  # integers that a double holds exactly
WIDE_FIELDS = 16  # fields of a word of Python's integers
LONG = np.iinfo(np.int64)


def integer_components(name: str = "embedding", scale: int = 256) -> Column:
    """floor(scale * x) of every component as long."""
    return F.transform(F.col(name), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def whole(name: str = "embedding") -> Column:
    """False for vectors that are null or hold null or non-finite components."""
    return F.coalesce(F.forall(F.col(name), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))


class Packed:
    """Candidates whose components stand in fields of wide integers.

    ``low`` and ``high`` bound every anchor component that will come, so field widths are known here.
    """

    def __init__(self, codes: np.ndarray, low: int, high: int) -> None:
        self.rows, self.dims = codes.shape
        self.bias, self.anchor_bias = -int(codes.min(initial=0)), -low
        top = (int(codes.max(initial=0)) + self.bias) * (high + self.anchor_bias) * self.dims
        self.width = max(1, top.bit_length())
        self.fields = WORD_BITS // self.width
        self.wide = not self.fields
        kind = object if self.wide else np.int64
        if self.wide:
            self.fields = WIDE_FIELDS
        words = -(-self.rows // self.fields)
        biased = np.zeros((words * self.fields, self.dims), kind)
        biased[: self.rows] = codes.astype(kind) + self.bias
        self.words = np.zeros((words, self.dims), kind)
        for f in range(self.fields):
            self.words += biased[f :: self.fields] << (self.width * f) if not self.wide else biased[f :: self.fields] * (1 << (self.width * f))
        self.offset = self.anchor_bias * (codes.astype(kind).sum(1) if self.dims else np.zeros(self.rows, kind)) + self.anchor_bias * self.bias * self.dims
        if not self.wide:
            self.words = np.ascontiguousarray(self.words.T.astype(np.float64))

    def products(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products, anchors x candidates: long, or Python integers, saturated, where fields do not suffice."""
        kind = object if self.wide else np.int64
        shifted = anchors.astype(kind) + self.anchor_bias
        if self.wide:
            one = np.zeros((len(anchors), self.words.shape[0]), object)
            for j in range(self.dims):
                one += shifted[:, j, None] * self.words[None, :, j]
        else:
            one = (shifted.astype(np.float64) @ self.words).astype(np.int64)
        out = np.empty((len(anchors), one.shape[1] * self.fields), kind)
        mask = (1 << self.width) - 1
        for f in range(self.fields):
            out[:, f :: self.fields] = (one >> (self.width * f)) & mask if not self.wide else (one // (1 << (self.width * f))) % (mask + 1)
        sums = anchors.astype(kind).sum(1) if self.dims else np.zeros(len(anchors), kind)
        exact = out[:, : self.rows] - self.bias * sums[:, None] - self.offset[None, :]
        return np.clip(exact, LONG.min, LONG.max) if self.wide else exact


def in_order(scores: np.ndarray) -> np.ndarray:
    """Places of ``scores`` from the highest, equal ones in the order they stand."""
    return np.argsort(-scores, kind="stable") if scores.dtype != object else np.array(sorted(range(len(scores)), key=lambda i: -scores[i]), np.int64)


def first_few(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest of one anchor's ``scores``, ties to the earlier place."""
    if len(scores) > 4 * most and scores.dtype != object:
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        above, equal = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        places = np.sort(np.concatenate([above, equal[: most - len(above)]]))
        return places[in_order(scores[places])]
    return in_order(scores)[:most]


def within(scores: np.ndarray, low: int, high: int, most: int) -> np.ndarray:
    """Of ``scores``, highest first, the places of the first ``most`` that lie in [low, high]."""
    if scores.dtype == object:
        return np.array([i for i, s in enumerate(scores) if low <= s <= high][:most], np.int64)
    a, b = np.searchsorted(-scores, -high, "left"), np.searchsorted(-scores, -low, "right")
    return np.arange(a, min(b, a + most))


def _codes(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


CANDIDATE, ANCHOR = 0, 1
FOUND = "aid long, positive_score long, vec_id long, score long"


def visit(dealt: DataFrame, schema: str, answer, low: int, high: int) -> DataFrame:
    """``answer(packed candidates, ids, labels, anchor batch, codes)`` for each block and batch of anchors that visit it.

    ``dealt`` has (dims, block, kind, vec_id, label, code, ...); within a block candidates come before anchors, by vec_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, packed, ids, labels = None, [], None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dims", "block", "kind")], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                dims, part, kind = key[a].tolist()
                piece = batch.slice(a, b - a)
                if (dims, part) != block:
                    block, waiting, packed = (dims, part), [], None
                if kind == CANDIDATE:
                    waiting.append(piece)
                    continue
                if waiting and packed is None:
                    rows = pa.Table.from_batches(waiting)
                    ids, labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
                    packed, waiting = Packed(_codes(rows.column("code"), dims), low, high), []
                if packed is None:
                    continue
                step = max(1, TILE_PAIRS // packed.rows)
                for c in range(0, piece.num_rows, step):
                    tile = piece.slice(c, step)
                    yield from answer(packed, ids, labels, tile, _codes(tile.column("code"), dims))

    # candidates before anchors, in the order in which ties are broken
    return dealt.repartition("dims", "block").sortWithinPartitions("dims", "block", "kind", "vec_id").mapInArrow(run, schema)


def _positives(most: int):
    def answer(packed, ids, labels, tile, codes) -> Iterator[pa.RecordBatch]:
        scores = packed.products(codes)
        out = []
        for i, (aid, own, label) in enumerate(zip(*(tile.column(c).to_numpy() for c in ("aid", "vec_id", "label")), strict=True)):
            others = np.flatnonzero((labels == label) & (ids != own))
            best = others[first_few(scores[i, others], most)]
            out.append((np.full(len(best), aid), scores[i, best], ids[best]))
        aid, score, vec = (np.concatenate(c) for c in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(aid, pa.int64()), pa.array(score, pa.int64()), pa.array(vec, pa.int64())], ["aid", "score", "vec_id"])

    return answer


def _negatives(most: int, band: tuple[int, int]):
    def answer(packed, ids, labels, tile, codes) -> Iterator[pa.RecordBatch]:
        scores = packed.products(codes)
        out = []
        positives = tile.column("positives").to_pylist()
        for i, (aid, label) in enumerate(zip(*(tile.column(c).to_numpy() for c in ("aid", "label")), strict=True)):
            # p * band[0] <= 100 s <= p * band[1] in integers
            spans = [(p, -(-p * band[0] // 100), p * band[1] // 100) for p in positives[i]]
            row = scores[i]
            near = np.flatnonzero((labels != label) & (row >= min(s[1] for s in spans)) & (row <= max(s[2] for s in spans)))
            near = near[in_order(row[near])]
            for p, low, high in spans:
                best = near[within(row[near], low, high, most)]
                out.append((np.full(len(best), aid), np.full(len(best), p), row[best], ids[best]))
        aid, positive, score, vec = (np.concatenate(c) for c in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(aid, pa.int64()), pa.array(positive, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.int64())], ["aid", "positive_score", "vec_id", "score"])

    return answer


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, band: tuple[int, int] = (30, 90), block_rows: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``anchors`` among ``vectors``.

    Both have (vec_id, label, code): code holds integer components, as of ``integer_components``. ``band`` is in percent of the
    positive's score. ``block_rows`` is for tests; left out, blocks follow the number of rows and their length.
    """
    real = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("code").isNotNull()
    rows = vectors.where(real).select("vec_id", F.col("label").cast("long").alias("label"), F.col("code").cast("array<bigint>").alias("code"))
    few = anchors.where(real).select("vec_id", F.col("label").cast("long").alias("label"), F.col("code").cast("array<bigint>").alias("code"))
    bounds = rows.agg(F.count("*"), F.max(F.size("code")), F.min(F.array_min("code")), F.max(F.array_max("code"))).first()
    count, longest, low, high = bounds[0], bounds[1] or 0, min(bounds[2] or 0, 0), max(bounds[3] or 0, 0)
    least, most = (few.agg(F.min(F.array_min("code")), F.max(F.array_max("code"))).first() or (0, 0))[:2]
    low_anchor, high_anchor = min(least or 0, 0), max(most or 0, 0)
    fits = next((t for t, bits in (("smallint", 15), ("int", 31)) if -(1 << bits) <= min(low, low_anchor) and max(high, high_anchor) < (1 << bits)), "bigint")
    size = block_rows or max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // max(1, longest), max(LEAST_ROWS, -(-count // BLOCKS))))
    blocks = max(1, -(-count // size))
    narrow = lambda df: df.withColumn("code", F.col("code").cast(f"array<{fits}>")).withColumn("dims", F.size("code"))
    rows = narrow(rows).withColumn("block", F.pmod(F.xxhash64("vec_id", "code", "label"), F.lit(blocks)).cast("int"))
    few = narrow(few).groupBy("vec_id", "label", "dims", "code").agg(F.count("*").cast("int").alias("times")).withColumn("aid", F.xxhash64("vec_id", "label", "code"))
    few = cut_lineage(few)
    none = F.lit(None)
    candidates = rows.select("dims", "block", F.lit(CANDIDATE).alias("kind"), "vec_id", "label", "code", none.cast("long").alias("aid"), none.cast("array<bigint>").alias("positives"))

    def visiting(df: DataFrame, scores: Column) -> DataFrame:
        each = df.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return candidates.unionByName(each.select("dims", "block", F.lit(ANCHOR).alias("kind"), "vec_id", "label", "code", "aid", scores.alias("positives")))

    best = visit(visiting(few, none.cast("array<bigint>")), "aid long, score long, vec_id long", _positives(positives), low_anchor, high_anchor)
    order = Window.partitionBy("aid").orderBy(F.col("score").desc(), "vec_id")
    best = cut_lineage(best.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives))
    wanted = few.join(best.groupBy("aid").agg(F.collect_set("score").alias("scores")), "aid")  # at most ``positives`` an anchor
    found = visit(visiting(wanted, F.col("scores")), FOUND, _negatives(negatives, band), low_anchor, high_anchor)
    order = Window.partitionBy("aid", "positive_score").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    pairs = best.withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"}).join(few.select("aid", F.col("vec_id").alias("anchor_id"), "times"), "aid")
    out = pairs.join(found, ["aid", "positive_score"]).withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine_embeddings(vectors: DataFrame, every: int = 100, moved: int = 7, labels: int = 10) -> DataFrame:
    """Hard negatives of ``vectors`` (vec_id, embedding, label): anchors are the rows whose vec_id ``every`` divides;
    where ``moved`` divides vec_id, label first becomes (label + 1) % ``labels``."""
    label = F.when(F.col("vec_id") % moved == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    rows = vectors.where(whole()).select("vec_id", label.cast("long").alias("label"), integer_components().alias("code"))
    return hard_negatives(rows, rows.where(F.col("vec_id") % every == 0))
