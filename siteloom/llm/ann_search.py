"""Approximate nearest neighbours by largest inner product, with an adaptive dimension scan.

Vectors get one more component that gives all of them the length of the longest, so the nearest by
distance is the largest inner product; then all are turned by one random rotation. Lists are the
cells of k-means centres fitted on at most ``SAMPLE`` rows; every row is in a list. The number of
probed lists is the least that finds ``AIM`` of the true neighbours inside the sample.

Inside a probed list the columns are read in blocks of ``BLOCK``. After d of D columns a candidate is
given up when its partial squared distance, scaled by D / d, exceeds the query's limit by the factor
(1 + EPSILON / sqrt(d))**2: then its full distance is beyond the limit with high probability. The limit is
the distance of the query's 20th find in its nearest list. What is left is scored in double
precision from the original vectors.

Of equal vectors only the k + 1 smallest ids can be among the k nearest, so no more are scanned. Large
lists are cut into chunks and their queries into blocks, so no list is one task.

Vectors are searched among those of their length: a length of at least ``INDEXED`` rows has an index of its own, the rows of
rarer lengths are compared with all of theirs in tiles.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without a vec_id, take no part, as
queries or candidates. Rows of the query's own vec_id are never its candidates. With no
more than k candidates all are returned: lists are probed until k + 1 rows are seen. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.support import by_group
from siteloom.llm.vectors import doubles, matrix, usable
from siteloom.session import cut_lineage

K, LISTS, SAMPLE, SAMPLE_CELLS, AIM = 20, 1024, 20_000, 2_000_000, 0.97
BLOCK, EPSILON = 16, 2.1
CHUNK, QUERIES = 2048, 1024
INDEXED = 1024


class Index:
    """Rotation, centres and the number of lists to probe."""

    def __init__(self, sample: np.ndarray, longest: float, lists: int, k: int = K) -> None:
        rng = np.random.default_rng(3)
        self.longest, self.k = longest, k
        d = sample.shape[1] + 1
        self.turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        x = self.rows(sample)
        self.centres = x[rng.permutation(len(x))[:lists]].copy()
        for _ in range(8):
            near = self.nearest(x, 1)[:, 0]
            count = np.bincount(near, minlength=len(self.centres))
            total = np.zeros_like(self.centres)
            np.add.at(total, near, x)
            self.centres[count > 0] = total[count > 0] / count[count > 0, None]
        self.probes = self._probes(sample, x)

    def rows(self, v: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.longest**2 - np.einsum("nd,nd->n", v, v), 0))
        return np.concatenate([v, extra[:, None]], axis=1) @ self.turn

    def queries(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([v, np.zeros((len(v), 1))], axis=1) @ self.turn

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        out = np.empty((len(x), n), np.int64)
        for a in range(0, len(x), 4096):
            far = (self.centres**2).sum(1)[None, :] - 2 * x[a : a + 4096] @ self.centres.T
            out[a : a + 4096] = far.argmin(1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")[:, :n]
        return out

    def _probes(self, sample: np.ndarray, x: np.ndarray) -> int:
        own = self.nearest(x, 1)[:, 0]
        some = np.arange(min(256, len(x)))
        score = sample[some] @ sample.T
        score[some, some] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
        order = self.nearest(self.queries(sample[some]), len(self.centres))
        place = np.argsort(order, axis=1)  # list -> when it is probed
        found = np.take_along_axis(place, own[best], axis=1)
        for n in range(1, len(self.centres) + 1):
            if (found < n).mean() >= AIM:
                return n
        return len(self.centres)


def scan(q: np.ndarray, x: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (query row, vector row) that no block's test gives up, and the number of columns read over all pairs."""
    dims = x.shape[1]
    test = lambda d: limit * (1 + EPSILON / np.sqrt(d)) ** 2 * (d / dims) if d < dims else limit * (1 + 1e-9)
    first = min(BLOCK, dims)
    part = (q[:, :first] ** 2).sum(1)[:, None] + (x[:, :first] ** 2).sum(1)[None, :] - 2 * q[:, :first] @ x[:, :first].T
    i, j = np.nonzero(part <= test(first)[:, None])
    far, read = part[i, j], part.size * first
    for d in range(first, dims, BLOCK):
        block = slice(d, min(d + BLOCK, dims))
        for a in range(0, len(i), 65536):
            far[a : a + 65536] += ((q[i[a : a + 65536], block] - x[j[a : a + 65536], block]) ** 2).sum(1)
        read += len(i) * (block.stop - d)
        keep = far <= test(block.stop)[i]
        i, j, far = i[keep], j[keep], far[keep]
    return i, j, read


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found in ``vectors`` for each row of ``queries`` (both vec_id, embedding)."""
    good = lambda df: df.where(usable() & F.col("vec_id").isNotNull()).select("vec_id", doubles(df).alias("v"))
    rows, asked = good(vectors), good(queries)
    dims = F.size("v")
    sizes = rows.groupBy(dims.alias("dims")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))).alias("longest"))
    common = sizes.where(F.col("n") >= INDEXED).orderBy("dims").collect()  # a few lengths
    found = [indexed_search(rows.where(dims == d), asked.where(dims == d), d, n, longest, k) for d, n, longest in common]
    often = [r.dims for r in common]
    rare = rows.where(~dims.isin(often)) if often else rows
    if not often or sizes.where(F.col("n") < INDEXED).limit(1).count():
        found.append(tile_search(rare, asked.where(~dims.isin(often)) if often else asked, k))
    return functools.reduce(DataFrame.unionByName, found)


def tile_search(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The same, exactly: each tile of rows of one length gives the best of its rows for each query of that length."""
    tiles = rows.groupBy(F.size("v").alias("dims")).agg(F.ceil(F.count("*") / CHUNK).alias("tiles"))
    left = rows.withColumn("dims", F.size("v")).join(tiles, "dims").withColumn("tile", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("tiles")))
    right = asked.withColumn("dims", F.size("v")).dropDuplicates(["vec_id"]).join(tiles, "dims").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    pick = lambda df, q: df.select(F.col("dims").cast("long").alias("dims"), F.col("tile").cast("long").alias("tile"), F.lit(q).alias("q"), F.col("vec_id").alias("id"), "v")

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        q, ids, v = group.column("q").to_numpy(zero_copy_only=False), group.column("id").to_numpy(), matrix(group.column("v"))
        xid, x = ids[~q], v[~q]
        for a in range(0, int(q.sum()), 256):
            qid, score = ids[q][a : a + 256], v[q][a : a + 256] @ x.T
            for i in range(len(qid)):
                other = np.flatnonzero(xid != qid[i])
                best = other[np.lexsort((xid[other], -score[i, other]))[:k]]
                exact = np.einsum("nd,d->n", x[best], v[q][a + i]) if len(best) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), qid[i])), pa.array(xid[best]), pa.array(exact)], ["query_id", "vec_id", "score"])

    found = by_group(pick(left, False).unionByName(pick(right, True)), ["dims", "tile"], run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def indexed_search(rows: DataFrame, asked: DataFrame, dims: int, n: int, longest: float, k: int = K) -> DataFrame:
    """The same for the ``n`` rows (vec_id, v) of ``dims`` components and length ``longest`` at most."""
    cap = max(64, min(SAMPLE, SAMPLE_CELLS // dims))
    h = F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(1 << 30))
    sample = rows.where(h < int((1 << 30) * min(1.0, 1.2 * cap / n))).orderBy(h, "vec_id").limit(cap).select("v").collect()
    model = Index(np.array([r[0] for r in sample], float).reshape(-1, dims), longest, max(1, min(LISTS, round(n**0.5), len(sample) // 8)), k)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # centres and rotation: (LISTS + dims) x dims numbers at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = shared.value.nearest(shared.value.rows(matrix(batch.column(1))), 1)[:, 0] if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(near), batch.column(0), batch.column(1)], ["list", "vec_id", "v"])

    least = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= k + 1).select("vec_id", "v")
    data = cut_lineage(few.mapInArrow(assign, "list long, vec_id long, v array<double>"))
    lists = len(model.centres)
    held = np.zeros(lists, np.int64)
    for r in data.groupBy("list").count().collect():  # one number a list
        held[r[0]] = r[1]

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = shared.value
            v = matrix(batch.column(1))
            order = m.nearest(m.queries(v), lists) if batch.num_rows else np.zeros((0, lists), np.int64)
            seen = held[order].cumsum(1)
            need = np.minimum(np.maximum((seen < k + 1).sum(1) + 1, m.probes), lists)
            flat = np.concatenate([o[:c] for o, c in zip(order, need, strict=True)]) if len(order) else np.zeros(0, np.int64)
            bounds = np.concatenate([[0], need.cumsum()]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(bounds, pa.array(flat))], ["query_id", "v", "lists"])

    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v"))  # a repeated row asks once
    asked = cut_lineage(asked.mapInArrow(probes, "query_id long, v array<double>, lists array<long>"))

    def meet(wanted: DataFrame) -> DataFrame:
        """Scan ``wanted`` (query_id, v, limit, list) against the lists' rows, chunk by chunk and block by block."""
        wanted = cut_lineage(wanted)
        asks = np.zeros(lists, np.int64)
        for r in wanted.groupBy("list").count().collect():
            asks[r[0]] = r[1]
        chunks, blocks = F.array(*[F.lit(max(1, int(-(-c // CHUNK)))).cast("long") for c in held]), F.array(*[F.lit(int(-(-c // QUERIES))).cast("long") for c in asks])
        at = F.col("list").cast("int")
        left = data.withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.get(chunks, at))).where(F.get(blocks, at) > 0)
        left = left.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.get(blocks, at) - 1)))
        right = wanted.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(2)), F.get(blocks, at))).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.get(chunks, at) - 1)))
        both = left.select("list", "chunk", "block", F.lit(None).cast("double").alias("limit"), F.col("vec_id").alias("id"), "v").unionByName(right.select("list", "chunk", "block", "limit", F.col("query_id").alias("id"), "v"))

        def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
            m = shared.value
            limit = group.column("limit").to_numpy()  # null (nan) for the list's own rows
            ids, v = group.column("id").to_numpy(), matrix(group.column("v"))
            is_query = ~np.isnan(limit)
            qv, xv, qid, xid, limit = v[is_query], v[~is_query], ids[is_query], ids[~is_query], limit[is_query]
            for a in range(0, len(qid), 256):
                for b in range(0, len(xid), 4096):
                    i, j, _ = scan(m.queries(qv[a : a + 256]), m.rows(xv[b : b + 4096]), limit[a : a + 256])
                    i, j = i + a, j + b
                    other = qid[i] != xid[j]
                    i, j = i[other], j[other]
                    score = np.concatenate([np.einsum("nd,nd->n", qv[i[c : c + 65536]], xv[j[c : c + 65536]]) for c in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
                    order = np.lexsort((xid[j], -score, i))
                    i, j, score = i[order], j[order], score[order]
                    first = np.concatenate([[0], np.flatnonzero(i[1:] != i[:-1]) + 1]) if len(i) else np.zeros(0, np.int64)
                    place = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
                    top = place < k
                    yield pa.RecordBatch.from_arrays([pa.array(qid[i[top]]), pa.array(xid[j[top]]), pa.array(score[top])], ["query_id", "vec_id", "score"])

        return by_group(both, ["list", "chunk", "block"], run, "query_id long, vec_id long, score double")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    home = cut_lineage(best(meet(asked.select("query_id", "v", F.lit(float("inf")).alias("limit"), F.get("lists", F.lit(0)).alias("list")))))
    reach = home.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    rest = asked.join(reach, "query_id", "left").withColumn("limit", F.when(F.col("kth").isNull(), float("inf")).otherwise(F.greatest(square + longest**2 - 2 * F.col("kth"), F.lit(0.0))))
    rest = rest.select("query_id", "v", "limit", F.explode(F.slice("lists", 2, lists)).alias("list"))
    found = best(home.drop("rank").unionByName(meet(rest)))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
