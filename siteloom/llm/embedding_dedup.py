"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Only vectors of equal, non-null label are compared, by cosine. Equal vectors of a label form a class
and one of them stands for it. The classes of a label are dealt to tiles of about ``TILE`` rows, sent in the type they came in
once for each tile they meet; each pair of tiles is one task, worked on in blocks of ``BLOCK`` rows: vectors are scaled to unit length and quantised to int8, x = s q
+ e with |e| known, and a product of two int8 matrices gives every cosine to within
|e_x| |s_y q_y| + |s_x q_x| |e_y| + |e_x| |e_y|. Pairs whose bound reaches the threshold are recomputed from
the original vectors in double precision. A task emits link counts and one spanning edge a class, never
pairs; a label with a third of all rows is many tile pairs like any other.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label,
link with nothing. Labels are compared as they are, of whatever type. Vectors of different lengths never link. Repeated rows (also of one vec_id) are members
of one class. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.components import components
from siteloom.llm.support import by_group
from siteloom.llm.vectors import matrix, usable
from siteloom.session import cut_lineage

THRESHOLD, TILE, BLOCK = 0.93, 4096, 1024


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, lengths of the quantised rows, and bounds of the lost parts' lengths."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    slack = 1 + 1e-12  # above the rounding of these few double operations
    return q, scale, np.linalg.norm(back, axis=1) * slack, np.linalg.norm(unit - back, axis=1) * slack + 1e-15


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Row pairs (i of x, j of y) with cosine >= threshold, i > j if both are the same tile; and how many were recomputed."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    qx, sx, lx, ex = quantised(x / nx[:, None])
    qy, sy, ly, ey = quantised(y / ny[:, None])
    # int8 products sum exactly in float32 as long as 127**2 * columns stays below 2**24
    product = np.zeros((len(x), len(y)), np.float64)
    for c in range(0, x.shape[1], 1024):
        product += qx[:, c : c + 1024].astype(np.float32) @ qy[:, c : c + 1024].astype(np.float32).T
    product *= sx[:, None] * sy[None, :]
    bound = product + ex[:, None] * ly[None, :] + lx[:, None] * ey[None, :] + ex[:, None] * ey[None, :]
    maybe = bound >= threshold - 1e-9
    if same:
        maybe &= np.tri(len(x), k=-1, dtype=bool)
    i, j = np.nonzero(maybe)
    exact = np.concatenate([np.einsum("nd,nd->n", x[i[a : a + 65536]], y[j[a : a + 65536]]) / (nx[i[a : a + 65536]] * ny[j[a : a + 65536]]) for a in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
    ok = exact >= threshold
    return i[ok], j[ok], len(i)


def link_embeddings(vectors: DataFrame, threshold: float = THRESHOLD, tile_rows: int = TILE, block_rows: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding, label)."""
    # 64-bit names of labels: two different ones coincide with probability 2**-64
    label = F.when(F.col("label").isNotNull(), F.xxhash64("label"))
    rows = vectors.select("vec_id", label.alias("label"), "embedding", (usable() & F.col("label").isNotNull()).alias("_ok"))
    kind = dict(vectors.dtypes)["embedding"].removeprefix("array<").removesuffix(">")
    narrow = F.transform("embedding", lambda x: x + F.lit(0).cast(kind))  # -0.0 and 0.0 are one value
    good = rows.where("_ok").select("vec_id", "label", narrow.alias("v"))
    good = good.select("vec_id", "label", F.size("v").alias("dims"), F.xxhash64("label", "v").alias("cid"), "v")
    # one row a class: 64-bit name of (label, vector)
    classes = cut_lineage(good.groupBy("cid").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("dims").alias("dims"), F.first("v").alias("v")))
    tiles = classes.groupBy("label", "dims").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles"))
    dealt = classes.join(tiles, ["label", "dims"]).withColumn("tile", F.pmod("cid", F.col("tiles")).cast("long"))
    dealt = dealt.select("label", F.col("dims").cast("long").alias("dims"), "cid", "weight", "v", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    dealt = dealt.select("label", "dims", F.least("tile", F.col("other").cast("long")).alias("t"), F.greatest("tile", F.col("other").cast("long")).alias("u"), "tile", "cid", "weight", "v")

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        t, u = group.column("t")[0].as_py(), group.column("u")[0].as_py()
        ids, weight, tile = (group.column(c).to_numpy() for c in ("cid", "weight", "tile"))
        v = matrix(group.column("v"))
        a = np.flatnonzero(tile == t)
        b = np.flatnonzero(tile == u)
        links, root = np.zeros(len(ids)), np.arange(len(ids))
        for x in range(0, len(a), block_rows):
            for y in range(0, x + 1 if t == u else len(b), block_rows):
                i, j, _ = close_pairs(v[a[x : x + block_rows]], v[b[y : y + block_rows]], threshold, t == u and x == y)
                i, j = a[x + i], b[y + j]
                links += np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
                # joins the pairs' trees: the roots of either end take the smaller one until both ends agree
                while True:
                    while (root[root] != root).any():
                        root = root[root]
                    p, q = root[i], root[j]
                    apart = p != q
                    if not apart.any():
                        break
                    np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        use = np.flatnonzero(links > 0)
        yield pa.RecordBatch.from_arrays([pa.array(ids[use]), pa.array(links[use].astype(np.int64)), pa.array(ids[root[use]])], ["cid", "links", "root"])

    found = cut_lineage(by_group(dealt, ["label", "dims", "t", "u"], run, "cid long, links long, root long"))
    joined = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("cid"), "component")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    whole = classes.select("cid", "least", "weight").join(links, "cid", "left").join(joined, "cid", "left")
    whole = whole.select("cid", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    whole = cut_lineage(whole.join(whole.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("cid", "n_links", "component_id"))
    out = good.select("vec_id", "cid").join(whole, "cid").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("_ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
