"""N-gram Jaccard self-join of documents by a MinHash LSH forest with exact verification.

Words are runs of ASCII letters, digits, underscores and non-ASCII characters of the lower-cased
text; a shingle is five consecutive words (a shorter text is one shingle). Two documents link
when the Jaccard similarity of their shingle sets is at least ``threshold``.

1. Texts with the same word sequence form a class; only classes are compared.
2. Each class enters ``trees`` tries: per tree a path of ``depth`` min-hashes, one byte each. The rows
   (tree, path, sketch) are range-partitioned and sorted, so neighbours have the longest common prefixes and a prefix shared
   by many classes spreads over tasks. From the whole path upwards the matched prefix is shortened hash by hash: classes
   under one prefix are compared by sketch, those like a leader need no shorter prefix, and only leaders go on to
   the next one, until ``prefix_depth``, the longest prefix that meets the target recall for pairs at the threshold. Only links to
   leaders leave a task, never all pairs.
3. Connected leaders give candidate clusters. Inside a cluster exact intersections come from
   tile products of shingle incidence matrices; a large cluster is split into tiles. Tasks emit link
   counts and one spanning edge a class.

Nulls, empty texts and texts without a word link with nothing. Repeated rows are members of one
class and link with each other.

A link can be missed in three ways, all below the forest's own chance of 1.5e-5 for a pair exactly at the threshold (far less above it):
no tree has the pair under one prefix; fewer than ``AGREE`` of its ``SKETCH`` sketch bytes are equal (1.2e-6 at the threshold); or,
in every tree where it meets, both are followers of leaders that neither shares with the other and nothing else joins their clusters.

Texts are cut into slices of whole rows: a text of n bytes needs some 60 n bytes of memory in its task. Ties have no meaning; the smallest
doc_id names a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.components import components
from siteloom.llm.support import U64, by_group, chunks, mix, prefix_hash, raw_bytes, span_hash
from siteloom.session import cut_lineage

WORDS, THRESHOLD = 5, 0.8
#: A path is a long: the tree's number and ``DEPTH`` min-hashes of one byte.
TREES, DEPTH, RECALL = 28, 7, 0.9999
SKETCH = 32
#: Sketch bytes out of SKETCH that must be equal before exact verification: over five standard deviations below the threshold.
AGREE = 14
TILE_ROWS, TILE_SHINGLES = 512, 400_000

_word = np.zeros(256, bool)
_word[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_step = mix(np.arange(1, 65, dtype=np.uint64)) | U64(1)


def prefix_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """Longest prefix at which a pair at the threshold meets in some tree with the wanted probability."""
    for d in range(depth, 0, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    raise ValueError("no prefix length reaches the target recall; use more trees")


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 31, n, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.int64).astype(np.uint32)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, their n + 1 row bounds, word counts, and a hash of each whole word sequence."""
    is_word = np.zeros(len(data) + 2, bool)
    is_word[1:-1] = _word[data]
    edge = is_word[1:] != is_word[:-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    split = np.unique(inner[is_word[inner] & is_word[inner + 1]])  # a word never crosses a row
    start = np.union1d(np.flatnonzero(edge & is_word[1:]), split)
    end = np.union1d(np.flatnonzero(edge & is_word[:-1]), split)
    word = span_hash(prefix_hash(data), start, end)
    first = np.searchsorted(start, offsets)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(word)) - first[row]
    at = np.zeros(len(word) + 1, U64)
    np.cumsum(mix(word + mix(place.astype(U64))), out=at[1:])
    sequence = mix((at[first[1:]] - at[first[:-1]]) ^ mix(counts.astype(U64)))
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(made, out=bounds[1:])
    owner = np.repeat(np.arange(len(counts)), made)
    begin = first[owner] + np.arange(bounds[-1]) - bounds[owner]
    out = np.zeros(bounds[-1], U64)
    have = np.minimum(counts[owner], n)
    for k in range(n):
        ok = have > k
        out[ok] += word[begin[ok] + k] * _step[k]
    return mix(out + have.astype(U64)), bounds, counts, sequence


def signatures(docs: DataFrame, words: int = WORDS, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(doc_id, th, cid, n_sh, paths array<long>, sketch binary) per row; cid is null where the text has no word."""
    a, b = _hash_family(trees * depth + SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                part = data[offsets[lo] : offsets[hi]]
                sh, bounds, counts, seq = shingle_hashes(part, offsets[lo : hi + 1] - offsets[lo], words)
                full = np.flatnonzero(counts > 0)
                sig = np.zeros((hi - lo, len(a)), np.uint32)
                if len(full):
                    x, starts = (sh >> U64(32)).astype(np.uint32), bounds[full]
                    for i in range(len(a)):
                        sig[full, i] = np.minimum.reduceat(x * a[i] + b[i], starts)
                paths = np.zeros((hi - lo, trees), U64) + np.arange(trees, dtype=np.uint64)
                for d in range(depth):
                    paths = paths << U64(8) | mix(sig[:, d : trees * depth : depth].astype(U64) + U64(d + 1)) >> U64(56)
                sketch = np.ascontiguousarray((mix(sig[:, trees * depth :].astype(U64)) >> U64(56)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(2).slice(lo, hi - lo),
                        pa.array(seq.view(np.int64), mask=counts == 0),
                        pa.array(np.diff(bounds)),
                        pa.ListArray.from_arrays(np.arange(0, (hi - lo + 1) * trees, trees, dtype=np.int32), pa.array(paths.view(np.int64).ravel())),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(SKETCH), hi - lo, [None, pa.py_buffer(sketch)]).cast(pa.binary()),
                    ],
                    ["doc_id", "th", "cid", "n_sh", "paths", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.lower(F.col("text")), F.xxhash64("text")).mapInArrow(run, "doc_id long, th long, cid long, n_sh long, paths array<long>, sketch binary")


def _linked(sketch: np.ndarray, other: np.ndarray) -> np.ndarray:
    hits = np.zeros((len(sketch), len(other)), np.uint8)
    for k in range(sketch.shape[1]):
        hits += sketch[:, k, None] == other[None, :, k]
    return hits >= AGREE


def _leaders(ids: np.ndarray, sketch: np.ndarray, edges: list) -> np.ndarray:
    """Adds an edge from each member to a leader like it, and between leaders it has in common; returns the leaders' places.

    Members come in trie order and meet the leaders so far in blocks; those like none become leaders. Then all
    members meet all leaders, also those found after them.
    """
    lead = np.zeros(1, np.int64)
    for at in range(1, len(ids), 256):
        left = at + np.flatnonzero(~_linked(sketch[at : at + 256], sketch[lead]).any(1))
        while len(left):  # the first that is left leads, those like it follow
            lead = np.append(lead, left[0])
            left = left[~_linked(sketch[left], sketch[left[:1]])[:, 0]]
    for at in range(0, len(ids), 256):
        near = _linked(sketch[at : at + 256], sketch[lead])
        x, y = np.nonzero(near)
        home = near.argmax(1)[x]  # one edge a member; leaders that share a member are linked once
        own = at + x[y == home]
        follows = own != lead[home[y == home]]
        edges.append((ids[own[follows]], ids[lead[home[y == home]][follows]]))
        shared = np.unique(np.stack([home, y], 1)[y != home], axis=0)
        edges.append((ids[lead[shared[:, 0]]], ids[lead[shared[:, 1]]]))
    return lead


def _climb(path: np.ndarray, ids: np.ndarray, sketch: np.ndarray, edges: list, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Path, id and sketch of the leaders of sorted rows that share all but the last ``short`` hashes of their paths.

    Rows of one whole path are settled first; their leaders meet those of neighbours under a prefix shorter by one hash, and so on.
    """
    for cut in range(short + 1):
        if len(ids) == 1:
            break
        prefix = path >> (8 * cut)
        bounds = np.concatenate([[0], np.flatnonzero(prefix[1:] != prefix[:-1]) + 1, [len(prefix)]])
        many = np.flatnonzero(np.diff(bounds) > 1)
        if not len(many):
            continue
        keep = np.zeros(len(ids), bool)
        keep[bounds[:-1][np.diff(bounds) == 1]] = True
        for g in many:
            a, b = bounds[g], bounds[g + 1]
            keep[a + _leaders(ids[a:b], sketch[a:b], edges)] = True
        path, ids, sketch = path[keep], ids[keep], sketch[keep]
    return path, ids, sketch


def forest_edges(classes: DataFrame, short: int = DEPTH - 5) -> DataFrame:
    """Edges (a, b) between classes that stand under one prefix of a tree and look alike by sketch.

    Rows (path, sketch) are range-partitioned by sampled splitters and sorted; ``short`` is the number of hashes that a
    prefix may lack. A prefix that spans partitions is joined up by its leaders, of which each partition hands on its first and
    last prefix's.
    """
    schema = "a long, b long, prefix long, sketch binary"

    def emit(edges: list, border: list) -> Iterator[pa.RecordBatch]:
        if edges:
            pairs = np.unique(np.concatenate([np.stack([np.maximum(x, y), np.minimum(x, y)], 1) for x, y in edges]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64()), pa.nulls(len(pairs), pa.binary())], ["a", "b", "prefix", "sketch"])
        for path, lead, sketch in border:
            yield pa.RecordBatch.from_arrays([pa.array(lead), pa.nulls(len(lead), pa.int64()), pa.array(path >> (8 * short)), pa.array([x.tobytes() for x in sketch], pa.binary())], ["a", "b", "prefix", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list = []
        border: list = []
        carry = None  # paths, leaders and their sketches, of the prefix that may go on in the next batch
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            path, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            data, _ = raw_bytes(batch.column(1))
            sketch = data.reshape(-1, SKETCH)
            if carry is not None and carry[0][0] >> (8 * short) == path[0] >> (8 * short):
                path, ids, sketch = (np.concatenate([x, y]) for x, y in zip(carry, (path, ids, sketch), strict=True))
            elif carry is not None and first:
                border.append(carry)
                first = False
            prefix = path >> (8 * short)
            bounds = np.concatenate([[0], np.flatnonzero(prefix[1:] != prefix[:-1]) + 1, [len(prefix)]])
            sizes = np.diff(bounds)
            for size in range(2, 5):  # the many small groups, all of one size at once: all their pairs
                at = bounds[:-1][:-1][sizes[:-1] == size]
                for i in range(size):
                    for j in range(i):
                        near = (sketch[at + i] == sketch[at + j]).sum(1) >= AGREE
                        edges.append((ids[at + i][near], ids[at + j][near]))
            for g in np.flatnonzero(sizes[:-1] > 4):
                a, b = bounds[g], bounds[g + 1]
                _climb(path[a:b], ids[a:b], sketch[a:b], edges, short)
            if first and len(sizes) > 1:
                b = bounds[1]
                border.append(_climb(path[:b], ids[:b], sketch[:b], edges, short))
                first = False
            a = bounds[-2]
            carry = _climb(path[a:], ids[a:], sketch[a:], edges, short)
            yield from emit(edges, [])
            edges = []
        if carry is not None:
            yield from emit(edges, [*border, carry])

    rows = classes.select(F.explode("paths").alias("path"), "sketch", "cid")
    found = cut_lineage(rows.repartitionByRange("path", "sketch", "cid").sortWithinPartitions("path", "sketch", "cid").mapInArrow(run, schema))

    def border_edges(group: pa.Table) -> Iterator[pa.RecordBatch]:
        data, _ = raw_bytes(group.column("sketch"))
        edges: list = []
        _leaders(group.column("a").to_numpy(), data.reshape(-1, SKETCH), edges)
        yield from emit(edges, [])

    # only prefixes that lie on both sides of a border
    border = found.where("prefix is not null").distinct()
    shared = border.groupBy("prefix").count().where("count > 1").select("prefix")
    across = by_group(border.join(shared, "prefix"), ["prefix"], border_edges, schema)
    return found.where("b is not null").select("a", "b").unionByName(across.where("b is not null").select("a", "b")).distinct()


def _intersections(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Exact sizes of all pairwise intersections of the rows' shingle sets, by blocks of shared shingles."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    order = np.argsort(values, kind="stable")
    v, r = values[order], row[order]
    new = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, bool)
    code = np.cumsum(new) - 1
    often = np.bincount(code, minlength=1) >= 2
    keep = often[code]
    code, r = (np.cumsum(often) - 1)[code[keep]], r[keep]
    width = int(often.sum())
    out = np.zeros((n, n), np.float32)
    block = max(256, 4_000_000 // n)
    at = np.searchsorted(code, np.arange(0, width + block, block))
    for k in range(len(at) - 1):
        a, b = at[k], at[k + 1]
        if b > a:
            x = np.zeros((n, block), np.float32)
            x[r[a:b], code[a:b] - k * block] = 1
            out += x @ x.T
    return out


def _row_key(doc_id: str, text_hash: Column) -> Column:
    """Names a row also where its id is null or repeated."""
    return F.struct(F.coalesce(F.col(doc_id), F.lit(-(1 << 63))).alias("id"), text_hash.alias("th")).alias("key")


def _verify(threshold: float):
    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, tile = group.column("cid").to_numpy(), group.column("tile").to_numpy()
        _, once = np.unique(ids, return_index=True)  # a repeated doc_id can bring a class twice
        group, ids, tile = group.take(pa.array(once)), ids[once], tile[once]
        weight = group.column("weight").to_numpy()
        data, offsets = raw_bytes(group.column("shingles"))
        bounds, values = offsets // 8, np.frombuffer(data.tobytes(), U64)
        common = _intersections(bounds, values)
        size = np.diff(bounds).astype(np.float64)
        link = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
        np.fill_diagonal(link, False)
        if group.column("t")[0].as_py() != group.column("u")[0].as_py():
            link &= tile[:, None] != tile[None, :]
        root = np.arange(len(ids))
        while True:  # the smallest class reachable inside this tile pair
            least = np.where(link, root[None, :], len(ids)).min(1, initial=len(ids))
            now = np.minimum(root, least)
            now = now[now]
            if (now == root).all():
                break
            root = now
        links = (link * weight[None, :]).sum(1)
        use = np.flatnonzero(links > 0)
        yield pa.RecordBatch.from_arrays([pa.array(ids[use]), pa.array(links[use].astype(np.int64)), pa.array(ids[root[use]])], ["cid", "links", "root"])

    return run


def linked_classes(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """(doc_id, th, component, class_id, n_links) for every row of ``docs`` (doc_id, text).

    th is xxhash64 of the text; component names the rows connected by links, null where the text has no word.
    """
    docs = docs.select("doc_id", "text")
    short = depth - prefix_depth(threshold, trees, depth, recall)
    sig = cut_lineage(signatures(docs, words, trees, depth))
    found = sig.where("cid is not null")
    named = F.max(F.struct("doc_id", "th"))  # one row whose text stands for the class
    classes = found.groupBy("cid").agg(F.count("*").alias("weight"), F.min("doc_id").alias("least"), F.first("n_sh").alias("n_sh"), named.alias("r"))
    classes = classes.select("cid", "weight", "least", "n_sh", _row_key("r.doc_id", F.col("r.th")))
    distinct = found.dropDuplicates(["cid"]).select("cid", "paths", "sketch")
    clusters = components(forest_edges(distinct, short)).select(F.col("node").alias("cid"), F.col("component").alias("cluster"))
    member = cut_lineage(classes.join(clusters, "cid"))
    size = member.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / TILE_ROWS), F.ceil(F.sum("n_sh") / TILE_SHINGLES)).cast("int").alias("tiles"))
    member = cut_lineage(member.join(size, "cluster").withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("long")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_bytes(batch.column(0))
            want = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in chunks(offsets):
                sh, bounds, _, seq = shingle_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)
                use = np.flatnonzero(seq.view(np.int64) == want[lo:hi])
                packed = [np.unique(sh[bounds[i] : bounds[i + 1]]).tobytes() for i in use]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo).take(pa.array(use)) for k in range(1, 6)), pa.array(packed, pa.binary())], ["cid", "weight", "cluster", "tile", "tiles", "shingles"])

    texts = docs.select("text", _row_key("doc_id", F.xxhash64("text"))).join(member.select("cid", "weight", "cluster", "tile", "tiles", F.col("key")), "key")
    shingled = texts.select(F.lower("text"), "cid", "weight", "cluster", "tile", "tiles").mapInArrow(sets, "cid long, weight long, cluster long, tile long, tiles int, shingles binary")
    pairs = shingled.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    pairs = pairs.select("cid", "weight", "cluster", "tile", "shingles", F.least("tile", "other").alias("t"), F.greatest("tile", "other").cast("long").alias("u"))
    verified = cut_lineage(by_group(pairs, ["cluster", "t", "u"], _verify(threshold), "cid long, links long, root long"))
    links = verified.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = components(verified.select(F.col("cid").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("cid"), "component")
    whole = classes.join(links, "cid", "left").join(joined, "cid", "left").select("cid", "weight", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cid").alias("component"))
    named = whole.groupBy("component").agg(F.min("least").alias("class_id"))
    whole = cut_lineage(whole.join(named, "component").select("cid", "weight", "links", "component", "class_id"))
    out = found.select("doc_id", "th", "cid").join(whole, "cid").select("doc_id", "th", "component", "class_id", (F.col("links") + F.col("weight") - 1).alias("n_links"))
    return out.unionByName(sig.where("cid is null").select("doc_id", "th", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def ngram_jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links) for every row of ``docs`` (doc_id, text).

    class_id is the smallest doc_id of the rows connected by links, n_links the number of other
    rows linked directly. Rows with a null doc_id take part; their class_id is null if no other
    row of the class has an id. An empty table gives an empty result.
    """
    return linked_classes(docs, threshold, words, trees, depth, recall).select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` less all but one of each group of linked rows: the one with the smallest doc_id, then text hash.

    Rows without a word stay.
    """
    linked = cut_lineage(linked_classes(docs, threshold).select("doc_id", "th", "component"))
    named = linked.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("k"))
    kept = cut_lineage(named.select("k.doc_id", "k.th").unionByName(linked.where("component is null").select("doc_id", "th").distinct()))
    twice = linked.where("component is not null").groupBy("doc_id", "th").count().where("count > 1").limit(1).count() > 0
    th = F.xxhash64("text")
    out = docs.join(kept.alias("k"), docs["doc_id"].eqNullSafe(F.col("k.doc_id")) & (th == F.col("k.th")), "left_semi").select(*docs.columns)
    return out.dropDuplicates(["doc_id", "text"]) if twice else out
