"""Exact removal of long repeated substrings by a sampled, range-partitioned suffix table.

Each byte covered by a string of ``LENGTH`` bytes that also starts anywhere else goes; strings never
cross documents and are judged on the input.

A table of all suffixes would be many times the input, so only anchored suffixes are kept. The anchor of
a start s is the position of the least k-gram hash in [s, s + WINDOW), leftmost on ties: it depends on nothing but the
string, so equal strings have their anchors at the same place and meet at equal anchored suffixes.
About one position in WINDOW / 2 is an anchor; it owns the consecutive starts [lo, hi] that lead to it.

1. Anchored suffixes (leading bytes, fingerprint of the LENGTH - WINDOW + 1 bytes that every string of
   the anchor holds, fingerprint of its whole block of strings) are dealt by splitters sampled from the
   suffixes' leading bytes and sorted bucket by bucket, word by word. Splitters never part equal suffixes,
   so nothing is left to compare across buckets. A block that occurs twice is a repeat as a whole.
2. Blocks that meet others under one suffix but equal none are looked at string by string: the fingerprints
   of their strings, and of one block of each repeated kind beside them, are dealt and sorted likewise.
   Of a suffix with more than ``TOGETHER`` kinds in one slice every kind is looked at.

Before anything is dealt, a task settles what repeats inside its own slice and hands on one entry of
it, so a passage in a third of all documents sends a few entries a task, not one a document.

Fingerprints have 64 bits. Null text is empty. Texts shorter than LENGTH stay whole. Repeated rows
repeat each other's text and lose it where long enough. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.support import POWERS, U64, by_group, chunks, mix, prefix_hash, raw_bytes, span_hash, text_or_empty
from siteloom.session import cut_lineage

LENGTH, WINDOW, GRAM = 400, 128, 16
BUCKET_BYTES, FLUSH, TOGETHER = 16 << 20, 250_000, 8
SAMPLE_KEYS = 65_536
REPEAT, LOOK = 1, 2  # marks of an anchor: its block repeats; its strings must be looked at
TWICE, MORE = 1, 2  # flags of a sent block: it repeats in its slice; the slice has held back other blocks of its suffix


def anchors(data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors in ``data`` and their first and last starts."""
    n, window = len(data), min(WINDOW, length - GRAM + 1)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none
    _, down = POWERS.upto(n + 1)
    m = n - GRAM + 1
    value = mix((prefix[GRAM:] - prefix[:-GRAM]) * down[:m])
    value = (value & U64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    padded = np.full(-(-m // window) * window, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = value
    blocks = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    turns = np.zeros(n + 1, np.int8)
    size = np.diff(offsets)
    fits = size >= length
    turns[offsets[:-1][fits]] += 1
    turns[offsets[1:][fits] - length + 1] -= 1
    start = np.flatnonzero(np.cumsum(turns[:-1], dtype=np.int8))
    if not len(start):
        return none, none, none
    at = (np.minimum(behind[start], ahead[start + window - 1]) & U64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    return at[first], start[first], start[last]


def described(data: np.ndarray, prefix: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order key, fingerprint of the shared bytes, fingerprint of the block) of each anchor; keys sort like the suffixes' leading bytes."""
    window = min(WINDOW, length - GRAM + 1)
    shared = span_hash(prefix, at, at + length - window + 1)
    block = mix(span_hash(prefix, lo, hi + length) + mix(((at - lo) << 16 | (hi - at + length)).astype(np.uint64)))
    lead = np.zeros(len(at), np.uint64)
    for k in range(5):
        lead = lead << U64(8) | data[at + k].astype(np.uint64)
    return lead << U64(24) | shared >> U64(40), shared, block


def _pack(*columns: np.ndarray) -> bytes:
    return b"".join(c.tobytes() for c in columns)


class Dealer:
    """Collects entries of one task, settles them slice by slice, and deals what is left to buckets as packed rows."""

    def __init__(self, splitters: np.ndarray, settle: Callable) -> None:
        self.splitters, self.settle, self.held, self.count = splitters, settle, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            self.held.append(columns)
            self.count += len(columns[0])
        if self.count >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.count:
            return
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        self.held, self.count = [], 0
        key, entries, marks = self.settle(*columns)
        bucket = np.searchsorted(self.splitters, key, "right")
        order = np.argsort(bucket, kind="stable")
        entries = [c[order] for c in entries]
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        bounds = [0, *cuts.tolist(), len(order)] if len(order) else [0]
        rows = [(int(bucket[order[a]]), 0, _pack(*(c[a:b] for c in entries))) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        if len(marks[0]):  # already settled: passes through any bucket
            rows.append((int(marks[0][0]) % (len(self.splitters) + 1), 1, _pack(*marks)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["bucket", "settled", "entries"])


PACKED = "bucket long, settled int, entries binary"


def _unpack(group: pa.Table, settled: int, types: list) -> list[np.ndarray]:
    size = sum(np.dtype(t).itemsize for t in types)
    parts = []
    for flag, raw in zip(group.column("settled").to_pylist(), group.column("entries").to_pylist(), strict=True):
        if flag == settled:
            n, at, got = len(raw) // size, 0, []
            for t in types:
                got.append(np.frombuffer(raw, t, n, at))
                at += n * np.dtype(t).itemsize
            parts.append(got)
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in types]


def _first(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of the sorted keys begins."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def _settle_anchors(key, shared, block, rid, at):
    order = np.lexsort((block, shared))
    key, shared, block, rid, at = (c[order] for c in (key, shared, block, rid, at))
    kind, suffix = _first(shared, block), _first(shared)
    kinds = np.flatnonzero(kind)
    many = np.diff(np.append(kinds, len(kind))) >= 2
    repeated = np.repeat(many, np.diff(np.append(kinds, len(kind))))
    # one entry a block; of a suffix with many blocks only the first few, which say that there are more
    nth = np.cumsum(kind) - 1
    base = nth[suffix][np.cumsum(suffix) - 1]
    over = nth - base >= TOGETHER
    send = kind & ~over
    more = np.bincount(np.cumsum(suffix) - 1, over)[np.cumsum(suffix) - 1] > 0
    mark = np.where(repeated & ~send, REPEAT, 0) | np.where(kind & over, LOOK, 0)
    out = mark > 0
    return key[send], [shared[send], block[send], rid[send], at[send], np.where(repeated[send], TWICE, 0).astype(np.uint8) | np.where(more[send], MORE, 0).astype(np.uint8)], [rid[out], at[out], mark[out].astype(np.uint8)]


ANCHOR_TYPES = [np.uint64, np.uint64, np.int64, np.uint32, np.uint8]
MARK_TYPES = [np.int64, np.uint32, np.uint8]


def _anchor_bucket(group: pa.Table) -> Iterator[pa.RecordBatch]:
    shared, block, rid, at, flags = _unpack(group, 0, ANCHOR_TYPES)
    order = np.lexsort((flags, block, shared))
    shared, block, rid, at, flags = (c[order] for c in (shared, block, rid, at, flags))
    twice = (flags & TWICE) > 0
    kind, suffix = _first(shared, block), _first(shared)
    kinds, group_of = np.flatnonzero(kind), np.cumsum(suffix) - 1
    repeated = (np.add.reduceat(twice.astype(np.int64), kinds) > 0) | (np.diff(np.append(kinds, len(kind))) >= 2) if len(kinds) else np.zeros(0, bool)
    blocks, lone = np.bincount(group_of[kinds], minlength=1), np.bincount(group_of[kinds], ~repeated, minlength=1)
    # blocks that a slice held back are looked at there, so those they may meet must be too
    held = np.bincount(group_of, (flags & MORE) > 0, minlength=1)
    look = ((blocks >= 2) & (lone > 0)) | (held > 0)
    each = np.repeat(repeated, np.diff(np.append(kinds, len(kind))))
    mark = np.where(each, REPEAT, 0) | np.where(kind & look[group_of], LOOK, 0) if len(kind) else np.zeros(0, np.int64)
    out = mark > 0
    more = _unpack(group, 1, MARK_TYPES)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([rid[out], more[0]])), pa.array(np.concatenate([at[out], more[1]]).astype(np.int64)), pa.array(np.concatenate([mark[out], more[2]]).astype(np.int32))], ["rid", "at", "mark"])


def _settle_strings(key, rid, start):
    order = np.argsort(key, kind="stable")
    key, rid, start = key[order], rid[order], start[order]
    new = _first(key)
    size = np.diff(np.append(np.flatnonzero(new), len(new)))
    repeated = np.repeat(size >= 2, size)
    settled = repeated & ~new
    return key[new], [key[new], rid[new], start[new], repeated[new].astype(np.uint8)], [rid[settled], start[settled]]


STRING_TYPES = [np.uint64, np.int64, np.uint32, np.uint8]


def _string_bucket(group: pa.Table) -> Iterator[pa.RecordBatch]:
    key, rid, start, twice = _unpack(group, 0, STRING_TYPES)
    order = np.argsort(key, kind="stable")
    key, rid, start, twice = key[order], rid[order], start[order], twice[order]
    new = _first(key)
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(new)))
    repeated = np.repeat((size >= 2) | (np.add.reduceat(twice.astype(np.int64), at) > 0), size) if len(at) else np.zeros(0, bool)
    more = _unpack(group, 1, [np.int64, np.uint32])
    rid, start = np.concatenate([rid[repeated], more[0]]), np.concatenate([start[repeated], more[1]]).astype(np.int64)
    order = np.lexsort((start, rid))
    rid, start = rid[order], start[order]
    new = np.ones(len(rid), bool)
    new[1:] = (rid[1:] != rid[:-1]) | (start[1:] > start[:-1] + LENGTH)  # strings that overlap or touch are one span
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(rid)) - 1 if len(a) else a
    yield pa.RecordBatch.from_arrays([pa.array(rid[a]), pa.array(start[a]), pa.array(start[b])], ["rid", "lo", "hi"])


def _members(column: pa.Array, fields: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row number and fields of every element of a column of lists of structs."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column)
    return np.repeat(np.arange(len(column)), size), [flat.field(f).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, np.int64) for f in fields]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, text, rid, marks, runs): what step 1 and 2 found, by row."""
    keyed = docs.select("doc_id", text_or_empty().alias("text"), F.xxhash64("doc_id", "text").alias("rid"))
    total, rows = keyed.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    buckets = max(64, int(-(-(total or 0) // BUCKET_BYTES)))

    def every(batch: pa.RecordBatch, column: int):
        data, offsets = raw_bytes(batch.column(column))
        for lo, hi in chunks(offsets):
            part, bounds = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            prefix = prefix_hash(part)
            yield lo, hi, part, bounds, prefix, *anchors(part, bounds, prefix)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, part, _, prefix, at, first, last in every(batch, 0):
                yield pa.RecordBatch.from_arrays([pa.array(described(part, prefix, at, first, last)[0].view(np.int64))], ["key"])

    h = F.pmod(F.xxhash64("rid", F.lit(4)), F.lit(1 << 30))
    few = keyed.where(h < int((1 << 30) * min(1.0, SAMPLE_KEYS / 32 / max(rows, 1)))).select("text").mapInArrow(keys, "key long")
    sample = np.sort(np.array([r[0] for r in few.orderBy(F.xxhash64("key")).limit(SAMPLE_KEYS).collect()], np.int64).view(np.uint64))
    splitters = np.unique(sample[np.linspace(0, len(sample) - 1, min(buckets, len(sample)) + 1).astype(int)[1:-1]]) if len(sample) > 2 else np.zeros(0, np.uint64)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(splitters, _settle_anchors)
        for batch in batches:
            rid = batch.column(1).to_numpy()
            for lo, _, part, bounds, prefix, at, first, last in every(batch, 0):
                row = np.searchsorted(bounds, at, "right") - 1
                yield from dealer.add(*described(part, prefix, at, first, last), rid[lo + row], (at - bounds[row]).astype(np.uint32))
        yield from dealer.flush()

    marks = by_group(keyed.select("text", "rid").mapInArrow(suffixes, PACKED), ["bucket"], _anchor_bucket, "rid long, at long, mark int")
    marks = cut_lineage(marks.groupBy("rid").agg(F.collect_list(F.struct("at", "mark")).alias("marks")))
    even = (np.arange(1, buckets, dtype=np.float64) / buckets * 2.0**64).astype(np.uint64)  # fingerprints are uniform

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(even, _settle_strings)
        for batch in batches:
            rid = batch.column(1).to_numpy()
            row, (where, mark) = _members(batch.column(3), ["at", "mark"])
            look = (mark & LOOK) > 0
            row, where = row[look], where[look]
            for lo, hi, part, bounds, prefix, at, first, last in every(batch, 2):
                mine = (row >= lo) & (row < hi)
                wanted = np.unique(bounds[row[mine] - lo] + where[mine])
                pick = np.searchsorted(at, wanted)
                a, b = first[pick], last[pick]
                size = b - a + 1
                for c in range(0, len(a), 2048):
                    n = size[c : c + 2048]
                    start = np.repeat(a[c : c + 2048], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    owner = np.searchsorted(bounds, start, "right") - 1
                    yield from dealer.add(span_hash(prefix, start, start + LENGTH), rid[lo + owner], (start - bounds[owner]).astype(np.uint32))
        yield from dealer.flush()

    known = keyed.join(marks, "rid").select("doc_id", "rid", "text", "marks")
    runs = by_group(known.mapInArrow(strings, PACKED), ["bucket"], _string_bucket, "rid long, lo long, hi long")
    runs = runs.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    return keyed.join(marks, "rid", "left").join(runs, "rid", "left").select("doc_id", "rid", "text", "marks", "runs")


def remove_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) per row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_bytes(batch.column(2))
            mark_row, (where, mark) = _members(batch.column(3), ["at", "mark"])
            whole = (mark & REPEAT) > 0
            mark_row, where = mark_row[whole], where[whole]
            run_row, (run_lo, run_hi) = _members(batch.column(4), ["lo", "hi"])
            for lo, hi in chunks(offsets):
                part, bounds = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                turns = np.zeros(len(part) + 1, np.int64)
                mine = (mark_row >= lo) & (mark_row < hi)
                if mine.any():
                    at, first, last = anchors(part, bounds, prefix_hash(part))
                    pick = np.searchsorted(at, np.unique(bounds[mark_row[mine] - lo] + where[mine]))
                    np.add.at(turns, first[pick], 1)
                    np.add.at(turns, last[pick] + LENGTH, -1)
                mine = (run_row >= lo) & (run_row < hi)
                base = bounds[run_row[mine] - lo]
                np.add.at(turns, base + run_lo[mine], 1)
                np.add.at(turns, base + run_hi[mine] + LENGTH, -1)
                gone = np.cumsum(turns[:-1]) > 0
                size = np.diff(bounds)
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[bounds[1:]] - total[bounds[:-1]]
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                inner = bounds[:-1][size > 0]
                begins[inner] = gone[inner]
                total = np.concatenate([[0], np.cumsum(begins)])
                spans = total[bounds[1:]] - total[bounds[:-1]]
                kept = [part[a:b].tobytes() if not r else part[a:b][~gone[a:b]].tobytes() for a, b, r in zip(bounds[:-1], bounds[1:], removed, strict=True)]
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary())] if keep_text else columns, [*names, "kept"] if keep_text else names)

    return repeated_spans(docs).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))
