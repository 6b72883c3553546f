"""Quality rules with compression bands: zstandard ratios of whole documents and of fixed chunks.

A text's ratio is its UTF-8 bytes over the bytes of its zstandard frame. Prose stays inside a band that rises slowly
with length: text above the band repeats itself, text below it holds little but noise. ``BANDS`` gives
the limits by length, for whole texts and for chunks alike, so a short last chunk is held to the limits of
its own length. A document fails if its whole ratio leaves the band, or if more than ``BAD_SHARE`` of its bytes
stand in chunks that leave theirs: a long clean text does not hide a long run of junk.

Before that come plain counts with fixed limits (``base_failed``): words are runs of characters other than space, tab, \\n, \\v,
\\f and \\r; a text fails with under ``LEAST_WORDS`` words, or with more than ``REPEAT_PERCENT`` percent of its words
in windows of ``WINDOW`` words that are found twice or more in it.

Each row is judged alone: no shuffle, nothing collected. Texts are worked on in slices, so memory follows the words of the
longest text (some 60 bytes each) and the text itself, not multiples of its bytes; words over ``LONG_WORD`` bytes are hashed one by one. Words and
windows are compared by 64-bit fingerprints. Null and empty texts have counts 0 and fail the base rules; repeated rows are
judged alike, ties have no meaning, a null doc_id stays null. An empty table gives no rows. Only doc_id and text are read,
columns of other names are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from siteloom.llm.support import U64, chunks, mix, prefix_hash, raw_bytes, span_hash

LEAST_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
LEVEL, CHUNK, BAD_SHARE = 3, 4096, 0.3
SLICE, LONG_WORD = 1 << 20, 4096
#: (bytes from which the limits hold, lowest ratio, highest ratio). Below 64 bytes the frame's header decides, so there is no limit.
BANDS = ((0, 0.0, 1e9), (64, 0.9, 2.6), (256, 1.05, 2.9), (512, 1.2, 3.2), (1024, 1.3, 3.6), (4096, 1.4, 4.2), (16384, 1.4, 5.0), (65536, 1.4, 6.0), (1 << 20, 1.4, 7.0))

SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
#: Bytes that begin a code point of a word.
WORD_CHAR = ~SPACE & ((np.arange(256) & 0xC0) != 0x80)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("n_bytes", "ratio", "n_chunks", "bad_chunk_bytes")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, n_bytes long, ratio double, n_chunks long, bad_chunk_bytes long, reason string"


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last positions of the words of all rows; words end with their row."""
    inside = ~SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = np.flatnonzero(np.diff(offsets))
    first, last = offsets[filled], offsets[filled + 1] - 1
    begins[first], ends[last] = inside[first], inside[last]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of words, slice by slice."""
    out = np.zeros(len(start), U64)
    long = end - start > LONG_WORD
    for i in np.flatnonzero(long):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    plain = np.flatnonzero(~long)
    a = 0
    while a < len(plain):
        base = start[plain[a]]
        b = max(a + 1, int(np.searchsorted(end[plain], base + SLICE, "right")))
        mine = plain[a:b]
        piece = data[base : end[mine[-1]]]
        if len(piece) > 2 * SLICE:  # a long word stands in between: words on its far side wait for the next slice
            b = a + int(np.searchsorted(start[mine], base + SLICE))
            mine = plain[a:b]
            piece = data[base : end[mine[-1]]]
        out[mine] = span_hash(prefix_hash(piece), start[mine] - base, end[mine] - base)
        a = b
    return out


def repeated_words(hashes: np.ndarray, row: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Whether each word stands in a window of ``window`` words that its row holds twice or more."""
    n = len(hashes) - window + 1
    covered = np.zeros(len(hashes), bool)
    if n < 2:
        return covered
    key = np.zeros(n, U64)
    for k in range(window):
        key = mix(key ^ hashes[k : k + n])
    key = mix(key ^ mix(row[:n].astype(U64) + U64(1)))
    valid = np.flatnonzero(row[:n] == row[window - 1 :])
    order = valid[np.argsort(key[valid], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    turns = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(turns, order[twice], 1)
    np.add.at(turns, order[twice] + window, -1)
    return np.cumsum(turns[:-1]) > 0


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in raw:
        return 0
    lines = [line for line in raw.split(b"\n") if line.strip()]  # bytes.strip() strips the same six characters
    return len(lines) - len(set(lines))


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """``COUNTS`` of each row of ``data``."""
    start, end = word_bounds(data, offsets)
    cut = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(cut))
    covered = np.flatnonzero(repeated_words(word_hashes(data, start, end), row))
    spans = list(zip(offsets[:-1], offsets[1:], strict=True))
    return {
        "n_words": np.diff(cut),
        "word_chars": np.array([np.count_nonzero(WORD_CHAR[data[a:b]]) for a, b in spans], np.int64),
        "n_symbols": np.array([np.count_nonzero(SYMBOL[data[a:b]]) for a, b in spans], np.int64),
        "n_dup_lines": np.array([duplicate_lines(data[a:b].tobytes()) for a, b in spans], np.int64),
        "n_repeat_words": np.diff(np.searchsorted(covered, cut)),
    }


def limits(n_bytes: int, bands: tuple = BANDS) -> tuple[float, float]:
    """Lowest and highest ratio that a text or chunk of ``n_bytes`` may have."""
    return next((low, high) for least, low, high in reversed(bands) if n_bytes >= least)


def judge_ratios(raw: memoryview, compressor: zstandard.ZstdCompressor, bands: tuple = BANDS, chunk: int = CHUNK) -> tuple[float | None, int, int, str | None]:
    """(ratio of the whole, chunks, bytes of chunks outside their band, why it fails or None)."""
    n = len(raw)
    if not n:
        return None, 0, 0, None
    ratio = n / len(compressor.compress(raw))
    low, high = limits(n, bands)
    reason = "repetitive" if ratio > high else "incompressible" if ratio < low else None
    pieces = range(0, n, chunk)
    bad = {"repetitive": 0, "incompressible": 0}
    if len(pieces) > 1:
        for a in pieces:
            piece = raw[a : a + chunk]
            r, (low, high) = len(piece) / len(compressor.compress(piece)), limits(len(piece), bands)
            if not low <= r <= high:
                bad["repetitive" if r > high else "incompressible"] += len(piece)
        if reason is None and sum(bad.values()) > BAD_SHARE * n:
            reason = max(bad, key=bad.get) + " chunks"
    return ratio, len(pieces), sum(bad.values()), reason


def judged(texts: pa.Array, bands: tuple = BANDS, chunk: int = CHUNK) -> Iterator[tuple[int, int, dict[str, list]]]:
    """(first row, past-last row, columns of ``SCHEMA`` but doc_id) for slices of ``texts``."""
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    data, offsets = raw_bytes(texts)
    for lo, hi in chunks(offsets):
        part, bounds = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        out = base_counts(part, bounds)
        base = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
        raw = memoryview(np.ascontiguousarray(part))
        ratio, pieces, bad, reason = zip(*(judge_ratios(raw[a:b], compressor, bands, chunk) for a, b in zip(bounds[:-1], bounds[1:], strict=True)), strict=True)
        kept = [not b and r is None for b, r in zip(base, reason, strict=True)]
        yield lo, hi, out | {"base_failed": base, "kept": kept, "n_bytes": np.diff(bounds), "ratio": ratio, "n_chunks": pieces, "bad_chunk_bytes": bad, "reason": reason}


def compression_bands(docs: DataFrame, bands: tuple = BANDS, chunk: int = CHUNK) -> DataFrame:
    """``SCHEMA`` per row of ``docs`` (doc_id, text): counts, verdicts, ratio and what the chunks say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, columns in judged(batch.column(1), bands, chunk):
                typed = [pa.array(c, pa.string() if n == "reason" else pa.float64() if n == "ratio" else pa.bool_() if n in ("base_failed", "kept") else pa.int64()) for n, c in columns.items()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *typed], ["doc_id", *columns])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def passing_documents(docs: DataFrame, bands: tuple = BANDS, chunk: int = CHUNK) -> DataFrame:
    """Rows of ``docs`` that pass, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, columns in judged(batch.column(at), bands, chunk):
                yield batch.slice(lo, hi - lo).filter(pa.array(columns["kept"], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
