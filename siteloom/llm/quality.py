"""Quality score of a text: a generalised additive model with pairwise interactions.

Features are counts and ratios of one text (``FEATURES``). Cyclic boosting visits the features in
turn and adds a shallow tree of one feature each time; then trees of two features for the pairs
that explain most of what is left. All trees of a feature (a pair) add up to one lookup table, so
a text is scored by binning its features and adding the tables' values.

Learning uses at most ``SAMPLE`` labelled rows outside the held-out third, drawn by hash; their
feature rows come to the driver. Scoring reads whole texts. label, lang, source and doc_id are no
inputs of a score.

Null and empty texts have all features 0 and get the score of that point. Without labels every score
is 0.5. Rows with a null doc_id are not held out and carry no label. Repeated rows get equal
scores; labels repeated for a document all count. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.support import chunks, prefix_hash, raw_bytes, span_hash

SAMPLE, BINS, COARSE, PAIRS = 20_000, 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE = 200, 100, 0.1
FEATURES = (
    "log_bytes", "upper", "digit", "stop", "pause", "mark", "pipe", "other", "words", "word_length", "long_words", "short_words", "distinct_words", "repeats", "lines", "line_words", "distinct_lines", "capital_words", "ended_lines",
)
_class = np.full(256, 7, np.uint8)  # 0 letter, 1 upper, 2 digit, 3 sentence end, 4 pause, 5 mark, 6 pipe, 7 other, 8 white space
_class[97:123] = _class[128:] = 0
_class[65:91] = 1
_class[48:58] = 2
_class[list(b".!?")] = 3
_class[list(b",;:'\"()-")] = 4
_class[list(b"#$%&*@^~<>{}[]\\/=+_`")] = 5
_class[list(b"|")] = 6
_class[[32, *range(9, 14)]] = 8


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _distinct(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return np.bincount(r[new], minlength=n)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x FEATURES of the texts."""
    n, size = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kind = _class[data]
    count = np.bincount(row * 9 + kind, minlength=9 * n).reshape(n, 9).astype(np.float64) if n else np.zeros((0, 9))
    full = np.maximum(size, 1)
    begins = np.zeros(len(data), bool)
    begins[offsets[:-1][size > 0]] = True
    word = kind != 8
    start = np.flatnonzero(word & (begins | np.concatenate([[True], ~word[:-1]])))
    ends = np.zeros(len(data), bool)
    ends[offsets[1:][size > 0] - 1] = True
    end = np.flatnonzero(word & (ends | np.concatenate([~word[1:], [True]]))) + 1
    prefix = prefix_hash(data)
    w, owner, length = span_hash(prefix, start, end), row[start], end - start
    words = np.bincount(owner, minlength=n)
    some = np.maximum(words, 1)
    again = np.zeros(len(w), bool)
    again[1:] = (w[1:] == w[:-1]) & (owner[1:] == owner[:-1])
    of = lambda mask: np.bincount(owner[mask], minlength=n) / some
    newline = data == 10
    line_start = np.flatnonzero(begins | np.concatenate([[False], newline[:-1]]))
    line_end = np.flatnonzero(newline | ends)
    line_end = np.where(newline[line_end], line_end, line_end + 1)
    line_row = row[line_start]
    line = span_hash(prefix, line_start, line_end)
    lines = np.maximum(np.bincount(line_row, minlength=n), 1)
    last = data[np.maximum(line_end - 1, 0)]
    ended = (_class[last] == 3) & (line_end > line_start)
    return np.stack(
        [
            np.log1p(size), count[:, 1] / full, count[:, 2] / full, count[:, 3] / full, count[:, 4] / full, count[:, 5] / full, count[:, 6] / full, count[:, 7] / full, np.log1p(words), np.bincount(owner, length, minlength=n) / some,
            of(length > 12), of(length < 4), _distinct(owner, w, n) / some, of(again), np.log1p(np.where(size > 0, lines, 0)), words / lines, np.where(size > 0, _distinct(line_row, line, n) / lines, 0), of(kind[start] == 1), np.bincount(line_row[ended], minlength=n) / lines,
        ],
        axis=1,
    )


@dataclass
class Model:
    """Cut points and one table a feature; tables of coarse bins for pairs of features."""

    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)]
        total = np.full(len(x), self.bias)
        for b, table in zip(bins, self.tables, strict=True):
            total += table[b]
        for f, g, table in self.pairs:
            total += table[_coarse(bins[f], self.cuts[f]), _coarse(bins[g], self.cuts[g])]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _coarse(bins: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return bins * COARSE // (len(cuts) + 1)


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf value of each bin of the best tree with two cuts, taken greedily."""
    edges = [0, len(g)]
    for _ in range(2):
        best = (1e-9, None)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 1:
                left_g, left_h, all_g, all_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1], g[a:b].sum(), h[a:b].sum()
                gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], a + k + 1)
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree that cuts both axes once."""
    sg, sh = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, out = 0.0, np.zeros_like(g)
    a, b = np.meshgrid(np.arange(COARSE - 1), np.arange(COARSE - 1), indexing="ij")
    gain = np.zeros(a.shape)
    parts = []
    for s in (sg, sh):
        one, two, three = s[a, b], s[a, -1] - s[a, b], s[-1, b] - s[a, b]
        parts.append((one, two, three, s[-1, -1] - one - two - three))
    for x, y in zip(*parts, strict=True):
        gain += x**2 / (y + 1)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    best = float(gain[i, j] - sg[-1, -1] ** 2 / (sh[-1, -1] + 1))
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum())
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y) or y.min() == y.max():
        value = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return Model(value, [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [])
    cuts = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]
    cuts = [c[c > col.min()] for c, col in zip(cuts, x.T, strict=True)]
    bins = [np.searchsorted(c, col, "right") for c, col in zip(cuts, x.T, strict=True)]
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Model(float(np.log(rate / (1 - rate))), cuts, [np.zeros(len(c) + 1) for c in cuts], [])
    total = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, len(cuts[f]) + 1), np.bincount(b, h, len(cuts[f]) + 1))
            model.tables[f] += step
            total += step[b]
    coarse = [_coarse(b, c) for b, c in zip(bins, cuts, strict=True)]
    square = lambda f, g_, v: np.bincount(coarse[f] * COARSE + coarse[g_], v, COARSE**2).reshape(COARSE, COARSE)
    g, h = slopes()
    found = sorted(((_pair_tree(square(f, k, g), square(f, k, h))[0], f, k) for f in range(len(bins)) for k in range(f + 1, len(bins))), reverse=True)[:PAIRS]
    model.pairs = [(f, k, np.zeros((COARSE, COARSE))) for _, f, k in found]
    for _ in range(PAIR_ROUNDS):
        for f, k, table in model.pairs:
            g, h = slopes()
            step = RATE * _pair_tree(square(f, k, g), square(f, k, h))[1]
            table += step
            total += step[coarse[f], coarse[k]]
    return model


def _rows(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray]]:
    data, offsets = raw_bytes(batch.column(column))
    for lo, hi in chunks(offsets):
        yield lo, hi, features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from at most ``sample`` labelled rows that are not held out."""
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    h = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30))
    rows = labels.count()
    few = labels.where(h < int((1 << 30) * min(1.0, 1.1 * sample / max(rows, 1)))).select("doc_id", "y", h.alias("h")).orderBy("h", "doc_id", "y").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x in _rows(batch, 2):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32), pa.array(x.ravel()))], ["h", "y", "x"])

    # few has at most ``sample`` rows of three numbers: a bound that does not grow with the input
    known = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("h", "y", "text").mapInArrow(run, "h long, y int, x array<double>")
    got = known.orderBy("h", "y", "x").limit(sample).collect()
    return fit(np.array([r[2] for r in got], float).reshape(-1, len(FEATURES)), np.array([r[1] for r in got], float))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs`` (doc_id, text)."""
    scorer = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for lo, hi, x in _rows(batch, 2):
                score[lo:hi] = scorer.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
