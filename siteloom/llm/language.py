"""Language identification by a blended-spectrum string kernel, Nyström landmarks and kernel ridge regression.

A text is the set of its byte n-grams, n = 1..``LONGEST``, of the lower-cased text, hashed to ``SLOTS``
presence bits; k(x, z) = |x & z| / sqrt(|x| |z|). ``LANDMARKS`` training texts a language span the Nyström
features; one-versus-rest ridge regression with rows weighted by language gives the scores. As
the kernel is a product of presence vectors, landmark kernel and coefficients fold into one
matrix, and a batch of texts is scored by one matrix product.

Learning uses at most ``SAMPLE`` rows of each language, drawn by hash, and about ``MOST_ROWS`` rows and
``MOST_LANDMARKS`` landmarks of all; only their presence bits, SLOTS / 8 bytes a row whatever the text's
length, come to the driver. Scoring reads whole texts.

A null text or one without a letter is ``und`` with score 0, and so is every text if there is
nothing to learn from. Rows with a null doc_id are held out. Repeated rows get equal results; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.support import chunks, free_name, raw_bytes

LONGEST, SLOT_BITS = 4, 15
SLOTS = 1 << SLOT_BITS
SAMPLE, LANDMARKS, RIDGE = 1000, 64, 1e-3
MOST_ROWS, MOST_LANDMARKS = 8000, 512
UNDETERMINED = "und"
ROWS = 32
_odd = np.array([2654435769, 2246822519, 3266489917, 668265263], np.uint32)


def held_out() -> Column:
    return F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)), F.lit(5)) == 0


def presence(data: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Fill the first rows of ``out`` (rows x SLOTS) with the presence vectors of the texts."""
    n = len(offsets) - 1
    used = out[:n]
    used.fill(0)
    flat = used.reshape(-1)
    row = np.repeat(np.arange(n, dtype=np.int64) << SLOT_BITS, np.diff(offsets))
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    code = np.zeros(len(data), np.uint32)
    for k in range(min(LONGEST, len(data))):
        code[: len(data) - k] |= data[k:].astype(np.uint32) << np.uint32(8 * k)
        ok = room > k
        slot = (code * _odd[k] + np.uint32(k)) >> np.uint32(32 - SLOT_BITS)
        flat[row[ok] + slot[ok]] = 1
    return used


def _batches(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = raw_bytes(batch.column(column))
    for lo, hi in chunks(offsets):
        for a in range(lo, hi, ROWS):
            b = min(a + ROWS, hi)
            yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def sampled_bits(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, bits) of at most ``sample`` learnable rows a language."""
    learn = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    counts = docs.where(~held_out() & F.col("lang").isNotNull()).groupBy("lang").count().collect()  # one number a language
    sample = max(20, min(sample, MOST_ROWS // max(1, len(counts))))
    least = F.lit(0.0)
    for lang, n in counts:
        least = F.when(F.col("lang") == lang, 1.2 * sample * (1 << 30) / n).otherwise(least)
    few = learn.where(h <= least).select("lang", F.lower("text").alias("text"), h.alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = np.zeros((ROWS, SLOTS), np.uint8)
        for batch in batches:
            for a, b, data, offsets in _batches(batch, 1):
                bits = np.packbits(presence(data, offsets, space), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([x.tobytes() for x in bits], pa.binary())], ["lang", "h", "bits"])

    made = few.mapInArrow(run, "lang string, h long, bits binary")
    return made.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "bits"))).where(F.col("n") <= sample).orderBy("lang", "n").select("lang", "bits")


def fit(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """Languages and the SLOTS x languages matrix that scores normalised presence vectors."""
    rows = sampled_bits(docs, sample).collect()
    if not rows:
        return [], np.zeros((SLOTS, 0), np.float32)
    langs = sorted({r[0] for r in rows})
    y = np.array([langs.index(r[0]) for r in rows])
    bits = np.frombuffer(b"".join(bytes(r[1]) for r in rows), np.uint8).reshape(len(rows), -1)
    sizes = np.maximum(np.concatenate([np.unpackbits(bits[i : i + 256], axis=1).sum(1, dtype=np.float64) for i in range(0, len(bits), 256)]), 1)
    landmarks = max(2, min(landmarks, MOST_LANDMARKS // len(langs)))
    first = np.concatenate([np.flatnonzero(y == k)[:landmarks] for k in range(len(langs))])
    z = np.unpackbits(bits[first], axis=1).astype(np.float32) / np.sqrt(sizes[first])[:, None].astype(np.float32)
    k_nm = np.concatenate([np.unpackbits(bits[i : i + 256], axis=1).astype(np.float32) @ z.T for i in range(0, len(bits), 256)]).astype(np.float64) / np.sqrt(sizes)[:, None]
    value, vector = np.linalg.eigh(k_nm[first])
    good = value > 1e-8 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = k_nm @ root
    weight = 1.0 / np.bincount(y)[y]
    target = (y[:, None] == np.arange(len(langs))).astype(np.float64)
    gram = phi.T @ (phi * weight[:, None])
    solved = np.linalg.solve(gram + ridge * np.eye(len(gram)), phi.T @ (target * weight[:, None]))
    return langs, z.T @ (root @ solved).astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` (doc_id, text, lang, ...) with held_out, lang_pred and score added.

    Kept columns of these names are replaced.
    """
    langs, matrix = fit(docs) if model is None else model
    scorer = docs.sparkSession.sparkContext.broadcast(np.concatenate([matrix, np.ones((SLOTS, 1), np.float32)], axis=1))
    keep = tuple(k for k in keep if k not in ("held_out", "lang_pred", "score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = np.zeros((ROWS, SLOTS), np.float32)
        weights = scorer.value
        names = pa.array([*langs, UNDETERMINED])
        for batch in batches:
            held, _, letter = (batch.column(i) for i in range(len(keep), len(keep) + 3))
            letter = letter.to_numpy(zero_copy_only=False).astype(bool)
            pred, score = np.full(batch.num_rows, len(langs)), np.zeros(batch.num_rows)
            if langs:
                for a, b, data, offsets in _batches(batch, len(keep) + 1):
                    got = presence(data, offsets, space) @ weights
                    margin = got[:, :-1] / np.sqrt(np.maximum(got[:, -1:], 1))
                    pred[a:b] = np.where(letter[a:b], margin.argmax(1), len(langs))
                    score[a:b] = np.where(letter[a:b], np.clip(margin.max(1), 0, 1), 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), held, names.take(pa.array(pred)), pa.array(score)], [*keep, "held_out", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "held_out boolean, lang_pred string, score double"])
    added = [c.alias(free_name(docs, n)) for n, c in (("held", held_out()), ("lower", F.lower("text")), ("letters", letters))]
    return docs.select(*[F.col(f"`{k}`") for k in keep], *added).mapInArrow(run, schema)
