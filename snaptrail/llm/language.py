"""Language identification with string kernels.

A text is the set of its 1-, 2- and 3-letter runs (hashed to ``BUCKETS`` places; case folded, all but letters is one
space). The blended-spectrum presence kernel of two texts is the size of the sets' intersection over the root of the
product of their sizes. A few training texts are Nystroem landmarks; one-versus-rest kernel ridge regression is solved
on them, and texts are scored in batches: presence matrix times landmarks, times coefficients.

Only a sample is learned from, of about ``per_language`` texts a language (a documented bound; drawn by a hash of the
id, whole texts); executors turn it into bit sets, so the driver gets 2 KB a text. ``most_texts`` bounds the sample over
all languages, which share it (where there are more languages than that, those with the most texts do), so a column full
of stray values can't fill the driver. Every text is scored whole.

Defined results: null text or text without a letter is ``und`` with score 0; so is every text if nothing can be learned
from; repeated rows stay repeated; a null id counts as the empty id when rows are held out; ties go to the language that
sorts first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaptrail.llm.common import parts_of

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
UNKNOWN = "und"
_MIX = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters; beyond the table none is."""
    return np.array([chr(i).isalpha() for i in range(0x33480)])


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A row of 0/1 places for each text, and whether it has a letter."""
    codes = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) if t else np.full(1, 32, np.uint32) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
    code = np.concatenate(codes)
    letters = _letters()
    is_letter = letters[np.minimum(code, len(letters) - 1)]
    code = np.where(is_letter, code, np.uint32(32))
    # a run of other characters is one space
    keep = is_letter.copy()
    keep[0] = True
    keep[1:] |= is_letter[:-1] | (row[1:] != row[:-1])
    code, row, is_letter = code[keep], row[keep], is_letter[keep]
    out = np.zeros((len(texts), BUCKETS), np.uint8)
    has_letter = np.zeros(len(texts), bool)
    has_letter[row[is_letter]] = True
    flat, base = out.reshape(-1), row.astype(np.int64) * BUCKETS
    mixed = [code * m for m in _MIX]
    for n in ORDERS:
        h = mixed[0] + np.uint32(n) if n == 1 else functools.reduce(np.bitwise_xor, (np.left_shift(mixed[j][j : len(code) - n + 1 + j], np.uint32(j)) for j in range(n))) * _MIX[n % 3]
        place = (h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS)
        last = len(code) - n + 1
        inside = row[:last] == row[n - 1 :]
        flat[(base[:last] + place)[inside]] = 1
    return out, has_letter


def kernel(bits: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Presence kernel of every row with every landmark (rows of the transposed matrix)."""
    x = bits.astype(np.float32)
    size = np.sqrt(np.maximum(1, x.sum(1)))
    return (x @ landmarks.T) / (size[:, None] * np.sqrt(np.maximum(1, landmarks.sum(1)))[None, :])


class Model:
    """Landmarks and one-versus-rest coefficients."""

    def __init__(self, bits: np.ndarray, labels: list[str], n_landmarks: int = 96, ridge: float = 1e-3) -> None:
        self.languages = sorted(set(labels))
        own = {lang: [i for i, x in enumerate(labels) if x == lang] for lang in self.languages}
        each = max(1, n_landmarks // max(1, len(own)))
        chosen = [i for lang in self.languages for i in own[lang][:each]]
        landmarks = bits[chosen].astype(np.float32)
        k_mm = kernel(bits[chosen], landmarks).astype(np.float64)
        k_nm = np.concatenate([kernel(bits[a : a + 512], landmarks) for a in range(0, len(bits), 512)]).astype(np.float64)
        y = np.array([[1.0 if x == lang else -1.0 for lang in self.languages] for x in labels])
        # languages count alike, whatever their share of the sample
        weight = np.array([1 / len(own[x]) for x in labels])[:, None] / len(own)
        a = k_nm.T @ (weight * k_nm) + ridge * k_mm + 1e-9 * np.eye(len(chosen))
        self.coefficients = np.linalg.solve(a, k_nm.T @ (weight * y)).astype(np.float32)
        self.packed = np.packbits(bits[chosen], axis=1)

    def predict(self, texts: list[str | None], landmarks: np.ndarray) -> tuple[list[str], np.ndarray]:
        bits, has_letter = presence(texts)
        margins = kernel(bits, landmarks) @ self.coefficients
        best = margins.argmax(1)
        score = np.clip((margins[np.arange(len(best)), best] + 1) / 2, 0, 1).astype(np.float64)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, has_letter, strict=True)], np.where(has_letter, score, 0.0)


def remainder(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def learn(docs: DataFrame, may_learn: Column, per_language: int = 600, most_texts: int = 24_000) -> Model | None:
    """A model from the rows that may be learned from; None if there are none.

    About ``per_language`` texts of each language are learned from, and about ``most_texts`` in all, so all languages have
    a share of them as long as there are fewer languages than texts.
    """
    rows = docs.select("doc_id", "text", "lang", may_learn.alias("may")).filter("may AND lang IS NOT NULL AND text IS NOT NULL").drop("may")
    # one row a language, at most as many as texts
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_texts).collect()
    if not counts:
        return None
    per_language = max(1, min(per_language, most_texts // len(counts)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["n"])) for r in counts], "lang string, share double")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < F.col("share") * (1 << 30)

    def bit_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (p.slice(i, 256) for p in parts_of(batch, 2, 4 << 20) for i in range(0, p.num_rows, 256)):
                bits, _ = presence(part.column(2).to_pylist())
                packed = [b.tobytes() for b in np.packbits(bits, axis=1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())], ["doc_id", "lang", "bits"])

    sample = rows.join(F.broadcast(shares), "lang").filter(drawn).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(bit_sets, "doc_id long, lang string, bits binary").collect()
    # landmarks are a language's first rows, so these come in an order that has nothing to do with ids
    sample.sort(key=lambda r: (r["lang"], zlib.crc32(bytes(r["bits"])), bytes(r["bits"]), r["doc_id"] or 0))
    if not sample:
        return None
    bits = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in sample), np.uint8).reshape(len(sample), -1), axis=1)
    return Model(bits, [r["lang"] for r in sample])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds nothing but ``lang_pred`` and ``score`` to (doc_id, held_out, text); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        landmarks = np.unpackbits(model.packed, axis=1).astype(np.float32) if model is not None else None
        for batch in batches:
            for part in (p.slice(i, 256) for p in parts_of(batch, 2, 4 << 20) for i in range(0, p.num_rows, 256)):
                texts = part.column(2).to_pylist()
                langs, scores = model.predict(texts, landmarks) if model is not None else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
