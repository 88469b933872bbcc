"""Media columns: FLAC files in a binary column.

``encode_media`` stores PCM bytes losslessly; ``decode_media`` reads the stored bytes (Rice residuals, linear
predictors, CRC-8, CRC-16 and MD5 verified) into PCM blocks with their sample offsets, so that a reader can seek.

Defined results: null PCM is the empty sound; a null or damaged file gives no blocks and says why in ``problem``;
repeated rows stay repeated; other columns pass through, but a column named like a new one is replaced; an empty table
gives an empty result. Both are narrow: no shuffle, whole files, memory bounded by the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from snaptrail.llm import flac

BLOCKS_TYPE = "array<struct<sample_offset:long,n_samples:int,pcm:binary>>"
GROUP_BYTES = 4 << 20
BLOCK_SAMPLES = flac.BLOCK * flac.SEEK_FRAMES


def _groups(column: pd.Series) -> Iterator[slice]:
    """Runs of rows of about GROUP_BYTES."""
    start = total = 0
    for i, value in enumerate(column):
        total += 0 if value is None else len(value)
        if total >= GROUP_BYTES:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(column):
        yield slice(start, len(column))


def _with_columns(df: DataFrame, source: str, new: str, run: Callable[[list], dict[str, list]]) -> DataFrame:
    """df with columns ``new`` (DDL) that ``run`` makes from groups of values of ``source``."""
    names = [c.split()[0] for c in new.split(", ")]
    kept = df.drop(*names)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in _groups(batch[source]):
                part = batch.iloc[rows]
                yield part.assign(**{k: pd.Series(v, index=part.index, dtype=object) for k, v in run(part[source].tolist()).items()})

    schema = StructType(kept.schema.fields + StructType.fromDDL(new).fields)
    return kept.mapInPandas(each, schema)


def encode_media(df: DataFrame, pcm: str, bps: int = 8) -> DataFrame:
    """Adds ``media``, the FLAC file of the PCM bytes in column ``pcm``."""
    return _with_columns(df, pcm, "media binary", lambda values: {"media": flac.encode([bytes(v) if v is not None else b"" for v in values], bps)})


def _feature(x: np.ndarray) -> str:
    """Counts and sums of whole numbers, so equal sounds give equal text."""
    x = x.astype(np.int64)
    return f"samples={len(x)};min={x.min(initial=0)};max={x.max(initial=0)};sum={x.sum()};energy={(x * x).sum()};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};travel={int(np.abs(np.diff(x)).sum())}"


def decode_media(df: DataFrame, media: str = "media", bps: int = 8) -> DataFrame:
    """Adds ``blocks`` (sample_offset, n_samples, pcm), ``feature`` and ``problem``; drops nothing."""

    def run(values: list) -> dict[str, list]:
        results = iter(flac.decode_each([bytes(v) for v in values if v is not None]))
        blocks, features, problems = [], [], []
        for v in values:
            x = next(results) if v is not None else "null"
            problems.append(None if isinstance(x, np.ndarray) else str(x)[:200])
            if not isinstance(x, np.ndarray):
                blocks.append([])
                features.append(None)
                continue
            raw = (x.astype(np.int32) + 128).astype(np.uint8).tobytes() if bps == 8 else x.astype("<i2").tobytes()
            width = bps // 8
            blocks.append([{"sample_offset": a, "n_samples": min(BLOCK_SAMPLES, len(x) - a), "pcm": raw[a * width : (a + BLOCK_SAMPLES) * width]} for a in range(0, len(x), BLOCK_SAMPLES)])
            features.append(_feature(x))
        return {"blocks": blocks, "feature": features, "problem": problems}

    return _with_columns(df, media, f"blocks {BLOCKS_TYPE}, feature string, problem string", run)


def pcm_of(blocks: Column) -> Column:
    """The PCM bytes of all blocks in order."""
    return F.when(F.size(blocks) == 1, blocks[0]["pcm"]).otherwise(F.unhex(F.array_join(F.transform(blocks, lambda b: F.hex(b["pcm"])), "")))


def seek(blocks: Column, sample: Column) -> Column:
    """The block that holds a sample number; null if none does."""
    return F.filter(blocks, lambda b: (b["sample_offset"] <= sample) & (sample < b["sample_offset"] + b["n_samples"]))[0]
