"""Token counts of whole texts by a vocabulary compiled into finite-state transducers.

The character classes of the vocabulary's word splitter are read once in the driver (a few kilobytes). Each Python worker
compiles the vocabulary; counting is narrow: no shuffle, memory bounded by a slice of an Arrow batch and by the compiled
transitions that are kept.

Defined results: null text is the empty text, which has no tokens; special strings inside texts count as one token each, as
the library reads them by default; repeated rows stay repeated; other columns pass through if they are asked for, columns
named like new ones are replaced; an empty table gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from snaptrail.llm.common import freed, parts_of
from snaptrail.llm.transducers import character_classes, token_counter

TEXT_BYTES = 2 << 20
NEW = "n_bytes long, n_tokens long"


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The kept columns (all but the text, if none are named) with ``n_bytes`` of UTF-8 and ``n_tokens``."""
    new = StructType.fromDDL(NEW)
    kept = [c for c in (docs.columns if keep is None else keep) if c != text and c not in new.names]
    first, kind = (a.tobytes() for a in character_classes(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(tokenizer_path, first, kind)
        for batch in batches:
            for part in parts_of(batch, len(kept), TEXT_BYTES):
                texts = part.column(len(kept))
                n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], n_bytes, pa.array(counter.count(texts), pa.int64())], [*kept, *new.names])

    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    return rows.mapInArrow(freed(run), StructType([*rows.schema.fields[:-1], *new.fields]))
