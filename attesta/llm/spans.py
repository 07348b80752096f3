"""Text of spans as the contracts want it, and a pass over whole texts with one Python object per worker."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts held as Python strings at once.
ROWS = 256


def ordered(spans: list[tuple[int, int, str]], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then by the order of ``kinds``, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted((a, kinds.index(k), b, k) for a, b, k in spans))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def over_texts(docs: DataFrame, make: Callable[[], Callable[[str], tuple]], fields: list[tuple[str, str, pa.DataType]], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ``fields`` (name, Spark type, Arrow type) of ``make()(text)`` for each row; null texts are empty."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                part = batch.slice(start, ROWS)
                columns = zip(*[row(text or "") for text in part.column(1).to_pylist()], strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f[2]) for c, f in zip(columns, fields, strict=True))], ["doc_id", *(f[0] for f in fields)])

    schema = ", ".join([f"doc_id {id_type}", *(f"{name} {kind}" for name, kind, _ in fields)])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
