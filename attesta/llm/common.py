"""Shared pieces of the training-data operators: scratch tables in the shared folder and checked broadcasts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.session import file_system, scratch_folder, ship

#: Rows and bytes up to which a side may be broadcast after both have been counted; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20

#: ``[\\x20\\x09-\\x0D]``, the white space of the contracts.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Shuffle files go as soon as the job that made them has ended. Without it they stay until the driver collects its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables that cut lineage: written once to the shared folder, read back from there, removed when the driver exits.

    A lost executor costs nothing that has been written. ``drop`` and ``only`` remove tables that no later plan reads.
    Shuffle files go once their table is written.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark, self.base, self.n = spark, scratch_folder(spark), 0

    def keep(self, df: DataFrame, *, by: list[str] | None = None) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads the written files."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        writer = df.write.partitionBy(*by) if by else df.write
        before = self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")
        try:
            writer.parquet(path)
        finally:
            self.spark.conf.set(_CLEAN, before) if before is not None else self.spark.conf.unset(_CLEAN)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._attesta_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._remove(df._attesta_path)

    def only(self, *tables: DataFrame) -> None:
        """Remove all tables but these, when no other is read by a later plan."""
        kept = {t._attesta_path for t in tables}
        for i in range(1, self.n + 1):
            if f"{self.base}/{i}" not in kept:
                self._remove(f"{self.base}/{i}")

    def _remove(self, path: str) -> None:
        fs, where = file_system(self.spark, path)
        fs.delete(where, True)


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows and ``most`` bytes, else as it is, so that the join shuffles.

    The count stops at the limit. ``df`` should be cheap to read (a scratch table).
    """
    wide = [c for c, kind in df.dtypes if kind.startswith(("string", "binary", "array", "struct", "map"))]
    width = F.lit(8 * (len(df.columns) - len(wide)) + 16)
    for c in wide:
        value = F.col(f"`{c}`")
        width = width + F.coalesce(F.octet_length(value if df.schema[c].dataType.simpleString() in ("string", "binary") else F.to_json(F.struct(value))), F.lit(0))
    n, size = df.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(width.cast("bigint")), F.lit(0))).first()
    return F.broadcast(df) if n <= limit and size <= most else df


def give_back() -> None:
    """Hand memory that is free in this process back to the system: workers outlive their tasks and are kept for others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, its worker without free memory after the task."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return within


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores in front until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(col):
    """A-Z to a-z and nothing else; plain ``lower`` where the text is ASCII, as both agree there and it is faster."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def let(value, body):
    """``body(value)`` with ``value`` computed once a row.

    A plain column may be put in place of its name by filter push-down, also inside lambdas, and would then be computed
    for each element.
    """
    return F.get(F.transform(F.array(value), body), 0)
