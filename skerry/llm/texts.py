"""Row-wise work on whole texts in Arrow batches, a few rows at a time."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows turned into Python objects at once; it bounds the memory of a task, whatever the size of an Arrow batch.
ROWS = 128
#: Rows and bytes of an Arrow batch of whole texts or packed arrays: for each task an executor holds a batch, and its copy
#: while it grows, outside the heap.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch sizes to `BATCH_ROWS` and `BATCH_BYTES`; smaller ones stay. Results don't depend on them."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(name).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(name, most)


def trim() -> None:
    """Give what this Python process has freed back to the system, where its C library can. Workers stay between tasks, and
    what they keep for themselves counts against their executor."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, keep: list[str], inputs: list[str], work: Callable[[], Callable[..., Iterable]], out: list[tuple[str, T.DataType]]) -> DataFrame:
    """Columns `keep` as they are, and `out` from work()(*inputs) for each row. `work` runs once a task and gives the row function;
    that one's `close`, if there is one, is called at the task's end."""
    small_batches(df.sparkSession)
    held = [f"k{i}" for i in range(len(keep))]
    given = [f"x{i}" for i in range(len(inputs))]
    source = df.select(*[F.col(c).alias(h) for c, h in zip(keep, held, strict=True)], *[F.col(c).alias(g) for c, g in zip(inputs, given, strict=True)])
    fields = [T.StructField(h, source.schema[h].dataType) for h in held] + [T.StructField(n, t) for n, t in out]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, pool = work(), pa.default_memory_pool()
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                columns = [piece.column(h) for h in held]
                rows = [row(*values) for values in zip(*(piece.column(g).to_pylist() for g in given), strict=True)]
                columns += [pa.array(values, f.type) for values, f in zip(zip(*rows, strict=True), list(arrow)[len(held) :], strict=True)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            pool.release_unused()
        if hasattr(row, "close"):
            row.close()

    result = source.mapInArrow(run, schema)
    return result.select(*[F.col(h).alias(c) for c, h in zip(keep, held, strict=True)], *[n for n, _ in out])
