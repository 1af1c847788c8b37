"""Helpers shared by the corpus operators: splits, shared folders, ragged arrays, bounded slices."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir

#: Text bytes handled at a time inside a task; it bounds memory and never cuts a text's result.
SLICE_BYTES = 8 << 20


def crc_bucket(key: Column, buckets: int) -> Column:
    """crc32 of the key as text, modulo ``buckets``; NULL keys give NULL."""
    return F.crc32(key.cast("string").cast("binary")) % buckets


def is_bucket(key: Column, buckets: int, remainder: int) -> Column:
    return F.coalesce(crc_bucket(key, buckets) == remainder, F.lit(False))


def hash_share(key: Column) -> Column:
    """Where the key's hash lies among all hashes, from 0 to below 1: the order of ``xxhash64`` as a share."""
    return F.xxhash64(key).cast("double") / float(1 << 64) + 0.5


def below_share(key: Column, bound: int, n: Column | int) -> Column:
    """Leaves some two times ``bound`` of ``n`` distinct keys, those of the lowest hashes, so that few are left to be ranked.

    The ``bound`` lowest are among them but for a chance that vanishes with the bound (below 1e-50 from 500 on).
    """
    n = F.lit(n) if isinstance(n, int) else n
    return hash_share(key) * n < 2.0 * bound + 20


def materialize(df: DataFrame, spark: SparkSession, purpose: str) -> DataFrame:
    """Writes to the shared folder and reads back: lineage is cut and lost executors cost nothing."""
    path = work_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _trimmer():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library keeps or returns memory by itself
        return lambda _: 0


_trim = _trimmer()


def tidy() -> None:
    """Returns memory that a worker has freed to the system, since workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes in ``column``; a longer single value is a run of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column with NULL as the empty text."""
    return pc.fill_null(batch.column(column), "")


def gather(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates the runs ``flat[offsets[i]:offsets[i + 1]]`` for i in ``index``; also returns their ends."""
    lengths = offsets[index + 1] - offsets[index]
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return flat[:0], ends
    at = np.repeat((offsets[index] - ends + lengths).astype(np.int32), lengths)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at], ends


def with_output(fields: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, (_, t) in zip(columns, fields, strict=True)],
        names=[n for n, _ in fields],
    )


class Remembered(dict):
    """A bounded memory of pure results: keys met since the last change of generation, and a generation before."""

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit, self.old = limit, {}

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def missing(self, keys: list) -> list:
        """The distinct keys that must be computed; the others stay or become current. Call it once per batch."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        old, new = self.old, []
        for key in dict.fromkeys(keys):
            if key not in self:
                if key in old:
                    self[key] = old[key]
                else:
                    new.append(key)
        return new
