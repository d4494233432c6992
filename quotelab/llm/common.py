"""What the operators share: reading tables, session limits, written intermediate tables."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelab.session import materialize

#: Ids are told apart by this many cells before rows travel; the table of cells is as small at any size of the input.
ID_CELLS = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    """Bound what one Arrow batch can hold, by rows and by bytes: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def parts_of(spark: SparkSession) -> int:
    """Into how many key ranges an exchange is dealt: the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back; shuffle files that only ``df`` needed can go.

    The JVM drops shuffle files once nothing refers to them, but notices only when it collects
    garbage; between the stages of one operator that would keep every exchange on disk at once.  The first
    collection frees the plan, only a second one what the plan held.
    """
    out = materialize(df, name)
    del df
    gc.collect()
    jvm = out.sparkSession.sparkContext._jvm
    jvm.System.gc()
    time.sleep(0.1)
    jvm.System.gc()
    return out


def parted(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``doc_id`` may be one of ``ids``, and those whose can't be.

    The second need not travel to be matched.  What is compared are cells of a hash, of which every task
    gets a table of bounded size, so an exact join must follow for the first.
    """
    cell = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(ID_CELLS))
    cells = F.broadcast(ids.select(cell.alias("id_cell_of_some")).distinct())
    same = cell == F.col("id_cell_of_some")
    return rows.join(cells, same, "left_semi"), rows.join(cells, same, "left_anti")


def with_found(rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``rows`` with the column ``name`` of ``found`` (``doc_id`` and that), null where it has none."""
    some, rest = parted(rows, found)
    none = F.lit(None).cast(found.schema[name].dataType)
    return some.join(found, "doc_id", "left").select(*rows.columns, name).unionByName(rest.withColumn(name, none))


def not_named(columns: Iterable[str], names: Iterable[str]) -> list[str]:
    """The columns that have none of the names, in any case."""
    taken = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in taken]


def set_aside(documents: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``documents`` with columns called like one of ``names``, in any case, under unused names, and the
    way back from these."""
    taken, moved = {c.lower() for c in (*documents.columns, *names)}, {}
    for c in set(documents.columns) - set(not_named(documents.columns, names)):
        new = f"given_{c}"
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        moved[c] = new
    return documents.withColumnsRenamed(moved), {new: c for c, new in moved.items()}


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The string column with nulls as empty texts."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.fill_null("") if column.null_count else column


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.to_numpy(zero_copy_only=False)


def longs(values: np.ndarray) -> pa.Array:
    """Unsigned hashes as the signed 64-bit column that Spark knows."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def grouped(key: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    if not len(key):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))


def distinct(rows: np.ndarray, *keys: str) -> np.ndarray:
    """``rows`` of a structured array in order of ``keys``, one for each value of them."""
    rows = rows[np.lexsort([rows[key] for key in reversed(keys)])]
    new = np.ones(len(rows), bool)
    new[1:] = rows[keys[0]][1:] != rows[keys[0]][:-1]
    for key in keys[1:]:
        new[1:] |= rows[key][1:] != rows[key][:-1]
    return rows[new]


def spans_of(at: np.ndarray, total: int) -> Iterator[tuple[int, int]]:
    """Start and end of each run, from where runs start."""
    return zip(at.tolist(), [*at[1:].tolist(), total][: len(at)], strict=True)


def dealt(part: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Records of a structured array by the part that each belongs to, packed in order of its fields.

    They are packed field by field (see ``packed``); the first field of a sorted part then compresses well.
    """
    order = np.lexsort((*(rows[name] for name in reversed(rows.dtype.names[:2])), part))
    part, rows = part[order], rows[order]
    at = grouped(part)
    for start, stop in spans_of(at, len(part)):
        yield int(part[start]), packed(rows[start:stop])


def packed(rows: np.ndarray) -> bytes:
    """Each field by the first byte of all rows, then the second, and so on, since the upper bytes of ids and
    places are mostly alike.  A first field of 64 bits, which is sorted, is kept as differences."""
    out = []
    for i, name in enumerate(rows.dtype.names):
        values = np.ascontiguousarray(rows[name])
        if i == 0 and values.itemsize == 8:
            values = np.diff(values.view(np.uint64), prepend=np.uint64(0))
        out.append(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())
    return b"".join(out)


def unpacked(payload: pa.Scalar, kind: np.dtype) -> np.ndarray:
    raw = payload.as_buffer()
    return unpacked_at(raw, kind, raw.size // kind.itemsize, 0)


def unpacked_at(raw: pa.Buffer, kind: np.dtype, n: int, at: int) -> np.ndarray:
    rows = np.empty(n, kind)
    for i, name in enumerate(kind.names):
        size = kind[name].itemsize
        planes = np.frombuffer(raw, np.uint8, len(rows) * size, at).reshape(size, len(rows))
        values = np.ascontiguousarray(planes.T).view(kind[name]).ravel()
        if i == 0 and size == 8:
            values = np.cumsum(values.view(np.uint64), dtype=np.uint64).view(kind[name])
        rows[name] = values
        at += len(rows) * size
    return rows
