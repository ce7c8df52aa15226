"""Scratch tables in the cluster's shared folder, and Arrow column access."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_written: dict[str, tuple[SparkSession, int]] = {}
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_tidy: dict[str, int | str | None] = {"writers": 0, "before": None}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Only where that is unset in local mode (tests) a temporary folder of this
    process stands in; a cluster without the setting is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"scorelake-{os.getpid()}")


def new_place(spark: SparkSession, what: str) -> str:
    """A path for a new table, which is removed when the driver ends or by ``release``."""
    path = f"{scratch_root(spark)}/scorelake/{what}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release)
    _written[path] = spark, threading.get_ident()
    return path


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that end meanwhile delete their shuffle files at once, not when the driver happens to collect garbage."""
    with _lock:
        if not _tidy["writers"]:
            _tidy["before"] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _tidy["writers"] += 1
    try:
        yield
    finally:
        with _lock:
            _tidy["writers"] -= 1
            if not _tidy["writers"]:
                if _tidy["before"] is None:
                    spark.conf.unset(_CLEANUP)
                else:
                    spark.conf.set(_CLEANUP, _tidy["before"])


def store(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor never makes the work before it run
    again, and every reader sees the same rows. The write's shuffle files go
    when the table stands.
    """
    spark = df.sparkSession
    path = new_place(spark, what)
    with _shuffles_dropped(spark):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def written() -> set[str]:
    """The paths that stand at present and that this thread wrote."""
    return {path for path, (_, thread) in list(_written.items()) if thread == threading.get_ident()}


def place_of(df: DataFrame) -> str | None:
    """The path of a table that ``store`` returned."""
    return _places.get(df)


def release(*paths: str | DataFrame) -> None:
    """Delete the given paths or stored tables, or everything that this process wrote.

    Only tables that no later plan reads may be given.
    """
    for path in [p if isinstance(p, str) else place_of(p) for p in paths] if paths else list(_written):
        spark, _ = _written.pop(path, (None, 0)) if path else (None, 0)
        if spark is None:
            continue
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except (AttributeError, ConnectionError, Py4JError):  # the session has gone; the cluster's cleaner removes the folder
            return


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and each row's offsets in them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def batch_of(schema: pa.Schema, *columns: Any) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def row_slices(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes; a longer row stands alone."""
    out, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        out.append((lo, hi))
        lo = hi
    return out
