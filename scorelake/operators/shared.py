"""Tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only where it is unset in local mode (tests) a temporary folder stands in; a
    cluster without it is an error.
    """
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rsplit("/", 1)[0]  # a folder of this application's own lies in it
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="scorelake-"))
    return shared_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint: its rows stand in the shared folder and are never made again, whatever executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return (system.getRawFileSystem() if system.getScheme() == "file" else system), where  # the raw one leaves no checksum files


def assembled(target: str, sections: Iterable[str | DataFrame], spark: SparkSession) -> str:
    """``target``, one file of texts and tables in their order; a table gives its ``line`` column, a line a row, in order of its other columns.

    Executors write the tables as ordered part files; their bytes are then copied
    one after another by the file systems, without passing through Python. The
    file appears under its name once it is whole.
    """
    work = f"{shared_folder(spark)}/assembled/{uuid.uuid4().hex}"
    folders = []
    for k, section in enumerate(sections):
        if isinstance(section, str):
            folders.append(section.encode())
            continue
        keys = [c for c in section.columns if c != "line"]
        section.orderBy(*keys).select("line").write.text(f"{work}/{k}")
        folders.append(f"{work}/{k}")
    system, where = _file_system(spark, target)
    partial = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}-{uuid.uuid4().hex}")
    out = system.create(partial, True)
    try:
        for section in folders:
            if isinstance(section, bytes):
                out.write(bytearray(section))
                continue
            source, folder = _file_system(spark, section)
            parts = sorted(str(f.getPath()) for f in source.listStatus(folder) if f.getPath().getName().startswith("part-"))
            for part in parts:
                stream = source.open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part))
                spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
                stream.close()
    finally:
        out.close()
    system.delete(where, False)
    if not system.rename(partial, where):
        raise OSError(f"cannot write {target}")
    store, folder = _file_system(spark, work)
    store.delete(folder, True)
    return target
