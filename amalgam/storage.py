"""Where intermediate tables go: the folder that driver and executors share; and small text files on any file system."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_base: dict[str, str] = {}
_scopes: list[list[str]] = []


def work_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a temporary folder stands in, but only in local mode, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_base:
        _own_base[app] = tempfile.mkdtemp(prefix="amalgam-")
    return _own_base[app]


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there and survives lost executors."""
    path = f"{work_base(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what :func:`materialize` has written inside; frames that read it must have been written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            fs, p = _hadoop(path, spark)
            fs.delete(p, True)


def _hadoop(path: str, spark: SparkSession | None = None):
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError(f"a Spark session is needed to reach {path}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _remote(path: str) -> bool:
    return "://" in path and not path.startswith("file:")


def _local(path: str) -> Path:
    return Path(path.removeprefix("file://").removeprefix("file:"))


def read_text(path: str) -> str | None:
    """The text of a file on any file system Spark knows; None if there is none."""
    if not _remote(path):
        p = _local(path)
        return p.read_text(encoding="utf-8") if p.exists() else None
    fs, p = _hadoop(path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return SparkSession.getActiveSession()._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """A file that is whole or as it was: written beside and moved over."""
    beside = f"{path}.{uuid.uuid4().hex}"
    if not _remote(path):
        p = _local(path)
        p.parent.mkdir(parents=True, exist_ok=True)
        _local(beside).write_text(text, encoding="utf-8")
        os.replace(_local(beside), p)
        return
    create_text(beside, text)
    spark, (_, p), (_, tmp) = SparkSession.getActiveSession(), _hadoop(path), _hadoop(beside)
    jvm = spark._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(tmp, p, how)


def create_text(path: str, text: str) -> bool:
    """Creates a file; False if it is there already. Of several that try, one succeeds."""
    if not _remote(path):
        p = _local(path)
        p.parent.mkdir(parents=True, exist_ok=True)
        try:
            with open(p, "x", encoding="utf-8") as f:
                f.write(text)
        except FileExistsError:
            return False
        return True
    fs, p = _hadoop(path)
    if fs.exists(p):
        return False
    try:
        stream = fs.create(p, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def move_away(path: str) -> bool:
    """Moves a file out of the way; of several that try, one succeeds."""
    beside = f"{path}.{uuid.uuid4().hex}"
    if not _remote(path):
        try:
            os.rename(_local(path), _local(beside))
        except FileNotFoundError:
            return False
        _local(beside).unlink()
        return True
    fs, p = _hadoop(path)
    tmp = _hadoop(beside)[1]
    try:
        moved = fs.exists(p) and fs.rename(p, tmp)
    except Exception as e:
        if "FileNotFound" not in str(e):
            raise
        moved = False
    if moved:
        fs.delete(tmp, False)
    return bool(moved)
