"""Small metadata files and listings on whatever file system Spark writes to."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _open(spark, path)
    return fs.exists(where)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, sorted, without hidden ones."""
    fs, where = _open(spark, path)
    if not fs.exists(where):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
    return sorted(name for name in found if not name.startswith((".", "_")))


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder, sorted, without hidden ones and drafts."""
    fs, where = _open(spark, path)
    if not fs.exists(where):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(where) if s.isFile()]
    return sorted(name for name in found if not name.startswith((".", "_")) and not name.endswith(".draft"))


def delete(spark: SparkSession, path: str) -> None:
    """A file or folder with all it holds; one that is not there is left alone."""
    fs, where = _open(spark, path)
    fs.delete(where, True)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Replace a small JSON file; readers see the old or the new one, never half of it."""
    _place(spark, path, value, "OVERWRITE")


def create_json(spark: SparkSession, path: str, value: dict) -> bool:
    """A new small JSON file, whole from the first moment on; False if there is one already, which stays."""
    try:
        _place(spark, path, value, "NONE")
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in str(error.java_exception.getClass().getName()):
            raise
        return False
    return True


def _place(spark: SparkSession, path: str, value: dict, how: str) -> None:
    fs, where = _open(spark, path)
    jvm = spark._jvm
    fs.mkdirs(where.getParent())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
    draft = where.suffix(f".{uuid.uuid4().hex}.draft")
    out = fs.create(draft, True)
    try:
        out.write(json.dumps(value, sort_keys=True).encode("utf-8"))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.valueOf(how)
    try:
        context.rename(draft, where, options)
    finally:
        fs.delete(draft, False)


def read_json(spark: SparkSession, path: str) -> dict | None:
    fs, where = _open(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
