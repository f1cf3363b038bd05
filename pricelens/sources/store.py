"""Publishing in a shared folder: files that appear whole, pointers that name what counts, digests of inputs.

Data is written aside under a name of its own and counts from the moment that a pointer to it is put in place. Hadoop's file
systems are used for pointers, so any store that Spark writes to will do that renames a file at once.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import archives


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None where there is no such file."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write(fs, p, text: str) -> None:
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()


def put_new(spark: SparkSession, path: str, text: str, aside: str) -> bool:
    """Puts a small file in place unless there is one: of several writers one wins, and readers never see part of it."""
    p, fs = _path(spark, path)
    a, _ = _path(spark, aside)
    _write(fs, a, text)
    fs.mkdirs(p.getParent())
    none = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(a, p, none)
        return True
    except Exception as problem:
        fs.delete(a, False)
        if "FileAlreadyExists" not in str(problem):
            raise
        return False


def put(spark: SparkSession, path: str, text: str, aside: str) -> None:
    """Replaces a small file at once."""
    p, fs = _path(spark, path)
    a, _ = _path(spark, aside)
    _write(fs, a, text)
    fs.mkdirs(p.getParent())
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    over = spark._sc._gateway.new_array(options, 1)
    over[0] = options.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(a, p, over)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def content_digest(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """One row, n_rows and signature, of all files below a folder: names and SHA-256, read block by block by tasks."""
    files = archives.listing(spark, root, pattern)
    whole = files.selectExpr("path", "cast(null as string) as member", "cast(null as bigint) as header_at", "cast(null as bigint) as stored", "length as size",
                             "cast(null as int) as method", "cast(null as bigint) as crc", f"'{archives.OK}' as status")
    return archives.result_digest(archives.file_digests(whole).selectExpr("element_at(split(path, '/'), -1) as name", "bytes", "sha256"), ["name", "bytes", "sha256"])
