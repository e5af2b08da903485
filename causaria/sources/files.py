"""Small files on whatever store the session reads: local folders and remote ones alike, by Hadoop's file systems."""

from __future__ import annotations

from functools import lru_cache
from urllib.parse import unquote

from pyspark import SparkContext
from pyspark.sql import SparkSession


@lru_cache(maxsize=1)
def _hadoop(context: SparkContext):
    """The path class and the configuration, looked up once: a lookup costs more than a rename."""
    return context._jvm.org.apache.hadoop.fs.Path, context._jsc.hadoopConfiguration()


def _at(spark: SparkSession, path: str):
    new, conf = _hadoop(spark.sparkContext)
    p = new(str(path))
    return p.getFileSystem(conf), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """In one step where the store renames in one: written beside, then renamed over the old one."""
    fs, p = _at(spark, path)
    _, beside = _at(spark, f"{path}.tmp")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"{path}: can't be renamed from {path}.tmp")


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders inside path that hold data."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and not s.getPath().getName().startswith(("_", ".")))


def names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def data(spark: SparkSession, path: str) -> list[str]:
    """A table's data files, by their paths below its folder; none where it isn't there."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return []
    out, found, base = [], fs.listFiles(p, True), fs.getFileStatus(p).getPath().toString()
    while found.hasNext():
        f = found.next().getPath().toString()[len(base) + 1 :]
        if not any(part.startswith(("_", ".")) for part in f.split("/")):
            out.append(f)
    return sorted(out)


def mkdirs(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.mkdirs(p)


def move(spark: SparkSession, path: str, to: str) -> None:
    """A rename; a path that isn't there is none."""
    fs, p = _at(spark, path)
    _, new = _at(spark, to)
    if fs.exists(p) and not fs.rename(p, new):
        raise OSError(f"{path}: can't be moved to {to}")


def partitions(spark: SparkSession, path: str, name: str) -> list[tuple[str, str]]:
    """(value, file) of a folder written by partitions of one column, each of one file."""
    fs, p = _at(spark, path)
    out, base, paths = {}, fs.getFileStatus(p).getPath().toString(), spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths
    for at in paths(fs.listStatus(paths(fs.listStatus(p)))):  # all folders' files by one call
        f = at.toString()
        folder, _, file = f[len(base) + 1 :].rpartition("/")
        if folder.startswith(f"{name}=") and file.startswith("part-"):
            value = unquote(folder[len(name) + 1 :])
            if value in out:
                raise ValueError(f"{path}/{folder}: more than one file")
            out[value] = f
    return sorted(out.items())


def replace(spark: SparkSession, source: str, to: str) -> None:
    """source (a file or folder) in place of to, by a rename; a source that is gone has been moved before."""
    fs, s = _at(spark, source)
    _, t = _at(spark, to)
    if not fs.exists(s):
        return
    fs.mkdirs(t.getParent())
    fs.delete(t, True)
    if not fs.rename(s, t):
        raise OSError(f"{source}: can't be moved to {to}")


def swap(spark: SparkSession, live: str, beside: str, keep: str | None = None) -> None:
    """beside in place of live, by two renames: a driver lost between them leaves live's rows in live.old, and recovered() puts them back. keep: where those rows go in the end, instead of being deleted."""
    old = f"{live.rstrip('/')}.old"
    delete(spark, old)
    move(spark, live, old)
    move(spark, beside, live)
    if keep is None:
        delete(spark, old)
    else:
        mkdirs(spark, keep.rsplit("/", 1)[0])
        move(spark, old, keep)


def recovered(spark: SparkSession, live: str) -> None:
    """Undoes a swap that was cut short: rows moved aside go back where nothing took their place."""
    fs, p = _at(spark, live)
    _, old = _at(spark, f"{live.rstrip('/')}.old")
    if fs.exists(old):
        fs.delete(old, True) if fs.exists(p) else fs.rename(old, p)
