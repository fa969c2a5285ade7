"""Versioned folders on shared storage: written beside the old one, visible once complete.

``base/v=N`` is claimed by creating a file once and counts when its marker is there, so
readers see the newest complete version as a whole or the one before it, never a mixture.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

COMPLETE = "_COMPLETE"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def list_versions(spark: SparkSession, base: str) -> list[int]:
    """Versions that were written to their end."""
    fs, p = _fs(spark, base)
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()
                  and exists(spark, f"{base.rstrip('/')}/{n}/{COMPLETE}"))


def _created(spark: SparkSession, path: str) -> bool:
    """Creates an empty file; false if it is there already.  Shared stores refuse to create a
    file twice; Hadoop's local file system does not, so there the file is made directly."""
    fs, p = _fs(spark, path)
    if fs.getUri().getScheme() == "file":
        fs.mkdirs(p.getParent())
        return spark.sparkContext._jvm.java.io.File(p.toUri().getPath()).createNewFile()
    try:
        fs.create(p, False).close()
    except Py4JJavaError as e:
        if fs.exists(p):
            return False
        raise e
    return True


def claim_version(spark: SparkSession, base: str) -> int:
    """The next version number, this caller's alone: a claim file is created without
    overwriting, and who comes second takes the number after it."""
    n = (list_versions(spark, base) or [0])[-1] + 1
    while not _created(spark, f"{base.rstrip('/')}/claims/{n}"):
        n += 1
    return n


def publish(spark: SparkSession, base: str, write: Callable[[str], object]) -> str:
    """``write`` fills a new version folder; readers see it when all of it is there.  If
    ``write`` fails, they stay on the version before."""
    path = f"{base.rstrip('/')}/v={claim_version(spark, base)}"
    write(path)
    _created(spark, f"{path}/{COMPLETE}")
    return path


def current(spark: SparkSession, base: str) -> str:
    """The newest complete version; ``base`` itself where nothing was ever published.  A
    job resolves it once and reads all its tables below what it got."""
    versions = list_versions(spark, base)
    if versions:
        return f"{base.rstrip('/')}/v={versions[-1]}"
    if exists(spark, f"{base.rstrip('/')}/claims"):
        raise FileNotFoundError(f"no version below {base} is complete")
    return base.rstrip("/")
