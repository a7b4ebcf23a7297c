"""Tables that are replaced whole: each version is a folder of its own, and a pointer names the current one.

The pointer is a small file that is renamed over the old one once all tables of a version are written, so that readers
see the old version or the new one, never a part, and a job that is lost leaves the old one in place.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> tuple[str, str] | None:
    """(folder of the current version, mark that its writer gave it), or None before the first."""
    at, fs = _files(spark, f"{root}/{POINTER}")
    if not fs.exists(at):
        return None
    version, mark = spark.read.text(f"{root}/{POINTER}", wholetext=True).first()[0].split("\n")[:2]
    return f"{root}/{version}", mark


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, mark: str = "") -> str:
    """Write the tables as a new version and make it the current one."""
    folder = new_version(root)
    for name, frame in tables.items():
        frame.write.parquet(f"{folder}/{name}")
    return make_current(spark, folder, mark)


def new_version(root: str) -> str:
    """The folder of a version that nobody reads yet."""
    return f"{root}/v-{uuid.uuid4().hex}"


def make_current(spark: SparkSession, folder: str, mark: str = "") -> str:
    """Point at a version whose tables are all written; the version before the last is deleted."""
    root, version = folder.rsplit("/", 1)
    before = current(spark, root)
    new, fs = _files(spark, f"{root}/_{version}")
    out = fs.create(new, True)
    out.write(f"{version}\n{mark}\n".encode())
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration()).rename(new, hadoop.Path(f"{root}/{POINTER}"), overwrite)
    at, _ = _files(spark, root)
    keep = {version, before[0].rsplit("/", 1)[-1] if before else version}
    for s in fs.listStatus(at):
        if s.isDirectory() and s.getPath().getName().startswith("v-") and s.getPath().getName() not in keep:
            fs.delete(s.getPath(), True)
    return folder


def delete_folder(spark: SparkSession, path: str) -> None:
    at, fs = _files(spark, path)
    fs.delete(at, True)


def mark_of(spark: SparkSession, *paths: str) -> str:
    """A mark of the files below the paths, by name, length and time: another one once any of them has changed. Their
    contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("path", "length", "modificationTime")
    n, total = files.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return f"{n} {total}"


def refreshed(spark: SparkSession, root: str, mark: str, build: Callable[[str], None]) -> str:
    """The folder of the current version if it has this mark, else of a new one that build(folder) writes."""
    found = current(spark, root)
    if found and found[1] == mark:
        return found[0]
    folder = new_version(root)
    build(folder)
    return make_current(spark, folder, mark)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir, or a folder of our own where that is unset on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-sylvan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
