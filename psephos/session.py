"""Sessions: what a query needs of the one it is given."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application.

    Python workers import functions by name; where the package isn't installed on an executor, it
    comes from this archive.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="psephos-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(name)
    _SHIPPED.add(context.applicationId)


_FOLDERS: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which driver and executors share.

    It is removed when the driver's JVM ends.  Only a local session, as in tests, may leave the setting
    unset: then a temporary folder of this machine is set.  On several machines that would lose rows,
    so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="psephos-")
        spark.conf.set("spark.checkpoint.dir", base)
    key = context.applicationId, base
    if key not in _FOLDERS:
        _FOLDERS[key] = f"{base.rstrip('/')}/psephos-{context.applicationId}-{uuid.uuid4().hex[:8]}"
        folder = context._jvm.org.apache.hadoop.fs.Path(_FOLDERS[key])
        files = folder.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return _FOLDERS[key]


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a path that no later job reads."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
