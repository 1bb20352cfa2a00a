"""Where stored tables lie: below the shared folder of the session, and once a session for what queries share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STORED: dict[tuple[str, ...], str] = {}


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared folder that ``spark.checkpoint.dir`` names.

    Where that setting is missing, a local session (tests, notebooks) gets a temporary folder; on a cluster, whose
    machines would not find each other's files, it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="docweave-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def _stamp(spark: SparkSession, source: str) -> str:
    """What tells whether the files below a folder of tables changed: their number and bytes, and the folders' newest time."""
    at = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return ""
    known = fs.getContentSummary(at)
    return f"{known.getFileCount()} {known.getLength()} {max((s.getModificationTime() for s in fs.listStatus(at)), default=0)}"


def stored_once(spark: SparkSession, name: str, source: str, write: Callable[[str], None]) -> str:
    """The folder that ``write`` filled from ``source``, written when this session asks for it the first time, and again when
    the files of ``source`` changed since."""
    key = (spark.sparkContext.applicationId, name, source, _stamp(spark, source))
    if key not in _STORED:
        path = scratch(spark, name)
        write(path)
        _STORED[key] = path
    return _STORED[key]


def ship_package(spark: SparkSession, root: str) -> None:
    """Sends the modules below ``root`` to the workers, once a session; Spark serves the file from the driver."""
    if (spark.sparkContext.applicationId, "package", root) in _STORED:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="docweave-"), "docweave.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "docweave")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    spark.sparkContext.addPyFile(path)
    _STORED[spark.sparkContext.applicationId, "package", root] = path


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """component (the folder below ``path``), files and bytes, from the listing alone."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    below = F.regexp_extract("path", r"/" + path.rstrip("/").rsplit("/", 1)[-1] + r"/([^/]+)", 1)
    return rows.groupBy(below.alias("component")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def clear_component(spark: SparkSession, path: str, component: str) -> bool:
    """Deletes one component's folder; whether it was there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{component}")
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))
