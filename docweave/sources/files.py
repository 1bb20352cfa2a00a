"""Files as tables: binary inputs, texts in doubtful encodings, artefacts as JSON lines, lists of paths."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_PAIR = T.StructType([T.StructField("model", T.StringType()), T.StructField("part", T.StringType())])
_FIELDS = {"doc_id": T.LongType(), "source": T.StringType(), "pairs": T.ArrayType(_PAIR), "markdown": T.StringType(), "metadata": T.StringType(), "markdown_length": T.LongType(), "pairs_count": T.LongType()}
#: Columns of parsed documents as they are stored; needs no running session.
ARTEFACT = T.StructType([T.StructField(n, t) for n, t in _FIELDS.items()])


def read_files(spark: SparkSession, path: str, recursive: bool = False, glob: str = "*.{pdf,txt,md}") -> DataFrame:
    """path, modificationTime, length, content of the matching files; one row per path."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).dropDuplicates(["path"])


def resolved(lists: Sequence[DataFrame]) -> DataFrame:
    """path, place of several lists of (path), or (path, place), one behind the other: each path once, where it came first."""
    parts = []
    for i, df in enumerate(lists):
        place = F.col("place") if "place" in df.columns else F.monotonically_increasing_id()
        parts.append(df.select("path", F.struct(F.lit(i).alias("list"), place.cast("bigint").alias("at")).alias("first")))
    rows = reduce(DataFrame.unionByName, parts).where("path is not null").groupBy("path").agg(F.min("first").alias("first"))
    return rows.select("path", F.col("first.list").alias("list"), F.col("first.at").alias("at"))


def resolve(spark: SparkSession, sources: Sequence[str], recursive: bool = False) -> DataFrame:
    """path, list, at of what sources name, in their order: URLs as they are, a folder's files of the three kinds (PDF, then
    text, then Markdown, by name), a file or pattern's matches; what matches nothing is left out."""
    lists = []
    for source in sources:
        if source.startswith(("http://", "https://")):
            lists.append(spark.createDataFrame([(source, 0)], "path string, place bigint"))
            continue
        at = spark._jvm.org.apache.hadoop.fs.Path(source)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        try:
            folder = fs.getFileStatus(at).isDirectory()
        except Exception:  # noqa: BLE001  Py4J wraps what Java threw: no such file, perhaps a pattern
            folder = False
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive and folder).lower())
        if folder:
            reader = reader.option("pathGlobFilter", "*.{pdf,txt,md}")
        elif not fs.globStatus(at):
            continue
        name = F.lower(F.col("path"))
        kind = F.when(name.endswith(".pdf"), 0).when(name.endswith(".txt"), 1).when(name.endswith(".md"), 2)
        found = reader.load(source).select("path", kind.alias("kind"))
        if not folder:  # files that match, not those of folders that do
            found = found.where(F.size(F.split("path", "/")) == fs.makeQualified(at).toString().count("/") + 1)
        if folder or any(c in source for c in "*?[{"):
            found = found.where("kind is not null")
        order = Window.orderBy(*(["kind", "path"] if folder else ["path"]))  # names of one source's files
        lists.append(found.select("path", F.row_number().over(order).cast("bigint").alias("place")))
    return resolved(lists) if lists else spark.createDataFrame([], "path string, list int, at bigint")


@F.pandas_udf(T.StringType())
def _without_bad_bytes(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def decoded(content: Column) -> Column:
    """UTF-8 if the bytes are valid, else Latin-1, which takes any byte, so that nothing is left for a third encoding."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def decoded_leniently(content: Column) -> Column:
    """UTF-8 without the bytes that are none of it; only rows that have some go to Python."""
    valid = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(valid, _without_bad_bytes(F.when(valid.isNull(), content)))


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """Paths named in a text file, one a line, blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def url_identity(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def file_identity(source: Column, content_hash: Column) -> Column:
    """Stem of the name, eight characters of the content's hash, eight of the path's."""
    stem = F.regexp_replace(F.substring_index(source, "/", -1), r"\.[a-z]+$", "")
    return F.concat_ws("_", stem, F.substring(content_hash, 1, 8), F.substring(F.sha2(source, 256), 1, 8))


def artefacts(registry: DataFrame, keep_text: bool = False) -> DataFrame:
    """Artefact rows of registered documents, with derived lengths and counts."""
    text = F.col("text") if keep_text else F.lit(None).cast("string")
    return registry.select("doc_id", "source", "pairs", text.alias("markdown"), "metadata", F.col("size").alias("markdown_length"), F.size("pairs").cast("bigint").alias("pairs_count"))


def artefact_to_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*ARTEFACT.names)).alias("value"))


def artefact_from_json(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("value", ARTEFACT).alias("a")).select("a.*")


def write_artefacts(rows: DataFrame, path: str) -> None:
    artefact_to_json(rows).write.text(path)


def read_artefacts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARTEFACT).json(path)
