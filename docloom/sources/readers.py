"""Sources: files, columns and streams as (doc_id, source_name, media_type, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, recursive: bool = True, glob: str | None = None, include: str | None = None, exclude: str | None = None, hidden: bool = False) -> DataFrame:
    """Files below `path`; names are filtered before any content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return _files(reader.load(path), include, exclude, hidden)


def stream_files(spark: SparkSession, path: str, glob: str | None = None, per_trigger: int = 1000) -> DataFrame:
    """The same as a stream of new files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return _files(reader.load(path), None, None, False)


def _files(df: DataFrame, include: str | None, exclude: str | None, hidden: bool) -> DataFrame:
    if include:
        df = df.where(F.col("path").rlike(include))
    if exclude:
        df = df.where(~F.col("path").rlike(exclude))
    if not hidden:
        df = df.where(~F.col("path").rlike(r"/\.[^/]+$"))
    return df.select(F.col("path").alias("doc_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("source_name"), F.lit(None).cast("string").alias("media_type"), "content")


def from_text(df: DataFrame, key: str, text: str, extension: str = "txt", media_type: str | None = None) -> DataFrame:
    """A text column as documents."""
    return df.select(F.col(key).cast("string").alias("doc_id"), F.concat(F.col(key).cast("string"), F.lit(f".{extension}")).alias("source_name"), F.lit(media_type).cast("string").alias("media_type"), F.encode(text, "UTF-8").alias("content"))
