"""Readers of document folders and tables, and writers of revisions and bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Extensions and the format that each declares (fixed values).
FORMATS = {
    "pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "txt": "txt", "md": "markdown", "html": "html", "htm": "html", "csv": "csv", "json": "json", "xml": "xml",
    "png": "image", "jpg": "image", "jpeg": "image", "tiff": "image", "webp": "image",
}


def folder(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modified, size, sha, format, content) of every file below a folder."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return d.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha"), declared_format(F.col("path")).alias("format"), "content")


def declared_format(path) -> Column:
    """The format that a file name's extension declares, null for others."""
    ext = F.lower(F.element_at(F.split(path, r"\."), -1))
    pairs = [x for k, v in FORMATS.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), ext)


def sniffed_format(content) -> Column:
    """The format that the first bytes tell: pdf, zip containers, images, html and xml, else txt."""
    head = F.hex(F.substring(content, 1, 16))
    text = F.lower(F.substring(content, 1, 64).cast("string"))
    return (
        F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "zip").when(head.startswith("89504E47") | head.startswith("FFD8FF") | head.startswith("49492A00"), "image")
        .when(text.contains("<!doctype html") | text.contains("<html"), "html").when(text.startswith("<?xml"), "xml").otherwise("txt")
    )


def jsonl(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """Typed JSON lines; a malformed line or a key that repeats fails."""
    d = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    repeated = d.groupBy(key).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{key} {repeated[0][0]} repeats")
    return d


def append_revision(df: DataFrame, path: str, revision: str, expected: str | None, head: str | None) -> str:
    """Writes a revision's folder if the head is the one expected; writing the head's own revision
    again changes nothing. Returns the new head."""
    if head == revision:
        return head
    if head != expected:
        raise ValueError(f"the head is {head}, not {expected}")
    df.write.mode("errorifexists").parquet(f"{path}/revision={revision}")
    return revision


def record_bundle(projected: DataFrame, path: str) -> None:
    """One folder of JSON lines for each collection and language."""
    projected.write.mode("overwrite").partitionBy("collection", "lang").json(path)
