"""Members of application archives: printable strings and signature blocks. Unzipping has no native form, so a batch of
archives goes through Arrow; everything after it is columns."""

from __future__ import annotations

import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_runs

CODE_OR_ASSET = re.compile(r"\.dex$|^assets/.*[^/]$")
SIGNATURE_BLOCK = re.compile(r"^META-INF/[^/]+\.(RSA|DSA|EC)$")


def members(spark: SparkSession, path: str, wanted: re.Pattern) -> DataFrame:
    """path, name, content of the archives' members whose name matches; broken archives have none."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for where, content in zip(batch["path"].to_pylist(), batch["content"]):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content.as_py()))
                    names = [n for n in archive.namelist() if wanted.search(n)]
                except zipfile.BadZipFile:
                    continue
                for name in names:
                    yield pa.RecordBatch.from_arrays([pa.array([where]), pa.array([name]), pa.array([archive.read(name)], pa.binary())], ["path", "name", "content"])

    return files.mapInArrow(run, "path string, name string, content binary")


def strings(spark: SparkSession, path: str, least: int = 4) -> DataFrame:
    """path, value: printable runs of code and assets."""
    return members(spark, path, CODE_OR_ASSET).select("path", F.explode(ascii_runs(F.col("content"), least)).alias("value"))


def certificates(spark: SparkSession, path: str) -> DataFrame:
    c = F.col("content")
    return members(spark, path, SIGNATURE_BLOCK).select("path", F.col("name").alias("file"), F.sha2(c, 256).alias("sha256"), F.length(c).alias("size"), F.base64(F.substring(c, 1, 64)).alias("base64_prefix"))
