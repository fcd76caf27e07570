"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: \x20 and \x09-\x0D. bytes.split() uses the same six characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, which has to be set."""
    sc = spark.sparkContext
    where = sc._jsc.sc().getCheckpointDir()
    if where.isDefined():
        return where.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of about 4 MB in this session, where it has Spark's default of 64 MB: texts can be long, and a batch is
    held by the JVM and by a Python worker at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "67108864b") == "67108864b":
        spark.conf.set(name, "4194304b")


def kept(key: str, make: Callable):
    """make(), built once in a Python worker and kept for the tasks that come to it; only the value of the latest key is kept."""
    store = sys.modules.setdefault("callatlas_worker", types.ModuleType("callatlas_worker")).__dict__
    if store.get("key") != key:
        store.pop("value", None)
        store["value"], store["key"] = make(), key
    return store["value"]


def text_bytes(column: str = "text"):
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once, and only where the result is asked for."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
