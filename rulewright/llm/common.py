"""Helpers shared by the corpus operators: scratch tables, shared-folder files, sharding by id."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let fewer rows go to Python at a time than Spark's 10,000, which of whole texts hold tens of MB on either side and
    in every worker that waits for its next task. A number that the user has set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where none is set (tests, one machine) a temporary one."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    conf = conf or spark.sparkContext.getCheckpointDir()
    if not conf:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
        conf = spark.sparkContext.getCheckpointDir()
    return conf.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, gives true sizes."""
    path, schema = scratch(df.sparkSession, tag), df.schema
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a scratch table that nothing reads any more. df: read from files of saved()."""
    spark, root = df.sparkSession, shared_dir(df.sparkSession)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {f.split("/kind=")[0].rsplit("/", 1)[0] if "/kind=" not in f else f.split("/kind=")[0] for f in df.inputFiles()}:
        path = hadoop(folder)
        if hadoop(root).toUri().getPath() in path.toUri().getPath():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard_part(df: DataFrame, part: str) -> None:
    """Delete one partition folder (kind=1) of a scratch table written by saved() that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.split(f"/{part}/")[0] for f in df.inputFiles() if f"/{part}/" in f}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished steps now. It does so when the driver collects its garbage, which a
    driver with little to do may put off until long after a job of many steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give memory that is free back to the system. Workers wait between tasks, several to an executor; what the last
    batch needed should not stay with them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path of a folder URI (file, hdfs, s3, gs, plain paths)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def commit(filesys: pafs.FileSystem, temp: str, final: str) -> None:
    """Give a finished file its final name. A repeated task writes the same bytes, so a file that has the name already
    stays: there is no moment at which a finished file is missing."""
    if filesys.get_file_info(final).type != pafs.FileType.NotFound:
        filesys.delete_file(temp)
    else:
        filesys.move(temp, final)


def crc_bucket(col: Column, n: int) -> Column:
    return F.pmod(F.crc32(col.cast("string")), F.lit(n))


def id_boundaries(df: DataFrame, id_col: str, n_shards: int, sample: int = 20_000) -> np.ndarray:
    """Ascending ids that cut df into n_shards ranges of about as many rows.

    They come from a sample by hash of the id (about `sample` ids, whatever the size of df), so they don't depend on
    how df is partitioned. Only their place is sampled; every row goes to a shard.
    """
    if n_shards <= 1:
        return np.array([], dtype=np.int64)
    step = max(1, df.count() // sample)
    ids = df.where(F.pmod(F.xxhash64(id_col), F.lit(step)) == 0).select(F.col(id_col).cast("long").alias("i")).where("i is not null").distinct()
    got = np.sort(ids.toPandas()["i"].to_numpy(dtype=np.int64))
    if not len(got):
        return np.array([], dtype=np.int64)
    return np.unique(got[(np.arange(1, n_shards) * len(got)) // n_shards])


def shard_column(id_col: str, boundaries: np.ndarray) -> Column:
    """The range that an id falls into; a null id falls into the first."""

    @F.pandas_udf("int")
    def shard(ids: pd.Series) -> pd.Series:
        values = ids.fillna(np.iinfo(np.int64).min).astype("int64").to_numpy() if ids.hasnans else ids.to_numpy(dtype="int64")
        return pd.Series(np.searchsorted(boundaries, values, side="right").astype("int32"))

    return shard(F.col(id_col).cast("long")) if len(boundaries) else F.lit(0)
