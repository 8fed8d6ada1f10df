"""Working folders that every executor can see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temp folder only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.conf.get("spark.master", "").startswith("local"):
        return tempfile.gettempdir()
    raise ValueError("Set spark.checkpoint.dir to a folder all executors share")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path in the shared folder that nothing uses yet; what is written there goes when Spark ends."""
    parent = f"{shared_folder(spark)}/barlake-{purpose}-{uuid.uuid4().hex}"
    system, found = hadoop_path(spark, parent)
    system.mkdirs(found)
    system.deleteOnExit(found)
    return f"{parent}/{purpose}"


def kept(df: DataFrame) -> DataFrame:
    """`df` written to a folder of its own and read from there."""
    folder = new_folder(df.sparkSession, "kept")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def drop_kept(df: DataFrame) -> None:
    """Remove the folder of what `kept` gave, once nothing reads it any more."""
    for folder in {path.rpartition("/")[0] for path in df.inputFiles()}:
        remove_folder(df.sparkSession, folder.rpartition("/")[0])


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the Hadoop client Spark itself uses; driver-side metadata only."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def folder_exists(spark: SparkSession, path: str) -> bool:
    system, found = hadoop_path(spark, path)
    return system.exists(found)


def make_folder(spark: SparkSession, path: str) -> None:
    system, found = hadoop_path(spark, path)
    if not system.mkdirs(found):
        raise OSError(f"Cannot make {path}")


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files in a folder."""
    system, found = hadoop_path(spark, path)
    return system.getContentSummary(found).getLength()


def child_folders(spark: SparkSession, path: str, prefix: str) -> list[tuple[str, str]]:
    """(path, rest of the name) of the folders in `path` whose names begin with `prefix`."""
    system, found = hadoop_path(spark, path)
    if not system.exists(found):
        return []
    children = [(c.getPath().toString(), c.getPath().getName()) for c in system.listStatus(found) if c.isDirectory()]
    return sorted((p, n.removeprefix(prefix)) for p, n in children if n.startswith(prefix))


def rename_folder(spark: SparkSession, path: str, target: str) -> None:
    system, found = hadoop_path(spark, path)
    if not system.rename(found, hadoop_path(spark, target)[1]):
        raise OSError(f"Cannot rename {path} to {target}")


def remove_folder(spark: SparkSession, path: str) -> bool:
    system, found = hadoop_path(spark, path)
    return system.delete(found, True)
