"""Where steps put what they must not compute twice, and the helpers that every operator of this package shares."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share. Only a session within one process, as in
    tests, makes one of its own where it is unset; on a cluster no other place would do."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_recorded = threading.local()


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that ``cut`` writes meanwhile."""
    before, _recorded.paths = getattr(_recorded, "paths", None), []
    try:
        yield _recorded.paths
    finally:
        _recorded.paths = before


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: its lineage ends there, and a lost executor costs no work before it."""
    path = new_path(df.sparkSession, name)
    if getattr(_recorded, "paths", None) is not None:
        _recorded.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*made: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote and that nothing reads any more."""
    for df in made:
        for file in df.inputFiles()[:1]:
            _delete(df.sparkSession, file.rsplit("/", 1)[0])


def release(docs: DataFrame, paths: list[str]) -> None:
    """Deletes those of the recorded tables that ``docs`` does not read, and empties the list."""
    read = {file.rsplit("/", 2)[1] for file in docs.inputFiles()} if paths else set()
    for path in paths:
        if path.rsplit("/", 1)[1] not in read:
            _delete(docs.sparkSession, path)
    paths.clear()


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
