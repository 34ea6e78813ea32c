"""Where files lie: any store that pyarrow can open by its address, and the folder all executors share."""
from __future__ import annotations

import atexit
import posixpath
import tempfile
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def store(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of an address such as file:///a, hdfs://host/a or s3://bucket/a."""
    system, inside = fs.FileSystem.from_uri(path)
    return system, inside


def listed(path: str, suffixes: tuple[str, ...] = ()) -> list[str]:
    """The addresses of the files in a folder, in order of their paths, or the file itself; hidden files are left out."""
    system, inside = store(path)
    info = system.get_file_info(inside)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    head = path.rstrip("/")[: len(path.rstrip("/")) - len(inside.rstrip("/"))]
    found = [f.path for f in system.get_file_info(fs.FileSelector(inside, recursive=True)) if f.type == fs.FileType.File]
    names = (f for f in found if not any(part[:1] in "._" for part in posixpath.relpath(f, inside).split("/")))
    return [head + f for f in sorted(names) if not suffixes or f.lower().endswith(suffixes)]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a local one only in local mode where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/arpent-shared"
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/arpent-{label}-{uuid.uuid4().hex}"


def _drop(spark: SparkSession, path: str) -> Callable[[], object]:
    where, conf = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()
    return lambda: where.getFileSystem(conf).delete(where, True)


def _at_end(drop: Callable[[], object]) -> None:
    try:
        drop()
    except Exception:  # noqa: BLE001 - the session has ended and can drop nothing more
        return


class Scratch:
    """Tables that one computation reads several times, in the shared folder; they are gone when it ends.

        with Scratch(spark) as s:
            narrow = s.written(sales.select("section", "price"))
            return s.result(some_join_of(narrow))
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            _drop(self.spark, path)()

    def _table(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def written(self, df: DataFrame) -> DataFrame:
        self.paths.append(fresh_dir(self.spark, "scratch"))
        return self._table(df, self.paths[-1])

    def result(self, df: DataFrame) -> DataFrame:
        """The table that is handed on; it is dropped when the process ends."""
        path = fresh_dir(self.spark, "result")
        atexit.register(_at_end, _drop(self.spark, path))
        return self._table(df, path)
