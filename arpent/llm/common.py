"""What the training-data operators share: tables, materialised stages, Arrow mapping."""
from __future__ import annotations

import atexit
import contextlib
import functools
import sys
import tempfile
import threading
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Word separators in every contract: space and the ASCII controls 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only in local mode, where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/arpent-shared"
    return found.rstrip("/")


class _Scopes(threading.local):
    """What has to be dropped: by the operators that are running, innermost last."""

    def __init__(self):
        self.open: list[list[Callable[[], None]]] = []


_scopes = _Scopes()
_at_end: list[Callable[[], None]] = []


def drop_later(drop: Callable[[], None]) -> None:
    """Calls `drop` when the operator that is running has its result, or when the process ends."""
    (_scopes.open[-1] if _scopes.open else _at_end).append(drop)


@atexit.register
def _drop_rest() -> None:
    for drop in _at_end:
        try:
            drop()
        except Exception:  # noqa: BLE001 - the session has ended and can drop nothing more
            return


def settled(label: str):
    """For functions that return a DataFrame: it is written, and what was written for it is dropped."""

    def wrap(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(fn)
        def run(*args, **options) -> DataFrame:
            made: list[Callable[[], None]] = []
            _scopes.open.append(made)
            try:
                out = fn(*args, **options)
            except BaseException:
                _at_end.extend(made)
                raise
            finally:
                _scopes.open.pop()
            out = materialise(out, label)
            for drop in made:
                drop()
            return out

        return run

    return wrap


def drop_folder(spark: SparkSession, path: str) -> Callable[[], None]:
    where, conf = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()
    return lambda: where.getFileSystem(conf).delete(where, True)


_dropping: dict[int, tuple[int, str]] = {}  # for each session: how many are inside, and what the setting was
_dropping_lock = threading.Lock()


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, what an execution has shuffled is dropped at its end, not when the driver next collects garbage.

    The setting is the session's: where several threads share one, the last to leave puts it back.
    """
    key, session = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", id(spark)
    with _dropping_lock:
        inside, before = _dropping.get(session, (0, None))
        before = spark.conf.get(key, "false") if inside == 0 else before
        _dropping[session] = (inside + 1, before)
        spark.conf.set(key, "true")
    try:
        yield
    finally:
        with _dropping_lock:
            inside, before = _dropping.pop(session)
            if inside > 1:
                _dropping[session] = (inside - 1, before)
            else:
                spark.conf.set(key, before)


class Stage:
    """A written intermediate table. It outlives lost executors and cuts the lineage."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/arpent-{label}-{uuid.uuid4().hex}"
        self.schema = df.schema
        self.drop = drop_folder(self.spark, self.path)
        drop_later(self.drop)
        with shuffles_dropped(self.spark):
            df.write.option("compression", "zstd").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    return Stage(df, label).read()


def row_key(id_col: str, text_col: str) -> list[Column]:
    """(_id, _hash): rows are told apart by id and text, as ids may be null or repeated."""
    return [F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.xxhash64(F.col(text_col)).alias("_hash")]


def utf8(column: str | Column) -> Column:
    """UTF-8 bytes of a text, so that Python workers need not decode and encode again."""
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("binary")


def per_process(key: tuple, make: Callable[[], object]) -> object:
    """What `make` gives, once for each Python process.

    Functions may travel to the workers by value, with globals of their own for each task; modules
    of the interpreter stay.
    """
    held = sys.modules.setdefault("_arpent_held", types.ModuleType("_arpent_held")).__dict__.setdefault("objects", {})
    if key not in held:
        held[key] = make()
    return held[key]


def map_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, rows: int = 512) -> DataFrame:
    """Apply `fn` to Arrow batches of at most `rows` rows, so that a batch of long texts stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = fn(batch.slice(start, rows))
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)
