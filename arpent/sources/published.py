"""Files named by their content: a Spark data source `published_files` that rows are written to.

    files.write.format("published_files").mode("append").save("s3://bucket/site")

Each row (prefix, extension, content) becomes the file `prefix-digest.extension`, where the digest is
the first 16 digits of the SHA-256 of its bytes, so equal content has one name on every build, and a
file never changes under its name. Tasks write to a folder of the build that no reader looks at, hash
on the way and report names and sizes; the driver, on commit, checks the number and size of files,
moves them to their names and writes `manifest.json` last, so readers see a whole build or the one
before. A task that fails removes what it wrote; abort removes the build's folder, which also holds
what lost executors or second attempts left behind.

The driver holds one entry for each file, at most `most_files`; contents stay in the tasks. Two rows
with one prefix and content are one file; two contents under one prefix are two files. With
`named_by=prefix` files are plain `prefix.extension`, where a prefix may hold folders; then two
contents under one name fail the build. Null content is
an empty file, null prefix or extension fails. Files of earlier builds stay, as their names may be in
use; the manifest names those of the last build.
"""
from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .stores import store

DIGITS = 16
MOST_FILES, MOST_BYTES = 20_000, 25 << 20  # fixed values: what the host of the files takes
MANIFEST = "manifest.json"


class TooLarge(ValueError):
    """The build has more or larger files than the host takes."""


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str, str, int, str]] = field(default_factory=list)  # name, place, prefix, bytes, SHA-256


class PublishedWriter(DataSourceWriter):
    def __init__(self, path: str, most_files: int, most_bytes: int, about: dict, by_content: bool):
        self.path, self.most_files, self.most_bytes, self.about, self.by_content = path.rstrip("/"), most_files, most_bytes, about, by_content
        self.build = f"{self.path}/_build-{uuid.uuid4().hex}"
        system, build = store(self.build)
        system.create_dir(build, recursive=True)  # once, here: a task that outlives an abort finds no folder and fails

    def write(self, iterator: Iterator[Row]) -> Written:
        system, build = store(self.build)
        done = Written()
        try:
            for row in iterator:
                content = row["content"] if row["content"] is not None else b""
                content = content.encode() if isinstance(content, str) else bytes(content)
                if row["prefix"] is None or row["extension"] is None:
                    raise ValueError("a file has no prefix or extension")
                digest, place = hashlib.sha256(content).hexdigest(), f"{build}/{uuid.uuid4().hex}"
                stem = f"{row['prefix']}-{digest[:DIGITS]}" if self.by_content else row["prefix"]
                done.files.append((f"{stem}.{row['extension']}", place, row["prefix"], len(content), digest))
                with system.open_output_stream(place) as f:
                    f.write(content)
            return done
        except BaseException:
            for _, place, *_ in done.files:
                try:
                    system.delete_file(place)
                except OSError:
                    continue  # was not begun
            raise

    def commit(self, messages: list[Written | None]) -> None:
        system, base = store(self.path)
        every = [f for m in messages if m is not None for f in m.files]
        files = {f[0]: f for f in every}
        clash = next((f[0] for f in every if f[4] != files[f[0]][4]), None)
        if clash is not None:
            self.abort(messages)
            raise ValueError(f"two contents for {clash}")
        largest = max((f[3] for f in files.values()), default=0)
        if len(files) > self.most_files or largest > self.most_bytes:
            self.abort(messages)
            raise TooLarge(f"{len(files)} files of at most {self.most_files}, the largest has {largest} bytes of at most {self.most_bytes}")
        for folder in {name.rpartition("/")[0] for name in files} - {""}:
            system.create_dir(f"{base}/{folder}", recursive=True)
        for name, place, *_ in files.values():
            system.move(place, f"{base}/{name}")
        listed = [{"name": name, "prefix": prefix, "bytes": size, "sha256": digest} for name, _, prefix, size, digest in sorted(files.values())]
        place = f"{store(self.build)[1]}/{MANIFEST}"
        with system.open_output_stream(place) as f:
            f.write(json.dumps({**self.about, "version": 1, "files": listed}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode())
        system.move(place, f"{base}/{MANIFEST}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, build = store(self.build)
        for wait in (0.1, 0.5, 2, 0):  # tasks that are being stopped may still add files
            try:
                return system.delete_dir(build)
            except FileNotFoundError:
                return
            except OSError:
                if not wait:
                    raise
                time.sleep(wait)


class PublishedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "published_files"

    def writer(self, schema: StructType, overwrite: bool) -> PublishedWriter:
        lacking = [c for c in ("prefix", "extension", "content") if c not in schema.names]
        if lacking:
            raise ValueError(f"missing columns {', '.join(lacking)}")
        o = self.options
        return PublishedWriter(o["path"], int(o.get("most_files", MOST_FILES)), int(o.get("most_bytes", MOST_BYTES)), json.loads(o.get("about", "{}")), o.get("named_by", "content") == "content")


def publish(files: DataFrame, path: str, about: dict | None = None, **options) -> DataFrame:
    """Writes the files and returns the manifest; `about` is added to it."""
    spark = files.sparkSession
    spark.dataSource.register(PublishedFiles)
    files.select("prefix", "extension", "content").write.format(PublishedFiles.name()).mode("append").option("about", json.dumps(about or {})).options(**options).save(path)
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, prefix, bytes, sha256) of the last build."""
    whole = spark.read.text(f"{path.rstrip('/')}/{MANIFEST}", wholetext=True)
    return whole.select(F.inline(F.expr("from_json(value, 'files array<struct<name string, prefix string, bytes bigint, sha256 string>>').files")))


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the manifest's files; content that does not match its digest fails."""
    found = spark.read.format("binaryFile").load(f"{path.rstrip('/')}/*-*.*").select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    both = read_manifest(spark, path).join(found, "name", "left")
    both = both.withColumn("content", F.when(F.col("bytes") == 0, F.lit(b"")).otherwise(F.col("content")))  # the scan leaves empty files out
    wrong = F.coalesce(F.sha2("content", 256), F.lit("")) != F.col("sha256")
    return both.select("name", F.when(~wrong, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("damaged or missing: "), "name")).cast("binary")).alias("content"))
