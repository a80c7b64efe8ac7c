"""A sink with a commit of its own: a version is visible as a whole or not at all.

Each task writes one Parquet part below the version's folder and reports it in
its commit message. The driver's commit writes the manifest of the version,
which lists the parts of the tasks that count, and then moves the pointer; an
abort removes the reported parts and moves nothing. Parts of failed, lost or
repeated task attempts have names of their own and are in no manifest, so no
reader ever sees them. A reader follows the pointer to a manifest and reads
its parts.

Guards run inside the tasks: columns that must not be NULL, and a key of rows
that must be finite numbers. A row that breaks one fails the write. An empty
table gives a version without parts, which reads as an empty table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

POINTER = "CURRENT.json"


class GuardError(ValueError):
    """A row breaks a rule of the version it was meant for."""


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    system, place = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    return system, place.rstrip("/")


def _put(system: fs.FileSystem, path: str, content: dict) -> None:
    """Written aside and moved, where the store can move; object stores replace an object in one step."""
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    aside = f"{path}.{uuid.uuid4().hex}" if isinstance(system, fs.LocalFileSystem) else path
    with system.open_output_stream(aside) as out:
        out.write(json.dumps(content, sort_keys=True).encode())
    if aside != path:
        system.move(aside, path)


def _get(system: fs.FileSystem, path: str) -> dict | None:
    if system.get_file_info(path).type != fs.FileType.File:
        return None
    with system.open_input_stream(path) as f:
        return json.loads(f.read())


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int


class VersionWriter(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.names = schema.fieldNames()
        self.folder, self.version = options["folder"], options["version"]
        self.required = [c for c in options.get("required", "").split(",") if c]
        self.finite = [c for c in options.get("finite", "").split(",") if c]

    def check(self, batch: pa.RecordBatch) -> None:
        for name in self.required:
            if batch[name].null_count:
                raise GuardError(f"{name} is NULL in {batch[name].null_count} rows")
        for name in self.finite:
            if not pc.all(pc.fill_null(pc.is_finite(batch[name].cast(pa.float64())), False), min_count=0).as_py():
                raise GuardError(f"{name} is not a finite number in every row")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, place = _store(self.folder)
        number = TaskContext.get().partitionId()
        path = f"{place}/data/{self.version}/part-{number:06d}-{uuid.uuid4().hex}.parquet"
        rows, writer = 0, None
        try:
            for batch in iterator:
                self.check(batch)
                if writer is None:
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    writer = pq.ParquetWriter(path, batch.schema, filesystem=system)
                writer.write_batch(batch)
                rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return Part(path if rows else "", rows)

    def commit(self, messages: list[Part | None]) -> None:
        system, place = _store(self.folder)
        parts = sorted((m.path, m.rows) for m in messages if m is not None and m.rows)
        before = _get(system, f"{place}/{POINTER}")
        manifest = {"version": self.version, "parts": [p for p, _ in parts], "rows": sum(n for _, n in parts), "after": before and before["version"]}
        _put(system, f"{place}/versions/{self.version}.json", manifest)
        _put(system, f"{place}/{POINTER}", {"version": self.version})

    def abort(self, messages: list[Part | None]) -> None:
        system, _ = _store(self.folder)
        for message in messages:
            if message is not None and message.rows:
                system.delete_file(message.path)


class VersionSource(DataSource):
    """Write only; :func:`current` reads."""

    @classmethod
    def name(cls) -> str:
        return "gridlark_versions"

    def writer(self, schema: T.StructType, overwrite: bool) -> VersionWriter:
        return VersionWriter(schema, dict(self.options))


def publish_version(df: DataFrame, folder: str, version: str, required: Sequence[str] = (), finite: Sequence[str] = ()) -> bool:
    """Publish all rows as one version and make it the current one; False if the version is there already, which is then left as it is."""
    system, place = _store(folder)
    if _get(system, f"{place}/versions/{version}.json") is not None:
        return False
    df.sparkSession.dataSource.register(VersionSource)
    df.write.format("gridlark_versions").mode("append").options(
        folder=folder, version=version, required=",".join(required), finite=",".join(finite)
    ).save()
    return True


def manifest(folder: str, version: str | None = None) -> dict | None:
    """The manifest of a version, of the current one by default; None if nothing is published."""
    system, place = _store(folder)
    pointer = {"version": version} if version else _get(system, f"{place}/{POINTER}")
    return pointer and _get(system, f"{place}/versions/{pointer['version']}.json")


def current(spark: SparkSession, folder: str, schema: T.StructType, version: str | None = None) -> DataFrame:
    """Rows of the current version, or of a named one."""
    found = manifest(folder, version)
    if not found or not found["parts"]:
        return spark.createDataFrame([], schema)
    system, _ = _store(folder)
    root = "" if isinstance(system, fs.LocalFileSystem) else folder.split("://", 1)[0] + "://"
    return spark.read.schema(schema).parquet(*(f"{root}{p}" if root else f"file:{p}" for p in found["parts"]))
