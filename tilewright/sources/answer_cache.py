"""Captured answers and cached tiles as a data source of Spark: written in parts by url, read with pushed conditions.

    register(spark)
    df.write.format("answer_cache").option("path", folder).mode("append").save()
    spark.read.format("answer_cache").option("path", folder).load().where("url = '...'")

Entries are (url, data, mime, added_at). A url's entries lie in one of `parts` parts; of entries of one url the last added
is the one that is read. A write counts when its manifest is written, which names all files that do: what failed tasks left
is never read, and readers go on with the manifest that they began with. One writer at a time. Nothing is fetched.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

SCHEMA = "url string, data binary, mime string, added_at timestamp"
#: Parts of a new cache; one that exists keeps its own number.
PARTS = 64
#: The setting that hands conditions to a source written in Python.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def part_of(url: str | None, parts: int) -> int:
    return zlib.crc32((url or "").encode()) % parts


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def manifest_of(path: str) -> dict:
    """The last manifest: version, parts and files by part; version 0 without files where there is none."""
    store, base = _store(path)
    found = store.get_file_info(fs.FileSelector(f"{base}/manifests", allow_not_found=True))
    last = max((f.path for f in found if f.path.endswith(".json")), default=None)
    if last is None:
        return {"version": 0, "parts": None, "files": {}}
    with store.open_input_stream(last) as stream:
        return json.loads(stream.read())


@dataclass
class CachePart(InputPartition):
    files: list[str]
    urls: list[str] | None


class CacheReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.urls = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality and lists of urls, which choose parts and rows; Spark looks after the others."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("url",):
                own = {f.value} if isinstance(f, EqualTo) else {*f.value}
                self.urls = own if self.urls is None else self.urls & own
            else:
                yield f

    def partitions(self) -> list[CachePart]:
        manifest = manifest_of(self.path)
        urls = None if self.urls is None else sorted(u for u in self.urls if u is not None)
        wanted = None if urls is None else {str(part_of(u, manifest["parts"] or 1)) for u in urls}
        return [CachePart(files, urls) for part, files in sorted(manifest["files"].items(), key=lambda x: int(x[0])) if wanted is None or part in wanted] or [CachePart([], urls)]

    def read(self, partition: CachePart) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        tables = []
        for file in partition.files:
            with store.open_input_file(file) as stream:
                table = pa.ipc.open_file(stream).read_all()
            tables.append(table if partition.urls is None else table.filter(pc.is_in(table["url"], pa.array(partition.urls, pa.string()))))
        if not tables:
            return
        table = pa.concat_tables(tables)
        order = pc.sort_indices(table, [("url", "ascending"), ("added_at", "descending")])
        table = table.take(order)
        urls = table["url"].to_pylist()
        yield from table.take(pa.array([k for k, u in enumerate(urls) if k == 0 or u != urls[k - 1]], pa.int64())).combine_chunks().to_batches()


@dataclass
class Written(WriterCommitMessage):
    files: dict[str, str]


class CacheWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, parts: int) -> None:
        self.path, self.overwrite = path, overwrite
        self.before = manifest_of(path)
        self.parts = parts if overwrite or not self.before["parts"] else self.before["parts"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = _store(self.path)
        store.create_dir(f"{base}/files", recursive=True)
        open_, files = {}, {}
        try:
            for batch in iterator:
                own = [part_of(u, self.parts) for u in batch["url"].to_pylist()]
                for part in sorted({*own}):
                    if part not in open_:
                        files[str(part)] = f"{base}/files/{part}-{uuid.uuid4().hex}.arrow"
                        sink = store.open_output_stream(files[str(part)])
                        open_[part] = sink, pa.ipc.new_file(sink, batch.schema)
                    open_[part][1].write_batch(batch.filter(pa.array([p == part for p in own])))
        finally:
            for sink, out in open_.values():
                out.close()
                sink.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _store(self.path)
        files = {} if self.overwrite else {k: [*v] for k, v in self.before["files"].items()}
        for message in messages:
            for part, file in (message.files if message else {}).items():
                files.setdefault(part, []).append(file)
        version = self.before["version"] + 1
        store.create_dir(f"{base}/manifests", recursive=True)
        aside = f"{base}/.manifest-{uuid.uuid4().hex}"
        with store.open_output_stream(aside) as stream:
            stream.write(json.dumps({"version": version, "parts": self.parts, "files": files}).encode())
        store.move(aside, f"{base}/manifests/{version:09d}.json")

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        for message in messages:
            for file in (message.files if message else {}).values():
                store.delete_file(file)


class AnswerCache(DataSource):
    """Options: path, and parts for a new cache."""

    @classmethod
    def name(cls) -> str:
        return "answer_cache"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("an answer_cache needs a path")
        return self.options["path"].rstrip("/")

    def reader(self, schema: object) -> CacheReader:
        return CacheReader(self._path())

    def writer(self, schema: object, overwrite: bool) -> CacheWriter:
        return CacheWriter(self._path(), overwrite, int(self.options.get("parts", PARTS)))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it be handed conditions."""
    spark.dataSource.register(AnswerCache)
    spark.conf.set(PUSHDOWN, True)
