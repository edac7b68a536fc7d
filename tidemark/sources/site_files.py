"""Pages as files: tasks write them, a manifest that is moved into place at the end makes them the site."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: A page's place: relative, of ordinary names.
_PATH = re.compile(r"(?!.*(?:^|/)\.{1,2}(?:/|$))[^/\\\0]+(?:/[^/\\\0]+)*")
_MANIFEST = "manifest.json"
_PART = "path string, bytes long, sha256 string"


@dataclass
class WrittenPart(WriterCommitMessage):
    """What a task has written: the name of its list, not the list."""

    part: str
    files: int
    size: int


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _put(files: pafs.FileSystem, path: str, content: bytes) -> None:
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(path) as out:
        out.write(content)


def _read_manifest(files: pafs.FileSystem, root: str) -> dict | None:
    path = f"{root}/{_MANIFEST}"
    if files.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    with files.open_input_stream(path) as text:
        return json.loads(text.read())


@dataclass
class SiteWriter(DataSourceWriter):
    """Writes (path, content) rows below a folder of this run and lists them beside it.

    A task lists its own files in one file and tells the driver its name. When all tasks are done, the names
    become the manifest, which is moved into place whole: until then the site is the one before, and
    afterwards the older run goes. A run that fails removes all that it wrote.
    """

    folder: str
    run: str = field(default_factory=lambda: f"run-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[Row]) -> WrittenPart:
        files, root = _open(self.folder)
        task, seen, lines, size = TaskContext.get(), set(), [], 0
        for row in iterator:
            if row["path"] is None or not _PATH.fullmatch(row["path"]) or row["path"] in seen:
                raise ValueError(f"not a path of its own: {row['path']!r}")
            seen.add(row["path"])
            content = (row["content"] or "").encode()
            _put(files, f"{root}/{self.run}/files/{row['path']}", content)
            lines.append(json.dumps({"path": row["path"], "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()}))
            size += len(content)
        # Another attempt of the task writes the same files and a list of its own.
        part = f"part-{task.partitionId()}-{task.taskAttemptId()}.json"
        _put(files, f"{root}/{self.run}/lists/{part}", "".join(f"{x}\n" for x in lines).encode())
        return WrittenPart(part, len(lines), size)

    def commit(self, messages: list[WrittenPart | None]) -> None:
        files, root = _open(self.folder)
        before, told = _read_manifest(files, root), [m for m in messages if m is not None]
        manifest = {"run": self.run, "parts": sorted(m.part for m in told), "files": sum(m.files for m in told), "bytes": sum(m.size for m in told)}
        new = f"{root}/.{self.run}.json"
        _put(files, new, json.dumps(manifest).encode())
        files.move(new, f"{root}/{_MANIFEST}")
        if before is not None:
            files.delete_dir(f"{root}/{before['run']}")

    def abort(self, messages: list[WrittenPart | None]) -> None:
        files, root = _open(self.folder)
        if files.get_file_info(f"{root}/{self.run}").type != pafs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.run}")


class SiteFiles(DataSource):
    """The data source ``tidemark_site``; its option ``folder`` is the site's."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_site"

    def writer(self, schema, overwrite: bool) -> SiteWriter:
        return SiteWriter(self.options["folder"])


def write_site(pages: DataFrame, folder: str) -> dict:
    """Write ``pages(path, content)`` as the site at ``folder``, in place of the one before: all of it or,
    where anything fails, nothing. Returns the manifest.

    Paths are relative and occur once; a null, foreign or repeated one fails the run, and a null content is an empty
    file. Pages are dealt by path, so that repeats meet. Files stand below the manifest's run (see :func:`site_root`).
    """
    spark = pages.sparkSession
    spark.dataSource.register(SiteFiles)
    pages.select("path", "content").repartition("path").write.format("tidemark_site").option("folder", folder).mode("append").save()
    return _read_manifest(*_open(folder))


def site_root(folder: str) -> str | None:
    """The folder whose files are the site now, or null where none was written."""
    manifest = _read_manifest(*_open(folder))
    return manifest and f"{folder}/{manifest['run']}/files"


def site_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of the site's files, by its manifest."""
    manifest = _read_manifest(*_open(folder))
    if manifest is None or not manifest["parts"]:
        return spark.createDataFrame([], _PART)
    lists = [f"{folder}/{manifest['run']}/lists/{p}" for p in manifest["parts"]]
    return spark.read.schema(_PART).json(lists).where(F.col("path").isNotNull())


def write_records(records: DataFrame, folder: str) -> str | None:
    """Records ``(slug, record)`` as a JSON file each, published together; returns the folder that holds them.

    ``read_records`` reads them back.
    """
    write_site(records.select(F.concat("slug", F.lit(".json")).alias("path"), F.to_json("record").alias("content")), folder)
    return site_root(folder)


def write_maps(rows: DataFrame, key: str, folder: str, entries: int = 20_000) -> dict:
    """Rows as JSON objects by ``key``, some ``entries`` to a file, published together; ``read_map`` reads them back."""
    files = rows.count() // entries + 1
    entry = F.struct(F.col(key).alias("k"), F.struct(*(c for c in rows.columns if c != key)).alias("v"))
    parts = rows.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(files)))
    maps = parts.groupBy("_part").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("content"))
    return write_site(maps.select(F.concat(F.lit("part-"), F.col("_part").cast("string"), F.lit(".json")).alias("path"), "content"), folder)
