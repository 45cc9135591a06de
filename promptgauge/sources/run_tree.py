"""The tree of stored results as a Spark source and sink, ``format("runtree")``.

``<root>/<org>__<name>/<revision>/<file>`` holds a baseline, ``.../experiments/<experiment>/<file>`` the results of a custom
prompt. Equality and ``IN`` filters on model, revision and experiment choose folders before anything in
them is listed. Files are given to tasks in parts of a bounded number of bytes, whole folders together where they fit. The
root may be any address that the pyarrow file systems open (local, S3, HDFS and others).

Options: ``path`` the root, ``names`` a pattern of file names (``*.json``), ``part_bytes`` the bytes of a task.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row

SCHEMA = "model string, revision string, experiment_id string, is_baseline boolean, name string, body string"
EXPERIMENTS = "experiments"
PART_BYTES = 32 << 20
OPEN_BYTES = 64 << 10  # what opening a file counts for
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_CHOSEN = ("model", "revision", "experiment_id")


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path in it."""
    if not root:
        raise ValueError("the source needs a path")
    if root.startswith("file:/") and not root.startswith("file://"):
        root = root.removeprefix("file:")  # as Spark writes local addresses
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def folder_of(model: str) -> str:
    return model.replace("/", "__")


@dataclass
class Part(InputPartition):
    """Files of one task: ``(path, model, revision, experiment or None)``."""

    files: list[tuple[str, str, str, str | None]]

    def __init__(self, files):
        super().__init__(None)
        self.files = files


class RunTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.names = options.get("path", ""), options.get("names", "*.json")
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what chooses folders, and leaves the rest to Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or len(f.attribute) != 1 or f.attribute[0] not in _CHOSEN:
                yield f
            else:
                name = f.attribute[0]
                self.wanted[name] = self.wanted.get(name, values) & values

    def _chosen(self, name: str, value: str | None) -> bool:
        return name not in self.wanted or value in self.wanted[name]

    def _files(self) -> Iterator[tuple[int, tuple[str, str, str, str | None]]]:
        """Sizes and files, folder by folder."""
        system, root = opened(self.root)

        def inside(path: str, kind: fs.FileType) -> list[fs.FileInfo]:
            found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
            return sorted((i for i in found if i.type == kind), key=lambda i: i.base_name)

        def matching(path: str) -> list[fs.FileInfo]:
            return [i for i in inside(path, fs.FileType.File) if fnmatch.fnmatchcase(i.base_name, self.names)]

        for model in inside(root, fs.FileType.Directory):
            named = model.base_name.replace("__", "/")
            if not self._chosen("model", named):
                continue
            for revision in inside(model.path, fs.FileType.Directory):
                if not self._chosen("revision", revision.base_name):
                    continue
                if self._chosen("experiment_id", None):
                    for file in matching(revision.path):
                        yield file.size, (file.path, named, revision.base_name, None)
                for experiment in inside(f"{revision.path}/{EXPERIMENTS}", fs.FileType.Directory):
                    if self._chosen("experiment_id", experiment.base_name):
                        for file in matching(experiment.path):
                            yield file.size, (file.path, named, revision.base_name, experiment.base_name)

    def partitions(self) -> list[Part]:
        parts, held = [[]], 0
        for size, file in self._files():
            size += OPEN_BYTES
            if parts[-1] and held + size > self.part_bytes:
                parts.append([])
                held = 0
            parts[-1].append(file)
            held += size
        return [Part(files) for files in parts]

    def read(self, part: Part) -> Iterator[tuple]:
        system, _ = opened(self.root)
        for path, model, revision, experiment in part.files:
            with system.open_input_stream(path) as f:
                yield model, revision, experiment, experiment is None, path.rsplit("/", 1)[1], f.read().decode("utf-8")


class RunTreeWriter(DataSourceWriter):
    """Writes each row as its file. A row written again, by a retry or another job, takes the place of the file."""

    def __init__(self, options: dict):
        self.root = options.get("path", "")
        opened(self.root)

    @staticmethod
    def place(row: Row) -> str:
        parts = [folder_of(row["model"]), row["revision"], *([] if row["is_baseline"] else [EXPERIMENTS, row["experiment_id"]]), row["name"]]
        if any(not p or "/" in p or p in (".", "..") for p in parts):
            raise ValueError(f"not a place in a run tree: {parts}")
        return "/".join(parts)

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, root = opened(self.root)
        made: set[str] = set()
        for row in rows:
            path = f"{root.rstrip('/')}/{self.place(row)}"
            folder, name = path.rsplit("/", 1)
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            with system.open_output_stream(f"{folder}/.{name}.part") as f:
                f.write((row["body"] or "").encode("utf-8"))
            system.move(f"{folder}/.{name}.part", path)
        return WriterCommitMessage()


class RunTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "runtree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RunTreeReader:
        return RunTreeReader(self.options)

    def writer(self, schema, overwrite: bool) -> RunTreeWriter:
        if overwrite:
            raise ValueError("a run tree is only added to")
        return RunTreeWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RunTree)
    spark.conf.set(PUSHDOWN, "true")


def read_tree(spark: SparkSession, root: str, names: str = "*.json", part_bytes: int = PART_BYTES) -> DataFrame:
    """``model, revision, experiment_id, is_baseline, name, body`` of every file; a baseline has no experiment."""
    register(spark)
    return spark.read.format("runtree").option("path", root).option("names", names).option("part_bytes", part_bytes).load()


def write_tree(results: DataFrame, root: str) -> None:
    """Write ``model, revision, experiment_id, is_baseline, name, body`` rows, one file each."""
    register(results.sparkSession)
    results.select("model", "revision", "experiment_id", "is_baseline", "name", "body").write.format("runtree").option("path", root).mode("append").save()
