"""A data source for trees of source files, hidden paths included.

    spark.dataSource.register(SourceTree)
    spark.read.format("source_tree").option("exclude", '["deps/"]').load(folder)

The driver lists the upper levels of the tree only, until there are enough folders for the wanted number of partitions; each
partition lists and reads its own. Filters on language (one of some) and relative_path (start or part) are applied before a file is opened, where the session has
spark.sql.python.filterPushdown.enabled. Folders may
lie in any file system that pyarrow opens.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringStartsWith

from skerry.operators.extract import EXTENSIONS

from .files import EXCLUDED

SCHEMA = "path string, relative_path string, language string, size long, mtime timestamp, content string"
#: Files are sent on in batches of about so many bytes; of rows at most so many.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 1024


def _left_out(path: str, patterns: list[str]) -> bool:
    """A pattern is part of the path, the file's name, or (with *) a glob that the name holds."""
    name = path.rsplit("/", 1)[-1]
    return any(p in path or p == name or ("*" in p and re.search(".*".join(map(re.escape, p.split("*"))), name)) for p in patterns)


@dataclass
class Folder(InputPartition):
    """Folders to read whole, and single files of the levels above."""

    folders: list[str]
    files: list[str]


class SourceTree(DataSource):
    """Options: path, or paths (a JSON list; repeats are read again); extensions, exclude (JSON lists); hidden (true, the default, or
    false: parts that start with a dot are left out); partitions (a number, 64 by default)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SourceReader:
        return SourceReader(self.options)


class SourceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.extensions = json.loads(options.get("extensions", json.dumps(list(EXTENSIONS))))
        self.exclude = json.loads(options.get("exclude", json.dumps(list(EXCLUDED))))
        self.hidden = options.get("hidden", "true").lower() == "true"
        self.wanted = int(options.get("partitions", "64"))
        self.languages: set[str] | None = None
        self.parts: list[tuple[str, bool]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ())
            if isinstance(f, (EqualTo, In)) and column == ("language",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.languages = own if self.languages is None else self.languages & own
            elif isinstance(f, (StringStartsWith, StringContains)) and column == ("relative_path",):
                self.parts.append((f.value, isinstance(f, StringStartsWith)))
            else:
                yield f

    def _listed(self, root: str, folder: str, deep: bool) -> tuple[list, list]:
        """(folders, files) in a folder, or with deep all files under it; what is left out is not gone into."""
        system, _ = fs.FileSystem.from_uri(_uri(root))
        folders, files, waiting = [], [], [folder]
        while waiting:
            for entry in system.get_file_info(fs.FileSelector(waiting.pop(), recursive=False)):
                if not self.hidden and entry.base_name.startswith("."):
                    continue
                if entry.type == fs.FileType.Directory:
                    (waiting if deep else folders).append(entry.path)
                elif entry.type == fs.FileType.File:
                    files.append(entry)
        return folders, files

    def partitions(self) -> list[InputPartition]:
        out = []
        for root in self.roots:
            _, top = fs.FileSystem.from_uri(_uri(root))
            folders, loose, goal = [top], [], max(1, self.wanted // len(self.roots))
            while folders and len(folders) < goal:  # a level of the tree at a time
                inner = [self._listed(root, f, False) for f in folders]
                loose += [e.path for _, files in inner for e in files if self._language(self._relative(top, e.path))]
                folders = [f for some, _ in inner for f in some]
            for i in range(goal):
                if folders[i::goal] or loose[i::goal]:
                    out.append(Folder([root, *folders[i::goal]], loose[i::goal]))
        return out or [Folder([self.roots[0]], [])]

    def _relative(self, top: str, path: str) -> str:
        return path[len(top.rstrip("/")) + 1 :]

    def _language(self, relative: str) -> str | None:
        """The file's language, or None if it is not to be read."""
        ending = os.path.splitext(relative)[1].lower()
        language = EXTENSIONS.get(ending, "unknown")
        if ending not in self.extensions or _left_out(relative, self.exclude) or (self.languages is not None and language not in self.languages):
            return None
        if any(not (relative.startswith(v) if start else v in relative) for v, start in self.parts):
            return None
        return language

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        root, *folders = partition.folders
        system, top = fs.FileSystem.from_uri(_uri(root))
        rows, held = [], 0
        single = system.get_file_info(partition.files) if partition.files else []
        for entry in (e for some in (single, *(self._listed(root, f, True)[1] for f in folders)) for e in some):
            relative = self._relative(top, entry.path)
            language = self._language(relative)
            if language is None:
                continue
            with system.open_input_stream(entry.path) as file:
                content = file.read().decode("utf-8", "replace")
            rows.append((entry.path, relative, language, entry.size, entry.mtime, content))
            held += entry.size
            if held > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + (path.removeprefix("file:") if path.startswith("file:") else os.path.abspath(path))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def scan_tree(spark: SparkSession, *folders: str, **options: str) -> DataFrame:
    """The source files under the folders, which follow each other, repeats kept. Turns filter pushdown on for the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").options(paths=json.dumps(list(folders)), **options).load()


def write_files(files: DataFrame, folder: str) -> int:
    """Each row of files (path, content) as a file under folder; returns how many. A row that is written again replaces its file."""

    def write(parts):
        system, top = fs.FileSystem.from_uri(_uri(folder))
        made: set[str] = set()
        for part in parts:
            for path, content in zip(part["path"].to_pylist(), part["content"].to_pylist(), strict=True):
                place = f"{top}/{path}"
                above = place.rsplit("/", 1)[0]
                if above not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                with system.open_output_stream(place) as file:
                    file.write((content or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64())], names=["n"])

    return files.select("path", "content").mapInArrow(write, "n long").agg({"n": "sum"}).first()[0] or 0
