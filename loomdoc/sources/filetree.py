"""A tree of files as a data source: hidden and empty files too, which Spark's own file sources leave out."""

from __future__ import annotations

import hashlib
import json
import os
from collections import deque
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, DataSourceStreamReader

# Fixed values.
NEVER_ENTERED = {".git", "node_modules", "__pycache__", ".venv", "venv"}
PROJECT_MARKERS = {".git", "package.json", "pyproject.toml", "requirements.txt", "Cargo.toml", "go.mod", "tsconfig.json", "pom.xml", "build.gradle", "Gemfile", "composer.json"}
CHUNK = 1 << 20
PARTS = 64
SCHEMA = "path string, name string, ext string, size bigint, mtime timestamp, hash string, error string, skipped boolean"


def digest(path: str) -> str:
    found = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(CHUNK):
            found.update(part)
    return found.hexdigest()


def _listed(folder: str, top: bool, prune: bool) -> tuple[list[str], list[str], bool]:
    """Files and folders of one folder, and whether it is a project that is left out."""
    names = sorted(os.listdir(folder))
    if prune and not top and PROJECT_MARKERS.intersection(names):
        return [], [], True
    inner = [n for n in names if os.path.isdir(os.path.join(folder, n)) and not os.path.islink(os.path.join(folder, n))]
    return [n for n in names if n not in inner], [n for n in inner if n not in NEVER_ENTERED], False


def _row(path: str, with_hash: bool) -> tuple:
    name = os.path.basename(path)
    ext = os.path.splitext(name)[1].lower()
    try:
        about = os.stat(path)
        return path, name, ext, about.st_size, datetime.fromtimestamp(about.st_mtime, UTC), digest(path) if with_hash else None, None, False
    except OSError as e:
        return path, name, ext, None, None, None, str(e), False


def walk(root: str, prune: bool, with_hash: bool, top: bool = True) -> Iterator[tuple]:
    """Rows of files below root; a folder that is left out gives a row with skipped."""
    files, folders, skipped = _listed(root, top, prune)
    if skipped:
        yield root, os.path.basename(root), "", None, None, None, None, True
        return
    for name in files:
        yield _row(os.path.join(root, name), with_hash)
    for name in folders:
        yield from walk(os.path.join(root, name), prune, with_hash, False)


def paths_of(root: str, prune: bool, top: bool = True) -> Iterator[str]:
    """The files of walk, by path alone; projects are left out without a row."""
    try:
        files, folders, skipped = _listed(root, top, prune)
    except OSError:  # gone, or not to be read, since its parent was listed
        return
    if not skipped:
        yield from (os.path.join(root, x) for x in files)
        for name in folders:
            yield from paths_of(os.path.join(root, name), prune, False)


class _Part(InputPartition):
    """A folder: own, only the files that lie in it itself; else all below it."""

    def __init__(self, folder: str, own: bool, top: bool) -> None:
        self.folder, self.own, self.top = folder, own, top


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.prune = options.get("skipprojects", "true").lower() == "true"
        self.hash = options.get("hash", "true").lower() == "true"

    def partitions(self) -> list[_Part]:
        """Folders from the root on, level by level, until there are PARTS of them, so that one large subfolder is several tasks."""
        own, below = [], deque([(self.root, True)])
        while below and len(own) + len(below) < PARTS:
            folder, top = below.popleft()
            own.append(_Part(folder, True, top))
            try:
                _, folders, _ = _listed(folder, top, self.prune)
            except OSError:  # the task reports it
                continue
            below.extend((os.path.join(folder, x), False) for x in folders)
        return [*own, *[_Part(folder, False, top) for folder, top in below]]

    def read(self, partition: _Part) -> Iterator[tuple]:
        try:
            if not partition.own:
                yield from walk(partition.folder, self.prune, self.hash, partition.top)
                return
            files, _, skipped = _listed(partition.folder, partition.top, self.prune)
        except OSError as e:
            yield partition.folder, os.path.basename(partition.folder), "", None, None, None, str(e), False
            return
        if skipped:
            yield partition.folder, os.path.basename(partition.folder), "", None, None, None, None, True
        for name in files:
            yield _row(os.path.join(partition.folder, name), self.hash)


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _StreamReader(DataSourceStreamReader):
    """Files that are new, or whose size or mtime changed, whatever their mtime is. The driver lists with stat alone; files are hashed in
    the tasks. What a trigger found is kept in the folder seen as one file, which the offset counts, so that a batch can run again.

    The driver holds 16 bytes for each file of the tree.
    """

    def __init__(self, options: dict[str, str]) -> None:
        if "seen" not in options:
            raise ValueError("the option seen is missing: a folder, outside of path, that lists what was found")
        self.inner, self.seen, self.files = _Reader(options), options["seen"], int(options.get("filespertask", "256"))
        self.known: set[bytes] = set()
        self.loaded = 0
        os.makedirs(self.seen, exist_ok=True)

    def _list(self, number: int) -> str:
        return os.path.join(self.seen, f"{number:09d}.json")

    def _found(self, number: int) -> list[list]:
        with open(self._list(number)) as f:
            return json.load(f)

    @staticmethod
    def _mark(path: str, size: int | None, mtime: int | None) -> bytes:
        return hashlib.blake2b(f"{size} {mtime} {path}".encode("utf-8", "surrogateescape"), digest_size=16).digest()

    def _stats(self) -> Iterator[tuple[str, int | None, int | None]]:
        for path in paths_of(self.inner.root, self.inner.prune):
            try:
                about = os.stat(path)
                yield path, about.st_size, about.st_mtime_ns
            except OSError:  # the task reports it
                yield path, None, None

    def initialOffset(self) -> dict:
        return {"lists": 0}

    def latestOffset(self) -> dict:
        while os.path.exists(self._list(self.loaded)):  # of this run or of one before
            self.known.update(self._mark(*x) for x in self._found(self.loaded))
            self.loaded += 1
        fresh = [x for x in self._stats() if self._mark(*x) not in self.known]
        if fresh:
            with open(self._list(self.loaded) + ".part", "w") as f:
                json.dump(fresh, f)
            os.replace(self._list(self.loaded) + ".part", self._list(self.loaded))
            self.known.update(self._mark(*x) for x in fresh)
            self.loaded += 1
        return {"lists": self.loaded}

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        paths = list(dict.fromkeys(x[0] for n in range(start["lists"], end["lists"]) for x in self._found(n)))
        return [_Files(paths[i : i + self.files]) for i in range(0, len(paths), self.files)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        return (_row(x, self.inner.hash) for x in partition.paths)

    def commit(self, end: dict) -> None:
        pass


class FileTree(DataSource):
    """format("file_tree"): options path, skipProjects (true), hash (true); of streams also seen (a folder) and filesPerTask (256)."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options)


def file_tree(spark: SparkSession, path: str, skip_projects: bool = True, with_hash: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, unreadable files with their error, project folders that were left out)."""
    spark.dataSource.register(FileTree)
    rows = spark.read.format("file_tree").option("path", path).option("skipProjects", str(skip_projects).lower()).option("hash", str(with_hash).lower()).load()
    return rows.where("not skipped and error is null").drop("error", "skipped"), rows.where("error is not null").select("path", "error"), rows.where("skipped").select("path")
