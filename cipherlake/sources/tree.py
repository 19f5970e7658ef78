"""Directory trees as a Spark data source: partitions by subtree, directories pruned and suffixes chosen by pushed filters,
on any file system that pyarrow opens; and the two orders of a listing."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, Not, StringContains

from cipherlake.shipping import ship_package
from cipherlake.sources.scratch import saved

#: Files that go out at once.
PORTION = 8192
_SCHEMA = "file_path string, rel_path string, in_directories string, file_name string, extension string, size long"


def open_root(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a directory: a URI, or a local path, resolved. NotADirectoryError if there is none."""
    system, path = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), os.path.realpath(root))
    path = path.rstrip("/") or "/"
    if system.get_file_info(path).type != pafs.FileType.Directory:
        raise NotADirectoryError(f"not a directory: {root}")
    return system, path


def read_bytes(path: str) -> bytes:
    """A file's content; of an unreadable file, nothing."""
    try:
        system, path = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        with system.open_input_stream(path) as f:
            return f.read()
    except OSError:
        return b""


def children(system: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    """What is in a directory, by name; nothing of an unreadable one. Links to directories are not followed."""
    try:
        found = system.get_file_info(pafs.FileSelector(folder))
    except OSError:
        return []
    local = isinstance(system, pafs.LocalFileSystem)
    return sorted((i for i in found if not (local and i.type == pafs.FileType.Directory and os.path.islink(i.path))), key=lambda i: i.base_name)


@dataclass
class Subtree(InputPartition):
    """A directory below the root, whole or only its files."""

    path: str
    deep: bool


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.subtrees = options["root"], int(options.get("subtrees", 64))
        self.prefix = self.root.split("://")[0] + "://" if "://" in self.root else ""
        #: Parts of `in_directories` that no file's may hold, and the suffixes asked for.
        self.without: list[str] = []
        self.extensions: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes `NOT contains(in_directories, x)` for a prefix of a directory's name, and equality or IN on extension."""
        for f in filters:
            match f:
                case Not(StringContains(("in_directories",), part)) if part.startswith("/"):
                    self.without.append(part)
                case EqualTo(("extension",), value):
                    self._only({value})
                case In(("extension",), values):
                    self._only(set(values))
                case _:
                    yield f

    def _only(self, values: set[str]) -> None:
        self.extensions = values if self.extensions is None else self.extensions & values

    def _wanted(self, inside: str) -> bool:
        return not any(part in inside for part in self.without)

    def partitions(self) -> Sequence[Subtree]:
        """Goes down through directories only, until there are `subtrees` of them or four levels are done."""
        system, root = open_root(self.root)
        passed, frontier = [], [(root, "/")]
        for _ in range(4):
            if not frontier or len(frontier) >= self.subtrees:
                break
            passed += frontier
            below = [(i.path, f"{inside}{i.base_name}/") for at, inside in frontier for i in children(system, at) if i.type == pafs.FileType.Directory]
            frontier = [(path, inside) for path, inside in below if self._wanted(inside)]
        return [Subtree(path, False) for path, _ in passed] + [Subtree(path, True) for path, _ in frontier]

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        system, root = open_root(self.root)
        rows: list[tuple] = []
        stack = [partition.path]
        while stack:
            folder = stack.pop()
            inside = "/" + folder[len(root) :].strip("/") + "/" if folder != root else "/"
            below = []
            for i in children(system, folder):
                if i.type == pafs.FileType.Directory:
                    if partition.deep and self._wanted(f"{inside}{i.base_name}/"):
                        below.append(i.path)
                    continue
                name = i.base_name
                dot = name.rfind(".")
                extension = name[dot:].lower() if dot >= 0 else ""
                if self.extensions is None or extension in self.extensions:
                    rows.append((self.prefix + i.path, inside[1:] + name, inside, name, extension, i.size))
            stack += below[::-1]
            if len(rows) >= PORTION:
                yield _batch(rows)
                rows = []
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if name == "size" else pa.string()) for k, name in enumerate(names)], names=names)


class SourceTree(DataSource):
    """`spark.read.format("source_tree").option("root", ...)`: a row for each file of a directory tree.

    file_path, rel_path, in_directories (`/a/b/`, so that `/a/` or `/.` tell directories), file_name, extension (lower
    case, with the dot), size. Conditions `NOT contains(in_directories, '/name/')` prune before descent.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def source_tree(spark: SparkSession, root: str, subtrees: int = 64) -> DataFrame:
    """The tree's files; registers the source and lets Spark push filters to it. Raises NotADirectoryError."""
    open_root(root)
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("root", root).option("subtrees", subtrees).load()


def without_directories(names: Iterable[str], hidden: bool = True) -> Column:
    """No directory below the root has one of the names or, if `hidden`, begins with a dot."""
    kept = F.lit(True)
    for part in [*(f"/{n}/" for n in names), *(["/."] if hidden else [])]:
        kept = kept & ~F.contains("in_directories", F.lit(part))
    return kept


# ── Orders ────────────────────────────────────────────────────────────────────────────────────────────────────────


def path_order() -> list[Column]:
    """By whole path, code point by code point: the order of one suffix's files."""
    return [F.col("file_path")]


def walk_order() -> list[Column]:
    """A directory's files by name, before those of its subdirectories, which come by name: several suffixes' files."""
    parts = F.split("file_path", "/")
    return [F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)]


def numbered(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """The rows with their place, from 1, in a global order; a distributed sort, and no window over all rows.

    Sorted rows are written with their place within their range; the ranges' counts are all that the driver sees.
    """
    ranged = saved(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, at = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before, starts = 0, []
    for r in sorted(ranged.groupBy(part).count().collect(), key=lambda r: r["_part"]):
        starts.append((r["_part"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _before long")
    placed = ranged.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(offsets), "_part")
    return placed.select(*df.columns, (at + F.col("_before") + 1).alias(name))
