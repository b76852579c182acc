"""Trees of very many files, listed and read by tasks: the driver never holds a list of them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Content that a task gives out at a time, one file at least, and names of files.
PIECE_BYTES, NAMES = 1 << 20, 10_000


class Tree(NamedTuple):
    """A folder: its path as Spark's readers write it, and its address for Arrow."""

    path: str
    uri: str


def qualified(spark: SparkSession, path: str) -> Tree:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place)
    return Tree(place.toString().rstrip("/"), re.sub("^file:/+", "file:///", place.toUri().toString()))


def opened(spark: SparkSession, path: str) -> Tree | None:
    """The folder at path; None for what only Spark's own reader takes: a store that Arrow doesn't open, a pattern, no folder."""
    if re.search(r"[][{}*?\\]", path):
        return None
    tree = qualified(spark, path)
    try:
        fs, base = pafs.FileSystem.from_uri(tree.uri)
        return tree if base.strip("/") and fs.get_file_info(base).type == pafs.FileType.Directory else None
    except (pa.ArrowException, OSError):
        return None


def hidden(name: str) -> bool:
    """Whether Spark's own readers pass over a file or folder of this name."""
    passed = name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)
    return passed and not name.startswith(("_metadata", "_common_metadata"))


def _entries(tree: Tree, kind: pafs.FileType, keep: Callable[[str], bool], deep: bool = False) -> Callable:
    """A step from folders to what they hold of a kind, or to that at any depth; keep judges the part of a name below the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(tree.uri)
        base = base.rstrip("/")
        for folder in (x for batch in batches for x in batch.column("name").to_pylist()):
            found = fs.get_file_info(pafs.FileSelector(base + folder, allow_not_found=True, recursive=deep))
            at = len(base) + len(folder) + 1
            names = [x.path[len(base) :] for x in found if x.type == kind and x.size != 0 and keep(x.path[at:])]
            for begin in range(0, len(names), NAMES):
                yield pa.RecordBatch.from_arrays([pa.array(names[begin : begin + NAMES], pa.string())], ["name"])

    return run


def names(spark: SparkSession, tree: Tree, folders: list[Callable[[str], bool]], file: Callable[[str], bool], deep: bool = False) -> DataFrame:
    """(name) of files that aren't empty, from the root on with a slash ahead: folders judges a level each, file the rest of the name.

    One task lists the folders of the root, then each folder is listed by one of ``4 * defaultParallelism`` tasks, to which the
    files found are dealt evenly, whatever folder they are in.
    """
    tasks = 4 * spark.sparkContext.defaultParallelism
    rows = spark.createDataFrame([("",)], "name string").coalesce(1)
    for keep in folders:
        rows = rows.mapInArrow(_entries(tree, pafs.FileType.Directory, keep), "name string").repartition(tasks)
    return rows.mapInArrow(_entries(tree, pafs.FileType.File, file, deep), "name string").repartition(tasks)


def paths(found: DataFrame, tree: Tree) -> DataFrame:
    """(path) as Spark's readers give it, of (name)."""
    return found.select(F.concat(F.lit(tree.path), "name").alias("path"))


#: What a task makes of batches of files besides reading them, and the schema of that.
Step = tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]


def contents(df: DataFrame, tree: Tree, column: str = "path", unreadable: bool = False, vanished: bool = False, then: Step | None = None) -> DataFrame:
    """Adds content to rows with the path of a file below a tree, in their order; with the flags, such files are skipped.

    A task holds one file or about PIECE_BYTES of smaller ones at a time. ``then`` takes them in the same Python worker, so that
    no content goes through Spark; the result is its.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(tree.uri)
        base = base.rstrip("/")

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.take(pa.array(at, pa.int64())).columns, pa.array(held, pa.binary())], [*batch.schema.names, "content"])

        for batch in batches:
            at, held, size = [], [], 0
            for n, path in enumerate(batch.column(column).to_pylist()):
                try:
                    with fs.open_input_file(base + path[len(tree.path) :]) as file:
                        content = file.read()
                except FileNotFoundError:
                    if not vanished:
                        raise
                    continue
                except OSError:
                    if not unreadable:
                        raise
                    continue
                if at and size + len(content) > PIECE_BYTES:
                    yield given()
                    at, held, size = [], [], 0
                at.append(n)
                held.append(content)
                size += len(content)
            if at:
                yield given()

    if then is None:
        fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
        return df.mapInArrow(read, f"{fields}, content binary")
    step, schema = then
    return df.mapInArrow(lambda batches: step(read(batches)), schema)


def move(df: DataFrame, tree: Tree, target: Tree, column: str = "path") -> int:
    """Files below a tree to target, a folder of the same store, under their full paths; those that are gone or can't be moved stay. Returns how many were moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(tree.uri)
        base, there = base.rstrip("/"), pafs.FileSystem.from_uri(target.uri)[1].rstrip("/")
        for batch in batches:
            n, made = 0, set()
            for path in batch.column(column).to_pylist():
                place = base + path[len(tree.path) :]
                new = f"{there}/{place.lstrip('/')}"
                try:
                    if (folder := new.rsplit("/", 1)[0]) not in made:
                        fs.create_dir(folder, recursive=True)
                        made.add(folder)
                    fs.move(place, new)
                    n += 1
                except OSError:
                    pass
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return df.select(column).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
