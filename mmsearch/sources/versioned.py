"""Versioned tables: snapshots that readers pin (S5) and keyed copy-on-write merges.

    <root>/versions/00000003.json   one pointer a version, made last and only once: the commit
    <root>/data/<id>/bucket=<b>/    rows of some buckets, written by Spark, never changed

A pointer names the folder of every bucket. A version that isn't committed doesn't exist for readers; a writer
that dies leaves folders nobody points to. A reader resolves a version to folders once, so a rebuild may read
the table that it replaces. Two writers of one version: the second to commit fails and may try again. Pointers go
through Hadoop's file system API, so any store that Spark writes to will do.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "bucket"


class Conflict(RuntimeError):
    """Another writer committed the version meanwhile."""


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, at = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _create(spark: SparkSession, path: str, text: str) -> None:
    """A whole small file that must not exist yet: written beside, then renamed, which no file system does twice."""
    fs, at = _fs(spark, path)
    _, beside = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, False)
    out.write(text.encode())
    out.close()
    if fs.exists(at) or not fs.rename(beside, at):
        fs.delete(beside, False)
        raise Conflict(f"{path} exists")


def _read(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


@dataclass(frozen=True)
class Version:
    """One pointer: the schema, the layout and the folder of each bucket, relative to the root; ``batch`` is the last batch merged."""

    number: int
    schema: str
    key: str | None = None
    buckets: int = 1
    batch: int | None = None
    folders: dict[str, str] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)


def _ddl(df: DataFrame) -> str:
    """The columns as text; every value may be null."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _pointer(root: str, number: int) -> str:
    return f"{root}/versions/{number:08d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, ascending."""
    return [int(n[:-5]) for n in _names(spark, f"{root}/versions") if n.endswith(".json")]


def current(spark: SparkSession, root: str, number: int | None = None) -> Version | None:
    """The newest version (or a given one), None for a table that was never committed."""
    if number is None:
        known = versions(spark, root)
        if not known:
            return None
        number = known[-1]
    return Version(**json.loads(_read(spark, _pointer(root, number))))


def _commit(spark: SparkSession, root: str, version: Version) -> Version:
    _create(spark, _pointer(root, version.number), json.dumps(version.__dict__))
    return version


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _load(spark: SparkSession, root: str, version: Version, only: set[int] | None = None) -> DataFrame:
    """Rows of the version, or of some of its buckets; without the bucket column."""
    schema = StructType.fromDDL(version.schema)
    paths = sorted({f"{root}/{p}" for b, p in version.folders.items() if only is None or int(b) in only})
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def read(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """A table pinned to its newest version, or to a given one: later commits don't change what this reads."""
    version = current(spark, root, number)
    if version is None:
        raise FileNotFoundError(f"no committed version under {root}")
    return _load(spark, root, version)


#: Bytes of stored rows that one task writes, about.
TASK_BYTES = 32 << 20


def _bytes(spark: SparkSession, root: str, folders) -> int:
    """Stored bytes of some folders, whole."""
    total = 0
    for folder in folders:
        fs, at = _fs(spark, f"{root}/{folder}")
        total += fs.getContentSummary(at).getLength()
    return total


def _write(df: DataFrame, root: str, key: str, buckets: int, parts: int) -> tuple[str, list[int]]:
    """Rows with a bucket column into a fresh folder; ``parts`` tasks for each bucket. Returns the folder and the buckets it holds."""
    spark, folder = df.sparkSession, f"data/{uuid.uuid4().hex}"
    place = F.col(BUCKET) * parts + F.pmod(F.hash(key), F.lit(parts))
    df.repartitionById(max(1, buckets * parts), place.cast("int")).write.partitionBy(BUCKET).parquet(f"{root}/{folder}")
    return folder, [int(n.split("=")[1]) for n in _names(spark, f"{root}/{folder}") if n.startswith(f"{BUCKET}=")]


def overwrite(df: DataFrame, root: str, key: str | None = None, buckets: int = 1, batch: int | None = None) -> Version:
    """The table anew as its next version. ``df`` may read the table's present version. With ``key``, rows are dealt to buckets by its hash.

    Without a key the rows keep their partitions in one folder. A column may not be called ``bucket``.
    """
    spark = df.sparkSession
    if BUCKET in df.columns:
        raise ValueError("a column may not be called bucket")
    before = current(spark, root)
    if key is None:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{root}/{folder}")
        folders = {"0": folder}
    else:
        folder, held = _write(df.withColumn(BUCKET, _bucket(key, buckets)), root, key, buckets, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets))
        folders = {str(b): f"{folder}/{BUCKET}={b}" for b in held}
    return _commit(spark, root, Version(1 + (before.number if before else 0), _ddl(df), key, buckets, batch, folders))


def _last(df: DataFrame, key: str, order: str) -> DataFrame:
    """(row, n): the last row of each key by ``order`` and how many there are, combined before the shuffle."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(order)).alias("row"), F.count("*").alias("n")).select("row", "n")


def upsert(df: DataFrame, root: str, key: str, order: str, buckets: int = 64, batch: int | None = None) -> Version:
    """Merge rows by key (S8, R4): a new key is inserted, a known one replaced, the last by ``order`` wins within df and df wins over the table.

    Only the buckets of df's keys are read and rewritten; the pointer takes the others' folders over. ``buckets`` counts for
    the first version and stays. A batch whose number isn't above the last one merged changes nothing, so a repeated
    micro-batch is harmless. Rows with a null key are left out. counts of the version: inserted, replaced, rejected rows.
    An empty df commits nothing once there is a version.
    """
    spark = df.sparkSession
    before = current(spark, root)
    if before is not None:
        if before.key != key:
            raise ValueError(f"the table is keyed by {before.key}")
        if batch is not None and before.batch is not None and batch <= before.batch:
            return before
        buckets = before.buckets
    else:
        before = _commit(spark, root, Version(1, _ddl(df), key, buckets))
    staged = f"{root}/data/{uuid.uuid4().hex}"
    _last(df, key, order).withColumn(BUCKET, _bucket(F.col(f"row.{key}"), buckets)).write.parquet(staged)  # df is computed here and nowhere else
    both = spark.read.parquet(staged)
    known = F.col(f"row.{key}").isNotNull()
    rows = both.filter(known).select("row.*", BUCKET)
    rejected = both.filter(~known).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    touched = {r[0] for r in rows.select(BUCKET).distinct().collect()}  # at most ``buckets`` small numbers
    if not touched:
        return before
    schema = StructType.fromDDL(before.schema)
    new = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema), BUCKET)
    old = _load(spark, root, before, touched).withColumn(BUCKET, _bucket(key, buckets))
    kept = old.join(new.select(F.col(key)), key, "left_anti").select(*new.columns)
    stored = _bytes(spark, root, [staged.removeprefix(f"{root}/"), *(p for b, p in before.folders.items() if int(b) in touched)])
    folder, held = _write(kept.unionByName(new), root, key, buckets, max(1, -(-stored // (len(touched) * TASK_BYTES))))
    folders = {b: p for b, p in before.folders.items() if int(b) not in touched} | {str(b): f"{folder}/{BUCKET}={b}" for b in held}
    replaced = old.join(new.select(F.col(key)), key, "left_semi").count()
    counts = {"inserted": rows.count() - replaced, "replaced": replaced, "rejected": rejected}
    version = _commit(spark, root, Version(before.number + 1, before.schema, key, buckets, batch if batch is not None else before.batch, folders, counts))
    _remove(spark, staged)
    return version


def _remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete pointers older than the newest ``keep`` and folders that no kept one names; nobody may be writing. Returns the folders deleted."""
    known = versions(spark, root)
    for n in known[:-keep]:
        _remove(spark, _pointer(root, n))
    named = {p for n in known[-keep:] for p in current(spark, root, n).folders.values()}
    gone = []
    for folder in _names(spark, f"{root}/data"):
        own = f"data/{folder}"
        if own in named:
            continue
        parts = [f"{own}/{x}" for x in _names(spark, f"{root}/{own}") if x.startswith(f"{BUCKET}=")]
        for path in [own] if not named.intersection(parts) else [x for x in parts if x not in named]:
            _remove(spark, f"{root}/{path}")
            gone.append(path)
    return gone
