"""Versioned Parquet tables with a pointer to the current version, and snapshots of a project with a verified manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratagraph.operators.ingest import digest

FORMAT_VERSION = 1
#: Buckets of a versioned table; an upsert of few keys writes few of them.
BUCKETS = 64


class _Files:
    """Small files and renames through Hadoop's file system, so that any storage Spark can write to will do."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark._jvm
        self.fs = self.path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *parts: str):  # noqa: ANN201
        return self.jvm.org.apache.hadoop.fs.Path("/".join(parts))

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Writes a new file under another name and renames it, so that no reader sees half of it. It must not be there yet."""
        part = f"{path}.{uuid.uuid4().hex}.part"
        stream = self.fs.create(self.path(part), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.exists(path) or not self.fs.rename(self.path(part), self.path(path)):
            self.fs.delete(self.path(part), False)
            raise FileExistsError(path)

    def list(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(path))) if self.exists(path) else []

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


class VersionedTable:
    """A table in buckets by a hash of its key: what changes it writes the buckets it touches anew, then a pointer to all buckets.

    Pointers are numbered files and the greatest is the current one. A pointer is never replaced, so readers always find a
    whole version, and of two writers at a time the later one fails, as its number is taken. The pointer holds the schema, so
    that an empty table and one with new columns can be read.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, keep: int = 2) -> None:
        self.spark, self.base, self.files, self.buckets, self.keep = spark, path.rstrip("/"), _Files(spark, path), buckets, keep

    def versions(self) -> list[int]:
        return sorted(int(f[2:10]) for f in self.files.list(self.base) if f.startswith("_v") and f.endswith(".json"))

    def exists(self) -> bool:
        return bool(self.versions())

    def _pointer(self, version: int) -> dict:
        return json.loads(self.files.read(f"{self.base}/_v{version:08d}.json"))

    def read(self, version: int | None = None) -> DataFrame:
        """The current version, or an earlier one that is still kept."""
        return self._rows(self._pointer(self.versions()[-1] if version is None else version))

    def _rows(self, pointer: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(pointer["schema"]))
        paths = [f"{self.base}/{p}" for b, p in pointer["parts"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, key: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*sorted(key)), F.lit(buckets)).cast("int")

    def _commit(self, rows: DataFrame, key: list[str], pointer: dict | None, touched: list[int] | None) -> None:
        """Writes rows, all there is of the touched buckets (all buckets if None), and the next pointer."""
        last = self.versions()[-1:]
        number, buckets = (last[0] if last else 0) + 1, pointer["buckets"] if pointer else self.buckets
        folder = f"d{number:08d}-{uuid.uuid4().hex[:8]}"
        rows.withColumn("b__", self._bucket(key, buckets)).repartition("b__").write.partitionBy("b__").parquet(f"{self.base}/{folder}")
        new = {f.partition("=")[2]: f"{folder}/{f}" for f in self.files.list(f"{self.base}/{folder}") if f.startswith("b__=")}
        kept = {b: p for b, p in pointer["parts"].items() if int(b) not in touched} if pointer and touched is not None else {}
        self.files.write(f"{self.base}/_v{number:08d}.json", json.dumps({"key": sorted(key), "buckets": buckets, "schema": rows.schema.json(), "parts": kept | new}))
        self._clean()

    def _clean(self) -> None:
        """Drops all but the newest versions and what only they refer to; what no version knows yet is left alone."""
        versions = self.versions()
        folders = lambda some: {p.split("/")[0] for v in some for p in self._pointer(v)["parts"].values()}
        old, kept = versions[: -self.keep], folders(versions[-self.keep :])
        for folder in folders(old) - kept:
            self.files.delete(f"{self.base}/{folder}")
        for v in old:
            self.files.delete(f"{self.base}/_v{v:08d}.json")

    def replace(self, df: DataFrame, key: list[str]) -> None:
        """Makes df, whose rows are told apart by key, the new version."""
        self._commit(df, key, None, None)

    def _touched(self, keys: DataFrame, key: list[str], buckets: int) -> list[int]:
        return [r[0] for r in keys.select(self._bucket(key, buckets)).distinct().collect()]

    def upsert(self, rows: DataFrame, key: list[str], order: str) -> None:
        """Merges rows: per key the one with the greatest `order` stays. Only the buckets of the rows' keys are read and written."""
        rows = rows.persist()
        try:
            pointer = self._pointer(self.versions()[-1]) if self.exists() else None
            if pointer and pointer["key"] != sorted(key):
                raise ValueError(f"the table's key is {pointer['key']}")
            touched = self._touched(rows, key, pointer["buckets"] if pointer else self.buckets)
            both = self._rows(pointer, touched).unionByName(rows, allowMissingColumns=True) if pointer else rows
            others = [c for c in both.columns if c not in key]
            newest = both.groupBy(*key).agg(F.max_by(F.struct(*others), order).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in others])
            self._commit(newest.select(*both.columns), key, pointer, touched)
        finally:
            rows.unpersist()

    def delete(self, keys: DataFrame, key: list[str]) -> None:
        pointer = self._pointer(self.versions()[-1])
        touched = self._touched(keys, key, pointer["buckets"])
        self._commit(self._rows(pointer, touched).join(keys, key, "left_anti"), key, pointer, touched)

    def delete_by(self, condition: Column) -> None:
        """Deletes the rows that meet a condition; only the buckets that hold some are written."""
        pointer = self._pointer(self.versions()[-1])
        key = pointer["key"]
        rows = self._rows(pointer)
        touched = self._touched(rows.where(condition), key, pointer["buckets"])
        self._commit(self._rows(pointer, touched).where(~F.coalesce(condition, F.lit(False))), key, pointer, touched)

    def set_columns(self, values: DataFrame) -> None:
        """Sets columns of existing rows (key and new values); keys that aren't there are ignored, as are columns not given."""
        pointer = self._pointer(self.versions()[-1])
        key = pointer["key"]
        touched = self._touched(values, key, pointer["buckets"])
        old = self._rows(pointer, touched)
        new = values.select(*key, F.struct(*[c for c in values.columns if c not in key]).alias("n__"))
        set_ = {c for c in values.columns if c not in key}
        both = old.join(new, key, "left")
        self._commit(both.select(*[F.when(F.col("n__").isNotNull(), F.col(f"n__.{c}")).otherwise(F.col(c)).alias(c) if c in set_ else F.col(c) for c in old.columns]), key, pointer, touched)

    def drop(self) -> None:
        self.files.delete(self.base)


def write_snapshot(spark: SparkSession, path: str, tables: dict[str, DataFrame], **manifest: object) -> dict:
    """Writes tables and a manifest with counts and a digest of each; writing the same content again changes nothing."""
    files = _Files(spark, path)
    if files.exists(f"{path}/manifest.json"):
        old = json.loads(files.read(f"{path}/manifest.json"))
        if old["digests"] == {n: content_digest(df) for n, df in tables.items()}:
            return old
        raise ValueError(f"{path} holds another snapshot")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    written = {name: spark.read.parquet(f"{path}/{name}") for name in tables}
    info = {"format_version": FORMAT_VERSION, **manifest, "counts": {n: df.count() for n, df in written.items()}, "digests": {n: content_digest(df) for n, df in written.items()}}
    files.write(f"{path}/manifest.json", json.dumps(info, sort_keys=True))
    return info


def content_digest(df: DataFrame) -> str:
    """A hash of a table's rows that depends neither on their order nor on that of the columns."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    first = digest(df.select(F.lit(1).alias("g"), line.alias("line")), ["g"], F.col("line")).select("digest").first()
    return first["digest"] if first else ""


def read_snapshot(spark: SparkSession, path: str, embed_model: str | None = None, embed_dim: int | None = None) -> tuple[str, dict, dict[str, DataFrame]]:
    """reason ('' if it is fine), manifest and tables. Checked in this order: format, model, dimension, digests."""
    files = _Files(spark, path)
    if not files.exists(f"{path}/manifest.json"):
        return "no manifest", {}, {}
    info = json.loads(files.read(f"{path}/manifest.json"))
    if info.get("format_version") != FORMAT_VERSION:
        return "format", info, {}
    if embed_model is not None and info.get("embed_model") != embed_model:
        return "model", info, {}
    if embed_dim is not None and info.get("embed_dim") != embed_dim:
        return "dimension", info, {}
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in info["digests"]}
    if any(content_digest(df) != info["digests"][n] for n, df in tables.items()):
        return "digest", info, {}
    return "", info, tables


def apply_snapshot(spark: SparkSession, path: str, targets: dict[str, tuple[VersionedTable, list[str]]], embed_model: str | None = None, embed_dim: int | None = None) -> str:
    """Restores a snapshot: each target (table, key) is replaced by the snapshot's table of its name, or emptied if it has none.

    The snapshot is verified first; returns '' or why it was refused, and then nothing is changed.
    """
    reason, _, tables = read_snapshot(spark, path, embed_model, embed_dim)
    if reason:
        return reason
    for name, (target, key) in targets.items():
        if name in tables:
            target.replace(tables[name], key)
        elif target.exists():
            target.replace(target.read().limit(0), key)
    return ""


class SnapshotStore:
    """Snapshots of projects by commit, in folders project/sha."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), _Files(spark, root)

    def path(self, project: str, sha: str) -> str:
        return f"{self.root}/{project}/{sha}"

    def write(self, project: str, sha: str, tables: dict[str, DataFrame], **manifest: object) -> dict:
        return write_snapshot(self.spark, self.path(project, sha), tables, project=project, head_sha=sha, **manifest)

    def has(self, project: str, sha: str) -> bool:
        return self.files.exists(f"{self.path(project, sha)}/manifest.json")

    def read(self, project: str, sha: str, embed_model: str | None = None, embed_dim: int | None = None) -> tuple[str, dict, dict[str, DataFrame]]:
        return read_snapshot(self.spark, self.path(project, sha), embed_model, embed_dim)

    def manifests(self, project: str) -> list[dict]:
        """The manifests of a project's snapshots, the newest first (by created_at, then sha)."""
        found = [json.loads(self.files.read(f"{self.path(project, s)}/manifest.json")) for s in self.files.list(f"{self.root}/{project}") if self.has(project, s)]
        return sorted(found, key=lambda m: (m.get("created_at") or 0, m["head_sha"]), reverse=True)

    def gc(self, project: str, keep_last: int) -> list[str]:
        """Deletes all but the newest snapshots of a project; returns the deleted commits."""
        gone = [m["head_sha"] for m in self.manifests(project)[max(0, keep_last) :]]
        for sha in gone:
            self.files.delete(self.path(project, sha))
        return gone
