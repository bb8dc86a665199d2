"""Tables of immutable folders and a pointer that is committed last.

A version is a small JSON file that names the folders which make up the table. A write puts its rows into new folders and
then adds the next version; a reader takes the newest one, so it sees the table before or after a write and never
without one, and what a lost write left is named by no version. Tables with keys are kept in buckets of them: a merge
reads and writes the buckets its rows fall into and takes the others over as they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lakequill.operators.store import latest, upsert

BUCKET = "__bucket"


def _value(name: str) -> str | None:
    """The value that a folder's name stands for."""
    return None if name == "__HIVE_DEFAULT_PARTITION__" else unquote(name)


class Conflict(RuntimeError):
    """Another writer committed meanwhile; nothing of this write counts."""


class Versioned:
    """The table at path. keys and buckets are those of its first merge; a table that was only replaced has none."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        """The numbers of all versions that are kept, oldest first."""
        folder = self._at("versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def exists(self) -> bool:
        return bool(self.versions())

    def plain(self) -> bool:
        """Whether the path holds something that isn't of a version."""
        return self._fs.exists(self._at("")) and any(s.getPath().getName() not in ("versions", "data") for s in self._fs.listStatus(self._at("")))

    def manifest(self, version: int | None = None) -> dict:
        """What a version names; the newest by default, an empty one if there is none."""
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "keys": [], "buckets": 0, "partition_by": [], "parts": {}, "values": {}, "batches": {}}
        source = self._fs.open(self._at(f"versions/v{version or known[-1]}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def _commit(self, manifest: dict, of: int) -> None:
        """Add the version that follows `of`: written under another name, renamed where none of that name exists."""
        fresh, target = self._at(f"versions/.{uuid.uuid4().hex}"), self._at(f"versions/v{of + 1}.json")
        out = self._fs.create(fresh, False)
        out.write(json.dumps(manifest | {"version": of + 1}).encode())
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()) if target.toUri().getScheme() else self._jvm.org.apache.hadoop.fs.FileContext.getFileContext()
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(fresh, target, none)
        except Exception as e:
            self._fs.delete(fresh, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{self.path}: version {of + 1} is there already") from None
            raise

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None, **where: Any) -> DataFrame:
        """The rows of a version; of some buckets, or of the parts whose partition columns have these values, only their files are read. Without a version it fails as a missing path does."""
        m = self.manifest(version)
        if m["schema"] is None:
            raise FileNotFoundError(f"PATH_NOT_FOUND: {self.path} has no version")
        schema = StructType.fromJson(json.loads(m["schema"]))
        own = {k: str(v) for k, v in where.items() if k in m["partition_by"]}
        fits = lambda part: all(m["values"][part][k] == v for k, v in own.items())
        parts = [p for p in sorted(m["parts"]) if fits(p) and (buckets is None or int(p) in buckets)]
        df = self._files(schema, [m["parts"][p] for p in parts], bool(m["partition_by"]))
        for name, value in where.items():
            df = df.where(F.col(name) == F.lit(value))
        return df

    def _files(self, schema: StructType, parts: list[str], partitioned: bool) -> DataFrame:
        """The rows of some parts. Partition columns are in the names of folders, below the folder of the write that made them."""
        writes: dict[str, list[str]] = {}
        for p in parts:
            writes.setdefault("/".join(p.split("/")[:2]) if partitioned else "", []).append(f"{self.path}/{p}")
        out = None
        for base, folders in writes.items():
            reader = self.spark.read.schema(schema)
            df = (reader.option("basePath", f"{self.path}/{base}") if base else reader).parquet(*folders).select(*schema.names)
            out = df if out is None else out.unionByName(df)
        return self.spark.createDataFrame([], schema) if out is None else out

    def replace(self, df: DataFrame, partition_by: Sequence[str] = (), others_stay: bool = False) -> int:
        """df, which may read the table itself, becomes the table; its new version is returned. others_stay: only the parts that df has rows of are replaced."""
        m = self.manifest()
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(f"{self.path}/{folder}")
        parts, values = {"": folder}, {"": {}}
        for _ in partition_by:  # one level of folders each
            level = [(k, f, s.getPath().getName()) for k, f in parts.items() for s in self._fs.listStatus(self._at(f)) if s.isDirectory()]
            parts = {f"{k}/{name}": f"{f}/{name}" for k, f, name in level}
            values = {f"{k}/{name}": values[k] | {name.split("=", 1)[0]: _value(name.split("=", 1)[1])} for k, _, name in level}
        if others_stay and m["partition_by"] == list(partition_by):
            parts, values = m["parts"] | parts, m["values"] | values
        self._commit({"schema": df.schema.json(), "keys": [], "buckets": 0, "partition_by": list(partition_by), "parts": parts, "values": values, "batches": m["batches"]}, m["version"])
        return m["version"] + 1

    def merge(self, new: DataFrame, keys: Sequence[str], combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None, buckets: int = 64, batch: tuple[str, int] | None = None) -> int:
        """Bring new rows in, bucket by bucket: combine(old, new) gives a bucket's rows, by default new rows replace those of their keys.

        combine sees whole buckets only, so it must not look beyond a key. batch (writer, number): a number that this
        writer has committed before, or a smaller one, is left out, so a stream's batch that runs again changes nothing.
        Returns the table's version.
        """
        m = self.manifest()
        if batch and m["batches"].get(batch[0], -1) >= batch[1]:
            return m["version"]
        if m["buckets"] and list(keys) != m["keys"]:
            raise ValueError(f"{self.path} is kept by {m['keys']}")
        n = m["buckets"] or buckets
        of = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
        if m["schema"] is not None and not m["buckets"]:
            raise ValueError(f"{self.path} isn't kept in buckets")
        path = f"{self.path}/data/{uuid.uuid4().hex}-new"
        new.withColumn(BUCKET, of).write.parquet(path)  # computed once: it decides the buckets and is merged
        new = self.spark.read.schema(StructType([*new.schema.fields, StructField(BUCKET, IntegerType())])).parquet(path)
        touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # numbers of buckets
        parts = dict(m["parts"])
        if touched:
            fresh = new.drop(BUCKET)
            old = self.read(m["version"], touched) if m["schema"] is not None else fresh.limit(0)
            rows = (combine or (lambda a, b: upsert(a, b, keys)))(old, fresh).select(*fresh.columns)
            folder = f"data/{uuid.uuid4().hex}"
            rows.withColumn(BUCKET, of).repartition(BUCKET, *keys).write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
            for b in touched:
                part = f"{folder}/{BUCKET}={b}"
                parts = parts | {str(b): part} if self._fs.exists(self._at(part)) else {k: v for k, v in parts.items() if k != str(b)}
        schema = m["schema"] or new.drop(BUCKET).schema.json()
        self._commit({"schema": schema, "keys": list(keys), "buckets": n, "partition_by": [], "parts": parts, "values": {}, "batches": m["batches"] | (dict([batch]) if batch else {})}, m["version"])
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(path), True)
        return m["version"] + 1

    def vacuum(self, keep: int = 2) -> None:
        """Drop all but the last `keep` versions and every folder that none of these names; a reader of an older one would fail."""
        known = self.versions()
        for v in known[:-keep] if keep else known:
            self._fs.delete(self._at(f"versions/v{v}.json"), False)
        named = {f.split("/")[1] for v in known[-keep:] for f in self.manifest(v)["parts"].values()}
        folder = self._at("data")
        for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if s.getPath().getName() not in named:
                self._fs.delete(s.getPath(), True)


def keep_latest(order: Sequence[str], keys: Sequence[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A combine of merge: of each key the last row by the order."""
    return lambda old, new: latest(old.unionByName(new), keys, [F.col(c) for c in order])


def resume(rows: DataFrame, key: str, done: Versioned, work: Callable[[DataFrame], DataFrame], groups: int = 4, buckets: int = 64, error: str | None = None) -> DataFrame:
    """work over those rows whose key `done` hasn't yet, committed group by group of buckets; the table afterwards.

    A run that is lost keeps the groups it has committed, and the next one goes on with the rest; without new keys it
    writes nothing. error: a column of the result; a done row that has one counts as open. work gives one or more rows
    of each key, which come with all rows of a key together.
    """
    of = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    for g in range(groups):
        own = [b for b in range(buckets) if b % groups == g]
        fresh = rows.where(of.isin(own))
        if done.exists():
            before = done.read(buckets=own)
            fresh = fresh.join((before.where(F.col(error).isNull()) if error else before).select(key).distinct(), key, "left_anti")
        if not fresh.isEmpty():
            done.merge(work(fresh), [key], _whole_keys(key), buckets)
    return done.read()


def _whole_keys(key: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """All new rows, and the old ones of other keys."""
    return lambda old, new: old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)
