"""Parquet tables of a dataset folder, and the other files of the pipeline."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator, Sequence
from typing import Any
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill import schemas
from lakequill.sources.versioned import Versioned

#: Bytes of a file that are hashed at once.
BLOCK = 1 << 20


class Dataset:
    """A folder of tables. Filters and columns reach the Parquet scan; of chunks and vectors, kept in parts by size, only the parts asked for are read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}.parquet"

    def load(self, table: str, columns: Sequence[str] | None = None, **where: Any) -> DataFrame:
        """The rows for which every given column equals the given value; without filters all."""
        df = read_table(self.spark, self.path(table), **where)
        return df.select(*columns) if columns else df

    def read(self, table: str, rules: dict[str, Column], json_columns: dict[str, str] | None = None, **where: Any) -> DataFrame:
        """load, with JSON text columns parsed under their schemas and every row checked."""
        df = self.load(table, **where)
        for name, schema in (json_columns or {}).items():
            df = df.withColumn(name, F.from_json(name, schema))
        return schemas.checked(df, rules)

    def rows_of(self, table: str, ids: DataFrame, key: str = "id") -> DataFrame:
        """The rows whose key is in ids, each once."""
        return self.load(table).join(ids.select(key).distinct(), key, "left_semi")

    def embeddings(self, provider: str, size: int) -> DataFrame:
        """(chunk_id, vec) of a provider and size; fails if their number isn't that of the chunks."""
        vectors = self.load("vectors", ["chunk_id", "vec"], provider=provider, size=size)
        have, want = vectors.count(), self.load("chunks", ["id"], size=size).count()
        if have != want:
            raise ValueError(f"{provider} has {have} vectors of size {size}, there are {want} chunks")
        return vectors

    def vector_slots(self, provider: str, size: int) -> DataFrame:
        """(chunk_id, vec) with a row for every chunk, null where it has no vector yet."""
        chunks = self.load("chunks", ["id"], size=size).withColumnRenamed("id", "chunk_id")
        try:
            found = self.load("vectors", ["chunk_id", "vec"], provider=provider, size=size)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return chunks.withColumn("vec", F.lit(None).cast("array<float>"))
        return chunks.join(found, "chunk_id", "left")

    def optional(self, table: str, schema: str, columns: Sequence[str] | None = None, **where: Any) -> DataFrame:
        """load, of a table that may be missing: then it is empty."""
        try:
            return self.load(table, columns, **where)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def write(self, table: str, df: DataFrame, partition_by: Sequence[str] = ()) -> None:
        """Replace the table; readers have the old one until the new one is whole."""
        replace(df, self.path(table), partition_by)


def replace(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Make df the table at path: see versioned. A reader has the table before or after it, and a lost write leaves the old one."""
    Versioned(df.sparkSession, path).replace(df, partition_by)


def read_table(spark: SparkSession, path: str, **where: Any) -> DataFrame:
    """The rows of a table of versions, as it stands now, or of plain Parquet, that have these values."""
    table = Versioned(spark, path)
    if table.exists():
        return table.read(**where)
    df = spark.read.parquet(path)
    for name, value in where.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace the partitions that df has rows of and leave all others; df may read from the table itself."""
    table = Versioned(df.sparkSession, path)
    if not table.exists() and table.plain():
        table.replace(df.sparkSession.read.parquet(path), partition_by)  # a table of plain Parquet becomes one of versions first
    table.replace(df, partition_by, others_stay=True)


def source_urls(spark: SparkSession, path: str) -> DataFrame:
    """(source, url) of a JSON array or of JSON lines, whichever the file is; trimmed, rows without either dropped; an empty file has none."""
    # One file that people write by hand: its first character says which of the two it is.
    start = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    if not start:
        return spark.createDataFrame([], schemas.SOURCE_URL)
    array = start[0]["value"].lstrip().startswith("[")
    rows = spark.read.schema(schemas.SOURCE_URL).option("multiLine", array).json(path)
    return rows.select(F.trim("source").alias("source"), F.trim("url").alias("url")).where("source <> '' and url <> ''")


def append_fetched(df: DataFrame, path: str) -> None:
    """Append fetch results as JSON lines; a page without text has an empty one."""
    df.withColumn("text", F.coalesce("text", F.lit(""))).write.mode("append").option("ignoreNullFields", "false").json(path)


def fetched_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FETCHED).json(path)


def layer(spark: SparkSession, path: str, items: str, with_errors: bool = True) -> DataFrame:
    """(id, items) of a working table; a missing table is empty, rows without items are left out, and those with an error too unless wanted."""
    try:
        df = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"id string, items {items}")
    df = df.where("items is not null")
    return (df if with_errors or "error" not in df.columns else df.where("error is null")).select("id", "items")


def export(tables: Iterable[DataFrame], path: str) -> None:
    """The union of the tables' rows and columns as one Parquet table."""
    from lakequill.operators.store import schema_union

    replace(schema_union(list(tables)), path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of the files below a folder, of any size: read in blocks where they lie, never as one value."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")  # without content nothing is read

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in source:
            rows = []
            for uri in pdf["path"]:
                if uri.startswith("file:"):
                    store, at = fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
                else:
                    store, at = fs.FileSystem.from_uri(quote(uri, safe=":/@"))
                digest = hashlib.sha256()
                with store.open_input_stream(at) as stream:
                    while block := stream.read(BLOCK):
                        digest.update(block)
                rows.append((at.rsplit("/", 1)[-1], digest.hexdigest()))
            yield pd.DataFrame(rows, columns=["name", "sha256"])

    return files.mapInPandas(run, "name string, sha256 string").where(~F.col("name").startswith("SHA256SUMS"))


def write_text(text: str, *paths: str) -> None:
    """A report on the driver: the latest and its dated copy."""
    from pathlib import Path

    for p in paths:
        Path(p).parent.mkdir(parents=True, exist_ok=True)
        Path(p).write_text(text, encoding="utf-8")


def config(path: str) -> dict:
    """YAML or JSON settings; an absent file is empty."""
    from pathlib import Path

    if not Path(path).exists():
        return {}
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def data_path(root_variable: str, *parts: str) -> str:
    """A path below the folder that an environment variable names (else the working folder); its parent exists afterwards."""
    import os
    from pathlib import Path

    p = Path(os.environ.get(root_variable, "."), *parts)
    p.parent.mkdir(parents=True, exist_ok=True)
    return str(p)
