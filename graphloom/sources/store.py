"""Tables that batches change: rows lie in hash buckets of a key, and a manifest says which version of each bucket counts.

A batch writes the buckets that it changes anew, then a manifest that names them; what a broken attempt wrote is named by none. A batch
that comes again, whole or in part, leaves the same rows, as replace() and merge() don't depend on how often they are called.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ledger import qualified
from .storage import materialize

_BUCKET = "__bucket"


class BucketStore:
    """A table under a path, in at most `buckets` files for each version; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...], buckets: int = 16):
        self.spark, self.path, self.key = spark, path, key
        self.files, self.root = fs.FileSystem.from_uri(qualified(spark, path))
        self.manifest = self._latest()
        self.buckets = self.manifest.get("of", buckets)

    def _latest(self) -> dict:
        found = [i for i in self.files.get_file_info(fs.FileSelector(f"{self.root}/manifests", allow_not_found=True)) if i.base_name.endswith(".json")]
        if not found:
            return {"number": 0, "buckets": {}}
        with self.files.open_input_stream(max(found, key=lambda i: i.base_name).path) as read:
            return json.loads(read.read())

    def _commit(self, changed: dict[str, str | None], kind: T.StructType, batch: int | None) -> None:
        """A new manifest, and those before the last one go with the buckets that only they name."""
        number = self.manifest["number"] + 1
        held = {k: v for k, v in (self.manifest["buckets"] | changed).items() if v}
        made = {"number": number, "of": self.buckets, "batch": batch, "schema": kind.json(), "buckets": held}
        self.files.create_dir(f"{self.root}/manifests", recursive=True)
        part = f"{self.root}/manifests/part-{uuid.uuid4().hex}"
        with self.files.open_output_stream(part) as out:
            out.write(json.dumps(made).encode())
        self.files.move(part, f"{self.root}/manifests/{number:012}.json")
        gone = {v for v in self.manifest.get("before", ()) if v not in held.values() and v not in self.manifest["buckets"].values()}
        for version in gone:
            self.files.delete_dir(f"{self.root}/data/{version}")
        self.manifest = made | {"before": sorted({*self.manifest["buckets"].values()})}

    @property
    def schema(self) -> T.StructType | None:
        """The rows' schema; None before the first batch."""
        return T.StructType.fromJson(json.loads(self.manifest["schema"])) if "schema" in self.manifest else None

    def _rows(self, buckets: list[str], kind: T.StructType) -> DataFrame:
        paths = [f"{self.path}/data/{self.manifest['buckets'][k]}/{_BUCKET}={k}" for k in buckets if k in self.manifest["buckets"]]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def read(self, schema: T.StructType | None = None) -> DataFrame:
        """All rows; before the first batch none, of the given schema."""
        kind = self.schema or schema
        if kind is None:
            raise FileNotFoundError(self.path)
        return self._rows(list(self.manifest["buckets"]), kind)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, made: DataFrame, touched: list[str], kind: T.StructType, batch: int | None) -> None:
        version = f"{'all' if batch is None else batch}-{uuid.uuid4().hex}"
        self._bucketed(made).repartition(self.buckets, _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/data/{version}")
        there = {i.base_name.partition("=")[2] for i in self.files.get_file_info(fs.FileSelector(f"{self.root}/data/{version}")) if i.base_name.startswith(_BUCKET)}
        self._commit({k: version if k in there else None for k in touched}, kind, batch)

    def _touched(self, keys: DataFrame) -> list[str]:
        return [str(r[_BUCKET]) for r in self._bucketed(keys).select(_BUCKET).distinct().collect()]  # at most `buckets`

    def replace(self, rows: DataFrame, keys: DataFrame, batch: int | None = None) -> None:
        """The rows of these keys (a table of the key columns) become `rows`; those of other keys stay."""
        rows, keys = materialize(rows, "store-rows"), materialize(keys.select(*self.key).distinct(), "store-keys")
        touched = self._touched(keys)
        if touched:
            kind = self.schema or rows.schema
            stay = self._rows(touched, kind).join(keys, list(self.key), "left_anti").select(*kind.names)
            self._write(stay.unionByName(rows), touched, kind, batch)

    def replace_all(self, rows: DataFrame, batch: int | None = None) -> None:
        self._write(rows, [str(k) for k in range(self.buckets)], rows.schema, batch)

    def merge(self, rows: DataFrame, combine: Callable[[DataFrame], DataFrame], batch: int | None = None) -> None:
        """The rows that share a key with `rows` become combine(old and new ones), which must give the same for a part that comes twice
        and in any order."""
        rows = materialize(rows, "store-rows")
        touched = self._touched(rows)
        if touched:
            kind = self.schema or rows.schema
            self._write(combine(self._rows(touched, kind).unionByName(rows)).select(*kind.names), touched, kind, batch)
