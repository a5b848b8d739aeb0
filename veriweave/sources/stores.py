"""Documents, vector points and the sync manifest as Parquet tables.

A stored table never replaces the files it is being computed from: each write
goes to a new version folder, and a one-row pointer names the current one.

A table with a key lies in buckets by the hash of that key, sorted by it and with a
bloom filter on it. A change reads and writes the buckets it meets and no others: the
new pointer names new folders for those and the old ones for the rest. A row is looked
up in the one bucket of its key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The kinds of documents, each the prefix of its document ids.
DOCUMENT_TYPES = (
    "case_summary",
    "accused_profile",
    "victim_profile",
    "officer_profile",
    "district_summary",
    "court_summary",
)


BUCKETS = 64
# Folder names that carry the version and the bucket of their rows; no columns of the table.
_VERSION, _BUCKET = "_version", "_bucket"


class VersionedTable:
    """A Parquet table whose rewrites never touch the version being read.

    The pointer of a version is a folder of its own, named in ascending order and complete
    once Spark has committed it; the newest complete one counts. It keeps the schema, so a
    table without rows can be read. Versions before the last ``keep`` are removed.

    With a ``key`` the rows lie in ``buckets`` by its hash, and a pointer names the folder of
    every bucket. The number of buckets is that of the first version; choose it so that a
    bucket is about a file of the size wanted. ``bucket_by`` names another column for that, if
    rows are looked up by it; rows that are removed then come with it.
    """

    def __init__(
        self, spark: SparkSession, path: str, partition_by: str | None = None, keep: int = 3, key: str | None = None, buckets: int = BUCKETS,
        bucket_by: str | None = None,
    ) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.partition_by = partition_by
        self.keep = keep
        self.key = key
        self.buckets = buckets
        self.bucket_by = bucket_by or key

    def _folder(self, name: str):
        """A folder of the table and the file system it is on."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        """Names of the complete pointers, oldest first."""
        path, files = self._folder("_versions")
        if not files.exists(path):
            return []
        found = [str(s.getPath().getName()) for s in files.listStatus(path)]
        return sorted(name for name in found if files.exists(self._folder(f"_versions/{name}/_SUCCESS")[0]))

    def exists(self) -> bool:
        """True once a version has been written."""
        return bool(self._versions())

    def _pointer(self, name: str) -> dict:
        row = json.loads(self.spark.read.text(f"{self.path}/_versions/{name}").first()["value"])
        return row | {"schema": T.StructType.fromJson(row["schema"])}

    def _current(self) -> dict:
        return self._pointer(self._versions()[-1])

    def folders(self) -> list[str]:
        """Folders of the current version: one, or one for each bucket that has rows."""
        return self._folders_of(self._current())

    def _folders_of(self, pointer: dict) -> list[str]:
        if "buckets" not in pointer:
            return [pointer["folder"]]
        return [f"{_VERSION}={version}/{_BUCKET}={bucket}" for bucket, version in sorted(pointer["folders"].items(), key=lambda x: int(x[0]))]

    def read(self) -> DataFrame:
        """The current version."""
        return self._read(self._current())

    def _read(self, pointer: dict, only: set[int] | None = None) -> DataFrame:
        schema = pointer["schema"]
        if "buckets" not in pointer:
            return self.spark.read.schema(schema).parquet(pointer["folder"])
        folders = pointer["folders"] if only is None else {b: v for b, v in pointer["folders"].items() if int(b) in only}
        if not folders:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{f}" for f in self._folders_of(pointer | {"folders": folders})]
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*paths).select(*[F.col(f"`{c}`") for c in schema.names])

    def _bucket_of(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")

    def _met(self, keys: DataFrame, buckets: int) -> set[int]:
        """Buckets that some of the keys lie in: numbers, no more than there are buckets."""
        return {r[0] for r in keys.select(self._bucket_of(F.col(self.bucket_by), buckets)).distinct().collect()}

    def lookup(self, keys: DataFrame | Sequence, key: str | None = None) -> DataFrame:
        """Rows whose key (or ``bucket_by`` column) is listed, from the buckets of those only.

        The files of a bucket are sorted by the key. A list of keys becomes a filter, for which
        Parquet skips row groups by their range and bloom filter; a frame of keys is joined.
        """
        pointer = self._current()
        key = self.bucket_by or key
        n = pointer.get("buckets")
        if isinstance(keys, DataFrame):
            listed = keys.select(key).distinct()
            return self._read(pointer, n and self._met(listed, n)).join(listed, key, "left_semi")
        if not keys:
            return self._read(pointer).limit(0)
        asked = self.spark.createDataFrame([(k,) for k in keys], T.StructType([pointer["schema"][key]]))
        return self._read(pointer, n and self._met(asked, n)).filter(F.col(key).isin(*keys))

    def _write(self, df: DataFrame, buckets: int) -> dict[str, str]:
        """Write rows by bucket under a new version; the version of each bucket that has rows."""
        version = uuid.uuid4().hex
        within = [c for c in (self.partition_by,) if c]
        # A bucket of many rows is written by several tasks, as files of their own.
        dealt = df.withColumn(_BUCKET, self._bucket_of(F.col(self.bucket_by), buckets)).hint("rebalance", F.col(_BUCKET)).sortWithinPartitions(_BUCKET, *within, self.bucket_by)
        dealt.write.mode("errorifexists").option(f"parquet.bloom.filter.enabled#{self.bucket_by}", "true").partitionBy(_BUCKET, *within).parquet(
            f"{self.path}/{_VERSION}={version}"
        )
        path, files = self._folder(f"{_VERSION}={version}")
        names = [str(s.getPath().getName()) for s in files.listStatus(path)]
        return {n.split("=")[1]: version for n in names if n.startswith(f"{_BUCKET}=")}

    def replace(self, df: DataFrame) -> None:
        """Write a new version, then point to it."""
        if self.key:
            self._point({"buckets": self.buckets, "folders": self._write(df, self.buckets)}, df.schema)
            return
        folder = f"{self.path}/v-{uuid.uuid4().hex}"
        writer = df.write.mode("errorifexists")
        if self.partition_by:
            writer = writer.partitionBy(self.partition_by)
        writer.parquet(folder)
        self._point({"folder": folder}, df.schema)

    def _point(self, to: dict, schema: T.StructType) -> None:
        """Make a written version the current one, and remove those that are too old."""
        earlier = self._versions()
        number = int(earlier[-1].split("-")[0]) + 1 if earlier else 0
        value = json.dumps({**to, "schema": schema.jsonValue()})
        pointer = self.spark.createDataFrame([(value,)], "value string").coalesce(1)
        pointer.write.text(f"{self.path}/_versions/{number:012d}-{uuid.uuid4().hex}")
        gone = earlier[: max(0, len(earlier) + 1 - self.keep)]
        if not gone:
            return
        used = {f for name in self._versions() if name not in gone for f in self._folders_of(self._pointer(name))}
        for name in gone:
            self._remove(name, used)

    def _remove(self, name: str, used: set[str]) -> None:
        """Remove a version: its pointer first, so that none points to nothing, then the folders no other version uses."""
        folders = self._folders_of(self._pointer(name))
        for part in (f"_versions/{name}", *[f.removeprefix(f"{self.path}/") for f in folders if f not in used]):
            path, files = self._folder(part)
            files.delete(path, True)

    def change(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, key: str | None = None) -> int:
        """Replace or add rows by their key and remove others, in one new version; how many buckets were written.

        Rows that are both removed and given stay as given. Buckets that no key lies in keep
        their files; a table without buckets is one.
        """
        key = self.key or key
        if not self.exists():
            self.replace(upserts if upserts is not None else deletes.limit(0))
            return self.buckets if self.key else 1
        pointer = self._current()
        n = pointer.get("buckets")
        given = [df.select(*dict.fromkeys([key, self.bucket_by or key])) for df in (upserts, deletes) if df is not None]
        keys = given[0] if len(given) == 1 else given[0].unionByName(given[1])
        met = self._met(keys, n) if n else None
        if n and not met:
            return 0
        rows = delete_rows(self._read(pointer, met), keys, key)
        if upserts is not None:
            rows = rows.unionByName(upserts)
        if not n:
            self.replace(rows)
            return 1
        rest = {b: v for b, v in pointer["folders"].items() if int(b) not in met}
        self._point({"buckets": n, "folders": rest | self._write(rows, n)}, pointer["schema"])
        return len(met)

    def upsert(self, rows: DataFrame, key: str) -> None:
        """Replace the rows with the same key and add the others."""
        self._by(key).change(upserts=rows, key=key)

    def delete(self, keys: DataFrame, key: str) -> None:
        """Remove the rows whose key is in ``keys``."""
        self._by(key).change(deletes=keys, key=key)

    def _by(self, key: str) -> VersionedTable:
        if self.key not in (None, key):
            raise ValueError(f"rows of {self.path} are kept by {self.key}, not by {key}")
        return self


def upsert_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows without a newer version, and all new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_rows(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Old rows whose key is not listed."""
    return old.join(keys.select(key).distinct(), key, "left_anti")


def document_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> VersionedTable:
    """Documents by bucket of their id, one folder per kind in each."""
    return VersionedTable(spark, path, partition_by="document_type", key="document_id", buckets=buckets)


def point_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> VersionedTable:
    """Points by bucket of their id."""
    return VersionedTable(spark, path, key="point_id", buckets=buckets)


def manifest_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> VersionedTable:
    """The sync manifest by bucket of the document id."""
    return VersionedTable(spark, path, key="document_id", buckets=buckets)


def type_of_id(document_id: str) -> str | None:
    """Kind of a document by the prefix of its id."""
    return next((t for t in DOCUMENT_TYPES if document_id.startswith(f"{t}_")), None)


def get_document(documents: DataFrame, document_id: str) -> DataFrame:
    """One document; the kind read from the id limits the scan to one folder."""
    kind = type_of_id(document_id)
    if kind is None:
        return documents.filter(F.lit(False))
    return documents.filter((F.col("document_type") == kind) & (F.col("document_id") == document_id))


def get_documents(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is listed (S10, for many ids)."""
    return documents.join(ids.select("document_id").distinct(), "document_id", "left_semi")


def ids_of_type(documents: DataFrame, document_type: str) -> DataFrame:
    """Ids of one kind; reads one folder and one column."""
    return documents.filter(F.col("document_type") == document_type).select("document_id")


def type_counts(documents: DataFrame) -> DataFrame:
    """Documents per kind."""
    first_parts = documents.filter("part_no = 0") if "part_no" in documents.columns else documents
    return first_parts.groupBy("document_type").agg(F.count(F.lit(1)).alias("documents"))


def document_index(documents: DataFrame) -> DataFrame:
    """Where each document is stored."""
    return documents.select("document_id", "document_type", F.input_file_name().alias("path"))


def points_with_wrong_dimension(points: DataFrame, dimension: int) -> DataFrame:
    """Points a collection of this dimension must not hold."""
    return points.filter(F.size("vector") != dimension)


def rebuild_points(store: VersionedTable, points: DataFrame, dimension: int) -> None:
    """Replace the collection, refusing points of another dimension."""
    wrong = points_with_wrong_dimension(points, dimension)
    if not wrong.isEmpty():
        raise ValueError(f"points must have {dimension} dimensions: {wrong.select('point_id').first()[0]} has not")
    store.replace(points)
