"""Tables that writers may retry: rows are dealt into buckets by a hash of their key.

A folder has `bucket=<n>/writer=<name>` partitions. A writer replaces its own partitions only, so a retry
writes once, and it looks for known keys in the buckets of its own rows only. A document collection adds
compaction: a manifest, which can be made only once, says which base and which later writes are valid.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkproof.operators.skew import latest
from sparkproof.session import new_folder

BUCKETS = 64


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def _fs(spark: SparkSession, path: str):
    """The file system that holds the path, be that a local disk or a cluster's store, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def with_partitions(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("writer", T.StringType())])


def read_buckets(spark: SparkSession, path: str, schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
    """Rows with `bucket` and `writer`; with `buckets` no other folder is opened."""
    make_folder(spark, path)
    rows = spark.read.schema(with_partitions(schema)).parquet(path)
    return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))


def buckets_in(rows: DataFrame, keys: list[str], buckets: int) -> list[int]:
    """Bucket numbers that occur: at most `buckets` numbers come to the driver."""
    return sorted(r[0] for r in rows.select(bucket_of(keys, buckets)).distinct().collect())


def write_buckets(rows: DataFrame, path: str, keys: list[str], writer: str, buckets: int = BUCKETS) -> None:
    """Replace what this writer wrote before in the buckets of its rows.

    A retry with the same rows leaves the same files, whatever the first attempt left."""
    dealt = rows.select("*", bucket_of(keys, buckets), F.lit(writer).alias("writer"))
    # Rebalanced by size at run time: a large bucket is written by several tasks, small ones share one.
    dealt.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "bucket", "writer"
    ).parquet(path)


def unknown_rows(rows: DataFrame, path: str, keys: list[str], writer: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows whose key no other writer has written. Only the key columns of the rows' buckets are read."""
    there = read_buckets(rows.sparkSession, path, rows.schema, buckets_in(rows, keys, buckets))
    known = there.where(F.col("writer") != writer).select(*keys).distinct()
    return rows.join(known, keys, "left_anti")


def write_once(rows: DataFrame, path: str, keys: list[str], writer: str, buckets: int = BUCKETS) -> None:
    """Add the rows whose key the table does not hold. `rows` has each key once.

    Two writers that add one key at the same time both keep it; `read_once` gives one of them."""
    write_buckets(unknown_rows(rows, path, keys, writer, buckets), path, keys, writer, buckets)


def read_once(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """One row for each key: that of the first writer by name."""
    rows = read_buckets(spark, path, schema).drop("bucket")
    return latest(rows, keys, [-F.xxhash64("writer"), F.col("writer")]).drop("writer")


def kept(df: DataFrame, name: str) -> DataFrame:
    """A table that several branches of a plan read: written once to the shared folder and read back, so it
    is computed once and a lost executor costs a task."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Collection:
    """SNK-1: documents by id, last write wins.

    `log/` holds writes, `base-<n>/` what was merged, `manifests/<n>.json` the base and the writes in it.
    A document's latest row is that with the largest `order`, then of the later writer by name."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "id", order: str = "updated_at", buckets: int = BUCKETS):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key, self.order, self.buckets = key, order, buckets

    def manifest(self) -> dict:
        fs, folder = _fs(self.spark, f"{self.path}/manifests")
        fs.mkdirs(folder)
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return {"number": 0, "base": None, "merged": []}
        text = self.spark.read.text(f"{self.path}/manifests/{max(numbers)}.json", wholetext=True).first()[0]
        return json.loads(text)

    def writers(self) -> list[str]:
        """Names of the writes in the log; these are folders, not rows."""
        fs, pattern = _fs(self.spark, f"{self.path}/log/bucket=*/writer=*")
        found = fs.globStatus(pattern) or []
        return sorted({f.getPath().getName().removeprefix("writer=") for f in found})

    def upsert(self, rows: DataFrame, writer: str) -> None:
        """Write documents under a name; the same name again replaces the write, or does nothing once it is merged."""
        if writer in self.manifest()["merged"]:
            return
        wanted = latest(rows, [self.key], [F.col(self.order)]).select(*self.schema.fieldNames())
        write_buckets(wanted, f"{self.path}/log", [self.key], writer, self.buckets)

    def rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        log = read_buckets(self.spark, f"{self.path}/log", self.schema, buckets)
        if manifest["merged"]:
            log = log.where(~F.col("writer").isin(manifest["merged"]))
        if manifest["base"] is None:
            return log
        return read_buckets(self.spark, f"{self.path}/{manifest['base']}", self.schema, buckets).unionByName(log)

    def current(self, ids: DataFrame | None = None) -> DataFrame:
        """The latest row of each document, or of those with an id in `ids`, whose buckets alone are read."""
        buckets = None if ids is None else buckets_in(ids, [self.key], self.buckets)
        rows = self.rows(self.manifest(), buckets)
        if ids is not None:
            rows = rows.join(ids.select(self.key).distinct(), self.key, "left_semi")
        return latest(rows, [self.key], [F.col(self.order), F.col("writer")]).select(*self.schema.fieldNames())

    def compact(self) -> bool:
        """Merge the log into a new base. False if another compaction came first; nothing is changed then.

        Writes that arrive meanwhile stay in the log. Old files are left for readers that still use them."""
        old, writers = self.manifest(), self.writers()
        new = [w for w in writers if w not in old["merged"]]
        rows = self.rows(old)
        rows = rows.where(F.col("writer").isin(new)) if old["base"] is None else rows.where(
            F.col("writer").isin(new) | (F.col("writer") == "base")
        )
        merged = latest(rows, [self.key], [F.col(self.order), F.col("writer") != "base", F.col("writer")])
        number = old["number"] + 1
        base = f"base-{number}-{uuid.uuid4().hex[:8]}"
        write_buckets(merged.select(*self.schema.fieldNames()), f"{self.path}/{base}", [self.key], "base", self.buckets)
        fs, p = _fs(self.spark, f"{self.path}/manifests/{number}.json")
        text = json.dumps({"number": number, "base": base, "merged": writers})
        try:
            out = fs.create(p, False)  # fails where the manifest is there already
        except Exception as e:
            if "exist" not in str(e).lower():
                raise
            return False
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True
