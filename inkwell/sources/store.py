"""Versioned tables on Parquet, with point reads, ranges, pages and compaction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.operators.model import NOT_EXIST, OK
from inkwell.operators.writer import KEY, fold


class Store:
    """A folder with a directory for each table and version; a version is complete once its _SUCCESS is there."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self, table: str) -> list[int]:
        at = self._path(f"{self.root}/{table}")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self._fs.exists(self._path(f"{self.root}/{table}/{n}/_SUCCESS")))

    def claim(self, table: str) -> int:
        """The next version, which no other writer gets: creating its mark is one step of the file system."""
        self._fs.mkdirs(self._path(f"{self.root}/{table}"))
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{table}"))]
        version = max((int(n[6:]) for n in names if n[:6] == "claim-"), default=0) + 1
        while True:
            try:
                if self._fs.createNewFile(self._path(f"{self.root}/{table}/claim-{version}")):
                    return version
            except Exception as e:  # some file systems raise where others say false
                if not self._fs.exists(self._path(f"{self.root}/{table}/claim-{version}")):
                    raise e
            version += 1

    def write(self, table: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        """df as the table's next version; readers of earlier ones are not disturbed."""
        version = self.claim(table)
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.root}/{table}/v{version}")
        return version

    def write_delta(self, table: str, df: DataFrame, batch: int) -> None:
        """Rows (doc_id and fields, null: as it was) of a numbered batch on top of a table; a batch written again is the same."""
        df.write.mode("overwrite").parquet(f"{self.root}/{table}_deltas/batch={batch}")

    def documents(self, table: str, fields: list[str]) -> DataFrame:
        """The last version with its deltas merged in, field by field the newest value that isn't null. Only
        documents that deltas name are grouped with them; a version of the table counts as batch -1."""
        at = self._path(f"{self.root}/{table}_deltas")
        base = self.read(table).select("doc_id", *fields, F.lit(-1).cast("long").alias("batch")) if self.versions(table) else None
        if not self._fs.exists(at):
            return base.drop("batch")
        deltas = self.spark.read.parquet(at.toString()).select("doc_id", *fields, F.col("batch").cast("long").alias("batch"))
        named = deltas.select("doc_id").distinct()
        every = deltas if base is None else deltas.unionByName(base.join(named, "doc_id", "left_semi"))
        newest = [F.max_by(n, F.when(F.col(n).isNotNull(), F.col("batch"))).alias(n) for n in fields]
        merged = every.groupBy("doc_id").agg(*newest)
        return merged if base is None else merged.unionByName(base.drop("batch").join(named, "doc_id", "left_anti"))

    def merge_deltas(self, table: str, fields: list[str]) -> int:
        """The deltas as part of the table's next version; they are deleted then. For times without a stream's writes."""
        version = self.write(table, self.documents(table, fields))
        self.drop(f"{table}_deltas")
        return version

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A snapshot: the given version, or the last."""
        return self.spark.read.parquet(f"{self.root}/{table}/v{max(self.versions(table)) if version is None else version}")

    def compact(self, table: str = "postings", keep: Column | None = None) -> int:
        """The newest state of each posting, without deleted ones and those that `keep` leaves out, sorted so that terms prune files."""
        out = fold(self.read(table))
        out = out if keep is None else out.where(keep)
        return self.write(table, out.withColumns({"state": F.lit(0), "seq": F.lit(0).cast("long")}).repartitionByRange(*map(F.col, KEY[:4])).sortWithinPartitions(*KEY))

    def drop(self, table: str | None = None) -> None:
        self._fs.delete(self._path(f"{self.root}/{table}" if table else self.root), True)


def get(rows: DataFrame, key: str, value: int) -> DataFrame:
    return rows.where(F.col(key) == value)


def multi_get(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Each key with its row and status."""
    return keys.join(rows.withColumn("there", F.lit(True)), key, "left").withColumn("status", F.when(F.col("there"), OK).otherwise(NOT_EXIST)).drop("there")


def scan_range(rows: DataFrame, key: str, low=None, high=None, desc: bool = False) -> DataFrame:
    """Rows of keys from low to high, in order."""
    rows = rows if low is None else rows.where(F.col(key) >= low)
    rows = rows if high is None else rows.where(F.col(key) <= high)
    return rows.orderBy(F.desc(key) if desc else F.asc(key))


def merged(children: list[DataFrame], *keys: str) -> DataFrame:
    """Several sorted inputs as one."""
    out = children[0]
    for c in children[1:]:
        out = out.unionByName(c)
    return out.orderBy(*keys)


def scan_page(rows: DataFrame, key: str, after, n: int, size: Column | None = None, max_bytes: int | None = None) -> DataFrame:
    """The next n rows after the cursor; with max_bytes only those before which the page has fewer bytes.
    The page's last key is the next cursor; an empty page is the end."""
    page = (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(n)
    if max_bytes is None:
        return page
    used = F.sum(size).over(Window.partitionBy(F.lit(0)).orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    return page.withColumn("used", F.coalesce(used, F.lit(0))).where(F.col("used") < max_bytes).drop("used")


def list_partitions(rows: DataFrame, business_type: int, after: int | None, n: int) -> DataFrame:
    """The next n partition sets of a type."""
    if n <= 1:
        raise ValueError("a page has more than one key")
    own = rows.where(F.col("business_type") == business_type).select("partition_set").distinct()
    return (own if after is None else own.where(F.col("partition_set") > after)).orderBy("partition_set").limit(n)


def data_size(changes: DataFrame) -> DataFrame:
    """(kv_count, data_size): how many changes a write buffer holds, and their bytes."""
    size = sum((F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in (*KEY, "state")), F.lit(0))
    return changes.agg(F.count("*").alias("kv_count"), F.coalesce(F.sum(size), F.lit(0)).alias("data_size"))


def delete_range(postings: DataFrame, field: str, low: str, high: str, seq: int) -> DataFrame:
    """Changes that delete the postings of a field's terms from low up to, but without, high."""
    own = postings.where((F.col("field") == field) & (F.col("term") >= low) & (F.col("term") < high))
    return own.select(*KEY, F.lit(1).alias("state"), F.lit(seq).cast("long").alias("seq"))


def write_batches(batches: list[tuple[str, DataFrame]], seq: Callable[[int], int] = lambda i: i) -> DataFrame:
    """A write buffer: deltas in order as one DataFrame of changes (KEY, state, seq)."""
    out = None
    for i, (_, df) in enumerate(batches):
        own = df.select(*KEY, "state", F.lit(seq(i)).cast("long").alias("seq"))
        out = own if out is None else out.unionByName(own)
    return out
