"""A keyed table that grows by committed appends.

A row lies in a hash bucket of its key. An append stages its rows, a Bloom filter of their keys for each bucket, and rows set aside
in folders of its own, then writes one small commit file by an atomic rename. Readers follow the commit files, so an append is there
whole or not at all, and what a lost driver has staged is never seen. A batch that is committed is not appended again.

The filters tell which arrived keys cannot be in the table; only buckets with a key that may be are read, to compare it
exactly. Null keys are equal to none in the table, so each append keeps one of its own. A filter has ``pages`` bitmaps of 32,768 bits for each bucket, whatever the table holds: with three bits a key, one page
for each 3,000 keys of a bucket keeps wrong hints near one in fifty. Fewer pages cost reads, not results.

    path/_commits/00000000.json   {"version", "batch", "folder", "rows", "newest"}
    path/data/append=<folder>/bucket=<n>/..   path/bloom/append=<folder>/..   path/aside/append=<folder>/..
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelbook.operators.sides import first_of_key
from duelbook.session import cut
from duelbook.sources.commits import CommitLog

PAGE_BITS = 1 << 15
HASHES = 3
_COMMIT = "version long, batch string, folder string, rows long, newest string"


@dataclass
class KeyedStore:
    """``schema`` has the key columns; ``dated`` names a date column whose newest value each commit notes."""

    spark: SparkSession
    path: str
    key: list[str]
    schema: T.StructType
    buckets: int = 64
    pages: int = 8
    dated: str | None = None

    def commits(self) -> list[dict]:
        """The commits in their order."""
        return self._log().entries()

    def holds(self, batch: str) -> bool:
        """Whether a batch is committed."""
        return any(c["batch"] == batch for c in self.commits())

    def newest(self) -> str | None:
        """The newest date of all commits, without a look at the rows."""
        return max((c["newest"] for c in self.commits() if c["newest"]), default=None)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All committed rows, or those of some buckets."""
        whole = T.StructType([*self.schema.fields, T.StructField("append", T.StringType()), T.StructField("bucket", T.IntegerType())])
        folders = [f"{self.path}/data/append={c['folder']}" for c in self.commits() if c["rows"]]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*folders)
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("append", "bucket")

    def set_aside(self, schema: T.StructType) -> DataFrame:
        """What committed appends have set aside."""
        folders = [f"{self.path}/aside/append={c['folder']}" for c in self.commits()]
        folders = [f for f in folders if self._log().exists(f)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def suspected(self, keys: DataFrame) -> DataFrame:
        """The distinct keys of which every bit is set: those that the table may hold, with their bucket."""
        folders = [f"{self.path}/bloom/append={c['folder']}" for c in self.commits() if c["rows"]]
        asked = keys.select(*self.key).distinct().withColumn("bucket", self._bucket())
        if not folders:
            return asked.limit(0)
        bits = self.spark.read.schema("bucket int, page int, bits binary").parquet(*folders).groupBy("bucket", "page").agg(F.bitmap_or_agg("bits").alias("bits"))
        each = asked.select(*self.key, "bucket", F.explode(self._places()).alias("place")).withColumn("page", F.expr(f"cast(place div {PAGE_BITS} as int)"))
        byte = F.expr(f"cast(conv(hex(substring(bits, cast(place % {PAGE_BITS} div 8 as int) + 1, 1)), 16, 10) as int)")
        isset = F.expr("byte >> cast(place % 8 as int)").bitwiseAND(F.lit(1))
        met = each.join(bits, ["bucket", "page"]).withColumn("byte", byte).select(*self.key, "bucket", isset.alias("isset"))
        return met.groupBy(*self.key, "bucket").agg(F.sum("isset").alias("n")).where(F.col("n") == HASHES).drop("n")

    def absent(self, rows: DataFrame) -> DataFrame:
        """The rows whose key the table does not hold. Buckets without a suspected key are not read."""
        suspects = cut(self.suspected(rows))
        touched = [r["bucket"] for r in suspects.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return rows
        held = self.read(touched).select(*self.key).join(suspects.select(*self.key), self.key, "left_semi").distinct()
        return rows.join(held, self.key, "left_anti").select(rows.columns)

    def append(self, batch: str, rows: DataFrame, order: list[Column], aside: DataFrame | None = None, checked: bool = False) -> bool:
        """Appends the first row of each key that the table does not hold; False if the batch was committed before.

        ``checked`` says that the table holds none of the keys.
        """
        commits = self.commits()
        if any(c["batch"] == batch for c in commits):
            return False
        folder = uuid.uuid4().hex
        count, newest = self._stage(folder, first_of_key(rows if checked else self.absent(rows), self.key, order), aside)
        self._commit({"version": len(commits), "batch": batch, "folder": folder, "rows": count, "newest": newest})
        return True

    def _stage(self, folder: str, rows: DataFrame, aside: DataFrame | None) -> tuple[int, str | None]:
        data = f"{self.path}/data/append={folder}"
        rows.select([F.col(f.name).cast(f.dataType) for f in self.schema.fields]).withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(data)
        written = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(data)
        places = written.select("bucket", F.explode(self._places()).alias("place"))
        pages = places.groupBy("bucket", F.expr(f"cast(place div {PAGE_BITS} as int)").alias("page"))
        pages.agg(F.bitmap_construct_agg(F.expr(f"place % {PAGE_BITS}")).alias("bits")).write.parquet(f"{self.path}/bloom/append={folder}")
        if aside is not None:
            aside.write.parquet(f"{self.path}/aside/append={folder}")
        newest = F.max(self.dated).cast("string") if self.dated else F.lit(None).cast("string")
        return tuple(written.agg(F.count(F.lit(1)), newest).first())

    def _commit(self, entry: dict) -> None:
        self._log().commit(entry)

    def _log(self) -> CommitLog:
        return CommitLog(self.spark, self.path, _COMMIT)

    def _hashed(self, seed: int) -> Column:
        return F.xxhash64(F.lit(seed), *[F.col(k).cast(self.schema[k].dataType) for k in self.key])

    def _bucket(self) -> Column:
        return F.pmod(self._hashed(0), F.lit(self.buckets)).cast("int")

    def _places(self) -> Column:
        return F.array(*[F.pmod(self._hashed(i + 1), F.lit(self.pages * PAGE_BITS)) for i in range(HASHES)])
