"""A table with one row a key, kept in buckets of keys; a batch rewrites only the buckets that it touches.

The table is partitioned by `bucket`.  An upsert reads the buckets of its batch (partition
pruning), merges, writes the result aside and then over those partitions alone (dynamic
partition overwrite), so bytes written follow the batch and not the table, and old versions go
with the write.  A batch that runs again, also after a loss half way, gives the same table.
A score store's key is the content hash and its bucket the first hex digits of it; any
other key is hashed.

Defined cases: an empty batch changes nothing; of several rows of a key in one batch the newest
counts (`newest`, ties by all columns); a row without key has no place and is left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textassay.sources.shared import folder


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Buckets:
    """Rows of `schema` (a DDL text with the key column) under a path, in buckets that `bucket` (a text column) names.

    `merge` maps a joined table of old and new rows (structs o and n, either null) to the kept struct.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, bucket: Column, newest: str, merge: Column | None = None):
        self.spark, self.path, self.schema, self.key, self.newest = spark, path, schema, key, newest
        self.bucket = bucket
        self.merge = F.coalesce("n", "o") if merge is None else merge
        self.columns = spark.createDataFrame([], schema).columns

    def _exists(self) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def rows(self) -> DataFrame:
        """The whole table, with its bucket."""
        schema = f"{self.schema}, bucket string"
        return self.spark.read.schema(schema).parquet(self.path) if self._exists() else self.spark.createDataFrame([], schema)

    def upsert(self, batch: DataFrame) -> list[str]:
        """Merge a batch into the table; the names of the buckets that were written."""
        order = Window.partitionBy(self.key).orderBy(F.desc(self.newest), *(F.desc(c) for c in self.columns if c not in (self.key, self.newest)))
        new = batch.select(*self.columns).where(F.col(self.key).isNotNull()).withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank").withColumn("bucket", self.bucket)
        aside = f"{folder(self.spark)}/upsert-{uuid.uuid4().hex}"
        new.write.parquet(f"{aside}/new")
        new = self.spark.read.schema(new.schema).parquet(f"{aside}/new")
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # names of buckets, as many as the store has at most
        if touched:
            whole = F.struct(*self.columns)
            old = self.rows().where(F.col("bucket").isin(touched)).select(self.key, "bucket", whole.alias("o"))
            both = old.join(new.select(self.key, "bucket", whole.alias("n")).hint("merge"), [self.key, "bucket"], "full")
            both.select(self.merge.alias("r"), "bucket").where("r IS NOT NULL").select("r.*", "bucket").write.parquet(f"{aside}/merged")
            merged = self.spark.read.schema(f"{self.schema}, bucket string").parquet(f"{aside}/merged")
            merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        _delete(self.spark, aside)
        return touched


def keyed(spark: SparkSession, path: str, schema: str, key: str, newest: str, merge: Column | None = None, buckets: int = 64) -> Buckets:
    """A store by any key, dealt over `buckets` by hash."""
    return Buckets(spark, path, schema, key, F.format_string("%04d", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), newest, merge)


class ScoreStore(Buckets):
    """Scores by content hash; `digits` hex digits of it name the bucket (256 buckets for two).

    A stored score gives way to a new one of the same hash if it has no owner or the same one; the
    first owner stays.
    """

    SCHEMA = "content_hash string, overall double, scored_on date, owner bigint, matched string, url string"

    def __init__(self, spark: SparkSession, path: str, digits: int = 2):
        other = F.col("o.owner").isNotNull() & ~F.col("o.owner").eqNullSafe(F.col("n.owner"))
        owned = F.col("n").withField("owner", F.col("o.owner"))
        merge = F.when(F.col("n").isNull() | F.col("o").isNotNull() & other, F.col("o")).when(F.col("o").isNull(), F.col("n")).otherwise(owned)
        super().__init__(spark, path, self.SCHEMA, "content_hash", F.substring("content_hash", 1, digits), "scored_on", merge)
        self.digits = digits

    def by_hash(self, prefix: str) -> DataFrame:
        """Scores whose hash begins with a prefix; long enough ones read one bucket."""
        own = F.col("content_hash").startswith(prefix)
        return self.rows().where(own & F.col("bucket").startswith(prefix[: self.digits])).drop("bucket")

    def query(self, least: float | None = None, most: float | None = None, since=None, until=None, rule: str | None = None, owner: int | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
        """Scores that pass all filters given, the newest first."""
        rows = self.rows().drop("bucket")
        tests = [(least, F.col("overall") >= F.lit(least)), (most, F.col("overall") <= F.lit(most)), (since, F.col("scored_on") >= F.lit(since)), (until, F.col("scored_on") <= F.lit(until)), (rule, F.array_contains(F.split("matched", "[|]"), F.lit(rule))), (owner, F.col("owner") == F.lit(owner))]
        for given, test in tests:
            rows = rows if given is None else rows.where(test)
        return rows.orderBy(F.desc("scored_on"), "content_hash").offset(offset).limit(limit)

    def history(self, limit: int = 20, owner: int | None = None) -> DataFrame:
        return self.query(owner=owner, limit=limit)
