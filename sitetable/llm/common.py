"""Helpers of this subpackage: stored intermediate tables, word splitting, table-name-safe joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitetable.session import shared_dir

# fixed value: a word is a run of anything but ASCII white space
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


class Scratch:
    """Tables under the folder in ``spark.checkpoint.dir``, which all executors share.

    A stored table survives a lost executor, cuts the lineage and has a known size, by which Spark picks its
    joins. ``clear`` deletes what was stored through this object; tables a lazy result still reads are stored
    with ``result=True`` and stay.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        self.tables: list[str] = []

    def path(self, name: str, result: bool = False) -> str:
        path = f"{self.root}/{len(self.paths)}-{name}"
        self.paths.append("" if result else path)
        return path

    def store(self, df: DataFrame, name: str, result: bool = False) -> DataFrame:
        path = self.path(name, result)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """``store``, in as many buckets by ``key`` as shuffles have partitions: joins by it move the other side only."""
        n = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
        path, table = self.path(name), f"scratch_{uuid.uuid4().hex}"
        (df.repartition(n, key).sortWithinPartitions(key).write.bucketBy(n, key).sortBy(key).format("parquet")
         .option("path", path).saveAsTable(table))
        self.tables.append(table)
        return self.spark.table(table)

    def clear(self) -> None:
        while self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop()}")
        jvm = self.spark._jvm
        for path in filter(None, self.paths):
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        self.paths = [""] * len(self.paths)


KEY_BITS, MOST_BITS = 32, 1 << 28  # of a bitmap of keys: bits a key, and bits at most (32 MB)


def marked(df: DataFrame, key: list[Column], keys: DataFrame, scratch: Scratch, name: str, result: bool = False) -> DataFrame:
    """``df`` and ``_marked``: false only where no row of ``keys`` equals ``key``; few other rows are true.

    A bitmap of hashed keys goes to every executor, so that rows that cannot have a partner need not move to a join,
    which has to follow for the others. Its size follows the number of keys up to MOST_BITS; beyond that more rows
    are marked than have a partner. ``keys`` is read twice: store it before.
    """
    wanted, bits = KEY_BITS * keys.count(), 1 << 15
    if not wanted:
        return df.withColumn("_marked", F.lit(False))
    while bits < min(wanted, MOST_BITS):
        bits *= 2

    def place(columns: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(bits)) + 1

    at = F.bitmap_bit_position("_place")
    marks = keys.select(place([F.col(c) for c in keys.columns]).alias("_place")).select(F.bitmap_bucket_number("_place").alias("_part"), at.alias("_at"))
    # dealt before they are folded: a task's own bitmaps would be larger than its keys
    marks = scratch.store(marks.repartition("_part").groupBy("_part").agg(F.bitmap_construct_agg("_at").alias("_bits")), f"{name}-marks", result)
    placed = df.withColumn("_place", place(key)).withColumns({"_part": F.bitmap_bucket_number("_place"), "_at": at})
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return placed.join(F.broadcast(marks), "_part", "left").select(
        *df.columns, F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1, F.lit(False)).alias("_marked"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def hash60(value: Column) -> Column:
    """60 bits of the md5 of a value's text (null: ``null``), the same in every engine."""
    text = F.coalesce(value.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def fresh(taken: list[str], wanted: str) -> str:
    """``wanted``, or a variant of it that no column in ``taken`` has (case ignored)."""
    used = {c.lower() for c in taken}
    name, i = wanted, 0
    while name.lower() in used:
        i += 1
        name = f"{wanted}_{i}"
    return name


def salted_join(left: DataFrame, right: DataFrame, key: str, salt: Column, salts: int = 64,
                hint: str | None = None) -> DataFrame:
    """Inner join on ``key`` (unique in ``right``) that deals the rows of a hot key to ``salts`` groups.

    The right row is copied once per salt that occurs with its key, so never more often than the left has rows.
    ``left`` is read twice: store it before.
    """
    left = left.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    copies = left.select(key, "_salt").distinct().join(right, key)
    return left.join(copies.hint(hint) if hint else copies, [key, "_salt"]).drop("_salt")
