"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a character class body for Java, RE2 and Python alike.
SPACES = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters that are not ASCII white space."""
    return F.regexp_count(text, F.lit(f"[^{SPACES}]+")).cast("long")


def row_key(df: DataFrame) -> Column:
    """Two 64-bit hashes of a whole row: rows with one key are copies of each other. Maps can't be hashed and don't count."""
    names = [f"`{f.name}`" for f in df.schema if "map<" not in f.dataType.simpleString()]
    nulls = F.concat(*[F.when(F.col(n).isNull(), "0").otherwise("1") for n in names])  # hashes pass over nulls
    return F.struct(F.xxhash64(nulls, *names).alias("a"), F.xxhash64(F.lit("second"), nulls, *names).alias("b"))


#: Rows up to which a table is sent to all tasks.
SMALL_ROWS = 200_000


def sent_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df (of narrow rows), with a hint to send it whole if it has few rows; beyond that Spark chooses the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written in the shared folder to cut lineage; they survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: list[str] = []

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", codec).parquet(path)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            if name in self.names:
                self.names.remove(name)

    def drop_but(self, *names: str) -> None:
        """Remove all tables but those that the result reads."""
        self.drop(*[n for n in self.names if n not in names])
