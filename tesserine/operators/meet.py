"""The join of rows that meet at a shared node, where both sides may have many for one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that stay together; a key with more on a side is cut into so many parts of it.
BLOCK = 2048


def meet(left: DataFrame, key: str, right: DataFrame, other: str, ids: list[str], other_ids: list[str]) -> DataFrame:
    """left.join(right, key = other), spread over all tasks whatever the keys: a key with
    more than BLOCK rows on either side is cut into blocks of both, and each block of one
    meets each of the other once. ids and other_ids are columns by which rows are dealt
    to blocks. Copies are a fraction (2 / BLOCK) of the rows that come out, and at most
    one in BLOCK rows of input is a key in the broadcast table."""
    spark = left.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def blocks(df: DataFrame, on: str, name: str) -> DataFrame:
        n = df.groupBy(F.col(f"`{on}`").alias("__h")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
        return n.select("__h", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias(name))

    heavy = F.broadcast(blocks(left, key, "__a").join(blocks(right, other, "__b"), "__h", "full_outer"))
    one = lambda c: F.coalesce(c, F.lit(1))

    def dealt(df: DataFrame, on: str, by: list[str], own: str, many: str, at: str, each: str) -> DataFrame:
        df = df.join(heavy, F.col(f"`{on}`") == F.col("__h"), "left")
        df = df.withColumn(at, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in by]), one(F.col(own)).cast("long")).cast("int"))
        return df.withColumn(each, F.explode(F.sequence(F.lit(0), one(F.col(many)) - 1))).drop("__h", "__a", "__b").repartition(parts, F.col(f"`{on}`"), at, each)

    a = dealt(left, key, ids, "__a", "__b", "__i", "__j")
    b = dealt(right, other, other_ids, "__b", "__a", "__k", "__l")
    # blocks of left by rows, of right by columns
    return a.join(b, (F.col(f"`{key}`") == F.col(f"`{other}`")) & (F.col("__i") == F.col("__l")) & (F.col("__j") == F.col("__k"))).drop("__i", "__j", "__k", "__l")
