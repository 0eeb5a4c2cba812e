"""Sharding by jump consistent hash (Lamping and Veach 2014), in SQL functions alone.

A key's shard follows from the key and the number of shards; there is no table of shards, and
going from n to n + 1 shards moves the rows of the new shard and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facematch.llm.common import documents, free_name, stored

#: Fixed: the paper's multiplier, and 2 ** 64, 2 ** 33 and 2 ** 31.
MULTIPLIER, WHOLE, UPPER, SPAN = 2862933555777941757, 1 << 64, 1 << 33, 1 << 31


def jump(key: Column, shards: int) -> Column:
    """Shard (0 to shards - 1, int) of a bigint key, read as 64 unsigned bits; null for null.

    The paper's loop as a fold over ``shards`` steps, of which those after its end do nothing.
    The generator's state is a decimal, as 64-bit products would overflow.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    state = F.when(key < 0, key.cast("decimal(20,0)") + F.lit(str(WHOLE)).cast("decimal(20,0)")).otherwise(key.cast("decimal(20,0)")).cast("decimal(20,0)")

    def step(s, _):
        k = ((s["k"] * F.lit(str(MULTIPLIER)).cast("decimal(19,0)") + F.lit(1)) % F.lit(str(WHOLE)).cast("decimal(20,0)")).cast("decimal(20,0)")
        upper = F.floor(k / F.lit(str(UPPER)).cast("decimal(11,0)")).cast("double")
        to = ((s["j"] + 1).cast("double") * (F.lit(float(SPAN)) / (upper + 1))).cast("long")
        return F.when(s["j"] < shards, F.struct(s["j"].alias("b"), to.alias("j"), k.alias("k"))).otherwise(s)

    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), state.alias("k"))
    return F.when(key.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int")))


def stable_key(df: DataFrame, column: str) -> Column:
    """A whole-number column itself; of another type, the 64-bit hash of its text."""
    kind = dict(df.dtypes)[column]
    return F.col(f"`{column}`").cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(F.col(f"`{column}`").cast("string"))


def assign(df: DataFrame, key: str = "doc_id", shards: int = 8) -> DataFrame:
    """df with ``shard`` and ``grown_shard`` (with one more shard); with underscores added where df has the name.

    A null key goes where key 0 goes; equal keys, of repeated rows too, go together. Texts play no
    part. An empty table gives an empty result.
    """
    at = F.coalesce(stable_key(df, key), F.lit(0).cast("long"))
    return df.withColumns({free_name(df, "shard"): jump(at, shards), free_name(df, "grown_shard"): jump(at, shards + 1)})


def slots(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """rows with ``slot`` (with underscores added where rows has it): 0, 1, ... without a gap in each shard.

    Rows are numbered within their task's part of a shard, and each part starts where the ones
    before it end; so no task sees a whole shard, however hot. The parts' sizes, a row for each
    task and shard, are summed by shard. Narrow tables only: the numbering is kept once, in the
    shared folder. Repeated rows get a slot each. An empty table gives an empty result.
    """
    at, part, many, start, within, slot = (free_name(rows, x) for x in ("at", "part", "many", "start", "within", "slot"))
    own, _ = stored(rows.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33)), "slots")
    parts = own.groupBy(part, shard).agg(F.count("*").alias(many))
    before = F.sum(many).over(Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(part, shard, F.coalesce(before, F.lit(0)).alias(start))
    numbered = own.withColumn(within, F.row_number().over(Window.partitionBy(part, shard).orderBy(at)) - 1)
    return numbered.join(starts, [part, shard]).withColumn(slot, F.col(start) + F.col(within)).select(*(F.col(f"`{c}`") for c in [*rows.columns, slot]))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = 8) -> None:
    """df as Parquet under ``path``, a folder shard=N for each shard; its own columns only."""
    placed = df.withColumn("shard", F.coalesce(jump(F.coalesce(stable_key(df, key), F.lit(0).cast("long")), shards), F.lit(0)))
    placed.write.partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have size 1 and the CRC of no bytes, 0."""
    docs = documents(spark, sf_dir).select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    out = slots(assign(docs).withColumn("law", F.lit("key")))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
