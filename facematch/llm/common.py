"""Shared pieces of the training-data operators."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facematch.shared import shared_dir

#: White space that parts words, as bytes.split() has it: 0x20 and 0x09 to 0x0D.
SPACES = b" \t\n\r\x0b\x0c"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of df has it (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, what: str, codec: str = "zstd", **options: str) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read again, and its path for ``dropped``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).options(**options).parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes what ``stored`` wrote, when nothing will read it again."""
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """Tables kept in the shared folder while a job runs; leaving the ``with`` block deletes those that ``keep`` wrote.

    Lost executors lose none of them, and they cut the lineage. Shuffle files of plans that are done
    with go when the driver's garbage is collected, which ``swept`` asks for.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*(df for df, _ in list(self.kept.values())))
        self.swept()

    def keep(self, df: DataFrame, what: str = "table", **options: str) -> DataFrame:
        """df, computed once; until the block ends or ``drop`` is told of it. options: of the Parquet writer."""
        out, path = stored(df, what, **options)
        self.kept[id(out)] = out, path  # held, so that no other table gets its id
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            dropped(self.spark, self.kept.pop(id(df))[1])

    def swept(self) -> None:
        """Lets Spark delete the shuffle files of plans that are done with, after a large table was kept."""
        for _ in range(2):  # what the first one finds may free more
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.2)

    def result(self, df: DataFrame, what: str = "result") -> DataFrame:
        """df, computed once, to stay when the block ends; it goes when the driver ends."""
        return stored(df, what)[0]


#: Bits of the filter of ``parted``: 2 MB of them are broadcast, whatever the input.
FILTER = 1 << 24


def parted(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose ``key`` (bigint) may be among keys (one column of bigint), and those whose key is not, or null.

    A filter of FILTER bits tells them apart, so that rows without a partner are spared the shuffle of
    a join. Once many keys fill the bits it spares nothing more; what comes of the join is the same.
    """
    name = keys.columns[0]
    word, bit = free_name(df, "word"), free_name(df, "bits")

    def spot(c):
        return F.expr(f"cast(pmod(`{c}`, {FILTER}) div 64 as int)"), F.expr(f"shiftleft(1L, cast(pmod(`{c}`, {FILTER}) % 64 as int))")

    w, b = spot(name)
    bits = keys.where(F.col(name).isNotNull()).select(w.alias(word), b.alias(bit)).groupBy(word).agg(F.bit_or(bit).alias(bit))  # FILTER / 64 rows at most
    w, b = spot(key)
    told = df.withColumn(word, w).join(F.broadcast(bits), word, "left").withColumn(bit, F.coalesce(F.col(bit).bitwiseAND(b) != 0, F.lit(False)))
    own = [F.col(f"`{c}`") for c in df.columns]
    return told.where(F.col(bit)).select(*own), told.where(~F.col(bit)).select(*own)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32(doc_id as text) mod folds is fold; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that ``column`` of each has about ``most`` bytes at most, or one row."""
    for batch in batches:
        n, at = batch.num_rows, 0
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        held = 0
        for i, size in enumerate(sizes):
            if held + size > most and i > at:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += size
        yield batch.slice(at, n - at)


def with_columns(df: DataFrame, column: str, work, fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """df with the columns ``fields`` that ``work(list of bytes or None) -> list of Arrow arrays`` makes of ``column``.

    Other columns pass through Arrow as they are; only ``column`` is read as Python objects.
    """
    names = [x for x, _ in fields]
    schema = T.StructType([*df.schema.fields, *(T.StructField(x, kind, True) for x, kind in fields)])

    def run(batches):
        for batch in slices(batches, column):
            texts = batch.column(column).cast(pa.binary()).to_pylist()
            made = work(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


#: Edges of which one task finds the groups, without a shuffle; more are dealt out.
FEW = 1 << 16


def components(edges: DataFrame, kept: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the edges (u, v): root is the least node of its connected component.

    Large-star and small-star rounds (Kiveris et al. 2014), each a min by node and a join; a stored
    table ends each round and replaces that of the round before. The result is kept in ``kept``. No
    group is gathered; hubs are combined before the shuffle, and adaptive execution splits a hub's
    rows in the join. FEW edges or fewer stay in one task, as a round's stages and tasks cost the driver
    more than such a round does. No edges: no rows.
    """

    def signature(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())

    def star(both, few):
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.join(least.hint("merge"), "u").coalesce(1) if few else both.join(least, "u")

    with Scratch(edges.sparkSession) as scratch:
        now = scratch.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        before = signature(now)
        for _ in range(most_rounds):
            if not before[0]:
                break
            few = before[0] <= FEW
            dealt = now.coalesce(1) if few else now
            both = dealt.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
            large = star(both, few).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            small = star(large, few)  # in it v < u
            after = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
            after = after.where("u <> v")
            old, now = now, scratch.keep((after.coalesce(1) if few else after).distinct(), "edges")
            scratch.drop(old)
            mark = signature(now)
            if mark == before:
                break
            before = mark
        else:
            raise RuntimeError("components did not settle")
        own = now.select(F.col("v").alias("node"), F.col("v").alias("root"))
        return kept.keep(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(own).distinct(), "components")
