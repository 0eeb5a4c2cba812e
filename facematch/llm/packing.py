"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces no longer than the longest permitted length. Pieces go, longest
first, into the open bin that they leave fullest; if none has room, a bin opens whose length is
the cheapest for the piece: a bin costs its length and a fixed overhead, and the piece bears the
share of it that neither it nor the shorter pieces still to come can fill. In the end every bin
is brought down to the least permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facematch.llm.common import documents, stored

CAPACITIES, OVERHEAD, BLOCK = (512, 1024, 2048, 4096), 16, 1 << 15


def pack(lengths: list[int], capacities=CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """bin and offset of each piece, and capacity of each bin. Lengths are 1 to the last capacity.

    Ties: equal pieces in their order; of equally full bins the one opened first; of equally
    cheap lengths the shortest.
    """
    caps = sorted(capacities)
    size = np.array(lengths, np.int64)
    order = np.argsort(-size, kind="stable")
    shortest_first = np.sort(size)
    volume = np.concatenate([[0], np.cumsum(shortest_first)])
    where, offset = [0] * len(lengths), [0] * len(lengths)
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    used: list[int] = []
    for done, i in enumerate(order.tolist()):
        n = lengths[i]
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            # What is left are the pieces after this one: the shortest ones.
            left = len(lengths) - done - 1
            best = None
            for c in caps:
                if c >= n:
                    fill = int(volume[min(left, int(np.searchsorted(shortest_first, c - n, "right")))])
                    cost = (c + overhead) * n / (n + min(c - n, fill))
                    if best is None or cost < best[0]:
                        best = cost, c
            free, b = best[1], len(used)
            used.append(0)
        where[i], offset[i] = b, used[b]
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    return where, offset, [caps[bisect_left(caps, x)] for x in used]


def pieces(lengths: DataFrame, longest: int) -> DataFrame:
    """(doc_id, n_tokens, piece, start, length) of lengths (doc_id, n_tokens): pieces of ``longest`` tokens, the last one shorter."""
    n = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / longest)).cast("int")
    cuts = lengths.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    start = F.col("piece").cast("long") * longest
    return cuts.select("doc_id", "n_tokens", "piece", start.alias("start"), F.least(F.lit(longest), F.col("n_tokens") - start).cast("long").alias("length"))


def best_fit(lengths: DataFrame, capacities=CAPACITIES, overhead: int = OVERHEAD, block: int = BLOCK) -> DataFrame:
    """A row for each piece of lengths (doc_id, n_tokens): doc_id, piece, start, length, block, bin, offset, capacity.

    A bin is named by block and bin; start is the piece's place in its document and offset that in
    its bin. Documents of null or no tokens need no room and have no row. Repeated rows are packed
    each. An empty table gives an empty result.

    Pieces are numbered without a gap (each task's rows after those of the tasks before it) and
    every ``block`` of them in turn are packed by a task of their own, so a block is bounded
    whatever the keys are; only the last bins of a block can be emptier for it.
    """
    caps = sorted({int(c) for c in capacities})
    if not caps or caps[0] < 1:
        raise ValueError("capacities must be positive")
    own, _ = stored(pieces(lengths, caps[-1]).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "pieces")
    parts = own.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each task
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    low = F.col("_at") - F.shiftleft("_part", 33)
    placed = own.join(starts, "_part").withColumn("_at", F.col("_start") + low).withColumn("block", F.floor(F.col("_at") / block))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        where, offset, held = pack(table["length"].to_pylist(), caps, overhead)
        more = {"bin": pa.array(where, pa.int32()), "offset": pa.array(offset, pa.int64()), "capacity": pa.array([held[b] for b in where], pa.int32())}
        for name, values in more.items():
            table = table.append_column(name, values)
        return table.drop_columns(["_at"])

    rows = placed.select("doc_id", "piece", "start", "length", "block", "_at")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.groupBy("block").applyInArrow(run, f"doc_id {kind}, piece int, start long, length long, block long, bin int, offset long, capacity int")


def word_lengths(docs: DataFrame) -> DataFrame:
    """doc_id and n_tokens of docs (doc_id, text): the words of the text and one end mark; null and empty texts have none."""
    words = F.size(F.filter(F.split(F.col("text"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")
    return docs.select("doc_id", F.when(F.length("text") > 0, words + 1).otherwise(0).cast("long").alias("n_tokens"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, block, bin, offset and capacity of every piece of every document; see ``best_fit``."""
    return best_fit(word_lengths(documents(spark, sf_dir)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing of the documents: see ``best_fit``."""
    return best_fit(word_lengths(docs))
