"""Near-duplicate documents by SimHash, with Golay-code keys.

A 64-bit fingerprint is three segments of 23, 23 and 18 bits. The perfect (23, 12) Golay code has
one codeword within 3 bits of any 23-bit word; a segment's keys are the indices of the codewords
within 4 bits: one, or six where the nearest is 3 bits off. So of two segments at most one bit
apart, either one's nearest codeword is among the other's keys; segments two bits apart share a key.

Fingerprints at most 4 bits apart have two segments at most 1 bit apart each, or one equal
segment and 2 bits in either other. The first kind meet on (nearest of a, key of b) against
(key of a, nearest of b); the second on the equal segment and a key of the next. A join on these
keys finds all of them, and bit_count of the difference verifies each pair.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facematch.llm.common import Scratch, components, documents, free_name, parted, slices

BITS, SHINGLE, SEED, GENERATOR = 4, 4, 42, 0b101011100011
_LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))
_SEGMENTS = ((0, 23), (23, 23), (46, 18))


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of a text (null: empty): a bit is 1 if it is set in over half of the hashes
    of its shingles; zero without words. Long texts are summed in blocks."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    whole, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    ends = ends[SHINGLE - 1 :].tolist()
    h, ones, step = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 1 << 15
    for at in range(0, n, step):
        block = np.array([h(whole[a:b], SEED) for a, b in zip(starts[at : at + step], ends[at : at + step], strict=True)], "<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of docs but text, and fp (long), of each row of docs (doc_id, text)."""
    kept = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in slices(batches, "text"):
            made = np.array([fingerprint(x) for x in batch.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(made.view(np.int64))], names=[*kept, "fp"])

    return docs.select(*kept, "text").mapInArrow(run, schema)


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome (2048): the error patterns of weight 4 at most that lead to a codeword, six of
    them (the lightest first, it alone repeated where it weighs under 3); and the syndrome of each
    23-bit word, in two tables of its lower 12 and upper 11 bits."""

    def syndrome(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    unit = [syndrome(1 << i) for i in range(23)]
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for i in range(12):
        low[np.arange(1 << 12) >> i & 1 == 1] ^= unit[i]
    for i in range(11):
        high[np.arange(1 << 11) >> i & 1 == 1] ^= unit[12 + i]
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= unit[b]
            found[s].append(sum(1 << b for b in bits))
    patterns = np.array([(x + x[:1] * 6)[:6] for x in found], np.int64)
    return patterns, np.concatenate([low, high])


def codewords(x: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within 4 bits of each 23-bit word; the nearest first, six columns."""
    patterns, tables = golay()
    s = tables[x & 0xFFF] ^ tables[(1 << 12) + (x >> 12)]
    return (x[:, None] ^ patterns[s]) >> 11  # the code is systematic: its upper 12 bits tell a codeword


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, side, key) of all keys; side 0 meets side 1, and side 2 itself. A key's upper bits tell its table."""
    u = fp.view(np.uint64)
    seg = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in _SEGMENTS]
    code = [codewords(x) for x in seg]
    rows, sides, out = [], [], []
    every = np.arange(len(fp))

    def put(side, key):
        key = key.reshape(len(fp), -1)
        rows.append(np.repeat(every, key.shape[1]))
        sides.append(np.full(key.size, side, np.int8))
        out.append(key.ravel())

    for table, (a, b) in enumerate(combinations(range(3), 2)):
        put(0, np.int64(table) << 40 | code[a][:, :1] << 12 | code[b])
        put(1, np.int64(table) << 40 | code[a] << 12 | code[b][:, :1])
    for a in range(3):
        put(2, np.int64(8 + a) << 40 | seg[a][:, None] << 12 | code[(a + 1) % 3])
    row, side, key = map(np.concatenate, (rows, sides, out))
    order = np.lexsort((side, key, row))
    row, side, key = row[order], side[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (side[1:] != side[:-1])
    return row[new], side[new], key[new]


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(u, v), u < v: the pairs of distinct fingerprints in prints (fp) at most ``bits`` (0 to 4) bits apart."""

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for at in range(0, len(fp), 1 << 13):
                own = fp[at : at + (1 << 13)]
                row, side, key = keys(own)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(side), pa.array(own[row])], names=["key", "side", "fp"])

    made = prints.mapInArrow(run, "key long, side byte, fp long")
    left = made.where("side in (0, 2)").select("key", F.col("fp").alias("u"))
    right = made.where("side in (1, 2)").select(F.col("key").alias("k"), F.col("fp").alias("v"))
    near = (F.col("key") == F.col("k")) & (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)
    # Spark takes the keys to be no larger than the prints they are made of, 54 times as few, and would broadcast them.
    return left.join(right.hint("merge"), near).select("u", "v").distinct()


def groups(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, fp and component_id of each row of docs (doc_id, text).

    component_id is the least doc_id that links of at most ``bits`` bits reach, the row's own
    included. Null and empty texts and texts of white space have fingerprint zero and link like
    any other. Rows with a null doc_id link and get a component_id, but never are one (null if
    no row of the group has an id). Repeated rows get a row each. An empty table gives an empty
    result. Equal fingerprints, a third of all rows perhaps, are one node: they are combined
    before the shuffle, and no pairs are made of them.
    """
    with Scratch(docs.sparkSession) as scratch:
        prints = scratch.result(fingerprints(docs.select("doc_id", "text")), "prints")
        return prints.join(_known(prints, scratch, bits).drop("root"), "fp")


def _known(prints: DataFrame, scratch: Scratch, bits: int = BITS) -> DataFrame:
    """fp, root (a fingerprint that stands for its group) and component_id of each fingerprint of prints (doc_id, fp)."""
    nodes = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "print-nodes")
    roots = components(links(nodes.select("fp"), bits), scratch)
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return scratch.result(named.join(least, "root").select("fp", "root", "component_id"), "print-groups")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document; see ``groups`` for null, empty and repeated rows."""
    out = groups(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the least doc_id, of those the least fingerprint and hash of the row. Rows without a doc_id stay.

    Which row stays is settled on narrow columns; only texts that may go are shuffled.
    """
    mark = free_name(docs, "row")
    marked = docs.withColumn(mark, F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    with Scratch(spark) as scratch:
        prints = scratch.keep(fingerprints(marked.select("doc_id", F.col(mark).alias("row"), "text")).where("doc_id is not null"), "prints")
        found = prints.join(_known(prints, scratch), "fp")
        keep = found.groupBy("root").agg(F.min(F.struct("doc_id", "fp", "row")).alias("x")).select("x.doc_id", "x.row", F.lit(True).alias("kept")).distinct()
        rows = scratch.keep(prints.groupBy("doc_id", "row").agg(F.count("*").alias("n")).join(keep, ["doc_id", "row"], "left"), "print-rows")
        kept = scratch.result(rows.where("kept").select("doc_id", F.col("row").alias(mark)), "kept-rows")
        others = scratch.result(rows.where("kept is null or n > 1").select("row"), "other-rows")
    some, rest = parted(marked.where("doc_id is not null"), mark, others)
    some = some.join(kept, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    return rest.unionByName(some).drop(mark).unionByName(docs.where("doc_id is null"))
