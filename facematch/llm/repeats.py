"""Removal of repeated byte strings by a distributed suffix array.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document of
smaller id, or earlier in the same one. Strings don't cross documents.

Equal strings must meet to be compared, and most strings have no equal. So each string of LENGTH
bytes (a window) is filed under its anchor, the GRAM bytes in it that hash least: equal windows
have equal anchors at the same offset, and neighbouring windows mostly share theirs. Then:

1. documents are packed into chunks, a few MB of compressed rows each, kept in the shared folder;
2. anchors' hashes, once for each chunk, are dealt by hash; those met twice go back to the chunks;
   documents whose whole text has the 16-byte BLAKE2 digest of an earlier one are found by a join;
3. each chunk marks those copies as removed whole, without regions; of its other documents it cuts
   out the regions of such anchors (the bytes of all windows of one anchor);
   a region that equals one before it in its chunk is removed whole;
4. regions are dealt by anchor; those equal to an earlier one are removed whole, and over the
   others of a bucket a suffix array is built by the difference-cover algorithm, locally in one task;
   of neighbours in it whose
   first LENGTH bytes are equal, all but the earliest are removed;
5. the removed runs go back to the chunks and are cut out.

No step drops or caps anything: windows whose anchor's hash is met once have no equal. No task
holds more than a chunk, a bucket of hashes, or a bucket of regions; a passage in very many
documents comes once from each chunk, and once from each ``FAN`` chunks after a round of merging.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facematch.llm.common import documents, slices, stored
from facematch.llm.suffix_array import equal_neighbours, suffix_array

LENGTH, GRAM = 100, 32
#: Bytes of text in a chunk; of text for a bucket of hashes and of regions; windows hashed at once; symbols in one suffix array.
CHUNK, HASHED, DEALT, BLOCK, MOST = 2 << 20, 24 << 20, 2 << 20, 1 << 17, 3 << 20
FAN = 4096
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(23))
_LOW = np.uint64((1 << 24) - 1)
#: What of a hash is sent to find those met twice: 39 bits and, above them, whether a chunk has it twice.
_SENT = np.uint64((1 << 39) - 1)


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hashes of all strings of GRAM (a power of 2) bytes of x."""
    h, power, n = _BYTES[x], _M1, 1
    with np.errstate(over="ignore"):
        while n < GRAM:
            h = h[:-n] * power + h[n:]
            power = power * power
            n *= 2
        h ^= h >> np.uint64(30)
        h *= _M2
        h ^= h >> np.uint64(27)
        h *= _M1
    return h


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """first, last, anchor (places in data) and hash: the runs of neighbouring windows of one document that share an anchor."""
    ok = np.zeros(len(data), bool)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a >= length:
            ok[a : b - length + 1] = True
    reach, out = length - GRAM + 1, []
    for a in range(0, max(0, len(data) - length + 1), BLOCK):
        good = ok[a : min(a + BLOCK, len(data) - length + 1)]
        if not good.any():
            continue
        h = gram_hashes(data[a : a + len(good) + length - 1])
        least = h & ~_LOW | np.arange(len(h), dtype=np.uint64)
        n = 1
        while 2 * n <= reach:
            least = np.minimum(least[:-n], least[n:])
            n *= 2
        if reach > n:
            least = np.minimum(least[: len(good)], least[reach - n : reach - n + len(good)])
        at = (least[: len(good)] & _LOW).astype(np.int64)
        new = good.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~good[:-1]
        end = good.copy()
        end[:-1] &= (at[1:] != at[:-1]) | ~good[1:]
        first, last = np.flatnonzero(new), np.flatnonzero(end)
        out.append((first + a, last + a, at[first] + a, h[at[first]]))
        del h, least
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    return tuple(map(np.concatenate, zip(*out, strict=True)))


class Chunk:
    """Rows of a chunk, read from its blob: their Arrow table, and ids, texts and places of the texts."""

    def __init__(self, blob: bytes, text: str):
        with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)) as reader:
            self.table = reader.read_all().combine_chunks()
        self.texts = [x or b"" for x in self.table[text].cast(pa.large_binary()).to_pylist()]
        self.ids = np.array([(1 << 63) - 1 if x is None else x for x in self.table["doc_id"].to_pylist()], np.int64)
        self.ends = np.cumsum(np.array(list(map(len, self.texts)), np.int64)) if self.texts else np.zeros(0, np.int64)
        self.starts = self.ends - np.array(list(map(len, self.texts)), np.int64)
        self.raw = b"".join(self.texts)
        self.data = np.frombuffer(self.raw, np.uint8)


def chunked(docs: DataFrame, text: str, most: int = CHUNK) -> DataFrame:
    """(chunk, n_bytes, rows, digests): the rows of docs in chunks of about ``most`` bytes of text, or one row."""

    def run(batches: Iterator[pa.RecordBatch]):
        part, number = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []

        def row():
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            texts = [x or b"" for x in table[text].cast(pa.large_binary()).to_pylist()]
            digests = b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in texts)
            return pa.RecordBatch.from_arrays([pa.array([part + number], pa.int64()), pa.array([sum(map(len, texts))], pa.int64()), pa.array([zstandard.ZstdCompressor(level=3).compress(sink.getvalue())], pa.binary()), pa.array([digests], pa.binary()), pa.array([[None if x is None else int(x) for x in table["doc_id"].to_pylist()]], pa.list_(pa.int64()))], names=["chunk", "n_bytes", "rows", "digests", "ids"])

        size = 0
        for batch in slices(batches, text, most):
            more = pc.sum(pc.binary_length(batch.column(text))).as_py() or 0
            if held and size + more > most:
                yield row()
                number, held, size = number + 1, [], 0
            held.append(batch)
            size += more
        if held:
            yield row()

    return docs.mapInArrow(run, "chunk long, n_bytes long, rows binary, digests binary, ids array<long>")


def copies(corpus: DataFrame) -> DataFrame:
    """(chunk, kind, blob): for each chunk the numbers (int32) of its rows whose whole text comes earlier; kind 1."""

    def spread(batches):
        for batch in batches:
            for chunk, digests, ids in zip(batch.column("chunk").to_pylist(), batch.column("digests").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([digests[16 * i : 16 * i + 16] for i in range(n)], pa.binary()), pa.array([(1 << 63) - 1 if x is None else x for x in ids], pa.int64()), pa.array([chunk] * n, pa.int64()), pa.array(range(n), pa.int32())], names=["digest", "id", "chunk", "row"])

    rows = corpus.select("chunk", "digests", "ids").mapInArrow(spread, "digest binary, id long, chunk long, row int")
    first = rows.groupBy("digest").agg(F.min(F.struct("id", "chunk", "row")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = rows.join(first, "digest").where((F.col("first.chunk") != F.col("chunk")) | (F.col("first.row") != F.col("row")))
    return later.groupBy("chunk").agg(F.collect_list("row").alias("rows"))  # as many as a chunk has rows


def met_twice(corpus: DataFrame, text: str, buckets: int) -> DataFrame:
    """(chunk, blob): for each chunk the sent part of the hashes (five bytes each) that this chunk has and that are met twice in all."""
    kinds = "bucket int, chunk long, blob binary"

    def send(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                c = Chunk(blob, text)
                h = np.sort(anchors(c.data, c.starts, c.ends)[3])
                own = np.ones(len(h), bool)
                own[1:] = h[1:] != h[:-1]
                twice = np.zeros(len(h), bool)
                twice[:-1] = ~own[1:]
                h, twice = h[own], twice[own]
                bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
                sent = (h & _SENT) | (twice.astype(np.uint64) << np.uint64(39))
                order = np.argsort(bucket, kind="stable")
                raw = sent[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array([raw[cuts[b] : cuts[b + 1]].tobytes() for b in some], pa.binary())], names=["bucket", "chunk", "blob"])

    def meet(table: pa.Table) -> pa.Table:
        blobs = table["blob"].to_pylist()
        n = [len(x) // 5 for x in blobs]
        h = np.zeros((sum(n), 8), np.uint8)
        h[:, :5] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
        h = h.view("<u8").ravel()
        keys, twice = h & _SENT, h > _SENT
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        same = s[1:] == s[:-1]
        many = np.zeros(len(h), bool)
        many[order[1:][same]] = True
        many[order[:-1][same]] = True
        many |= twice
        cuts, out = np.cumsum([0, *n]), []
        raw = keys.view(np.uint8).reshape(-1, 8)[:, :5]
        for i in range(len(n)):
            part = slice(cuts[i], cuts[i + 1])
            out.append(raw[part][many[part]].tobytes())
        return pa.table({"chunk": table["chunk"], "blob": pa.array(out, pa.binary())})

    return corpus.select("chunk", "rows").mapInArrow(send, kinds).groupBy("bucket").applyInArrow(meet, "chunk long, blob binary")


#: A region: hash of its anchor, id, chunk and row of its document, its place there, the anchor's offset in it, its length.
REGION = np.dtype([("hash", "<u8"), ("id", "<i8"), ("chunk", "<i8"), ("row", "<i4"), ("at", "<i8"), ("offset", "<u2"), ("size", "<u4")])
#: A removed run of a document's bytes.
RUN = np.dtype([("chunk", "<i8"), ("row", "<i4"), ("at", "<i8"), ("end", "<i8")])
OUT = "bucket long, chunk long, kind int, blob binary"


def _pack(regions: np.ndarray, texts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(len(regions).to_bytes(8, "little") + regions.tobytes() + b"".join(texts))


def _unpack(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    regions = np.frombuffer(raw, REGION, n, 8)
    ends = (8 + n * REGION.itemsize + np.cumsum(regions["size"].astype(np.int64))).tolist()
    return regions, [raw[b - a : b] for a, b in zip(regions["size"].tolist(), ends, strict=True)]


def _runs(out: list[tuple[int, bytes]], runs: np.ndarray) -> None:
    """Adds the blobs of runs by chunk."""
    runs = runs[np.lexsort((runs["at"], runs["row"], runs["chunk"]))]
    for part in np.split(runs, np.flatnonzero(np.diff(runs["chunk"])) + 1):
        if len(part):
            out.append((int(part["chunk"][0]), part.tobytes()))


def collapse(regions: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which regions are the earliest of those equal to them, and the runs of the others, which are removed whole."""
    order = np.lexsort((regions["at"], regions["row"], regions["chunk"], regions["id"]))
    seen: set[tuple[int, bytes]] = set()
    keep = np.zeros(len(regions), bool)
    offsets = regions["offset"].tolist()
    for i in order.tolist():
        key = offsets[i], texts[i]
        if key not in seen:
            seen.add(key)
            keep[i] = True
    gone = regions[~keep]
    runs = np.zeros(len(gone), RUN)
    for name in ("chunk", "row", "at"):
        runs[name] = gone[name]
    runs["end"] = gone["at"] + gone["size"]
    return keep, runs


def compare(regions: np.ndarray, texts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """The runs of all windows of distinct regions that equal an earlier window, by the suffix array of the regions' text."""
    raw = b"\0".join(texts) + bytes(length)
    data = np.frombuffer(raw, np.uint8)
    sizes = regions["size"].astype(np.int64)
    start = np.cumsum(sizes + 1) - sizes - 1
    symbols = data[: len(raw) - length + 1].astype(np.int64) + 2
    symbols[start[1:] - 1] = 1
    symbols[-1] = 1
    window = np.zeros(len(symbols) + 1, np.int32)
    np.add.at(window, start, 1)
    np.add.at(window, start + sizes - length + 1, -1)
    window = np.cumsum(window)[:-1] > 0
    order = suffix_array(symbols)
    order = order[window[order]]
    same = equal_neighbours(data, order, length)
    member = np.zeros(len(order), bool)
    member[1:] |= same
    member[:-1] |= same
    group = np.cumsum(np.concatenate([[True], ~same]))[: len(order)][member]
    place = order[member]
    region = np.searchsorted(start, place, "right") - 1
    at = regions["at"][region] + place - start[region]
    rank = np.lexsort((at, regions["row"][region], regions["chunk"][region], regions["id"][region], group))
    later = np.zeros(len(place), bool)
    later[rank[1:]] = group[rank[1:]] == group[rank[:-1]]
    place = np.sort(place[later])
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1] + 1  # windows of two regions are never neighbours
    begin, end = place[first], place[np.concatenate([first[1:], [True]]) if len(place) else first]
    region = np.searchsorted(start, begin, "right") - 1
    runs = np.zeros(len(begin), RUN)
    runs["chunk"], runs["row"] = regions["chunk"][region], regions["row"][region]
    runs["at"] = regions["at"][region] + begin - start[region]
    runs["end"] = regions["at"][region] + end - start[region] + length
    return runs


def removed_runs(corpus: DataFrame, text: str, total: int, chunks: int, fan: int = FAN) -> DataFrame:
    """(chunk, blob): the removed runs of each chunk's documents, in blobs of RUN; runs may overlap."""
    twice = met_twice(corpus, text, max(1, -(-total // HASHED)))
    marks = twice.select("chunk", F.lit(0).alias("kind"), "blob", F.lit(None).cast("array<int>").alias("doubles")).union(copies(corpus).select("chunk", F.lit(1), F.lit(None).cast("binary"), "rows"))
    buckets = max(1, -(-total // DEALT))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, bytes]] = []
        for chunk, blob in zip(left["chunk"].to_pylist(), left["rows"].to_pylist(), strict=True):
            c = Chunk(blob, text)
            doubles = [r for rows in right["doubles"].to_pylist() if rows for r in rows]
            single = np.ones(len(c.ids), bool)
            single[doubles] = False
            whole = np.array([r for r in doubles if c.ends[r] - c.starts[r] >= LENGTH], np.int64)
            runs = np.zeros(len(whole), RUN)
            runs["chunk"], runs["row"], runs["end"] = chunk, whole, (c.ends - c.starts)[whole]
            raw = np.zeros((sum(len(x) // 5 for x in right["blob"].to_pylist() if x), 8), np.uint8)
            raw[:, :5] = np.frombuffer(b"".join(x for x in right["blob"].to_pylist() if x), np.uint8).reshape(-1, 5)
            known = np.sort(raw.view("<u8").ravel())
            first, last, at, h = anchors(c.data, c.starts[single], c.ends[single])
            spot = np.searchsorted(known, h & _SENT)
            hit = known[np.minimum(spot, len(known) - 1)] == (h & _SENT) if len(known) else np.zeros(len(h), bool)
            first, last, at, h = first[hit], last[hit], at[hit], h[hit]
            # Empty texts begin where others do; the last that begins at or before a place holds it.
            row = np.searchsorted(c.starts, first, "right") - 1
            regions = np.zeros(len(first), REGION)
            regions["hash"], regions["id"], regions["chunk"], regions["row"] = h, c.ids[row], chunk, row
            regions["at"], regions["offset"], regions["size"] = first - c.starts[row], at - first, last - first + LENGTH
            texts = [c.raw[a : b + LENGTH] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            keep, more = collapse(regions, texts)
            made: list[tuple[int, bytes]] = []
            _runs(made, np.concatenate([runs, more]))
            out += [(k % buckets, k, 1, x) for k, x in made]
            kept = np.flatnonzero(keep)
            bucket = ((regions["hash"][kept] * _M2 >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(part):
                    out.append((int(bucket[part[0]]), chunk, 0, _pack(regions[kept[part]], [texts[i] for i in kept[part]])))
        return table(out)

    def table(out):
        return pa.table([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["bucket", "chunk", "kind", "blob"])

    def gather(t: pa.Table) -> tuple[np.ndarray, list[bytes], list[tuple[int, bytes]]]:
        regions, texts, out = [np.zeros(0, REGION)], [], []
        for chunk, kind, blob in zip(t["chunk"].to_pylist(), t["kind"].to_pylist(), t["blob"].to_pylist(), strict=True):
            if kind:
                out.append((chunk, blob))
            else:
                own, more = _unpack(blob)
                regions.append(own)
                texts += more
        every = np.concatenate(regions)
        keep, runs = collapse(every, texts)
        _runs(out, runs)
        kept = np.flatnonzero(keep)
        return every[kept], [texts[i] for i in kept], out

    def merge(t: pa.Table) -> pa.Table:
        regions, texts, runs = gather(t)
        bucket, chunk = t["bucket"][0].as_py(), t["chunk"][0].as_py()
        return table([(bucket, k, 1, x) for k, x in runs] + ([(bucket, chunk, 0, _pack(regions, texts))] if len(texts) else []))

    def settle(t: pa.Table) -> pa.Table:
        regions, texts, out = gather(t)
        order = np.argsort(regions["hash"], kind="stable")
        regions, texts = regions[order], [texts[i] for i in order]
        # Equal windows have equal anchors, so the array may be built anchor by anchor, and is for about MOST symbols at once.
        at, sizes, hashes = 0, regions["size"].tolist(), regions["hash"].tolist()
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (held < MOST or hashes[end] == hashes[end - 1]):
                held += sizes[end] + 1
                end += 1
            _runs(out, compare(regions[at:end], texts[at:end]))
            at = end
        return pa.table({"chunk": pa.array([k for k, _ in out], pa.int64()), "blob": pa.array([x for _, x in out], pa.binary())})

    regions = corpus.select("chunk", "rows").groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(cut, OUT)
    while chunks > fan:
        chunks = -(-chunks // fan)
        regions = regions.groupBy("bucket", F.pmod(F.xxhash64("chunk"), F.lit(chunks)).alias("some")).applyInArrow(lambda t: merge(t), OUT)
    return regions.groupBy("bucket").applyInArrow(settle, "chunk long, blob binary")


def spans_of(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that runs (of one row) cover."""
    order = np.argsort(runs["at"], kind="stable")
    at, end = runs["at"][order], np.maximum.accumulate(runs["end"][order])
    new = np.ones(len(at), bool)
    new[1:] = at[1:] > end[:-1]
    last = np.ones(len(at), bool)
    last[:-1] = new[1:]
    return at[new], end[last]


def dedup(docs: DataFrame, text: str = "text", digest: bool = False) -> DataFrame:
    """docs with ``text`` cut down to the bytes that no repeat covers, in any order of rows.

    With ``digest`` instead doc_id, n_bytes, n_removed, n_spans (long) and kept_sha256 (of the
    bytes left) of each row. In the text, bytes that a cut leaves without their letter go too.

    Null texts count as empty; empty ones and those under LENGTH bytes stay as they are (null as
    null). Rows with a null doc_id come after all others; rows of equal doc_id are documents of
    their own, in the order of the chunks that hold them. An empty table gives an empty result.
    Other columns pass through as they are, whatever their names. doc_id must be a whole number, as
    ids are ordered; another type is a TypeError.
    """
    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("doc_id must be a whole number")
    if digest:
        docs = docs.select("doc_id", text)
    corpus, _ = stored(chunked(docs, text), "chunks", "uncompressed")
    total, chunks = corpus.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    runs = removed_runs(corpus, text, total, chunks)
    kinds = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())]) if digest else docs.schema

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        blobs = left["rows"].to_pylist()
        own = np.frombuffer(b"".join(right["blob"].to_pylist()), RUN)
        own = own[np.argsort(own["row"], kind="stable")]
        made = []
        for blob in blobs:  # one
            c = Chunk(blob, text)
            at = np.searchsorted(own["row"], np.arange(len(c.ids) + 1))
            rows = []
            for i, x in enumerate(c.texts):
                starts, ends = spans_of(own[at[i] : at[i + 1]])
                left_over, old = [], 0
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    left_over.append(x[old:a])
                    old = b
                left_over.append(x[old:])
                rows.append((b"".join(left_over) if old else x, len(starts)))
            if digest:
                n = [len(x) for x in c.texts]
                columns = {"doc_id": c.table["doc_id"], "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array([a - len(x) for a, (x, _) in zip(n, rows, strict=True)], pa.int64()), "n_spans": pa.array([k for _, k in rows], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x, _ in rows], pa.string())}
                made.append(pa.table(columns))
            else:
                kept = [None if old is None else x.decode("utf-8", "ignore") for old, (x, _) in zip(c.table[text].to_pylist(), rows, strict=True)]
                where = c.table.schema.get_field_index(text)
                made.append(c.table.set_column(where, c.table.schema.field(where), pa.array(kept, c.table.schema.field(where).type)))
        return pa.concat_tables(made) if made else pa.table({f.name: pa.array([], _arrow(f.dataType)) for f in kinds})

    return corpus.select("chunk", "rows").groupBy("chunk").cogroup(runs.groupBy("chunk")).applyInArrow(cut, kinds)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document; see ``dedup``."""
    return dedup(documents(spark, sf_dir), digest=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without repeated strings; n_chars is that of the text left."""
    return dedup(docs).withColumn("n_chars", F.length("text").cast("long"))
