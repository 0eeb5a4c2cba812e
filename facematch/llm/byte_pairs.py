"""Byte-level BPE encoding and decoding with a public vocabulary.

The texts of a batch are cut into pretokens; those not met before are encoded together by a pair
occurrence index: each adjacent pair of symbols maps to all places where it occurs, active merge
ranks are taken in ascending order, and each merge updates the lists of the pairs that it makes
and breaks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from facematch.llm.common import documents, free_name, with_columns

#: Fixed: the pattern of byte-level pretokens, with white space as Unicode's property has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pretokens kept encoded in a Python worker, at most this many and of this many bytes in all.
MOST_KEPT, MOST_KEPT_BYTES = 400_000, 48 << 20


def byte_letters() -> dict[str, int]:
    """Letter of the vocabulary file to byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """ids, merge ranks and special tokens of a tokenizers file of a byte-level BPE without normaliser."""

    def __init__(self, source: str):
        spec = json.loads(source)
        letters = byte_letters()
        model, special = spec["model"], spec.get("added_tokens", [])
        self.special = {t["content"]: t["id"] for t in special}
        raw = {x: bytes(map(letters.__getitem__, x)) for x in model["vocab"] if x not in self.special}
        self.ids = {raw[x]: i for x, i in model["vocab"].items() if x in raw}
        self.bytes = {i: x for x, i in self.ids.items()} | {i: x.encode() for x, i in self.special.items()}
        self.start = [self.ids[bytes([b])] for b in range(256)]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[self.ids[raw[a]], self.ids[raw[b]]] = k, self.ids[raw[a] + raw[b]]
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.kept: dict[str, bytes] = {}
        self.kept_bytes = 0

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, as little-endian 32-bit integers, by one pair occurrence index over all pieces."""
        symbols: list[int] = []
        for p in pieces:
            symbols += map(self.start.__getitem__, p.encode())
            symbols.append(-1)  # no pair crosses it
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[tuple[int, int], list[int]] = {}
        for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)):
            if pair in self.rank:
                places.setdefault(pair, []).append(i)
        active = [(self.rank[p][0], p) for p in places]
        heapq.heapify(active)
        while active:
            _, pair = heapq.heappop(active)
            left, right = pair
            made = self.rank[pair][1]
            at = places.pop(pair, ())
            fresh = set()
            for i in sorted(at) if left == right else at:
                if symbols[i] != left or (j := after[i]) >= n or symbols[j] != right:
                    continue  # a merge nearby took one of the two
                symbols[i], symbols[j] = made, -2
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    new = made, symbols[k]
                    if new in self.rank:
                        if new not in places:
                            places[new] = []
                            fresh.add(new)
                        places[new].append(i)
                if (h := before[i]) >= 0:
                    new = symbols[h], made
                    if new in self.rank:
                        if new not in places:
                            places[new] = []
                            fresh.add(new)
                        places[new].append(h)
            for new in fresh:
                heapq.heappush(active, (self.rank[new][0], new))
        ids = np.array(symbols, np.int32)
        ids = ids[ids != -2]
        ends = np.flatnonzero(ids == -1)
        out, at = [], 0
        for e in ends.tolist():
            out.append(ids[at:e].astype("<u4").tobytes())
            at = e + 1
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        cut = []
        for text in texts:
            parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
            cut.append([p if p in self.special else self.pattern.findall(p) for p in parts if p])
        new = {p for parts in cut for x in parts if isinstance(x, list) for p in x} - self.kept.keys()
        if new:
            if len(self.kept) + len(new) > MOST_KEPT or self.kept_bytes > MOST_KEPT_BYTES:
                self.kept, self.kept_bytes = {}, 0
                new = {p for parts in cut for x in parts if isinstance(x, list) for p in x}
            order = sorted(new)
            at = 0
            while at < len(order):  # about a million bytes in one index
                size, end = 0, at
                while end < len(order) and (size < 1 << 20 or end == at):
                    size += len(order[end])
                    end += 1
                made = self.encode_pieces(order[at:end])
                self.kept.update(zip(order[at:end], made, strict=True))
                self.kept_bytes += sum(map(len, made)) + size
                at = end
        kept = self.kept
        return [b"".join([np.uint32(self.special[x]).tobytes() if isinstance(x, str) else b"".join(map(kept.__getitem__, x)) for x in parts]) for parts in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def vocabulary(source: str) -> Vocabulary:
    return Vocabulary(source)


def _source(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the column ``ids`` (array of int; with underscores added where df has the name): the
    tokens of the text, by the vocabulary file at ``path``.

    Null and empty texts have no tokens. The strings of special tokens become their ids. Repeated
    rows are encoded each; very long texts whole. An empty table gives an empty result. The file, a
    few MB whatever the input, is read by the driver and broadcast.
    """
    sent = df.sparkSession.sparkContext.broadcast(_source(path))

    def work(texts):
        made = vocabulary(sent.value).encode_batch([(x or b"").decode() for x in texts])
        flat = np.frombuffer(b"".join(made), "<u4").astype(np.int32)
        offsets = np.cumsum([0, *(len(x) // 4 for x in made)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]

    return with_columns(df, text, work, [(free_name(df, ids), T.ArrayType(T.IntegerType()))])


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the column ``text`` (with underscores added where df has the name): the text of the
    tokens in ``ids``; null for null. An empty table gives an empty result."""
    sent = df.sparkSession.sparkContext.broadcast(_source(path))
    text = free_name(df, text)
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])

    def run(batches):
        for batch in batches:
            v = vocabulary(sent.value)
            made = [None if x is None else v.decode(np.array(x, "<u4").tobytes()) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, text])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, path: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of each row's text, beside doc_id: both ways at once, so no tokens leave the task."""
    sent = df.sparkSession.sparkContext.broadcast(_source(path))

    def work(texts):
        v = vocabulary(sent.value)
        made = v.encode_batch([(x or b"").decode() for x in texts])
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return [pa.array([len(x) // 4 for x in made], pa.int64()), pa.array(map(sha, made), pa.string()), pa.array([sha(v.decode(x).encode()) for x in made], pa.string())]

    out = with_columns(df.select("doc_id", "text"), "text", work, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())])
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_byte_pairs(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; a null text counts as empty.

    path: the vocabulary file, byte_bpe_50k.json of the public tokenizers where none is given."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return digests(documents(spark, sf_dir), path)
