"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facematch.llm.common import documents, held_out, slices

BITS, ORDERS, SMOOTH = 16, (1, 2, 3), 0.5
#: Letters looked at together; a longer text is taken in pieces that overlap by max(ORDERS) - 1.
PIECE = 1 << 16
#: Letters whose grams are looked up at once.
MOST = 1 << 18
_MIX = np.uint32(0x9E3779B1)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and bucket of all character n-grams of the texts' lower case, with white space,
    digits and signs as one blank and a blank at either end; blanks alone make no gram. The texts'
    grams of one order stand together, in the order of the texts."""
    coded = [f" {x.lower()} ".encode("utf-32-le", "replace") for x in texts]
    c = np.frombuffer(b"".join(coded), np.uint32)
    own = np.repeat(np.arange(len(texts)), [len(x) // 4 for x in coded])
    plain = (c < 128) & ~((c >= 97) & (c <= 122)) | (c >= 0x2000) & (c <= 0x206F) | (c >= 0x80) & (c <= 0xBF) & (c != 0xAA) & (c != 0xB5) & (c != 0xBA)
    c = np.where(plain, np.uint32(32), c)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (own[1:] != own[:-1])
    c, own = c[keep], own[keep]
    rows, out, h = [], [], np.zeros(len(c), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] * _MIX + c[n - 1 :]) * _MIX
        if n in ORDERS:
            x = h ^ (h >> np.uint32(15)) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            x = (x * _MIX) >> np.uint32(32 - BITS)
            inside = own[: len(x)] == own[n - 1 :] if n > 1 else c != 32
            rows.append(own[: len(x)][inside])
            out.append(x[inside])
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(out)) if out else (none, none)


def pieces(text: str):
    lap = max(ORDERS) - 1
    for at in range(0, max(1, len(text) - lap), PIECE - lap):
        yield text[at : at + PIECE]


def groups(texts: list[str | None]):
    """Number of the text and piece, in lists of about MOST letters, of the texts that have a letter."""
    held: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        if has_letter(text):
            for p in pieces(text):
                held.append((i, p))
                size += len(p)
                if size >= MOST:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def train(docs: DataFrame, most_langs: int = 256) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and the matrix of log probabilities (languages x 2 ** BITS), from all rows of docs (text, lang).

    Each task counts all its rows in one dense array a language; the sums that reach the driver
    are at most most_langs * 2 ** BITS numbers, however many documents there are. More languages
    than most_langs are an error. Rows without text or lang teach nothing; repeated rows count each.
    """
    docs = docs.select("text", "lang").where("text is not null and lang is not null")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in slices(batches, "text"):
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lang, text in zip(langs, texts, strict=True):
                if has_letter(text):
                    rows[lang] = rows.get(lang, 0) + 1
            if len(rows) > most_langs:
                raise ValueError(f"more than {most_langs} languages")
            for held in groups(texts):
                own, bucket = grams([p for _, p in held])
                of = np.array([langs[i] for i, _ in held])
                for lang in set(of.tolist()):
                    counts = np.bincount(bucket[(of == lang)[own]], minlength=1 << BITS)
                    sums[lang] = sums[lang] + counts if lang in sums else counts
        for lang, x in sums.items():
            used = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(used) + 1)), pa.array([-1, *used.tolist()], pa.int32()), pa.array([rows[lang], *x[used].tolist()], pa.int64())], names=["lang", "bucket", "n"])

    got = docs.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    named = got["lang"].combine_chunks().dictionary_encode()  # numbers instead of a string for each row
    found = named.dictionary.to_pylist()
    langs = sorted(found)
    if len(langs) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    at = np.array([langs.index(x) for x in found], int)
    row, bucket, n = at[named.indices.to_numpy()] if len(found) else np.zeros(0, int), got["bucket"].to_numpy(), got["n"].to_numpy()
    table, prior = np.full((len(langs), 1 << BITS), SMOOTH), np.ones(len(langs))
    own = bucket < 0
    prior[row[own]] += n[own]
    table[row[~own], bucket[~own]] += n[~own]
    return langs, np.log(prior / prior.sum()), np.log(table / table.sum(1, keepdims=True))


def predict(docs: DataFrame, langs: list[str], prior: np.ndarray, table: np.ndarray) -> DataFrame:
    """doc_id, text's lang_pred and score for each row of docs (doc_id, text).

    score is the posterior probability of lang_pred. A text that is null, empty or without a
    letter is "und" with score 0; without any language learned every text is "und". Repeated rows are
    told alike; other columns of docs, whatever their names, are not looked at; very long texts are
    taken in pieces. An empty table gives an empty result. The matrix, bounded as in ``train``, is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast((prior, np.ascontiguousarray(table.T.astype(np.float32))))
    kinds = T.StructType([*docs.select("doc_id").schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        prior, rows = sent.value
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            sums, told = np.tile(prior, (len(texts), 1)), np.zeros(len(texts), bool)
            for held in groups(texts) if langs else ():
                own, bucket = grams([p for _, p in held])
                of = np.array([i for i, _ in held])
                told[of] = True
                # A sparse matrix of grams by piece times the matrix of log probabilities: rows are looked up and summed by piece, order by order.
                starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, int)
                if len(starts):
                    np.add.at(sums, of[own[starts]], np.add.reduceat(rows[bucket], starts, axis=0, dtype=np.float64))
            best = sums.argmax(1) if langs else np.zeros(len(texts), int)
            odds = np.exp(sums - sums.max(1, keepdims=True)).sum(1) if langs else np.ones(len(texts))
            names = [langs[k] if fine else "und" for k, fine in zip(best.tolist(), told.tolist(), strict=True)]
            scores = np.where(told, 1 / odds, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, kinds)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; see ``predict``."""
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    return predict(docs, *model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
