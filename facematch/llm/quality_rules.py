"""Quality rules by weak supervision.

Each rule votes good, votes bad or abstains on a text. Votes of all documents are counted by
pattern (at most 3 ** len(RULES) of them, whatever the input), expectation-maximisation over
these counts estimates each rule's accuracy on good and on bad texts and the share of good
ones, and a document's verdict is its posterior probability of being good.

The model takes rules as independent, so it trusts what several rules say alike and learns that
a rule is wrong where it stands alone. So each kind of junk has three rules or more that see it.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facematch.llm.common import documents, free_name, stored, with_columns

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Votes that each rule is taken to have cast before, in either class: right and wrong ones.
PRIOR = (4.0, 1.0)
UPPER, LOWER, DIGITS = (bytes(range(a, b)) for a, b in ((65, 91), (97, 123), (48, 58)))
CONTINUATION = bytes(range(0x80, 0xC0))
#: Words that hold a symbol; words of marks alone; the same mark twice or more in a row.
MARKED = re.compile(rb"[^\s#*$%&|<>]*[#*$%&|<>]\S*")
BARE = re.compile(rb"(?<!\S)[^\s0-9A-Za-z\x80-\xff]+(?!\S)")
RUN = re.compile(rb"([^\s0-9A-Za-z\x80-\xff])\1+")


def _share(bad, good):
    """A rule on a share: bad from ``bad`` on, good up to ``good``, else it abstains."""
    return lambda x: -1 if x >= bad else 1 if x <= good else 0


def _least(bad, good):
    return lambda x: -1 if x <= bad else 1 if x >= good else 0


#: name and rule, in the order of ``measure``'s values, which are shares that don't depend on a text's length or language.
RULES = (
    ("symbols", _share(0.10, 0.02)),
    ("marked words", _share(0.10, 0.02)),
    ("bare marks", _share(0.10, 0.02)),
    ("runs of marks", _share(0.10, 0.02)),
    ("repeats", _share(0.45, 0.20)),
    ("dup_lines", _share(0.45, 0.20)),
    ("commonest word", _share(0.30, 0.15)),
    ("variety", _least(0.12, 0.25)),
    ("shouting", _share(0.30, 0.15)),
    ("exclaims", _share(0.15, 0.04)),
    ("letters", _least(0.70, 0.85)),
    ("word_size", lambda x: 1 if 3.0 <= x <= 12.0 else -1 if x < 2.0 or x > 20.0 else 0),
)


def measure(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, code (the votes in base 3).

    Null counts as empty; on a text without words all rules abstain.
    """
    text = text or b""
    words = text.split()
    n = len(words)
    lines, seen, dup_lines = text.split(b"\n"), set(), 0
    if len(lines) > 1:
        for line in lines:
            if line in seen:
                dup_lines += bool(line.split(None, 1))
            else:
                seen.add(line)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    solid = b"".join(words)
    word_chars = len(solid) - (len(solid) - len(solid.translate(None, CONTINUATION)))
    triples = list(zip(words, words[1:], words[2:], strict=False))
    repeats = 0
    if len(seen_triples := Counter(triples)) < len(triples):
        last = -1  # the last word position counted
        for i, x in enumerate(triples):
            if seen_triples[x] > 1:
                repeats += i + 3 - max(i, last)
                last = i + 3
    votes = [0] * len(RULES)
    if n:
        upper, lower = (len(solid) - len(solid.translate(None, x)) for x in (UPPER, LOWER))
        letters = upper + lower + (len(solid) - len(solid.translate(None, bytes(range(0xC3, 0xF5)))))
        filled = sum(1 for x in lines if x.strip()) if len(lines) > 1 else 1
        counts = Counter(words)
        values = (
            symbols / n,
            len(MARKED.findall(text)) / n if symbols else 0.0,
            len(BARE.findall(text)) / n,
            len(RUN.findall(text)) / n,
            repeats / n,
            dup_lines / filled,
            max(counts.values()) / n if n >= 20 else 0.0,
            len(counts) / n * max(1.0, math.log10(n / 100 + 1) * 2),
            upper / max(1, upper + lower),
            solid.count(b"!") / n,
            letters / max(1, word_chars),
            word_chars / n,
        )
        votes = [rule(x) for (_, rule), x in zip(RULES, values, strict=True)]
    code = 0
    for v in votes:
        code = code * 3 + v + 1
    return n, word_chars, symbols, dup_lines, repeats, code


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "votes")


def votes_of(code: int) -> list[int]:
    out = []
    for _ in RULES:
        code, v = divmod(code, 3)
        out.append(v - 1)
    return out[::-1]


def fit(patterns: dict[int, int], rounds: int = 500) -> dict[int, float]:
    """The posterior probability of good for each vote pattern, by expectation-maximisation.

    Two classes; given the class, rules vote independently, each right with a probability of its
    own in either class (among its votes; abstaining tells nothing), with PRIOR as if seen before.
    The start takes the share of good votes as the probability. No patterns: no posteriors.
    """
    codes = sorted(patterns)
    votes = np.array([votes_of(c) for c in codes], np.int8).reshape(len(codes), len(RULES))
    weight = np.array([patterns[c] for c in codes], np.float64)
    up, down = (votes > 0).astype(np.float64), (votes < 0).astype(np.float64)
    good = (up.sum(1) + 0.5) / ((up + down).sum(1) + 1)
    right, wrong = PRIOR
    for _ in range(rounds if codes else 0):
        on_good, on_bad = weight * good, weight * (1 - good)
        share = (on_good.sum() + 1) / (weight.sum() + 2)
        of_good = (on_good @ up + right) / (on_good @ (up + down) + right + wrong)  # right votes, by rule
        of_bad = (on_bad @ down + right) / (on_bad @ (up + down) + right + wrong)
        odds = np.log(share / (1 - share)) + up @ np.log(of_good / (1 - of_bad)) + down @ np.log((1 - of_good) / of_bad)
        new = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        moved, good = np.abs(new - good).max(), new
        if moved < 1e-9:
            break
    return dict(zip(codes, good.tolist(), strict=True))


def measured(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """df with the columns FIELDS, their names after ``prefix``."""
    names = [prefix + x for x in FIELDS]

    def work(texts):
        return [pa.array(x, pa.int64()) for x in (zip(*map(measure, texts), strict=True) if texts else [[]] * len(names))]

    return with_columns(df, text, work, [(x, T.LongType()) for x in names])


def _verdict(m: dict, name: str, least: float):
    """The struct ``name`` of measures and posterior."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    return F.struct(*(m[x].alias(x) for x in FIELDS[:-1]), m["posterior"].alias("posterior"), failed.alias("base_failed"), (~failed & (m["posterior"] >= least)).alias("kept")).alias(name)


def judge(df: DataFrame, text: str = "text", least: float = 0.5, texts: bool = True) -> DataFrame:
    """df with one struct column ``quality`` (with underscores added where that name is taken).

    Its fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), posterior
    (double), base_failed, kept (boolean). Null and empty texts fail the base. Repeated rows are
    judged alike. An empty table gives an empty result. Without ``texts`` the text is left out.

    Texts are measured once; the measures are kept in the shared folder, beside the texts if those
    are wanted. Nothing but the counts of vote patterns, at most 3 ** len(RULES) rows of two numbers,
    reaches the driver, and no text is shuffled.
    """
    name, prefix = free_name(df, "quality"), "m_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    made = measured(df, text, prefix)
    kept = [c for c in df.columns if texts or c != text]
    made, _ = stored(made.select(*(F.col(f"`{c}`") for c in [*kept, *made.columns[len(df.columns) :]])), "measured")
    votes, posterior = f"{prefix}votes", f"{prefix}posterior"
    counts = made.groupBy(votes).agg(F.count("*").alias("n")).toPandas()
    found = fit(dict(zip(counts[votes].tolist(), counts["n"].tolist(), strict=True)))
    table = df.sparkSession.createDataFrame(list(found.items()), f"{votes} long, {posterior} double")  # as small as the counts
    out = made.join(F.broadcast(table), votes)
    m = {x: F.col(f"`{prefix}{x}`") for x in (*FIELDS, "posterior")}
    return out.select(*(F.col(f"`{c}`") for c in kept), _verdict(m, name, least))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the measures, posterior, base_failed and kept of every document; see ``judge`` for null and empty texts."""
    return judge(documents(spark, sf_dir).select("doc_id", "text"), texts=False).select("doc_id", "quality.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep."""
    name = free_name(docs, "quality")
    return judge(docs).where(F.col(name)["kept"]).drop(name)
