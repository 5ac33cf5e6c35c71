"""Language by rank-order profiles of character n-grams.

A profile is the most frequent n-grams (one to three letters, word borders marked) of a
language, most frequent first. A document's own list is compared with each profile: an
n-gram adds the distance between its two ranks, or the profile's length where the profile
lacks it. The language with the smallest sum wins; equal sums go to the name that sorts first.

Counts of n-grams come from every learning document and whole text. Tasks add them up
before the shuffle, so a language with a third of all rows costs a task no more than others.
Profiles are broadcast; their size is PROFILE rows for each language.

A text that is null or has no letter is ``und`` with score 0. With no learning row at all,
every row is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waypath.llm.shared import by_steps, end_task, small_batches, steps

#: N-grams to a profile and to a document's list.
PROFILE = 400
LONGEST = 3
#: Distinct n-grams that a learning task adds up before it hands them on.
FLUSH = 2_000_000
#: Bytes of text taken at a time; its n-grams take about a hundred times as much memory.
STEP = 1 << 19
SPLITS = 64  # of a language's n-grams, when the most frequent are chosen

UNKNOWN = "und"


@cache
def _folded() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0 (a border)."""
    out = np.zeros(0x110000, np.int64)
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000 and (c := chr(i)).isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of each text, and where each text's codes start."""
    flat = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    code = _folded()[flat]
    code[ends - 1] = 0
    keep = (code > 0) | np.concatenate(([True], code[:-1] > 0))
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))[keep]
    c = np.concatenate(([0], code[keep], [0, 0]))  # a border before the first letter
    letter, n = c > 0, len(owner)
    here, at = slice(1, n + 1), np.arange(n)
    grams = [(letter[here], c[here])]
    grams.append((letter[0:n] | letter[here], (c[0:n] << 21 | c[here]) + (1 << 62)))  # two, one may be a border
    grams.append((letter[here] & (letter[0:n] | letter[2 : n + 2]), c[0:n] << 42 | c[here] << 21 | c[2 : n + 2] | (1 << 61)))
    codes = np.concatenate([g[ok] for ok, g in grams])
    who = np.concatenate([owner[at[ok]] for ok, _ in grams])
    order = np.argsort(who.astype(np.int32), kind="stable")
    return codes[order], np.searchsorted(who[order], np.arange(len(texts) + 1))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): counts of a task, added up."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, (g, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], names=["lang", "gram", "n"])
        sums.clear()

    for batch in batches:
        for part in steps(batch, "text", STEP):
            langs = part.column("lang").to_pylist()
            codes, at = ngrams(pc.fill_null(part.column("text"), "").to_pylist())
            for lang in dict.fromkeys(langs):
                own = [codes[at[i] : at[i + 1]] for i, x in enumerate(langs) if x == lang]
                g, n = np.unique(np.concatenate(own), return_counts=True)
                if lang in sums:
                    both = np.concatenate((sums[lang][0], g))
                    g, where = np.unique(both, return_inverse=True)
                    n = np.bincount(where, np.concatenate((sums[lang][1], n))).astype(np.int64)
                sums[lang] = g, n.astype(np.int64)
        if sum(len(g) for g, _ in sums.values()) > FLUSH:
            yield from out()
    yield from out()
    end_task()


def profiles(learning: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank) of the rows (text, lang); rows without text or lang teach nothing."""
    small_batches(learning.sparkSession)
    counts = learning.where("lang is not null and text is not null").select("text", "lang").mapInArrow(_learn, "lang string, gram long, n long")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    split = W.partitionBy("lang", F.pmod("gram", F.lit(SPLITS))).orderBy(*order)
    few = total.withColumn("r", F.row_number().over(split)).where(F.col("r") <= size)
    return few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)) - 1).where(F.col("rank") < size).select("lang", "gram", "rank")


class Model:
    """The profiles as one table of ranks: a row for each language, a column for each n-gram of any."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted({x[0] for x in rows})
        self.grams = np.unique(np.array([x[1] for x in rows], np.int64))
        #: 2 * size marks an n-gram that a profile lacks; the last column is one that all lack
        self.rank = np.full((len(self.langs), len(self.grams) + 1), 2 * size, np.int64)
        for lang, gram, rank in rows:
            self.rank[self.langs.index(lang), np.searchsorted(self.grams, gram)] = rank

    def judge(self, codes: np.ndarray) -> tuple[str, float]:
        """The language of one text's n-grams, and 1 less the share of the largest possible distance."""
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        s = np.sort(codes)
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        n = np.diff(first, append=len(s))
        top = s[first[np.argsort(-n, kind="stable")[: self.size]]]
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        at[self.grams[at] != top] = len(self.grams)
        far = np.abs(self.rank[:, at] - np.arange(len(top)))
        far[self.rank[:, at] == 2 * self.size] = self.size
        sums = far.sum(axis=1)
        best = int(sums.argmin())
        return self.langs[best], float(1 - sums[best] / (self.size * len(top)))


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, lang_pred, score, and its columns ``keep``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(batch.column("text"), "").to_pylist()
        codes, at = ngrams(texts)
        got = [held.value.judge(codes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    return by_steps(rows, "text", judge, "doc_id long, lang_pred string, score double", STEP, keep)


def fold(folds: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(folds)


def learned(docs: DataFrame) -> Model:
    """Profiles from the documents of all folds of 4 but fold 2."""
    rows = profiles(docs.where(fold(4) != 2)).collect()  # PROFILE rows for each language
    return Model([tuple(r) for r in rows])


def languages(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of ``docs`` (doc_id, text, lang), with its columns ``keep``.

    A null doc_id is in no fold: it teaches nothing and isn't held out.
    """
    found = predict(docs, learned(docs), *keep)
    return found.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", *keep)
