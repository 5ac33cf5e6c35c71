"""Quality rules: counts of each text, and a hashed n-gram log-likelihood ratio.

Two multinomials over BUCKETS hashed n-grams of GRAM bytes of the text in UTF-8 are counted: of
trusted documents (the target) and of the whole corpus (raw), both smoothed by adding ALPHA. A document's
score is the mean over its n-grams of log(target / raw). It is kept if it passes the base
rules and its score is at least LEAST: the same rule for every document, no sampling.

The target is the one part fitted on a bounded sample: up to TRUSTED labelled rows with
quality 1, those with the smallest hashes of their ids. Raw counts cover every row.

A null text has no words; it and every text of under 10 words fails the base rules. With no
trusted row the ratio decides nothing: its score is 0 and passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypath.llm.shared import Words, by_steps, runs, small_batches, steps

BUCKETS = 1 << 16
GRAM = 4  # bytes
ALPHA = 1.0
#: Mean log ratio from which a document is kept: between the lowest score of trusted documents that weren't
#: learned from (-0.16 on the 0.1 tables) and the highest percent of poor ones (-0.73).
LEAST = -0.35
#: Trusted rows at most; their ids (8 bytes each) are broadcast.
TRUSTED = 50_000

SYMBOLS = b"#*$%&|<>"  # fixed by the contract of the rules
WINDOW = 5
SPACES = " \t\n\v\f\r"


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of bytes of each text (inside it alone), and where each text's start."""
    blobs = pc.fill_null(texts.cast(pa.binary()), b"").to_pylist()
    data = np.frombuffer(b"".join(blobs), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(b) for b in blobs])))
    n = np.maximum(np.diff(starts) - (GRAM - 1), 0)
    at = np.concatenate(([0], np.cumsum(n)))
    if len(data) < GRAM:
        return np.zeros(0, np.int64), at
    code = np.zeros(len(data) - GRAM + 1, np.uint32)
    for k in range(GRAM):
        code = code << np.uint32(8) | data[k : len(data) - GRAM + 1 + k]
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    inside = np.ones(len(code), bool)
    for i in range(1, GRAM):  # n-grams that reach over a border
        over = starts[1:-1] - i
        inside[over[(over >= 0) & (over < len(code))]] = False
    short = np.flatnonzero(np.diff(starts) < GRAM)
    for i in short:
        inside[starts[i] : min(starts[i + 1], len(code))] = False
    return code[inside].astype(np.int64), at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in steps(batch, "text"):
            code, at = grams(part.column("text"))
            raw += np.bincount(code, minlength=BUCKETS)
            own = np.repeat(part.column("trusted").to_numpy(zero_copy_only=False).astype(bool), np.diff(at))
            target += np.bincount(code[own], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """doc_id of up to ``most`` labelled rows of quality 1, by the hash of the id."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def weights(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log(target / raw) of each bucket; BUCKETS rows come to the driver."""
    small_batches(docs.sparkSession)
    mark = F.broadcast(trusted.select("doc_id", F.lit(True).alias("trusted")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(mark, "doc_id", "left")
    rows = rows.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    sums = rows.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[sums["bucket"]], target[sums["bucket"]] = sums["raw"], sums["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + ALPHA) / (target.sum() + ALPHA * BUCKETS)) - np.log((raw + ALPHA) / (raw.sum() + ALPHA * BUCKETS))


def repeated_words(words: Words) -> np.ndarray:
    """Words of each text that lie in a window of WINDOW words found twice or more in it."""
    out = np.zeros(len(words.starts) - 1, np.int64)
    if not len(words.codes):
        return out
    g, at = runs(words.hashes()[words.codes], words.starts, WINDOW, 3)
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        if b - a < 2:
            continue
        s = np.sort(g[a:b])
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):
            hit = np.isin(g[a:b], twice)
            edge = np.zeros(b - a + WINDOW, np.int64)
            edge[:-WINDOW] += hit
            edge[WINDOW:] -= hit
            out[i] = int((np.cumsum(edge) > 0).sum())
    return out


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def stats(texts: pa.Array) -> list[np.ndarray]:
    """The columns of STATS."""
    words = Words(texts)
    sizes = np.fromiter((len(w.decode()) for w in words.distinct), np.int64, len(words.distinct))
    per_word = sizes[words.codes] if len(words.codes) else np.zeros(0, np.int64)
    chars = np.diff(np.concatenate(([0], np.cumsum(per_word)))[words.starts])
    plain = pc.fill_null(texts, "").to_pylist()
    symbol = np.zeros(256, np.int64)
    symbol[list(SYMBOLS)] = 1
    blob = [t.encode() for t in plain]
    marks = np.concatenate(([0], np.cumsum(symbol[np.frombuffer(b"".join(blob), np.uint8)])))
    ends = np.concatenate(([0], np.cumsum([len(b) for b in blob])))
    return [words.counts(), chars, np.diff(marks[ends]), np.array([duplicate_lines(t) for t in plain], np.int64), repeated_words(words)]


def judge(docs: DataFrame, labels: DataFrame, *keep: str, least: float = LEAST) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score of each row of ``docs``, with its columns ``keep``."""
    held = docs.sparkSession.sparkContext.broadcast(weights(docs, trusted_ids(labels)))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        columns = stats(texts)
        code, at = grams(texts)
        total = np.concatenate(([0.0], np.cumsum(held.value[code])))
        n = np.diff(at)
        score = np.diff(total[at]) / np.maximum(n, 1)
        failed = (columns[0] < 10) | (100 * columns[4] > 20 * columns[0])
        arrays = [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns), pa.array(failed), pa.array(~failed & (score >= least)), pa.array(score)]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    return by_steps(rows, "text", step, f"doc_id long, {STATS}, base_failed boolean, kept boolean, score double", keep=keep)
