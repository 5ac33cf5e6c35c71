"""Log-likelihood of whole documents under a recurrent language model learned from the corpus.

1. Words of all learning documents are counted (tasks add up before the shuffle).
2. The most frequent words, SHORT times the fifth root of the tokens, get classes and slots, as
   many classes as words to a class; every other word belongs to the class where its reversed
   spelling falls and shares that class's last slot. Inside that
   slot, words divide the probability by their counts, smoothed, an unseen word included.
   So the vocabulary is all of the corpus, and the probabilities of all words sum to one.
3. The network (``gru``) is trained in ROUNDS over disjoint parts of the learning documents,
   all of them together: in a round every task starts from the same weights and learns from
   its own rows; the weights are averaged by tokens, tasks to groups to one.
4. Every document is scored from start to end, the state carried across windows. The counts
   of the KNOWN most frequent words are broadcast (a fixed number of rows); all other words
   leave the task as (row, word, times) and meet their counts in a shuffle join.

So counts, rare words and weights sent grow with the corpus; what is broadcast doesn't.

A null or empty text has one token, its end. A null doc_id is in no fold: it isn't learned
from and isn't held out. With nothing to learn from, every word is unseen. Rows that share a
doc_id are scored each.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypath.llm import gru
from waypath.llm.shared import Words, end_task, materialize, steps

#: Words of the network for each fifth root of the learning tokens: 1,000 of twenty million tokens, 3,300 of six billion.
SHORT = 36
KNOWN = 200_000
#: Twentieths of the learning documents (by a hash of the id) that each round learns from, and its step size.
ROUNDS = ((range(1), 0.05), (range(1, 5), 0.05), (range(5, 20), 0.04))
#: Bytes of text that are scored or learned from side by side.
STEP = 8 << 20
FLUSH = 1_000_000  # distinct words that a counting task holds
FOLDS, HELD_OUT = 5, 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[bytes, int] = {}

    def out() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.binary()), pa.array(sums.values(), pa.int64())], names=["word", "n"])
        sums.clear()
        return got

    for batch in batches:
        for part in steps(batch, "text", STEP):
            words = Words(part.column("text"), lower=True)
            for w, n in zip(words.distinct, np.bincount(words.codes, minlength=len(words.distinct)).tolist(), strict=True):
                sums[w] = sums.get(w, 0) + n
            if len(sums) > FLUSH:
                yield out()
    yield out()


@dataclass
class Vocabulary:
    """The frequent words and where every word stands."""

    words: list[bytes]  # most frequent first
    counts: np.ndarray
    layout: gru.Layout
    borders: list[bytes]  # reversed spelling from which a class after the first begins
    ends: int  # learning documents
    total: int = 0  # learning tokens, ends included
    types: int = 0  # distinct ones
    #: of each class: tokens and distinct words outside the shortlist
    rest: np.ndarray | None = None
    rest_types: np.ndarray | None = None

    @classmethod
    def of(cls, words: list[bytes], counts: np.ndarray, ends: int, tokens: int) -> "Vocabulary":
        """``tokens``: of all learning documents, those of words that aren't among ``words`` included."""
        n = min(int(SHORT * tokens**0.2), len(words))
        classes = max(2, round(n**0.5))
        by_spelling = sorted(range(n), key=lambda i: words[i][::-1])
        share = np.cumsum(np.sqrt(counts[by_spelling].astype(float))) if n else np.zeros(0)
        group = np.minimum((share / share[-1] * classes).astype(int), classes - 1) if n else np.zeros(0, int)
        class_of, slot_of = np.zeros(n + classes + 1, np.int64), np.zeros(n + classes + 1, np.int64)
        first, borders, last = [0], [], b""
        for c in range(classes):
            own = [by_spelling[j] for j in np.flatnonzero(group == c)]
            class_of[own], slot_of[own] = c, np.arange(len(own))
            class_of[n + c], slot_of[n + c] = c, len(own)
            first.append(first[-1] + len(own) + 1)
            if c:
                last = words[own[0]][::-1] if own else last
                borders.append(last)
        class_of[-1] = classes
        first.append(first[-1] + 1)
        return cls(words, counts, gru.Layout(class_of, slot_of, np.array(first)), borders, ends)

    @property
    def classes(self) -> int:
        """Classes of words; the end of a text is one more."""
        return self.layout.classes - 1

    @property
    def short(self) -> int:
        """Words with a slot of their own."""
        return self.layout.end - self.classes

    def class_of(self, word: bytes) -> int:
        return bisect_right(self.borders, word[::-1])

    def index(self) -> dict[bytes, int]:
        if not hasattr(self, "_index"):
            self._index = {w: i for i, w in enumerate(self.words)}
        return self._index

    def kinds(self) -> np.ndarray:
        """The id of each frequent word."""
        if not hasattr(self, "_kinds"):
            self._kinds = np.arange(len(self.words))
            self._kinds[self.short :] = [self.short + self.class_of(w) for w in self.words[self.short :]]
        return self._kinds

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_index", "_kinds")}

    def ids(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per distinct word its place among the frequent words (-1: none) and its id; per text and word the id, ends put in."""
        index, short = self.index(), self.short
        place = np.fromiter(map(index.get, words.distinct, repeat(-1)), np.int64, len(words.distinct))
        kind = self.kinds()[place] if self.words else place.copy()
        far = np.flatnonzero(place < 0)
        kind[far] = [short + self.class_of(words.distinct[i]) for i in far.tolist()]
        ids = np.insert(kind[words.codes] if len(words.codes) else np.zeros(0, np.int64), words.starts[1:], self.layout.end)
        return place, kind, ids


def _classes(vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and words of each class outside the shortlist, in a task's part of the counts."""
    v: Vocabulary = vocabulary.value
    index = v.index()
    n, kinds = np.zeros(v.classes, np.int64), np.zeros(v.classes, np.int64)
    for batch in batches:
        for w, k in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            if index.get(w, v.short) >= v.short:
                c = v.class_of(w)
                n[c] += k
                kinds[c] += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(v.classes)), pa.array(n), pa.array(kinds)], names=["class", "n", "kinds"])


def frequent(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words (at most ``most``, words about as frequent as each other all or none) and their counts.

    Steps of about one percent in frequency are counted first, so that only what is taken
    comes to the driver.
    """
    step = F.floor(F.log2("n") * 64)
    sizes = counts.groupBy(step.alias("step")).count().collect()  # under 4096 rows
    taken, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["step"]):
        taken += r["count"]
        if taken > most:
            break
        least = r["step"]
    if least is None:
        return [], np.zeros(0, np.int64)
    top = counts.where(step >= least).select("word", "n").toArrow()
    pairs = sorted(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    return [w for w, _ in pairs], np.array([n for _, n in pairs], np.int64)


def vocabulary(learning: DataFrame, counts: DataFrame) -> Vocabulary:
    """Of the counts (word, n) of the learning documents; at most KNOWN rows come to the driver."""
    ends = learning.count()
    v = Vocabulary.of(*frequent(counts, KNOWN), ends, ends + (counts.agg(F.sum("n")).first()[0] or 0))
    sent = counts.sparkSession.sparkContext.broadcast(v)
    sums = counts.mapInArrow(lambda it: _classes(sent, it), "class long, n long, kinds long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).toPandas()
    v.rest, v.rest_types = np.zeros(v.classes, np.int64), np.zeros(v.classes, np.int64)
    v.rest[sums["class"]], v.rest_types[sums["class"]] = sums["n"], sums["kinds"]
    v.total = int(v.rest.sum() + v.counts[: v.short].sum()) + v.ends
    v.types = int(v.rest_types.sum()) + v.short + (1 if v.ends else 0)
    return v


WEIGHTS = "tokens long, weights binary"


def _row(tokens: int, weights: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([weights.astype(np.float32).tobytes()], pa.binary())], names=["tokens", "weights"])


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, tokens = None, 0
    for batch in batches:
        for n, w in zip(batch.column("tokens").to_pylist(), batch.column("weights"), strict=True):
            w = np.frombuffer(w.as_buffer(), np.float32).astype(np.float64) * n
            total, tokens = w if total is None else total + w, tokens + n
    if tokens:
        yield _row(tokens, total / tokens)


def trained(learning: DataFrame, v: Vocabulary) -> np.ndarray:
    """Weights learned from all rows (doc_id, text) of ``learning``."""
    spark = learning.sparkSession
    counts = np.zeros(v.layout.ids - 1)
    counts[: v.short], counts[v.short : v.short + v.classes], counts[-1] = v.counts[: v.short], v.rest, v.ends
    weights = gru.flat(gru.initial(v.layout, counts))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(20))
    vocab = spark.sparkContext.broadcast(v)
    for own, rate in ROUNDS:
        start = spark.sparkContext.broadcast(weights)

        def learn(batches: Iterator[pa.RecordBatch], start=start, rate=rate) -> Iterator[pa.RecordBatch]:
            v, tokens, net = vocab.value, 0, None
            for batch in batches:
                for some in steps(batch, "text", STEP):
                    if net is None:
                        net, memory = gru.Net(v.layout, gru.unflat(start.value, v.layout)), gru.memory(v.layout)
                    words = Words(some.column("text"), lower=True)
                    ids = v.ids(words)[2]
                    net.train(ids, words.starts + np.arange(len(words.starts)), rate, memory)
                    tokens += len(ids)
            if tokens:
                yield _row(tokens, gru.flat(net.p))

        rows = learning.where((part >= own.start) & (part < own.stop)).select("text").mapInArrow(learn, WEIGHTS)
        groups = max(1, int(int(spark.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
        few = rows.repartition(groups).mapInArrow(_average, WEIGHTS).repartition(1).mapInArrow(_average, WEIGHTS).collect()
        start.unpersist()
        if few:
            weights = np.frombuffer(few[0]["weights"], np.float32)
    return weights


SCORED = "doc_id long, n_tokens long, n_known long, base double, score double, rare array<struct<word:binary,class:int,n:int>>"


def scored(docs: DataFrame, v: Vocabulary, weights: np.ndarray) -> DataFrame:
    """SCORED rows; the words in ``rare`` are still to be added to n_known, base and score."""
    context = docs.sparkSession.sparkContext
    vocab, sent = context.broadcast(v), context.broadcast(weights)
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("class", pa.int32()), ("n", pa.int32())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        net = gru.Net(v.layout, gru.unflat(sent.value, v.layout))
        base_of = np.log10((v.counts + 0.5) / (v.total + 0.5 * (v.types + 1)))
        end_base = np.log10((v.ends + 0.5) / (v.total + 0.5 * (v.types + 1)))
        in_rest = v.rest + 0.5 * (v.rest_types + 1)
        for batch in batches:
            for some in steps(batch, "text", STEP):
                words = Words(some.column("text"), lower=True)
                place, kind, ids = v.ids(words)
                starts = words.starts + np.arange(len(words.starts))
                known = place >= 0
                base, share = np.zeros(len(place)), np.zeros(len(place))
                base[known] = base_of[place[known]]
                outside = place >= v.short  # known, but not of the shortlist
                share[outside] = np.log10((v.counts[place[outside]] + 0.5) / in_rest[kind[outside] - v.short])
                add = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[words.codes] if len(words.codes) else x[:0])))[words.starts])
                out = net.scores(ids, starts) / np.log(10) + add(share)
                owners, codes = words.owners(), words.codes
                far = np.flatnonzero(~known[codes]) if len(codes) else np.zeros(0, np.int64)
                pairs, times = np.unique(owners[far] * len(place) + codes[far], return_counts=True)
                who, what = pairs // max(len(place), 1), pairs % max(len(place), 1)
                bounds = np.searchsorted(who, np.arange(len(starts)))
                rare = pa.StructArray.from_arrays(
                    [pa.array([words.distinct[i] for i in what], pa.binary()), pa.array((kind[what] - v.short).astype(np.int32)), pa.array(times.astype(np.int32))], fields=list(rare_type.value_type)
                )
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(np.diff(starts)), pa.array(add(known.astype(np.int64)) + (1 if v.ends else 0)), pa.array(add(base) + end_base), pa.array(out), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), rare)],
                    names=["doc_id", "n_tokens", "n_known", "base", "score", "rare"],
                )
        end_task()

    return docs.mapInArrow(score, SCORED)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.lit(FOLDS)
    learning = docs.where(fold != HELD_OUT)
    counts = materialize(learning.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    v = vocabulary(learning, counts)
    got = materialize(scored(docs, v, trained(learning, v)).withColumn("row", F.monotonically_increasing_id()), "scored")

    each = got.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.class").alias("class"), F.col("r.n").alias("times"))
    in_rest = F.element_at(F.array(*(F.lit(float(x)) for x in v.rest + 0.5 * (v.rest_types + 1))), F.col("class") + 1)
    n = F.coalesce("n", F.lit(0))
    sums = (
        each.join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * F.log10((n + 0.5) / F.lit(v.total + 0.5 * (v.types + 1)))).alias("more_base"),
            F.sum(F.col("times") * F.log10((n + 0.5) / in_rest)).alias("more_score"),
        )
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return got.drop("rare").join(sums, "row", "left").select(
        "doc_id",
        F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + zero("more_known")).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base")).alias("base_score"),
        (F.col("score") + zero("more_score")).alias("score"),
    )
