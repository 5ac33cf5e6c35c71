"""Hard negatives from embeddings through a vector-approximation file.

1. Vectors become integers, floor(256 x). Of rows with equal label and vector only the first FIRST ids can ever be
   among the first few of an anchor, as all others tie and come later: a class keeps these (exact, not a sample).
2. Each dimension is cut into CELLS cells whose borders are quantiles of SAMPLE rows (those with the smallest hashes)
   and whose ends are the least and the largest value of all rows. The approximation file has one byte a dimension
   for every row, apart from the vectors.
3. Anchors are written in blocks. Blocks of approximations meet blocks of anchors: for an anchor a table has the
   least and the largest product of its component with a value of each cell, and lookups in it are added to a lower
   and an upper bound of each row's score. An anchor's positives are among the same-label rows whose upper bound
   reaches the fifth largest lower bound; only these are fetched and scored.
4. A positive with score p opens the window from 0.8 p to p. Different-label rows whose bounds meet the window, and
   whose upper bound reaches the fifth largest lower bound of those surely inside, are fetched and scored; the
   first NEGATIVES in the window are returned. Bounds are exact, so nothing is missed: recall is 1.

Anchors are a stated query set against all rows, in blocks. They are broadcast, at most ANCHOR_BYTES at a
time: more anchors take more passes over the approximations. What leaves a block of approximations is what can
be among the first few there.

Rows with a null label, vector or vec_id, or with a null or non-finite component take no part. Components beyond
LARGEST count as LARGEST, so that scores fit 64 bits (of up to 16,384 dimensions; more raise an error). A shorter
vector is filled up with zeros; an empty one scores 0 with all. Rows alike in vec_id, label and vector count
once; rows that only repeat a vec_id are judged each, and are no partners of an anchor with that id. Ties go to the
smaller vec_id. Without anchors, positives or windows that hold a row, there is no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waypath.llm.shared import drop, materialize, small_batches

SCALE, LABELS, MOVED, ANCHORS = 256, 10, 7, 100
POSITIVES, NEGATIVES, LEAST = 5, 5, 80  # first partners, first negatives, hundredths of a positive's score from which a window reaches
FIRST = max(POSITIVES, NEGATIVES)
LARGEST, DIMENSIONS = 1 << 24, 1 << 14
CELLS, SAMPLE = 64, 4096
#: Bytes of a block of approximations, anchors of a block, and bytes of anchors broadcast at a time.
BLOCK_BYTES, ANCHOR_BLOCK, ANCHOR_BYTES = 1 << 20, 256, 64 << 20

Step = Iterator[pa.RecordBatch]


def _vectors(batches: Step) -> Step:
    """(vec_id, label, vector as little-endian 32-bit integers) of the rows that take part."""
    for batch in batches:
        lists = batch.column("embedding")
        flat = lists.flatten()
        x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null is nan
        n = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        ends = np.cumsum(n)
        bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
        q = np.clip(np.floor(SCALE * np.clip(np.nan_to_num(x), -LARGEST, LARGEST)), -LARGEST, LARGEST).astype("<i4").tobytes()
        own = [i for i in range(len(n)) if bad[ends[i]] == bad[ends[i] - n[i]]]
        vectors = [q[4 * (ends[i] - n[i]) : 4 * ends[i]] for i in own]
        at = pa.array(own, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), pa.array(vectors, pa.binary())], names=["vec_id", "label", "vector"])


def matrix(vectors: list[bytes], d: int) -> np.ndarray:
    """One row a vector, filled up with zeros to ``d``."""
    if all(len(v) == 4 * d for v in vectors):
        return np.frombuffer(b"".join(vectors), "<i4").reshape(len(vectors), d).astype(np.int64)
    out = np.zeros((len(vectors), d), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v) // 4] = np.frombuffer(v, "<i4")
    return out


def _ranges(d: int):
    """Least and largest value of each dimension, over a task."""

    def run(batches: Step) -> Step:
        lo, hi = np.full(d, np.iinfo(np.int64).max), np.full(d, np.iinfo(np.int64).min)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("vector").to_pylist(), d)
                lo, hi = np.minimum(lo, x.min(axis=0)), np.maximum(hi, x.max(axis=0))
        if d and lo[0] <= hi[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(lo), pa.array(hi)], names=["dim", "lo", "hi"])

    return run


class Cells:
    """``low`` and ``high`` (dimension, cell): the least and the largest value that a cell may hold."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, sample: np.ndarray, cells: int = CELLS):
        cuts = np.quantile(sample, np.arange(1, cells) / cells, axis=0, method="lower").T.astype(np.int64)  # (dimension, cells - 1)
        self.cuts = np.clip(cuts, lo[:, None], hi[:, None])
        self.low = np.concatenate((lo[:, None], self.cuts), axis=1)
        # values from a cut on, and under the next one, have a cell; an empty cell is never looked up
        self.high = np.maximum(np.concatenate((self.cuts - 1, hi[:, None]), axis=1), self.low)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Cell (a byte) of each component."""
        out = np.empty(x.shape, np.uint8)
        for j in range(x.shape[1]):
            out[:, j] = np.searchsorted(self.cuts[j], x[:, j], side="right")
        return out

    def table(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest product of the anchor's component with each cell, row by row."""
        a, b = anchor[:, None] * self.low, anchor[:, None] * self.high
        return np.minimum(a, b).ravel(), np.maximum(a, b).ravel()

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Where the codes' products stand in a table."""
        return codes.astype(np.int64) + np.arange(codes.shape[1]) * self.low.shape[1]


def bounds(table: tuple[np.ndarray, np.ndarray], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of each row's score by lookups in an anchor's table."""
    return tuple(t.take(places).sum(axis=1) if places.shape[1] else np.zeros(len(places), np.int64) for t in table)


BLOCKS = "ids binary, labels binary, codes binary"


def _approximated(cells: Cells):
    """Blocks of approximations: ids, labels and codes of some rows."""
    most = max(1, BLOCK_BYTES // max(1, len(cells.low)))

    def run(batches: Step) -> Step:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            parts = [np.concatenate(x).tobytes() for x in zip(*held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], names=["ids", "labels", "codes"])

        for batch in batches:
            for i in range(0, batch.num_rows, most):
                part = batch.slice(i, most)
                x = matrix(part.column("vector").to_pylist(), len(cells.low))
                held.append((part.column("vec_id").to_numpy(), part.column("label").to_numpy().astype(np.int64), cells.codes(x)))
                if sum(len(h[0]) for h in held) >= most:
                    yield block()
                    held.clear()
        if held:
            yield block()

    return run


def largest(lower: np.ndarray, n: int) -> int:
    """The n-th largest of ``lower``; lower than all if there are fewer."""
    return int(np.partition(lower, len(lower) - n)[len(lower) - n]) if len(lower) >= n else np.iinfo(np.int64).min


CANDIDATES = "anchor long, w int, vec_id long, lower long, upper long, sure boolean"


def _candidates(cells: Cells, negative: bool):
    """CANDIDATES of blocks of rows with blocks of anchors: positives (w is 0), or ``negative`` ones of each window w."""
    d = len(cells.low)

    def run(batches: Step) -> Step:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                places = cells.places(np.frombuffer(row["codes"], np.uint8).reshape(len(ids), d))
                of = {x: np.flatnonzero((labels != x) if negative else (labels == x)) for x in {a["label"] for a in row["anchors"]}}
                of = {x: (ids[i], places[i]) for x, i in of.items()}
                out = []
                for a in row["anchors"]:
                    own, at = of[a["label"]]
                    if not len(own):
                        continue
                    lower, upper = bounds(cells.table(matrix([a["vector"]], d)[0]), at)
                    for w, top in enumerate(a["windows"] if negative else [None]):
                        if negative:
                            # the window has the integers from least to top
                            least = -(-LEAST * top // 100)
                            may, sure = (upper >= least) & (lower <= top), (lower >= least) & (upper <= top)
                        else:
                            may = sure = np.ones(len(own), bool)
                        may, sure = may & (own != a["own_id"]), sure & (own != a["own_id"])
                        may &= upper >= largest(lower[sure], FIRST)
                        i = np.flatnonzero(may)
                        out.append((np.full(len(i), a["anchor"]), np.full(len(i), w, np.int32), own[i], lower[i], upper[i], sure[i]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=[c.split()[0] for c in CANDIDATES.split(", ")])

    return run


def _scored(d: int):
    """Exact scores in place of the two vectors."""

    def run(batches: Step) -> Step:
        for batch in batches:
            a, b = (matrix(batch.column(c).to_pylist(), d) for c in ("vector", "other"))
            keep = [c for c in batch.schema.names if c not in ("vector", "other")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array((a * b).sum(axis=1))], names=[*keep, "score"])

    return run


class HardNegatives:
    """The steps above over one table of embeddings (vec_id, embedding, label)."""

    def __init__(self, embeddings: DataFrame, anchor_bytes: int = ANCHOR_BYTES):
        self.spark, self.anchor_bytes = embeddings.sparkSession, anchor_bytes
        small_batches(self.spark)
        label = F.col("label").cast("long")
        moved = F.when(F.col("vec_id").cast("long") % MOVED == 0, (label + 1) % LABELS).otherwise(label)
        rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
        rows = rows.where("vec_id is not null and label is not null and embedding is not null").mapInArrow(_vectors, "vec_id long, label long, vector binary")
        # a hot class is cut down before the shuffle: Spark pushes the limit of a row number below it
        first = W.partitionBy("label", "vector").orderBy("vec_id")
        self.rows = materialize(rows.distinct(), "integers")
        few = self.rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= FIRST + 1).drop("_r")
        self.vectors = materialize(few, "vectors")
        size = self.vectors.agg(F.max(F.length("vector"))).first()[0]
        self.empty, self.d = size is None, (size or 0) // 4
        if self.d > DIMENSIONS:
            raise ValueError(f"vectors have at most {DIMENSIONS} dimensions, not {self.d}")

    def cells(self) -> Cells:
        """Cells of all rows; their borders from a bounded sample, which only tells how tight bounds are."""
        ends = self.vectors.mapInArrow(_ranges(self.d), "dim long, lo long, hi long").groupBy("dim").agg(F.min("lo"), F.max("hi")).orderBy("dim").collect() if self.d else []
        most = max(256, min(SAMPLE, (16 << 20) // max(1, 4 * self.d)))
        sample = [r.vector for r in self.vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("vector").collect()]
        return Cells(np.array([e[1] for e in ends], np.int64), np.array([e[2] for e in ends], np.int64), matrix([bytes(v) for v in sample], self.d))

    def passes(self, blocks: DataFrame, anchors: DataFrame, cells: Cells, negative: bool) -> DataFrame:
        """CANDIDATES of all blocks with all ``anchors`` (anchor, own_id, label, vector, windows)."""
        n = anchors.count()
        many = -(-n // ANCHOR_BLOCK)
        if not many:
            return self.spark.createDataFrame([], CANDIDATES)
        one = F.struct("anchor", "own_id", "label", "vector", "windows")
        dealt = materialize(anchors.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(many))).groupBy("block").agg(F.collect_list(one).alias("anchors")), "anchors")
        each = max(1, self.anchor_bytes // (ANCHOR_BLOCK * (4 * self.d + 64)))  # blocks of anchors to a broadcast
        found = None
        for k in range(0, many, each):
            mine = blocks.withColumn("block", F.explode(F.sequence(F.lit(k).cast("long"), F.lit(min(k + each, many) - 1).cast("long"))))
            some = dealt.where(F.col("block").between(k, k + each - 1))
            part = mine.join(F.broadcast(some), "block").drop("block").mapInArrow(_candidates(cells, negative), CANDIDATES)
            found = part if found is None else found.unionByName(part)
        return materialize(found, "candidates")

    def reaching(self, candidates: DataFrame) -> DataFrame:
        """(anchor, vec_id) of the candidates that reach the fifth largest lower bound of all blocks."""
        first = W.partitionBy("anchor", "w").orderBy(F.desc("lower"), "vec_id")
        fifth = candidates.where("sure").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= FIRST)
        fifth = fifth.groupBy("anchor", "w").agg(F.when(F.count("*") == FIRST, F.min("lower")).alias("least"))
        return candidates.join(fifth, ["anchor", "w"], "left").where("least is null or upper >= least").select("anchor", "vec_id").distinct()

    def exact(self, pairs: DataFrame, anchors: DataFrame, same: bool) -> DataFrame:
        """``pairs`` (anchor, vec_id, ...) with exact scores, of rows with the anchor's label (``same``) or another one."""
        other = self.vectors.select("vec_id", F.col("label").alias("_label"), F.col("vector").alias("other"))
        both = pairs.join(anchors.select("anchor", "label", "vector"), "anchor").join(other, "vec_id")
        both = both.where((F.col("label") == F.col("_label")) == F.lit(same)).select(*pairs.columns, "vector", "other")
        schema = ", ".join(f"{c} {t}" for c, t in both.dtypes if c not in ("vector", "other")) + ", score long"
        return both.mapInArrow(_scored(self.d), schema)

    def result(self) -> DataFrame:
        """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
        wanted = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        if self.empty:
            return self.spark.createDataFrame([], wanted)
        cells = self.cells()
        blocks = materialize(self.vectors.select("vec_id", "label", "vector").mapInArrow(_approximated(cells), BLOCKS), "approximations")
        # anchors have numbers of their own, as a vec_id may repeat
        asked = self.rows.where(F.col("vec_id") % ANCHORS == 0).withColumnsRenamed({"vec_id": "own_id"})
        anchors = materialize(asked.withColumns({"anchor": F.monotonically_increasing_id(), "windows": F.array().cast("array<long>")}), "anchors")
        # positives: the first of the same label
        pairs = self.reaching(self.passes(blocks, anchors, cells, False))
        order = W.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
        positives = self.exact(pairs, anchors, True).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= POSITIVES)
        positives = materialize(positives.select("anchor", "_r", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        # windows of an anchor are those of its positives' scores; equal scores have one
        windows = positives.groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("windows"))
        asked = materialize(anchors.drop("windows").join(windows, "anchor"), "windows")
        pairs = self.reaching(self.passes(blocks, asked, cells, True))
        scores = materialize(self.exact(pairs, anchors, False), "scores")
        inside = (F.col("score") * 100 >= F.col("positive_score") * LEAST) & (F.col("score") <= F.col("positive_score"))
        rank = F.row_number().over(W.partitionBy("anchor", "_r").orderBy(F.desc("score"), "vec_id"))
        both = positives.join(scores, "anchor").where(inside).withColumn("rank", rank).where(F.col("rank") <= NEGATIVES)
        drop(blocks)
        both = both.join(anchors.select("anchor", "own_id"), "anchor")
        return both.select(F.col("own_id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(embeddings: DataFrame, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``embeddings`` (vec_id, embedding, label)."""
    return HardNegatives(embeddings, anchor_bytes).result()


SQL = f"""
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % {MOVED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, [floor({SCALE} * CAST(x AS DOUBLE)) for x in embedding] AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % {ANCHORS} = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES}
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND {LEAST} * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
