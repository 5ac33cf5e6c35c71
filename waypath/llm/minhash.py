"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded
buckets, star-shaped candidate edges, and links confirmed on full shingle sets.

1. Every text gives its set of five-word shingles as 64-bit hashes, the set's size and digest,
   a sketch (the lowest hash of each of BINS bins, empty bins filled from a full one by a fixed
   probe sequence) and BANDS bucket keys of ROWS bins each. Only these leave the task.
2. Documents with equal sets form a class; one row for each class goes on, so thousands of
   copies cost one row. A class's number is its place in the written table of classes.
3. A bucket of up to BLOCK classes is one chunk; a larger one is dealt to chunks by a hash of the
   id, and its smallest and largest id join every chunk, so no bucket is one task's. Within a
   chunk each class is compared by sketch with every other. A class that is surely like another
   gives an edge to its leader, the first such class of the chunk: a star. Stars that may be alike
   are tied by the edge most alike, as in a spanning tree. So a chunk has fewer edges than rows.
4. Edges are confirmed on the full sets; confirmed ones give components. Where one isn't, its
   chunk is gone through again: all its pairs that may be alike and are still apart are confirmed.
5. What a large bucket may miss are links between its chunks. If its classes are not all of one component, they
   are a crowd and are settled by their full sets. A shingle that at most BLOCK classes of the crowd hold is a
   bucket of its own, compared as any small one: rare shingles part a crowd, and a passage that all of it shares
   never makes a key. Two classes that share no rare shingle can only link by frequent ones. Those with the same
   frequent shingles link if their sizes allow it, so each is tied to the smallest one that does; different sets of
   frequent shingles are compared with each other, one row a set, in blocks. These links are exact.

Two classes that link are missed only where no path of other links joins them and they meet in no bucket (at exactly
0.75 with probability 0.0002), or where a pair that meets lies beyond ERRORS standard errors of the estimate.

Rows without words link with nothing. Rows that repeat a doc_id are each judged by their own
text. A null doc_id links with nothing and keeps a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypath.llm.graph import components
from waypath.llm.shared import BROADCAST_KEYS, Words, by_steps, drop, let_go, materialize, mixed, runs, seeds, sieve

WORDS, PERCENT = 5, 75  # of the shingles, and of the similarity from which documents link
BANDS, ROWS = 32, 5
#: Bins of the sketch; bands use the first BANDS * ROWS of them.
BINS = 512
#: Classes of a bucket that are compared as one chunk.
BLOCK = 64
#: Where every chunk of a bucket meets every other, each class is sent to all of them; so from SPREAD chunks on, chunks grow
#: before they become more, up to WIDE times BLOCK.
SPREAD, WIDE = 64, 8
#: Standard errors of the estimate below 0.75 from which a pair isn't confirmed, and above from which it counts as sure
#: to be; or as many shingles of the smaller set. A pair lies beyond with probability 0.00002.
ERRORS, FEW = 4.2, 2.0
SKETCHES = "doc_id long, n_shingles long, digest binary, sketch binary, bits binary, bands array<long>"


def shingles(words: Words) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; under five words give one of all words."""
    h = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    g, at = runs(h, words.starts, WORDS, 5)
    out = []
    for i, n in enumerate(words.counts()):
        if 0 < n < WORDS:
            w = h[words.starts[i] : words.starts[i + 1]]
            out.append(np.array([xxhash.xxh3_64_intdigest(w.tobytes(), seed=7)], np.uint64))
            continue
        s = np.sort(g[at[i] : at[i + 1]])
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s)
    return out


def binned(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One row of BINS values for each non-empty set, the set's lowest hash of each bin, and which bins have one."""
    value, full = np.zeros((len(sets), BINS), np.uint64), np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        b = ((s >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)  # sorted as s is
        first = np.concatenate(([True], b[1:] != b[:-1]))
        value[i, b[first]], full[i, b[first]] = s[first], True
    return value, full


def densified(value: np.ndarray, full: np.ndarray) -> np.ndarray:
    """The values with each empty bin filled from a full one."""
    value = value.copy()
    row, col = np.nonzero(~full)
    tried = np.uint64(0)
    while len(row):
        tried += np.uint64(1)
        donor = (mixed(col.astype(np.uint64) * np.uint64(1 << 32) + tried) % np.uint64(BINS)).astype(np.int64)
        found = full[row, donor]
        value[row[found], col[found]] = value[row[found], donor[found]]
        row, col = row[~found], col[~found]
    return value


def packed(value: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Which bins are full, and two bits of each: three planes of PLANE 64-bit words a row."""
    return np.concatenate([np.packbits(x, axis=1) for x in (full, value & np.uint64(1), value >> np.uint64(1) & np.uint64(1))], axis=1)


def sketch_step(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = shingles(Words(batch.column("text"), lower=True))
    full = [i for i, s in enumerate(sets) if len(s)]
    own, there = binned([sets[i] for i in full])
    bits, value = packed(own, there), densified(own, there)
    mult = seeds(ROWS, 11)
    keys = np.zeros((len(full), BANDS), np.uint64)
    for k in range(ROWS):
        keys += mixed(value[:, k : BANDS * ROWS : ROWS]) * mult[k]
    keys = mixed(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
    low = (value & np.uint64(255)).astype(np.uint8)
    digests, sketches, planes, lengths = [b""] * len(sets), [b""] * len(sets), [b""] * len(sets), np.zeros(len(sets), np.int32)
    for r, i in enumerate(full):
        digests[i], sketches[i], planes[i], lengths[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), low[r].tobytes(), bits[r].tobytes(), BANDS
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id").cast(pa.int64()),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array(digests, pa.binary()),
            pa.array(sketches, pa.binary()),
            pa.array(planes, pa.binary()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1))),
        ],
        names=["doc_id", "n_shingles", "digest", "sketch", "bits", "bands"],
    )


def set_step(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(id, shingles) of the rows whose set is the one that ``digest`` tells of."""
    sets = [s.tobytes() for s in shingles(Words(batch.column("text"), lower=True))]
    own = [i for i, d in enumerate(batch.column("digest").to_pylist()) if xxhash.xxh3_128_digest(sets[i]) == d]
    return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(own, pa.int64())), pa.array([sets[i] for i in own], pa.binary())], names=["id", "shingles"])


PLANE = BINS // 64


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity from planes of bits, and its standard error at 0.75.

    It is the share of bins that agree, of those full in either set. Empty bins are left out rather than
    filled here: of few shingles nearly all stand in bins of their own, and then the estimate is nearly
    exact, so it errs by the shingles that share a bin with others, and by bits that agree by chance,
    once in four.
    """
    fa, fb = a[:, :PLANE], b[:, :PLANE]
    count = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.float64)
    both = fa & fb
    d = a[:, PLANE:] ^ b[:, PLANE:]
    agree, both, either = count(both & ~(d[:, :PLANE] | d[:, PLANE:])), count(both), np.maximum(count(fa | fb), 1)
    s = (agree - both / 4) / 0.75
    of = -BINS * np.log1p(-np.minimum(either, BINS - 0.5) / BINS)  # shingles of both sets
    drawn = 0.1875 / either * np.maximum(of - either, 0) / np.maximum(of - 1, 1)
    chance = np.maximum(both - s, 0) / 3 / either**2
    return s / either, np.sqrt(drawn + chance)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """For each row the first row with the same keys."""
    order = np.lexsort(keys[::-1])
    new = np.concatenate(([True], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)))
    first = np.empty(len(order), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]  # lexsort keeps the order of equal rows
    return first


def spanning(root: np.ndarray, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Which edges (i, j), most alike first, tie the groups ``root`` (each row's first row) to trees."""
    order = np.argsort(s, kind="stable")
    i, j, chosen, root = i[order], j[order], np.zeros(len(i), bool), root.copy()
    while True:
        apart = np.flatnonzero(root[i] != root[j])
        if not len(apart):
            return order[chosen]
        x, y = root[i[apart]], root[j[apart]]
        best = np.full(len(root), -1)
        for k in (x, y):
            np.maximum.at(best, k, apart)  # the later edge is the one more alike
        own = np.flatnonzero(best >= 0)
        e = best[own]
        chosen[e] = True
        other = np.where(root[i[e]] == own, root[j[e]], root[i[e]])
        stay = (best[other] == e) & (own < other)  # of two that chose the same edge, one stays
        to = np.arange(len(root))
        to[own] = np.where(stay, own, other)
        while (to[to] != to).any():
            to = to[to]
        root = to[root]


def compared(group: np.ndarray, n: np.ndarray, comp: np.ndarray, bits: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the pairs to confirm, and whether they are sure to be; rows of a chunk (equal ``group``) come one after the other.

    All that may be alike and are in other components with ``every``, else their stars and trees.
    """
    leader, found = np.arange(len(n)), []
    for d in range(1, int(np.unique(group, return_counts=True)[1].max(initial=1))):
        i = np.flatnonzero(group[d:] == group[:-d])
        j = i + d
        ok = (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])) & (comp[i] != comp[j])
        i, j = i[ok], j[ok]
        s, e = similarity(bits[i], bits[j])
        margin = np.maximum(ERRORS * e, FEW / np.minimum(n[i], n[j]))
        sure = s >= np.minimum(PERCENT / 100 + margin, 0.97)
        leader[j[sure]] = i[sure]  # the last one, the first row of the chunk, stays
        maybe = s >= PERCENT / 100 - margin
        found.append((i[maybe], j[maybe], np.where(sure[maybe], 1.0, 0.0) + s[maybe]))
    i, j, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    if every:
        return i, j, s >= 1 + PERCENT / 100
    star = np.flatnonzero(leader != np.arange(len(n)))
    i, j, s = np.concatenate((i, leader[star])), np.concatenate((j, star)), np.concatenate((s, np.full(len(star), 3.0)))  # stars come first
    tree = spanning(_groups(group, comp), i, j, s)
    return i[tree], j[tree], s[tree] >= 1 + PERCENT / 100


PAIRS = "bucket long, i long, j long, a long, b long"


def _pairs(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
    """PAIRS of chunks (bucket, i, j), whose rows come one after the other; pairs that are sure to be confirmed name no chunk."""

    def out(t: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        bits = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint64).reshape(len(t), 3 * PLANE)
        ids = t["id"].to_numpy()
        x, y, sure = compared(group, t["n"].to_numpy(), t["comp"].to_numpy(), bits, every)
        # many chunks hold the same pairs; chunks are asked for again only where a pair that isn't sure fails
        once = sure | every
        rows = np.stack((*(np.where(once, 0, t[c].to_numpy()[x]) for c in ("bucket", "i", "j")), np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in np.unique(rows, axis=1)], names=["bucket", "i", "j", "a", "b"])

    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
        if not len(t):
            continue
        new = np.zeros(len(t), bool)
        for c in ("bucket", "i", "j"):
            k = t[c].to_numpy()
            new[1:] |= k[1:] != k[:-1]
        group = np.cumsum(new)
        last = int(np.searchsorted(group, group[-1]))  # this chunk may go on in the next batch
        held = t.slice(last)
        if last:
            yield out(t.slice(0, last), group[:last])
    if held is not None and len(held):
        yield out(held, np.zeros(len(held), np.int64))


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        ok = []
        for x, y in zip(p["shingles_a"], p["shingles_b"], strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            small, large = (x, y) if len(x) < len(y) else (y, x)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            both = int((large[at] == small).sum())
            ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield p.loc[ok, ["a", "b"]]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, id, other columns) of (id, shingles, other columns)."""
    for batch in batches:
        sets = [np.frombuffer(b, np.int64) for b in batch.column("shingles").to_pylist()]
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        at = np.repeat(np.arange(len(sets)), n)
        rest = [c for c in batch.schema.names if c != "shingles"]
        for i in range(0, len(at), 1 << 18):
            rows = pa.array(at[i : i + (1 << 18)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)[i : i + (1 << 18)]), *(batch.column(c).take(rows) for c in rest)], names=["shingle", *rest])


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share (of distinct ones)."""
    k, row = len(sets), np.repeat(np.arange(len(sets)), list(map(len, sets)))
    _, code, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(code, kind="stable")
    order = order[held[code[order]] > 1]  # what one set holds is shared with none
    row, code = row[order], code[order]
    held = held[held > 1]
    code = np.repeat(np.arange(len(held)), held)  # shingles are numbered anew, those of one stand together
    both = np.zeros((k, k), np.int64)
    if 80 * int((held**2).sum()) > k * k * len(held):  # pairs of holders (8 ns each) or products (0.1 ns)
        wide = max(1, (1 << 22) // k)  # so many columns at a time
        ends = np.concatenate(([0], np.cumsum(held)))
        for first in range(0, len(held), wide):
            now = slice(ends[first], ends[min(first + wide, len(held))])
            has = np.zeros((k, min(wide, len(held) - first)), np.float32)
            has[row[now], code[now] - first] = 1
            both += (has @ has.T).astype(np.int64)
        return both
    starts, total = np.cumsum(held) - held, np.cumsum(held[code])  # a row meets each holder of its shingle
    at = 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 20), side="right")))
        n = held[code[at:to]]
        other = row[np.repeat(starts[code[at:to]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        both += np.bincount(np.repeat(row[at:to], n) * k + other, minlength=k * k).reshape(k, k)
        at = to
    return both


def overlaps(ids: np.ndarray, n: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(s, t, most) of each two of the sets, both ways: a class with set s, ``most`` shingles or fewer, links to the smallest class of t (``n`` shingles).

    Two classes that share i shingles link if 100 i >= PERCENT (n + m - i).
    """
    both = shared_counts(sets)
    most = (100 + PERCENT) * both // PERCENT - n[None, :]
    x, y = np.nonzero((most >= n[:, None]) & ~np.eye(len(sets), dtype=bool))
    return ids[x], ids[y], most[x, y]


def few_edges(s: np.ndarray, t: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of :func:`overlaps` of a chunk: for each s the pair with the highest limit, and pairs (with the limit -1, for no further
    class) that tie each s to the first one that the chunk's pairs reach from it. So at most two rows for each s."""
    ids, code = np.unique(np.concatenate((s, t)), return_inverse=True)
    i, j = code[: len(s)], code[len(s) :]
    first = np.arange(len(ids))
    while True:  # pairs go both ways
        new = first.copy()
        np.minimum.at(new, i, first[j])
        new = new[new]
        if (new == first).all():
            break
        first = new
    order = np.lexsort((t, most, s))
    best = order[np.concatenate((s[order][1:] != s[order][:-1], [True]))] if len(s) else order
    tied = np.flatnonzero(first != np.arange(len(ids)))
    return np.concatenate((s[best], ids[tied])), np.concatenate((t[best], ids[first[tied]])), np.concatenate((most[best], np.full(len(tied), -1)))


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """:func:`few_edges` of chunks (bucket, i, j), whose rows come one after the other; a chunk has from 2 * BLOCK to 2 * WIDE * BLOCK rows."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        found = few_edges(*overlaps(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[2] for r in rows]))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["s", "t", "most"])

    at, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("often")
        sets = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])
        for *k, id_, n, own in zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j", "id", "sn")), sets, strict=True):
            if k != at:
                if held:
                    yield out(held)
                at, held = k, []
            held.append((id_, n, own))
    if held:
        yield out(held)


class NearDuplicates:
    """The steps above over one table of documents (doc_id, text); ``keys`` are further columns of the result."""

    def __init__(self, docs: DataFrame, *keys: str, block: int = BLOCK):
        self.keys, self.block, self.spent = keys, block, []
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keys)
        self.sketches = materialize(by_steps(self.docs, "text", sketch_step, SKETCHES, keep=keys), "sketches")
        linkable = self.sketches.where("n_shingles > 0 and doc_id is not null")
        # equal sets have equal sizes and sketches, so any row's will do
        same = [F.first(c).alias(n) for c, n in (("n_shingles", "n"), ("sketch", "sketch"), ("bits", "bits"), ("bands", "bands"))]
        classes = linkable.groupBy("digest").agg(F.min("doc_id").alias("doc"), *same)
        self.reps = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "reps")
        let_go(docs.sparkSession)

    def chunks(self, rows: DataFrame, whole: bool) -> tuple[DataFrame, DataFrame | None]:
        """(bucket, i, j, end, id) of the buckets with two rows at least, and (bucket, id) of the large ones. ``whole``: every chunk meets every other."""
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("m"), F.min("id").alias("least"), F.max("id").alias("most")).where("m > 1")
        power = lambda size: F.pow(F.lit(2.0), F.ceil(F.log2(F.col("m") / F.lit(size))))
        dealt = F.least(power(self.block), F.greatest(F.lit(float(SPREAD)), power(WIDE * self.block))) if whole else power(self.block)
        chunks = F.when(F.col("m") <= self.block, 1).otherwise(dealt)
        sizes = materialize(sizes.withColumn("nb", chunks.cast("long")), "sizes")
        end = F.expr("nb > 1 and (id = least or id = most)")
        every = F.expr("nb > 1") if whole else end
        dealt = rows.join(sizes, "bucket").withColumns({"own": F.expr("pmod(xxhash64(bucket, id), nb)"), "end": end, "every": every})
        # the numbers of many chunks come from two short lists
        dealt = dealt.withColumn("hi", F.explode(F.expr("if(every, sequence(0L, (nb - 1) div 1024), array(own div 1024))")))
        dealt = dealt.withColumn("c", F.explode(F.expr("if(every, sequence(hi * 1024, least(hi * 1024 + 1023, nb - 1)), array(own))")))
        i, j = (F.least("c", "own"), F.greatest("c", "own")) if whole else (F.col("c"), F.col("c"))
        dealt = materialize(dealt.select("bucket", i.alias("i"), j.alias("j"), "end", "id", "nb"), "chunks")
        large = dealt.where("nb > 1").select("bucket", "id").distinct()
        self.spent += [sizes, dealt]
        return dealt, None if sizes.where("nb > 1").isEmpty() else large

    def pairs(self, dealt: DataFrame, comps: DataFrame | None, every: bool) -> DataFrame:
        """PAIRS (a < b) to confirm; see :func:`compared`."""
        rows = dealt.drop("nb").join(self.reps.select("id", "n", "bits"), "id")
        rows = rows.withColumn("comp", F.col("id")) if comps is None else rows.join(comps, "id", "left").withColumn("comp", F.coalesce("component", "id"))
        rows = rows.select("bucket", "i", "j", "end", "id", "n", "comp", "bits").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "end", "id")
        return materialize(rows.drop("end").mapInArrow(lambda it: _pairs(it, every), PAIRS), "pairs")

    def linked(self, rows: DataFrame, links: DataFrame | None, comps: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """Links and components after the chunks of ``rows`` (bucket, id), and the rows of large buckets."""
        dealt, large = self.chunks(rows, False)
        found = self.pairs(dealt, comps, False)
        tried = materialize(found.select("a", "b").distinct(), "tried")
        new = self.confirmed(tried)
        links = new if links is None else links.unionByName(new)
        if comps is None or not new.isEmpty():
            comps = materialize(components(links), "components")
        failed = materialize(tried.join(new, ["a", "b"], "left_anti"), "failed")
        if not failed.isEmpty():
            again = found.join(failed, ["a", "b"], "left_semi").select("bucket", "i", "j").distinct()
            # chunks of large buckets are settled as a crowd, if need be
            more = self.pairs(dealt.where("nb = 1").join(again, ["bucket", "i", "j"], "left_semi"), comps, True)
            more = self.confirmed(materialize(more.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "tried"))
            if not more.isEmpty():
                links = links.unionByName(more)
                comps = materialize(components(links), "components")
        self.spent += [found, tried, failed]
        return links, comps, large

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, shingles) of the classes ``ids`` (id)."""
        ids = materialize(self.reps.select("id", "doc", "digest").join(ids, "id", "left_semi"), "ids")
        docs, picked, n = self.docs.select("doc_id", "text"), ids, ids.count()
        if n <= BROADCAST_KEYS:
            picked = F.broadcast(ids)
        else:  # the driver can't hold any number of ids, and not all texts should be shuffled
            docs, _ = sieve(docs, ["doc_id"], ids.select(F.col("doc").alias("doc_id")), n)
        texts = docs.join(picked, F.col("doc_id") == F.col("doc")).select("id", "digest", "text")
        # a doc_id may repeat with the same text
        sets = materialize(by_steps(texts, "text", set_step, "id long, shingles binary").dropDuplicates(["id"]), "sets")
        drop(ids)
        return sets

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        for end in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("id").alias(end), F.col("shingles").alias(f"shingles_{end}")), end)
        links = materialize(pairs.mapInPandas(_linked, "a long, b long").distinct(), "links")
        drop(sets)
        let_go(self.docs.sparkSession)
        return links

    def mixed(self, giants: DataFrame, comps: DataFrame) -> DataFrame:
        """(bucket, id) of the large buckets that hold two components."""
        rows = giants.join(comps, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("comp"))
        apart = rows.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("bucket")
        return materialize(rows.join(apart, "bucket", "left_semi").select("bucket", "id"), "mixed")

    def crowd(self, rows: DataFrame, links: DataFrame, comps: DataFrame) -> DataFrame:
        """Components after all links among the classes of the mixed buckets ``rows`` (bucket, id)."""
        sets = self.sets(rows.select("id").distinct())
        posts = materialize(sets.mapInArrow(_postings, "shingle long, id long"), "postings")
        often = materialize(posts.groupBy("shingle").agg(F.count("*").alias("m")).where(F.col("m") > self.block).select("shingle"), "often")
        picked = F.broadcast(often) if often.count() <= BROADCAST_KEYS else often
        # rare: groups of at most BLOCK ids; many shingles have the same one
        groups = posts.join(picked, "shingle", "left_anti").groupBy("shingle").agg(F.sort_array(F.collect_list("id")).alias("ids")).where("size(ids) > 1").select("ids").distinct()
        rare = materialize(groups.select(F.xxhash64("ids").alias("bucket"), F.explode("ids").alias("id")), "rare")
        links, comps, _ = self.linked(rare, links, comps)
        self.spent += [sets, posts, often, rare]
        left = self.mixed(rows, comps)
        self.spent.append(left)
        if left.isEmpty():
            return comps
        posts = posts.join(left.select("id").distinct(), "id", "left_semi")  # a link still missed lies in a bucket still mixed
        # frequent: a class counts where they alone could make three quarters of it
        h = lambda i: F.bit_xor(F.xxhash64("shingle", F.lit(i)))
        own = posts.join(picked, "shingle", "left_semi").groupBy("id").agg(F.count("*").alias("f"), h(1).alias("x"), h(2).alias("y"))
        own = own.join(self.reps.select("id", "n"), "id").where(100 * F.col("f") >= PERCENT * F.col("n"))
        own = materialize(own, "frequent")
        key = ["f", "x", "y"]
        least = materialize(own.groupBy(*key).agg(F.min(F.struct("n", "id")).alias("s")).select(*key, F.col("s.n").alias("sn"), F.col("s.id").alias("s")), "least")
        within = own.join(least, key).where(F.col("id") != F.col("s")).where(100 * F.col("f") >= PERCENT * (F.col("n") + F.col("sn") - F.col("f")))
        sure = materialize(within.select(F.least("id", "s").alias("a"), F.greatest("id", "s").alias("b")).unionByName(self.across(own, least, sets, picked)), "sure")
        if not sure.isEmpty():
            comps = materialize(components(links.unionByName(sure)), "components")
        self.spent += [own, least]
        return comps

    def across(self, own: DataFrame, least: DataFrame, sets: DataFrame, often: DataFrame) -> DataFrame:
        """Edges (a, b) between classes of different sets of frequent shingles, by these alone.

        Sets A and B link if the smallest class of each does; then each class of A that is small enough links to the smallest
        of B. Of all B that with the highest limit takes every class of A that any B takes.
        """
        window = F.log(F.col("f").cast("double")) / F.lit(2 * float(np.log(4 / 3)))  # linked sets differ by a third at most
        rows = least.select(F.explode(F.array(*(F.xxhash64(F.floor(window + k / 2), F.lit(k)) for k in (0, 1)))).alias("bucket"), F.col("s").alias("id"))
        dealt, _ = self.chunks(rows, True)
        parts = sets.join(least.select(F.col("s").alias("id"), "sn"), "id").mapInArrow(_postings, "shingle long, id long, sn long").join(often, "shingle", "left_semi")
        parts = parts.groupBy("id", "sn").agg(F.sort_array(F.collect_list("shingle")).alias("often"))
        chunk = dealt.drop("nb", "end").join(parts, "id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")
        pairs = materialize(chunk.select("bucket", "i", "j", "id", "sn", "often").mapInArrow(_overlaps, "s long, t long, most long"), "overlaps")
        best = pairs.groupBy("s").agg(F.max(F.struct("most", "t")).alias("best")).select("s", F.col("best.most").alias("most"), F.col("best.t").alias("t"))
        members = own.join(least, ["f", "x", "y"]).join(best, "s").where("n <= most")
        self.spent.append(pairs)
        edges = pairs.select("s", "t").unionByName(members.select(F.col("id").alias("s"), "t"))
        return edges.where("s <> t").select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()

    def components(self) -> DataFrame:
        """(id, component) of the classes that link with another."""
        links, comps, large = self.linked(self.reps.select(F.explode("bands").alias("bucket"), "id"), None, None)
        if large is not None:
            left = self.mixed(large, comps)
            if not left.isEmpty():
                comps = self.crowd(left, links, comps)
            self.spent.append(left)
        while self.spent:
            drop(self.spent.pop())
        let_go(self.docs.sparkSession)
        return comps

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept, part (and ``keys``): a row for every row of the documents.

        part numbers the components, also those whose smallest doc_id is the same; null where nothing links."""
        comps = self.components()
        classes = self.reps.select("id", "digest", "doc").join(comps, "id", "left").select("digest", "doc", F.coalesce("component", "id").alias("comp"))
        least = materialize(classes.groupBy("comp").agg(F.min("doc").alias("component_id")), "least")
        self.found = found = materialize(classes.join(least, "comp").select("digest", "component_id", F.col("comp").alias("part")), "found")
        drop(self.reps)
        drop(comps)
        rows = self.sketches.select("doc_id", "n_shingles", "digest", *self.keys)
        linked = rows.where("n_shingles > 0 and doc_id is not null").join(found, "digest").select("doc_id", "n_shingles", "component_id", "part", *self.keys)
        alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("part"), *self.keys)
        return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

    def clear(self) -> None:
        """Delete the tables that :meth:`result` reads."""
        drop(self.sketches)
        drop(self.found)


def near_duplicates(docs: DataFrame, *keys: str) -> DataFrame:
    """doc_id, n_shingles long, component_id, kept of each row of ``docs`` (doc_id, text), with its columns ``keys``."""
    return NearDuplicates(docs, *keys).result().drop("part")
