"""Near-duplicates by SimHash, found through the binary Golay code.

1. A text gives one fingerprint of 64 bits: a bit is 1 if it is set in over half of the hashes (XXH64, seed 42) of
   its 3-word shingles, repeats included. Under three words the whole sequence is one shingle; without words the
   fingerprint is zero, and links like any other.
2. Rows with equal fingerprints are a class; one row a class goes on, so thousands of copies cost one row.
3. A fingerprint is cut into segments of 23, 23 and 18 bits (the last filled up with zeros). The Golay code has
   exactly one codeword within three bits of every 23-bit word: the segment's own codeword. All codewords within four
   bits are its near ones: one for a word up to two bits from its own codeword, else six (its own and five at four bits).
   If two words differ in one bit at most, the own codeword of each is among the near ones of the other.
4. Of three errors over three segments either none has more than one, or one segment is equal and another has
   one at most (pigeonhole). So a class has seven home keys - its three own codewords together, and each segment
   itself with the own codeword of each other one - and as probe keys all combinations of near codewords in
   their place (182 on average). Home and probe keys meet in a join, where at most 3 differing bits are verified.
   No link is missed; a key has 30 to 36 bits, so that unlike classes hardly meet.
5. A key of over BLOCK homes would make a link of every two rows in it. Its homes are dealt to chunks of about
   BLOCK, probes go to each of them, and a chunk gives edges that join what it links: no more than it has rows.
6. Edges give components, components the smallest doc_id.

A null text has no words. Rows that repeat a doc_id are each judged by their own text. A null doc_id
takes part with its fingerprint; its component_id is the component's smallest id, null if it has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypath.llm.graph import components
from waypath.llm.shared import Words, by_steps, drop, materialize

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Homes of a key that are joined as they are.
BLOCK = 256
#: Fixed value: the generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LENGTH = 23
#: First bit and bits of each segment.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Shingles whose bits are counted at a time.
PIECE = 1 << 18


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every shingle, repeats included, and where each text's shingles begin (one more than texts)."""
    words = Words(texts, lower=True)
    flat = pa.DictionaryArray.from_arrays(pa.array(words.codes), pa.array(words.distinct, pa.binary())).dictionary_decode()
    spaced = pc.binary_join_element_wise(flat.cast(pa.large_binary()), pa.scalar(b" ", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    _, offsets, values = spaced.buffers()
    at = np.frombuffer(offsets, np.int64)[: len(spaced) + 1]
    data = values.to_pybytes() if values else b""
    n = words.counts()
    shingles = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    starts = np.concatenate(([0], np.cumsum(shingles)))
    first = np.repeat(words.starts[:-1] - starts[:-1], shingles) + np.arange(starts[-1])
    last = first + np.repeat(np.minimum(n, SHINGLE), shingles)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(data[s:e], SEED) for s, e in zip(at[first].tolist(), (at[last] - 1).tolist(), strict=True)), np.uint64, len(first)), starts


def fingerprints(texts: pa.Array) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text."""
    h, starts = shingle_hashes(texts)
    n = np.diff(starts)
    counts = np.zeros((len(n), 64), np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    for i in range(0, len(h), PIECE):
        part, own = h[i : i + PIECE], owner[i : i + PIECE]
        new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts[own[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int32)
    set_ = 2 * counts > n[:, None]
    return np.packbits(set_, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprint_step(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = fingerprints(batch.column("text")).view(np.int64)
    return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found)], names=["doc_id", "fp"])


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the three bytes of a word; the errors (own codeword's first) of each syndrome, and how many it has."""
    of_bit, x = [], 1
    for _ in range(24):
        of_bit.append(x)
        x <<= 1
        if x >> 11:
            x ^= GENERATOR
    of_bit[LENGTH] = 0  # not part of a word
    syndromes = np.zeros((3, 256), np.int64)
    for byte in range(3):
        for bit in range(8):
            syndromes[byte, np.arange(256) >> bit & 1 == 1] ^= of_bit[8 * byte + bit]
    errors, count = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            s, e = 0, 0
            for b in bits:
                s, e = s ^ of_bit[b], e | 1 << b
            # a word up to two bits from its codeword has no other within four
            if weight < 4 or bin(errors[s, 0]).count("1") == 3:
                errors[s, count[s]] = e
                count[s] += 1
    return syndromes, errors, count


_SYNDROMES, _ERRORS, _COUNT = _tables()


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Six 12-bit codeword indices for each 23-bit word, its own first, and how many of them count (1 or 6)."""
    s = _SYNDROMES[0][words & 255] ^ _SYNDROMES[1][words >> 8 & 255] ^ _SYNDROMES[2][words >> 16]
    return (words[:, None] ^ _ERRORS[s]) >> 11, _COUNT[s]


SEGMENTED = "fp long, seg array<int>, near0 array<int>, near1 array<int>, near2 array<int>"


def segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of each fingerprint and their near codewords, own ones first."""
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        segs, lists = [], []
        for first, bits in SEGMENTS:
            w = (fp >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype(np.int64)
            index, count = near_codewords(w)
            segs.append(w)
            ends = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(index[np.arange(6) < count[:, None]].astype(np.int32))))
        seg = np.stack(segs, axis=1).astype(np.int32)
        seg = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(fp) + 1, 3, dtype=np.int32)), pa.array(seg.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column("fp"), seg, *lists], names=["fp", "seg", "near0", "near1", "near2"])


def _whole(a: Column, b: Column, c: Column) -> Column:
    """Key of three codewords."""
    return (a.cast("long") * 4096 + b) * 4096 + c


#: (equal segment, near segment) of the other kinds of keys.
MIXED = [(x, y) for x in range(3) for y in range(3) if x != y]


def _mixed(kind: int, x: int, codeword: Column) -> Column:
    """Key of segment ``x`` and a codeword of another one."""
    return F.lit((kind + 1) << 40).cast("long") + F.col("seg")[x].cast("long") * 4096 + codeword


def homes(classes: DataFrame) -> DataFrame:
    """(key, fp): seven rows a class."""
    own = lambda y: F.col(f"near{y}")[0]
    keys = [_whole(own(0), own(1), own(2)), *(_mixed(k, x, own(y)) for k, (x, y) in enumerate(MIXED))]
    return classes.select(F.explode(F.array(*keys)).alias("key"), "fp")


def probes(classes: DataFrame) -> DataFrame:
    """(key, fp): every combination of near codewords."""
    of = lambda k, x, y: F.transform(f"near{y}", lambda c: _mixed(k, x, c))
    mixed = classes.select(F.explode(F.concat(*(of(k, x, y) for k, (x, y) in enumerate(MIXED)))).alias("key"), "fp")
    whole = classes.withColumn("a", F.explode("near0")).withColumn("b", F.explode("near1")).withColumn("c", F.explode("near2"))
    return whole.select(_whole(F.col("a"), F.col("b"), F.col("c")).alias("key"), "fp").unionByName(mixed)


def joined(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``labels`` (each the smallest row of its group) after groups of rows i and j have become one."""
    while True:
        x, y = labels[i], labels[j]
        apart = x != y
        if not apart.any():
            return labels
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        to = np.arange(len(labels))
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while (to[to] != to).any():
            to = to[to]
        labels = to[labels]


def chunk_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of chunks (key, c); a chunk's rows come one after the other, its homes first.

    A probe gives an edge to one home that it links, homes give one when a probe joins two groups of them.
    """
    at, own, labels = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "c", "probe", "fp")]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:2]], axis=0)) + 1 if batch.num_rows else []
        for rows in zip(*(np.split(c, edge) for c in cols), strict=True):
            if not len(rows[0]):
                continue
            if (k := (rows[0][0], rows[1][0])) != at:
                at, own, labels = k, np.zeros(0, np.int64), np.zeros(0, np.int64)
            new = rows[3][~rows[2]]
            own, labels = np.concatenate((own, new)), np.concatenate((labels, np.arange(len(own), len(own) + len(new))))
            asks = rows[3][rows[2]]
            for p in range(0, len(asks) if len(own) else 0, 1024):
                part = asks[p : p + 1024]
                both = np.concatenate((labels, np.arange(len(own), len(own) + len(part))))
                for h in range(0, len(own), 1024):
                    i, j = np.nonzero(np.bitwise_count((own[h : h + 1024, None] ^ part[None, :]).view(np.uint64)) <= DISTANCE)  # of a signed one it would take the absolute value
                    both = joined(both, i + h, j + len(own))
                a, b = np.concatenate((own, part)), np.concatenate((own, part))[both]
                moved = np.concatenate((both[: len(own)] != labels, both[len(own) :] != np.arange(len(own), len(both)))) & (a != b)
                labels = both[: len(own)]
                yield pa.RecordBatch.from_arrays([pa.array(a[moved]), pa.array(b[moved])], names=["a", "b"])


def links(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between fingerprints whose components are those of all links."""
    home = homes(classes)
    home = home.join(home.groupBy("key").agg(F.count("*").alias("m")), "key")
    ask = probes(classes).withColumnRenamed("fp", "b")
    few = home.where(F.col("m") <= block).select("key", F.col("fp").alias("a"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)  # either way round a link is found
    found = ask.join(few, "key").where(near).select("a", "b").distinct()
    chunks = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("m") / F.lit(block)))).cast("long")
    many = materialize(home.where(F.col("m") > block).select("key", "fp", chunks.alias("nb")), "homes")
    if many.isEmpty():
        drop(many)
        return found
    own = many.select("key", F.expr("pmod(xxhash64(fp), nb)").alias("c"), F.lit(False).alias("probe"), "fp")
    asked = ask.join(many.select("key", "nb").distinct(), "key")
    asked = asked.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("c"), F.lit(True).alias("probe"), F.col("b").alias("fp"))
    rows = own.unionByName(asked).repartition("key", "c").sortWithinPartitions("key", "c", "probe")
    return found.unionByName(rows.mapInArrow(chunk_edges, "a long, b long"))


def near_duplicates(docs: DataFrame, *keep: str, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row of ``docs`` (doc_id, text), with its columns ``keep``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    rows = materialize(by_steps(docs, "text", fingerprint_step, "doc_id long, fp long", keep=keep), "fingerprints")
    alike = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("doc")), "classes")
    classes = materialize(alike.select("fp").repartition("fp").mapInArrow(segmented, SEGMENTED), "segments")
    edges = materialize(links(classes, block), "links")
    comps = materialize(components(edges), "components")
    of = alike.join(comps, alike["fp"] == comps["id"], "left").select("fp", "doc", F.coalesce("component", "fp").alias("component"))
    least = of.groupBy("component").agg(F.min("doc").alias("component_id"))
    found = materialize(of.join(least, "component").select("fp", "component_id"), "found")
    for used in (alike, classes, edges, comps):
        drop(used)
    return rows.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *keep)
