"""Packing token sequences: full windows first, then best-fit decreasing per group.

1. Every document is turned into token ids (plus one end id) inside its task; only piece
   boundaries and checksums leave it. An overlong document is cut into full windows of
   ``window`` ids; each full window is a sequence of its own. What remains is one piece
   shorter than the window.
2. Boundaries are written; a row's place in that table is its number, which a repeated task can't
   change. Rows are dealt to groups by a hash of that number, about ``GROUP_DOCS`` documents
   each, so rows that repeat id and text spread like any others. Groups share the session's
   shuffle partitions; a task packs one group after the other.
3. In a group, pieces go in decreasing length to the open sequence with the least room that
   still fits, found by a segment tree over remaining capacity. Ties go by (doc_id, number),
   so a repeated task gives the same sequences.

Every group leaves a few sequences open, so padding stays a fraction of a percent whatever
the size of the corpus. A null text is empty and gives the end id alone. Rows that share a
doc_id are packed each. A sequence id is group * 2^32 + its number in the group.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypath.llm.shared import by_steps, materialize
from waypath.llm.tokens import ByteBpe, of

WINDOW, END_ID = 1024, 0
#: Documents to a group; a group is packed by one task.
GROUP_DOCS = 8_000
#: Bytes of text that are turned into ids at a time.
STEP = 2 << 20

CUTS = "doc_id long, no_id boolean, doc_tokens long, crcs array<long>"
PIECES = "doc_id long, no_id boolean, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class BestFit:
    """Open sequences by remaining capacity: a segment tree of counts over 1..window.

    ``place`` gives the number and the offset of the tightest sequence with room for n, and
    opens one if there is none.
    """

    def __init__(self, window: int):
        self.window, self.size = window, 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.made = 0

    def _add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.tree[at] += by
            at >>= 1

    def _least(self, n: int) -> int:
        """The least room >= n of an open sequence, or 0."""
        at = n + self.size
        if self.tree[at]:
            return n
        while at > 1:
            if not at & 1 and self.tree[at + 1]:  # the sibling to the right holds larger rooms
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return 0

    def place(self, n: int) -> tuple[int, int]:
        room = self._least(n)
        if room:
            number = self.open[room].pop()
            self._add(room, -1)
        else:
            number, room = self.made, self.window
            self.made += 1
        if room > n:
            self.open[room - n].append(number)
            self._add(room - n, 1)
        return number, self.window - room


def cutter(tokenizer: str, window: int, end_id: int):
    """Rows of text to rows of CUTS: checksums of each full window and of the rest, in order."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, starts = of(ByteBpe, tokenizer).ids(batch.column("text"))
        totals, crcs = [], []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            ids = np.append(flat[a:b], end_id).astype("<u4")
            totals.append(len(ids))
            crcs.append([zlib.crc32(ids[i : i + window]) for i in range(0, len(ids), window)])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("no_id"), pa.array(totals, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "no_id", "doc_tokens", "crcs"])

    return cut


def packer(window: int):
    def pack(p: pd.DataFrame) -> pd.DataFrame:
        """Sequences of one group: first its full windows in order of documents, then best fit of the rests."""
        p = p.sort_values(["doc_id", "no_id", "row"], kind="stable")
        total = p["doc_tokens"].to_numpy()
        n_full = total // window
        rest = total - n_full * window
        group, made = int(p["group"].iloc[0]) << 32, int(n_full.sum())
        ids, no_id, crcs = p["doc_id"].to_numpy(), p["no_id"].to_numpy(), p["crcs"].to_numpy()
        row = np.repeat(np.arange(len(p)), n_full)
        nth = np.arange(made) - np.repeat(np.cumsum(n_full) - n_full, n_full)
        full = pd.DataFrame({"doc_id": ids[row], "no_id": no_id[row], "start": nth * window, "length": window, "ids_crc32": [crcs[r][k] for r, k in zip(row, nth, strict=True)], "doc_tokens": total[row], "sequence_id": group + np.arange(made), "offset": 0})
        fit = BestFit(window)
        order = np.argsort(-rest, kind="stable")
        order = order[rest[order] > 0]
        placed = [fit.place(int(rest[i])) for i in order]
        number, offset = (np.array([x[k] for x in placed], np.int64) for k in (0, 1))
        tail = pd.DataFrame({"doc_id": ids[order], "no_id": no_id[order], "start": n_full[order] * window, "length": rest[order], "ids_crc32": [crcs[i][-1] for i in order], "doc_tokens": total[order], "sequence_id": group + made + number, "offset": offset})
        return pd.concat([full, tail], ignore_index=True)

    return pack


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, group_docs: int = GROUP_DOCS) -> DataFrame:
    """PIECES of all ``docs`` (doc_id, text): one row per piece, with its place in a sequence."""
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("no_id"), F.col("text").cast("string").alias("text"))
    cuts = by_steps(rows, "text", cutter(tokenizer, window, end_id), CUTS, STEP)
    cuts = materialize(cuts.withColumn("row", F.monotonically_increasing_id()), "cuts")
    groups = max(1, -(-cuts.count() // group_docs))
    dealt = cuts.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    pieces = dealt.groupBy("group").applyInPandas(packer(window), PIECES)
    return pieces.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
