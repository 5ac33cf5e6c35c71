"""Encoding and decoding with a SentencePiece vocabulary by single-pass Viterbi.

An Aho-Corasick automaton holds all pieces. At each character, its output links name every
piece that ends there; each relaxes the best score at that position. A character that is in
no piece alone costs FALLBACK for each of its UTF-8 bytes and becomes byte pieces. Of equal
scores, the longest last piece wins.

Text begins with one extra space; spaces become U+2581. That mark itself in a text is written
as byte pieces, so decoding gives back every text exactly. Nothing else is normalised.

Texts are cut before a space that follows another character, and around line feeds, where
the vocabulary has no piece that reaches over such a place (checked when it is loaded); the
best path of a text is then the best paths of its parts. The vocabulary in use holds ranks of
merges for scores, so the ids are those of the best path by these scores, not those that a
merging encoder of the same vocabulary gives; decoding is the same for both. Null encodes as an empty text, and
an empty text to no ids.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypath.llm.shared import by_steps
from waypath.llm.tokens import Pieces, of

MARK = "▁"
FALLBACK = 10.0  # below the lowest score of a piece
UNSCORED = -1e8  # a model gives pieces outside its ranking (runs of spaces) a score below this


class Automaton:
    """Aho-Corasick over pieces: transitions, and for each node the pieces that end there, longest first."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        self.next: list[dict[str, int]] = [{}]
        ends: list[tuple[int, int, float] | None] = [None]
        for text, (i, score) in pieces.items():
            at = 0
            for c in text:
                at = self.next[at].setdefault(c, len(self.next))
                if at == len(self.next):
                    self.next.append({})
                    ends.append(None)
            ends[at] = len(text), i, score
        self.fail = [0] * len(self.next)
        #: of each node, (length, id, score) of its own piece and of those along its output links
        self.out: list[tuple[tuple[int, int, float], ...]] = [()] * len(self.next)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            for c, to in self.next[at].items():
                back = self.fail[at]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[to] = self.next[back].get(c, 0) if at else 0
                self.out[to] = ((ends[to],) if ends[to] else ()) + self.out[self.fail[to]]
                queue.append(to)

    def step(self, at: int, c: str) -> int:
        while at and c not in self.next[at]:
            at = self.fail[at]
        return self.next[at].get(c, 0)


class Vocabulary(Pieces):
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        super().__init__()
        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self._take({model.id_to_piece(i): (i, model.get_score(i)) for i in plain}, {int(model.id_to_piece(i)[3:-1], 16): i for i in range(n) if model.is_byte(i)})

    @classmethod
    def made(cls, pieces: dict[str, tuple[int, float]], byte_ids: dict[int, int]) -> "Vocabulary":
        """A vocabulary from pieces (id, score) and the ids of all 256 bytes."""
        self = cls.__new__(cls)
        Pieces.__init__(self)
        self._take(pieces, byte_ids)
        return self

    def _take(self, pieces: dict[str, tuple[int, float]], byte_ids: dict[int, int]) -> None:
        if len(byte_ids) != 256:
            raise ValueError("the vocabulary lacks byte pieces")
        self.pieces, self.byte_ids = pieces, byte_ids
        self.automaton = Automaton(pieces)
        self.lowest = min((s for _, s in pieces.values() if s > UNSCORED), default=0.0) - FALLBACK
        self.bytes_of = {i: p.replace(MARK, " ").encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in byte_ids.items()}
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.fallback = np.zeros(len(self.table), bool)
        self.fallback[list(byte_ids.values())] = True
        self.at_spaces = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.at_feeds = not any("\n" in p for p in pieces)

    def cuts(self, data: np.ndarray) -> list[np.ndarray]:
        out = []
        if self.at_spaces:
            out.append(np.flatnonzero((data[1:] == 0x20) & (data[:-1] != 0x20)) + 1)
        if self.at_feeds:
            feed = np.flatnonzero(data == 0x0A)
            out += [feed, feed + 1]
        return out

    def best(self, text: str) -> list[int]:
        """Ids of the best path over a marked text."""
        n = len(text)
        score, last = [0.0] + [-np.inf] * n, [(0, 0)] * (n + 1)  # of each position: best score, (length, id) that leads there
        step, out, at = self.automaton.step, self.automaton.out, 0
        lowest, single = self.lowest, self.pieces
        for i, c in enumerate(text, 1):
            at = step(at, c)
            if c not in single:
                score[i], last[i] = score[i - 1] + lowest * len(c.encode()), (1, -1)
            for length, piece, s in out[at]:
                if score[i - length] + s > score[i]:
                    score[i], last[i] = score[i - length] + s, (length, piece)
        ids: list[int] = []
        while n:
            length, piece = last[n]
            ids += [piece] if piece >= 0 else [self.byte_ids[b] for b in reversed(text[n - 1].encode())]
            n -= length
        return ids[::-1]

    def one(self, piece: str) -> list[int]:
        """Ids of a part of a text; a mark in it is written as bytes."""
        ids: list[int] = []
        for k, part in enumerate(piece.split(MARK)):
            ids += [self.byte_ids[b] for b in MARK.encode()] * (k > 0) + (self.best(part.replace(" ", MARK)) if part else [])
        return ids

    def encode(self, pieces: list[str]) -> list[bytes]:
        return [np.array(self.one(p), "<u4").tobytes() for p in pieces]

    def texts_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text with its extra space, and where they start; none for an empty text."""
        texts = pc.fill_null(texts, "")
        return self.ids(pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, "")))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the extra space."""
        return b"".join(map(self.table.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (array of int) of each row of ``docs`` (doc_id, text)."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, starts = of(Vocabulary, model).texts_ids(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return by_steps(_rows(docs), "text", step, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of each row of ``encoded`` (doc_id, ids); null ids give a null text."""

    def run(batches):
        for batch in batches:
            v = of(Vocabulary, model)
            texts = [None if x is None else v.decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, n_bytes (byte pieces) long, ids_crc32 long, restored: whether decoding the ids gives the text back."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = of(Vocabulary, model)
        ids, starts = v.texts_ids(batch.column("text"))
        ids = ids.astype("<u4")
        spans = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
        total = np.concatenate(([0], np.cumsum(v.fallback[ids])))
        same = [v.decode(ids[a:b]) == (t or "") for (a, b), t in zip(spans, batch.column("text").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(starts)), pa.array(np.diff(total[starts])), pa.array([zlib.crc32(ids[a:b]) for a, b in spans], pa.int64()), pa.array(same)],
            names=["doc_id", "n_pieces", "n_bytes", "ids_crc32", "restored"],
        )

    return by_steps(_rows(docs), "text", step, "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, restored boolean")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
