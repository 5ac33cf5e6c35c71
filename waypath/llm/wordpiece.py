"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie with two roots: one for pieces that start a word, one for pieces
that go on in it. Every node has a failure link (the node of what is left once the longest
matches have been taken off) and the number of pieces that are popped on the way. Reading a
word moves along the trie, and along failure links where it ends, adding popped counts; so
a word costs steps in proportion to its length and no piece is ever built.

A word at which the greedy match gets stuck counts as one unknown piece, whatever part of it
was matched before.
Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has no words and no tokens.
"""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypath.llm.shared import FORGET, Words, by_steps

#: Distinct words whose counts a worker remembers, in two generations.
MEMORY = 400_000
LONGEST = 200


class LongestMatch:
    """The automaton over bytes. ``starts`` begin a word, ``parts`` go on in it."""

    def __init__(self, starts: list[bytes], parts: list[bytes]):
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        self.fail: list[int] = [-1, -1]  # the roots: 0 of starts, 1 of parts
        self.pops: list[int] = [0, 0]
        piece = [False, False]
        for root, pieces in ((0, starts), (1, parts)):
            for p in pieces:
                at = root
                for c in p:
                    key = at << 8 | c
                    if key not in self.child:
                        self.child[key] = len(self.fail)
                        self.fail.append(-1)
                        self.pops.append(0)
                        piece.append(False)
                    at = self.child[key]
                piece[at] = piece[at] or at > 1
        below: dict[int, list[tuple[int, int]]] = {}
        for key, to in self.child.items():
            below.setdefault(key >> 8, []).append((key & 255, to))
        queue = deque([0, 1])
        while queue:  # by rising length, so that links of shorter strings are there
            at = queue.popleft()
            for c, to in below.get(at, ()):
                if piece[to]:
                    self.fail[to], self.pops[to] = 1, 1
                else:
                    back, pops = self.fail[at], self.pops[at]
                    while back >= 0 and (back << 8 | c) not in self.child:
                        pops += self.pops[back]
                        back = self.fail[back]
                    if back >= 0:
                        self.fail[to], self.pops[to] = self.child[back << 8 | c], pops
                queue.append(to)

    def count(self, word: bytes) -> int:
        """The number of pieces of a word; 0 if it can't be covered."""
        child, fail, pops = self.child, self.fail, self.pops
        at = total = 0
        for c in word:
            while (to := child.get(at << 8 | c)) is None:
                total += pops[at]
                at = fail[at]
                if at < 0:
                    return 0
            at = to
        while at != 1:
            total += pops[at]
            at = fail[at]
            if at < 0:
                return 0
        return total


def byte_level(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces of a byte-level vocabulary file: those with a leading space start a word, the rest go on in one."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    pieces = [bytes(byte[c] for c in p) for p in vocabulary if all(c in byte for c in p)]
    return [p[1:] for p in pieces if p[:1] == b" " and len(p) > 1], [p for p in pieces if p[:1] != b" "]


class Counter:
    """Counts of words with a bounded memory; one per worker and file."""

    _made: dict[str, "Counter"] = {}

    @classmethod
    def of(cls, path: str) -> "Counter":
        if path not in cls._made:
            cls._made[path] = cls(LongestMatch(*byte_level(path)))
        return cls._made[path]

    def __init__(self, automaton: LongestMatch):
        self.automaton = automaton
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def counts(self, words: list[bytes]) -> np.ndarray:
        young, old, count = self.young, self.old, self.automaton.count
        out = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            n = young.get(w)
            if n is None:
                n = old.get(w)
                n = count(w) if n is None else n
                if len(w) <= LONGEST:
                    young[w] = n
            out[i] = n
        if len(young) > MEMORY // 2:
            self.old, self.young = young, {}
        return out


def _forget() -> None:
    for made in Counter._made.values():
        made.young, made.old = {}, {}


FORGET.append(_forget)


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown (long) of each row of ``docs`` (doc_id, text)."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column("text"))
        n = Counter.of(vocabulary).counts(words.distinct)
        each = n[words.codes] if len(words.codes) else np.zeros(0, np.int64)
        total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[words.starts])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(words.counts()), pa.array(total(np.maximum(each, 1))), pa.array(total((each == 0).astype(np.int64)))], names=["doc_id", "n_words", "n_tokens", "n_unknown"]
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return by_steps(rows, "text", step, "doc_id long, n_words long, n_tokens long, n_unknown long")
