"""Token ids of whole texts by way of their distinct pieces.

A column of texts is cut where a tokenizer never merges, each distinct piece is encoded
once, and the ids are laid out again in order.
"""

from __future__ import annotations

import os
import string
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from waypath.llm.shared import FORGET

#: Distinct pieces a worker remembers: two generations of half as many, the older one dropped when the younger is full.
MEMORY = 400_000
#: A longer piece (a text without spaces) isn't remembered.
LONGEST = 200
#: Pieces given to a tokenizer in one call.
AT_ONCE = 2000


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 in one array, and where each starts (one more than texts); null is empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, values = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]] if values else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


class Pieces:
    """What encoders by pieces share: subclasses give ``cuts`` and ``encode``."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def cuts(self, data: np.ndarray) -> list[np.ndarray]:
        """Offsets in ``data`` where a piece may start, besides the starts of texts."""
        raise NotImplementedError

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit numbers."""
        raise NotImplementedError

    def _known(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.young.get, pieces))
        missing = [i for i, x in enumerate(found) if x is None]
        new = []
        for i in missing:
            x = self.old.get(pieces[i])
            if x is None:
                new.append(i)
            else:
                found[i] = self.young[pieces[i]] = x
        for i, x in zip(new, self.encode([pieces[i] for i in new]), strict=True):
            found[i] = x
            if len(pieces[i]) <= LONGEST:
                self.young[pieces[i]] = x
        if len(self.young) > MEMORY // 2:
            self.old, self.young = self.young, {}
        return found

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's ids start (one more than texts)."""
        data, bounds = buffers(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        cuts = np.concatenate((bounds, *self.cuts(data)))
        cuts.sort()
        cuts = cuts[np.concatenate(([True], cuts[1:] != cuts[:-1]))]
        coded = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        codes, each = coded.indices.to_numpy(), self._known(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, each), np.int64, len(each)) >> 2
        flat = np.frombuffer(b"".join(each), "<u4")
        first = np.cumsum(sizes) - sizes
        n = sizes[codes]
        ends = np.cumsum(n)
        out = flat[np.repeat(first[codes] - (ends - n), n) + np.arange(ends[-1])]
        return out, np.concatenate(([0], ends))[np.searchsorted(cuts, bounds)]


_MADE: dict[tuple[type, str], Pieces] = {}


def _forget() -> None:
    for made in _MADE.values():
        made.young, made.old = {}, {}


FORGET.append(_forget)


def of(kind: type, path: str) -> Pieces:
    """The worker's encoder of a file, which keeps its memory from batch to batch of a task."""
    if (kind, path) not in _MADE:
        _MADE[kind, path] = kind(path)
    return _MADE[kind, path]


class ByteBpe(Pieces):
    """A byte-level BPE of the tokenizers library.

    Its pattern starts a new part before a space or line feed between two visible characters,
    after that line feed, and before a sign (but ' and |) that follows a letter, whatever surrounds
    them; parts are encoded each for themselves. Where the neighbours aren't plainly
    visible characters, the text is left whole, which is slower and gives the same ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one worker per core
        self.tokenizer = Tokenizer.from_file(path)
        for t in self.tokenizer.get_added_tokens_decoder().values():
            if any(len(c) for c in self.cuts(np.frombuffer(t.content.encode(), np.uint8))):
                raise ValueError(f"texts may be cut inside the special token {t.content!r}")

    def cuts(self, data: np.ndarray) -> list[np.ndarray]:
        if len(data) < 3:
            return []
        visible = (data > 0x20) & (data < 0x7F)
        lead = (data >= 0xC3) & (data <= 0xDF)  # of a letter from U+00C0 to U+07FF, or a sign; never white space
        ends, begins = visible.copy(), visible | lead
        ends[1:] |= lead[:-1]
        feed = data[1:-1] == 0x0A
        at = np.flatnonzero((feed | (data[1:-1] == 0x20)) & ends[:-2] & begins[2:]) + 1
        low = data | 0x20
        letter = (low >= 0x61) & (low <= 0x7A)
        mark = _MARKS[data[1:]] & letter[:-1]
        return [at, at[data[at] == 0x0A] + 1, np.flatnonzero(mark) + 1]

    def encode(self, pieces: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(pieces), AT_ONCE):  # the library's own results take many times the ids
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces[i : i + AT_ONCE], add_special_tokens=False)]
        return out


_MARKS = np.zeros(256, bool)
_MARKS[[b for b in string.punctuation.encode() if b not in b"'|"]] = True
