"""A gated recurrent network over token ids with a class-factored softmax, in numpy.

Ids: the shortlist's words, one id for the other words of each class, the end of a text, and
the start (only ever read). Output: a softmax over classes (and the end), then one over the
slots of the class: its shortlist words and one slot for all its other words.

Texts are handled side by side, longest first, so the rows still running are always the
first ones. The state goes on from window to window of a text, in scoring and in training;
gradients stop at a window's start.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

HIDDEN = 18
WINDOW = 24
#: Texts side by side in training and in scoring.
LANES, SCORING_LANES = 256, 512
STRETCH = 512  # tokens of each text that training takes before it goes on with the next ones of the same texts
CLIP = 1.0


@dataclass
class Layout:
    """Where words stand. class_of and slot_of: of each id (not the start); first: a class's first slot."""

    class_of: np.ndarray
    slot_of: np.ndarray
    first: np.ndarray  # one more than classes, the end's class included

    @property
    def ids(self) -> int:
        return len(self.class_of) + 1

    @property
    def start(self) -> int:
        return len(self.class_of)

    @property
    def end(self) -> int:
        return len(self.class_of) - 1

    @property
    def classes(self) -> int:
        return len(self.first) - 1


SHAPES = ("x", "u", "b", "oc", "bc", "os", "bs")


def shapes(at: Layout, hidden: int = HIDDEN) -> dict[str, tuple[int, ...]]:
    h, slots = hidden, int(at.first[-1])
    return {"x": (at.ids, 3 * h), "u": (h, 3 * h), "b": (3 * h,), "oc": (h, at.classes), "bc": (at.classes,), "os": (h, slots), "bs": (slots,)}


def initial(at: Layout, counts: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Small random weights; output biases that give each slot its share in ``counts`` (of ids)."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * (0.1 if k == "x" else 0.2)).astype(np.float32) for k, s in shapes(at).items()}
    slots = np.zeros(int(at.first[-1]))
    slots[at.first[at.class_of] + at.slot_of] = counts + 0.5
    by_class = np.add.reduceat(slots, at.first[:-1])
    p["bs"] = np.log(slots / np.repeat(by_class, np.diff(at.first))).astype(np.float32)
    p["bc"] = np.log(by_class / by_class.sum()).astype(np.float32)
    p["b"][:] = 0
    p["oc"] *= 0.1
    p["os"] *= 0.1
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unflat(v: np.ndarray, at: Layout) -> dict[str, np.ndarray]:
    out, i = {}, 0
    for k, s in shapes(at).items():
        n = int(np.prod(s))
        out[k] = v[i : i + n].reshape(s).astype(np.float32)
        i += n
    return out


class Net:
    """Inside, units are rows and tokens columns, so that every sum and product runs along memory."""

    def __init__(self, at: Layout, p: dict[str, np.ndarray]):
        self.at, self.p = at, p
        self._kept: dict[str, np.ndarray] = {}

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """Memory that is used again from window to window: fresh pages cost more than what is done in them."""
        n, room = math.prod(shape), self._kept.get(name)
        if room is None or len(room) < n:
            room = self._kept[name] = np.empty(n, self.p["u"].dtype)
        return room[:n].reshape(shape)

    def _forward(self, ids: list[np.ndarray], h: np.ndarray, learn: bool = True) -> tuple[np.ndarray, list[tuple]]:
        """States after each step's inputs and, with ``learn``, what led to them; ``h`` is left at the last one, for the rows that still run there."""
        p, n2, n3 = self.p, 2 * h.shape[1], h.shape[1]
        zx, u = np.ascontiguousarray((p["x"] + p["b"]).T), np.ascontiguousarray(p["u"].T)
        np.negative(zx[:n2], out=zx[:n2])  # gates are 1 / (1 + exp(-z))
        np.negative(u[:n2], out=u[:n2])
        total, most = sum(map(len, ids)), len(ids[0])
        states, saved = self._room("states", n3, total), []
        inputs, taken = (self._room(k, m * (total if learn else most)) for k, m in (("inputs", 3 * n3), ("taken", n3)))
        j, old = 0, h.T.copy()
        for x in ids:
            n, k = len(x), j if learn else 0
            old, new = old[:, :n], states[:, j : j + n]
            z, hc, zh, part = inputs[3 * n3 * k :][: 3 * n3 * n].reshape(-1, n), taken[n3 * k :][: n3 * n].reshape(-1, n), self._room("zh", 3 * n3, n), self._room("part", n3, n)
            np.take(zx, x, axis=1, out=z, mode="clip")
            np.matmul(u, old, out=zh)
            g, c = z[:n2], z[n2:]
            g += zh[:n2]
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            r, keep = g[:n3], g[n3:]
            if learn:
                hc[:] = zh[n2:]
            np.multiply(r, zh[n2:], out=part)
            c += part
            np.tanh(c, out=c)
            np.subtract(old, c, out=part)
            part *= keep
            np.add(part, c, out=new)
            saved.append((old, r, keep, hc, c))
            j, old = j + n, new
        h[: old.shape[1]] = old.T
        return states.T, saved

    def _outputs(self, s: np.ndarray, targets: np.ndarray, learn: bool):
        """log-probability of each target; with ``learn`` also gradients of their sum's negative.

        Tokens stand in the order of their classes, so that a class's tokens are one slice.
        """
        p, at = self.p, self.at
        c = at.class_of[targets].astype(np.int16)
        order = np.argsort(c, kind="stable")
        c, slots = c[order], at.slot_of[targets[order]]
        h = s.shape[1]
        st = self._room("st", h + 1, len(s))
        st[h] = 1  # for the biases
        np.take(s.T, order, axis=1, out=st[:h], mode="clip")
        oc, os = np.vstack((p["oc"], p["bc"])), np.vstack((p["os"], p["bs"]))
        # a state's parts lie between -1 and 1: no logit is farther from 0
        small = bool(max(np.abs(oc).sum(axis=0).max(initial=0), np.abs(os).sum(axis=0).max(initial=0)) <= 40)
        logits = lambda w, x: np.matmul(w.T, x, out=self._room("logits", w.shape[1], x.shape[1]))
        e, total, got, own = self._softmax(logits(oc, st), c, small)
        grads, ds = None, None
        if learn:
            e = self._error(e, total, own)
            ds, g, gs = np.matmul(p["oc"], e, out=self._room("ds", *s.T.shape)), st @ e.T, np.zeros_like(os)
            grads = {"oc": g[:h], "bc": g[h], "os": gs[:h], "bs": gs[h]}
        bounds = np.searchsorted(c, np.arange(at.classes + 1)).tolist()
        first = at.first.tolist()
        for k in range(at.classes):
            a, b, i, j = first[k], first[k + 1], bounds[k], bounds[k + 1]
            if b - a < 2 or i == j:
                continue
            e, total, more, own = self._softmax(logits(os[:, a:b], st[:, i:j]), slots[i:j], small)
            got[i:j] += more
            if learn:
                e = self._error(e, total, own)
                ds[:, i:j] += os[:h, a:b] @ e
                gs[:, a:b] = st[:, i:j] @ e.T
        out = np.empty_like(got)
        out[order] = got
        if not learn:
            return out, None, None
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return out, grads, np.take(ds, back, axis=1, out=self._room("back", *ds.shape), mode="clip").T

    @staticmethod
    def _softmax(logits: np.ndarray, chosen: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Exponentials, their sums, the chosen rows' log-probabilities, and where these rows stand in memory.
        ``small``: no exponential is too large or too small."""
        if not small and (logits.max(initial=0) > 40 or logits.min(initial=0) < -40):
            logits -= logits.max(axis=0)
        n = logits.shape[1]
        own = chosen.astype(np.int64) * n + np.arange(n)
        got = logits.reshape(-1).take(own).astype(np.float64)
        e = np.exp(logits, out=logits)
        total = e.sum(axis=0)
        return e, total, got - np.log(total), own

    @staticmethod
    def _error(e: np.ndarray, total: np.ndarray, own: np.ndarray) -> np.ndarray:
        e *= 1 / total
        e.reshape(-1)[own] -= 1
        return e

    def _backward(self, ids: list[np.ndarray], saved: list[tuple], ds: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        """Adds gradients of x, u and b; x as (ids, rows)."""
        p, ds = self.p, ds.T
        h3 = p["u"].shape[0]
        carry = np.zeros((h3, len(ids[0])), ds.dtype)
        end = ds.shape[1]
        z, grads["u"] = self._room("z", 3 * h3, end), np.zeros_like(p["u"])
        for x, (old, r, keep, hc, c) in zip(reversed(ids), reversed(saved), strict=True):
            n = len(x)
            own = slice(end - n, end)
            end -= n
            # of the gates, of what a candidate takes from the state, and of the candidate
            step, d, kept = (self._room(k, m * h3, n) for k, m in (("step", 4), ("d", 1), ("kept", 1)))
            np.add(ds[:, own], carry[:, :n], out=d)
            dr, dk, dh, dc = step[:h3], step[h3 : 2 * h3], step[2 * h3 : 3 * h3], step[3 * h3 :]
            np.multiply(d, keep, out=kept)
            np.multiply(c, c, out=dc)
            np.subtract(1, dc, out=dc)
            d -= kept
            dc *= d
            np.subtract(old, c, out=dk)
            dk *= kept
            np.subtract(1, keep, out=d)
            dk *= d
            np.multiply(dc, r, out=dh)
            np.subtract(1, r, out=dr)
            dr *= dh
            dr *= hc
            np.matmul(p["u"], step[: 3 * h3], out=carry[:, :n])
            carry[:, :n] += kept
            grads["u"] += old @ step[: 3 * h3].T
            z[: 2 * h3, own], z[2 * h3 :, own] = step[: 2 * h3], dc
        which = np.concatenate(ids)
        order = np.argsort(which.astype(np.uint16) if self.at.ids < 1 << 16 else which, kind="stable")
        found = which[order]
        first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        sums = np.add.reduceat(np.take(z, order, axis=1, out=self._room("sorted", *z.shape), mode="clip"), first, axis=1)
        grads["b"] = sums.sum(axis=1)
        grads["x"] = found[first], np.ascontiguousarray(sums.T)

    @staticmethod
    def _windows(starts: np.ndarray, rows: np.ndarray, ids: np.ndarray, begin: int, window: int, least: int = 0):
        """(inputs, targets) of each window of the texts ``rows`` (longest first), step by step."""
        return Net._steps(starts[:-1][rows], (starts[1:] - starts[:-1])[rows], ids, np.full(len(rows), begin), window, least)

    @staticmethod
    def _steps(at: np.ndarray, length: np.ndarray, ids: np.ndarray, begin: np.ndarray, window: int, least: int = 0):
        """The same of the tokens from ``at`` on, where ``begin`` is read before each first one; windows go on until they have ``least`` tokens."""
        longest = int(length[0])
        running = np.searchsorted(-length, -np.arange(longest), side="left").tolist()  # texts longer than t
        before = begin
        xs, ys, size = [], [], 0
        for t, n in enumerate(running):
            xs.append(before[:n])
            before = ids[at[:n] + t]
            ys.append(before)
            size += n
            if len(ys) >= window and size >= least or t == longest - 1:
                yield xs, ys
                xs, ys, size = [], [], 0

    def scores(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Natural log-probability of each text, its end included."""
        out = np.zeros(len(starts) - 1)
        order = np.argsort(starts[:-1] - starts[1:], kind="stable")
        for i in range(0, len(order), SCORING_LANES):
            rows = order[i : i + SCORING_LANES]
            h, sums = np.zeros((len(rows), self.p["u"].shape[0]), np.float32), np.zeros(len(rows))
            for xs, ys in self._windows(starts, rows, ids, self.at.start, WINDOW, WINDOW * SCORING_LANES):
                s, _ = self._forward(xs, h, learn=False)
                got, _, _ = self._outputs(s, np.concatenate(ys), False)
                j = 0
                for y in ys:
                    sums[: len(y)] += got[j : j + len(y)]
                    j += len(y)
            out[rows] = sums
        return out

    def train(self, ids: np.ndarray, starts: np.ndarray, rate: float, memory: dict[str, np.ndarray]) -> None:
        """One pass of truncated backpropagation with per-weight step sizes (Adagrad).

        Texts are read a stretch at a time, which keeps lanes full; the state at its end begins the next.
        """
        lengths = np.diff(starts)
        state = np.zeros((len(lengths), self.p["u"].shape[0]), np.float32)
        for done in range(0, int(lengths.max(initial=0)), STRETCH):
            left = np.clip(lengths - done, 0, STRETCH)
            order = np.argsort(-left, kind="stable")[: int((left > 0).sum())]
            for i in range(0, len(order), LANES):
                rows = order[i : i + LANES]
                at, h = starts[:-1][rows] + done, state[rows]
                self._learn(self._steps(at, left[rows], ids, ids[at - 1] if done else np.full(len(rows), self.at.start), WINDOW), h, rate, memory)
                state[rows] = h

    def _learn(self, windows, h: np.ndarray, rate: float, memory: dict[str, np.ndarray]) -> None:
        """A step of the weights for each window; ``h`` goes on."""
        for xs, ys in windows:
            s, saved = self._forward(xs, h)
            targets = np.concatenate(ys)
            _, grads, ds = self._outputs(s, targets, True)
            self._backward(xs, saved, ds, grads)
            scale = np.float32(1 / len(targets))
            for k in SHAPES:
                w, m = self.p[k], memory[k]
                if k == "x":
                    at, g = grads[k]
                    g = np.clip(g * scale, -CLIP, CLIP)
                    m[at] += g * g
                    w[at] -= rate * g / np.sqrt(m[at])
                else:
                    g = np.clip(grads[k] * scale, -CLIP, CLIP)
                    m += g * g
                    w -= rate * g / np.sqrt(m)


def memory(at: Layout, start: float = 1e-4) -> dict[str, np.ndarray]:
    return {k: np.full(s, start, np.float32) for k, s in shapes(at).items()}
