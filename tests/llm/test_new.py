"""Hard negatives, Golay SimHash and fill-in-middle against plain versions and on awkward tables."""

import collections
import hashlib
import math
import os
import random
import re

import numpy as np
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waypath.llm import fim, golay, gru, negatives

MIDDLE = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(MIDDLE), reason="no test tables")
CLASH = ["fp", "fingerprint", "key", "m", "c", "a", "b", "seg", "near0", "doc", "component", "n", "form", "output", "_fim", "anchor", "score", "vector", "w", "_r", "_label", "windows", "block", "h"]


def clashing(df):
    return df.withColumns({c: F.lit(7) for c in CLASH})


# fill in middle


def plain_fim(doc_id, text):
    """The contract word for word, over a list of code points."""
    text = text or ""
    units = list(text)
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = min(h1 % (len(units) + 1), h2 % (len(units) + 1)), max(h1 % (len(units) + 1), h2 % (len(units) + 1))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return len(units), "spm", a, b - a, "<S>" + s + "<P>" + p + "<M>" + m
    return len(units), "psm", a, b - a, "<P>" + p + "<S>" + s + "<M>" + m


AWKWARD = [(i, t) for i, t in enumerate([None, "", "x", "né 日本\ń🏽", "a <P> b", "<S", "P><", "<" * 9, "<P<S<M" * 7, "\r\n" * 5, "word " * 70_000, "x" * 5000])]


def test_fim_equals_the_plain_version(spark):
    rows = AWKWARD + [(100 + i, t) for i in range(40) for _, t in AWKWARD[3:10]] + [(None, "null id"), (7, "word"), (7, "word"), (-3, "negative id")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256, r.restored_sha256) for r in fim.fill_in_middle(df).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = collections.Counter()
    for i, t in rows:
        n, form, a, b, output = plain_fim(i, t)
        want[i, n, form, a, b, output, sha(output), sha(t or "")] += 1
    assert got == want
    assert {k[2] for k in want} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0


@given(st.text("<>PSMab é\n", max_size=30), st.integers(0, 10**6))
@settings(max_examples=400, deadline=None)
def test_fim_restores_every_text(text, doc_id):
    at = fim.ends(text, fim.runs_of(fim.CODE_POINT))
    form, *parts = fim.cut(text, at, fim.seeds(doc_id), whole=100)
    assert "".join(parts) == text
    assert fim.restored(fim.laid_out(form, *parts), form) == text


@pytest.mark.parametrize("unit", ["(?s:.)", r"\X", r"\S+\s*", "[a-z]"])
@given(st.text("ab é́\r\n👍🏽", max_size=40))
@settings(max_examples=100, deadline=None)
def test_unit_ends_are_those_of_single_matches(unit, text):
    pattern = fim.runs_of(unit)
    assert list(fim.ends(text * 60, pattern)) == [m.end() for m in regex.finditer(unit, text * 60)]


def test_units_are_not_empty():
    with pytest.raises(ValueError, match="empty"):
        fim.runs_of("a*")


# SimHash


def plain_fingerprint(text):
    lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", lower)
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """Row -> first row reachable, by all pairs."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i:] ^ f[i]) <= 3):
            a, b = sorted((root(i), root(i + int(j))))
            parent[b] = a
    return [root(i) for i in range(len(fps))]


def test_codewords_within_one_bit_meet():
    """The own codeword of a word is near every word one bit away; sizes are those of the perfect code."""
    rng = np.random.default_rng(1)
    words = np.concatenate((np.arange(4096), rng.integers(0, 1 << 23, 6000)))
    index, count = golay.near_codewords(words)
    assert set(count) == {1, 6}
    assert np.bincount(golay._COUNT)[[1, 6]].tolist() == [1 + 23 + 253, 1771]
    for bit in range(23):
        other, n = golay.near_codewords(words ^ (1 << bit))
        assert ((other == index[:, :1]) & (np.arange(6) < n[:, None])).any(axis=1).all()


def crowd(rng, n):
    """Fingerprints around a few centres, chains of three bits a step, and strangers."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(n // 4):
            x = centre
            for b in rng.sample(range(64), rng.randrange(0, 7)):
                x ^= 1 << b
            out.append(x)
        for _ in range(30):
            for b in rng.sample(range(64), 3):
                centre ^= 1 << b
            out.append(centre)
    # errors placed in segments: 3 in one, 2 and 1, one in each
    for first in ((0, 1, 2), (23, 24, 45), (46, 50, 63), (0, 1, 30), (0, 30, 31), (5, 60, 61), (30, 62, 63), (1, 30, 50)):
        x = rng.getrandbits(64)
        out += [x, x ^ sum(1 << b for b in first)]
    return out


@pytest.mark.parametrize("block", [256, 2, 16])
def test_links_join_what_all_pairs_join(spark, block):
    rng = random.Random(block)
    fps = sorted(set(crowd(rng, 200)))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    classes = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3).mapInArrow(golay.segmented, golay.SEGMENTED)
    edges = [(r.a, r.b) for r in golay.links(classes, block).collect()]
    where = {x: i for i, x in enumerate(signed)}
    parent = np.arange(len(fps))
    i, j = np.array([(where[a], where[b]) for a, b in edges]).T
    assert golay.joined(parent, i, j).tolist() == plain_components(fps)
    assert len(edges) < 40 * len(fps) or block > 16


def test_simhash_of_awkward_rows(spark):
    prose = "the quick brown fox jumps over the lazy dog and then runs far away from here because it is very late in the day "
    rows = [(5, prose * 4), (3, prose * 4), (3, prose * 4), (9, (prose * 4).upper()), (4, prose * 4 + "x"), (1, None), (2, ""), (None, " \t"), (None, "only a null id has this text"), (7, "one"), (8, "ONE"), (11, "one two"), (12, "é É"), (13, prose * 9000), (14, "x" * 300_000)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in golay.near_duplicates(df).collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(fps)
    least = {r: min((rows[i][0] for i in range(len(rows)) if roots[i] == r and rows[i][0] is not None), default=None) for r in roots}
    assert got == collections.Counter((rows[i][0], f"{fps[i]:016x}", least[roots[i]]) for i in range(len(rows)))
    assert golay.near_duplicates(df.limit(0)).count() == 0
    assert golay.near_duplicates(df.where("doc_id = 1")).collect()[0].component_id == 1


@needs_tables
def test_simhash_of_the_tables(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").orderBy("doc_id")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in golay.near_duplicates(docs).collect()}
    fps = [int(got[i].fingerprint, 16) for i, _ in rows]
    assert [rows[r][0] for r in plain_components(fps)] == [got[i].component_id for i, _ in rows]
    for i, t in rows[::7]:
        assert plain_fingerprint(t) == int(got[i].fingerprint, 16)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["a b c d e f g", None, "x", "a b " * 50, "", "q r s t"])
    whole = golay.fingerprints(texts).tolist()
    monkeypatch.setattr(golay, "PIECE", 3)
    assert golay.fingerprints(texts).tolist() == whole == [plain_fingerprint(t) for t in texts.to_pylist()]


# hard negatives


def plain_negatives(rows):
    """The contract word for word."""
    v = []
    for i, e, label in dict.fromkeys((i, None if e is None else tuple(e), label) for i, e, label in rows):
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v.append((i, (label + 1) % 10 if i % 7 == 0 else label, [max(-(1 << 24), min(1 << 24, math.floor(256 * x))) for x in e]))
    out = []
    for i, label, e in v:
        if i % 100:
            continue
        scores = sorted((-sum(a * b for a, b in zip(e, f, strict=False)), j, k == label) for j, k, f in v if j != i)
        for s, j, _ in [x for x in scores if x[2]][:5]:
            inside = [(t, k) for t, k, same in scores if not same and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(inside, 1)]
    return collections.Counter(out)


def mined(df, **more):
    return collections.Counter(map(tuple, negatives.hard_negatives(df, **more).collect()))


EMB = "vec_id long, embedding array<float>, label int"


def vectors(rng, n, d, labels=3):
    centres = rng.normal(size=(labels, d)) * 0.4
    out = []
    for i in range(n):
        label = int(rng.integers(labels))
        x = (centres[int(rng.integers(labels))] + rng.normal(size=d) * 0.2).astype(np.float32)
        out.append((i, [float(y) for y in x], label))
    return out


@pytest.mark.parametrize(("n", "d"), [(900, 8), (700, 1), (300, 33)])
def test_negatives_equal_brute_force(spark, monkeypatch, n, d):
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 100 * d)  # several blocks
    rows = vectors(np.random.default_rng(n), n, d)
    rows += [(n + i, rows[5][1], rows[5][2]) for i in range(300)]  # one vector a quarter of all rows
    want = plain_negatives(rows)
    assert len(want) > 20
    assert mined(spark.createDataFrame(rows, EMB).repartition(4), anchor_bytes=1) == want  # a block of anchors to a broadcast


def test_negatives_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, 0.25], 1), (100, [0.5, 0.25], 2), (200, [], 2), (300, None, 2), (400, [1.0, nan], 2), (500, [1.0, inf], 1), (600, [None, 1.0], 1),
        (700, [3e38, -3e38], 2), (800, [0.0, 0.0], 2), (900, [0.5, 0.25], None), (None, [0.5, 0.25], 2), (1, [0.5, 0.25], 2), (1, [0.5, 0.25], 2), (2, [0.45, 0.25], 3),
        (3, [0.45, 0.25], 3), (4, [0.4, 0.3], 1), (100, [0.5, 0.25], 2), (100, [0.1, 0.1], 2), (14, [0.44, 0.25], 9), (5, [0.5], 2), (6, [-0.5, -0.25], 2), (8, [0.3, 0.1], 0), (9, [-0.5, -0.2], 4),
    ]
    df = clashing(spark.createDataFrame(rows, EMB).repartition(3))
    assert mined(df) == plain_negatives(rows)
    assert mined(df.limit(0)) == collections.Counter()
    assert mined(df.where("label is null or embedding is null")) == collections.Counter()
    assert mined(df.where("vec_id % 100 <> 0")) == collections.Counter()


def test_bounds_hold_every_score():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(2000, 12)) * 90).astype(np.int64)
    x[:, 3] = 7  # a dimension of one value
    cells = negatives.Cells(x.min(axis=0), x.max(axis=0), x[:100])
    codes = cells.codes(x)
    assert ((cells.low[np.arange(12), codes] <= x) & (x <= cells.high[np.arange(12), codes])).all()
    for a in x[:20]:
        lower, upper = negatives.bounds(cells.table(a), cells.places(codes))
        assert ((lower <= x @ a) & (x @ a <= upper)).all()
        assert (upper - lower).mean() < 0.3 * np.ptp(x @ a)  # tight enough to leave most rows out


def test_too_many_dimensions_are_told(spark):
    with pytest.raises(ValueError, match="dimensions"):
        negatives.hard_negatives(spark.createDataFrame([(0, [0.1] * (negatives.DIMENSIONS + 1), 1)], EMB))


# language model


def small_net():
    at = gru.Layout(np.array([0, 0, 1, 1, 0, 1, 2]), np.array([0, 1, 0, 1, 2, 2, 0]), np.array([0, 3, 6, 7]))
    return gru.Net(at, gru.initial(at, np.array([5.0, 3, 2, 1, 1, 1, 2])))


def test_long_texts_fill_their_windows(monkeypatch):
    """A text that runs on alone takes windows by tokens, not by steps, and scores as before."""
    net, seen = small_net(), []
    ids, starts = np.random.default_rng(5).integers(0, 6, 5100), np.array([0, 5000, 5060, 5100])
    whole = net.scores(ids, starts)
    monkeypatch.setattr(net, "_outputs", lambda s, *rest, real=net._outputs: seen.append(len(s)) or real(s, *rest))
    assert net.scores(ids, starts) == pytest.approx(whole) and sum(seen) == 5100 and len(seen) < 5000 / gru.WINDOW / 10
    monkeypatch.setattr(gru, "SCORING_LANES", 1)
    assert net.scores(ids, starts) == pytest.approx(whole, rel=1e-5)


def test_a_text_alone_keeps_the_states_it_came_from():
    net, h = small_net(), np.zeros((1, gru.HIDDEN), np.float32)
    states, saved = net._forward([np.array([1]), np.array([2])], h)
    assert (saved[0][0] == 0).all() and np.array_equal(saved[1][0][:, 0], states[0]) and np.array_equal(h[0], states[1]) and h.any()
