"""What the driver holds, and what is shuffled, when there are many keys, classes or chunks."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from waypath.llm import minhash, shared


def test_a_sieve_keeps_every_key_and_few_others(spark):
    rows = spark.range(100_000).select((F.col("id") * 7 - 3).alias("doc_id"), F.lit("x").alias("text")).union(spark.createDataFrame([(None, "null")], "doc_id long, text string"))
    keys = rows.where("doc_id % 5 = 0").select("doc_id")
    n = keys.count()
    maybe, others = shared.sieve(rows, ["doc_id"], keys, n)
    assert maybe.where("doc_id % 5 = 0").count() == n
    assert maybe.count() < n + 0.08 * (100_001 - n)
    assert sorted(map(str, maybe.union(others).collect())) == sorted(map(str, rows.collect()))
    assert shared.sieve(rows, ["doc_id"], keys.where("false"), 0)[0].isEmpty()


def test_many_ids_pick_their_texts_without_passing_the_driver(spark, monkeypatch):
    n, sent = 60_000, []
    monkeypatch.setattr(F, "broadcast", lambda df, real=F.broadcast: sent.append(df.count()) or real(df))
    near = minhash.NearDuplicates(spark.createDataFrame([(0, "none")], "doc_id long, text string"))
    near.docs = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"))
    digests = [(i, i, xxhash.xxh3_128_digest(minhash.shingles(minhash.Words(minhash.pa.array([f"w{i}"])))[0].tobytes())) for i in (0, 5, 2 * n - 2)]
    near.reps = spark.range(0, 2 * n, 2).selectExpr("id", "id as doc", "cast('' as binary) as digest").where("id not in (0, 5)").union(spark.createDataFrame(digests, "id long, doc long, digest binary"))
    assert {r.id for r in near.sets(near.reps.select("id").distinct()).collect()} == {0, 5, 2 * n - 2}
    assert max(sent) < 1000


@pytest.mark.parametrize("most", [0, 50_000])
def test_rows_without_some_keys(spark, monkeypatch, most):
    monkeypatch.setattr(shared, "BROADCAST_KEYS", most)
    rows = spark.createDataFrame([(i % 50, i % 3, f"t{i}") for i in range(600)], "_file long, _row long, text string")
    gone = rows.where("_row = 1 and _file < 20").select("_file", "_row").distinct()
    left = shared.without(rows, ["_file", "_row"], gone)
    assert left.columns == rows.columns
    assert sorted(left.collect()) == sorted(rows.where("not (_row = 1 and _file < 20)").collect())
    assert sorted(shared.without(rows, ["_file", "_row"], gone.where("false")).collect()) == sorted(rows.collect())


def test_chunks_that_all_meet_grow_before_they_are_many(spark):
    """Each class goes to every chunk of its bucket: 256 chunks of one would make 65,536 rows."""
    near = minhash.NearDuplicates(spark.createDataFrame([(0, "none")], "doc_id long, text string"), block=1)
    dealt, large = near.chunks(spark.range(256).select(F.lit(1).cast("long").alias("bucket"), "id"), True)
    assert dealt.count() <= 256 * minhash.SPREAD and large.count() == 256
    meet = {(a, b) for ids in dealt.groupBy("bucket", "i", "j").agg(F.collect_set("id").alias("ids")).collect() for a in ids.ids for b in ids.ids if a < b}
    assert len(meet) == 256 * 255 // 2


@pytest.mark.parametrize("kinds", [1, 2, 40])
def test_shared_counts_either_way(kinds):
    rng = np.random.default_rng(kinds)
    sets = [np.unique(rng.integers(0, 60, 30)) + 1000 * (i % kinds) for i in range(80)]
    both = minhash.shared_counts(sets)
    assert all(both[a, b] == len(np.intersect1d(sets[a], sets[b])) for a in range(80) for b in range(80) if a != b)
