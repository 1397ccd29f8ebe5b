"""Work that goes by slices gives what it gives at once, and leaves no shuffles behind."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.operators import cosine, dense_top
from tastemill.plans import cbow, item_cf
from tastemill.session import stage, stage_slices

from . import test_tiny as T

KEYS = ["user_id", "basket_no"]


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).getName().startswith("shuffle_") for k in range(files.size()))


def test_shuffles_go_with_their_job(spark):
    def settled(count, wait=10):
        for _ in range(wait * 10):
            if shuffle_files(spark) <= count:
                break
            time.sleep(0.1)
        return shuffle_files(spark)

    before = shuffle_files(spark)
    rows = stage(spark.range(1000).repartition(7, "id"), "gone")
    assert settled(before) <= before and rows.count() == 1000


def test_stage_slices(spark):
    parts = (spark.range(100).where(F.col("id") % 3 == k) for k in range(3))
    assert sorted(r[0] for r in stage_slices(parts, "parts").collect()) == list(range(100))


def test_pair_cosine(spark):
    draw = np.random.default_rng(3)
    vectors = stage(spark.createDataFrame([(i, draw.normal(size=4).tolist()) for i in range(20)], "item_id long, vec array<double>"), "v")
    pairs = spark.createDataFrame([(i, j) for i in range(22) for j in range(i + 1, 22)], "i long, j long")
    want = {(r["i"], r["j"]): r["sim"] for r in cosine.pair_cosine(pairs, vectors).collect()}
    got = {(r["i"], r["j"]): r["sim"] for r in cosine.pair_cosine(pairs, vectors, slice_bytes=1000).collect()}
    assert got == want and len(got) == 190


@pytest.mark.parametrize("chunk", [2, 256])
def test_item_cf(tiny, chunk):
    whole = item_cf.ItemCF(tiny.centred, T.tiny_baskets(tiny), chunk)
    sliced = item_cf.ItemCF(tiny.centred, T.tiny_baskets(tiny), chunk, slice_pairs=2, slice_bytes=16)
    cells = lambda found: {(r["user_id"], r["item_id"]): r["score"] for r in found.collect()}
    for of in (item_cf.ItemCF.predict_rated, item_cf.ItemCF.predict_unrated, lambda m: item_cf.recommend_unrated(m, tiny.users, tiny.items, 2)):
        want = cells(of(whole))
        assert want and cells(of(sliced)) == pytest.approx(want)


@pytest.mark.parametrize("skip_gram", [False, True])
def test_embedding_shards(spark, skip_gram):
    draw = np.random.default_rng(2)
    rows = [(u, 0, int(i)) for u in range(60) for i in draw.choice(12, 4, replace=False)]
    baskets = stage(spark.createDataFrame(rows, "user_id long, basket_no long, item_id long"), "b")
    models = []
    for size in (4 * 2**30, 5_000):
        model = cbow.train(baskets, KEYS, 4, 3, 2, epochs=2, sample=0, shard=60, skip_gram=skip_gram, slice_bytes=size)
        models.append(sorted((r["item_id"], r["vec"], r["out"]) for r in model.collect()))
    assert models[0] == models[1] and len(models[0]) == 12


def test_seen_pairs_of_other_items_are_not_sent(spark):
    rows = stage(spark.createDataFrame([(u, [1.0, float(u)]) for u in range(5)], "user_id long, vec array<double>"), "r")
    items = stage(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "item_id long, vec array<double>"), "i")
    seen = stage(spark.createDataFrame([(u, i) for u in range(5) for i in (u, 10 + u, None)], "user_id long, item_id long"), "s")
    found = dense_top.dense_candidates(rows, items, "user_id", "item_id", 4, 2, seen=seen)
    assert "LeftSemi" in found._jdf.queryExecution().toString()
    assert {(r["user_id"], r["item_id"]) for r in found.collect()} == {(u, i) for u in range(5) for i in range(4) if u != i}
