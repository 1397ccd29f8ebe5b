"""Sizes at which earlier versions cut, overflowed or failed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.functions.vectors import sums_by
from tastemill.operators import baskets, cooccur, cosine, dense_top, rank
from tastemill.plans import als, cbow, embed, rules
from tastemill.session import stage, tune
from tastemill.sources import files, sinks

from .conftest import lists


def test_small_scores_keep_their_order(spark):
    rows = spark.createDataFrame([(1, 2, 1e-9), (1, 5, 3e-9), (1, 9, 4.9e-9), (1, 7, 0.0)], "user_id long, item_id long, score double")
    assert [i for i, _ in lists(rank.top_n(rows, 4))[1]] == [9, 5, 2, 7]
    users, items = spark.createDataFrame([(1,)], "user_id long"), spark.createDataFrame([(i,) for i in range(1, 12)], "item_id long")
    taken = rows.select("user_id", "item_id")
    assert [i for i, _ in lists(rank.top_n_with_zeros(rows, taken, users, items, 4))[1]] == [9, 5, 2, 1]


def test_weights_of_items_with_a_million_raters(spark):
    """One shared basket among a million raters each: the weight is tiny and still ranks."""
    raters = spark.createDataFrame([(1, 1_000_000), (2, 1_000_000), (3, 4_000_000)], "item_id long, raters long")
    members = spark.createDataFrame([(1, 1, i, 3) for i in (1, 2, 3)], "user_id long, basket_no long, item_id long, basket_size long")
    weights = {(r["i"], r["j"]): r["w"] for r in cooccur.purchase_similarity(members, raters).collect()}
    assert weights[1, 2] == pytest.approx(1e-6) and weights[1, 3] == pytest.approx(5e-7)
    scores = spark.createDataFrame([(1, 10 + j, w * 0.1) for (_, j), w in weights.items()], "user_id long, item_id long, score double")
    best = lists(rank.top_n(scores, 3))[1]
    assert [s for _, s in best] == sorted((s for _, s in best), reverse=True) and best[0][1] > best[-1][1]


def test_basket_of_more_than_a_thousand_items(spark):
    items = [5000 * k for k in range(2501)]
    rows = spark.createDataFrame([(1, 1, i, len(items)) for i in items] + [(2, 1, 3, 2), (2, 1, 4, 2)], "user_id long, basket_no long, item_id long, basket_size long")
    found = {(r["user_id"], r["piece"]): r["items"] for r in baskets.basket_lists(rows, ["user_id", "basket_no"]).collect()}
    assert found == {(1, 0): items[:1000], (1, 1): items[1000:2000], (1, 2): items[2000:], (2, 0): [3, 4]}
    words = sorted((r["words"] for r in embed.sentences(rows, ["user_id", "basket_no"], 5).collect()), key=lambda w: int(w[0]))
    long = [w for w in words if len(w) > 2]
    assert max(map(len, long)) <= 1000 and [int(x) for x in long[0][-5:]] == [int(x) for x in long[1][:5]]
    assert {int(x) for w in long for x in w} == set(items)


def test_rules_of_an_itemset_of_32(spark):
    """Only rules that pass grow: with 31 items on the left each, 2**32 splits are never formed."""
    items = list(range(32))
    sets = [(items, 10, 0.1)] + [([x for x in items if x != i], 10 if i == 0 else 50, 0.5) for i in items]
    sets += [(items[2:], 1000, 1.0)]
    frame = spark.createDataFrame(sets, "items array<long>, freq long, support double")
    found = rules.association_rules(frame, 0.5)
    assert [(len(r["antecedent"]), r["consequent"], r["confidence"]) for r in found.collect()] == [(31, [0], 1.0)]


def test_masked_als_with_large_ids(spark):
    rows = [(3_000_000_000 + u, 5_000_000_000 + i, float((u * i) % 3 - 1)) for u in range(12) for i in range(6)]
    model = als.als_masked(spark.createDataFrame(rows, "user_id long, item_id long, centred double"), 2, 2)
    assert {r["user_id"] for r in model.users.collect()} == {3_000_000_000 + u for u in range(12)}
    assert {r["item_id"] for r in model.items.collect()} == {5_000_000_000 + i for i in range(6)}


def test_matrix_of_more_than_ten_thousand_columns(spark, tmp_path):
    rows = [(k % 7, k, float(k % 5)) for k in range(10_001)]
    cells = spark.createDataFrame(rows, "item_id long, user_id long, rating double")
    sinks.write_matrix(cells, str(tmp_path / "wide"), "item_id", "user_id", "rating", block=4000)
    back = files.read_matrix_blocks(spark, str(tmp_path / "wide"), "item_id", "user_id", "rating")
    assert sorted((r["item_id"], r["user_id"], r["rating"]) for r in back.collect()) == sorted(rows)


def test_matrix_of_many_blocks_in_few_jobs(spark, tmp_path, monkeypatch):
    rows = [(k % 7, k // 3, float(k % 5)) for k in range(2000)] + [(None, 4, 2.5)]
    cells = spark.createDataFrame(rows, "item_id long, user_id long, rating double").dropDuplicates(["item_id", "user_id"])
    monkeypatch.setattr(sinks, "PART_CELLS", 3)  # several files for a block
    tracker, path = spark.sparkContext.statusTracker(), str(tmp_path / "blocks")
    spark.sparkContext.setJobGroup("matrix", "")
    sinks.write_matrix(stage(cells, "cells"), path, "item_id", "user_id", "rating", block=5)
    back = files.read_matrix_blocks(spark, path, "item_id", "user_id", "rating")
    found = {(r["item_id"], r["user_id"], r["rating"]) for r in back.collect()}
    jobs = len(tracker.getJobIdsForGroup("matrix"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == set(rows) and back.count() == len(set(rows))
    assert back.columns == ["item_id", "user_id", "rating"]
    assert spark.read.parquet(path + "/labels").select("block").distinct().count() == 134
    assert jobs < 100  # two or more for each block before


def test_narrow_files_of_wide_rows_are_not_broadcast(spark):
    wide = stage(spark.range(400_000).select(F.col("id").alias("item_id"), F.array_repeat(F.lit(0.1), 200).alias("vec")), "wide")
    ids = spark.range(5_000_000).select(F.col("id").alias("item_id"), F.lit(1.5).alias("x"))
    tune(spark)  # as every query does
    plan = ids.join(wide, "item_id").agg(F.sum(F.col("vec")[0] * F.col("x")))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_drawn_rows_are_not_broadcast(spark):
    guide = cbow.Guide(stage(spark.range(50).select(F.col("id").alias("item_id"), F.lit(3).cast("long").alias("weight")), "weights"))
    wanted = spark.range(4).select("id", F.explode(F.sequence(F.lit(0), F.lit(16383))).alias("slot")).withColumn("ticket", F.col("slot").cast("long"))
    drawn = guide.draw(wanted, "ticket")
    assert "BroadcastHashJoin" not in drawn._jdf.queryExecution().executedPlan().toString()
    assert drawn.count() == 4 * 16384


def test_equal_vectors_are_scored_once(spark, monkeypatch):
    draw, scored = np.random.default_rng(5), []
    kinds = draw.normal(size=(9, 4))
    kinds /= np.linalg.norm(kinds, axis=1)[:, None]
    ids = draw.permutation(60)
    kind = np.r_[np.zeros(20, int), 1, draw.integers(2, 9, 39)]  # a large group, a lone row
    frame = stage(spark.createDataFrame([(int(i), kinds[g].tolist()) for i, g in zip(ids, kind)], "item_id long, vec array<double>"), "same")
    monkeypatch.setattr(cosine, "dense_candidates", lambda rows, *more, **named: (scored.append(rows.count()), dense_top.dense_candidates(rows, *more, **named))[1])
    got = {}
    for r in cosine.most_similar(frame, 5, 4).collect():
        got.setdefault(r["i"], {})[r["rank"]] = (r["j"], round(r["sim"], 6))
    want = lambda i, g: sorted((-np.float32(kinds[g] @ kinds[h]).round(5), int(j), round(float(kinds[g] @ kinds[h]), 6)) for j, h in zip(ids, kind) if j != i)[:5]
    for i, g in zip(ids, kind):
        assert [got[int(i)][k] for k in range(1, 6)] == [(j, pytest.approx(s, abs=2e-6)) for _, j, s in want(i, g)]
    assert len(got) == 60 and scored == [len(set(kind.tolist()))]
    assert cosine.most_similar(frame.union(frame.limit(3)), 5, 4).count() == 300  # repeated ids go the plain way


def test_wide_sums(spark):
    draw = np.random.default_rng(2)
    rows = [(k % 3, float(k), draw.random(100).tolist()) for k in range(12)]
    frame = spark.createDataFrame(rows, "g long, x double, vec array<double>")
    got = {r["g"]: r["vec"] for r in sums_by(frame, ["g"], "vec", 100, "x").collect()}
    for g in range(3):
        assert got[g] == pytest.approx(sum(x * np.array(v) for h, x, v in rows if h == g))
    assert sums_by(frame.where(F.lit(False)), ["g"], "vec", 100, "x").count() == 0


def test_shuffled_rows_come_in_small_tasks(spark):
    """A task reads about 16 MB of a shuffle, whatever there is; by Spark's own bound it would read 64 MB."""
    tune(spark)
    wide = spark.range(6_000_000).select(F.xxhash64("id").alias("key"), F.hash("id").alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        tasks = wide.repartition("key").select(F.spark_partition_id().alias("at")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    assert tasks == 4
