"""Frequent itemsets, association rules and lists from them."""

from __future__ import annotations

from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, functions as F

from tastemill.operators.rank import top_n, unseen
from tastemill.operators.skew import deal, lookup
from tastemill.session import stage

# Leads of rules (antecedent and one item) that every task may hold.
HELD_LEADS = 50_000


def smallest_count(share: float, total: int) -> int:
    """Smallest whole count with count / total >= share."""
    count = max(1, ceil(share * total))
    while count > 1 and (count - 1) / total >= share:
        count -= 1
    while count / total < share:
        count += 1
    return count


def frequent_itemsets(baskets: DataFrame, keys: list[str], min_support: float = 0.08) -> DataFrame:
    """(items, freq, support) of all itemsets in at least ``min_support`` of the baskets.

    Baskets are first reduced to items that are frequent on their own. Their number is at
    most (mean basket size / min_support), which bounds the arrays handed to the miner
    whatever the size of a basket.
    """
    members = stage(baskets.select(*keys, "item_id").distinct(), "members")
    total = members.select(*keys).distinct().count()
    least = smallest_count(min_support, total)
    single = members.groupBy("item_id").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= least)
    kept = lookup(members, single.select("item_id"), "item_id", keys, "left_semi")
    arrays = kept.groupBy(*keys).agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    arrays = stage(arrays.select("items"), "transactions")
    left = arrays.count()
    if left < least:
        return single.select(F.array("item_id").alias("items"), "freq", (F.col("freq") / total).alias("support"))
    miner = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / left, minConfidence=1.0)
    found = stage(miner.fit(arrays).freqItemsets, "itemsets")
    return found.select(F.array_sort("items").alias("items"), "freq", (F.col("freq") / total).alias("support"))


def association_rules(itemsets: DataFrame, min_confidence: float = 0.2, semantics: str = "reference") -> DataFrame:
    """(antecedent, consequent, support, confidence).

    Every split of a frequent itemset into two non-empty sides is a candidate. They are
    grown level by level: a larger consequent can only lower the confidence, so only rules
    that pass get another item moved over. ``corrected`` keeps to single-item consequents,
    which give the same best confidence per item.
    """
    sets = itemsets.select("items", "freq", "support")
    base = stage(sets.select(F.col("items").alias("antecedent"), F.col("freq").alias("_base")), "rule-bases")

    def confident(sides: DataFrame) -> DataFrame:
        rated = sides.join(base, "antecedent").withColumn("confidence", F.col("freq") / F.col("_base"))
        return stage(rated.where(F.col("confidence") >= min_confidence).drop("_base"), "rules")

    one = sets.where(F.size("items") > 1).withColumn("_one", F.explode("items"))
    level = confident(
        one.withColumn("antecedent", F.array_remove("items", F.col("_one"))).withColumn("consequent", F.array("_one")).drop("items", "_one")
    )
    found = level
    while semantics != "corrected":
        wider = level.withColumn("_one", F.explode("antecedent")).where((F.col("_one") > F.array_max("consequent")) & (F.size("antecedent") > 1))
        level = confident(
            wider.withColumn("antecedent", F.array_remove("antecedent", F.col("_one")))
            .withColumn("consequent", F.array_append("consequent", F.col("_one")))
            .drop("_one", "confidence")
        )
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found.select("antecedent", "consequent", "support", "confidence")


def recommend_by_rules(
    recent: DataFrame,
    rules: DataFrame,
    n: int = 10,
    semantics: str = "reference",
    seen: DataFrame | None = None,
) -> DataFrame:
    """Lists for all users from (user_id, item_id) rows of recent items.

    A rule applies if all of its antecedent is recent. An item scores the lowest
    confidence of the rules that lead to it, or the highest if ``corrected``. Tasks hold the
    rules if these are few (counted first), and users are dealt out evenly; many rules are joined.
    """
    best = F.max if semantics == "corrected" else F.min
    per_item = (
        rules.select("antecedent", F.explode("consequent").alias("item_id"), "confidence")
        .groupBy("antecedent", "item_id")
        .agg(best("confidence").alias("confidence"))
    )
    per_item = stage(per_item, "rule-leads")
    sets = stage(per_item.select("antecedent").distinct().withColumn("set_id", F.monotonically_increasing_id()), "rule-sets")
    need = sets.select("set_id", F.size("antecedent").alias("_need"), F.explode("antecedent").alias("item_id"))
    recent = stage(recent.select("user_id", "item_id").distinct(), "recent")
    held = per_item.count() <= HELD_LEADS

    def meet(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
        return deal(rows, "user_id").join(F.broadcast(table), key) if held else lookup(rows, table, key, ["user_id"])

    met = (
        meet(recent, need, "item_id")
        .groupBy("user_id", "set_id", "_need")
        .agg(F.count(F.lit(1)).alias("_met"))
        .where(F.col("_met") == F.col("_need"))
        .select("user_id", "set_id")
    )
    met = stage(met, "met-sets")
    scored = (
        meet(met, per_item.join(sets, "antecedent").drop("antecedent"), "set_id")
        .groupBy("user_id", "item_id")
        .agg(best("confidence").alias("score"))
    )
    return top_n(scored if seen is None else unseen(scored, seen), n)
