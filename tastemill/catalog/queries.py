"""One query per operator, over the whole tables of an input folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastemill.functions import encode
from tastemill.functions.encode import hex_number
from tastemill.functions.vectors import unit
from tastemill.operators import baskets, cooccur, cosine, features, sampling, split
from tastemill.operators.rank import ordering
from tastemill.plans import als, cbow, embed, evaluate as ev, factors, item_cf, lottery, popular, push, rules, svd, walk
from tastemill.plans.workspace import Workspace, workspace
from tastemill.session import stage, staging_root
from tastemill.sources import files, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BASKET = ["user_id", "basket_no"]
SAMPLE_ITEMS, SAMPLE_USERS = 0.1, 0.2
RULE_SUPPORT, RULE_CONFIDENCE = 0.003, 0.005
SHIFT_SUPPORT, SHIFT_CONFIDENCE = 0.02, 0.05
WALK_TOLERANCE = 1e-12


def shown(df: DataFrame) -> DataFrame:
    """Lists with their scores rounded; they are ranked on the scores as they are."""
    return rounded(df, *({"score", "sim"} & set(df.columns))) if "rank" in df.columns else df


def significant(df: DataFrame) -> DataFrame:
    """Lists whose scores are too small for fixed decimals, to the bits that they are ranked on."""
    return df.withColumn("score", ordering(F.col("score")).cast("double"))


def query(build: Callable[[Workspace], DataFrame], show: Callable[[DataFrame], DataFrame] = shown) -> Callable[[Workspace], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: show(build(workspace(spark, folder)))
    return build


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def scratch(w: Workspace, name: str) -> str:
    return f"{staging_root(w.spark)}/{name}-{uuid.uuid4().hex}"


# --- inputs and outputs -----------------------------------------------------------------


@query
def ratings_view(w):
    return w.orders.ratings


@query
def event_ratings_view(w):
    return w.events.ratings


@query
def dat_scan(w):
    """Ratings written and read as '::'-separated text."""
    path = scratch(w, "dat")
    sinks.write_dat(w.orders.ratings.select("user_id", "item_id", "rating", "ts"), path)
    return files.read_ratings(w.spark, path)


@query
def csv_scan(w):
    """Tag scores written as CSV with their original header and read back renamed."""
    path = scratch(w, "csv")
    long = tag_scores_view(w).withColumnsRenamed({"item_id": "movieId", "tag_id": "tagId"})
    sinks.write_table(long.select("movieId", "tagId", "relevance"), path, "csv")
    return files.read_tag_scores(w.spark, path)


@query
def matrix_scan(w):
    """The item x user matrix of the event ratings, exported wide and read back long."""
    path = scratch(w, "matrix")
    sinks.write_matrix(w.events.ratings, path, "item_id", "user_id", "rating")
    return files.read_matrix_blocks(w.spark, path, "item_id", "user_id", "rating")


@query
def time_matrix(w):
    """Times of the earlier part, exported wide and read back long."""
    path = scratch(w, "times")
    sinks.write_matrix(w.events.old, path, "item_id", "user_id", "ts")
    return files.read_matrix_blocks(w.spark, path, "item_id", "user_id", "ts", "long")


@query
def time_matrix_new(w):
    """Times of the later part, in blocks of 64 columns."""
    path = scratch(w, "times")
    sinks.write_matrix(w.events.new, path, "item_id", "user_id", "ts", block=64)
    return files.read_matrix_blocks(w.spark, path, "item_id", "user_id", "ts", "long")


@query
def users_scan(w):
    """Customers in the users layout, written and read as '::'-separated text."""
    path = scratch(w, "users")
    rows = w.table("customer").select(
        F.col("c_custkey").alias("user_id"),
        F.when(F.col("c_acctbal") < 0, "F").otherwise("M").alias("gender"),
        F.col("c_nationkey").cast("int").alias("age"),
        encode.category_code(F.col("c_mktsegment"), tables.SEGMENTS).cast("int").alias("occupation"),
        F.col("c_mktsegment").alias("zip"),
    )
    sinks.write_dat(rows, path)
    return files.read_users(w.spark, path)


@query
def items_scan(w):
    """Parts in the items layout with several genres each, written and read as text."""
    path = scratch(w, "items")
    sinks.write_dat(w.table("part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), _genres().alias("genres")), path)
    return files.read_items(w.spark, path)


@query
def tags_scan(w):
    """Tag names with a comma, written as CSV, copied and read back renamed."""
    path = scratch(w, "tags")
    tags = tag_scores_view(w).select("tag_id").distinct().select(F.col("tag_id").alias("tagId"), F.concat(F.lit("tag, "), F.col("tag_id")).alias("tag"))
    sinks.write_table(tags, path, "csv")
    sinks.copy_table(files.read_tags(w.spark, path).withColumnsRenamed({"tag_id": "tagId"}), path + "-copy", "csv")
    return files.read_tags(w.spark, path + "-copy")


SIZES = ("TINY", "LITTLE", "MIDDLE", "BIG", "HUGE")


def _genres():
    """Two genres of a part in one string: its type and its class of size."""
    place = F.least(F.floor((F.col("p_size") - 1) / 10), F.lit(4)).cast("int")
    return F.concat_ws("|", "p_type", F.element_at(F.array(*map(F.lit, SIZES)), place + 1))


@query
def basket_scan(w):
    """Baskets written as item lists and read back."""
    path = scratch(w, "baskets")
    sinks.write_table(baskets.basket_lists(w.gap_baskets, BASKET), path)
    read = files.read_baskets(w.spark, path)
    words = F.transform("items", lambda i: i.cast("string"))
    return read.select(*BASKET, "piece", F.array_join(words, ",").alias("items"))


@query
def tag_scores_view(w):
    """Long tag scores from the vectors, renamed, with the columns not needed dropped."""
    wide = tables.tag_vectors(w.spark, w.folder)
    long = wide.select("item_id", F.posexplode("tags").alias("tagId", "score"))
    long = long.withColumnsRenamed({"tagId": "tag_id"}).withColumn("tag_id", F.col("tag_id").cast("long"))
    return long.withColumn("relevance", F.round("score", 6)).drop("score")


# --- preparation --------------------------------------------------------------------------


@query
def bound_filter(w):
    """Tag scores up to the last part."""
    return sampling.up_to_last_item(tag_scores_view(w), w.items)


@query
def bound_filter_corrected(w):
    return sampling.up_to_last_item(tag_scores_view(w), w.items, "corrected")


@query
def genre_onehot(w):
    parts = w.table("part").select(F.col("p_partkey").alias("item_id"), _genres().alias("genres"))
    return parts.select("item_id", *encode.multi_hot(F.col("genres"), (*tables.PART_TYPES, *SIZES)))


@query
def category_codes(w):
    return w.users.select("user_id", encode.category_code(F.col("segment"), tables.SEGMENTS).alias("segment"))


@query
def minmax_users(w):
    return rounded(w.scaled_users, "balance", "nation")


@query
def minmax_users_inverted(w):
    return rounded(encode.with_min_max(w.users.drop("segment"), ["balance", "nation"], positive=False), "balance", "nation")


@query
def rating_labels(w):
    """Vertex labels, their ids read back, and days."""
    r = w.orders.ratings
    user, item = encode.label("U", F.col("user_id")), encode.label("S", F.col("item_id"))
    return r.select(
        user.alias("user_label"),
        item.alias("item_label"),
        encode.unlabel(item).alias("item_id"),
        user.startswith("U_").alias("is_user"),
        F.round(encode.days(F.col("ts")), 6).alias("day"),
    )


@query
def rating_threshold(w):
    return w.orders.ratings.where(F.col("rating") >= 3).select("user_id", "item_id")


@query
def rated_counts(w):
    """Rated and unrated items per customer, 0 where there are no ratings."""
    counts = w.orders.old.groupBy("user_id").agg(F.count("item_id").alias("rated"))
    total = w.items.agg(F.count("item_id").alias("total"))
    return (
        w.users.select("user_id")
        .join(counts, "user_id", "left")
        .select("user_id", F.coalesce("rated", F.lit(0)).alias("rated"))
        .withColumn("unrated", total.scalar() - F.col("rated"))
    )


@query
def sample_items(w):
    return sampling.sample_exact(w.items, "item_id", SAMPLE_ITEMS, "items")


@query
def sample_users(w):
    return sampling.sample_exact(w.users.select("user_id"), "user_id", SAMPLE_USERS, "users")


@query
def sample_ratings(w):
    return sampling.restrict(w.orders.ratings, sample_items(w), sample_users(w))


@query
def sample_tag_scores(w):
    """Tag scores of known items; the whole catalogue counts here, not the sample."""
    return tag_scores_view(w).join(w.items, "item_id", "left_semi")


@query
def items_with_vectors(w):
    joined = w.items.join(tables.tag_vectors(w.spark, w.folder), "item_id", "left")
    cells = joined.select("item_id", "genres", F.posexplode_outer("tags").alias("tag_id", "value"))
    return rounded(cells.withColumn("tag_id", F.col("tag_id").cast("long")), "value")


def _tag_cells(imputed: DataFrame) -> DataFrame:
    cells = imputed.select("item_id", F.posexplode("tags").alias("tag_id", "value"))
    return rounded(cells.withColumn("tag_id", F.col("tag_id").cast("long")), "value")


@query
def impute_features(w):
    return _tag_cells(w.imputed)


@query
def impute_features_fine(w):
    """Finer genre sets (type and size), so that some groups have no vector at all."""
    sizes = [str(s) for s in range(1, 51)]
    typed = w.table("part").select(
        F.col("p_partkey").alias("item_id"),
        F.concat(
            encode.multi_hot_array(F.col("p_type"), tables.PART_TYPES),
            encode.multi_hot_array(F.col("p_size").cast("string"), sizes),
        ).alias("genre_vec"),
    )
    return _tag_cells(features.impute(typed, tables.tag_vectors(w.spark, w.folder)))


@query
def impute_features_corrected(w):
    """Genre sets of which some contain others: large parts have their size as a second genre."""
    sizes = [str(s) for s in range(41, 51)]
    typed = w.table("part").select(
        F.col("p_partkey").alias("item_id"),
        F.concat(
            encode.multi_hot_array(F.col("p_type"), tables.PART_TYPES),
            encode.multi_hot_array(F.col("p_size").cast("string"), sizes),
        ).alias("genre_vec"),
    )
    return _tag_cells(features.impute(typed, tables.tag_vectors(w.spark, w.folder), "corrected"))


# --- split --------------------------------------------------------------------------------


@query
def user_cuts(w):
    return rounded(w.orders.cut.select("user_id", "cut").distinct(), "cut", digits=3)


@query
def split_old(w):
    return w.orders.old


@query
def split_new(w):
    return w.orders.new


@query
def split_new_corrected(w):
    return split.new_part(w.orders.cut, "corrected")


@query
def recent_items(w):
    return w.orders.recent


@query
def center_ratings(w):
    return rounded(w.orders.centred, "user_mean", "centred")


# --- similarity and baskets ---------------------------------------------------------------


@query
def gap_baskets(w):
    return w.gap_baskets


@query
def mean_shift_baskets(w):
    return w.shift_baskets


@query
def cooccurrence(w):
    return cooccur.cooccurrence(w.gap_baskets)


@query
def item_raters(w):
    return cooccur.item_raters(w.orders.old)


@query
def item_similarity_buy(w):
    """The non-zero cells of the purchase similarity matrix with its diagonal."""
    weights = cooccur.purchase_similarity(w.gap_baskets, cooccur.item_raters(w.orders.old))
    return rounded(cooccur.similarity_matrix(weights, w.items), "w")


@query
def item_pair_cosine(w):
    """Cosine of the item pairs that were bought together."""
    pairs = cooccur.cooccurrence(w.gap_baskets)
    return rounded(cosine.pair_cosine(pairs, w.item_vectors), "sim")


@query
def similar_items(w):
    return cosine.most_similar(w.item_vectors, 10, w.vector_size)


@query
def user_cosine(w):
    return cosine.most_similar(w.user_vectors, 10, 3, "user_id")


# --- rules --------------------------------------------------------------------------------


def _itemsets(w) -> DataFrame:
    return rules.frequent_itemsets(w.brand_baskets, ["basket_id"], RULE_SUPPORT)


def _words(column: str):
    return F.array_join(F.transform(column, lambda i: i.cast("string")), ",").alias(column)


@query
def frequent_itemsets(w):
    return _itemsets(w).select(_words("items"), "freq", F.round("support", 6).alias("support"))


def _rules_out(found: DataFrame) -> DataFrame:
    return rounded(found.select(_words("antecedent"), _words("consequent"), "support", "confidence"), "support", "confidence")


@query
def assoc_rules(w):
    return _rules_out(rules.association_rules(_itemsets(w), RULE_CONFIDENCE))


@query
def assoc_rules_corrected(w):
    return _rules_out(rules.association_rules(_itemsets(w), RULE_CONFIDENCE, "corrected"))


@query
def rule_recommend(w):
    found = rules.association_rules(_itemsets(w), RULE_CONFIDENCE)
    return rules.recommend_by_rules(w.brands.recent, found)


@query
def rule_recommend_corrected(w):
    found = rules.association_rules(_itemsets(w), RULE_CONFIDENCE, "corrected")
    return rules.recommend_by_rules(w.brands.recent, found, semantics="corrected")


def _shift_rules(w) -> DataFrame:
    found = rules.frequent_itemsets(w.shift_brands, BASKET, SHIFT_SUPPORT)
    return rules.association_rules(found, SHIFT_CONFIDENCE)


@query
def rules_mean_shift(w):
    """Rules from the mean-shift baskets of the brand ratings."""
    return _rules_out(_shift_rules(w))


@query
def rule_recommend_mean_shift(w):
    return rules.recommend_by_rules(w.brands.recent, _shift_rules(w))


# --- recommenders -------------------------------------------------------------------------


@query
def hot_items(w):
    return popular.hot_items(w.orders.old, w.items)


@query
def hot_recommend(w):
    return popular.recommend_hot(hot_items(w), w.users)


@query
def hot_recommend_unseen(w):
    return popular.recommend_hot(stage(hot_items(w), "hot"), w.users, seen=w.orders.old)


@query
def random_recommend(w):
    return lottery.recommend_random(w.items, w.users)


def _item_cf(w) -> item_cf.ItemCF:
    return item_cf.ItemCF(w.orders.centred, w.gap_baskets)


@query
def item_cf_recommend(w):
    return item_cf.recommend_rated(_item_cf(w))


@query
def item_cf_recommend_unrated(w):
    return item_cf.recommend_unrated(_item_cf(w), w.users, w.items)


@query
def item_cf_mean_shift(w):
    """Item CF on the mean-shift baskets."""
    return item_cf.recommend_rated(item_cf.ItemCF(w.orders.centred, w.shift_baskets))


def _svd(w, semantics="reference"):
    return svd.svd(w.events.centred, w.events.users, w.events.items, semantics=semantics)


@query
def svd_energy(w):
    """Singular values up to the kept count and their share of the total energy."""
    model, sigma = _svd(w)
    total = w.events.centred.agg(F.sum(F.col("centred") * F.col("centred"))).first()[0]
    rows = [(i + 1, float(s), float(e)) for i, (s, e) in enumerate(zip(sigma, svd.energy(sigma, total)))]
    out = w.spark.createDataFrame(rows[: model.k + 1], "position int, sigma double, energy double")
    return rounded(out, "sigma", "energy")


@query
def svd_moments(w):
    """Sums of the second and fourth powers of all singular values."""
    sigma = svd.svd(w.events.centred, w.events.users, w.events.items, 1.1)[1]
    rows = [(p, float((sigma**p).sum())) for p in (2, 4)]
    return rounded(w.spark.createDataFrame(rows, "power int, total double"), "total", digits=3)


@query
def svd_full_rank(w):
    """Predictions with all components, which are the centred ratings again."""
    e = w.events
    model, _ = svd.svd(e.centred, e.users, e.items, 1.1)
    return rounded(factors.predict_cells(model, e.centred.select("user_id", "item_id")), "pred")


@query
def svd_recommend(w):
    model, _ = _svd(w)
    return factors.recommend_factors(model, w.events.users, w.events.items, w.events.old)


@query
def svd_recommend_corrected(w):
    model, _ = _svd(w, "corrected")
    return factors.recommend_factors(model, w.events.users, w.events.items, w.events.old)


def _simple_start(key: str, k: int):
    """Start values both engines can state: (7919 id + 104729 f) mod 1000 / 1000."""
    cells = [F.pmod(F.col(key) * 7919 + F.lit(104729 * (f + 1)), F.lit(1000)) / F.lit(1000.0) for f in range(k)]
    return F.array(*cells)


def _als(w, k=2, steps=2, **more) -> factors.Factors:
    e = w.events
    return als.als_dense(e.centred, e.users, e.items, k, steps, 1e-5, 0.1, 0.1, start=_simple_start, **more)


@query
def als_losses(w):
    losses = _als(w).losses
    rows = w.spark.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "step int, loss double")
    return rounded(rows, "loss", digits=4)


@query
def als_recommend(w):
    return factors.recommend_factors(_als(w), w.events.users, w.events.items, w.events.old)


@query
def als_recommend_reference(w):
    """Only as many items as there are factors are ever updated."""
    return factors.recommend_factors(_als(w, semantics="reference"), w.events.users, w.events.items, w.events.old)


@query
def als_predictions(w):
    """Predicted (centred) values of the later ratings."""
    return rounded(factors.predict_cells(_als(w), w.events.new.select("user_id", "item_id", "rating")), "pred")


@partial(query, show=significant)
def als_recommend_wide(w):
    """Forty factors from hashed start values."""
    e = w.events
    model = als.als_dense(e.centred, e.users, e.items, 40, 6)
    return factors.recommend_factors(model, e.users, e.items, e.old)


@query
def als_recommend_dissimilar(w):
    return factors.recommend_dissimilar(_als(w), w.events.users, w.events.items, w.events.old, w.topic_vectors)


@query
def als_masked_recommend(w):
    model = als.als_masked(w.events.centred, 8, 5)
    return factors.recommend_factors(model, w.events.users, w.events.items, w.events.old)


@query
def als_curve(w):
    """RMSE, coverage and diversity after each sweep."""
    e, out = w.events, None
    model = _als(w, keep_history=True)
    for step, (users, items) in enumerate(model.history):
        state = factors.Factors(users, items, model.k)
        lists = factors.recommend_factors(state, e.users, e.items, e.old)
        row = ev.evaluate(lists, e.new, e.items, w.topic_vectors, extra=ev.rmse(state, e.new, e.means))
        row = row.select(F.lit(step).alias("step"), "rmse", "coverage", "diversity")
        out = row if out is None else out.unionByName(row)
    return out


@query
def graph_transitions(w):
    """Edges of the user-item graph with both step probabilities."""
    edges = stage(walk.graph_edges(w.events.centred), "graph")
    moves = walk.transitions(edges).select("user_id", "item_id", "p_item", "p_user")
    return rounded(moves, "p_item", "p_user")


def _walk(w, semantics="reference") -> DataFrame:
    edges = stage(walk.graph_edges(w.events.centred), "graph")
    return walk.walk_scores(edges, w.events.users, tolerance=WALK_TOLERANCE, semantics=semantics)


@query
def walk_recommend(w):
    return walk.recommend_walk(_walk(w), w.events.users, w.events.items)


@query
def walk_recommend_corrected(w):
    return walk.recommend_walk(_walk(w, "corrected"), w.events.users, w.events.items)


@query
def walk_push(w):
    """The walk's lists by forward push, from the ten best items of each source."""
    edges = stage(walk.graph_edges(w.events.centred), "graph")
    scores = push.push_scores(edges, w.events.users, tolerance=WALK_TOLERANCE, top=10)
    return walk.recommend_walk(scores.select("user_id", "item_id", "score"), w.events.users, w.events.items)


@query
def walk_table(w):
    """The score table [user, item] of chosen sources: users whose id is divisible by 50."""
    edges = stage(walk.graph_edges(w.events.centred), "graph")
    scores = push.push_scores(edges, w.events.users.where("user_id % 50 = 0"), tolerance=1e-9)
    return rounded(scores.where("score >= 1e-6").select("user_id", "item_id", "score"), "score")


EMBED_SIZE, EMBED_MIN_COUNT = 32, 5


def _embedding(w) -> DataFrame:
    model = embed.train(w.gap_baskets, BASKET, EMBED_SIZE, EMBED_MIN_COUNT, epochs=2)
    return embed.item_vectors(model)


def _embedding_lists(w) -> DataFrame:
    return embed.recommend_embedding(w.orders.recent, _embedding(w), EMBED_SIZE)


@query
def w2v_recommend(w):
    return _embedding_lists(w)


@query
def w2v_status(w):
    return embed.status_counts(embed.list_status(w.users, w.orders.recent, _embedding_lists(w)))


@query
def w2v_reload(w):
    """Every trained item once, and whether the stored model gives the same vector."""
    model = embed.train(w.gap_baskets, BASKET, EMBED_SIZE, EMBED_MIN_COUNT, epochs=2)
    path = scratch(w, "model")
    embed.save(model, path)
    again = embed.item_vectors(embed.load(path)).withColumnRenamed("vec", "_again")
    both = embed.item_vectors(model).join(again, "item_id", "full")
    return both.select("item_id", F.col("vec").eqNullSafe(F.col("_again")).alias("same"))


def _tag_directions(w) -> DataFrame:
    vectors = tables.tag_vectors(w.spark, w.folder).join(w.items, "item_id", "left_semi")
    return vectors.select("item_id", unit(F.col("tags")).alias("vec"))


@query
def embedding_recommend(w):
    """Lists from the mean of the recent items, on given vectors instead of trained ones."""
    return embed.recommend_embedding(w.orders.recent, _tag_directions(w), tables.VECTOR_SIZE)


@query
def embedding_recommend_unseen(w):
    return embed.recommend_embedding(w.orders.recent, _tag_directions(w), tables.VECTOR_SIZE, seen=w.orders.old)


@query
def embedding_status(w):
    return embed.status_counts(embed.list_status(w.users, w.orders.recent, embedding_recommend(w)))


def _cbow(w) -> DataFrame:
    return cbow.train(w.gap_baskets, BASKET, EMBED_SIZE, EMBED_MIN_COUNT, epochs=3)


@query
def negative_samples(w):
    """Five items for each user, drawn by their counts in baskets to the power 3/4."""
    vocab = cbow.vocabulary(w.gap_baskets, EMBED_MIN_COUNT)
    text = F.concat_ws("-", F.col("user_id").cast("string"), F.col("slot").cast("string"))
    wanted = w.users.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("slot"))
    return cbow.Guide(vocab).draw(wanted.withColumn("ticket", hex_number(text)), "ticket").select("user_id", "slot", "item_id")


@query
def cbow_vectors(w):
    """Input and output vectors of the items in at least five baskets."""
    return _cbow(w)


@partial(query, show=significant)
def cbow_recommend(w):
    """The likeliest items after the mean of the recent ones, with their probabilities."""
    return cbow.recommend(w.orders.recent, _cbow(w), EMBED_SIZE)


@partial(query, show=lambda lists: rounded(lists, "score", digits=9))
def output_probabilities(w):
    """The same on given vectors, which stand for inputs and outputs."""
    given = _tag_directions(w)
    return cbow.probabilities(cbow.contexts(w.orders.recent, given, tables.VECTOR_SIZE), given, tables.VECTOR_SIZE)


# --- evaluation ---------------------------------------------------------------------------


@query
def eval_hot(w):
    return ev.evaluate(hot_recommend(w), w.orders.new, w.items, w.item_vectors)


@query
def eval_hot_corrected(w):
    return ev.evaluate(hot_recommend(w), w.orders.new, w.items, w.item_vectors, "corrected")


@query
def diversity_random(w):
    lists = stage(random_recommend(w), "lists")
    return rounded(ev.list_diversity(lists, w.item_vectors), "diversity")


@query
def eval_random(w):
    return ev.evaluate(random_recommend(w), w.orders.new, w.items, w.item_vectors)


@query
def eval_item_cf(w):
    return ev.evaluate(item_cf_recommend(w), w.orders.new, w.items, w.item_vectors)


@query
def eval_rules(w):
    brands = w.brands.items
    return ev.evaluate(rule_recommend(w), w.brands.new, brands)


@query
def eval_rules_mean_shift(w):
    return ev.evaluate(rule_recommend_mean_shift(w), w.brands.new, w.brands.items)


@query
def eval_embedding(w):
    return ev.evaluate(embedding_recommend(w), w.orders.new, w.items, w.item_vectors)


@query
def eval_item_cf_mean_shift(w):
    return ev.evaluate(item_cf_mean_shift(w), w.orders.new, w.items, w.item_vectors)


@query
def eval_svd(w):
    e = w.events
    model, _ = _svd(w)
    lists = factors.recommend_factors(model, e.users, e.items, e.old)
    return ev.evaluate(lists, e.new, e.items, w.topic_vectors, extra=ev.rmse(model, e.new, e.means))


@query
def eval_als(w):
    e, model = w.events, _als(w)
    lists = factors.recommend_factors(model, e.users, e.items, e.old)
    return ev.evaluate(lists, e.new, e.items, w.topic_vectors, extra=ev.rmse(model, e.new, e.means))


@query
def eval_walk(w):
    return ev.evaluate(walk_recommend(w), w.events.new, w.events.items, w.topic_vectors)


@query
def eval_w2v(w):
    return ev.evaluate(_embedding_lists(w), w.orders.new, w.items, w.item_vectors)


@query
def eval_cbow(w):
    return ev.evaluate(cbow.recommend(w.orders.recent, _cbow(w), EMBED_SIZE), w.orders.new, w.items, w.item_vectors)
