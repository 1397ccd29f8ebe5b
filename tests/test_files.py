"""Readers and writers."""

from tastemill.functions import encode
from tastemill.operators import features, sampling
from tastemill.schema import GENDER_CODES, GENRES
from tastemill.sources import files, sinks
from pyspark.sql import functions as F


def test_dat_files(spark, tmp_path):
    (tmp_path / "users.dat").write_text("1::F::1::10::48067\n2::M::56::16::70072\n")
    (tmp_path / "movies.dat").write_bytes('1::"Quoted" (1995)::Animation|Children\'s\n2::Caf\xe9::Drama\n'.encode("latin-1"))
    (tmp_path / "ratings.dat").write_text("1::1193::5::978300760\n2::661::3::978302109\n")
    users = files.read_users(spark, str(tmp_path / "users.dat"))
    assert [tuple(r) for r in users.orderBy("user_id").collect()] == [(1, "F", 1, 10, "48067"), (2, "M", 56, 16, "70072")]
    items = files.read_items(spark, str(tmp_path / "movies.dat"))
    assert [tuple(r) for r in items.orderBy("item_id").collect()] == [(1, '"Quoted" (1995)', "Animation|Children's"), (2, "Café", "Drama")]
    ratings = files.read_ratings(spark, str(tmp_path / "ratings.dat"))
    assert sorted(map(tuple, ratings.collect())) == [(1, 1193, 5.0, 978300760), (2, 661, 3.0, 978302109)]
    flags = items.where("item_id = 1").select(*encode.multi_hot(F.col("genres"), GENRES)).first().asDict()
    assert len(flags) == 18 and {g for g, v in flags.items() if v == 1} == {"Animation", "Children's"}
    coded = users.select("user_id", encode.category_code(F.col("gender"), GENDER_CODES).alias("g"), "age")
    assert [tuple(r) for r in encode.with_min_max(coded, ["age"]).orderBy("user_id").collect()] == [(1, 0, 0.0), (2, 1, 1.0)]
    same = encode.with_min_max(coded.withColumn("age", F.lit(3)), ["age"]).select("age").distinct().collect()
    assert [r[0] for r in same] == [1.0]


def test_csv_files(spark, tmp_path):
    (tmp_path / "tags.csv").write_text('tagId,tag\n1,"a, b"\n2,c\n')
    (tmp_path / "scores.csv").write_text("movieId,tagId,relevance\n1,2,0.25\n1,1,0.5\n7,1,0.125\n9,1,0.1\n")
    tags = files.read_tags(spark, str(tmp_path / "tags.csv"))
    assert sorted(map(tuple, tags.collect())) == [(1, "a, b"), (2, "c")]
    scores = files.read_tag_scores(spark, str(tmp_path / "scores.csv"))
    items = spark.createDataFrame([(1,), (8,)], "item_id long")
    assert {r["item_id"] for r in sampling.up_to_last_item(scores, items).collect()} == {1, 7}
    assert {r["item_id"] for r in sampling.up_to_last_item(scores, items, "corrected").collect()} == {1}
    vectors = {r["item_id"]: r["tags"] for r in features.tag_vectors(scores).collect()}
    assert vectors[1] == [0.5, 0.25]
    sinks.copy_table(tags, str(tmp_path / "copy"), "csv")
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "copy"), tags.schema).collect())) == [(1, "a, b"), (2, "c")]


def test_matrix_files(spark, tmp_path):
    (tmp_path / "rate.csv").write_text("MovieID,1,2.0,3\n10,5.0,,3.5\n11,,,\n12,1,2,\n")
    long = files.read_matrix(spark, str(tmp_path / "rate.csv"), "item_id", "user_id", "rating")
    want = [(10, 1, 5.0), (10, 3, 3.5), (12, 1, 1.0), (12, 2, 2.0)]
    assert sorted((r["item_id"], r["user_id"], r["rating"]) for r in long.collect()) == want
    (tmp_path / "time.csv").write_text("MovieID,1,2\n10,978300760.0,\n")
    times = files.read_matrix(spark, str(tmp_path / "time.csv"), "item_id", "user_id", "ts", "long")
    assert [tuple(r) for r in times.collect()] == [(10, 1, 978300760)]
    sinks.write_matrix(long, str(tmp_path / "out"), "item_id", "user_id", "rating", [1, 2, 3])
    back = files.read_matrix(spark, str(tmp_path / "out"), "item_id", "user_id", "rating")
    assert sorted((r["item_id"], r["user_id"], r["rating"]) for r in back.collect()) == want


def test_exact_sample(spark):
    ids = spark.range(1005).select(F.col("id").alias("item_id"))
    picked = sampling.sample_exact(ids, "item_id", 0.1, "x")
    assert picked.count() == 100 and picked.distinct().count() == 100
    assert sampling.sample_exact(ids, "item_id", 0.1, "y").intersect(picked).count() < 40
