import pytest
from pyspark.sql import SparkSession

from tastemill.session import stage, tune

DAY = 86400

RATED = [
    (1, 1, 5, 0), (1, 2, 3, 1), (1, 3, 4, 2), (1, 4, 1, 40), (1, 5, 2, 100),
    (2, 1, 4, 0), (2, 2, 2, 10), (2, 3, 5, 60), (2, 6, 3, 61),
    (3, 2, 5, 0), (3, 3, 4, 1), (3, 4, 2, 2), (3, 5, 1, 3), (3, 6, 4, 4),
    (4, 6, 5, 5),
]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("staging")))
    )
    session = tune(builder.getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


class Tiny:
    """The hand-made fixture: four users, six items."""

    def __init__(self, spark):
        from tastemill.operators.split import centred, new_part, old_part, with_cut

        rows = [(u, i, float(r), d * DAY) for u, i, r, d in RATED]
        self.ratings = stage(spark.createDataFrame(rows, "user_id long, item_id long, rating double, ts long").coalesce(1), "r")
        self.users = spark.createDataFrame([(u,) for u in range(1, 5)], "user_id long")
        self.items = spark.createDataFrame([(i,) for i in range(1, 7)], "item_id long")
        self.genres = spark.createDataFrame(
            [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 1.0]), (5, [1.0, 1.0]), (6, [1.0, 0.0])],
            "item_id long, genre_vec array<double>",
        )
        self.tags = spark.createDataFrame(
            [(1, [0.9, 0.1]), (2, [0.8, 0.2]), (3, [0.1, 0.9]), (4, [0.2, 0.7]), (5, [0.5, 0.5])],
            "item_id long, tags array<double>",
        )
        cut = stage(with_cut(self.ratings), "cut")
        self.old, self.new = stage(old_part(cut), "old"), stage(new_part(cut), "new")
        self.centred = stage(centred(self.old), "centred")


@pytest.fixture(scope="session")
def tiny(spark):
    return Tiny(spark)


def sets(df, key="user_id", value="item_id"):
    out = {}
    for row in df.collect():
        out.setdefault(row[key], set()).add(row[value])
    return out


def lists(df):
    out = {}
    for row in sorted(df.collect(), key=lambda r: (r["user_id"], r["rank"])):
        out.setdefault(row["user_id"], []).append((row["item_id"], row["score"]))
    return out
