"""Table layouts of the input data and of the results."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


USERS = _struct(
    user_id=T.LongType(),
    gender=T.StringType(),
    age=T.IntegerType(),
    occupation=T.IntegerType(),
    zip=T.StringType(),
)
ITEMS = _struct(item_id=T.LongType(), title=T.StringType(), genres=T.StringType())
RATINGS = _struct(
    user_id=T.LongType(),
    item_id=T.LongType(),
    rating=T.DoubleType(),
    ts=T.LongType(),
)
TAGS = _struct(tag_id=T.LongType(), tag=T.StringType())
TAG_SCORES = _struct(item_id=T.LongType(), tag_id=T.LongType(), relevance=T.DoubleType())
RECOMMENDATIONS = _struct(
    user_id=T.LongType(),
    rank=T.IntegerType(),
    item_id=T.LongType(),
    score=T.DoubleType(),
)

# The genre vocabulary of the film data, in its published order.
GENRES = (
    "Action",
    "Adventure",
    "Animation",
    "Children's",
    "Comedy",
    "Crime",
    "Documentary",
    "Drama",
    "Fantasy",
    "Film-Noir",
    "Horror",
    "Musical",
    "Mystery",
    "Romance",
    "Sci-Fi",
    "Thriller",
    "War",
    "Western",
)

# Gender codes.
GENDER_CODES = {"F": 0, "M": 1}

SECONDS_PER_DAY = 86400
