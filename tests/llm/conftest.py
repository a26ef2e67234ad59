import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use inside.
    T.StructField("id", T.LongType()), T.StructField("key", T.StringType()), T.StructField("size", T.LongType()),
    T.StructField("spans", T.StringType()), T.StructField("fp", T.LongType()), T.StructField("place", T.LongType()),
    T.StructField("stratum", T.StringType()), T.StructField("word", T.StringType()), T.StructField("score", T.DoubleType()),
])
PROSE = "the quick brown fox jumps over the lazy dog while seven small birds watch from a tall old tree near the river"


def rows_of(texts):
    """Rows of documents from (doc_id, text, lang, source)."""
    return [(i, t, lang, source, None if t is None else len(t), 1, "k", 2, "s", 3, 4, "x", "w", 0.5)
            for i, t, lang, source in texts]


#: Nulls in every column, empty and very long texts, ties and repeated rows.
ODD = [
    (1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \t\n\x0b\x0c\r ", "en", None),
    (None, PROSE + " again", "en", "b"), (None, None, None, None), (5, "one", "de", "b"), (6, "One two", "de", "b"),
    (7, ("password=abcdefgh12345 " + PROSE + "\n") * 3000, "en", "a"), (8, "x" * 100_000, "en", "c"),
    (9, "é ü ß 中文 \U0001f600 secret: 'Zz09+/_.=-x' ſ K \x00 end", "fr", "c"), (10, PROSE.upper(), "en", "a"),
]


@pytest.fixture(scope="session", autouse=True)
def checkpoint_folder(spark, tmp_path_factory):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows_of(ODD), DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def make(spark):
    def build(texts):
        return spark.createDataFrame(rows_of([(i, t, "en", "a") if not isinstance(t, tuple) else (i, *t) for i, t in texts]), DOCS)

    return build


@pytest.fixture(scope="session")
def texts(duck):
    """(doc_id, text) of the test documents."""
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()
