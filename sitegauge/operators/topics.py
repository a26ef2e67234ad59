"""Topics of a corpus: weighted terms, a topic model and readable labels."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.feature import (
    CountVectorizerModel, ElementwiseProduct, Normalizer, StopWordsRemover,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from sitegauge.functions.scalars import first_max_index
from sitegauge.functions.text import topic_tokens, uni_and_bigrams, without_words
from sitegauge.operators import lda
from sitegauge.session import small_table, stage
from sitegauge.sources import dimensions as dims
from sitegauge.sources.fixed_values import DOMAIN_STOP_WORDS, RESISTANCE_LABELS

# Functions that run in tasks are shipped by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Values that a task counts together, texts it takes out of a batch at a time, and rows it gives back at a time.
VALUES_TOGETHER, TEXTS_TOGETHER, ROWS_SENT = 1 << 21, 1024, 1 << 16
# Limits of the vocabulary and settings of the model.
MIN_DOCS = 5
MAX_DOC_SHARE = 0.8
MAX_TERMS = 2000
PASSES = 20


def default_stop_words() -> list[str]:
    """Spark's English list plus the words that every post in this domain uses."""
    return sorted({*StopWordsRemover.loadDefaultStopWords("english"), *DOMAIN_STOP_WORDS})


def with_words(
    posts: DataFrame, text: str, out: str = "words", stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """Tokens without stop words."""
    stops = default_stop_words() if stop_words is None else stop_words
    return posts.withColumn(out, without_words(topic_tokens(text), stops))


def with_terms(
    posts: DataFrame, text: str, out: str = "terms", stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """Tokens without stop words, and the pairs that then stand side by side."""
    return with_words(posts, text, "_kept", stop_words).withColumn(out, uni_and_bigrams(F.col("_kept"))).drop("_kept")


def term_counts(docs: DataFrame, terms: str = "terms") -> DataFrame:
    """term, tf, df: uses in the whole corpus and texts using it."""
    def count(terms: pa.Array, sizes: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        coded = terms.dictionary_encode("encode")
        places = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return coded.dictionary, *uses(places, np.repeat(np.arange(len(sizes)), sizes), len(coded.dictionary))

    return counted(docs, terms, count)


def pair_counts(docs: DataFrame, words: str, common: pa.Array) -> DataFrame:
    """term, tf, df of the pairs of words side by side in ``words``, both of which are among the common ones."""
    def count(found: pa.Array, sizes: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        place = pc.fill_null(pc.index_in(found, common), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.repeat(np.arange(len(sizes)), sizes)
        first = np.flatnonzero((place[:-1] >= 0) & (place[1:] >= 0) & (text[:-1] == text[1:]))
        different, pair = np.unique(place[first] * len(common) + place[first + 1], return_inverse=True)
        left, right = (common.take(pa.array(at)) for at in np.divmod(different, max(len(common), 1)))
        return pc.binary_join_element_wise(left, right, " "), *uses(pair, text[first], len(different))

    return counted(docs, words, count)


def uses(term: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each of ``n`` terms is used, and by how many texts."""
    # Once per text: its equal terms stand side by side when sorted.
    both = np.sort(text * n + term)
    return np.bincount(term, minlength=n), np.bincount(both[np.diff(both, prepend=-1) > 0] % max(n, 1), minlength=n)


def counted(docs: DataFrame, column: str, count: Callable) -> DataFrame:
    """term, tf, df, from what ``count`` gives for the lists of some texts: their values one after another, and their lengths.

    A task hands over the texts of ``VALUES_TOGETHER`` values or so at a time; what travels is a row per term of each such part.
    """
    def rows(parts: list) -> Iterator:
        terms, tf, df = count(pa.concat_arrays([values for values, _ in parts]), np.concatenate([sizes for _, sizes in parts]))
        whole = pa.RecordBatch.from_arrays([terms, pa.array(tf, pa.int64()), pa.array(df, pa.int64())], names=["term", "tf", "df"])
        for at in range(0, whole.num_rows, ROWS_SENT):
            yield whole.slice(at, ROWS_SENT)

    def run(batches: Iterator) -> Iterator:
        parts, held = [], 0
        for batch in batches:
            # A batch may hold many long texts.
            for at in range(0, batch.num_rows, TEXTS_TOGETHER):
                texts = batch.column(0).slice(at, TEXTS_TOGETHER)
                parts.append((texts.flatten(), pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)))
                held += len(parts[-1][0])
                if held >= VALUES_TOGETHER:
                    yield from rows(parts)
                    parts, held = [], 0
        if held:
            yield from rows(parts)

    return docs.select(F.col(column).alias("values")).mapInArrow(run, "term string, tf long, df long").groupBy("term").agg(
        F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def vocabulary(
    counts: DataFrame, n_docs: int, min_docs: int = MIN_DOCS,
    max_share: float = MAX_DOC_SHARE, max_terms: int = MAX_TERMS,
) -> DataFrame:
    """The most used terms that are neither rare nor everywhere, with their idf."""
    kept = counts.filter((F.col("df") >= min_docs) & (F.col("df") <= max_share * n_docs))
    return (
        kept.orderBy(F.desc("tf"), F.asc("term")).limit(max_terms)
        .withColumn("idf", F.log(F.lit(1.0 + n_docs) / (F.col("df") + 1)) + 1.0))


class TfIdf:
    """Vocabulary of at most MAX_TERMS terms and the weights that go with it."""

    def __init__(self, terms: list[str], idf: list[float]):
        self.terms = terms
        self.idf = idf

    def transform(self, docs: DataFrame, terms: str = "terms", out: str = "features") -> DataFrame:
        count = CountVectorizerModel.from_vocabulary(self.terms, inputCol=terms, outputCol="_tf")
        weigh = ElementwiseProduct(
            scalingVec=Vectors.dense(self.idf), inputCol="_tf", outputCol="_tfidf")
        unit = Normalizer(p=2.0, inputCol="_tfidf", outputCol=out)
        return unit.transform(weigh.transform(count.transform(docs))).drop("_tf", "_tfidf")


def fit_tfidf(docs: DataFrame, terms: str = "terms", words: str | None = None, **limits) -> TfIdf:
    """The vocabulary of ``terms`` as ``with_terms`` gives them: words, which a column of their own may hold, then pairs.

    A pair is used at most as often, and by as many texts, as each of its words.  So pairs are counted only of words
    that are in enough texts and used no less than the last word that a vocabulary of words alone would have.
    """
    if words is None:
        single = F.slice(terms, F.lit(1), F.floor((F.size(terms) + 1) / 2).cast("int"))
        docs, words = docs.select(single.alias("words")), "words"
    n_docs = docs.count()
    of_words = stage(term_counts(docs, words), "word-counts")
    chosen = vocabulary(of_words, n_docs, **limits).agg(F.count(F.lit(1)), F.min("tf")).head()
    least = chosen[1] if chosen[0] >= limits.get("max_terms", MAX_TERMS) else 0
    common = of_words.filter((F.col("df") >= limits.get("min_docs", MIN_DOCS)) & (F.col("tf") >= least)).select("term")
    pairs = pair_counts(docs, words, common.toArrow().column(0).combine_chunks())
    kept = vocabulary(of_words.unionByName(pairs), n_docs, **limits).collect()
    if not kept:
        raise ValueError("no term is common enough to describe the texts")
    return TfIdf([r["term"] for r in kept], [r["idf"] for r in kept])


def with_topic_weights(
    features: DataFrame, model: lda.TopicModel, column: str = "features", kept_in: str | None = None,
) -> DataFrame:
    """topic_i_weight columns that sum to one, and the strongest topic of each text.

    A text without any known term says nothing about topics.  The weighted terms go, unless a column is named to keep them in.
    """
    keep = [c for c in features.columns if c != column]
    if kept_in is not None:
        features, keep = features.withColumn(kept_in, F.col(column)), [*keep, kept_in]
    weighted = features.select(*keep, model.shares(F.col(column)).alias("_w")).select(
        *keep, *[F.get("_w", F.lit(i)).alias(f"topic_{i}_weight") for i in range(model.k)])
    return weighted.withColumn(
        "dominant_topic", first_max_index([f"topic_{i}_weight" for i in range(model.k)]))


def top_terms(spark, model: lda.TopicModel, terms: Sequence[str], n: int = 15) -> DataFrame:
    """topic_id and its n strongest terms, strongest first."""
    rows = [(t, [terms[i] for i in best]) for t, best in enumerate(model.top_terms(n))]
    return small_table(spark, rows, "topic_id int, top_words array<string>")


def label_topics(topics: DataFrame, keywords: DataFrame | None = None, least: int = 2) -> DataFrame:
    """topic_id, label, top_words: the label sharing most keywords, else the top word.

    At least ``least`` keywords must be shared; the earlier label wins a tie.
    """
    keywords = keywords if keywords is not None else dims.topic_keywords(topics.sparkSession)
    folded = topics.withColumn("_words", F.array_distinct(F.transform("top_words", F.lower)))
    word_rows = folded.select("topic_id", F.explode("_words").alias("word"))
    keyed = keywords.select("label", "pos", F.explode("keywords").alias("word"))
    overlaps = word_rows.join(keyed, "word").groupBy("topic_id", "label", "pos").agg(
        F.count(F.lit(1)).alias("overlap"))
    best = overlaps.filter(F.col("overlap") >= least).groupBy("topic_id").agg(
        F.max_by("label", F.struct("overlap", -F.col("pos"))).alias("_label"))
    return topics.join(best, "topic_id", "left").select(
        "topic_id",
        F.coalesce("_label", F.concat(F.lit("Cluster: "), F.get("top_words", F.lit(0)))).alias("label"),
        "top_words")


def resistance_topics(summary: DataFrame) -> list[int]:
    """Ids of the topics whose label speaks of resistance."""
    found = summary.filter(F.col("label").isin(RESISTANCE_LABELS)).select("topic_id")
    return sorted(r[0] for r in found.collect())  # one row per topic


def topic_distribution(posts: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Texts per dominant topic and their share in percent."""
    from sitegauge.operators.profile import value_shares

    shares = value_shares(posts, "dominant_topic").withColumnRenamed("dominant_topic", "topic_id")
    return shares if summary is None else shares.join(
        summary.select("topic_id", "label"), "topic_id", "left")


def extract_topics(
    posts: DataFrame, text: str = "clean_text", k: int = 6, seed: int = 42,
    stop_words: Sequence[str] | None = None, passes: int = PASSES, kept_in: str | None = None, **limits,
) -> tuple[DataFrame, DataFrame, lda.TopicModel, TfIdf]:
    """Posts with topic weights, the labelled topics, and the fitted models.

    The weighted terms of the texts are staged with them; ``kept_in`` names a column to give those in.
    """
    if text not in posts.columns:
        raise ValueError(f"posts must have a {text!r} column")
    words = stage(with_words(posts.select(text), text, "_words", stop_words).select("_words"), "words")
    tfidf = fit_tfidf(words, words="_words", **limits)
    docs = with_terms(posts, text, "_terms", stop_words)
    features = stage(tfidf.transform(docs, "_terms", "_features").drop("_terms"), "terms-of-texts")
    model = lda.fit(features, len(tfidf.terms), k, seed, passes, "_features")
    weighted = with_topic_weights(features, model, "_features", kept_in)
    return weighted, label_topics(top_terms(posts.sparkSession, model, tfidf.terms)), model, tfidf
