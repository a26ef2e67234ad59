"""Latent topics by online variational Bayes over mini-batches that are laid out once.

The texts' weighted terms are written in hash buckets, each a folder of its own, and a step reads one of them: a pass reads
every text once, whatever the number of passes.  A step's tasks fit the topic shares of their texts and add up the expected
uses of each term in each topic; only these sums (topics times terms, which the vocabulary's limit bounds) reach the driver,
where they move the topics.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.session import shared_dir

# Functions that run in tasks are shipped by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Texts of a mini-batch, and the most batches that a pass is cut into; beyond that the batches grow.
BATCH_TEXTS, MOST_BATCHES = 128, 4
# How fast later steps lose weight.
OFFSET, DECAY = 10.0, 0.7
#: Most rounds of the fit of one text's shares while topics are learned, and the mean change that ends them.
ROUNDS, SETTLED = 100, 1e-3
#: Most texts, and terms of these, that are fitted together in a task, and texts of about the same size.
TOGETHER, TERMS_TOGETHER, ALIKE = 2048, 1 << 18, 64


def digamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by the recurrence up to 6 and the asymptotic series beyond."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(6):
        out -= 1 / x
        x = x + 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by the recurrence up to 6 and the asymptotic series beyond."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(6):
        out -= np.log(x)
        x = x + 1
    y = 1 / (x * x)
    return out + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x


def expectation(x: np.ndarray) -> np.ndarray:
    """E[log share] of Dirichlet rows."""
    return digamma(x) - digamma(x.sum(axis=-1))[..., None]


def settled(terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray, topics: np.ndarray, alpha: float,
            rounds: int | None = ROUNDS) -> np.ndarray:
    """Dirichlet parameters of each text's topic shares.

    ``terms`` and ``counts`` hold the texts one after another, ``sizes`` how many belong to each; ``topics`` is
    exp(E[log p(term | topic)]), a row per topic.  A text leaves the rounds when it has settled; with ``rounds`` None
    they go on until every text has, as each round raises the bound.  Texts of about the same size are filled up to the
    longest of ``ALIKE`` and take a round as matrix products.
    """
    k, n = len(topics), len(sizes)
    starts = np.cumsum(sizes) - sizes
    total = np.bincount(np.repeat(np.arange(n), sizes), counts, n)
    gamma = np.repeat(alpha + total[:, None] / k, k, axis=1)
    open_texts = np.argsort(sizes, kind="stable")
    open_texts = open_texts[sizes[open_texts] > 0]
    bands = []
    for at in range(0, len(open_texts), ALIKE):
        some = open_texts[at : at + ALIKE]
        place = np.arange(sizes[some[-1]])
        inside = place < sizes[some][:, None]
        place = np.where(inside, starts[some][:, None] + place, 0)
        bands.append((np.ascontiguousarray(topics[:, terms[place]].transpose(1, 0, 2)), np.where(inside, counts[place], 0.0)))
    done = 0
    while len(open_texts) and (rounds is None or done < rounds):
        done += 1
        theta = np.exp(expectation(gamma[open_texts]))
        new, ends = np.empty_like(theta), np.cumsum([len(held) for _, held in bands])
        for (weight, held), end in zip(bands, ends):
            here = slice(end - len(held), end)
            part = np.matmul(theta[here, None, :], weight)[:, 0, :]
            np.divide(held, np.maximum(part, 1e-300, out=part), out=part)
            new[here] = np.matmul(weight, part[:, :, None])[:, :, 0]
        new = alpha + theta * new
        moving = np.abs(new - gamma[open_texts]).mean(axis=1) >= SETTLED
        gamma[open_texts] = new
        # Those that have settled are taken out a tenth at a time, as that costs about a round.
        if not moving.any():
            break
        if moving.sum() <= 0.9 * len(moving):
            kept = np.split(moving, ends[:-1])
            bands = [(weight[m], held[m]) for (weight, held), m in zip(bands, kept) if m.any()]
            open_texts = open_texts[moving]
    return gamma


def text_shares(terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray, topics: np.ndarray, alpha: float,
                rounds: int | None = ROUNDS):
    """What ``settled`` gives, and of each term of each text the expected topic weights."""
    gamma = settled(terms, counts, sizes, topics, alpha, rounds)
    part = np.repeat(np.exp(expectation(gamma)).T, sizes, axis=1)
    part *= topics[:, terms]
    part *= counts / np.maximum(part.sum(axis=0), 1e-300)
    return gamma, part.T


def portions(sizes: np.ndarray) -> Iterator[slice]:
    """Texts to fit together: at most ``TOGETHER``, and ``TERMS_TOGETHER`` terms where they are more than one."""
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        some = np.searchsorted(ends, (ends[at - 1] if at else 0) + TERMS_TOGETHER, side="right")
        until = int(min(at + TOGETHER, max(at + 1, some), len(sizes)))
        yield slice(at, until)
        at = until


def text_bounds(terms, counts, sizes, gamma, topics, alpha: float) -> np.ndarray:
    """Each text's part of the variational bound of the log likelihood."""
    k, n = gamma.shape[1], len(sizes)
    row = np.repeat(np.arange(n), sizes)
    log_theta = expectation(gamma)
    inner = np.repeat(np.exp(log_theta).T, sizes, axis=1)
    inner *= topics[:, terms]
    words = np.bincount(row, counts * np.log(np.maximum(inner.sum(axis=0), 1e-300)), n)
    prior = ((alpha - gamma) * log_theta + log_gamma(gamma)).sum(axis=1) - k * math.lgamma(alpha) \
        + math.lgamma(alpha * k) - log_gamma(gamma.sum(axis=1))
    return words + prior


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column one after another, and the lists' lengths."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)


class TopicModel:
    """Dirichlet parameters of the topics (a row per topic, a column per term) and the prior of a text's shares."""

    def __init__(self, parameters: np.ndarray, bound: float | None = None):
        self.parameters = parameters
        self.alpha = 1.0 / len(parameters)
        #: Variational bound of the log likelihood per text at the last pass.
        self.bound = bound

    @property
    def k(self) -> int:
        return len(self.parameters)

    def top_terms(self, n: int) -> list[list[int]]:
        """Places of each topic's strongest terms, strongest first, ties by place."""
        shares = self.parameters / self.parameters.sum(axis=1, keepdims=True)
        return [np.lexsort((np.arange(len(s)), -s))[:n].tolist() for s in shares]

    def shares(self, features: Column) -> Column:
        """Topic shares of a text as an array that sums to one; equal shares for a text without a known term."""
        topics, alpha, k = np.exp(expectation(self.parameters)), self.alpha, self.k

        @F.pandas_udf("array<double>")
        def of(terms: pd.Series, counts: pd.Series) -> pd.Series:
            out = []
            every = np.array([len(t) for t in terms], int)
            for some in portions(every):
                sizes, places = every[some], np.concatenate([*terms[some], np.zeros(0)]).astype(int)
                gamma = settled(places, np.concatenate([*counts[some], np.zeros(0)]), sizes, topics, alpha, None)
                gamma[sizes == 0] = 1.0
                out += (gamma / gamma.sum(axis=1, keepdims=True)).tolist()
            return pd.Series(out)

        return of(*sparse(features))


def sparse(features: Column) -> tuple[Column, Column]:
    """Places and values of a sparse vector's terms."""
    inner = F.unwrap_udt(features)
    dense = F.filter(F.sequence(F.lit(0), F.size(inner["values"]) - 1), lambda i: F.get(inner["values"], i) != 0)
    places = F.when(inner["indices"].isNotNull(), inner["indices"]).when(F.size(inner["values"]) > 0, dense).otherwise(
        F.array().cast("array<int>"))
    return places, F.when(inner["indices"].isNotNull(), inner["values"]).otherwise(
        F.transform(places, lambda i: F.get(inner["values"], i)))


def lay_out(features: DataFrame, column: str, n: int) -> tuple[str, int]:
    """Write the weighted terms in hash buckets of about ``BATCH_TEXTS`` texts, at most ``MOST_BATCHES``; path and number."""
    terms, counts = sparse(F.col(column))
    buckets = max(1, min(MOST_BATCHES, -(-n // BATCH_TEXTS)))
    path = f"{shared_dir(features.sparkSession).rstrip('/')}/mini-batches-{uuid.uuid4().hex}"
    rows = features.select(terms.alias("terms"), counts.alias("counts"), F.pmod(
        F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int").alias("bucket"))
    rows.write.partitionBy("bucket").parquet(path)
    return path, buckets


def expected_uses(texts: DataFrame, parameters: np.ndarray, alpha: float) -> tuple[np.ndarray, float, int]:
    """Expected uses of each term in each topic over the texts, their part of the bound, and their number."""
    k, v = parameters.shape

    def run(batches: Iterator) -> Iterator:
        topics = np.exp(expectation(parameters))
        uses, bound, n = np.zeros((k, v)), 0.0, 0
        for whole in batches:
            for some in portions(flat(whole.column(0))[1]):
                batch = whole.slice(some.start, some.stop - some.start)
                terms, sizes = flat(batch.column(0))
                counts, _ = flat(batch.column(1))
                gamma, part = text_shares(terms, counts, sizes, topics, alpha)
                for t in range(k):
                    uses[t] += np.bincount(terms, part[:, t], v)
                bound += float(text_bounds(terms, counts, sizes, gamma, topics, alpha).sum())
                n += len(sizes)
        topic, term = np.nonzero(uses)
        # Topic -1 carries the bound, topic -2 the number of texts.
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([topic, [-1, -2]]).astype(np.int32)), pa.array(np.concatenate([term, [0, 0]]).astype(np.int32)),
            pa.array(np.concatenate([uses[topic, term], [bound, n]]))], names=["topic", "term", "v"])

    sums = texts.select("terms", "counts").mapInArrow(run, "topic int, term int, v double")
    told = sums.groupBy("topic", "term").agg(F.sum("v").alias("v")).toArrow()  # at most topics times terms
    topic, term, value = (told.column(c).to_numpy() for c in ("topic", "term", "v"))
    uses = np.zeros((k, v))
    real = topic >= 0
    uses[topic[real], term[real]] = value[real]
    return uses, float(value[topic == -1].sum()), int(value[topic == -2].sum())


def topics_bound(parameters: np.ndarray, eta: float) -> float:
    """The topics' own part of the bound."""
    k, v = parameters.shape
    logs = expectation(parameters)
    return float((((eta - parameters) * logs + log_gamma(parameters)).sum(axis=1) - log_gamma(parameters.sum(axis=1))).sum()
                 + k * (math.lgamma(eta * v) - v * math.lgamma(eta)))


def first_topics(k: int, n_terms: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).gamma(100.0, 0.01, (k, n_terms))


def fit(features: DataFrame, n_terms: int, k: int = 6, seed: int = 42, passes: int = 20, column: str = "features") -> TopicModel:
    """Fit ``k`` topics to the weighted terms of ``column`` in ``passes`` passes; all texts are read in each."""
    n = features.count()
    path, buckets = lay_out(features, column, n)
    spark = features.sparkSession
    eta = alpha = 1.0 / k
    parameters, step, bound = first_topics(k, n_terms, seed), 0, None
    texts = spark.read.schema("terms array<int>, counts array<double>, bucket int").parquet(path)
    for _ in range(passes):
        parts = 0.0
        for bucket in range(buckets):
            # Only this bucket's folder is read.
            uses, part, size = expected_uses(texts.where(F.col("bucket") == bucket), parameters, alpha)
            parts += part
            if size:
                step += 1
                rate = (OFFSET + step) ** -DECAY
                parameters = (1 - rate) * parameters + rate * (eta + n / size * uses)
        bound = (parts + topics_bound(parameters, eta)) / max(1, n)
    return TopicModel(parameters, bound)
