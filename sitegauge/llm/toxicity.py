"""Toxicity by two class-conditional Kneser-Ney models.

For each class (toxic, ordinary) the labelled texts in which a word, or a word after another, occurs are counted.  A
class gives a word its count less an absolute discount, and the discounted share goes to what both classes share: the
number of different words that the word was seen after, in either class.  The discounts are set so that both classes
hand the same share to that common backoff, however many texts each has.  A rare expression, one that both counts leave
to the backoff, is then equally likely under both and tells nothing, unless its counts alone say that it is commoner in
toxic texts: then it keeps them less the usual discount (below 1, from counts of counts).  How many texts that takes does
not rise with their number, so insults that are each rare count too.  What this adds to a class's sum is one constant for
all words, which the fit below takes up.

A text's score is the mean over its words of the difference of the two log-likelihoods, turned into a probability by a
monotone fit on labelled texts that were not counted.  Of a few discounts and of word and word-pair models the one that
predicts those texts best is taken.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.llm.words import bound_batches
from sitegauge.session import stage

#: About so many labelled rows are used at most, picked by a hash; they are few enough to be sent to every task.
FIT_ROWS = 200_000
#: Discounts as shares of the toxic class's texts.
SHARES = (0.02, 0.05, 0.1, 0.2)
#: Log-likelihood ratio from which counts alone tell: a chance of about one in a million per expression.
EVIDENCE = 12.0
THRESHOLD = 0.7
BINS, WIDTH = 1600, 0.00125
#: Expressions that a task counts at a time.
HELD = 200_000

# Bytes that part words: ASCII other than letters and digits.
PARTING = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().translate(PARTING).split() if text else []


@dataclass
class Model:
    """Differences of log-likelihoods, for words and for pairs; anything else differs by nothing."""

    words: dict[bytes, float]
    pairs: dict[tuple[bytes, bytes], float]
    contexts: dict[bytes, float]

    def score(self, words: list[bytes]) -> float:
        if not words:
            return 0.0
        if not self.contexts:
            get = self.words.get
            return sum([get(w, 0.0) for w in words]) / len(words)
        total, before = 0.0, b""
        for w in words:
            known = self.pairs.get((before, w))
            if known is None:
                known = self.words.get(w, 0.0) + self.contexts.get(before, 0.0)
            total += known
            before = w
        return total / len(words)


def held_out(id_col: str) -> Column:
    return fold(id_col) == 1


def fold(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(``text``, ``y``, ``fold``) of about ``rows`` labelled rows at most; an id with several labels is toxic if one says so."""
    bound_batches(docs.sparkSession)
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(~held_out(id_col)).groupBy(
        id_col).agg((F.max(label_col) == 1).cast("int").alias("y"))
    marks = stage(marks, "labels")
    share = min(1.0, rows / max(1, marks.count()))
    picked = marks.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), id_col).select(
        "text", "y", fold(id_col).alias("fold"))


def counts(rows: DataFrame) -> DataFrame:
    """(``h``, ``w``, ``n0``, ``n1``): texts per class that hold a word (null ``h``) or a pair; ``h`` empty at the beginning.

    A task holds ``HELD`` expressions at a time, whatever the size of its texts.
    """
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        # Words hold no spaces, so a pair is one key; both classes' counts are one number.
        seen: dict[bytes, int] = {}
        get, high = seen.get, 1 << 32

        def flush() -> pa.RecordBatch:
            keys, both = list(seen), list(seen.values())
            parts = [k.split(b" ") for k in keys]
            seen.clear()
            return pa.RecordBatch.from_arrays([
                pa.array([p[0] if len(p) == 2 else None for p in parts], pa.binary()), pa.array([p[-1] for p in parts], pa.binary()),
                pa.array([n % high for n in both], pa.int64()), pa.array([n // high for n in both], pa.int64())],
                names=["h", "w", "n0", "n1"])

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                words = words_of(text.as_py())
                more = high if y else 1
                for found in (words, map(b" ".join, zip([b"", *words], words))):
                    for key in set(found):
                        seen[key] = get(key, 0) + more
                    if len(seen) >= HELD:
                        yield flush()
        if seen:
            yield flush()

    partial = rows.select("text", "y").mapInArrow(run, "h binary, w binary, n0 bigint, n1 bigint")
    return partial.groupBy("h", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


@dataclass
class Evidence:
    """What every fit needs: sizes of counts, and the counts of the expressions that the smallest discount leaves or that tell.

    ``words`` and ``pairs`` have an expression's counts, whether it tells, and how many different words stand before the
    (second) word; ``heads`` has the counts of all pairs that begin with a word.
    """

    sizes: dict[bool, dict[int, Counter]]
    all_pairs: int
    words: dict[bytes, tuple[int, int, bool, int]]
    pairs: dict[tuple[bytes, bytes], tuple[int, int, bool, int]]
    heads: dict[bytes, tuple[int, int]]


def gather(rows: DataFrame, discount: float) -> Evidence | None:
    """Counts of ``rows`` for discounts of ``discount`` and above, which leave fewer expressions; None without both classes.

    Gathered are the expressions above the discount, at most mean text size * texts / discount of them, and those that tell.
    Each of these is in at least EVIDENCE / ln(all / toxic) of the counted toxic texts, which ``labelled`` bounds at any size.
    """
    counted = stage(counts(rows), "expressions")
    sizes: dict[bool, dict[int, Counter]] = {p: {0: Counter(), 1: Counter()} for p in (False, True)}
    by_class = counted.select(F.col("h").isNotNull().alias("pair"), F.explode(F.array(*[
        F.struct(F.lit(y).alias("y"), F.col(f"n{y}").alias("n")) for y in (0, 1)])).alias("c")).select("pair", "c.*")
    # One row per different count.
    for r in by_class.where("n > 0").groupBy("pair", "y", "n").agg(F.count(F.lit(1)).alias("k")).collect():
        sizes[r.pair][r.y][r.n] = r.k
    if not all(sizes[p][y] for p in sizes for y in (0, 1)):
        return None

    def left(pair: bool) -> DataFrame:
        totals, _, less = balanced(sizes[pair], discount)
        known = counted.where(F.col("h").isNotNull() if pair else F.col("h").isNull())
        return known.withColumn("tells", telling(totals)).where((F.col("n0") > less[0]) | (F.col("n1") > less[1]) | F.col("tells"))

    strong = stage(left(False).unionByName(left(True)), "strong")
    pairs = counted.where(F.col("h").isNotNull())
    before = pairs.groupBy("w").agg(F.count(F.lit(1)).alias("before"))
    heads = pairs.groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).join(
        strong.select("h").distinct(), "h", "left_semi")
    seen = Evidence(sizes, pairs.count(), {}, {}, {bytes(r.h): (r.n0, r.n1) for r in heads.collect()})
    for r in strong.join(before, "w").collect():
        counts_of = r.n0, r.n1, r.tells, r.before
        if r.h is None:
            seen.words[bytes(r.w)] = counts_of
        else:
            seen.pairs[bytes(r.h), bytes(r.w)] = counts_of
    return seen


def balanced(sizes: dict[int, Counter], discount: float) -> tuple[list[int], float, list[float]]:
    """Totals, the share given to the backoff, and the discount per class that frees just that share."""
    totals = [sum(c * k for c, k in sizes[y].items()) for y in (0, 1)]
    freed = lambda y, d: sum(min(c, d) * k for c, k in sizes[y].items()) / totals[y]
    share = freed(1, discount)
    low, high = 0.0, float(max(sizes[0]))
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if freed(0, mid) < share else (low, mid)
    return totals, share, [high, discount]


def usual_discount(sizes: Counter) -> float:
    """The absolute discount from counts of counts; below 1 whatever the number of texts."""
    return sizes[1] / (sizes[1] + 2 * sizes[2]) if sizes[1] and sizes[2] else 0.5


def telling(totals: list[int]) -> Column:
    """Whether an expression is commoner in toxic texts beyond chance, by its own counts."""
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    part = lambda n, total: F.when(n > 0, n * F.log(n * float(sum(totals)) / ((n0 + n1) * float(total)))).otherwise(0.0)
    return (n1 * float(totals[0]) > n0 * float(totals[1])) & (part(n0, totals[0]) + part(n1, totals[1]) >= EVIDENCE)


def kept(c: list[int], tells: bool, less: list[float], usual: list[float], totals: list[int], shared: float) -> list[float]:
    """Both counts less the discounts; an expression that tells gets the usual ones where they say more."""
    large = [max(c[y] - less[y], 0.0) for y in (0, 1)]
    if not tells:
        return large
    return max(large, [max(c[y] - usual[y], 0.0) for y in (0, 1)],
               key=lambda x: (x[1] / totals[1] + shared) / (x[0] / totals[0] + shared))


def fit(seen: Evidence, discount: float, order: int) -> Model:
    """The model for one discount, at least the one of ``gather``."""
    def taken(found: dict, less: list[float]):
        return ((key, n0, n1, tells, before) for key, (n0, n1, tells, before) in found.items()
                if tells or n0 > less[0] or n1 > less[1])

    n, backoff, less = balanced(seen.sizes[False], discount)
    usual = [usual_discount(seen.sizes[False][y]) for y in (0, 1)]
    p: list[dict[bytes, float]] = [{}, {}]
    for w, n0, n1, tells, before in taken(seen.words, less):
        shared = backoff * before / seen.all_pairs
        for y, x in enumerate(kept([n0, n1], tells, less, usual, n, shared)):
            p[y][w] = x / n[y] + shared
    words = {w: math.log(p[1][w] / p[0][w]) for w in p[0]}
    if order == 1:
        return Model(words, {}, {})
    n, _, less = balanced(seen.sizes[True], discount)
    usual = [usual_discount(seen.sizes[True][y]) for y in (0, 1)]
    over: dict[tuple[bytes, bytes], list[float]] = {}
    for key, n0, n1, tells, before in taken(seen.pairs, less):
        shared = backoff * before / seen.all_pairs
        over[key] = [*kept([n0, n1], tells, less, usual, n, shared), shared]
    lower: dict[bytes, list[float]] = {}
    for (h, _), x in over.items():
        sums = lower.setdefault(h, [0.0, 0.0])
        sums[0] += x[0]
        sums[1] += x[1]
    rest = {h: [1 - x[y] / seen.heads[h][y] if seen.heads[h][y] else 1.0 for y in (0, 1)] for h, x in lower.items()}
    contexts = {h: math.log(max(r[1], 1e-9) / max(r[0], 1e-9)) for h, r in rest.items()}
    table = {}
    for (h, w), x in over.items():
        held = seen.heads[h]
        q = [(x[y] / held[y] if held[y] else 0.0) + rest[h][y] * p[y].get(w, x[2]) for y in (0, 1)]
        table[h, w] = math.log(max(q[1], 1e-12) / max(q[0], 1e-12))
    return Model(words, table, contexts)


def bin_of(score: float) -> int:
    return min(BINS - 1, max(0, int(score / WIDTH) + BINS // 2 if score >= 0 else BINS // 2 - 1 - int(-score / WIDTH)))


def monotone(ones: list[float], all_: list[float]) -> list[float]:
    """Rising probability per bin: neighbouring bins out of order are pooled; empty bins take the one below."""
    blocks: list[list[float]] = []
    for a, b in zip(ones, all_):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            x = blocks.pop()
            blocks[-1] = [blocks[-1][0] + x[0], blocks[-1][1] + x[1], blocks[-1][2] + x[2]]
    # Half a row of either kind keeps a block of few rows from certainty.
    return [(a + 0.5) / (b + 1.0) if b else 0.5 for a, b, n in blocks for _ in range(int(n))]


def train(rows: DataFrame) -> tuple[Model, list[float]]:
    """The best model and its probability per bin."""
    import pyarrow as pa

    counted, measured = rows.where("fold = 0"), rows.where("fold <> 0")
    n_toxic = counted.where("y = 1").count()
    discounts = [max(1.0, share * n_toxic) for share in SHARES]
    seen = gather(counted, min(discounts)) if n_toxic else None
    models = [fit(seen, d, order) for order in (1, 2) for d in discounts] if seen else [Model({}, {}, {})]

    def bins(batches: Iterator) -> Iterator:
        seen: Counter = Counter()
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                words = words_of(text.as_py())
                seen.update((i, bin_of(m.score(words)), y) for i, m in enumerate(models))
        if seen:
            i, b, y = zip(*seen)
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "b": pa.array(b, pa.int32()),
                                              "y": pa.array(y, pa.int32()), "n": pa.array(list(seen.values()), pa.int64())})

    found: dict[int, list[list[float]]] = {i: [[0.0] * BINS, [0.0] * BINS] for i in range(len(models))}
    binned = measured.select("text", "y").mapInArrow(bins, "i int, b int, y int, n bigint")
    for r in binned.groupBy("i", "b", "y").agg(F.sum("n").alias("n")).collect():
        found[r.i][0][r.b] += r.n * r.y
        found[r.i][1][r.b] += r.n
    fits = [(monotone(*found[i]), *found[i]) for i in range(len(models))]
    loss = [-sum(a * math.log(p) + (b - a) * math.log(1 - p) for p, a, b in zip(*f) if b) for f in fits]
    best = min(range(len(models)), key=loss.__getitem__)
    return models[best], fits[best][0]


def scorer(model: Model, chance: list[float]):
    """A function from a text column to its scores; only the text travels to Python, and only the score comes back."""
    import pyarrow as pa

    @F.arrow_udf("double")
    def of(texts):
        out = []
        for text in texts:
            mean = model.score(words_of(text.as_py()))
            # The last term orders texts of one bin without leaving the range.
            out.append(0.999 * chance[bin_of(mean)] + 0.0005 * (1 + math.tanh(mean)))
        return pa.array(out, pa.float64())

    return of


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, ``held_out``, ``score``, ``predicted``) of every row.

    Only labelled rows whose crc32 of the id, mod 3, is not 1 are learnt from.  A null or empty text has no words and
    gets the score of a difference of 0.  Rows with null ids are scored, never learnt from; null labels are left out;
    without labels of both kinds every row scores 0.5 at most.  Repeated rows stay; an empty table gives an empty result.
    """
    model, chance = train(labelled(docs, labels, id_col, text_col, label_col, fit_rows))
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"),
                       scorer(model, chance)(F.col(text_col).cast("string")).alias("score"))
    return rows.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                  threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns, whatever their names; see ``score``."""
    model, chance = train(labelled(docs, labels, id_col, text_col, label_col, fit_rows))
    return docs.where(scorer(model, chance)(F.col(text_col).cast("string")) < threshold)
