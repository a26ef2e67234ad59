"""Quality rules whose cut-offs are chosen under a bound on false rejection, in DataFrame functions only.

Every rule compares one figure of a text with a cut-off.  Candidate cut-offs are tried on labelled texts of good
quality, apart for each stratum: with k of n good texts rejected, a cut-off is accepted if the chance of k or fewer
rejections would be at most the error level were the true share above the allowed one (the exact binomial bound).  The
error level is divided by the number of all tests (Bonferroni), and the allowed share among the rules, so that with the
stated confidence no stratum loses more than the allowed share of its good texts.  Of the accepted cut-offs the
strictest holds; a rule without one, as in a stratum with few labels, rejects nothing there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.session import small_table, stage

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Allowed share of good texts rejected per stratum, and the error level of that promise.
ALLOWED, ERROR = 0.02, 0.05

#: Figure -> cut-offs from lenient to strict; a text is rejected above the cut-off.
CUTOFFS: Mapping[str, Sequence[float]] = {
    "symbol_share": (0.5, 0.3, 0.2, 0.1, 0.05),
    "dup_line_share": (0.9, 0.7, 0.5, 0.3),
    "repeat_share": (0.45, 0.4, 0.3, 0.2),
    "word_length": (40.0, 20.0, 15.0, 12.0),
}


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(words: Column, size: int = 3) -> Column:
    """Number of words that stand in a ``size``-word window found twice or more, the first place included.

    Windows are compared by two 64-bit hashes.  Only where some window repeats are they sorted, so that equal ones stand
    together; the places of repeated ones are then walked in order, each adding the words it does not share with the one
    before.
    """
    def marked(windows: Column) -> Column:
        def places(ordered: Column) -> Column:
            same = lambda i, j: (F.get(ordered, i)["h"] == F.get(ordered, j)["h"]) & (
                F.get(ordered, i)["g"] == F.get(ordered, j)["g"])
            return F.array_sort(F.transform(F.filter(
                F.transform(ordered, lambda w, i: F.struct(w["at"].alias("at"), (
                    ((i > 0) & F.coalesce(same(i, i - 1), F.lit(False))) | F.coalesce(same(i, i + 1), F.lit(False))).alias("twice"))),
                lambda w: w["twice"]), lambda w: w["at"]))

        return F.aggregate(
            let(F.array_sort(windows), places), F.struct(F.lit(-size).alias("last"), F.lit(0).alias("n")),
            lambda s, at: F.struct(at.alias("last"), (s["n"] + F.least(F.lit(size), at - s["last"])).alias("n")),
            lambda s: s["n"])

    def count(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: let(
            F.array_join(F.slice(w, i + 1, size), " "),
            lambda t: F.struct(F.xxhash64(t).alias("h"), F.hash(t).alias("g"), i.alias("at"))))
        return let(windows, lambda x: F.when(
            F.size(F.array_distinct(F.transform(x, lambda y: y["h"]))) == F.size(x), 0).otherwise(marked(x)))

    return let(words, lambda w: F.when(F.size(w) < size + 1, 0).otherwise(count(w)))


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(id, ``stratum``, the counts) of every row; a null text has no words, a null stratum is one of its own."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    worded = F.filter(F.split(text, "\n"), lambda x: F.rtrim(F.translate(x, SPACES[1:], " " * 5)) != "")
    return docs.select(
        F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(worded, F.size).cast("long").alias("n_lines"),
        repeated_words(words_of(text)).cast("long").alias("n_repeat_words"))


def shares() -> dict[str, Column]:
    """The figures that rules judge; null where a text has nothing to divide by."""
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return {"symbol_share": over("n_symbols", "word_chars"), "dup_line_share": over("n_dup_lines", "n_lines"),
            "repeat_share": over("n_repeat_words", "n_words"), "word_length": over("word_chars", "n_words")}


def at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), exactly, for k <= n p; 1 beyond, where no bound below p can hold.

    The term at k is found in logarithms and the smaller ones before it as its multiples.
    """
    import math

    ratio = (1 - p) / p
    log_top = F.aggregate(F.sequence(F.lit(0), k), (n - k) * math.log1p(-p) + k * math.log(p), lambda s, i: s + F.when(
        i > 0, F.log((n - i + 1) / F.greatest(i, F.lit(1)))).otherwise(0.0))
    below = F.aggregate(
        F.sequence(F.lit(0), k), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct((s["term"] * (k - i) / (n - k + i + 1) * ratio).alias("term"), (s["sum"] + s["term"]).alias("sum")),
        lambda s: s["sum"])
    return F.when(k > n * p, 1.0).otherwise(F.least(F.lit(1.0), F.exp(log_top) * below))


def calibrate(table: DataFrame, labels: DataFrame, cutoffs: Mapping[str, Sequence[float]] = CUTOFFS,
              allowed: float = ALLOWED, error: float = ERROR) -> DataFrame:
    """(``stratum``, ``name``, ``cutoff``): the strictest accepted cut-off of every rule in every stratum.

    ``labels`` has (``id``, ``good``); ids labelled twice count as good only if all their labels say so.  Only rows that
    pass the fixed rule are counted, as the others are rejected in any case.
    """
    tests = [(name, c) for name, cuts in cutoffs.items() for c in cuts]
    spark = table.sparkSession
    asked = small_table(spark, tests, "name string, cutoff double")
    good = labels.groupBy("id").agg(F.min("good").alias("good")).where("good").select("id")
    chosen = table.where(~failed_base()).join(good, "id").select(
        "stratum", F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in cutoffs]), F.array(*[shares()[n] for n in cutoffs]))).alias("name", "value"))
    counted = chosen.join(F.broadcast(asked), "name").groupBy("stratum", "name", "cutoff").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > F.col("cutoff")).alias("k"))
    n_tests = len(tests) * max(1, table.select("stratum").distinct().count())
    passed = counted.where(at_most(F.col("k"), F.col("n"), allowed / len(cutoffs)) <= error / n_tests)
    return passed.groupBy("stratum", "name").agg(F.min("cutoff").alias("cutoff"))


def failed_base() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
          label_col: str = "quality") -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every row.

    A null text counts as empty.  Labels with a null id or a null label are left out; without labels, only the fixed
    rule rejects.  Repeated rows and null ids are judged like any other; an empty table gives an empty result.
    """
    table = stage(figures(docs, id_col, text_col, stratum_col), "figures")
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("id"), (F.col(label_col) == 1).alias("good"))
    held = stage(calibrate(table, marks), "cutoffs").groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("name", "cutoff"))).alias("cutoffs")).withColumnRenamed("stratum", "_stratum")
    judged = table.join(held, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    above = [F.coalesce(value > F.col("cutoffs")[name], F.lit(False)) for name, value in shares().items()]
    rejected = above[0]
    for more in above[1:]:
        rejected = rejected | more
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed_base().alias("base_failed"), (~failed_base() & ~rejected).alias("kept"))
