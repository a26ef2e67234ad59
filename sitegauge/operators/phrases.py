"""Find listed phrases in texts.

The list becomes two small bit tables: one of the words that open a phrase, one of the whole phrases.  They travel inside
the expression, so a text is searched within its row: where a word may open a phrase, it and the words after it are put
together, and what may be a phrase leaves the row.  Those few rows are joined to the list, which alone decides.  The tables
grow with the list up to a fixed size; beyond it more is left to the join, and nothing else changes.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sitegauge.functions.scalars import with_costly

#: Bits of a table for the longest lists, and bits per listed phrase below that.
MOST_BITS, BITS_PER_PHRASE = 1 << 20, 32


def phrase_tokens(c: str | Column) -> Column:
    """Lower-case runs of letters, digits and apostrophes; punctuation separates."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(
        F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_']+"), 0)


def phrase_form(c: str | Column) -> Column:
    """A phrase as its tokens joined by single spaces."""
    return F.array_join(phrase_tokens(c), " ")


class PhraseFilter:
    """Bit tables of a list's opening words and of its phrases, and the number of words of the longest."""

    def __init__(self, listed: DataFrame, form: str):
        opening = F.substring_index(form, " ", 1)
        placed = listed.select(F.size(F.split(form, " ")).alias("len"), F.explode(F.array(
            F.struct(F.lit(0).alias("table"), self._place(opening, MOST_BITS).alias("place")),
            F.struct(F.lit(1).alias("table"), self._place(F.col(form), MOST_BITS).alias("place")))).alias("p")).select("len", "p.*")
        # One row per 64 bits of a table, whose size is fixed.
        cells = placed.groupBy("table", F.shiftright("place", 6).alias("cell")).agg(
            F.bit_or(F.expr("shiftleft(1L, int(place & 63))")).alias("bits"), F.max("len").alias("len"),
            F.count(F.lit(1)).alias("n")).collect()
        self.longest = max((r["len"] for r in cells), default=1)
        wanted = BITS_PER_PHRASE * sum(r["n"] for r in cells) // 2
        self.size = 64
        while self.size < min(wanted, MOST_BITS):
            self.size *= 2
        self.tables = [[0] * (self.size // 64) for _ in range(2)]
        for r in cells:
            # A table of half the size is both halves of the larger one laid upon each other.
            self.tables[r["table"]][r["cell"] % (self.size // 64)] |= r["bits"]

    @staticmethod
    def _place(value: Column, size: int) -> Column:
        return F.xxhash64(value).bitwiseAND(F.lit(size - 1))

    def _has(self, table: int, value: Column) -> Column:
        place = self._place(value, self.size)
        bits = F.from_json(F.lit(json.dumps(self.tables[table])), "array<bigint>")
        return F.getbit(F.get(bits, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1

    def may_open(self, word: Column) -> Column:
        return self._has(0, word)

    def may_be(self, phrase: Column) -> Column:
        return self._has(1, phrase)


def phrase_hits(
    texts: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str,
    negations: Sequence[str] = (), window: int = 3, keep: Sequence[str] = (),
) -> DataFrame:
    """The longest listed phrase at each position of each text.

    Columns: key, ``keep`` (of the text), pos, len, the phrase table's columns, and ``negated`` (one of
    the ``window`` tokens before it is a negation).  ``key`` must be unique.
    """
    listed = phrases.withColumn("_form", phrase_form(phrase)).filter("_form <> ''")
    known = PhraseFilter(listed, "_form")
    tokens = with_costly(texts.select(key, *keep, text), "_tokens", phrase_tokens(text)).select(
        key, *keep, "_tokens").filter(F.size("_tokens") > 0)
    places = F.filter(F.sequence(F.lit(1), F.size("_tokens")), lambda i: known.may_open(F.element_at("_tokens", i)))

    def begun(i: Column) -> Column:
        lengths = F.sequence(F.lit(1), F.least(F.lit(known.longest), F.size("_tokens") - i + 1))
        turned = F.exists(F.slice("_tokens", F.greatest(i - window, F.lit(1)), F.least(i - 1, F.lit(window))),
                          lambda t: t.isin(list(negations)) | t.endswith("n't")) if negations else F.lit(False)
        return F.filter(F.transform(lengths, lambda n: F.struct(
            i.alias("pos"), n.alias("len"), turned.alias("negated"),
            F.array_join(F.slice("_tokens", i, n), " ").alias("_form"))), lambda g: known.may_be(g["_form"]))

    grams = tokens.select(key, *keep, F.inline(F.flatten(F.transform(places, begun))))
    # One text is one group here, so all steps below share this one shuffle.
    found = grams.join(listed, "_form").repartition(key)
    longest_first = Window.partitionBy(key, "pos").orderBy(F.desc("len"))
    best = found.withColumn("_nth", F.row_number().over(longest_first)).filter("_nth = 1")
    return best.drop("_nth", "_form")


def outermost(hits: DataFrame, key: str) -> DataFrame:
    """Hits that do not lie inside an earlier, longer one."""
    earlier = (Window.partitionBy(key).orderBy("pos")
               .rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("pos") + F.col("len")
    return (hits.withColumn("_covered", F.coalesce(F.max(end).over(earlier), F.lit(0)))
            .filter(F.col("_covered") < end).drop("_covered"))
