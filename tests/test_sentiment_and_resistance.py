import math
import re

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from sitegauge.operators import phrases, resistance, sentiment
from sitegauge.session import small_table, stage

LEXICON = {"tax revenue": 1.0, "revenue": 1.0, "tax break": -0.5, "oppose": -2.0, "good": 1.9, "water shortage": -3.0}


def lexicon(spark):
    return small_table(spark, list(LEXICON.items()), "term string, valence double")


def scored(spark, texts, terms=None):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    table = small_table(spark, list((terms or LEXICON).items()), "term string, valence double")
    return [r.sentiment for r in sentiment.with_sentiment(df, "id", "t", table).orderBy("id").collect()]


def read(text, terms):
    """The rule in plain Python: from left to right, the longest term at each place."""
    words = re.findall(r"[\w']+", (text or "").lower())
    total, at = 0.0, 0
    while at < len(words):
        n = next((n for n in range(len(words) - at, 0, -1) if " ".join(words[at : at + n]) in terms), 0)
        if n:
            turned = any(w in sentiment.NEGATIONS or w.endswith("n't") for w in words[max(0, at - 3) : at])
            total += terms[" ".join(words[at : at + n])] * (-0.74 if turned else 1)
        at += max(n, 1)
    return squash(total)


def squash(s):
    return round(s / math.sqrt(s * s + 15), 4)


def test_scores(spark):
    got = scored(spark, [
        "We OPPOSE it.", "tax revenue", "Tax; revenue!", "not good", "it is not really very good",
        "not one two three good", "don't oppose", "", None, "oppose oppose water-shortage"])
    want = [squash(-2), squash(1), squash(1), squash(1.9 * -0.74), squash(1.9 * -0.74), squash(1.9),
            squash(2 * 0.74), 0.0, 0.0, squash(-7)]
    assert got == pytest.approx(want)


WORDS = ["tax", "revenue", "break", "oppose", "good", "not", "don't", "water", "shortage", "x" * 70, "y" * 49 + "n't", "the", ",", "été"]


OVERLAPPING = {**LEXICON, "not good": -1.0, "good deal": 2.0, "good": 1.9, "no tax": 0.7, "tax": -0.4, "good good good": 5.0}


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(WORDS + ["deal", "no"]), max_size=14).map(" ".join), min_size=200, max_size=250))
def test_overlapping_and_negating_terms(spark, texts):
    assert scored(spark, texts, OVERLAPPING) == pytest.approx([read(t, OVERLAPPING) for t in texts])


def test_a_negation_inside_a_term_is_used_up(spark):
    assert scored(spark, ["not good deal"], {"not good": -1.0, "good deal": 2.0}) == [-0.25]


def test_a_lexicon_of_any_size_reads_alike(spark):
    large = OVERLAPPING | {f"filler{i} word": 1.0 for i in range(6000)}
    texts = ["not good deal", "good tax break", "filler7 word not filler8 word", ""]
    assert scored(spark, texts, large) == pytest.approx([read(t, large) for t in texts])



def test_domain_terms_override_a_general_lexicon(spark):
    base = small_table(spark, [("block", 9.0), ("nice", 1.5)], "term string, valence double")
    got = {r.term: r.valence for r in sentiment.full_lexicon(spark, base).collect()}
    assert got["block"] == -1.0 and got["nice"] == 1.5 and len(got) == 46


def test_factors(spark):
    df = spark.createDataFrame([(20, 2000.0), (1000, 1e6)], "n long, pop double")
    row = df.select(resistance.intensity(F.col("n") / F.col("pop")).alias("i"), resistance.volume("n").alias("v")).collect()
    assert row[0].i == pytest.approx(6.9088, abs=1e-4) and row[0].v == pytest.approx(0.7743, abs=1e-4)
    assert row[1].v == 1.5


def test_resistance_per_county(spark):
    posts = spark.createDataFrame(
        [("a", -0.5, 0.5, 0.1), ("a", 0.2, 0.3, 0.1), ("b", -0.04, 0.5, 0.5), (None, -1.0, 1.0, 0.0), ("c", 0.9, 0.1, 0.2)],
        "matched_county_fips string, sentiment double, topic_0_weight double, topic_1_weight double")
    pops = spark.createDataFrame([("a", 2000), ("b", 0)], "county_fips string, population long")
    got = resistance.resistance_scores(posts, pops, [0, 1, 7]).toPandas().set_index("matched_county_fips")
    a = got.loc["a"]
    signals = [0.5 * 0.6, -0.2 * 0.4]
    assert a.raw_resistance_mean == pytest.approx(sum(signals) / 2)
    assert a.post_count == 2 and a.negative_pct == 50.0 and a.posts_per_capita == 0.001
    assert a.std_resistance == pytest.approx(pd.Series(signals).std())
    raw = a.raw_resistance_mean * math.log1p(100) * math.log(3) / math.log(51)
    assert a.social_resistance_score_raw == pytest.approx(raw)
    assert got.loc["b"].posts_per_capita == 1.0 and got.loc["b"].negative_pct == 0.0
    assert pd.isna(got.loc["c"].social_resistance_score) and pd.isna(got.loc["c"].population)
    assert sorted(got.social_resistance_score.dropna()) == pytest.approx([100 / 3, 200 / 3])


def test_no_topic_weights_means_full_relevance(spark):
    posts = spark.createDataFrame([("a", -0.5), ("b", 0.5)], "matched_county_fips string, sentiment double")
    pops = spark.createDataFrame([("a", 100), ("b", 100)], "county_fips string, population long")
    got = {r.matched_county_fips: r.raw_resistance_mean for r in resistance.resistance_scores(posts, pops).collect()}
    assert got == {"a": 0.5, "b": -0.5}


def test_texts_are_searched_inside_their_rows(spark):
    """The bit tables are constants of the plan, and of 3000 words only the two that form a phrase leave the row."""
    text = " ".join(f"w{i}" for i in range(1500)) + " good tax revenue " + " ".join(f"v{i}" for i in range(1500))
    df = spark.createDataFrame([(1, text)], "id long, t string")
    hits = phrases.phrase_hits(df, "id", "t", stage(lexicon(spark)), "term")
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and plan.count("Generate inline") == 1
    assert {(r.pos, r.len, r.term) for r in hits.collect()} == {(1501, 1, "good"), (1502, 2, "tax revenue"), (1503, 1, "revenue")}
    known = phrases.PhraseFilter(lexicon(spark).withColumnRenamed("term", "f"), "f")
    words = spark.range(20_000).select(F.concat(F.lit("word"), "id").alias("w"))
    passed = words.agg(F.count_if(known.may_open(F.col("w"))), F.count_if(known.may_be(F.col("w")))).head()
    assert max(passed) < 2500 and known.longest == 2


def test_lists_larger_than_the_bit_tables(spark, monkeypatch):
    """Tables that hold every bit let everything through to the join, which decides as before."""
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    terms = {f"a{i} b{i % 7}": 1.0 for i in range(400)} | LEXICON
    texts = ["a3 b3 good", "tax break a9 b2 a9 b9", "a1 b0 b1", "not good water shortage"]
    assert scored(spark, texts, terms) == pytest.approx([read(t, terms) for t in texts])
