import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from sitegauge.functions import scalars as sc, significance as sig, text as tx


def value(spark, expr, **columns):
    fields = ", ".join(f"{k} {t}" for k, (t, _) in columns.items()) or "dummy int"
    row = tuple(v for _, v in columns.values()) or (0,)
    return spark.createDataFrame([row], fields).select(expr.alias("r")).head().r


def cleaned(spark, raw, **options):
    return value(spark, tx.clean_text("t", **options), t=("string", raw))


@pytest.mark.parametrize("raw, want", [
    ("[a](https://x.y) b", "[a]( b"),
    ("our/their", "ou"),
    ("![pic](x.png) see [text](note)", "see text"),
    ("# Head *bold* _it_ ~s~ `c` > q", "Head bold it s c q"),
    ("ask /u/some_one in r/nova now", "ask in now"),
    ("a\n\n b\t c  ", "a b c"),
    ("café u/über ok", "café ok"),
    (None, ""), ("", ""), ("  ", ""),
    ("x https://a.b/c?d=e#f, y", "x y"),
    ("a [b\nc](d) e", "a b c e"), ("[b](c\nd)", "[b](c d)"),
])
def test_clean_text(spark, raw, want):
    assert cleaned(spark, raw) == want


def test_strict_cleaning_keeps_words(spark):
    assert cleaned(spark, "our/their r/nova", strict=True) == "our/their"


def python_form(raw):
    for pattern, to in ((r"https?://\S+", ""), (r"!\[.*?\]\(.*?\)", ""), (r"\[([^\]]+)\]\(.*?\)", r"\1"),
                        (r"[#*_~`>]", ""), (r"/?(u|r)/\w+", ""), (r"\s+", " ")):
        raw = re.sub(pattern, to, raw)
    return raw.strip()


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ur/[]()!ab \n\t*_>.:éß中1\u00a0\x85\u3000\x1c", max_size=60), min_size=150, max_size=200))
def test_clean_text_against_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.clean_text("t").alias("c"))
    assert [r.c for r in df.collect()] == [python_form(t) for t in texts]


def test_forum_and_keys(spark):
    url = ("string", "https://old.reddit.com/r/NoVA/comments/1")
    assert value(spark, tx.forum_of("u"), u=url) == "nova"
    assert value(spark, tx.forum_of("u"), u=("string", "https://x.com/r/nova")) is None
    assert value(spark, tx.lookup_key("p", "h"), p=("string", " NoVA "), h=("string", None)) == "nova|"
    assert value(spark, tx.county_label("p"), p=("string", " King ")) == "king county"
    assert value(spark, tx.county_label("p"), p=("string", "King County")) == "king county"


def test_topic_tokens(spark):
    text = ("string", "Data-center abc1 1abc a be état d'Or_x naïve The END")
    assert value(spark, tx.topic_tokens("t"), t=text) == re.findall(r"(?u)\b[a-zA-Z][a-zA-Z]+\b", text[1].lower())


def test_bigrams_follow_stop_word_removal(spark):
    kept = tx.without_words(tx.topic_tokens("t"), ["the", "of"])
    got = value(spark, tx.uni_and_bigrams(kept), t=("string", "noise of the grid"))
    assert got == ["noise", "grid", "noise grid"]
    assert value(spark, tx.uni_and_bigrams(tx.topic_tokens("t")), t=("string", "")) == []


def test_numbers(spark):
    assert value(spark, sc.pad_code("c"), c=("string", "4013")) == "04013"
    assert value(spark, sc.pad_code("c"), c=("string", "1234567")) == "1234567"
    assert value(spark, sc.clip("x", 0.0, 1.0), x=("double", None)) is None
    assert value(spark, sc.clip("x", 0.0, 1.0), x=("double", 7.0)) == 1.0
    assert value(spark, sc.finite("x"), x=("double", float("nan"))) is None
    assert value(spark, sc.finite("x"), x=("double", float("-inf"))) is None
    assert value(spark, sc.nonzero("x"), x=("double", 0.0)) is None
    assert value(spark, sc.number("x"), x=("string", "Ice")) is None
    assert value(spark, sc.number("x"), x=("string", " 4.5 ")) == 4.5
    assert value(spark, sc.half_even("x", 3), x=("double", 0.0005)) == 0.0
    assert value(spark, sc.half_even("x", 1), x=("double", 2.25)) == 2.2
    assert value(spark, sc.scale_from("x", 3.0, 3.5), x=("double", 10.0)) == 100.0
    assert [value(spark, sc.tier("x"), x=("double", v)) for v in (70.0, 69.9, 50.0, 49.9, None)] == [
        "high", "moderate", "moderate", "low", None]
    assert value(spark, sc.viable("x"), x=("double", None)) == 0


def test_row_means(spark):
    cols = dict(a=("double", None), b=("double", 50.0))
    assert value(spark, sc.row_mean(["a", "b"]), **cols) == 50.0
    assert value(spark, sc.row_mean(["a", "b"]), a=("double", 1.0), b=("double", 50.0)) == 25.5
    assert value(spark, sc.row_mean(["a"]), a=("double", None)) is None
    assert value(spark, sc.row_known_share(["a", "b"]), **cols) == 0.5
    assert value(spark, sc.first_max_index(["a", "b", "c"]), a=("double", 1.0), b=("double", 3.0), c=("double", 3.0)) == 1


def test_point_needs_both_coordinates(spark):
    p = value(spark, F.to_json(sc.point("x", "y")), x=("double", -77.6), y=("double", 39.1))
    assert p == '{"type":"Point","coordinates":[-77.6,39.1]}'
    assert value(spark, sc.point("x", "y"), x=("double", 0.0), y=("double", 39.1)) is None


def test_costly_column_is_computed_once(spark):
    df = sc.with_costly(spark.createDataFrame([("a b",)], "t string"), "c", tx.clean_text("t")).filter(F.length("c") > 1)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("https?://") == 1


# ---- p-values, against counted permutations and known figures

def test_u_distribution_is_the_count_of_arrangements():
    from itertools import combinations

    ways = sig.u_counts(3, 4)
    seen = [0] * 13
    for picked in combinations(range(7), 3):
        seen[sum(1 for i in picked for j in range(7) if j not in picked and j < i)] += 1
    assert ways == seen


def test_u_p_values():
    assert sig.u_greater_p(12, 3, 4, 0) == pytest.approx(1 / 35)
    assert sig.u_greater_p(0, 3, 4, 0) == 1.0
    assert sig.u_greater_p(12, 3, 4, 0, "normal") != sig.u_greater_p(12, 3, 4, 0, "exact") == sig.u_greater_p(12, 3, 4, 0)
    assert [sig.u_form(8, 10**6, 0), sig.u_form(9, 9, 0), sig.u_form(3, 4, 6.0)] == ["exact", "normal", "normal"]
    # 50 against 50 with U at its mean: the continuity correction leaves a little over one half.
    assert sig.u_greater_p(1250, 50, 50, 0) == pytest.approx(0.5 + 0.001375, abs=1e-4)
    assert sig.u_greater_p(5.0, 2, 3, 6.0) == pytest.approx(sig.normal_tail(1.5 / (0.5 * (6 - 6 / 20)) ** 0.5))


def test_tau_p_values():
    from itertools import permutations

    n = 5
    inv = [sum(p[i] > p[j] for i in range(n) for j in range(i + 1, n)) for p in permutations(range(n))]
    for d in range(0, 11):
        extreme = sum(k <= min(d, 10 - d) for k in inv) * 2 / len(inv)
        assert sig.tau_p(n, d, 0, 0, 0, (0, 0), (0, 0)) == pytest.approx(min(1.0, extreme))
    assert sig.tau_b(4, 0, 0, 0, 0) == 1.0 and sig.tau_b(4, 6, 0, 0, 0) == -1.0
    assert sig.tau_b(3, 0, 3, 0, 0) is None
    assert sig.tau_p(10**9, 0, 0, 0, 0, (0, 0), (0, 0)) == 0.0
