import pytest
from pyspark.sql import functions as F

from sitegauge.operators import joins, places
from sitegauge.operators.corpus import collect_results, corpus_stats
from sitegauge.sources import dimensions as dims


@pytest.fixture(scope="module")
def candidates(spark):
    return places.candidate_lists(dims.place_aliases(spark))


def resolve(spark, candidates, place, hint, cache=None):
    df = spark.createDataFrame([(place, hint)], "place string, state_hint string")
    return places.resolve_places(df, candidates, cache=cache).head().county_fips


@pytest.mark.parametrize("place, hint, want", [
    ("nova", None, "51059"), ("dfw", "TX", "48113"), ("nova", "TX", None), ("mesa", "VA", "04013"),
    (" NoVA ", "va", "51059"), ("research triangle", "NC", "37063"), ("atlantis", None, None),
    ("x", None, None), (None, "VA", None), ("nova", "", "51059"), ("dfw", "??", None),
])
def test_resolution(spark, candidates, place, hint, want):
    assert resolve(spark, candidates, place, hint) == want


def test_cache_wins_hit_or_miss(spark, candidates):
    cache = spark.createDataFrame([("mesa|VA", None), ("atlantis|", "99999")], "key string, fips string")
    assert resolve(spark, candidates, "Mesa", "VA", cache) is None
    assert resolve(spark, candidates, "Atlantis", None, cache) == "99999"
    assert resolve(spark, candidates, "mesa", None, cache) == "04013"


def test_aliases_override_the_crosswalk(spark):
    cross = spark.createDataFrame(
        [("Mesa", "99999"), ("Springfield ", "1001"), ("springfield", "1001"), ("springfield", "17167")],
        "place_name string, county_fips string")
    got = {r.place: r.candidates for r in places.candidate_lists(dims.place_aliases(spark), cross).collect()}
    assert got["mesa"] == ["04013"]
    assert got["springfield"] == ["01001", "17167"]
    assert got["nova"] == ["51059", "51107", "51153", "51013"]


def test_texts_are_scanned_and_cleaned_once(spark, tmp_path):
    """The last plan reads written columns only: no cleaning, and the clean text is shuffled at most once."""
    rows = [(f"https://www.reddit.com/r/x/{i}", f"People near Mesa and Loudoun County talk about it at length, post number {i}.") for i in range(40)]
    spark.createDataFrame(rows, "url string, content string").write.parquet(str(tmp_path / "corpus"))
    out = places.preprocess(spark.read.parquet(str(tmp_path / "corpus")))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and str(tmp_path / "corpus") not in str(out.inputFiles())
    assert out.count() == 40 and out.where("matched_county_fips IS NULL").count() == 0


@pytest.mark.parametrize("county, hint, want", [
    ("King", "WA", "53033"), ("king county", None, "53033"), ("King County", "TX", None), ("nowhere", None, None),
])
def test_county_names(spark, county, hint, want):
    df = spark.createDataFrame([(county, hint)], "county string, state_hint string")
    assert places.county_by_name(df, dims.county_names(spark)).head().county_fips == want


def test_mentions_in_order_longest_first_without_country_names(spark):
    text = "We left Ashburn for West Des Moines, then Loudoun County and ashburn again; US and mt. Prospect"
    posts = spark.createDataFrame([("p", text)], "url string, t string")
    got = places.place_mentions(posts, "url", "t", places.gazetteer(spark)).orderBy("pos").collect()
    assert [r.place for r in got] == ["ashburn", "west des moines", "loudoun county", "mt. prospect"]


def test_state_hints(spark):
    posts = spark.createDataFrame(
        [("https://reddit.com/r/NoVA/1",), ("https://reddit.com/r/cats/2",), (None,)], "url string")
    got = {r.url: r.state_hint for r in places.with_state_hint(posts).collect()}
    assert got["https://reddit.com/r/NoVA/1"] == "VA" and got["https://reddit.com/r/cats/2"] is None and got[None] is None


def corpus(spark):
    pad = " and more words to pass the length bar of fifty characters"
    rows = [
        ("https://reddit.com/r/nova/1", "Moratorium in Sterling" + pad),
        ("https://reddit.com/r/texas/2", "nova then DFW" + pad),
        ("https://reddit.com/r/cats/3", "nothing here" + pad),
        ("https://reddit.com/r/ohio/4", "short"),
        ("https://reddit.com/r/cats/5", "nova or dfw" + pad),
    ]
    return spark.createDataFrame(rows, "url string, content string")


def test_posts_match_their_first_resolvable_place(spark):
    got = {r.url[-1]: r for r in places.preprocess(corpus(spark)).collect()}
    assert set(got) == {"1", "2", "3", "5"}
    assert got["1"].matched_county_fips == "51107"
    assert got["2"].matched_county_fips == "48113"  # nova is ambiguous outside Texas, so the next one counts
    assert got["2"].raw_locations == ["nova", "dfw"]
    assert got["3"].matched_county_fips is None and got["3"].raw_locations == []
    assert got["5"].matched_county_fips == "51059"


def test_texts_are_searched_once(spark, tmp_path):
    """Mentions are staged with their hints; the last plan reads no text but the post's own columns."""
    path = str(tmp_path / "posts")
    places.with_state_hint(corpus(spark)).withColumnRenamed("content", "clean_text").write.parquet(path)
    out = places.match_posts(spark.read.parquet(path), places.gazetteer(spark), places.candidate_lists(dims.place_aliases(spark)))
    plan = out.drop("clean_text")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "clean_text" not in plan.split("Relation")[-1]
    assert out.count() == 5


def test_split_keeps_every_post(spark):
    posts = places.preprocess(corpus(spark))
    matched, unmatched = places.split_matched(posts)
    assert matched.count() == 3 and unmatched.columns == ["url", "raw_locations", "state_hint", "clean_text"]
    assert unmatched.count() == 1


def test_length_bar_is_strict(spark):
    df = spark.createDataFrame([("a", "x" * 50), ("b", "x" * 51)], "url string, content string")
    assert [r.url for r in places.preprocess(df).collect()] == ["b"]


def test_search_results_keep_the_first_sight_of_an_address(spark):
    rows = [("https://reddit.com/a", 1, 0, 5, "q0"), ("https://reddit.com/a", 1, 1, 0, "q1"),
            ("https://x.com/b", 1, 0, 0, "q0"), ("https://reddit.com/c", 2, 0, 0, "s"), ("https://reddit.com/c", 1, 9, 9, "g")]
    df = spark.createDataFrame(rows, "url string, phase int, query_no int, result_no int, query string")
    assert {(r.url[-1], r.query) for r in collect_results(df).collect()} == {("a", "q0"), ("c", "g")}


def test_corpus_stats(spark):
    df = spark.createDataFrame([("s", "q", "abcd"), ("s", None, "ab"), ("t", "q", None)], "source string, query string, content string")
    stats = corpus_stats(df)
    assert [(r.source, r.n) for r in stats["by_source"].collect()] == [("s", 2), ("t", 1)]
    assert [(r.query, r.n) for r in stats["by_query"].collect()] == [("q", 2), ("unknown", 1)]
    row = stats["length"].head()
    assert (row.min_length, row.max_length, row.median_length) == (0, 4, 2)


def test_ordered_helpers(spark):
    df = spark.createDataFrame([(1, "B", 2), (1, "b", 1), (1, "a", 3), (1, "B", 9)], "k int, v string, pos int")
    got = joins.distinct_in_order(df, "k", "v", "pos").orderBy("pos").collect()
    assert [(r.v, r.pos) for r in got] == [("b", 1), ("a", 3)]
    assert joins.ordered_lists(df, "k", "v", "pos", "l").head().l == ["b", "B", "a"]


def test_hot_address_is_not_one_group(spark):
    """A third of the results share one address; the wide rows are matched on address and order."""
    rows = spark.range(3000).select(
        F.when(F.col("id") < 1000, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("o"), F.lit("x").alias("w"))
    got = joins.first_per_key(rows, "k", ["o"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "[k#" in plan and "Window" not in plan
    assert got.count() == rows.select("k").distinct().count()


def test_mentions_are_found_once_for_a_cache(spark):
    """The cache's hot keys and the join both read the mentions; finding them is costly."""
    found = spark.sparkContext.accumulator(0)

    def find(i):
        found.add(1)
        return "fairfax" if i % 2 else "reston"

    mentions = spark.range(40).select("id", F.udf(find, "string")("id").alias("place"), F.lit("VA").alias("state_hint"))
    candidates = spark.createDataFrame([("fairfax", ["51059"]), ("reston", ["51107"])], "place string, candidates array<string>")
    cache = spark.createDataFrame([("fairfax|VA", "99999")], "key string, fips string")
    got = places.resolve_places(mentions, candidates, cache=cache).collect()
    assert sorted({(r.place, r.county_fips) for r in got}) == [("fairfax", "99999"), ("reston", "51107")]
    assert len(got) == 40 and found.value == 40
