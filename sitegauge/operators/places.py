"""From free text to counties: find place names, resolve them, match posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sitegauge.functions.scalars import pad_code, with_costly
from sitegauge.functions.text import clean_text, county_label, forum_of, lookup_key, place_key
from sitegauge.operators.joins import cache_rows, distinct_in_order, override, with_cached
from sitegauge.operators.phrases import outermost, phrase_hits
from sitegauge.session import stage
from sitegauge.sources import dimensions as dims
from sitegauge.sources.cache import LookupCache
from sitegauge.sources.fixed_values import COUNTRY_NAMES

MIN_CLEAN_CHARS = 50


def with_state_hint(posts: DataFrame, url: str = "url", forums: DataFrame | None = None) -> DataFrame:
    """State spoken for by the forum in a post's address, null where unknown."""
    forums = forums if forums is not None else dims.forum_states(posts.sparkSession)
    return (posts.withColumn("subreddit", forum_of(url))
            .join(forums, "subreddit", "left").drop("subreddit"))


def candidate_lists(
    aliases: DataFrame, crosswalk: DataFrame | None = None, order: str | None = None,
) -> DataFrame:
    """place, candidates: the counties a place may mean, most prominent first.

    Aliases replace the crosswalk's entry for the same name.  ``order`` names the crosswalk's column that ranks them;
    without one the codes do.
    """
    def listed(df: DataFrame) -> DataFrame:
        firsts = df.groupBy("place", "county_fips").agg(F.min("pos").alias("pos"))
        packed = F.array_sort(F.collect_list(F.struct("pos", "county_fips")))
        return firsts.groupBy("place").agg(
            F.transform(packed, lambda s: s["county_fips"]).alias("candidates"))

    base = listed(aliases)
    if crosswalk is None:
        return base
    cross = crosswalk.select(
        place_key("place_name").alias("place"), pad_code("county_fips").alias("county_fips"),
        F.col(order or "county_fips").alias("pos")).filter(F.col("place").isNotNull())
    return override(listed(cross), base, "place")


def resolve_places(
    mentions: DataFrame, candidates: DataFrame, place: str = "place", hint: str = "state_hint",
    out: str = "county_fips", states: DataFrame | None = None, cache: DataFrame | None = None,
) -> DataFrame:
    """County of each mention, from its candidates and the state hint.

    A single candidate is taken whatever the hint says.  Of several, the first
    in the hinted state; without a hint, the first.  Several candidates, none in
    the hinted state: unresolved.  A cached answer, hit or miss, comes first.
    """
    states = states if states is not None else dims.states(mentions.sparkSession)
    if cache is not None:
        # Read twice, for the cache's hot keys and for the join; finding the mentions in their texts is costly.
        mentions = stage(mentions, "mentions")
    known = candidates.select(F.col("place").alias("_place"), "candidates")
    prefixes = states.select(F.col("state").alias("_state"), F.col("state_fips").alias("_prefix"))
    joined = (
        mentions.withColumn("_place", place_key(place)).withColumn("_state", F.upper(hint))
        .join(known, "_place", "left").join(prefixes, "_state", "left"))
    many = F.size("candidates") > 1
    has_hint = F.coalesce(F.col(hint), F.lit("")) != ""
    in_state = F.filter("candidates", lambda c: c.startswith(F.col("_prefix")))
    answer = (
        F.when(F.length(F.trim(place)) < 2, F.lit(None))
        .when(F.size("candidates") == 1, F.get("candidates", F.lit(0)))
        .when(many & has_hint, F.get(in_state, F.lit(0)))
        .when(many, F.get("candidates", F.lit(0))))
    if cache is None:
        return joined.withColumn(out, answer).drop("_place", "_state", "candidates", "_prefix")
    resolved = with_cached(joined, cache, place, hint, answer, out)
    return resolved.withColumn(out, F.when(F.length(F.trim(place)) >= 2, F.col(out))).drop(
        "_place", "_state", "candidates", "_prefix")


def county_by_name(
    df: DataFrame, names: DataFrame, name: str = "county", hint: str = "state_hint",
    out: str = "county_fips",
) -> DataFrame:
    """County code by name: in the hinted state, or the first of that name without a hint."""
    per_name = names.groupBy(F.col("county_name").alias("_name")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "state", "county_fips"))).alias("_listed"))
    joined = df.withColumn("_name", county_label(name)).join(per_name, "_name", "left")
    hinted = F.filter("_listed", lambda s: s["state"] == F.upper(hint))
    pick = F.when(F.coalesce(F.col(hint), F.lit("")) != "", F.get(hinted, F.lit(0))).otherwise(
        F.get("_listed", F.lit(0)))
    return joined.withColumn(out, pick["county_fips"]).drop("_name", "_listed")


def gazetteer(spark, crosswalk: DataFrame | None = None) -> DataFrame:
    """All names that can be found in text: aliases, county names and the crosswalk."""
    names = dims.place_aliases(spark).select("place").unionByName(
        dims.county_names(spark).select(F.col("county_name").alias("place")))
    if crosswalk is not None:
        names = names.unionByName(crosswalk.select(place_key("place_name").alias("place")))
    return names.filter(F.col("place").isNotNull()).distinct()


def place_mentions(posts: DataFrame, key: str, text: str, names: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """key, pos, place and the post's ``keep`` columns: each listed place once per text, in order of first mention."""
    hits = outermost(phrase_hits(posts, key, text, names.select("place"), "place", keep=keep), key)
    hits = hits.filter((F.length("place") >= 2) & ~F.col("place").isin(COUNTRY_NAMES))
    return distinct_in_order(hits, key, "place", "pos", keep)


def resolve_pairs(
    pairs: DataFrame, candidates: DataFrame, cache: DataFrame | LookupCache | None = None,
    place: str = "place", hint: str = "state_hint", out: str = "county_fips", states: DataFrame | None = None,
) -> DataFrame:
    """County of each distinct pair of place and hint.

    With a kept cache only pairs that no earlier run has answered are resolved, and their answers, misses too, are kept.
    """
    if not isinstance(cache, LookupCache):
        return resolve_places(pairs, candidates, place, hint, out, states, cache)
    keyed = pairs.withColumn("key", lookup_key(place, hint))
    fresh = resolve_places(cache.unknown(keyed), candidates, place, hint, out, states)
    cache.add(cache_rows(fresh, place, hint, out))
    return keyed.join(cache.entries().select("key", F.col("fips").alias(out)), "key", "left").drop("key")


def match_posts(
    posts: DataFrame, names: DataFrame, candidates: DataFrame, key: str = "url",
    text: str = "clean_text", hint: str = "state_hint", cache: DataFrame | LookupCache | None = None,
) -> DataFrame:
    """Add raw_locations and the county of the first mention that resolves."""
    # Texts are searched once; the mentions, with their hints, serve both steps below.
    mentions = stage(place_mentions(posts, key, text, names, [hint]), "mentions")
    # Few pairs of place and hint stand for many mentions; each is resolved once.
    pairs = resolve_pairs(mentions.select("place", hint).distinct(), candidates, cache, "place", hint, "_fips").select(
        F.col("place").alias("_place"), F.col(hint).alias("_hint"), "_fips")
    resolved = mentions.join(
        pairs, (F.col("place") == F.col("_place")) & F.col(hint).eqNullSafe(F.col("_hint")), "left")
    per_post = resolved.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "place"))),
                    lambda s: s["place"]).alias("raw_locations"),
        F.min_by("_fips", F.when(F.col("_fips").isNotNull(), F.col("pos")))
        .alias("matched_county_fips"))
    empty = F.array().cast("array<string>")
    return posts.join(per_post, key, "left").withColumn(
        "raw_locations", F.coalesce("raw_locations", empty))


def preprocess(
    corpus: DataFrame, crosswalk: DataFrame | None = None, cache: DataFrame | LookupCache | None = None,
    min_chars: int = MIN_CLEAN_CHARS,
) -> DataFrame:
    """Clean, filter, hint and match a raw corpus; unmatched posts keep a null county."""
    spark = corpus.sparkSession
    posts = with_costly(corpus, "clean_text", clean_text("content")).filter(
        F.length("clean_text") > min_chars)
    # Cleaned once; what follows reads the columns it needs from the written table.
    posts = stage(with_state_hint(posts), "posts")
    candidates = candidate_lists(dims.place_aliases(spark), crosswalk)
    candidates = with_county_names(candidates, dims.county_names(spark))
    return match_posts(posts, gazetteer(spark, crosswalk), candidates, cache=cache)


def with_county_names(candidates: DataFrame, names: DataFrame) -> DataFrame:
    """Let full county names resolve too, unless the lists already know the name."""
    listed = names.groupBy(F.col("county_name").alias("place")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "county_fips"))),
                    lambda s: s["county_fips"]).alias("candidates"))
    return override(listed, candidates, "place")


def split_matched(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matched posts in full; unmatched ones with what is needed to find new aliases."""
    matched = posts.filter(F.col("matched_county_fips").isNotNull())
    unmatched = posts.filter(F.col("matched_county_fips").isNull()).select(
        "url", "raw_locations", "state_hint", "clean_text")
    return matched, unmatched


def hits_and_misses(cache: DataFrame) -> DataFrame:
    return cache.agg(
        F.count(F.lit(1)).alias("entries"), F.count("fips").alias("hits"),
        F.count_if(F.col("fips").isNull()).alias("misses"))
