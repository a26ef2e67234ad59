"""The whole job: from features and corpus to scores, validation and publishing.

Every step writes its table under one folder, with a digest of what it was made from, and is skipped when the table is
there and was made from the same, so a broken run goes on where it stopped and a changed input is taken up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitegauge.functions.scalars import finite_columns, viable
from sitegauge.operators import places, profile, topics
from sitegauge.operators.composite import score_locations
from sitegauge.operators.joins import left_renamed
from sitegauge.operators.normalize import normalize_table
from sitegauge.operators.resistance import resistance_scores
from sitegauge.operators.sentiment import with_sentiment
from sitegauge.operators.validation import (
    class_centres, classification_report, confusion, match_outcomes, roc_points, sensitivity, validate_scores,
)
from sitegauge.operators.weights import derive_weights
from sitegauge.plans import features as sources
from sitegauge.plans.results import validation_summary
from sitegauge.session import small_table
from sitegauge.sources import dimensions as dims, files, schemas
from sitegauge.sources.cache import LookupCache
from sitegauge.sources.fixed_values import (
    DIMENSIONS, FALLBACK_WEIGHTS, MODEL_VERSION, PRIORITY_FEATURES,
)
from sitegauge.sources.publish import publish


#: Hash buckets of the tables with one row per location; their joins need no shuffle.
BUCKETS = 8


class Suitability:
    """Tables and documents of one run, kept under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, force: bool = False, buckets: int = BUCKETS):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.force = force
        self.buckets = buckets

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _table(self, name: str, compute, *inputs: DataFrame | None, **parameters) -> DataFrame:
        return files.materialize(self.spark, self._path(name), compute, self.force, files.digest(*inputs, **parameters))

    def _per_location(self, name: str, compute, *inputs: DataFrame | None) -> DataFrame:
        """A table with one row per location, in hash buckets of its code."""
        return files.materialize(
            self.spark, self._path(name), compute, self.force, files.digest(*inputs, buckets=self.buckets),
            lambda df, path: files.write_bucketed(df, path, "county_fips", self.buckets),
            lambda path: files.read_bucketed(self.spark, path, "county_fips", self.buckets))

    # ---- features from landed answers

    def _landed(self, answers: str, name: str, key: str, payload: str) -> DataFrame | None:
        """A service's answers that parse, or None where none were landed; what does not parse is kept aside."""
        path = f"{answers.rstrip('/')}/{name}"
        if not files.exists(self.spark, path):
            return None
        good, broken = files.read_answers(self.spark, path, key, payload)
        files.quarantine(broken, self._path(f"quarantine/{name}"))
        return good

    def collected(self, answers: str, counties: DataFrame | None = None) -> DataFrame:
        """The feature table of all sources that were landed under ``answers``.

        Folders: prices, generation (by state); solar, wind, climate, ground_water, surface_water (by county).  Without
        county climates the state's are taken.
        """
        spark = self.spark
        counties = counties if counties is not None else dims.target_counties(spark)
        prices = self._landed(answers, "prices", "state", schemas.PRICE_AS_SENT)
        generation = self._landed(answers, "generation", "state", schemas.GENERATION)
        solar = self._landed(answers, "solar", "county_fips", schemas.SOLAR)
        wind = self._landed(answers, "wind", "county_fips", schemas.WIND)
        climates = self._landed(answers, "climate", "county_fips", schemas.CLIMATE)
        ground = self._landed(answers, "ground_water", "county_fips", schemas.WATER)
        surface = self._landed(answers, "surface_water", "county_fips", schemas.WATER)

        def or_none(df: DataFrame | None, key: str, payload: str) -> DataFrame:
            return df if df is not None else small_table(spark, [], f"{key} string, payload struct<{payload.replace(' ', ': ', 1)}>")

        power = renewable = water = None
        if prices is not None or generation is not None:
            power = self._table("electricity", lambda: sources.electricity(
                sources.prices(or_none(prices, "state", schemas.PRICE_AS_SENT)),
                sources.latest_mix(sources.generation_rows(or_none(generation, "state", schemas.GENERATION))),
                dims.target_states(spark)), prices, generation)
        if solar is not None or wind is not None:
            renewable = self._per_location("sun_and_wind", lambda: sources.sun_and_wind(
                dims.centroids(spark), or_none(solar, "county_fips", schemas.SOLAR),
                or_none(wind, "county_fips", schemas.WIND)), solar, wind)
        climate = self._per_location("climate", lambda: sources.climate(counties, sources.climate_rows(climates))
                                     if climates is not None else sources.climate_from_states(counties, dims.state_climate(spark)),
                                     climates, counties)
        if ground is not None or surface is not None:
            water = self._per_location("water", lambda: sources.water(
                counties, sources.series_last_rows(or_none(ground, "county_fips", schemas.WATER)),
                sources.series_last_rows(or_none(surface, "county_fips", schemas.WATER))), ground, surface, counties)
        spine = self._per_location("counties", lambda: counties.select("county_fips"), counties)
        return sources.master_features(spine, power, renewable, climate, water)

    # ---- texts

    def posts(self, corpus: DataFrame, crosswalk: DataFrame | None = None, cache: DataFrame | None = None) -> DataFrame:
        """All long enough posts with clean text, place mentions and county.

        Answers of lookups are kept over runs; those given as ``cache`` are taken in first.
        """
        def compute() -> DataFrame:
            kept = LookupCache(self.spark, self._path("lookups"))
            if cache is not None:
                kept.add(cache)
            return places.preprocess(corpus, crosswalk, kept)

        return self._table("posts", compute, corpus, crosswalk, cache)

    def matched(self, posts: DataFrame) -> DataFrame:
        matched, unmatched = places.split_matched(posts)
        files.write_csv(unmatched, self._path("unmatched_posts"))
        return self._table("matched_posts", lambda: matched, posts)

    def with_topics(self, matched: DataFrame, **options) -> DataFrame:
        def compute() -> DataFrame:
            weighted, summary, _, _ = topics.extract_topics(matched, **options)
            files.write_table(summary, self._path("topic_summary"))
            files.write_csv(self.spark.read.parquet(self._path("topic_summary")), self._path("topic_summary_csv"))
            return weighted

        return self._table("posts_with_topics", compute, matched, **options)

    def resistance(self, posts: DataFrame, populations: DataFrame, by_label: bool = False) -> DataFrame:
        """Scores per county; topics 0-4 count, or those labelled as resistance."""
        def compute() -> DataFrame:
            n = sum(c.startswith("topic_") and c.endswith("_weight") for c in posts.columns)
            chosen = range(min(n, 5))
            if by_label:
                chosen = topics.resistance_topics(self.spark.read.parquet(self._path("topic_summary")))
            return resistance_scores(with_sentiment(posts), populations, chosen)

        return self._table("county_resistance_scores", compute, posts, populations, by_label=by_label)

    # ---- scores

    def correlation(self, features: DataFrame) -> DataFrame:
        """Collinear feature pairs with what to do about them; the profile of all numeric columns is kept beside them."""
        numeric = features.select(*profile.numeric_columns(features))
        self._table("column_profile", lambda: profile.column_profile(numeric), features)

        def compute() -> DataFrame:
            pairs = profile.collinear_pairs(profile.correlation_pairs(profile.drop_all_null(numeric)))
            return profile.recommend(pairs, PRIORITY_FEATURES)

        return self._table("collinear_pairs", compute, features)

    def normalized(self, features: DataFrame) -> DataFrame:
        return self._table("features_normalized", lambda: normalize_table(features), features)

    def enriched(self, features: DataFrame, resistance: DataFrame | None) -> DataFrame:
        """Features with the social columns, as scored and as varied in the sensitivity run."""
        if resistance is None:
            return features
        wanted = ["matched_county_fips", "social_resistance_score", "posts_per_capita",
                  "post_count", "avg_sentiment"]
        side = files.select_existing(resistance, wanted)
        return left_renamed(features, side, "county_fips", "matched_county_fips").drop(
            "matched_county_fips")

    def weights(self, features: DataFrame | None = None, labels: DataFrame | None = None) -> dict:
        """The stored weights document; learned once from the same features and labels; else the fallback."""
        path = self._path("derived_weights")
        stored = files.read_weights(self.spark, path)
        if features is None or labels is None:
            return stored or {"weights": dict(FALLBACK_WEIGHTS)}
        made_from = files.digest(features, labels)
        if stored and not self.force and files.noted(self.spark, path) == made_from:
            return stored
        rows = labels.select("county_fips", "label").join(features, "county_fips")
        document = derive_weights(rows)
        if document["raw_coefficients"]:
            files.write_weights(self.spark, document, path)
            files.note(self.spark, path, made_from)
        return document

    def scores(self, features: DataFrame, weights: dict) -> DataFrame:
        return self._table("psi_scores", lambda: score_locations(features, weights), features, weights=weights)

    # ---- validation

    def sensitivity(self, features: DataFrame, weights: dict) -> tuple[DataFrame, DataFrame]:
        pairs, table = sensitivity(features, weights, DIMENSIONS)
        pairs = self._table("sensitivity_analysis", lambda: pairs, features, weights=weights)
        files.write_csv(pairs, self._path("sensitivity_analysis_csv"))
        return pairs, table

    def validation(
        self, scores: DataFrame, labels: DataFrame, document: dict, pairs: DataFrame | None = None,
        match_rate: float | None = None,
    ) -> dict:
        """Figures of the scores against known outcomes; reports, ROC, class centres and the summary are kept."""
        metrics = validate_scores(scores, labels)
        matched = match_outcomes(labels.select("county_fips", "label"), scores, "county_fips")
        if metrics["auc"] is not None:
            predicted = matched.withColumn("predicted", viable("psi"))
            self._table("confusion", lambda: confusion(predicted, "label", "predicted"), scores, labels)
            self._table("classification_report", lambda: classification_report(predicted, "label", "predicted"), scores, labels)
            self._table("roc_points", lambda: roc_points(matched, "psi", "label"), scores, labels)
            self._table("class_centres", lambda: class_centres(matched, "social_score", "label"), scores, labels)
        summary = validation_summary(self.spark, document, metrics, match_rate, pairs, MODEL_VERSION)
        files.write_table(summary, self._path("validation_summary"))
        return metrics

    def run(
        self, features: DataFrame | None = None, corpus: DataFrame | None = None, populations: DataFrame | None = None,
        labels: DataFrame | None = None, crosswalk: DataFrame | None = None,
        cache: DataFrame | None = None, learn: bool = False, publish_to: str | None = None,
        answers: str | None = None, **topic_options,
    ) -> dict:
        """Run all steps and return their tables and figures by name.

        Features are given, or built from the answers landed under ``answers``.
        """
        if features is None and answers is None or corpus is None:
            raise ValueError("features or answers, and a corpus, are needed")
        spark = self.spark
        populations = populations if populations is not None else dims.populations(spark)
        labels = labels if labels is not None else dims.labelled_sites(spark)
        given = finite_columns(features if features is not None else self.collected(answers))
        features = self._table("features", lambda: given, given)
        posts = self.posts(corpus, crosswalk, cache)
        matched = self.matched(posts)
        with_topics = self.with_topics(matched, **topic_options)
        resistance = self.resistance(with_topics, populations)
        collinear = self.correlation(features)
        normalized = self.normalized(features)
        enriched = self.enriched(features, resistance)
        document = self.weights(enriched, labels) if learn else self.weights()
        scores = self.scores(enriched, document["weights"])
        stability, table = self.sensitivity(enriched, document["weights"])
        rate = profile.match_rate(posts, "matched_county_fips").head().asDict()
        out = {
            "features": features, "posts": posts, "matched": matched, "topics": with_topics,
            "resistance": resistance, "collinear": collinear, "normalized": normalized,
            "weights": document, "scores": scores,
            "validation": self.validation(scores, labels, document, stability, rate["rate"]),
            "sensitivity": stability, "rank_table": table, "match_rate": rate,
        }
        if publish_to:
            locations = features.join(dims.centroids(spark), "county_fips", "left")
            out["published"] = publish(scores, publish_to, MODEL_VERSION, document["weights"], locations)
        return out
