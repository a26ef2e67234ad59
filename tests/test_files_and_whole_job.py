import json
import os

import pytest
from pyspark.sql import functions as F

from sitegauge.operators import joins, places, weights
from sitegauge.plans import results
from sitegauge.plans.suitability import Suitability
from sitegauge.session import shared_dir, small_table, stage
from sitegauge.sources import dimensions as dims, files, publish as pub, schemas
from sitegauge.sources.cache import LookupCache
from sitegauge.sources.fixed_values import FALLBACK_WEIGHTS


def test_corpus_round_trip(spark, tmp_path):
    path = tmp_path / "corpus.jsonl"
    path.write_text('{"url": "u", "content": "größe", "scraped_at": "2025-01-02T03:04:05+00:00"}\n\n{"url": "v"}\n', encoding="utf-8")
    df = files.read_corpus(spark, str(path))
    assert df.count() == 2 and df.schema == schemas.POSTS_RAW
    files.write_corpus(df, str(tmp_path / "out"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*"))
    assert "größe" in text
    assert files.read_corpus(spark, str(tmp_path / "out")).count() == 2


def test_missing_tables(spark, tmp_path):
    assert files.read_table(spark, str(tmp_path / "a"), str(tmp_path / "b")) is None
    spark.range(2).write.parquet(str(tmp_path / "b"))
    assert files.read_table(spark, str(tmp_path / "a"), str(tmp_path / "b")).count() == 2
    assert files.read_csv(spark, str(tmp_path / "c"), schemas.TOPIC_SUMMARY) is None


def test_availability_of_tables_written_by_others(spark, tmp_path):
    for name in ("marked", "unmarked", "broken_off"):
        spark.range(3).write.parquet(str(tmp_path / name))
    for name in ("unmarked", "broken_off"):
        (tmp_path / name / "_SUCCESS").unlink()
    (tmp_path / "broken_off" / "_temporary").mkdir()
    (tmp_path / "empty").mkdir()
    names = ["marked", "unmarked", "broken_off", "empty", "absent"]
    got = files.availability(spark, {n: str(tmp_path / n) for n in names})
    assert [(r.dataset, r.n) for r in got.collect()] == [("marked", 3), ("unmarked", 3), ("broken_off", 0), ("empty", 0), ("absent", 0)]


def test_csv_keeps_codes_and_lists(spark, tmp_path):
    (tmp_path / "cross.csv").write_text("place_name,county_fips\nMesa,4013\n")
    assert files.read_crosswalk(spark, str(tmp_path / "cross.csv")).head().county_fips == "04013"
    df = small_table(spark, [(0, "A", ["x y", "z"])], "topic_id int, label string, top_words array<string>")
    files.write_csv(df, str(tmp_path / "t"))
    back = files.read_csv(spark, str(tmp_path / "t"), schemas.TOPIC_SUMMARY)
    assert back.select(files.parse_list("top_words").alias("w")).head().w == ["x y", "z"]


def test_weights_document(spark, tmp_path):
    path = str(tmp_path / "w")
    assert files.load_weights(spark, path) == FALLBACK_WEIGHTS
    files.write_weights(spark, {"weights": {"power": 0.6, "social": 0.4}, "strategy": "s", "n_blocked": 3}, path)
    assert files.load_weights(spark, path) == {"power": 0.6, "social": 0.4}
    assert files.read_weights(spark, path)["n_blocked"] == 3


def test_landed_answers(spark, tmp_path):
    path = tmp_path / "answers"
    path.mkdir()
    (path / "a.json").write_text(json.dumps({"state": "VA", "payload": {"response": {"data": [{"price": "6.5"}]}}}) + "\n\n")
    (path / "b.json").write_text((json.dumps({"state": "TX", "payload": {}}) + "\n") * 2)
    df = files.read_payloads(spark, str(path), "state", schemas.PRICE)
    assert {r.state: r.payload.response and r.payload.response.data[0].price for r in df.distinct().collect()} == {"VA": "6.5", "TX": None}
    assert sorted(r.records for r in files.records_per_file(spark, str(path)).collect()) == [1, 2]
    files.land_payloads(df, str(tmp_path / "again"))
    assert files.read_payloads(spark, str(tmp_path / "again"), "state", schemas.PRICE).count() == 3


def test_stages_are_reused(spark, tmp_path):
    calls = []
    def compute():
        calls.append(1)
        return spark.range(len(calls))
    path = str(tmp_path / "s")
    assert [files.materialize(spark, path, compute, f).count() for f in (False, False, True)] == [1, 1, 2]
    assert len(calls) == 2


def test_a_write_that_broke_off_is_not_taken_for_a_table(spark, tmp_path):
    half = tmp_path / "half"
    spark.range(3).write.parquet(str(half))
    (half / "_SUCCESS").unlink()
    whole = str(tmp_path / "whole")
    spark.range(5).write.parquet(whole)
    assert files.read_table(spark, str(half)) is None
    assert files.read_table(spark, str(half), whole).count() == 5
    assert files.materialize(spark, str(half), lambda: spark.range(100)).count() == 100
    assert files.read_table(spark, str(half)).count() == 100
    one = str(next((tmp_path / "whole").glob("*.parquet")))
    assert files.read_table(spark, one).count() <= 5
    path = str(tmp_path / "weights")
    files.write_weights(spark, {"weights": {"power": 1.0}, "strategy": "x"}, path)
    assert files.load_weights(spark, path) == {"power": 1.0}
    (tmp_path / "weights" / "_SUCCESS").unlink()
    assert files.read_weights(spark, path) is None


def test_staged_tables_live_in_the_named_folder(spark):
    df = stage(spark.range(3))
    assert shared_dir(spark).rstrip("/") in df.inputFiles()[0]


def test_site_lists(spark, tmp_path):
    files.write_site_lists(spark, str(tmp_path))
    both = spark.read.option("header", True).csv(str(tmp_path / "all_validation_sites"))
    assert both.count() == 40 and both.filter("label = 1").count() == 25


def test_hash_ignores_order_and_sees_changes(spark):
    df = small_table(spark, [("a", 1.0, None), ("b", None, [1]), ("b", None, [1])], "k string, x double, l array<int>")
    one = pub.content_hash(df).head()
    assert one.data_hash == pub.content_hash(df.orderBy(F.desc("k")).repartition(3)).head().data_hash and len(one.data_hash) == 12
    assert one.data_hash == pub.content_hash(df.select("l", "k", "x")).head().data_hash
    assert one.data_hash != pub.content_hash(df.distinct()).head().data_hash
    swapped = df.select("k", F.lit(None).cast("double").alias("x"), "l")
    assert one.data_hash != pub.content_hash(swapped).head().data_hash


def test_publish_once_per_content(spark, tmp_path):
    folder = str(tmp_path / "pub")
    first = small_table(spark, [("4013", 50.0, '{"power": 1.0}')], "county_fips string, psi double, weights_used string")
    second = small_table(spark, [("4013", 60.0, None), ("51107", 70.0, None)], "county_fips string, psi double, weights_used string")
    places = dims.centroids(spark)
    assert pub.publish(first, folder, "1.0", locations=places)["published"]
    assert not pub.publish(first, folder, "1.0", locations=places)["published"]
    assert pub.publish(second, folder, "2.0", {"power": 0.5})["published"]
    assert pub.publish(second, folder, "1.0")["published"]
    registry = pub.read_registry(spark, folder).orderBy("seeded_at").collect()
    assert [(r.model_version, r.n_locations, r.is_active) for r in registry] == [("1.0", 1, False), ("2.0", 2, False), ("1.0", 2, True)]
    assert registry[0].weights == {"power": 1.0} and registry[1].weights == {"power": 0.5}
    assert sorted(r.psi for r in pub.active_scores(spark, folder).collect()) == [60.0, 70.0]
    stored = spark.read.parquet(folder + "/scores")
    assert stored.count() == 4 and stored.filter("county_fips = '04013'").count() == 2
    points = spark.read.parquet(folder + "/locations")
    assert points.count() == 20 and points.filter("coordinates is not null").count() == 20


def test_broken_answers_are_kept_aside(spark, tmp_path):
    good = json.dumps({"state": "VA", "payload": {"response": {"data": [{"price": "6.5"}]}}})
    for name, lines in (("a.json", [good, "", good[:20], "no json", good]), ("b.json", [good, '{"state": "TX", "payload": 7}'])):
        (tmp_path / "answers").mkdir(exist_ok=True)
        (tmp_path / "answers" / name).write_text("\n".join(lines) + "\n")
    answers, broken = files.read_answers(spark, str(tmp_path / "answers"), "state", schemas.PRICE)
    assert [r.payload.response.data[0].price for r in answers.collect()] == ["6.5"] * 3
    counts = files.quarantine(broken, str(tmp_path / "aside")).collect()
    assert {r.file[-6:]: r.broken for r in counts} == {"a.json": 2, "b.json": 1}
    assert sorted(r.line for r in spark.read.parquet(str(tmp_path / "aside")).collect()) == sorted(
        [good[:20], "no json", '{"state": "TX", "payload": 7}'])


def test_digests_see_inputs_and_parameters(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(5).write.parquet(path)
    df = spark.read.parquet(path)
    one = files.digest(df, k=1)
    assert one == files.digest(spark.read.parquet(path), k=1)
    assert one not in (files.digest(df, k=2), files.digest(df.where("id > 1"), k=1), files.digest(df, None, k=1))
    assert files.digest(df.where("id > 1")) != files.digest(df.where("id > 2"))
    spark.range(6).write.mode("overwrite").parquet(path)
    assert one != files.digest(spark.read.parquet(path), k=1)
    rows = [("a", 1), ("b", 2)]
    local = [files.digest(spark.createDataFrame(r, "k string, n int")) for r in (rows, rows[::-1], rows[:1])]
    assert local[0] == local[1] != local[2]


def test_stages_follow_their_inputs(spark, tmp_path):
    path, calls = str(tmp_path / "s"), []

    def run(n, **parameters):
        def compute():
            calls.append(n)
            return spark.range(n)

        return files.materialize(spark, path, compute, made_from=files.digest(spark.range(n), **parameters)).count()

    assert [run(3), run(3), run(4), run(4, k=1), run(4, k=1)] == [3, 3, 4, 4, 4] and calls == [3, 4, 4]
    (tmp_path / "s.made-from" / "_SUCCESS").unlink()
    assert run(4, k=1) == 4 and len(calls) == 4  # a note that was not finished says nothing


def test_lookups_are_kept_over_runs(spark, tmp_path):
    kept = LookupCache(spark, str(tmp_path / "lookups"))
    entry = "key string, fips string"
    assert kept.entries().count() == kept.batches() == 0
    assert kept.add(small_table(spark, [("a|", "1"), ("b|", None)], entry)) == 2
    assert kept.add(small_table(spark, [("a|", "1"), ("b|", None)], entry)) == 0 and kept.batches() == 1
    assert kept.add(small_table(spark, [("b|", "2"), ("c|", "3"), ("a|", "1")], entry)) == 2
    again = LookupCache(spark, str(tmp_path / "lookups"))
    assert {(r.key, r.fips, r.batch) for r in again.entries().collect()} == {("a|", "1", 1), ("b|", "2", 2), ("c|", "3", 2)}
    asked = small_table(spark, [("b|",), ("z|",)], "key string")
    assert [r.key for r in again.unknown(asked).collect()] == ["z|"]
    (tmp_path / "lookups" / "batch-2" / "_SUCCESS").unlink()
    assert again.batches() == 1  # cut short, so it does not count


def test_posts_resolve_only_new_lookups(spark, tmp_path):
    kept = LookupCache(spark, str(tmp_path / "lookups"))
    kept.add(small_table(spark, [("nova|VA", None), ("atlantis|", "99999")], "key string, fips string"))
    rows = [(f"https://reddit.com/r/nova/{i}", f"{name} and many more words that fill the text beyond its least length") for i, name in
            enumerate(["Nova", "Mesa", "Nova"])]
    posts = places.preprocess(spark.createDataFrame(rows, "url string, content string"), cache=kept)
    assert sorted((r.matched_county_fips or "") for r in posts.collect()) == ["", "", "04013"]
    assert {(r.key, r.fips) for r in kept.history().where("batch = 2").collect()} == {("mesa|VA", "04013")}


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    base = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("county_fips"), "id")
    for name in ("a", "b", "c"):
        files.write_bucketed(base.withColumnRenamed("id", name), str(tmp_path / name), "county_fips", 4)
    files.write_bucketed(base.withColumnRenamed("id", "a"), str(tmp_path / "a"), "county_fips", 4)  # written over
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = [files.read_bucketed(spark, str(tmp_path / n), "county_fips", 4) for n in ("a", "b", "c")]
        joined = joins.left_chain(tables[0], "county_fips", *tables[1:])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.where("a = b AND b = c").count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_feature_table_needs_no_shuffle_by_county(spark, folder):
    from sitegauge.catalog import evidence

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = evidence.feature_table(spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") >= 4 and "hashpartitioning(county_fips" not in plan


def land(folder, name, rows):
    (folder / name).mkdir(parents=True)
    (folder / name / "part.json").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def test_whole_job(spark, tmp_path, monkeypatch):
    """From landed answers and a corpus to a summary that is read back."""
    monkeypatch.setattr(weights, "FOLDS", 2)
    monkeypatch.setattr(weights, "MIN_MINORITY", 99)
    names = ["Ashburn", "Manassas", "Chandler", "DFW", "Quincy", "Atlanta", "Seattle", "Chicago", "Las Vegas", "Nashville"]
    themes = ["water shortage drought aquifer gallons", "noise pollution loud sound quiet", "tax revenue jobs economy hire"]
    rows = [(f"https://reddit.com/r/{'nova' if i % 4 else 'texas'}/{i}", f"[t](http://x.y) {names[i % 10]}: {themes[i % 3]} "
             f"{themes[(i // 3) % 3]} people **oppose** the plan number {i}") for i in range(80)]
    corpus = spark.createDataFrame(rows, "url string, content string")
    answers = tmp_path / "answers"
    counties = [r.county_fips for r in dims.target_counties(spark).collect()]
    states = [r.state for r in dims.target_states(spark).orderBy("state").collect()]
    land(answers, "prices", [{"state": s, "payload": {"response": {"data": [{"price": str(5 + i / 10)}]}}} for i, s in enumerate(states)] + ['{"state": "VA", "pay'])
    land(answers, "generation", [{"state": s, "payload": {"response": {"data": [
        {"period": "2023", "generation": "100", "fueltypeid": "ALL"}, {"period": "2023", "generation": str(7 * i % 90), "fueltypeid": "SUN"}]}}}
        for i, s in enumerate(states)])
    land(answers, "solar", [{"county_fips": c, "payload": {"outputs": {"solrad_annual": 3 + i / 8}}} for i, c in enumerate(counties)])
    land(answers, "surface_water", [{"county_fips": c, "payload": {"value": {"timeSeries": [{"values": [{"value": [{"value": str(3 * i)}]}]}]}}}
                                    for i, c in enumerate(counties)])
    job = Suitability(spark, str(tmp_path / "run"))
    options = dict(corpus=corpus, answers=str(answers), learn=True, k=3, passes=1, max_share=1.0)
    out = job.run(publish_to=str(tmp_path / "pub"), **options)
    features = {r.county_fips: r for r in out["features"].collect()}
    assert len(features) == 26 and features["51107"].state == "VA"
    assert features["51107"].industrial_rate_cents_kwh == pytest.approx(5 + states.index("VA") / 10)
    assert features["04013"].avg_temp_f == 60.3  # no county climates were landed, so the state's are taken
    assert features[counties[2]].surface_water_flow_cfs == 6.0 and features[counties[0]].groundwater_level_ft is None
    assert [r.line for r in spark.read.parquet(str(tmp_path / "run/quarantine/prices")).collect()] == ['{"state": "VA", "pay']
    assert out["scores"].count() == 26 and out["match_rate"]["total"] == 80
    # "DFW" in a Virginia forum has two candidates, none of them there.
    assert out["match_rate"]["matched"] == out["matched"].count() == 72
    assert out["resistance"].count() == 9
    assert out["resistance"].filter("social_resistance_score is null").count() == 0
    assert out["sensitivity"].count() == 10 and out["validation"]["n"] == 33 and 0 <= out["validation"]["auc"] <= 1
    assert sum(out["weights"]["weights"].values()) == pytest.approx(1.0, abs=0.01)
    assert out["published"]["published"]
    assert out["scores"].filter("social_score is null").count() == 17  # no posts, no social score
    # What validation found is kept and read back.
    summary = results.stored_summary(spark, str(tmp_path / "run")).head()
    assert summary.auc == out["validation"]["auc"] and summary.imbalance_strategy == out["weights"]["strategy"]
    assert summary.weights == out["weights"]["weights"] and len(summary.sensitivity) == 10
    assert summary.geocoding_match_rate == pytest.approx(90.0) and summary.n_validation_sites == 39 - 6
    assert results.stored_summary(spark, str(tmp_path / "none")).head().auc is None
    for name, least in (("classification_report", 5), ("confusion", 4), ("roc_points", 2), ("class_centres", 2), ("column_profile", 5)):
        assert spark.read.parquet(str(tmp_path / "run" / name)).count() >= least
    for name, n in (("topic_summary_csv", 3), ("sensitivity_analysis_csv", 10)):
        assert spark.read.option("header", True).csv(str(tmp_path / "run" / name)).count() == n
    assert {r.fips for r in LookupCache(spark, str(tmp_path / "run/lookups")).entries().collect()} >= {"51107", "04013"}
    # A second run reads every table back; other weights score anew.
    written = {n: (tmp_path / "run" / n / "_SUCCESS").stat().st_mtime_ns for n in ("features", "posts", "posts_with_topics", "psi_scores")}
    again = Suitability(spark, str(tmp_path / "run"))
    assert again.weights()["strategy"] == out["weights"]["strategy"]
    scores = again.run(**options)["scores"]
    assert scores.count() == 26
    assert written == {n: (tmp_path / "run" / n / "_SUCCESS").stat().st_mtime_ns for n in written}
    other = again.scores(out["features"], {"power": 1.0})
    assert {r.weights_used for r in other.collect()} == {'{"power": 1.0}'}
