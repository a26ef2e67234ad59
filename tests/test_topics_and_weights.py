import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sitegauge.operators import lda, logistic, topics, weights
from sitegauge.operators.neighbours import nearest, nearest_distances
from sitegauge.session import stage
from sitegauge.sources import dimensions as dims
from sitegauge.sources.fixed_values import FALLBACK_WEIGHTS

THEMES = ["water drought aquifer gallons shortage cooling", "noise loud sound neighborhood quiet residential",
          "tax incentive revenue abatement subsidy deal"]


@pytest.fixture(scope="module")
def posts(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(THEMES[i % 3].split(), 12)) + " data center the project") for i in range(90)]
    return spark.createDataFrame(rows + [(90, ""), (91, None)], "id long, clean_text string")


def test_vocabulary_limits(spark):
    docs = spark.createDataFrame([(["a", "b", "a"],), (["a"],), (["a", "c"],), (["a", "b"],), (["b"],)], "terms array<string>")
    counts = {r.term: (r.tf, r.df) for r in topics.term_counts(docs).collect()}
    assert counts == {"a": (5, 4), "b": (3, 3), "c": (1, 1)}
    kept = topics.vocabulary(topics.term_counts(docs), 5, min_docs=2, max_share=0.8).collect()
    assert [r.term for r in kept] == ["a", "b"]
    assert kept[0].idf == pytest.approx(np.log(6 / 5) + 1)
    assert [r.term for r in topics.vocabulary(topics.term_counts(docs), 5, 1, 0.7).collect()] == ["b", "c"]
    assert [r.term for r in topics.vocabulary(topics.term_counts(docs), 5, 1, 1.0, 1).collect()] == ["a"]


def test_topic_shape(spark, posts):
    weighted, summary, model, tfidf = topics.extract_topics(posts, k=3, passes=20, max_share=1.0)
    rows = weighted.orderBy("id").collect()
    assert len(rows) == 92
    for r in rows:
        w = [r[f"topic_{i}_weight"] for i in range(3)]
        assert sum(w) == pytest.approx(1.0) and r.dominant_topic == int(np.argmax(w))
    # Texts of one theme share their strongest topic.
    for theme in range(3):
        found = pd.Series([r.dominant_topic for r in rows[theme:90:3]]).value_counts()
        assert found.iloc[0] >= 27
    assert not {"data", "center", "project", "the"} & set(tfidf.terms)
    assert summary.count() == 3 and all(len(r.top_words) == 15 for r in summary.collect())
    shares = topics.topic_distribution(weighted, summary).agg(F.sum("n"), F.sum("pct")).head()
    assert shares[0] == 92 and shares[1] == pytest.approx(100.0)


def test_shares_go_on_until_every_text_has_settled(spark):
    """Between two topics that are almost alike a long text moves slowly for more rounds than learning allows."""
    model = lda.TopicModel(np.array([[520.0, 480.0, 500.0], [500.0, 500.0, 500.0]]))
    vectors = spark.createDataFrame([(0, Vectors.sparse(3, [0, 1, 2], [500.0, 300.0, 200.0])), (1, Vectors.sparse(3, [], []))], ["i", "f"])
    got = {r.i: np.array(r.w) for r in vectors.select("i", model.shares(F.col("f")).alias("w")).collect()}
    theta, topics = np.exp(lda.digamma(got[0] * 1001.0)), np.exp(lda.expectation(model.parameters))
    again = 0.5 + sum(n * theta * topics[:, t] / (theta * topics[:, t]).sum() for t, n in enumerate([500.0, 300.0, 200.0]))
    assert np.abs(again / again.sum() - got[0]).max() < 1e-5 and got[0].max() > 0.99
    assert got[1].tolist() == [0.5, 0.5]


def test_distances_to_the_nearest_are_exact(spark):
    """More rows than a window, in clusters, with copies and outliers: the walk along Z-orders misses some."""
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(rng.uniform(-50, 50, 3), s, (400, 3)) for s in (0.1, 1, 5, 20, 20)]).round(2)
    points = np.concatenate([points, points[:30], points[:30], np.repeat(points[:1], 9, axis=0), [[1e5, 0, 0], [0, -1e5, 3]]])
    rows = spark.createDataFrame(pd.DataFrame(points, columns=["a", "b", "c"])).repartition(5)
    got = {(r.a, r.b, r.c): r.near for r in nearest_distances(rows, ["a", "b", "c"], 5, block=64).collect()}
    assert len(got) == len({tuple(p) for p in points})
    for p in points:
        wanted = np.sort(np.sqrt(((points - p) ** 2).sum(axis=1)))[1:6]
        assert np.allclose(got[tuple(p)], wanted, rtol=1e-12, atol=1e-12)
    few = nearest_distances(spark.createDataFrame([(0.0,), (3.0,), (3.0,)], ["a"]), ["a"], 5)
    assert {r.a: r.near for r in few.collect()} == {0.0: [3.0, 3.0], 3.0: [0.0, 3.0]}


def plain_lda(texts, n_terms, k, seed, passes, n_batches):
    """The same steps text by text and term by term: topics, and the bound per text at the last pass."""
    from math import lgamma, log

    alpha = eta = 1.0 / k
    psi = lambda x: (lgamma(x + 1e-5) - lgamma(x - 1e-5)) / 2e-5
    logs = lambda p: np.array([psi(v) for v in p]) - psi(sum(p))
    topics, step = lda.first_topics(k, n_terms, seed), 0
    for _ in range(passes):
        bound = 0.0
        for b in range(n_batches):
            log_topics = np.array([logs(t) for t in topics])
            uses, batch = np.zeros((k, n_terms)), texts[b::n_batches]
            for terms, counts in batch:
                gamma = np.full(k, alpha + sum(counts) / k)
                for _ in range(100):
                    theta = np.exp(logs(gamma))
                    part = [n * (s := theta * np.exp(log_topics[:, t])) / s.sum() for t, n in zip(terms, counts)]
                    new = alpha + sum(part, np.zeros(k))
                    done, gamma = np.abs(new - gamma).mean() < 1e-3, new
                    if done:
                        break
                for t, p in zip(terms, part):
                    uses[:, t] += p
                theta = logs(gamma)
                bound += sum(n * log(np.exp(theta + log_topics[:, t]).sum()) for t, n in zip(terms, counts))
                bound += sum((alpha - g) * x + lgamma(g) - lgamma(alpha) for g, x in zip(gamma, theta))
                bound += lgamma(alpha * k) - lgamma(sum(gamma))
            bound_topics = topics
            step += 1
            rate = (10.0 + step) ** -0.7
            topics = (1 - rate) * topics + rate * (eta + len(texts) / len(batch) * uses)
        final = sum(sum((eta - v) * x + lgamma(v) - lgamma(eta) for v, x in zip(t, logs(t))) + lgamma(eta * n_terms) - lgamma(sum(t))
                    for t in topics)
    return topics, (bound + final) / len(texts)


@pytest.mark.parametrize("n_texts, passes", [(100, 12), (300, 6)])
def test_topics_and_bound_by_a_plain_form(spark, n_texts, passes):
    """One mini-batch gives the plain form's topics; of several, which hold other texts, the bound is close."""
    rng = np.random.default_rng(3)
    vectors = []
    for i in range(n_texts):
        terms = sorted(rng.choice(30, 8, replace=False) // 3 * 3 + i % 3)
        vectors.append((sorted(set(map(int, terms))), None))
        vectors[-1] = (vectors[-1][0], [float(v) for v in rng.uniform(0.2, 2.0, len(vectors[-1][0]))])
    rows = [(i, Vectors.sparse(30, t, c)) for i, (t, c) in enumerate(vectors)]
    df = spark.createDataFrame(rows, ["id", "features"]).repartition(3)
    model = lda.fit(df, 30, 3, 42, passes)
    n_batches = max(1, min(lda.MOST_BATCHES, -(-n_texts // lda.BATCH_TEXTS)))
    parameters, bound = plain_lda(vectors, 30, 3, 42, passes, n_batches)
    if n_batches == 1:
        assert np.allclose(model.parameters, parameters, rtol=2e-2, atol=2e-2)
    assert model.bound == pytest.approx(bound, rel=0.03)


def test_digamma_and_log_gamma():
    from math import lgamma

    x = np.array([1e-3, 0.1, 0.5, 1.0, 2.5, 30.0, 1e4])
    assert np.allclose(lda.log_gamma(x), [lgamma(v) for v in x], rtol=1e-10, atol=1e-10)
    assert np.allclose(lda.digamma(x), [(lgamma(v * (1 + 1e-6)) - lgamma(v * (1 - 1e-6))) / (2e-6 * v) for v in x], rtol=1e-5)


def test_pairs_are_counted_of_common_words_only(spark, monkeypatch):
    """The vocabulary is that of all words' and pairs' counts, in parts of any size; null texts and words count as before."""
    monkeypatch.setattr(topics, "VALUES_TOGETHER", 50)
    monkeypatch.setattr(topics, "TEXTS_TOGETHER", 7)
    rng = np.random.default_rng(4)
    words = [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rng.choice(words, 15, p=np.arange(20, 0, -1) / 210)) + " new york" * (i % 3),) for i in range(60)] + [(None,), ("",)]
    docs = topics.with_terms(spark.createDataFrame(rows, "t string").repartition(3), "t", stop_words=["wb"])
    plain = [t for text in docs.select("terms").collect() for t in text.terms]
    n = {r.term: (r.tf, r.df) for r in topics.term_counts(docs).collect()}
    assert {t: tf for t, (tf, _) in n.items()} == pd.Series(plain).value_counts().to_dict()
    seen, count = [], topics.pair_counts

    def counting(docs, words, common):
        seen.append(common.to_pylist())
        return count(docs, words, common)

    monkeypatch.setattr(topics, "pair_counts", counting)
    for limits in ({"max_terms": 9}, {"max_terms": 9, "max_share": 0.5}, {"max_terms": 500}, {"min_docs": 2, "max_terms": 30}):
        wanted = topics.vocabulary(topics.term_counts(docs), 62, **limits).collect()
        for found in (topics.fit_tfidf(docs, **limits), topics.fit_tfidf(topics.with_words(docs, "t", stop_words=["wb"]), words="words", **limits)):
            assert found.terms == [r.term for r in wanted] and found.idf == pytest.approx([r.idf for r in wanted])
    assert 9 <= len(seen[0]) < 15 < len(seen[4]) and any(" " in r.term for r in wanted)
    odd = spark.createDataFrame([(["a", None, "a", None],), (None,), ([],), (["a"],)], "terms array<string>")
    assert {tuple(r) for r in topics.term_counts(odd).collect()} == {("a", 3, 2), (None, 2, 1)}


def test_weights_take_no_text_apart_again(spark, posts):
    """Weights and the weighted terms come from a staged table, so neither splits a text again."""
    weighted, _, model, tfidf = topics.extract_topics(posts, k=3, passes=1, max_share=1.0, kept_in="features")
    assert weighted.columns == ["id", "clean_text", "features", *[f"topic_{i}_weight" for i in range(3)], "dominant_topic"]
    assert "regexp_extract_all" not in weighted._jdf.queryExecution().executedPlan().toString()
    again = tfidf.transform(topics.with_terms(posts, "clean_text"))
    assert dict(weighted.select("id", "features").collect()) == dict(again.select("id", "features").collect())


def test_shares_of_texts_fitted_together_are_those_of_each_alone(monkeypatch):
    """Texts of many sizes, some empty, in bands and portions of any size."""
    rng = np.random.default_rng(6)
    values = np.exp(lda.expectation(rng.gamma(2.0, 1.0, (3, 40))))
    sizes = rng.integers(0, 30, 50)
    terms = np.concatenate([rng.choice(40, size, replace=False) for size in sizes])
    counts = rng.uniform(0.2, 3.0, len(terms))
    monkeypatch.setattr(lda, "SETTLED", 1e-9)
    monkeypatch.setattr(lda, "ALIKE", 8)
    gamma, part = lda.text_shares(terms, counts, sizes, values, 0.3, None)
    for i, end in enumerate(np.cumsum(sizes)):
        own = slice(end - sizes[i], end)
        share = np.exp(lda.expectation(gamma[i]))[:, None] * values[:, terms[own]]
        share *= counts[own] / share.sum(axis=0)
        assert np.allclose(gamma[i], 0.3 + share.sum(axis=1), atol=1e-6) and np.allclose(part[own], share.T)
    monkeypatch.setattr(lda, "TOGETHER", 6)
    monkeypatch.setattr(lda, "TERMS_TOGETHER", 40)
    portions = list(lda.portions(sizes))
    assert [i for p in portions for i in range(p.start, p.stop)] == list(range(50))
    assert all(p.stop - p.start == 1 or p.stop - p.start <= 6 and sizes[p].sum() <= 40 for p in portions)


def test_a_pass_reads_every_text_once(spark, posts, monkeypatch):
    """Buckets are folders of their own: each step's scan has one of them as its only partition."""
    monkeypatch.setattr(lda, "BATCH_TEXTS", 30)
    docs = topics.with_terms(posts, "clean_text", "_terms")
    tfidf = topics.fit_tfidf(docs, "_terms", max_share=1.0)
    path, buckets = lda.lay_out(tfidf.transform(docs, "_terms", "f"), "f", docs.count())
    assert buckets == 4
    table = spark.read.parquet(path)
    for b in range(buckets):
        files = {r[0] for r in table.where(F.col("bucket") == b).select(F.input_file_name()).distinct().collect()}
        assert files and all(f"bucket={b}/" in f for f in files)
    assert table.count() == docs.count()
    plan = table.where("bucket = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_missing_text_column_is_an_error(posts):
    with pytest.raises(ValueError):
        topics.extract_topics(posts.drop("clean_text"))


def test_labels(spark):
    df = spark.createDataFrame([
        (0, ["water", "drought", "noise"]), (1, ["zebra", "water"]), (2, ["power", "Grid", "tax", "revenue"]),
        (3, ["residential", "noise", "property"]), (4, ["jobs", "economy", "hire"])], "topic_id int, top_words array<string>")
    summary = topics.label_topics(df)
    got = {r.topic_id: r.label for r in summary.collect()}
    assert got == {0: "Water Consumption", 1: "Cluster: zebra", 2: "Power Grid Strain", 3: "Noise / Quality of Life",
                   4: "Economic Development"}
    assert topics.resistance_topics(summary) == [0, 2, 3]


# ---- weights

def outcome_rows(spark, n=120, seed=5):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.75).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n), "label": y, "f1": rng.normal(50, 5, n) + 6 * y, "f2": rng.normal(50, 5, n) - 3 * y, "f3": rng.normal(50, 5, n)})
    return spark.createDataFrame(pdf), pdf


DIMS = {"power": ["f1"], "environmental": ["f2", "absent"], "social": ["f3"]}


def newton(x, y, w, steps=60):
    """Weighted logistic regression with unit L2 penalty, intercept free."""
    a = np.column_stack([x, np.ones(len(x))])
    beta, ridge = np.zeros(a.shape[1]), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-a @ beta))
        grad = a.T @ (w * (p - y)) + ridge @ beta
        beta -= np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + ridge, grad)
    return beta[:-1]


def test_balanced_fit_solves_the_penalized_problem(spark):
    df, pdf = outcome_rows(spark)
    model = weights.fit_balanced(df, ["f1", "f2", "f3"])
    y = pdf.label.to_numpy()
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    want = newton(pdf[["f1", "f2", "f3"]].to_numpy(), y, w)
    assert np.allclose(np.array(model.coefficients), want, atol=1e-7)


def test_fits_side_by_side_are_those_of_their_rows(spark):
    """One aggregate per step serves all models; each is the one of its own rows, also where the first steps go too far."""
    df, pdf = outcome_rows(spark)
    wide = df.withColumn("f1", F.col("f1") * 400 - 20000)
    parts = F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda m: m != F.col("id") % 3)
    fits = logistic.fit_models(weights.in_models(wide, parts), ["f1", "f2"], 4)
    for m in range(3):
        rows = pdf[pdf.id % 3 != m]
        y = rows.label.to_numpy()
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
        one = weights.fit_balanced(wide.where(F.col("id") % 3 != m), ["f1", "f2"])
        assert np.allclose([one.intercept, *one.coefficients], [fits[m].intercept, *fits[m].coefficients], atol=1e-8)
        x = np.column_stack([rows.f1 * 400 - 20000, rows.f2])
        p = 1 / (1 + np.exp(-(x @ np.array(fits[m].coefficients) + fits[m].intercept)))
        gradient = x.T @ (w * (p - y)) + np.array(fits[m].coefficients)
        assert np.abs(gradient / np.abs(x).max(axis=0)).max() < 1e-5 and abs((w * (p - y)).sum()) < 1e-5
    assert fits[3] == logistic.Fit(0.0, (0.0, 0.0))


def test_separable_classes_stay_finite(spark):
    df = spark.range(100).select(F.when(F.col("id") < 30, 0).otherwise(1).alias("label"), (F.col("id") * 1000.0).alias("f1"))
    fit = weights.fit_balanced(df, ["f1"])
    assert all(np.isfinite([fit.intercept, *fit.coefficients])) and weights.predict(fit, df, ["f1"]).where("predicted <> label").count() == 0


def test_weights_document(spark, monkeypatch):
    monkeypatch.setattr(weights, "FOLDS", 2)
    df, pdf = outcome_rows(spark)
    doc = weights.derive_weights(df, dimensions=DIMS, key="id")
    assert doc["n_successful"] == int(pdf.label.sum()) and doc["n_blocked"] == int((1 - pdf.label).sum())
    assert sum(doc["weights"].values()) == pytest.approx(1.0, abs=0.01)
    assert doc["weights"]["power"] == max(doc["weights"].values()) and doc["raw_coefficients"]["power"] > 0
    assert 0.5 < doc["macro_f1"] <= 1.0 and doc["strategy"] in ("SMOTE + balanced", "balanced class weights")


@pytest.mark.parametrize("labels", [[1] * 5 + [0] * 4, [1] * 19 + [0], [1] * 12])
def test_too_few_outcomes_fall_back(spark, labels):
    df = spark.createDataFrame([(i, y, float(i), 1.0, 2.0) for i, y in enumerate(labels)], "id long, label int, f1 double, f2 double, f3 double")
    doc = weights.derive_weights(df, dimensions=DIMS, key="id")
    assert doc["weights"] == FALLBACK_WEIGHTS and doc["strategy"] == "fallback"


def test_matrix_fills_medians_and_absent_dimensions(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (2, 0, None), (3, 1, 4.0)], "id long, label int, f1 double")
    got = weights.dimension_matrix(df, {"power": ["f1"], "social": ["none"]}, "label", "id").toPandas()
    assert sorted(got.power) == [1.0, 2.5, 4.0] and set(got.social) == {50.0}


def test_folds_keep_class_shares(spark):
    df = spark.range(1003).select(F.col("id").alias("_id"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    dealt = weights.with_folds(df, 5)
    assert dealt.count() == 1003
    sizes = dealt.groupBy("label", "fold").count().toPandas()
    for _, group in sizes.groupby("label"):
        assert len(group) == 5 and group["count"].max() - group["count"].min() <= 1


def test_neighbours_in_small_groups_are_the_nearest(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 6, size=(80, 2)).astype(float)
    df = spark.createDataFrame([(i + 1, i % 2, *map(float, p)) for i, p in enumerate(x)], "n long, g int, a double, b double").repartition(3)
    rows = nearest(df, ["a", "b"], 4, "n", "g", bucket=16).collect()
    assert len(rows) == 80
    for r in rows:
        i = r["n"] - 1
        far = ((x - x[i]) ** 2).sum(axis=1)
        far[i] = far[1 - i % 2 :: 2] = np.inf
        assert sorted(far[np.array(r.near) - 1]) == sorted(far)[:4] and len(set(r.near)) == 4


@pytest.mark.parametrize("shape", ["even", "lumps", "one place"])
def test_neighbours_of_many_rows(spark, shape):
    """Nine in ten of the nearest at least, also where rows crowd or a third of them stand at one place."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 3))
    if shape == "lumps":
        x = x * 0.01 + rng.integers(0, 3, size=(6000, 1)) * [5.0, 90.0, 1.0]
    if shape == "one place":
        x[::3] = [0.5, 0.5, 0.5]
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(n=np.arange(6000), g=0))
    found = nearest(df, ["a", "b", "c"], 5, "n", "g", bucket=700).toPandas()
    assert len(found) == 6000
    hits = 0
    for n, near in zip(found.n, found.near):
        far = ((x - x[n]) ** 2).sum(axis=1)
        far[n] = np.inf
        assert n not in near and len(set(near)) == 5
        hits += (far[list(near)] <= np.partition(far, 4)[4] + 1e-15).sum()
    assert hits >= 0.9 * 5 * 6000


def test_synthetic_rows_lie_between_neighbours(spark):
    """Every one of them, between a row and one of its true five nearest of the same class and model."""
    df, pdf = outcome_rows(spark)
    parts = F.filter(F.array(F.lit(0), F.lit(1)), lambda m: (m == 0) | (F.col("id") % 3 != 0))
    rows = stage(weights.in_models(df.select(F.col("id").alias("_id"), "id", "label", "f1", "f2"), parts).drop("id"))
    made = weights.synthetic_rows(rows, ["f1", "f2"], 2).toPandas()
    for m, real in ((0, pdf), (1, pdf[pdf.id % 3 != 0])):
        counts = real.label.value_counts()
        mine = made[made._model == m]
        assert len(mine) == counts.max() - counts.min() and set(mine.label) == {counts.idxmin()}
        small = real[real.label == counts.idxmin()].set_index("id")[["f1", "f2"]]
        for r in mine.itertuples(index=False):
            start, end, at = small.loc[r[4]].to_numpy(), small.loc[r[5]].to_numpy(), np.array([r.f1, r.f2])
            far = ((small - start) ** 2).sum(axis=1).drop(r[4])
            assert r[5] in far.nsmallest(5, keep="all").index
            share = (at - start) @ (end - start) / ((end - start) @ (end - start))
            assert 0 <= share <= 1 and np.allclose(at, start + share * (end - start))
    out = weights.oversample(rows.select("_id", "label", "f1", "f2"), ["f1", "f2"]).toPandas()
    assert out.label.value_counts().nunique() == 1


def test_points_are_made_at_any_size(spark):
    """All rows stay, the classes are even, and points start at rows all over the smaller class."""
    df = spark.range(4000).selectExpr("id AS _id", "int(id % 8 = 0) AS label", "double(id % 61) AS f1", "double(id % 13) AS f2")
    out = weights.oversample(stage(df), ["f1", "f2"])
    assert {r.label: r["count"] for r in out.groupBy("label").count().collect()} == {0: 3500, 1: 3500}
    made = weights.synthetic_rows(weights.in_models(df, F.array(F.lit(0))), ["f1", "f2"], 1)
    assert made.select("_from").distinct().count() > 495 and made.where("_from = _to OR _from % 8 <> 0").count() == 0


@pytest.mark.parametrize("labels", [[1] * 9 + [0], [1] * 5, [0, 1] * 5])
def test_no_points_without_two_rows_or_a_gap(spark, labels):
    df = spark.createDataFrame([(i, y, float(i)) for i, y in enumerate(labels)], "_id long, label int, f1 double")
    assert weights.oversample(df, ["f1"]).count() == len(labels)


def test_weights_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(weights, "FOLDS", 2)
    df, _ = outcome_rows(spark)
    docs = [weights.derive_weights(df.repartition(n), dimensions=DIMS, key="id") for n in (1, 7)]
    assert docs[0]["weights"] == docs[1]["weights"] and docs[0]["macro_f1"] == docs[1]["macro_f1"]


def test_folds_are_fitted_without_a_thread_or_a_job_each(spark):
    """As many passes for five folds and both strategies as the slowest single fit takes."""
    df, pdf = outcome_rows(spark)
    folded = stage(weights.with_folds(df.withColumnRenamed("id", "_id"), 5))
    fits = weights.fold_fits(folded, ["f1", "f2", "f3"], 5, synthetic=True)
    assert {s: len(f) for s, f in fits.items()} == {weights.PLAIN: 6, weights.MIXED: 6}
    scores = weights.fold_scores(folded, ["f1", "f2", "f3"], fits).toPandas()
    assert sorted(map(tuple, scores[["strategy", "fold"]].to_numpy())) == sorted((s, f) for s in fits for f in range(5))
    for fold in range(5):
        one = weights.fit_balanced(folded.where(F.col("fold") != fold), ["f1", "f2", "f3"])
        told = weights.predict(one, folded.where(F.col("fold") == fold), ["f1", "f2", "f3"])
        want = weights.macro_f1(told).head()["f1"]
        got = scores[(scores.strategy == weights.PLAIN) & (scores.fold == fold)].f1.item()
        assert got == pytest.approx(want)


def test_shares():
    assert weights.shares_of({"a": -2.0, "b": 1.0, "c": 1.0}) == {"a": 0.5, "b": 0.25, "c": 0.25}
    assert weights.shares_of({"a": 0.0}) == FALLBACK_WEIGHTS


def test_class_balance(spark):
    row = weights.class_balance(dims.labelled_sites(spark)).head()
    assert (row.n, row.n_successful, row.n_blocked) == (39, 25, 14) and row.ratio == pytest.approx(25 / 14)
