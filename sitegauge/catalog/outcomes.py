"""Queries that hold scores against known outcomes."""

import uuid

from pyspark.sql import functions as F

from sitegauge.catalog import TAIL_SQL, query, r, rounded, table
from sitegauge.catalog.scores import _z
from sitegauge.functions.scalars import pad_code, viable
from sitegauge.operators import validation, weights
from sitegauge.operators.composite import score_locations
from sitegauge.operators.joins import left_chain
from sitegauge.operators.neighbours import nearest_distances
from sitegauge.plans import results
from sitegauge.session import shared_dir, small_table, stage
from sitegauge.sources import dimensions as dims, files


def _labelled(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "n_chars", "text", "source")
    return validation.match_outcomes(table(spark, folder, "labels"), docs, "doc_id")


_LABELLED_SQL = """
j AS (SELECT quality, toxic, n_chars, (n_chars / 25 >= 60)::INT AS predicted FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count_if(quality = 0 AND predicted = 0) AS c00, count_if(quality = 0 AND predicted = 1) AS c01,
             count_if(quality = 1 AND predicted = 0) AS c10, count_if(quality = 1 AND predicted = 1) AS c11 FROM j)
"""


@query(f"""WITH {_LABELLED_SQL} SELECT 0 AS label, 0 AS predicted, c00 AS n FROM c UNION ALL SELECT 0, 1, c01 FROM c
UNION ALL SELECT 1, 0, c10 FROM c UNION ALL SELECT 1, 1, c11 FROM c""")
def quality_confusion(spark, folder):
    df = _labelled(spark, folder).withColumn("predicted", viable(F.col("n_chars") / 25))
    return validation.confusion(df, "quality", "predicted")


@query(f"""WITH {_LABELLED_SQL},
k AS (SELECT c00 + c01 AS s0, c10 + c11 AS s1, c00 + c01 + c10 + c11 AS n, c00 / (c00 + c10) AS p0, c00 / (c00 + c01) AS r0,
             c11 / (c11 + c01) AS p1, c11 / (c10 + c11) AS r1, (c00 + c11) / (c00 + c01 + c10 + c11) AS acc FROM c),
f AS (SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1 FROM k)
SELECT '0' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, s0 AS support FROM f
UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), s1 FROM f
UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), n FROM f
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), n FROM f
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / n, 6), round((r0 * s0 + r1 * s1) / n, 6),
          round((f0 * s0 + f1 * s1) / n, 6), n FROM f""")
def quality_report(spark, folder):
    df = _labelled(spark, folder).withColumn("predicted", viable(F.col("n_chars") / 25))
    return rounded(validation.classification_report(df, "quality", "predicted"))


@query("""
WITH j AS (SELECT toxic, (rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0) AS k
           FROM labels JOIN documents USING (doc_id)),
s AS (SELECT sum(toxic) AS n1, count(*) - sum(toxic) AS n0, sum(k) FILTER (toxic = 1) AS r1 FROM j)
SELECT n1::BIGINT AS n_pos, n0::BIGINT AS n_neg, round(r1 - n1 * (n1 + 1) / 2, 4) AS u,
       round((r1 - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM s
""")
def length_auc_for_toxic(spark, folder):
    return rounded(validation.auc(_labelled(spark, folder), "n_chars", "toxic"))


@query("""
WITH j AS (SELECT toxic, n_chars FROM labels JOIN documents USING (doc_id)),
t AS (SELECT n_chars AS threshold, sum(toxic) AS p, sum(1 - toxic) AS n FROM j GROUP BY 1)
SELECT threshold::DOUBLE AS threshold, round(sum(n) OVER w / sum(n) OVER (), 6) AS fpr, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr
FROM t WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)
UNION ALL SELECT 'inf'::DOUBLE, 0, 0
""")
def length_roc_for_toxic(spark, folder):
    return rounded(validation.roc_points(_labelled(spark, folder), "n_chars", "toxic"))


@query("""
SELECT quality, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.5), 6) AS median
FROM labels JOIN documents USING (doc_id) GROUP BY quality
""")
def length_by_quality(spark, folder):
    return rounded(validation.class_centres(_labelled(spark, folder), "n_chars", "quality"))


@query(f"""
WITH j AS (SELECT quality, n_chars, (rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0) AS k
           FROM labels JOIN documents USING (doc_id)),
t AS (SELECT sum(c ** 3 - c) AS ties FROM (SELECT count(*) AS c FROM j GROUP BY n_chars)),
s AS (SELECT count_if(quality = 0) AS a, count_if(quality = 1) AS b, sum(k) FILTER (quality = 0) AS r FROM j),
u AS (SELECT a, b, r - a * (a + 1) / 2 AS u, a + b AS n, ties FROM s, t),
z AS (SELECT *, (u - a * b / 2.0 - 0.5) / sqrt(a * b / 12.0 * ((n + 1) - ties / (n * (n - 1.0)))) AS z FROM u),
{TAIL_SQL}
SELECT a AS n_greater, b AS n_other, u::DOUBLE AS u, round(CASE WHEN z >= 0 THEN q ELSE 1 - q END, 4) AS p_value,
       'normal' AS form FROM tail
""")
def length_test_by_quality(spark, folder):
    """One-sided rank test."""
    out = validation.mann_whitney(_labelled(spark, folder), "n_chars", "quality", greater=0)
    return small_table(spark, [tuple(out.values())], "n_greater long, n_other long, u double, p_value double, form string")


_HINTS = """SELECT state_hint FROM (SELECT 'https://www.reddit.com/r/' || upper(source) || '/comments/' || doc_id AS url FROM documents)
LEFT JOIN (SELECT 'src' || n_nationkey AS subreddit, n_name AS state_hint FROM nation
           JOIN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal < 0) ON n_nationkey = s_nationkey)
ON lower(nullif(regexp_extract(url, 'reddit\\.com/r/(\\w+)', 1), '')) = subreddit"""
_DIMENSIONS = {"size": ["n_chars", "n_words"], "shape": ["word_length"], "marks": ["digits", "breaks"], "none": ["gone"]}


def _text_features(spark, folder):
    """Plain measures of each labelled text; word length is unknown for odd-length texts."""
    words = F.size(F.split("text", " "))
    return _labelled(spark, folder).select(
        "doc_id", F.col("quality").alias("label"), "source", (F.col("n_chars") / 1000).alias("n_chars"),
        (words / 100).alias("n_words"),
        F.when(F.col("n_chars") % 2 == 0, F.col("n_chars") / words).alias("word_length"),
        (F.length("text") - F.length(F.regexp_replace("text", "[0-9]", ""))).alias("digits"),
        (F.size(F.split("text", "\n")) - 1).alias("breaks"))


_MATRIX_SQL = """
t AS (SELECT doc_id, quality AS label, n_chars / 1000 AS a, len(string_split(text, ' ')) / 100 AS b,
             CASE WHEN n_chars % 2 = 0 THEN n_chars / len(string_split(text, ' ')) END AS c,
             length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS d,
             len(string_split(text, chr(10))) - 1 AS e FROM labels JOIN documents USING (doc_id)),
m AS (SELECT doc_id, label, (a + b) / 2 AS size, coalesce(c, (SELECT quantile_cont(c, 0.5) FROM t)) AS shape,
             (d + e) / 2 AS marks, 50.0::DOUBLE AS "none" FROM t)
"""


def _solved(n, inner):
    """SQL giving the solution d0.. of the symmetric system h{i}_{j} (i >= j), g{i} of each row of ``inner``."""
    for t in range(n):
        left = range(t + 1, n)
        if left:
            inner = f"SELECT *, {', '.join(f'h{i}_{t} / h{t}_{t} AS f{i}_{t}' for i in left)} FROM ({inner})"
            new = [f"h{i}_{j} - f{i}_{t} * h{j}_{t} AS h{i}_{j}" for i in left for j in range(t + 1, i + 1)]
            new += [f"g{i} - f{i}_{t} * g{t} AS g{i}" for i in left]
            inner = f"SELECT * REPLACE ({', '.join(new)}) FROM ({inner})"
    for i in reversed(range(n)):
        known = "".join(f" - h{j}_{i} * d{j}" for j in range(i + 1, n))
        inner = f"SELECT *, (g{i}{known}) / h{i}_{i} AS d{i} FROM ({inner})"
    return inner


def _newton_sql(columns, steps=15):
    """CTEs ending in ``fit`` (g, b0..): Newton steps for the fits without fold 0 to 4 and, as the fifth, the one of all rows."""
    x = ["1", *[f'"{c}"' for c in columns]]
    n, b = len(x), ", ".join(f"b{j}" for j in range(len(x)))
    pairs = [(i, j) for i in range(n) for j in range(i + 1)]
    p = f"1 / (1 + exp(-({' + '.join(f'b{j} * {c}' for j, c in enumerate(x))})))"
    sums = [f"sum(w * (p - label) * {c}) + {f'b{j}' if j else 0} AS g{j}" for j, c in enumerate(x)]
    sums += [f"sum(w * p * (1 - p) * {x[i]} * {x[j]}) + {int(i == j > 0)} AS h{i}_{j}" for i, j in pairs]
    system = f"""SELECT i, g, {b}, {', '.join(sums)} FROM (SELECT *, {p} AS p FROM (
      SELECT it.*, dealt.*, CASE WHEN label = 1 THEN w1 ELSE w0 END AS w FROM it JOIN dealt ON fold <> g JOIN cw USING (g)
      WHERE i < {steps})) GROUP BY i, g, {b}"""
    return f"""
dealt AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) - 1) % 5 AS fold FROM m),
cw AS MATERIALIZED (SELECT g, count(*) / (2 * count_if(label = 0)) AS w0, count(*) / (2 * count_if(label = 1)) AS w1
  FROM dealt JOIN range(6) r(g) ON fold <> g GROUP BY g),
it AS (SELECT 0 AS i, g, {', '.join(f'0::DOUBLE AS b{j}' for j in range(n))} FROM cw
  UNION ALL SELECT i + 1, g, {', '.join(f'b{j} - d{j}' for j in range(n))} FROM ({_solved(n, system)})),
fit AS (SELECT g, {b} FROM it WHERE i = {steps}),
told AS (SELECT fold, label, ({' + '.join(f'b{j} * {c}' for j, c in enumerate(x))} > 0)::INT AS predicted FROM dealt JOIN fit ON fold = g),
cell AS (SELECT fold, count_if(label = 0 AND predicted = 0) AS c00, count_if(label = 0 AND predicted = 1) AS c01,
  count_if(label = 1 AND predicted = 0) AS c10, count_if(label = 1 AND predicted = 1) AS c11 FROM told GROUP BY fold),
f1 AS (SELECT fold, (coalesce(2 * c00 / nullif(2 * c00 + c01 + c10, 0), 0) + coalesce(2 * c11 / nullif(2 * c11 + c01 + c10, 0), 0)) / 2
  AS f1 FROM cell)
"""


_FIT_SQL = f"{_MATRIX_SQL}, {_newton_sql(_DIMENSIONS)}"
_LONG_FIT_SQL = f"""{_FIT_SQL},
shares AS (SELECT name, b, abs(b) / sum(abs(b)) OVER () AS share FROM (
  {' UNION ALL '.join(f"SELECT '{c}' AS name, b{j} AS b FROM fit WHERE g = 5" for j, c in enumerate(_DIMENSIONS, 1))})),
weighed AS (SELECT name, b, round(CASE WHEN abs(sum(w) OVER () - 1) > 0.01 THEN w / sum(w) OVER () ELSE w END, 3) AS weight
  FROM (SELECT *, round(share, 3) AS w FROM shares))
"""


@query(f"""WITH {_MATRIX_SQL} SELECT label, round(size, 6) AS size, round(shape, 6) AS shape,
round(marks, 6) AS marks, "none" FROM m""")
def training_matrix(spark, folder):
    matrix = weights.dimension_matrix(_text_features(spark, folder), _DIMENSIONS, "label", "doc_id")
    return rounded(matrix.drop("_id"))


@query("""
WITH c AS (SELECT count(*) AS n, count_if(quality = 1) AS a, count_if(quality = 0) AS b FROM labels)
SELECT n, a AS n_successful, b AS n_blocked, round(a * 100.0 / n, 6) AS successful_pct,
       round(b * 100.0 / n, 6) AS blocked_pct, round(greatest(a, b) / greatest(least(a, b), 1), 6) AS ratio FROM c
""")
def quality_balance(spark, folder):
    return rounded(weights.class_balance(table(spark, folder, "labels"), "quality"))


@query("""
WITH c AS (SELECT quality AS label, count(*) AS n FROM labels GROUP BY 1)
SELECT label, f::INT AS fold, (n // 5 + (f < n % 5)::INT)::BIGINT AS n FROM c, range(5) t(f)
""")
def fold_sizes(spark, folder):
    labels = table(spark, folder, "labels").select(F.col("quality").alias("label"), "doc_id")
    dealt = weights.with_folds(labels, 5, key="doc_id")
    return dealt.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT quality AS label, (SELECT max(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) AS n
FROM labels GROUP BY quality
""")
def balanced_by_synthesis(spark, folder):
    matrix = weights.dimension_matrix(_text_features(spark, folder), _DIMENSIONS, "label", "doc_id")
    return weights.oversample(matrix, list(_DIMENSIONS)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH RECURSIVE {_LONG_FIT_SQL}
SELECT name AS dimension, weight, round(b, 4) + 0 AS coefficient, CASE WHEN round(b, 4) > 0 THEN 'helps' ELSE 'hurts' END AS direction,
  (SELECT round(avg(f1), 3) FROM f1) AS macro_f1, (SELECT round(stddev_pop(f1), 3) FROM f1) AS macro_f1_spread,
  'balanced class weights' AS strategy FROM weighed
""")
def learned_weights(spark, folder):
    """Weights and coefficients of the balanced fit, and how well it predicts folds it has not seen."""
    document = weights.derive_weights(_text_features(spark, folder), "label", _DIMENSIONS, key="doc_id", synthesis=False)
    return weights.coefficient_report(spark, document).select(
        "dimension", "weight", (F.col("coefficient") + 0.0).alias("coefficient"), "direction", F.lit(document["macro_f1"]).alias("macro_f1"),
        F.lit(document["macro_f1_spread"]).alias("macro_f1_spread"), F.lit(document["strategy"]).alias("strategy"))


@query(f"""
WITH RECURSIVE {_FIT_SQL}
SELECT fold::INT AS fold, round(f1, 6) AS f1, round(avg(f1) OVER (), 6) AS mean_f1, round(stddev_pop(f1) OVER (), 6) AS spread FROM f1
""")
def macro_f1_per_fold(spark, folder):
    """Macro F1 of each fold under the fit of the other folds."""
    matrix = weights.dimension_matrix(_text_features(spark, folder), _DIMENSIONS, "label", "doc_id")
    folded = stage(weights.with_folds(matrix, weights.FOLDS), "folds")
    fits = weights.fold_fits(folded, list(_DIMENSIONS), weights.FOLDS, synthetic=False)
    scores = stage(weights.fold_scores(folded, list(_DIMENSIONS), fits), "f1").select("fold", "f1")
    both = scores.agg(F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("spread"))
    return rounded(scores.select("fold", "f1", both.select("mean_f1").scalar().alias("mean_f1"),
                                 both.select("spread").scalar().alias("spread")))


@query(f"""
WITH RECURSIVE {_FIT_SQL}
SELECT g::INT AS without_fold, {", ".join(f'round(b{j}, 5) + 0 AS "{c}"' for j, c in enumerate(["intercept", *_DIMENSIONS]))} FROM fit
""")
def coefficients_side_by_side(spark, folder):
    """The fits without each fold, and, as number 5, the one of all rows."""
    matrix = weights.dimension_matrix(_text_features(spark, folder), _DIMENSIONS, "label", "doc_id")
    folded = stage(weights.with_folds(matrix, weights.FOLDS), "folds")
    fits = weights.fold_fits(folded, list(_DIMENSIONS), weights.FOLDS, synthetic=False)[weights.PLAIN]
    rows = [(m, *[round(v, 5) + 0.0 for v in (f.intercept, *f.coefficients)]) for m, f in enumerate(fits)]
    return small_table(spark, rows, "without_fold int, intercept double, " + ", ".join(f"`{c}` double" for c in _DIMENSIONS))


@query("""
SELECT dimension, 0.0::DOUBLE AS gradient FROM (VALUES ('size'), ('shape'), ('marks'), ('none'), ('intercept')) t(dimension)
""")
def fitted_gradient(spark, folder):
    """At the fitted coefficients the penalised, balanced log-likelihood is flat in every dimension."""
    matrix = stage(weights.dimension_matrix(_text_features(spark, folder), _DIMENSIONS, "label", "doc_id"), "matrix")
    names = list(_DIMENSIONS)
    model = weights.fit_balanced(matrix, names)
    n0, n1 = matrix.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).head()
    line = F.lit(float(model.intercept))
    for name, c in zip(names, model.coefficients):
        line = line + F.col(name) * float(c)
    miss = (1 / (1 + F.exp(-line)) - F.col("label")) * F.when(F.col("label") == 1, (n0 + n1) / (2 * n1)).otherwise((n0 + n1) / (2 * n0))
    scale = {name: max(1.0, matrix.agg(F.max(F.abs(F.col(name)))).head()[0]) for name in names} | {"intercept": 1.0}
    sums = matrix.agg(*[F.sum(miss * (F.col(n) if n != "intercept" else F.lit(1.0))).alias(n) for n in scale]).head()
    penalty = dict(zip(names, map(float, model.coefficients))) | {"intercept": 0.0}
    rows = [(n, abs(round((sums[n] + penalty[n]) / (n0 + n1) / scale[n], 3))) for n in scale]
    return small_table(spark, rows, "dimension string, gradient double")


def _known_mean(*names):
    return f"({' + '.join(f'coalesce({n}, 0)' for n in names)}) / nullif({' + '.join(f'({n} IS NOT NULL)::INT' for n in names)}, 0)"


@query(f"""
WITH RECURSIVE {_LONG_FIT_SQL}, f AS (SELECT * FROM t),
n AS (SELECT doc_id, label, {_z('a')} AS za, {_z('b')} AS zb, CASE WHEN c IS NOT NULL THEN {_z('c')} END AS zc, {_z('d')} AS zd, {_z('e')} AS ze FROM f),
scored AS (SELECT doc_id, label, {_known_mean('za', 'zb')} AS size, zc AS shape, {_known_mean('zd', 'ze')} AS marks FROM n),
psi AS (SELECT doc_id, label, marks, size * (SELECT weight FROM weighed WHERE name = 'size') + shape * (SELECT weight FROM weighed WHERE name = 'shape')
  + marks * (SELECT weight FROM weighed WHERE name = 'marks') + 50 * (SELECT weight FROM weighed WHERE name = 'none') AS psi FROM scored),
kp AS (SELECT label, rank() OVER (ORDER BY psi) + (count(*) OVER (PARTITION BY psi) - 1) / 2.0 AS k FROM psi WHERE psi IS NOT NULL),
auc AS (SELECT (sum(k) FILTER (label = 1) - count_if(label = 1) * (count_if(label = 1) + 1) / 2.0) / (count_if(label = 1) * count_if(label = 0)) AS auc FROM kp),
km AS (SELECT label, marks, rank() OVER (ORDER BY marks) + (count(*) OVER (PARTITION BY marks) - 1) / 2.0 AS k FROM psi WHERE marks IS NOT NULL),
ties AS (SELECT sum(c ** 3 - c) AS ties FROM (SELECT count(*) AS c FROM km GROUP BY marks)),
u AS (SELECT count_if(label = 0) AS x, count_if(label = 1) AS y, sum(k) FILTER (label = 0) AS ranks FROM km),
z AS (SELECT (ranks - x * (x + 1) / 2 - x * y / 2.0 - 0.5) / sqrt(x * y / 12.0 * ((x + y + 1) - ties / ((x + y) * (x + y - 1.0)))) AS z FROM u, ties),
{TAIL_SQL},
h AS (SELECT count(state_hint) * 100.0 / count(*) AS rate FROM ({_HINTS})),
c AS (SELECT count(*) AS all_rows, count_if(label = 1) AS built, count_if(label = 0) AS stopped FROM m)
SELECT '1.0.0' AS model_version, all_rows AS n_validation_sites, built AS successful, stopped AS blocked,
  round((SELECT auc FROM auc), 3) AS auc, (SELECT round(avg(f1), 3) FROM f1) AS macro_f1,
  (SELECT round(CASE WHEN z >= 0 THEN q ELSE 1 - q END, 4) FROM tail) AS social_test_p_value, round((SELECT rate FROM h), 6) AS geocoding_match_rate,
  'balanced class weights' AS imbalance_strategy, (SELECT string_agg(name || '=' || round(weight, 3), ',' ORDER BY name) FROM weighed) AS weights,
  10 AS n_pairs FROM c
""")
def validation_summary(spark, folder):
    """Everything known about the model, from weights learnt, scores, sensitivity and match rate, kept and read back."""
    from sitegauge.catalog.texts import hint_match_rate

    rows = stage(_text_features(spark, folder), "text-features")
    document = weights.derive_weights(rows, "label", _DIMENSIONS, key="doc_id", synthesis=False)
    scored = stage(score_locations(rows.drop("label"), document["weights"], _DIMENSIONS, [], "doc_id", ["source"], ranked=False), "scored")
    scored = scored.withColumn("social_score", F.col("marks_score"))
    metrics = validation.validate_scores(scored, rows.select("doc_id", "label"), "doc_id")
    metrics["p_value"] = validation.mann_whitney(
        scored.join(rows.select("doc_id", "label"), "doc_id"), "social_score", "label", greater=0, form="normal")["p_value"]
    pairs, _ = validation.sensitivity(rows.drop("label"), document["weights"], _DIMENSIONS, [], "doc_id")
    rate = hint_match_rate(spark, folder).head()["rate"]
    path = f"{shared_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    files.write_table(results.validation_summary(spark, document, metrics, rate, pairs, "1.0.0"), f"{path}/validation_summary")
    row = results.stored_summary(spark, path)
    listed = F.array_sort(F.transform(F.map_entries("weights"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return row.select(
        "model_version", "n_validation_sites", "class_balance.successful", "class_balance.blocked", "auc", "macro_f1",
        r("social_test_p_value", 4).alias("social_test_p_value"), r("geocoding_match_rate").alias("geocoding_match_rate"),
        "imbalance_strategy", F.array_join(listed, ",").alias("weights"), F.size("sensitivity").alias("n_pairs"))


@query("""
SELECT doc_id, quality, toxic, n_chars, source FROM labels JOIN documents USING (doc_id)
""")
def outcomes_with_scores(spark, folder):
    return _labelled(spark, folder).drop("text")


@query("""
SELECT topic_id, label, top_words FROM (
  SELECT n_nationkey::INT AS topic_id, coalesce(r_name, '') AS label, n_name AS top_words
  FROM nation LEFT JOIN (SELECT region.* FROM region JOIN (SELECT DISTINCT n_regionkey AS k FROM nation
    JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 9900) ON r_regionkey = k) ON n_regionkey = r_regionkey)
""")
def topic_list(spark, folder):
    # Regions without a rich supplier stay unlabelled.
    rich = table(spark, folder, "supplier").where("s_acctbal > 9900").join(
        table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("r_regionkey"))
    regions = table(spark, folder, "region").join(rich, "r_regionkey", "left_semi")
    summary = table(spark, folder, "nation").join(
        regions, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(
        F.col("n_nationkey").alias("topic_id"), F.col("r_name").alias("label"),
        F.col("n_name").alias("top_words"))
    return results.topic_list(summary)


@query(f"""
WITH {_MATRIX_SQL}, c AS (SELECT label, count(*) AS n FROM m GROUP BY 1)
SELECT label, max(n) OVER () AS n, max(n) OVER () - n AS n_made, n AS n_real, true AS on_the_way, true AS same_class FROM c
""")
def synthetic_points(spark, folder):
    """Every made point lies on the way between the two rows of its class that it names."""
    names = list(_DIMENSIONS)
    matrix = stage(weights.dimension_matrix(_text_features(spark, folder), _DIMENSIONS, "label", "doc_id"), "matrix")
    made = weights.synthetic_rows(weights.in_models(matrix, F.array(F.lit(0))), names, 1)

    def end(name):
        return matrix.select(F.col("_id").alias(name), F.col("label").alias(f"{name}_label"),
                             *[F.col(c).alias(f"{name}_{c}") for c in names])

    both = made.join(end("_from"), "_from").join(end("_to"), "_to")
    # How far along: the same share of the way in every dimension.
    way = F.lit(0.0)
    for c in names:
        way = way + (F.col(f"_to_{c}") - F.col(f"_from_{c}")) * (F.col(f"_to_{c}") - F.col(f"_from_{c}"))
    done = F.lit(0.0)
    for c in names:
        done = done + (F.col(c) - F.col(f"_from_{c}")) * (F.col(f"_to_{c}") - F.col(f"_from_{c}"))
    both = both.withColumn("share", F.when(way > 0, done / F.greatest(way, F.lit(1e-300))).otherwise(0.0))
    straight = F.col("share").between(-1e-9, 1 + 1e-9)
    for c in names:
        at = F.col(f"_from_{c}") + F.col("share") * (F.col(f"_to_{c}") - F.col(f"_from_{c}"))
        straight = straight & (F.abs(F.col(c) - at) <= 1e-6)
    same = (F.col("_from_label") == F.col("label")) & (F.col("_to_label") == F.col("label")) & (F.col("_from") != F.col("_to"))
    checked = both.groupBy("label").agg(F.count(F.lit(1)).alias("n_made"), F.every(straight).alias("on_the_way"),
                                        F.every(same).alias("same_class"))
    real = matrix.groupBy("label").agg(F.count(F.lit(1)).alias("n_real"))
    joined = real.join(checked, "label", "left").withColumn("n_made", F.coalesce("n_made", F.lit(0)))
    return joined.select("label", (F.col("n_real") + F.col("n_made")).alias("n"), "n_made", "n_real",
                         F.coalesce("on_the_way", F.lit(True)).alias("on_the_way"), F.coalesce("same_class", F.lit(True)).alias("same_class"))


@query(f"""
WITH {_MATRIX_SQL}, s AS (SELECT label AS small FROM m GROUP BY label ORDER BY count(*), label LIMIT 1),
p AS (SELECT doc_id, size, shape, marks FROM m, s WHERE label = small),
d AS (SELECT a.doc_id, (a.size - b.size) ** 2 + (a.shape - b.shape) ** 2 + (a.marks - b.marks) ** 2 AS d FROM p a JOIN p b ON a.doc_id <> b.doc_id)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY d)::INT AS place, round(sqrt(d), 6) AS distance FROM d
QUALIFY place <= 5
""")
def nearest_in_the_smaller_class(spark, folder):
    """Distances to the five nearest rows of the smaller class."""
    names = list(_DIMENSIONS)
    matrix = stage(weights.dimension_matrix(_text_features(spark, folder), _DIMENSIONS, "label", "doc_id"), "matrix")
    sizes = {row["label"]: row["n"] for row in matrix.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    small = min(sizes, key=lambda c: (sizes[c], c))
    rows = stage(matrix.where(F.col("label") == small).select("_id", *names), "smaller-class")
    near = nearest_distances(rows, names, 5)
    return rows.join(near, names).select(F.col("_id").alias("doc_id"), F.posexplode("near").alias("at", "d")).select(
        "doc_id", (F.col("at") + 1).alias("place"), r("d").alias("distance"))


def _sites() -> str:
    from sitegauge.sources.fixed_values import BLOCKED_SITES, BUILT_SITES

    def text(v):
        return "NULL" if not v else "'" + str(v).replace("'", "''") + "'"

    rows = [f"({text(r[0])}, {text(r[1])}, {label})" for label, sites in ((0, BLOCKED_SITES), (1, BUILT_SITES)) for r in sites]
    return ", ".join(rows)


def _county_values() -> str:
    from sitegauge.sources.fixed_values import CENTROIDS, COUNTY_POPULATIONS

    known = {c[0]: (c[1], c[2]) for c in CENTROIDS}
    return ", ".join(f"('{code}', {people}, {known[code][0] if code in known else 'NULL'}::DOUBLE)" for code, people in COUNTY_POPULATIONS)


@query(f"""
WITH s(name, county_fips, label) AS (VALUES {_sites()}), c(county_fips, population, lat) AS (VALUES {_county_values()}),
o AS (SELECT lpad(o_orderkey::VARCHAR, 5, '0') AS county_fips, count(*) AS orders FROM orders WHERE o_orderkey < 100000 GROUP BY 1)
SELECT name, s.county_fips, label, population::BIGINT AS population, round(lat, 6) AS lat, orders FROM s LEFT JOIN c USING (county_fips) LEFT JOIN o USING (county_fips)
WHERE s.county_fips IS NOT NULL
""")
def labelled_sites_with_counties(spark, folder):
    """The labelled sites that have a county, with its population and place, and the orders whose number is its code."""
    orders = table(spark, folder, "orders").where("o_orderkey < 100000").groupBy(
        pad_code("o_orderkey").alias("county_fips")).agg(F.count(F.lit(1)).alias("orders"))
    sites = dims.labelled_sites(spark).select("name", "county_fips", "label")
    return left_chain(sites, "county_fips", dims.populations(spark), dims.centroids(spark).select("county_fips", r("lat").alias("lat")), orders)
