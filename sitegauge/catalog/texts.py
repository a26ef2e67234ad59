"""Text, place, sentiment, resistance and topic queries over the documents."""

import uuid

from pyspark.sql import functions as F

from sitegauge.catalog import documents, query, r, rounded, table
from sitegauge.functions.scalars import with_costly
from sitegauge.functions.text import clean_text
from sitegauge.operators import lda, places, profile, resistance, sentiment, topics
from sitegauge.operators.phrases import phrase_hits
from sitegauge.session import dealt, shared_dir, small_table, stage

_SP = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"


# The cleaning patterns, in DuckDB's syntax.
def _clean_sql(c):
    for pattern, to in ((rf"https?://[^{_SP[1:-1]}]+", ""), (r"!\[.*?\]\(.*?\)", ""),
                        (r"\[([^\]]+)\]\(.*?\)", r"\1"), (r"[#*_~`>]", ""),
                        (r"/?(u|r)/[\p{L}\p{N}_]+", ""), (rf"{_SP}+", " ")):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return f"trim({c})"


_MARKED_SQL = """text || ' [see ' || source || '](https://example.org/' || doc_id || ') ![pic](a.png) by /u/'
                 || source || ' in **r/' || lang || '** > [plain](note)'"""


@query(f"""
WITH c AS (SELECT doc_id, {_clean_sql(_MARKED_SQL)} AS clean_text FROM documents)
SELECT doc_id, md5(clean_text) AS digest, length(clean_text) AS n FROM c WHERE length(clean_text) > 50
""")
def cleaned_documents(spark, folder):
    content = F.concat(
        F.col("text"), F.lit(" [see "), F.col("source"), F.lit("](https://example.org/"), F.col("doc_id"),
        F.lit(") ![pic](a.png) by /u/"), F.col("source"), F.lit(" in **r/"), F.col("lang"),
        F.lit("** > [plain](note)"))
    docs = with_costly(documents(spark, folder), "clean_text", clean_text(content))
    docs = docs.filter(F.length("clean_text") > places.MIN_CLEAN_CHARS)
    return docs.select("doc_id", F.md5("clean_text").alias("digest"),
                       F.length("clean_text").cast("long").alias("n"))


@query(f"""
WITH c AS (SELECT conv_id, turn, {_clean_sql('text')} AS clean_text FROM conversations)
SELECT conv_id, turn, md5(clean_text) AS digest FROM c WHERE length(clean_text) > 50
""")
def cleaned_conversations(spark, folder):
    turns = with_costly(table(spark, folder, "conversations"), "clean_text", clean_text("text"))
    return turns.filter(F.length("clean_text") > places.MIN_CLEAN_CHARS).select(
        "conv_id", "turn", F.md5("clean_text").alias("digest"))


_HINT_SQL = """
p AS (SELECT doc_id, 'https://www.reddit.com/r/' || upper(source) || '/comments/' || doc_id AS url FROM documents),
f AS (SELECT 'src' || n_nationkey AS subreddit, n_name AS state_hint FROM nation
      JOIN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal < 0) ON n_nationkey = s_nationkey),
h AS (SELECT doc_id, state_hint FROM p LEFT JOIN f
      ON lower(nullif(regexp_extract(url, 'reddit\\.com/r/(\\w+)', 1), '')) = subreddit)
"""


def _hinted(spark, folder):
    posts = table(spark, folder, "documents").select("doc_id", F.concat(
        F.lit("https://www.reddit.com/r/"), F.upper("source"), F.lit("/comments/"), "doc_id").alias("url"))
    # Nations without a supplier in debt have no forum.
    in_debt = table(spark, folder, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey"))
    forums = table(spark, folder, "nation").join(in_debt, "n_nationkey", "left_semi").select(
        F.concat(F.lit("src"), "n_nationkey").alias("subreddit"), F.col("n_name").alias("state_hint"))
    return places.with_state_hint(posts, forums=forums)


@query(f"WITH {_HINT_SQL} SELECT doc_id, state_hint FROM h")
def state_hints(spark, folder):
    return _hinted(spark, folder).select("doc_id", "state_hint")


@query(f"""
WITH {_HINT_SQL}, m AS (SELECT count(*) AS total, count(state_hint) AS matched FROM h)
SELECT total, matched, total - matched AS unmatched, round(matched * 100.0 / total, 6) AS rate,
       matched * 100.0 / total < 60 AS below_alarm FROM m
""")
def hint_match_rate(spark, folder):
    return rounded(profile.match_rate(_hinted(spark, folder), "state_hint"))


# Frequent words of the documents stand in for place names and lexicon terms.
_PLACES = {
    "the": ["51059", "48113"], "of the": ["48113", "48439"], "and the": ["41065"], "der": ["04013"],
    "die": ["51107", "51153"], "de": ["48029", "51013"], "la": ["13121"], "us": ["53033"],
    "by": ["51013", "17031"], "this": ["48085", "32003"],
}
_STATES = {"VA": "51", "TX": "48"}
_HINT_OF_LANG = {"en": "VA", "fr": "TX", "es": "ZZ"}


def _hits_sql(terms, columns, negations=(), source="documents", key="doc_id"):
    """Longest listed phrase at each position, as CTEs ending in ``best``."""
    listed = ", ".join(f"({', '.join(map(repr, t))})" for t in terms)
    negated = " OR ".join(
        f"coalesce(p{i} IN ({', '.join(map(repr, negations))}) OR ends_with(p{i}, 'n''t'), false)"
        for i in (1, 2, 3)) if negations else "false"
    keys = key.split(", ")
    part = ", ".join(keys)
    return f"""
terms({columns}) AS (VALUES {listed}),
toks AS (SELECT {part}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_'']+') AS w FROM {source}),
tok AS (SELECT {part}, unnest(w) AS t, generate_subscripts(w, 1) AS pos FROM toks),
win AS (SELECT {part}, pos, t, lead(t) OVER x AS t2, lag(t, 1) OVER x AS p1, lag(t, 2) OVER x AS p2,
               lag(t, 3) OVER x AS p3 FROM tok WINDOW x AS (PARTITION BY {part} ORDER BY pos)),
cand AS (SELECT {part}, pos, 1 AS len, t AS gram, {negated} AS negated FROM win
         UNION ALL SELECT {part}, pos, 2, t || ' ' || t2, {negated} FROM win WHERE t2 IS NOT NULL),
best AS (SELECT * FROM cand JOIN terms ON gram = term
         QUALIFY row_number() OVER (PARTITION BY {part}, pos ORDER BY len DESC) = 1),
kept AS (SELECT * FROM best QUALIFY coalesce(max(pos + len) OVER (PARTITION BY {part} ORDER BY pos
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < pos + len)
"""


_MENTIONS_SQL = _hits_sql([(p,) for p in _PLACES], "term") + """,
mentions AS (SELECT doc_id, term AS place, min(pos)::INT AS pos FROM kept
             WHERE length(term) >= 2 AND term NOT IN ('us', 'usa', 'america') GROUP BY 1, 2)
"""


def _names(spark):
    return small_table(spark, [(p,) for p in _PLACES], "place string")


def _candidates(spark):
    return small_table(spark, list(_PLACES.items()), "place string, candidates array<string>")


def _states(spark):
    return small_table(spark, list(_STATES.items()), "state string, state_fips string")


@query(f"WITH {_MENTIONS_SQL} SELECT doc_id, pos, place FROM mentions")
def place_mentions(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    return places.place_mentions(docs, "doc_id", "text", _names(spark))


_MATCH_SQL = f"""{_MENTIONS_SQL},
cands(place, c) AS (VALUES {', '.join(f"('{p}', {c!r})" for p, c in _PLACES.items())}),
hints(lang, hint, prefix) AS (VALUES ('en', 'VA', '51'), ('fr', 'TX', '48'), ('es', 'ZZ', NULL)),
resolved AS (SELECT m.doc_id, m.pos, m.place,
    CASE WHEN len(c) = 1 THEN c[1] WHEN hint IS NOT NULL THEN
         list_filter(c, lambda x: starts_with(x, coalesce(prefix, '?')))[1] ELSE c[1] END AS fips
    FROM mentions m JOIN documents d USING (doc_id) JOIN cands USING (place) LEFT JOIN hints USING (lang)),
matched AS (SELECT doc_id, string_agg(place, ',' ORDER BY pos) AS raw_locations,
                   arg_min(fips, pos) FILTER (fips IS NOT NULL) AS matched_county_fips
            FROM resolved GROUP BY doc_id)
"""


def _matched(spark, folder):
    hint = F.create_map(*[F.lit(x) for kv in _HINT_OF_LANG.items() for x in kv])[F.col("lang")]
    posts = documents(spark, folder).select("doc_id", "source", "text", hint.alias("state_hint"))
    states = _states(spark)
    mentions = places.place_mentions(posts, "doc_id", "text", _names(spark)).join(
        posts.select("doc_id", "state_hint"), "doc_id")
    return posts, places.resolve_places(mentions, _candidates(spark), "place", "state_hint", "fips", states)


@query(f"WITH {_MATCH_SQL} SELECT doc_id, pos, place, fips FROM resolved")
def resolved_mentions(spark, folder):
    return _matched(spark, folder)[1].select("doc_id", "pos", "place", "fips")


@query(f"""WITH {_MATCH_SQL}, m AS (SELECT count(*) AS total, count(fips) AS matched FROM resolved)
SELECT total, matched, total - matched AS unmatched, round(matched * 100.0 / total, 6) AS rate,
       matched * 100.0 / total < 60 AS below_alarm FROM m""")
def mention_resolution_rate(spark, folder):
    return rounded(profile.match_rate(_matched(spark, folder)[1], "fips"))


@query(f"""WITH {_MATCH_SQL} SELECT d.doc_id, coalesce(raw_locations, '') AS raw_locations,
matched_county_fips FROM documents d LEFT JOIN matched USING (doc_id)""")
def documents_matched_to_counties(spark, folder):
    hint = F.create_map(*[F.lit(x) for kv in _HINT_OF_LANG.items() for x in kv])[F.col("lang")]
    posts = documents(spark, folder).select("doc_id", "text", hint.alias("state_hint"))
    found = places.match_posts(posts, _names(spark), _candidates(spark), "doc_id", "text")
    return found.select("doc_id", F.array_join("raw_locations", ",").alias("raw_locations"),
                        "matched_county_fips")


@query(f"""WITH {_MATCH_SQL}, k AS (SELECT place || '|' || coalesce(hint, '') AS key, max(fips) AS fips
FROM resolved JOIN documents USING (doc_id) LEFT JOIN hints USING (lang) GROUP BY 1)
SELECT key, fips FROM k""")
def lookup_cache(spark, folder):
    from sitegauge.operators.joins import cache_rows

    return cache_rows(_matched(spark, folder)[1], "place", "state_hint", "fips")


@query(f"""WITH {_MATCH_SQL},
cache(key, fips) AS (VALUES ('the|VA', '99999'), ('by|TX', NULL), ('la|', NULL))
SELECT r.doc_id, r.place, CASE WHEN k.key IS NOT NULL THEN k.fips ELSE r.fips END AS fips
FROM resolved r JOIN documents USING (doc_id) LEFT JOIN hints USING (lang)
LEFT JOIN cache k ON k.key = r.place || '|' || coalesce(hint, '')""")
def mentions_resolved_with_cache(spark, folder):
    posts, resolved = _matched(spark, folder)
    cache = small_table(spark, [("the|VA", "99999"), ("by|TX", None), ("la|", None)], "key string, fips string")
    again = places.resolve_places(resolved.drop("fips"), _candidates(spark), "place", "state_hint", "fips",
                                  _states(spark), cache)
    return again.select("doc_id", "place", "fips")


@query(f"""WITH {_MATCH_SQL}, k AS (SELECT place || '|' || coalesce(hint, '') AS key, max(fips) AS fips, min((lang <> 'en')::INT) + 1 AS batch
FROM resolved JOIN documents USING (doc_id) LEFT JOIN hints USING (lang) GROUP BY 1)
SELECT key, fips, batch::INT AS batch, (SELECT count(*) FROM k WHERE batch = 2) AS asked_in_second_run FROM k""")
def lookups_kept_over_runs(spark, folder):
    """The first run meets the English texts, the second all; it resolves only what the first one did not know."""
    from sitegauge.sources.cache import LookupCache

    hint = F.create_map(*[F.lit(x) for kv in _HINT_OF_LANG.items() for x in kv])[F.col("lang")]
    posts = documents(spark, folder).select("doc_id", "text", "lang", hint.alias("state_hint"))
    mentions = stage(places.place_mentions(posts, "doc_id", "text", _names(spark), ["state_hint", "lang"]), "mentions")
    cache = LookupCache(spark, f"{shared_dir(spark).rstrip('/')}/lookups-{uuid.uuid4().hex}")
    for met in (mentions.where("lang = 'en'"), mentions):
        pairs = met.select("place", "state_hint").distinct()
        places.resolve_pairs(pairs, _candidates(spark), cache, out="fips", states=_states(spark))
    asked = cache.history().where("batch = 2").agg(F.count(F.lit(1)).alias("n"))
    return cache.entries().withColumn("asked_in_second_run", asked.scalar())


@query("""
WITH names AS (SELECT lower(n_name) || ' county' AS county_name, r_name AS state,
                      lpad(n_nationkey::VARCHAR, 5, '0') AS fips, n_nationkey AS pos
               FROM nation JOIN region ON n_regionkey = r_regionkey
               UNION ALL SELECT lower(n_name) || ' county', 'ELSEWHERE', lpad((n_nationkey + 500)::VARCHAR, 5, '0'),
                      n_nationkey + 100 FROM nation),
q AS (SELECT c_custkey, n_name AS county, CASE c_mktsegment WHEN 'BUILDING' THEN r_name
             WHEN 'MACHINERY' THEN 'elsewhere' WHEN 'HOUSEHOLD' THEN 'NONE' END AS state_hint
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey, arg_min(fips, pos) FILTER (state_hint IS NULL OR upper(state_hint) = state) AS county_fips
FROM q JOIN names ON county_name = lower(county) || ' county' GROUP BY c_custkey
""")
def counties_by_name(spark, folder):
    both = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))

    def listed(state, shift, move):
        return both.select(
            F.concat(F.lower("n_name"), F.lit(" county")).alias("county_name"), state.alias("state"),
            F.lpad((F.col("n_nationkey") + shift).cast("string"), 5, "0").alias("county_fips"),
            (F.col("n_nationkey") + move).alias("pos"))

    names = listed(F.col("r_name"), 0, 0).unionByName(listed(F.lit("ELSEWHERE"), 500, 100))
    hint = (F.when(F.col("c_mktsegment") == "BUILDING", F.col("r_name"))
            .when(F.col("c_mktsegment") == "MACHINERY", "elsewhere")
            .when(F.col("c_mktsegment") == "HOUSEHOLD", "NONE"))
    asked = table(spark, folder, "customer").join(both, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("n_name").alias("county"), hint.alias("state_hint"))
    return places.county_by_name(asked, names).select("c_custkey", "county_fips")


_LEXICON = {"the": 0.5, "of the": -1.5, "that": -0.8, "was": 0.4, "der": 1.0, "die": -1.2, "que": 0.9, "with": -2.0}
_NEGATIONS = ["is", "not", "en"]
_SCORE = """round(s / sqrt(s * s + 15), 4)"""
_TOTAL = """coalesce(sum(CASE WHEN negated THEN valence * -0.74 ELSE valence END), 0)::DOUBLE AS s"""
_SENTIMENT_SQL = _hits_sql(list(_LEXICON.items()), "term, valence", _NEGATIONS) + f""",
sums AS (SELECT d.doc_id, {_TOTAL} FROM documents d LEFT JOIN kept USING (doc_id) GROUP BY 1),
scored AS (SELECT doc_id, {_SCORE} AS sentiment FROM sums)
"""


def _lexicon(spark):
    return small_table(spark, list(_LEXICON.items()), "term string, valence double")


def _scored_documents(spark, folder):
    docs = documents(spark, folder)
    return sentiment.with_sentiment(docs, "doc_id", "text", _lexicon(spark), negations=_NEGATIONS)


@query(f"WITH {_SENTIMENT_SQL} SELECT doc_id, sentiment FROM scored")
def document_sentiment(spark, folder):
    return _scored_documents(spark, folder).select("doc_id", "sentiment")


@query("WITH " + _hits_sql(list(_LEXICON.items()), "term, valence", _NEGATIONS, "conversations", "conv_id, turn") + f""",
sums AS (SELECT c.conv_id, c.turn, {_TOTAL} FROM conversations c LEFT JOIN kept USING (conv_id, turn) GROUP BY 1, 2)
SELECT conv_id, turn, {_SCORE} AS sentiment FROM sums""")
def conversation_sentiment_by_join(spark, folder):
    """Texts known by a key of two columns."""
    turns = table(spark, folder, "conversations").withColumn("id", F.struct("conv_id", "turn"))
    scored = sentiment.with_sentiment(turns, "id", "text", _lexicon(spark), negations=_NEGATIONS)
    return scored.select("conv_id", "turn", "sentiment")


@query("WITH " + _hits_sql(list(_LEXICON.items()), "term, valence") + """
SELECT term, count(*) AS n FROM best GROUP BY term""")
def lexicon_hits(spark, folder):
    hits = phrase_hits(documents(spark, folder), "doc_id", "text", _lexicon(spark), "term")
    return hits.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


_RESISTANCE_SQL = f"""{_SENTIMENT_SQL},
posts AS (SELECT source, sentiment, -sentiment * (n_chars / (n_chars + 1000.0) + 0.1) AS signal
          FROM scored JOIN documents USING (doc_id)),
agg AS (SELECT source, avg(signal) AS raw_resistance_mean, max(signal) AS raw_resistance_max,
               count(signal) AS post_count, stddev_samp(signal) AS std_resistance,
               avg(sentiment) AS avg_sentiment,
               avg((sentiment < -0.05)::INT) * 100 AS negative_pct FROM posts GROUP BY source),
pops AS (SELECT 'src' || s_nationkey AS county_fips, sum(s_suppkey) AS population FROM supplier GROUP BY 1),
joined AS (SELECT *, CASE WHEN population IS NOT NULL THEN greatest(population, 1) END AS people
           FROM agg LEFT JOIN pops ON source = county_fips),
corrected AS (SELECT *, post_count / people AS posts_per_capita,
    ln(1 + post_count / people * 100000) AS intensity_factor,
    least(ln(1 + post_count) / ln(51), 1.5) AS volume_factor FROM joined),
rawed AS (SELECT *, raw_resistance_mean * intensity_factor * volume_factor AS raw FROM corrected),
res AS (SELECT *, CASE WHEN abs((SELECT skewness(raw) FROM rawed)) > 2 THEN
    CASE WHEN raw IS NOT NULL THEN rank() OVER (ORDER BY raw) * 100.0 / count(raw) OVER () END
    WHEN raw IS NOT NULL THEN (least(greatest((raw - avg(raw) OVER ()) / stddev_pop(raw) OVER (), -3), 3) + 3) / 6 * 100 END
    AS social_resistance_score FROM rawed)
"""


def _resistance(spark, folder):
    posts = _scored_documents(spark, folder).select(
        F.col("source").alias("matched_county_fips"), "sentiment",
        (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("topic_0_weight"),
        F.lit(0.1).alias("topic_1_weight"), F.lit(0.7).alias("topic_5_weight"))
    # Nations without a supplier have no population.
    pops = table(spark, folder, "supplier").groupBy(F.concat(F.lit("src"), "s_nationkey").alias("county_fips")).agg(
        F.sum("s_suppkey").alias("population"))
    return resistance.resistance_scores(posts, pops)


@query(f"""WITH {_RESISTANCE_SQL} SELECT source AS matched_county_fips, county_fips,
population::BIGINT AS population, post_count,
""" + ", ".join(f"round({c}, 6) AS {c}" for c in (
    "raw_resistance_mean", "raw_resistance_max", "std_resistance", "avg_sentiment", "negative_pct",
    "posts_per_capita", "intensity_factor", "volume_factor", "social_resistance_score"))
    + ", round(raw, 6) AS social_resistance_score_raw FROM res")
def resistance_by_source(spark, folder):
    return rounded(_resistance(spark, folder))


@query(f"""WITH {_RESISTANCE_SQL}, k AS (SELECT source, rank() OVER (ORDER BY raw_resistance_mean DESC) AS a,
  CASE WHEN social_resistance_score IS NOT NULL THEN
  rank() OVER (ORDER BY social_resistance_score DESC NULLS LAST) END AS b FROM res),
m AS (SELECT source, a - b AS change FROM k WHERE b IS NOT NULL)
SELECT 'top_raw' AS part, source FROM (SELECT source FROM res ORDER BY raw_resistance_mean DESC LIMIT 5)
UNION ALL SELECT 'top_corrected', source FROM
  (SELECT source FROM res ORDER BY social_resistance_score DESC NULLS LAST LIMIT 5)
UNION ALL SELECT 'movers', source FROM (SELECT * FROM m QUALIFY rank() OVER (ORDER BY change DESC) <= 5)
""")
def correction_report(spark, folder):
    scores = stage(_resistance(spark, folder), "resistance")
    report = resistance.correction_report(scores)
    parts = [report[p].select(F.lit(p).alias("part"), F.col("matched_county_fips").alias("source"))
             for p in ("top_raw", "top_corrected", "movers")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_STOPS = ["the", "of", "and", "de", "in", "to", "la", "en", "a", "is"]
_TERMS_SQL = f"""
tk AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'),
       lambda x: regexp_full_match(x, '[a-z][a-z]+') AND x NOT IN ({', '.join(map(repr, _STOPS))})) AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM tk),
g AS (SELECT doc_id, t AS term FROM u UNION ALL
      SELECT doc_id, t || ' ' || t2 FROM (SELECT doc_id, t, lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS t2 FROM u)
      WHERE t2 IS NOT NULL),
counts AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM g GROUP BY term),
vocab AS (SELECT term, tf, df, ln((1 + (SELECT count(*) FROM documents)) / (df + 1)) + 1 AS idf FROM counts
          WHERE df >= 5 AND df <= 0.8 * (SELECT count(*) FROM documents) ORDER BY tf DESC, term LIMIT 2000)
"""


def _docs_with_terms(spark, folder):
    return topics.with_terms(dealt(table(spark, folder, "documents").select("doc_id", "text")), "text", stop_words=_STOPS)


@query(f"WITH {_TERMS_SQL} SELECT term, tf, df FROM counts")
def term_and_document_counts(spark, folder):
    return topics.term_counts(_docs_with_terms(spark, folder))


@query(f"WITH {_TERMS_SQL} SELECT term, tf, df, round(idf, 6) AS idf FROM vocab")
def topic_vocabulary(spark, folder):
    docs = _docs_with_terms(spark, folder)
    n = table(spark, folder, "documents").count()
    return rounded(topics.vocabulary(topics.term_counts(docs), n))


@query(f"""WITH {_TERMS_SQL}, x AS (SELECT doc_id, term, count(*) * any_value(idf) AS v FROM g JOIN vocab USING (term) GROUP BY 1, 2),
w AS (SELECT doc_id, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS v FROM x)
SELECT d.doc_id, count(v) AS known_terms, round(coalesce(sum(v), 0), 6) AS weight,
       round(coalesce(max(v), 0), 6) AS top_weight
FROM documents d LEFT JOIN w USING (doc_id) GROUP BY 1""")
def tfidf_weights(spark, folder):
    from pyspark.ml.functions import vector_to_array

    docs = _docs_with_terms(spark, folder)
    vectors = topics.fit_tfidf(docs).transform(docs).select("doc_id", vector_to_array("features").alias("v"))
    known = F.filter("v", lambda x: x > 0)
    return rounded(vectors.select(
        "doc_id", F.size(known).cast("long").alias("known_terms"),
        F.aggregate(known, F.lit(0.0), lambda a, x: a + x).alias("weight"),
        F.coalesce(F.array_max(known), F.lit(0.0)).alias("top_weight")))


@query("""SELECT doc_id, 6 AS n_weights, 1.0::DOUBLE AS total, true AS dominant_is_largest, true AS settled FROM documents""")
def document_topics(spark, folder):
    """Topic weights of every text; a fitted model, so SQL states what must hold of each text.

    Settled: the weights that follow from a text's weights, term by term, are those weights again, to a hundredth.
    """
    import numpy as np
    import pandas as pd

    docs = documents(spark, folder).select("doc_id", F.col("text").alias("clean_text"))
    weighted, _, model, _ = topics.extract_topics(docs, kept_in="features")
    topic_of_term, alpha, k, digamma = np.exp(lda.expectation(model.parameters)), model.alpha, model.k, lda.digamma

    @F.pandas_udf("boolean")
    def follows(weights: pd.Series, terms: pd.Series, counts: pd.Series) -> pd.Series:
        out = [np.zeros(0, bool)]
        every = np.array([len(t) for t in terms], int)
        for some in lda.portions(every):
            w, sizes = np.array([*weights[some]]), every[some]
            t, n = np.concatenate([*terms[some]]).astype(int), np.concatenate([*counts[some]])
            row = np.repeat(np.arange(len(sizes)), sizes)
            theta = np.exp(digamma(w * (np.bincount(row, n, len(sizes)) + alpha * k)[:, None]))
            share = theta.T[:, row] * topic_of_term[:, t]
            share *= n / share.sum(axis=0)
            gamma = alpha + np.array([np.bincount(row, s, len(sizes)) for s in share]).T
            out.append((sizes == 0) | (np.abs(gamma / gamma.sum(axis=1, keepdims=True) - w).max(axis=1) < 0.01))
        return pd.Series(np.concatenate(out))

    weights = F.array(*[F.col(f"topic_{t}_weight") for t in range(k)])
    terms, counts = lda.sparse(F.col("features"))
    joined = weighted.select("doc_id", "dominant_topic", weights.alias("w")).join(
        weighted.select("doc_id", terms.alias("terms"), counts.alias("counts")), "doc_id")
    return joined.select(
        "doc_id", F.size("w").alias("n_weights"), r(F.aggregate("w", F.lit(0.0), lambda a, x: a + x)).alias("total"),
        (F.get("w", F.col("dominant_topic")) == F.array_max("w")).alias("dominant_is_largest"),
        follows("w", "terms", "counts").alias("settled"))


@query("SELECT t::INT AS topic_id, 15 AS n_words, 15 AS n_different, true AS all_known FROM range(6) r(t)")
def topic_words(spark, folder):
    """The strongest terms of each topic: fifteen different ones, all of the vocabulary."""
    docs = documents(spark, folder).select("doc_id", F.col("text").alias("clean_text"))
    _, _, model, tfidf = topics.extract_topics(docs)
    words = topics.top_terms(spark, model, tfidf.terms)
    known = F.array(*[F.lit(t) for t in tfidf.terms])
    return words.select(
        "topic_id", F.size("top_words").alias("n_words"), F.size(F.array_distinct("top_words")).alias("n_different"),
        (F.size(F.array_except("top_words", known)) == 0).alias("all_known"))


_WORDS_SQL = """
wt AS (SELECT lang, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS t FROM documents),
top AS (SELECT lang, t, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, t) AS i FROM wt
        WHERE regexp_full_match(t, '[a-z][a-z]+') GROUP BY 1, 2 QUALIFY i <= 15)
"""
_KEYWORDS = {"articles": ["the", "la", "der", "die", "le"], "english": ["the", "of", "and", "to"],
             "german": ["der", "die", "und", "den"], "other": ["que", "ci"]}


@query(f"""WITH {_WORDS_SQL},
kw(label, pos, words) AS (VALUES {', '.join(f"('{k}', {i}, {v!r})" for i, (k, v) in enumerate(_KEYWORDS.items()))}),
a AS (SELECT lang, label, pos, count(*) AS n FROM top JOIN (SELECT label, pos, unnest(words) AS t FROM kw) USING (t)
      GROUP BY 1, 2, 3 HAVING count(*) >= 2),
o AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, pos) = 1),
f AS (SELECT lang, string_agg(t, ',' ORDER BY i) AS top_words, min(t) FILTER (i = 1) AS first FROM top GROUP BY 1)
SELECT lang AS topic_id, coalesce(label, 'Cluster: ' || first) AS label, top_words FROM f LEFT JOIN o USING (lang)""")
def languages_labelled_by_keywords(spark, folder):
    from pyspark.sql import Window

    from sitegauge.functions.text import topic_tokens

    counts = documents(spark, folder).select(
        F.col("lang").alias("topic_id"), F.explode(topic_tokens("text")).alias("t")).groupBy(
        "topic_id", "t").agg(F.count(F.lit(1)).alias("n"))
    # Word counts are few per language; the words themselves were combined before.
    order = Window.partitionBy("topic_id").orderBy(F.desc("n"), "t")
    top = counts.withColumn("i", F.row_number().over(order)).filter("i <= 15")
    summary = top.groupBy("topic_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "t"))), lambda s: s["t"]).alias("top_words"))
    keywords = small_table(spark, [(k, i, v) for i, (k, v) in enumerate(_KEYWORDS.items())],
                           "label string, pos int, keywords array<string>")
    labelled = topics.label_topics(summary, keywords)
    return labelled.select("topic_id", "label", F.array_join("top_words", ",").alias("top_words"))


def _domain_values() -> str:
    from sitegauge.sources.fixed_values import DOMAIN_LEXICON

    return ", ".join("('" + term.replace("'", "''") + f"', {valence!r}::DOUBLE)" for term, valence in DOMAIN_LEXICON)


@query(f"""
WITH domain(term, valence) AS (VALUES {_domain_values()}),
base AS (SELECT lower(n_name) AS term, n_regionkey::DOUBLE AS valence FROM nation
         UNION ALL SELECT term, n_nationkey::DOUBLE FROM domain, nation WHERE n_nationkey = 7)
SELECT * FROM domain UNION ALL SELECT * FROM base WHERE term NOT IN (SELECT term FROM domain)
""")
def domain_terms_over_general_lexicon(spark, folder):
    """A general lexicon that lists some domain terms too; the domain's valence stands."""
    from sitegauge.sources.dimensions import domain_lexicon

    nations = table(spark, folder, "nation")
    valence = nations.where("n_nationkey = 7").select(F.col("n_nationkey").cast("double"))
    listed = domain_lexicon(spark).select("term", valence.scalar().alias("valence"))
    base = nations.select(F.lower("n_name").alias("term"), F.col("n_regionkey").cast("double").alias("valence")).unionByName(listed)
    return sentiment.full_lexicon(spark, base)


def _labels_of_nations() -> str:
    from sitegauge.sources.fixed_values import TOPIC_KEYWORDS

    return "[" + ", ".join("'" + label.replace("'", "''") + "'" for label, _ in TOPIC_KEYWORDS) + "]"


def _resistance_labels() -> str:
    from sitegauge.sources.fixed_values import RESISTANCE_LABELS

    return ", ".join("'" + label.replace("'", "''") + "'" for label in RESISTANCE_LABELS)


@query(f"""
WITH l AS (SELECT {_labels_of_nations()} AS labels),
t AS (SELECT c_nationkey AS topic_id, count(*) AS n FROM customer GROUP BY 1),
s AS (SELECT topic_id, labels[1 + (topic_id + n) % len(labels)] AS label FROM t, l)
SELECT topic_id::INT AS topic_id FROM s WHERE label IN ({_resistance_labels()})
""")
def topics_of_resistance(spark, folder):
    """Of topics with a label each, those that speak of resistance."""
    from sitegauge.sources.fixed_values import TOPIC_KEYWORDS

    labels = F.array(*[F.lit(label) for label, _ in TOPIC_KEYWORDS])
    summary = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("topic_id")).agg(F.count(F.lit(1)).alias("n")).select(
        "topic_id", F.get(labels, ((F.col("topic_id") + F.col("n")) % F.size(labels)).cast("int")).alias("label"))
    return small_table(spark, [(i,) for i in topics.resistance_topics(summary)], "topic_id int")
