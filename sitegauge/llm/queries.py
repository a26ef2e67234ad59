"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op1_bpe_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    from sitegauge.llm import bpe

    return bpe.encode(table(spark, folder, "documents"), tokenizer_path(), keep_ids=False)


@query()
def op6_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and group of near copies of every text."""
    from sitegauge.llm import simhash

    return simhash.near_copies(table(spark, folder, "documents"))


@query(r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM s),
w AS (SELECT *, (place % 3 + 1)::DOUBLE AS weight, 3 * source_size AS cap FROM p),
r AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, place
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rate FROM w),
f AS (SELECT *, cap < rate * weight AS stopped FROM r),
g AS (SELECT *, CASE WHEN stopped THEN cap::DOUBLE ELSE
        (sum(source_size) OVER () - sum(CASE WHEN stopped THEN cap ELSE 0 END) OVER ())::DOUBLE * weight
        / sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER () END AS target FROM f),
q AS (SELECT source, source_size, target, least(round(target), cap) AS quota FROM g),
b AS (SELECT d.doc_id, d.size, q.*, sum(d.size) OVER (PARTITION BY d.source
        ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size) - d.size AS b0
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
  (greatest(0, least(b0 + size, quota) - b0)
   + greatest(0, least(b0 + source_size + size, quota) - (b0 + source_size))
   + greatest(0, least(b0 + 2 * source_size + size, quota) - (b0 + 2 * source_size)))::BIGINT AS taken
FROM b
""")
def op10_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    from sitegauge.llm import mixing

    return mixing.mix(table(spark, folder, "documents"))


def _secrets_sql() -> str:
    """The same spans by plain scans: each match is taken with the gap before it, and lengths are added up."""
    from sitegauge.llm.secrets import BASE_RULES, RULES

    parts = []
    for number, rule in enumerate(RULES):
        pattern = rule.pattern
        for word in ("password", "passwd", "secret", "token", "api", "key"):
            if rule.kind == "assign":
                pattern = pattern.replace(word, "".join(f"[{c}{c.upper()}]" for c in word))
        pattern = pattern.replace("(?i:", "(?:").replace("'", "''")
        whole = f"'(?s)(.*?)({pattern})'"
        counted = f"regexp_extract_all(t, {whole}, {2 + rule.counted})" if rule.counted else f"regexp_extract_all(t, {whole}, 2)"
        parts.append(f"""SELECT rid, {number} AS number, '{rule.kind}' AS kind, {rule.least} AS least,
          unnest(regexp_extract_all(t, {whole}, 1)) AS gap, unnest(regexp_extract_all(t, {whole}, 2)) AS hit,
          unnest({counted}) AS counted, unnest(range(len(regexp_extract_all(t, {whole}, 1)))) AS i FROM d""")
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({" UNION ALL ".join(parts)}),
    p AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY rid, number ORDER BY i) AS e FROM m),
    s AS (SELECT rid, number, kind, (e - length(hit))::BIGINT AS b, e::BIGINT AS e FROM p WHERE length(counted) >= least),
    g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
      count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, number) FILTER (number < {len(BASE_RULES)}) AS base,
      string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, number) AS spans FROM s GROUP BY rid)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""


@query(_secrets_sql())
def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every text."""
    from sitegauge.llm import secrets

    return secrets.scan(table(spark, folder, "documents"))


@query(r"""
WITH rules(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'),
  ('example.com/de/', 'block'), ('org/fr/', 'allow')),
parts AS (SELECT *, split_part(rule, '/', 1) AS rule_host, substring(rule, instr(rule, '/')) AS rule_path FROM rules),
p AS (SELECT row_number() OVER () AS rid, page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
b AS (SELECT rid, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM p JOIN parts
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host,
  '(^|\.)(casino-win|free-bets|ads-track|spam-farm)\.example\.com$') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN b USING (rid)
""")
def op4_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, fitting rule and verdict of every page."""
    from sitegauge.llm import urls

    return urls.judge(table(spark, folder, "pages"))


def _quality_sql() -> str:
    """The same counts by exploded words, and the same bounds by the logarithm of the gamma function."""
    from sitegauge.llm.quality import ALLOWED, CUTOFFS, ERROR, MIN_WORDS

    tests = ", ".join(f"('{name}', {c}::DOUBLE)" for name, cuts in CUTOFFS.items() for c in cuts)
    n_tests, p = sum(map(len, CUTOFFS.values())), ALLOWED / len(CUTOFFS)
    above = " OR ".join(f"coalesce({name} > (SELECT cutoff FROM cut WHERE cut.lang IS NOT DISTINCT FROM f.lang AND name = '{name}'), false)"
                        for name in CUTOFFS)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
s AS MATERIALIZED (SELECT rid, doc_id, lang, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
u AS (SELECT rid, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM s),
g AS (SELECT rid, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
m AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM g WHERE c IS NOT NULL),
v AS (SELECT rid, count(DISTINCT i + k0) AS n FROM m, range(3) z(k0) WHERE k > 1 GROUP BY rid),
x AS (SELECT s.rid, doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words FROM s LEFT JOIN v USING (rid)),
f AS MATERIALIZED (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_symbols / nullif(word_chars, 0) AS symbol_share, n_dup_lines / nullif(n_lines, 0) AS dup_line_share,
  n_repeat_words / nullif(n_words, 0) AS repeat_share, word_chars / nullif(n_words, 0) AS word_length FROM x),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min((quality = 1)::INT) = 1),
j AS (SELECT * FROM f JOIN good USING (doc_id) WHERE NOT base_failed),
l AS ({" UNION ALL ".join(f"SELECT lang, '{name}' AS name, {name} AS value FROM j" for name in CUTOFFS)}),
c AS (SELECT lang, t.name, cutoff, count(*) AS n, count_if(value > cutoff)::BIGINT AS k
      FROM l JOIN (VALUES {tests}) t(name, cutoff) ON l.name = t.name GROUP BY ALL),
b AS (SELECT lang, name, cutoff, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p!r}) + (n - i) * ln({1 - p!r}))) AS chance
      FROM (SELECT *, unnest(range(k + 1)) AS i FROM c WHERE k <= n * {p!r}) GROUP BY ALL),
cut AS MATERIALIZED (SELECT lang, name, min(cutoff) AS cutoff FROM b
  WHERE chance <= {ERROR!r} / ({n_tests} * (SELECT count(*) FROM (SELECT DISTINCT lang FROM d))) GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({above}) AS kept FROM f"""


@query(_quality_sql())
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every text."""
    from sitegauge.llm import quality

    return quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


def _licences_sql() -> str:
    """The same votes with words compared as they are."""
    from sitegauge.llm.licenses import DRIFT, LEAST_SHARE, PASSAGES, PHRASES

    known = ", ".join(f"({i}, '{label}', {i < len(PHRASES)}, '{text}')".lower() for i, (text, label) in enumerate([*PHRASES, *PASSAGES]))
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT id, label, phrase, string_split(text, ' ') AS w FROM (VALUES {known}) k(id, label, phrase, text)),
tg AS (SELECT id, label, phrase, len(w) - 1 AS n, unnest(w[:-2]) AS a, unnest(w[2:]) AS b, unnest(range(len(w) - 1)) AS q FROM t),
dg AS (SELECT rid, unnest(w[:-2]) AS a, unnest(w[2:]) AS b, unnest(range(len(w) - 1)) AS p FROM d WHERE len(w) > 1),
h AS (SELECT rid, id, label, phrase, n, p, q, p - q AS g FROM dg JOIN tg USING (a, b)),
c AS (SELECT rid, id, label, phrase, n, g, list(DISTINCT q) AS found, min(p) AS start FROM h GROUP BY ALL),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, id ORDER BY g) AS run FROM (
  SELECT *, (g - coalesce(lag(g) OVER (PARTITION BY rid, id ORDER BY g), -1000000000) > {DRIFT})::INT AS fresh FROM c WHERE NOT phrase)),
v AS (SELECT h.rid, h.id, h.label, h.n, r.run, h.q, min(h.p) AS p FROM h JOIN r ON h.rid = r.rid AND h.id = r.id AND h.g = r.g GROUP BY ALL),
y AS (SELECT *, p - lag(p) OVER w AS ahead, q - lag(q) OVER w AS gone FROM v WINDOW w AS (PARTITION BY rid, id, run ORDER BY q)),
z AS (SELECT rid, label, (1 + count(*) FILTER (ahead > 0 AND ahead <= gone + {DRIFT})) / n AS share FROM y GROUP BY rid, id, label, n, run),
s AS (SELECT rid, label, true AS phrase, g AS start, 1.0::DOUBLE AS share FROM c WHERE phrase AND len(found) = n
  UNION ALL SELECT rid, label, false, 0, share FROM z WHERE share >= {LEAST_SHARE}),
o AS (SELECT rid, count(*) FILTER (phrase) AS n_base, min(start) FILTER (phrase) AS first_word, max(start) FILTER (phrase) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
  max(share) AS score FROM s GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0) AS score FROM d LEFT JOIN o USING (rid)"""


@query(_licences_sql())
def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and passages of every text."""
    from sitegauge.llm import licenses

    return licenses.scan(table(spark, folder, "documents"))


@query()
def op3_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector."""
    from sitegauge.llm import vectors

    return vectors.nearest(table(spark, folder, "embeddings"))


@query()
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Chance that a text is toxic."""
    from sitegauge.llm import toxicity

    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op8_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """log10 probability of every text."""
    from sitegauge.llm import language_model

    return language_model.score(table(spark, folder, "documents"))


@query(r"""
WITH RECURSIVE crc(b, c, i) AS (SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM crc WHERE i < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM crc WHERE i = 8),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
x AS MATERIALIZED (SELECT side, rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda y: y <> '') AS w
  FROM (SELECT 's' AS side, rid, text FROM d UNION ALL SELECT 't', -row_number() OVER (), text FROM benchmark)),
u AS (SELECT side, rid, unnest(w) AS a, unnest(w[2:] || [NULL]) AS b, unnest(w[3:] || [NULL, NULL]) AS c FROM x WHERE len(w) > 0),
f AS MATERIALIZED (SELECT side, rid, unnest([a, a || ' ' || b, a || ' ' || b || ' ' || c]) AS gram FROM u),
g AS (SELECT DISTINCT gram FROM f WHERE gram IS NOT NULL),
h AS MATERIALIZED (SELECT gram, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(gram)), '..'),
    lambda z: ('0x' || z)::BIGINT)), lambda acc, z: xor(acc >> 8, t[(xor(acc, z) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM g, tab),
k AS MATERIALIZED (SELECT side, rid, bucket, count(*) AS n FROM f JOIN h USING (gram) GROUP BY ALL),
c AS (SELECT range AS bucket, coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t
  FROM range(10000) LEFT JOIN k ON range = bucket GROUP BY range),
e AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM c),
w AS (SELECT rid, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM k JOIN e USING (bucket) WHERE side = 's' GROUP BY rid),
p AS (SELECT d.rid, doc_id, coalesce(len(x.w), 0) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d JOIN x ON d.rid = x.rid LEFT JOIN w ON d.rid = w.rid),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
    5 * count(*) OVER (PARTITION BY n_words >= 20) // 100 AS most FROM p)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= most THEN place END AS rank FROM r
""")
def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Weight, score and rank of every document in a draw towards the benchmark."""
    from sitegauge.llm import importance

    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda y: y <> '') AS w FROM documents),
i AS MATERIALIZED (SELECT row_number() OVER () AS qid, item_id, list_distinct(list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda y: y <> '')) AS w FROM benchmark),
q AS (SELECT qid, item_id, unnest(w) AS term FROM i),
a AS (SELECT count(*) FILTER (len(w) > 0) AS big_n, sum(len(w))::BIGINT AS big_l FROM d),
t AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
p AS (SELECT t.*, count(*) OVER (PARTITION BY term) AS df FROM t WHERE term IN (SELECT term FROM q)),
v AS (SELECT rid, doc_id, term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l))) AS impact FROM p, a),
s AS (SELECT qid, item_id, rid, doc_id, sum(impact)::BIGINT AS score FROM q JOIN v USING (term) GROUP BY ALL HAVING sum(impact) > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
""")
def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    from sitegauge.llm import lexical

    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op13_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 1024 tokens."""
    import public_tokenizers

    from sitegauge.llm import packing

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    return packing.pack(table(spark, folder, "documents"), tokenizer)
