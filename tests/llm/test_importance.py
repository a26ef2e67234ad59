import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sitegauge.llm import importance

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, buckets=importance.BUCKETS):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g) % buckets for g in grams]


def plain(docs, target, percent=5, min_words=20):
    """All rows as (id, n_features, weight, score), and the drawn ones in order."""
    s, t = [0] * importance.BUCKETS, [0] * importance.BUCKETS
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in features(text)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    rows, able = [], []
    for i, text in docs:
        n, found = features(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
        able += [rows[-1]] if n >= min_words else []
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return rows, able[: percent * len(able) // 100]


def check(docs, target, **options):
    got = importance.resample(docs, target, **options).collect()
    rows, first = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], **options)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=key) == sorted(rows, key=key)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(first) + 1))
    assert [(r.doc_id, r.n_features, r.weight, r.score) for r in ranked] == first


def test_given_documents(spark, folder):
    check(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))


@pytest.mark.parametrize("percent", [0, 30, 100])
def test_odd_rows(odd, empty, percent):
    check(odd, odd.where("doc_id < 4"), percent=percent, min_words=1)
    assert importance.resample(empty, odd).count() == 0
    assert importance.resample(odd, empty).count() == odd.count()


def test_ties_go_to_the_smaller_id_and_then_to_repeated_rows(spark, odd):
    text = "one two three"
    docs = spark.createDataFrame([(i % 7 if i % 7 else None, text) for i in range(140)], "doc_id int, text string").repartition(5)
    check(docs, odd, percent=37, min_words=3)


def test_value_at_every_place(spark):
    values = [5, -9_000_000_000, 5, 5, 7, 1 << 62, -(1 << 62), 7, 0]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint")
    for place in range(1, len(values) + 1):
        at = sorted(values)[place - 1]
        assert importance.value_at(rows, F.col("v"), place) == (at, sum(v < at for v in values), values.count(at))


def test_columns_of_any_name_stay_in_the_sample(spark, odd):
    docs = odd.withColumns({n: F.lit(i) for i, n in enumerate(("row", "weight", "kept", "rank", "n_words", "_place", "_part"))})
    first = importance.sample(docs, odd, percent=50, min_words=1)
    ranks = {(r.doc_id, r.text): r["rank"] for r in first.select("rank", "document.*").drop("rank").withColumn(
        "rank", F.lit(1)).collect()}
    want = [r for r in importance.resample(docs, odd, percent=50, min_words=1).collect() if r["rank"]]
    assert first.count() == len(want) and {i for i, _ in ranks} == {r.doc_id for r in want}
    assert first.select("document.*").columns == docs.columns


def test_the_draw_leans_towards_the_target(make, spark):
    docs = make([(i, " ".join(["alpha beta gamma" if i % 2 else "delta eps zeta"] * 8)) for i in range(400)])
    target = make([(0, "alpha beta gamma " * 10)])
    got = [r.doc_id for r in importance.resample(docs, target).collect() if r["rank"]]
    assert len(got) == 20 and all(i % 2 for i in got)
