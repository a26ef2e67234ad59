import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitegauge.llm import lexical

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.lower() for t in TERM.findall((text or "").encode())]


def plain(docs, queries, k):
    """(item, [(id, score), ...]) of every query, by scoring all documents."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in queries:
        found = []
        for i, bag in bags:
            score = 0
            for t in set(terms(text)) & set(bag):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * (10 + 90 * bag.total() * n_docs // n_terms)))
            if score > 0:
                found.append((i, score))
        found.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out.append((item, found[:k]))
    return out


def check(docs, queries, query_id="doc_id", **options):
    k = options.get("k", lexical.TOP)
    got = Counter((r[query_id], r["rank"], r["doc_id"] if query_id != "doc_id" else r[2], r.score)
                  for r in lexical.search(docs, queries, query_id_col=query_id, **options).collect())
    want = Counter((item, n + 1, i, score) for item, found in plain(
        [(r.doc_id, r.text) for r in docs.collect()], [(r[query_id], r.text) for r in queries.collect()], k)
        for n, (i, score) in enumerate(found))
    assert got == want


@pytest.mark.parametrize("options", [{}, {"block": 7, "width": 16}, {"k": 3, "width": 1}, {"k": 1000}])
def test_given_documents(spark, folder, options):
    check(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"), "item_id", **options)


def test_bounds_hold_and_small_steps_lose_nothing(spark, folder, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 64)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    check(docs.repartition(5), docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("q"), "text"), "q", k=4)


def test_odd_rows(odd, empty, spark):
    queries = odd.select(F.col("doc_id").alias("q"), "text")
    check(odd, queries, "q")
    check(odd, queries.where("q = 1"), "q", k=1)
    clash = odd.withColumns({n: F.lit(1) for n in ("query", "terms", "tfs", "n", "sketch", "rank", "number", "item")})
    check(clash, clash.select(F.col("doc_id").alias("q"), "text", "rank", "item", "number"), "q")
    for docs, asked in ((empty, queries), (odd, queries.where("false")), (empty, queries.where("false"))):
        found = lexical.search(docs, asked, query_id_col="q")
        assert found.columns == ["q", "rank", "doc_id", "score"] and found.count() == 0


def test_copies_and_ties(make):
    docs = make([(i, "same words in all of these" if i % 3 else f"other words {i} here") for i in range(60, 0, -1)] + [(5, "same words")])
    queries = docs.where("doc_id in (5, 7, 9)").select(F.col("doc_id").alias("q"), "text")
    check(docs, queries, "q")


def test_best_rises_and_breaks_ties():
    best = lexical.Best(2, 5)
    for score, i in ((4, 1), (9, 8), (9, None), (9, 3), (7, 0)):
        best.add(score, i)
    assert [(-s, i) for s, _, i in best.rows] == [(9, 3), (9, 8)] and best.bar == 9
