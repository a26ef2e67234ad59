import random
import re
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from sitegauge.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeats, len(covered), failed


def check(docs, labels):
    rows = quality.judge(docs, labels).collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == sorted((str(r.doc_id), *brute(r.text)) for r in docs.collect())
    assert not any(r.kept and r.base_failed for r in rows)
    return rows


@pytest.fixture(scope="module")
def labels(spark, folder):
    return spark.read.parquet(f"{folder}/labels.parquet")


def test_whole_test_table(spark, folder, labels):
    check(spark.read.parquet(f"{folder}/documents.parquet"), labels)


def test_odd_rows(odd, empty, spark, labels):
    marks = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (7, 1)], "doc_id bigint, quality int")
    assert all(r.kept != r.base_failed for r in check(odd, marks))  # too few labels to reject by
    assert quality.judge(empty, labels).count() == 0
    check(odd, marks.limit(0))


def test_repeats(make):
    draw = random.Random(8)
    docs = make([(i, draw.choice(["", "\n", " x y z "]).join(draw.choice(["a ", "b ", "c\n", "d\td ", "  \n"]) for _ in range(draw.randint(0, 60))))
                 for i in range(300)])
    words = docs.select("doc_id", "text", quality.repeated_words(quality.words_of(F.col("text"))).alias("n")).collect()
    assert {r.doc_id: r.n for r in words} == {r.doc_id: brute(r.text)[4] for r in words}


@pytest.mark.parametrize("p", [0.005, 0.05, 0.3])
def test_binomial_bound(spark, p):
    cases = [(k, n) for n in (1, 10, 57, 400) for k in range(n + 1)]
    got = spark.createDataFrame(cases, "k bigint, n bigint").select("k", "n", quality.at_most(F.col("k"), F.col("n"), p).alias("x")).collect()
    for r in got:
        want = sum(comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k + 1)) if r.k <= r.n * p else 1.0
        assert r.x == pytest.approx(want, rel=1e-9)


def test_cutoffs_keep_their_promise(make, spark):
    """In one stratum good texts have many symbols, in the other few; only there the strict cut-off is accepted."""
    draw = random.Random(2)
    plain = lambda n: " ".join(draw.choice(["some", "words", "of", "every", "kind", "here", "and", "there"]) + str(draw.randint(0, 999)) for _ in range(n))
    texts = []
    for i in range(6000):
        marks = "#" * 60 if i % 2 and i % 10 == 1 else ""
        texts.append((i, (plain(60) + " " + marks, "ab"[i % 2], "s")))
    bad = [(9001, (plain(60) + " " + "#" * 500, "a", "s")), (9002, (plain(60) + " " + "#" * 60, "b", "s"))]
    docs = make(texts + bad)
    marks = spark.createDataFrame([(i, 1) for i, _ in texts] + [(9001, 0), (9002, 0)], "doc_id bigint, quality int")
    kept = {r.doc_id: r.kept for r in quality.judge(docs, marks).collect()}
    assert not kept[9001] and kept[9002]
    good = [kept[i] for i, _ in texts]
    assert good.count(False) <= quality.ALLOWED * len(good)


def test_no_python_in_the_plan(odd, labels, capsys):
    quality.judge(odd, labels).explain()
    assert not re.search("Python|Pandas|InArrow|Cartesian", capsys.readouterr().out)
