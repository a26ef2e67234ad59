import random

import pytest

from sitegauge.llm import toxicity

BAD = ["zilch", "gronk", "vexed"]


@pytest.fixture(scope="module")
def corpus(spark):
    """Clean prose, some of it with bad words; labels hold a few random mistakes."""
    draw = random.Random(9)
    common = [f"w{i}" for i in range(300)]
    texts, labels, truth = [], [], {}
    for i in range(1500):
        words = [draw.choice(common) for _ in range(draw.randint(30, 120))]
        truth[i] = i % 7 == 0
        if truth[i]:
            for _ in range(max(2, len(words) // 25)):
                words[draw.randrange(len(words))] = draw.choice(BAD)
        texts.append((i, " ".join(words)))
        if i % 5 != 4:
            labels.append((i, int(truth[i] or draw.random() < 0.02)))
    return (spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4),
            spark.createDataFrame(labels, "doc_id bigint, toxic int"), truth)


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    caught = [r.predicted for r in held if truth[r.doc_id]]
    wrong = [r.predicted for r in held if not truth[r.doc_id]]
    assert sum(caught) >= 0.9 * len(caught) and sum(wrong) <= 0.02 * len(wrong)


def test_held_out_labels_are_not_learnt_from(corpus, spark):
    from pyspark.sql import functions as F

    docs, labels, _ = corpus
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [{r.doc_id: r.score for r in toxicity.score(docs, x).collect()} for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_stage_drops_what_is_predicted(corpus):
    docs, labels, _ = corpus
    toxic = {r.doc_id for r in toxicity.score(docs, labels).collect() if r.predicted}
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - toxic


def test_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (7, 0), (10, 0), (99, 1)], "doc_id bigint, toxic int")
    got = toxicity.score(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty, labels).count() == 0
    assert toxicity.score(odd, labels.limit(0)).where("predicted = 1").count() == 0


def test_columns_of_any_name_stay(odd, spark):
    from pyspark.sql import functions as F

    names = ("_text", "_score", "_id", "_held_out", "_predicted", "Predicted", "predicted", "held_out", "h", "w", "y", "fold")
    docs = odd.withColumns({n: F.lit(i) for i, n in enumerate(names[:5] + names[6:])})
    labels = spark.createDataFrame([(1, 1), (7, 0), (10, 0)], "doc_id bigint, toxic int")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert toxicity.score(docs, labels).columns == ["doc_id", "held_out", "score", "predicted"]


def plain_counts(rows):
    """Texts per class that hold each word, or each pair."""
    from collections import Counter

    seen = {}
    for text, y in rows:
        words = toxicity.words_of(text)
        for key in {(None, w) for w in words} | set(zip([b"", *words], words)):
            seen.setdefault(key, [0, 0])[y] += 1
    return Counter({(*k, *n): 1 for k, n in seen.items()})


@pytest.mark.parametrize("held", [7, 200_000])
def test_counts_by_brute_force(corpus, spark, monkeypatch, held):
    """Also where a task holds few expressions, and of long texts in one batch."""
    from collections import Counter

    monkeypatch.setattr(toxicity, "HELD", held)
    rows = [(r.text, r.doc_id % 2) for r in corpus[0].where("doc_id < 60").collect()] + [
        (None, 0), ("", 1), ("one", 1), ("One  two, ONE two" * 3000, 0)]
    got = toxicity.counts(spark.createDataFrame(rows, "text string, y int").coalesce(1)).collect()
    assert Counter((r.h and bytes(r.h) if r.h is not None else None, bytes(r.w), r.n0, r.n1) for r in got) == plain_counts(rows)


def test_model_and_scores_by_brute_force(corpus, spark):
    """Every score again from plain counts, by the formulas, for each discount and order."""
    import math
    from collections import Counter

    docs, labels, truth = corpus
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [(r.text, marks[r.doc_id]) for r in docs.collect() if r.doc_id in marks]
    counts = {k[:2]: k[2:] for k in plain_counts(rows)}
    single = {w: n for (h, w), n in counts.items() if h is None}
    pairs = {k: n for k, n in counts.items() if k[0] is not None}
    before = Counter(w for _, w in pairs)
    n_toxic = sum(y for _, y in rows)
    discounts = [max(1.0, s * n_toxic) for s in toxicity.SHARES]
    seen = toxicity.gather(spark.createDataFrame(rows, "text string, y int").repartition(3), min(discounts))

    def totals_and_discounts(table, d1):
        totals = [sum(n[y] for n in table.values()) for y in (0, 1)]
        share = sum(min(n[1], d1) for n in table.values()) / totals[1]
        low, high = 0.0, max(n[0] for n in table.values())
        for _ in range(60):
            d0 = (low + high) / 2
            low, high = (d0, high) if sum(min(n[0], d0) for n in table.values()) / totals[0] < share else (low, d0)
        usual = [toxicity.usual_discount(Counter(n[y] for n in table.values() if n[y])) for y in (0, 1)]
        return totals, share, [high, d1], usual

    def tells(n, totals):
        if n[1] * totals[0] <= n[0] * totals[1]:
            return False
        return sum(n[y] * math.log(n[y] * sum(totals) / (sum(n) * totals[y])) for y in (0, 1) if n[y]) >= toxicity.EVIDENCE

    def left_over(n, totals, less, usual, shared):
        large = [max(n[y] - less[y], 0.0) for y in (0, 1)]
        small = [max(n[y] - usual[y], 0.0) for y in (0, 1)]
        ratio = lambda x: (x[1] / totals[1] + shared) / (x[0] / totals[0] + shared)
        return small if tells(n, totals) and ratio(small) > ratio(large) else large

    for d in discounts:
        t1, share, less1, usual1 = totals_and_discounts(single, d)
        t2, _, less2, usual2 = totals_and_discounts(pairs, d)
        word, pair, context = {}, {}, {}
        for w, n in single.items():
            shared = share * before[w] / len(pairs)
            x = left_over(n, t1, less1, usual1, shared)
            word[w] = [x[y] / t1[y] + shared for y in (0, 1)]
        strong = {k: n for k, n in pairs.items() if n[0] > less2[0] or n[1] > less2[1] or tells(n, t2)}
        for head in {h for h, _ in strong}:
            whole = [sum(n[y] for (h, _), n in pairs.items() if h == head) for y in (0, 1)]
            x = {w: left_over(n, t2, less2, usual2, share * before[w] / len(pairs)) for (h, w), n in strong.items() if h == head}
            rest = [1 - sum(v[y] for v in x.values()) / whole[y] if whole[y] else 1.0 for y in (0, 1)]
            context[head] = math.log(max(rest[1], 1e-9) / max(rest[0], 1e-9))
            for w, v in x.items():
                q = [(v[y] / whole[y] if whole[y] else 0.0) + rest[y] * word[w][y] for y in (0, 1)]
                pair[head, w] = math.log(max(q[1], 1e-12) / max(q[0], 1e-12))
        one, two = toxicity.fit(seen, d, 1), toxicity.fit(seen, d, 2)
        for text in [r for r, _ in rows[:40]] + ["zilch never seen before gronk", "w1", "", None]:
            words = toxicity.words_of(text)
            plain = [math.log(word[w][1] / word[w][0]) if w in word else 0.0 for w in words]
            assert one.score(words) == pytest.approx(sum(plain) / max(1, len(words)), abs=1e-9)
            both = sum(pair[k] if (k := (h, w)) in pair else x + context.get(h, 0.0)
                       for h, w, x in zip([b"", *words], words, plain))
            assert two.score(words) == pytest.approx(both / max(1, len(words)), abs=1e-9)


def test_common_backoff_says_nothing():
    """Both classes free the same share, so what is rare in both differs by nothing."""
    from collections import Counter

    sizes = {0: Counter({1: 500, 40: 20, 900: 3}), 1: Counter({1: 60, 8: 10, 50: 2})}
    totals, share, less = toxicity.balanced(sizes, 6.0)
    freed = [sum(min(c, less[y]) * k for c, k in sizes[y].items()) / totals[y] for y in (0, 1)]
    assert freed[0] == pytest.approx(share) and freed[1] == pytest.approx(share)


def test_monotone_fit():
    p = toxicity.monotone([0, 3, 1, 0, 9], [10, 10, 10, 0, 9])
    assert p == sorted(p) and p[1] == p[2] == pytest.approx(4.5 / 21)


def test_insults_that_are_each_rare_count(spark):
    """300 different insults, each in about 1 % of the toxic texts and in no other."""
    draw = random.Random(11)
    common = [f"w{i}" for i in range(200)]
    texts, truth = [], {}
    for i in range(12_000):
        words = [draw.choice(common) for _ in range(30)]
        truth[i] = i % 4 == 0
        if truth[i]:
            for place in draw.sample(range(30), 4):
                words[place] = f"bad{draw.randrange(300)}"
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(y)) for i, y in truth.items()], "doc_id bigint, toxic int")
    held = [r for r in toxicity.score(docs, labels).collect() if r.held_out]
    caught = [r.predicted for r in held if truth[r.doc_id]]
    wrong = [r.predicted for r in held if not truth[r.doc_id]]
    assert sum(caught) >= 0.95 * len(caught) and sum(wrong) <= 0.005 * len(wrong)


def test_the_evidence_asked_for_does_not_rise_with_the_corpus(spark):
    from collections import Counter

    rows = spark.createDataFrame([(0, 20), (20, 20), (2000, 160), (0, 3), (100, 0)], "n0 bigint, n1 bigint")
    for size in (10**5, 10**9):
        assert [r[0] for r in rows.select(toxicity.telling([13 * size, size])).collect()] == [True, True, False, False, False]
    assert toxicity.usual_discount(Counter({1: 10**9, 2: 10**8})) < 1 and toxicity.usual_discount(Counter({3: 4})) == 0.5
