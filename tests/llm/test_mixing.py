import pytest

from sitegauge.llm import mixing


def water_filling(sizes):
    """Targets by the stated rounds: share, stop, share the excess again."""
    weights = {s: i % 3 + 1.0 for i, s in enumerate(sizes)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in stopped]
        left = total - sum(3 * sizes[s] for s in stopped)
        share = {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            return {**{s: 3.0 * sizes[s] for s in stopped}, **share}
        stopped |= above


def check(docs, **options):
    rows = mixing.mix(docs, **options).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    by_id = {}
    for r in docs.collect():
        by_id.setdefault(r.doc_id, set()).add(r.source)
    sizes, taken, targets = {}, {}, {}
    for r in rows:
        key = r.target, r.source_size
        taken[key] = taken.get(key, 0) + r.taken
        targets[key] = r.target
    assert all(abs(taken[k] - targets[k]) <= 1 * sum(1 for _ in targets) for k in taken)
    return rows


def test_targets(make, spark):
    names = ["a", "b", "c", "d", "é", "Z", None]
    docs = make([(i, (" ".join(["w"] * (1 + i * k)), "en", names[k])) for k in range(7) for i in range(10)])
    sizes = {}
    for r in sorted(docs.collect(), key=lambda r: (r.source is None, (r.source or "").encode())):
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    want = water_filling(sizes)
    got = {(r.source_size, round(r.target, 6)) for r in mixing.mix(docs).collect()}
    assert got == {(sizes[s], round(want[s], 6)) for s in sizes}


@pytest.mark.parametrize("block", [1, 7, 128])
def test_odd_rows(odd, empty, block):
    check(odd, block_words=block)
    assert mixing.mix(empty, block_words=block).count() == 0


def test_hot_source_and_reruns(make):
    docs = make([(i, (" ".join(["w"] * (i % 40)), "en", "hot" if i % 3 else f"s{i % 9}")) for i in range(900)])
    first = sorted(map(tuple, check(docs)))
    assert first == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_schedule_is_even_and_whole(make, spark):
    docs = make([(i, (" ".join(["w"] * 50), "en", "abc"[i % 3])) for i in range(300)])
    narrow = docs.select("source").groupBy("source").count().selectExpr("source", "count * 50 AS source_size")
    shares = mixing.targets(narrow)
    quota = {r.place: r.quota for r in shares.collect()}
    slots = mixing.schedule(shares, 10).collect()
    for place, words in quota.items():
        ranks = sorted(r["rank"] for r in slots if r.place == place)
        assert ranks == list(range(-(-words // 10)))
    # Any stretch of slots holds each source about as often as its share says.
    order = [r.place for r in sorted(slots, key=lambda r: r.slot)]
    for at in range(0, len(order) - 120, 40):
        for place, words in quota.items():
            assert abs(order[at : at + 120].count(place) - 120 * words / sum(quota.values())) <= 5


def test_repeated_rows_follow_the_mix(make):
    docs = make([(i, (" ".join(["w"] * 20), "en", "ab"[i % 10 == 0])) for i in range(200)])
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    times = {}
    for r in out.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert all(times.get(i, 0) == round(t / 20 + 1e-9) for i, t in taken.items())


def test_rows_are_repeated_one_by_one(make, spark):
    """Rows that share an id, or have none, get what is taken of each; columns of any name stay."""
    from pyspark.sql import functions as F

    docs = make([(i if i % 3 else None, (f"w{i} " + " ".join(["w"] * (5 + i % 7)), "en", "abc"[i % 2] if i % 5 else "c")) for i in range(120)]
                + [(1, ("x y z", "en", "a")), (1, ("x y z other", "en", "b"))])
    names = ("_time", "_times", "_taken", "n", "time", "mark_id", "Mark_Text", "mark_source", "taken")
    docs = docs.withColumns({n: F.lit(i) for i, n in enumerate(names)})
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    took = {(r.doc_id, r.mark.source, r.mark.m): round(r.taken / max(1, r["size"]) + 1e-9) for r in mixing.mix(
        docs, mark=F.struct(F.xxhash64("text").alias("m"), "source")).collect()}
    got = {}
    for r in out.withColumn("m", F.xxhash64("text")).collect():
        got[r.doc_id, r.source, r.m] = got.get((r.doc_id, r.source, r.m), 0) + 1
    assert {k: v for k, v in took.items() if v} == got
    assert len({v for k, v in took.items() if k[0] is None}) > 1
