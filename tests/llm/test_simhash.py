import random
import re

import numpy as np
import pytest
from xxhash import xxh64

from sitegauge.llm import simhash
from sitegauge.llm.components import connected


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, pairs):
    up = {v: v for v in values}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def close(values, bits=3):
    v = np.array(sorted(values), np.uint64)
    return [(int(v[i]), int(v[j])) for i in range(len(v)) for j in (i + 1 + np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= bits))]


def brute(rows):
    prints = {t: brute_fingerprint(t) for _, t in rows}
    label = components(set(prints.values()), close(set(prints.values())))
    low = {}
    for i, t in rows:
        if i is not None:
            k = label[prints[t]]
            low[k] = min(i, low.get(k, i))
    return sorted(((i, "%016x" % prints[t], low.get(label[prints[t]])) for i, t in rows), key=str)


def got(docs):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_copies(docs).collect()), key=str)


def test_whole_test_table(spark, folder, texts):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert got(docs) == brute(texts)


def test_odd_rows(odd, empty):
    assert got(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert simhash.near_copies(empty).count() == 0


@pytest.mark.parametrize("chunk", [3, 16, 2048])
def test_links_connect_all_close_fingerprints(spark, chunk):
    """Dense balls, one of them large, and single values; small chunks make one block fill many."""
    draw = random.Random(11)
    values = {0, 2**64 - 1, 1, 3, 7, 2**63}
    for size in (150, 20, 5, 2):
        centre = draw.getrandbits(64)
        for _ in range(size):
            flips = draw.sample(range(64), draw.randint(0, 3))
            values.add(centre ^ sum(1 << b for b in flips))
    values |= {draw.getrandbits(64) for _ in range(60)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = simhash.links(spark.createDataFrame(signed, "fp bigint"), chunk=chunk).collect()
    pairs = [(r.a % 2**64, r.b % 2**64) for r in found]
    assert all(bin(a ^ b).count("1") <= 64 for a, b in pairs)
    assert components(values, pairs) == components(values, close(values))


def test_gray_rank(spark):
    from pyspark.sql import functions as F

    rows = spark.range(64).select("id", simhash.gray_rank(F.col("id")).alias("rank")).collect()
    assert {r.id: r["rank"] for r in rows} == {n ^ n >> 1: n for n in range(64)}


@pytest.mark.parametrize("edges, want", [
    ([], {}),
    ([(1, 2), (2, 1), (2, 2), (None, 3), (4, None)], {1: 1, 2: 1}),
    ([(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(-5, -4)],
     {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, -5: -5, -4: -5}),
])
def test_components(spark, edges, want):
    found = connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.label for r in found} == want and len(found) == len(want)


def test_one_of_each_group_stays(make):
    base = " ".join(f"word{i}" for i in range(200))
    docs = make([(5, base), (3, base), (3, base), (9, base + " more"), (7, "something else entirely here"), (None, "lone text")])
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    labels = {i: c for i, _, c in got(docs) if i is not None}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*{str(c) for c in labels.values()}, "None"])


def test_texts_under_one_id_and_without_one_are_rows_of_their_own(make, spark):
    from pyspark.sql import functions as F

    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in ("a", "b", "c", "d")]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[0]), (2, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[3])]
    docs = make(rows).withColumns({n: F.lit(i) for i, n in enumerate(("first_id", "First_Mark", "own_mark", "mark", "_text", "label", "low"))})
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    want = sorted([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3])], key=repr)
    for n in (1, 5):
        assert sorted(((r.doc_id, r.text) for r in simhash.one_of_each(docs.repartition(n)).collect()), key=repr) == want
