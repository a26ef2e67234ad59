import numpy as np
import pytest

from sitegauge.llm import vectors
from sitegauge.llm.queries import op3_nearest_vectors


def exact(rows, k=20, every=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in sorted({i for i in ids if i % every == 0}):
        own = x[np.flatnonzero(ids == q)]
        y = min(own.tolist())
        s = np.einsum("bd,d->b", x, np.array(y))
        s[ids == q] = -np.inf
        order = [j for j in np.lexsort((ids, -s)) if s[j] > -np.inf][:k]
        out[q] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_on_the_test_vectors(spark, folder, duck):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    got, want = found(op3_nearest_vectors(spark, folder)), exact(rows)
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    x = {i: np.array(v, float) for i, v in rows}
    assert all(abs(s - x[i] @ x[q]) < 1e-9 for q in got for i, s in got[q])


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]),
            (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.0]),
            (20, [0.0, 1.0]), (9, [-1.0, 0.0])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, leaf int, id string")
    fine = [r for r in rows if r[0] in (0, 1, 2, 9, 20)]
    got, want = found(vectors.nearest(table, recall=1.0)), exact(fine)
    assert got == want
    assert vectors.nearest(table.limit(0)).count() == 0


def test_copies_of_one_vector_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 50)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 7)
    draw = np.random.default_rng(2)
    rows = [(i, [1.0, 0.0, 0.0]) if i % 3 == 0 else (i, draw.normal(size=3).round(3).tolist()) for i in range(600)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got, want = found(vectors.nearest(table, recall=1.0)), exact(rows)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


@pytest.mark.parametrize("n", [1, 3, 1000])
def test_walk_visits_every_leaf_once(n):
    x = np.random.default_rng(1).normal(size=(n, 4))
    tree = vectors.fit_tree(x, max(1, n // 20))
    order = list(tree.best_first(x[0]))
    assert sorted(order) == list(range(tree.n_leaves))
    assert set(tree.route(x)) <= set(order)


def test_small_leaves_give_as_many_rows_as_asked_for(spark, monkeypatch):
    """Tight clusters, many smaller than 20 rows, and copies of one vector, which settle for one leaf."""
    monkeypatch.setattr(vectors, "LEAF_ROWS", 16)
    draw = np.random.default_rng(4)
    rows = [[9.0, 0.0, 0.0]] * 400
    for size in (1, 1, 1, 2, 3, 5, 8, 60, 60, 60, 100, 100):
        centre = draw.normal(size=3)
        rows += (20 * centre / np.linalg.norm(centre) + draw.normal(scale=0.01, size=(size, 3))).tolist()
    ids = draw.permutation(len(rows)).tolist()
    rows = [(i if j < 400 else 20 * i, v) for j, (i, v) in enumerate(zip(ids, rows))]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for share in (0.05, vectors.RECALL):
        got, want = found(vectors.nearest(table, recall=share)), exact(rows)
        assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) == 20 for q in want)


def test_a_query_with_fewer_candidates_gets_all(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAF_ROWS", 4)
    rows = [(0, [5.0, float(i % 7)]) for i in range(60)] + [(i, [-float(i), 1.0]) for i in range(1, 13)]
    got = found(vectors.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), recall=0.05))
    assert {i for i, _ in got[0]} == set(range(1, 13)) and len(got[0]) == 12


def test_copies_count_once_in_the_calibration(spark):
    draw = np.random.default_rng(5)
    single = draw.normal(size=(100, 3)).tolist()
    tree = vectors.fit_tree(np.array(single), 20)
    leaves = lambda x: tree.route(np.array(x)).tolist()
    visits = []
    for rows in (single, single + [[9.0, 0.0, 0.0]] * 3000):
        table = [(i, v, leaf) for i, (v, leaf) in enumerate(zip(rows, leaves(rows)))]
        routed = spark.createDataFrame(table, "id bigint, v array<double>, leaf bigint")
        # Of the copies, only those that a different vector finds may change the figure.
        visits.append(vectors.calibrated_visits(routed.where("id < 100") if rows is single else routed, tree, len(rows), 20))
    asked_once = vectors.calibrated_visits(spark.createDataFrame(
        [(i, v, leaf) for i, (v, leaf) in enumerate(zip(single, leaves(single)))], "id bigint, v array<double>, leaf bigint"), tree, 100, 20)
    assert visits[0] == asked_once and visits[1] > 1
