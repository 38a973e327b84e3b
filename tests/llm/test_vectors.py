"""op8 equals brute force with ties and odd rows; op9 finds at least nine tenths and scores exactly."""

import math

import numpy as np
import pytest

from vigil.llm import multi_index, topk

SCHEMA = "vec_id long, embedding array<float>, label int, query_id int, score string, dim int"


def make(n, dim, seed, scale=1.0, heavy=False):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim)) * scale
    if heavy:
        x *= r.pareto(1.5, (n, 1)) + 0.1
    x[5] = x[6] = x[7]
    rows = [[i, [float(np.float32(v)) for v in x[i]], 0, 1, "s", 2] for i in range(n)]
    rows[8][1] = None
    rows[9][1] = [float("nan")] * dim
    rows[10][1] = [None] + [1.0] * (dim - 1)
    rows[11][1] = [float("inf")] * dim
    rows[12][1] = [0.0] * dim
    rows[13][1] = []
    rows[14][0] = None
    rows.append(list(rows[20]))  # a repeated row
    rows.append([20, [float(np.float32(v)) for v in -x[21]], 0, 1, "s", 2])  # another vector under its id
    rows.append([33, list(rows[20][1]), 0, 1, "s", 2])
    return [tuple(r) for r in rows]


def usable(rows, zero=True):
    return [
        (r[0], r[1]) for r in rows
        if r[0] is not None and r[1] and all(v is not None and math.isfinite(v) for v in r[1]) and (zero or any(r[1]))
    ]


@pytest.mark.parametrize("heavy", [False, True])
def test_top_products_equal_brute_force(spark, heavy):
    rows = make(700, 16, 3, heavy=heavy)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = topk.top_products(df, every=10, k=7, candidate_block=64, query_block=16).collect()
    vectors = [(i, [math.floor(1024 * v) for v in x]) for i, x in usable(rows)]
    want = []
    for at, (q, x) in enumerate(vectors):
        if q % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), c) for j, (c, y) in enumerate(vectors) if j != at)[:7]
            want += [(q, rank, c, -s) for rank, (s, c) in enumerate(scores, 1)]
    assert sorted(map(tuple, found)) == sorted(want)


def test_top_products_of_few_huge_and_mixed_vectors(spark):
    rows = [(0, [1e30, 1.0]), (10, [1e30, -1.0]), (1, [3.0]), (20, [2.0]), (2, [1e-9, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(r.query_id, r.vec_id): r.score for r in topk.top_products(df, every=10).collect()}
    assert found[0, 10] == 2**63 - 1 and found[20, 1] == 3 * 2 * 1024 * 1024
    assert set(found) == {(0, 10), (0, 2), (10, 0), (10, 2), (20, 1)}
    assert topk.top_products(spark.createDataFrame([], SCHEMA)).collect() == []


def test_multi_index_recall_and_scores(spark):
    rows = make(3000, 24, 4)
    found = multi_index.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), row_block=256, query_block=64).collect()
    vectors = usable(rows, zero=False)
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors])
    asked = [at for at, i in enumerate(ids) if i % 20 == 0]
    assert len(found) == 20 * len(asked)
    hits = 0
    for q in {int(ids[at]) for at in asked}:
        got = [r for r in found if r.query_id == q]
        rows_of_q = [at for at in asked if ids[at] == q]
        assert sorted(r.rank for r in got) == sorted(list(range(1, 21)) * len(rows_of_q))
        want, able = set(), set()
        for at in rows_of_q:
            scores = x @ x[at]
            want |= {(round(float(scores[i]), 9), int(ids[i])) for i in [i for i in np.lexsort((ids, -scores)) if i != at][:20]}
            able |= {(round(float(scores[i]), 9), int(ids[i])) for i in range(len(ids)) if i != at}
        answers = {(round(r.score, 9), r.vec_id) for r in got}
        assert answers <= able  # scores are exact
        hits += len(answers & want) / max(1, len(want))
        if len(rows_of_q) == 1:
            got.sort(key=lambda r: r.rank)
            assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
    assert hits / len({int(ids[at]) for at in asked}) >= 0.9


def test_multi_index_with_a_cell_that_holds_most_rows_and_with_few(spark):
    rows = [(i, [1.0, 0.0, 0.0, 0.001 * (i % 7)]) for i in range(600)] + [(600 + i, [0.0, 1.0, float(i), 0.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = multi_index.nearest(df, row_block=50).collect()
    assert {r.query_id for r in found} == set(range(0, 605, 20)) and len(found) == 31 * 20
    few = multi_index.nearest(df.filter("vec_id in (0, 3, 601)")).collect()
    assert {(r.query_id, r.vec_id) for r in few} == {(0, 3), (0, 601)}
    assert multi_index.nearest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_traversal_visits_cells_by_summed_distance():
    r = np.random.default_rng(0)
    index = multi_index.MultiIndex(r.standard_normal((6, 4)), r.standard_normal((5, 5)), 10.0)
    index.sizes[:] = 1
    q = r.standard_normal((3, 8))
    for x, cells in zip(q, index.traverse(q, np.inf)):
        a = multi_index.distances(x[None, :4], index.first)[0]
        b = multi_index.distances(np.r_[x[4:], 0][None], index.second)[0]
        sums = [a[i] + b[j] for i, j in cells]
        assert len(set(cells)) == 30 and sums == sorted(sums)


def test_lengths_keep_block_pairs_from_being_shipped(spark, monkeypatch):
    r = np.random.default_rng(1)
    x = r.standard_normal((2000, 8)) * (r.pareto(1.0, (2000, 1)) + 0.01)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    pairs = {}
    real = topk.surviving

    def seen(*args):
        later, spread = real(*args)
        pairs["queries"], pairs["rows"] = later.select("qb", "cb").distinct().count(), spread.select("qb", "cb").distinct().count()
        return later, spread

    monkeypatch.setattr(topk, "surviving", seen)
    found = topk.top_products(df, every=10, k=5, candidate_block=50, query_block=10)
    y = np.floor(x * 1024)
    scores = y[::10] @ y.T
    scores[np.arange(200), np.arange(0, 2000, 10)] = -np.inf
    want = {(10 * i, j + 1, int(o)) for i, s in enumerate(scores) for j, o in enumerate(np.lexsort((np.arange(2000), -s))[:5])}
    assert {(r.query_id, r["rank"], r.vec_id) for r in found.collect()} == want
    assert pairs["queries"] == pairs["rows"] < 0.5 * 20 * 39


def test_repeated_ids_and_rows_agree_with_the_sql(spark):
    import duckdb

    from vigil.llm.oracle import ORACLE

    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [5.0, 1.0]), (2, [0.5, 3.0]), (2, [0.5, 3.0]), (100, [2.0, 2.0]), (100, [2.0, 2.0]), (100, [-1.0, 4.0])]
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", rows)
    want = con.sql(ORACLE["op8_top_products"]).fetchall()
    found = topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, found)) == sorted(want) and len(want) == 28
