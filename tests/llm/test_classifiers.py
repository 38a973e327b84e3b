"""op4 and op6: held-out accuracy, labels of the held-out fold unused, odd rows."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import quality, toxicity
from vigil.llm.common import fold, fold_column, table
from vigil.llm.labels import least_hashes

SF = os.environ.get("VIGIL_LLM_SF", "/root/testdata/sf0.01")


def auc(scores, y):
    order = np.argsort(np.argsort(scores, kind="stable"))
    ranks = np.array([np.mean(order[scores == s]) for s in scores])
    p = y.sum()
    return (ranks[y == 1].sum() - p * (p - 1) / 2) / (p * (len(y) - p))


@pytest.fixture(scope="module")
def tables(spark):
    return table(spark, SF, "documents"), table(spark, SF, "labels")


@pytest.mark.parametrize("score,column,folds,held,least", [
    (toxicity.score_toxicity, "toxic", 3, 1, 0.85), (quality.score_quality, "quality", 5, 0, 0.97),
])
def test_held_out_accuracy_and_fold(tables, score, column, folds, held, least):
    docs, labels = tables
    found = {r.doc_id: r for r in score(docs, labels).collect()}
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % folds == held) and 0 <= r.score <= 1 for i, r in found.items())
    y = {r.doc_id: r[column] for r in labels.collect()}
    ids = [i for i in y if i in found and found[i].held_out]
    assert auc(np.array([found[i].score for i in ids]), np.array([y[i] for i in ids])) >= least
    # flipping the held-out labels changes nothing
    flipped = labels.withColumn(column, F.when(fold_column(folds) == held, 1 - F.col(column)).otherwise(F.col(column)))
    again = {r.doc_id: r.score for r in score(docs, flipped).collect()}
    assert all(abs(again[i] - found[i].score) < 1e-9 for i in found)


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_odd_rows_and_no_labels(spark, docs, rows, no_docs, tables, score):
    labels = spark.createDataFrame(
        [(i, i % 2, (i // 2) % 2) for i in range(100)] + [(1, None, None), (None, 1, 1), (2, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
    assert score(docs, labels).count() == len(rows)
    assert score(no_docs, labels).collect() == []
    assert score(docs, labels.limit(0)).count() == len(rows)


def test_fold_of_column_and_python(spark):
    df = spark.createDataFrame([(1,), (77,), (None,)], "doc_id long").withColumn("f", fold_column(5))
    assert all(r.f == fold(r.doc_id, 5) for r in df.collect())


@pytest.fixture(scope="module")
def model(spark, tables):
    return toxicity.character_model(tables[0])


def test_deobfuscation(model):
    for noisy, word in {
        "1d10t": "idiot", "l0s3r": "loser", "s.t.u.p.i.d": "stupid", "m0r0n": "moron", "tr@sh": "trash", "$cum": "scum", "cl0wn": "clown",
        "ídiot": "idiot", "stuuupid": "stupid",
    }.items():
        assert word in toxicity.restored_words(noisy, model), noisy
    assert "idiot" in toxicity.spelled_words("you i d i o t now", model)
    assert toxicity.restored_words("plain", model) == ["plain"]
    assert toxicity.restore("An 1d10t and a m0r0n", model) == "an idiot and a moron"


def test_character_model_counts_every_text(spark, tables):
    docs = spark.createDataFrame([(1, "ab ab"), (2, None), (3, "")], "doc_id long, text string")
    probabilities = np.exp(toxicity.character_model(docs))
    assert np.allclose(probabilities.sum(2), 1) and probabilities[0, 1].argmax() == 2


def test_statistics_are_finite():
    for text in ("", " ", "a", "\n\n", "!" * 100, "x " * 50_000, "\ud83d" + "é" * 10, "|" * 5):
        assert np.isfinite(quality.statistics(text)).all() and len(quality.statistics(text)) == len(quality.STATISTICS)


def test_discriminant_equals_direct_densities():
    r = np.random.default_rng(0)
    k = len(quality.STATISTICS)
    x = [r.standard_normal((80, k)), r.standard_normal((300, k)) * 2 + 1]
    model = quality.Discriminant(
        np.array([80.0, 300.0]), np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]), shrink=0.0, ridge=0.0
    )
    point = r.standard_normal((5, k))
    direct = []
    for v in x:
        c, d = np.cov(v.T), point - v.mean(0)
        direct.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    gap = direct[1] - direct[0] + np.log(301 / 81)
    assert np.allclose(model.difference(point), np.sign(gap) * np.log1p(np.abs(gap)), atol=1e-4)


def test_least_hashes_are_a_bounded_sample(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "id % 7 AS x").repartition(6)
    every = sorted((r.h, r.doc_id) for r in rows.selectExpr("shiftrightunsigned(xxhash64(doc_id), 1) AS h", "doc_id").collect())
    drawn = [r.doc_id for r in least_hashes(rows, 500, "doc_id").collect()]
    assert sorted(drawn) == sorted(i for _, i in every[:500])
    assert least_hashes(rows.limit(30), 500, "doc_id").count() == 30
    plan = least_hashes(rows, 500, "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan  # what the sort sees is bounded by the sample, not by the partitions
