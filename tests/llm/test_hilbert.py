"""op7: the curve is a Hilbert curve, counts differ by one at most, slots have no gaps."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vigil.llm import hilbert


@pytest.mark.parametrize("n,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(spark, n, bits):
    cells = spark.range(1 << (n * bits)).select(
        *[((F.col("id") / (1 << (bits * j))).cast("long") % (1 << bits)).alias(f"d{j}") for j in range(n)]
    )
    found = cells.withColumn("h", hilbert.curve_index([F.col(f"d{j}") for j in range(n)], bits)).orderBy("h").collect()
    assert [r.h for r in found] == list(range(1 << (n * bits)))
    for a, b in zip(found, found[1:]):
        assert sum(abs(a[f"d{j}"] - b[f"d{j}"]) for j in range(n)) == 1


def test_shards(docs, rows):
    found = hilbert.shard_documents(docs).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == want
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(slots) <= set(range(16))
    counts = [len(slots[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # shards are runs of the curve
    order = sorted(found, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in found)


def test_fewer_rows_than_shards_and_none(spark, docs, no_docs):
    assert hilbert.shard_documents(no_docs).collect() == []
    few = hilbert.shard_documents(docs.limit(5)).collect()
    assert len(few) == 5 and max(Counter(r.shard for r in few).values()) == 1


def test_native_plan(docs):
    plan = hilbert.shard_documents(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_written_shards_hold_every_row(spark, docs, rows, tmp_dir):
    hilbert.write_shards(docs, f"{tmp_dir}/shards", 4)
    back = spark.read.parquet(f"{tmp_dir}/shards")
    assert Counter((r.doc_id, r.text, r.score) for r in back.collect()) == Counter((r[0], r[1], "s") for r in rows)
    assert back.filter("shard >= 4").count() == 0


def test_an_outlying_id_leaves_the_others_apart(spark):
    rows = [(i, "text", "en", "s") for i in range(600)] + [(1 << 60, "text", "en", "s"), (-(1 << 60), "text", "en", "s"), (None, "text", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    edges = hilbert.quantile_edges(docs, "doc_id")
    steps = {r.doc_id: r.s for r in docs.select("doc_id", hilbert.quantile_step(F.col("doc_id"), edges).alias("s")).collect()}
    assert len({steps[i] for i in range(600)}) > 200 and steps[None] == 0 and max(steps.values()) < 256
    found = hilbert.shard_documents(docs).collect()
    assert len(found) == 603 and len({r.curve for r in found}) > 200
    assert hilbert.quantile_edges(docs.limit(0), "doc_id") == []
