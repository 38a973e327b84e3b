"""op11: features, weights and the draw against a plain loop."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from vigil.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text, order):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1)]


def plain_loop(docs, target, order=1, buckets=10_000, share=(10, 100), least=20, seed=2024):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    ours = Counter(bucket(f) for _, t in docs for f in features(t, order)[1])
    theirs = Counter(bucket(f) for t in target for f in features(t, order)[1])
    s_all, t_all = sum(ours.values()), sum(theirs.values())

    def gain(b):
        return math.floor(1000 * math.log((theirs[b] + 1) * (s_all + buckets) / ((ours[b] + 1) * (t_all + buckets))))

    rows = []
    for doc_id, text in docs:
        words, found = features(text, order)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = len(fit) * share[0] // share[1]
    return rows, [(r[0], r[4]) for r in fit[:drawn]]


def key(row):
    return tuple((x is None, x) for x in row)


TARGET = ["The river runs north under old bridges", None, "", "naïve 日本語 42 x", "don't TURN the River"]


@pytest.mark.parametrize("order,buckets,share", [(1, 10_000, (10, 100)), (3, 997, (1, 2)), (2, 50, (1, 1))])
def test_against_a_plain_loop(spark, docs, rows, order, buckets, share):
    target = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TARGET)], "item_id long, text string, bucket int")
    got = resample.resample(docs, target, order=order, buckets=buckets, share=share).collect()
    want, drawn = plain_loop([r[:2] for r in rows], TARGET, order, buckets, share)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(map(tuple, want), key=key)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == drawn


def test_runs_line_up_over_rows():
    texts = pa.array(["a", "", "b c", "d e f g", "h", "i j k", "a b c d e"])
    for k, (crcs, index, rows) in enumerate(resample.runs(texts, 4), 1):
        want = [(i, " ".join(w[j : j + k])) for i, t in enumerate(texts.to_pylist()) for w in [t.split()] for j in range(len(w) - k + 1)]
        assert [(int(r), int(crcs[x])) for r, x in zip(rows, index)] == [(i, zlib.crc32(g.encode())) for i, g in want]
        assert len(set(crcs.tolist())) == len(crcs)


def test_empty_tables(spark, docs, no_docs, rows):
    target = spark.createDataFrame([(0, "the river")], "item_id long, text string")
    assert resample.resample(no_docs, target).collect() == []
    assert resample.resample(docs, target.limit(0)).count() == len(rows)


def test_one_id_in_most_rows(spark):
    table = spark.createDataFrame([(7, "w " * 30)] * 200 + [(i, "v " * 30) for i in range(20)], "doc_id long, text string")
    got = resample.resample(table, table, share=(1, 2)).collect()
    assert len(got) == 220 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 111))
