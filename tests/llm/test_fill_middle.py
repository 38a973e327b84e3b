"""op12: units, cuts, forms and outputs against a plain loop; texts come back from their outputs."""

import hashlib
import re

import pyarrow as pa
import pytest

from vigil.llm import fill_middle
from vigil.llm.common import text_slices

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_loop(doc_id, text, sentinels=("<P>", "<S>", "<M>"), rate=50, share=80, seed=42):
    text = text or ""
    tokens = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in sentinels) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    before, between, last = sentinels
    if h4 % 100 < share:
        return doc_id, n, "spm", len(p), len(m), between + s + before + p + last + m
    return doc_id, n, "psm", len(p), len(m), before + p + between + s + last + m


def key(row):
    return tuple((x is None, x) for x in row)


ODD = [
    "", " ", "\n\n\t", " lead", "trail \x0b\x0c ", "a\x00b c\x1cd", "nb sp wide　e", "emoji 👩‍👩‍👧 x", "has <P> inside",
    "almost < P> <S <M", "x", "<", "<S", "ends in <", "<M> alone", "ÿ ÿÿ ÿ", "tab\tand\rreturn",
]


def test_against_a_plain_loop(spark, docs, rows):
    texts = [(i, r[0], r[1]) for i, r in enumerate(rows)] + [(0, 1000 + 40 * k + j, t) for k, t in enumerate(ODD) for j in range(20)]
    table = spark.createDataFrame([(d, t) for _, d, t in texts], "doc_id long, text string").repartition(3)
    for rate, share in ((50, 80), (100, 50), (0, 80)):
        found = fill_middle.restore(fill_middle.fill_in_middle(table, rate=rate, spm_share=share)).collect()
        want = [plain_loop(d, t, rate=rate, share=share) for _, d, t in texts]
        assert sorted((tuple(r)[:6] for r in found), key=key) == sorted(want, key=key)
        by_id = {d: t or "" for _, d, t in texts if d is not None}
        assert all(r.restored == by_id[r.doc_id] for r in found if r.doc_id is not None)
        assert {r.form for r in found} == ({"plain"} if rate == 0 else {"plain", "spm", "psm"})


def test_empty_and_extra_columns(spark, docs, no_docs, rows):
    assert fill_middle.fill_in_middle_digests(no_docs).collect() == []
    assert fill_middle.fill_in_middle_digests(docs).count() == len(rows)


def test_own_sentinels(spark):
    table = spark.createDataFrame([(i, f"one two {i} <P> three\n") for i in range(40)], "doc_id long, text string")
    own = ("␟pre", "␟suf", "␟mid")
    found = fill_middle.restore(fill_middle.fill_in_middle(table, sentinels=own, rate=100), own).collect()
    assert {r.form for r in found} == {"spm", "psm"}
    assert all(r.restored == f"one two {r.doc_id} <P> three\n" for r in found)
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(table, sentinels=("aa", "b", "c"))


def test_slices_hold_every_row():
    texts = ["x" * 10, None, "", "y" * 100, "z", "é" * 30, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["doc_id", "text"])
    parts = list(text_slices(batch, size=25))
    assert [t for _, part in parts for t in part.to_pylist()] == [t or "" for t in texts]
    assert [i for part, _ in parts for i in part.column("doc_id").to_pylist()] == list(range(7))
    assert all(len(part) == 1 or sum(len(t.encode()) for t in part.to_pylist()) <= 25 for _, part in parts)
