"""op3: every id in exactly one piece, no padding, sources in proportion."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from vigil.llm import packing

PATH = P.path("byte_bpe_50k.json")


def encode(text):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [0]


@pytest.fixture(scope="module")
def pieces(docs):
    return packing.pack_documents(docs, PATH, length=64, window=2048, grain=16, with_ids=True).collect()


def test_pieces_hold_every_id_once(rows, pieces):
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append(p)
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    want = defaultdict(list)
    for doc_id, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want[doc_id, len(ids)].append(ids)
    assert set(by_doc) == set(want)
    for key, lists in want.items():
        if len(lists) == 1:
            got = []
            for p in sorted(by_doc[key], key=lambda p: p.start):
                assert p.start == len(got)
                got += np.frombuffer(p.ids, "<u4").tolist()
            assert got == lists[0]
        assert sum(p.length for p in by_doc[key]) == sum(map(len, lists))
    for p in pieces:
        assert p.length == len(p.ids) // 4 and p.ids_crc32 == zlib.crc32(bytes(p.ids))


def test_sequences_are_full_and_gapless(pieces):
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    lengths = {}
    for s, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        lengths[s] = at
    assert sorted(lengths) == list(range(len(lengths)))
    short = [n for n in lengths.values() if n != 64]
    assert all(n & (n - 1) == 0 and n < 64 for n in short) and len(set(short)) == len(short)


def round_robin(totals, weights, window, grain):
    """The plain loop: (tokens served of each queue) after every window."""
    tokens, left, deficit, after = sum(totals), list(totals), [0] * len(totals), []
    windows = max(1, tokens // window)
    share, den, since = None, None, [0, [0] * len(totals)]
    while any(left):
        if weights is None:
            share, den = list(totals), windows
        else:
            now = [w if n else 0 for w, n in zip(weights, left)]
            now = now if any(now) else list(left)
            if share is None or [bool(x) for x in now] != [bool(x) for x in share]:  # a queue has run dry
                share, den, since = [window * x for x in now], sum(now), [0, [0] * len(totals)]
                extra = list(deficit)
        since[0] += 1
        for q, n in enumerate(left):
            if share[q]:
                earned = since[0] * share[q] // den  # what it has earned in all windows of these queues
                deficit[q] += earned - since[1][q]
                since[1][q] = earned
                give = n if deficit[q] >= n else deficit[q] // grain * grain
                left[q] -= give
                deficit[q] -= give
        after.append([t - n for t, n in zip(totals, left)])
    return after


CASES = [
    ([1000, 250, 3000, 17], None), ([1000, 250, 3000, 17], [1, 1, 1, 1]), ([1000, 250, 3000, 17], [5, 0, 1, 0]), ([64, 64], [3, 1]),
    ([1], [7]), ([5000, 1], [1, 1000]), ([900, 900, 900, 900, 900], [1, 2, 3, 4, 5]), ([100, 4096, 33], [0, 0, 9]), ([2048], None),
]


@pytest.mark.parametrize("totals,weights", CASES)
@pytest.mark.parametrize("window,grain", [(256, 16), (1000, 64), (100, 1)])
def test_the_schedule_equals_a_plain_round_robin(totals, weights, window, grain):
    schedule = packing.Schedule(totals, window, grain, weights)
    after = round_robin(totals, weights, window, grain)
    assert schedule.windows == len(after)
    before = [0] * len(totals)
    for k, now in enumerate(after):
        assert [schedule.served(k, q) for q in range(len(totals))] == before == schedule.all_served(k).tolist(), k
        for q in range(len(totals)):
            assert all(schedule.window_of(q, x) == k for x in range(before[q], now[q]))
        before = now
    assert before == totals


def test_windows_hold_the_target_shares_until_a_source_runs_dry(spark):
    text = "one two three four five six seven eight nine ten " * 4
    docs = spark.range(400).selectExpr("id doc_id", f"'{text}' text", "case when id % 4 = 0 then 'a' when id % 4 = 1 then null else 'b' end source")
    found = packing.pack_documents(docs, PATH, length=64, window=2048, grain=16, targets={"a": 0.5, None: 0.25, "b": 0.25}).collect()
    assert sum(p.length for p in found) == 400 * len(encode(text)) and {p.doc_id for p in found} == set(range(400))
    per_doc = len(encode(text))
    until = 100 * per_doc * 2  # source a, of 100 documents and half of every window, runs dry here
    head = [p for p in found if p.sequence_id * 64 + p.offset < until // 2]
    size = sum(p.length for p in head)
    share = {q: sum(p.length for p in head if p.queue == q) / size for q in ("sa", "", "sb")}
    assert abs(share["sa"] - 0.5) < 0.03 and abs(share[""] - 0.25) < 0.03 and abs(share["sb"] - 0.25) < 0.03
    with pytest.raises(ValueError):
        packing.pack_documents(docs, PATH, targets={"a": -1.0})


def test_empty_table(no_docs):
    assert packing.pack_documents(no_docs, PATH).collect() == []


def test_three_thousand_sources_have_a_queue_each(spark):
    docs = spark.range(6000).selectExpr("id doc_id", "concat('text ', id) text", "concat('s', case when id < 2000 then 0 else id % 3000 end) source")
    found = packing.pack_documents(docs, PATH, length=64, window=4096, grain=1).collect()
    lengths = {i: len(encode(f"text {i}")) for i in range(0, 6000, 97)}
    got = defaultdict(int)
    for p in found:
        got[p.doc_id] += p.length
    assert len({p.queue for p in found}) == 3000 and len(got) == 6000 and all(got[i] == n for i, n in lengths.items())
    # every source has what it is owed after every window, to within a grain
    totals = defaultdict(int)
    for p in found:
        totals[p.queue] += p.length
    counts = [totals[q] for q in sorted(totals)]
    schedule = packing.Schedule(counts, 4096, 1)
    for k in range(schedule.windows + 1):
        served = schedule.all_served(k)
        assert all(0 <= k * t / schedule.windows - s < 1 for s, t in zip(served.tolist(), counts))
