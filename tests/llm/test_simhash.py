"""op2: fingerprints, links and components equal brute force; the threshold programme is optimal."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vigil.llm import simhash
from vigil.llm.components import connected


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(pairs, prints, distance=2):
    """pairs: (doc_id, print); returns the least doc_id reachable for each position."""
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(pairs)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= distance:
            root[find(i)] = find(j)
    least = {}
    for i, doc_id in enumerate(pairs):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [least.get(find(i)) for i in range(len(pairs))]


def test_documents(docs, rows):
    found = simhash.near_duplicates(docs).collect()
    prints = [brute_fingerprint(r[1]) for r in rows]
    want = zip([r[0] for r in rows], [f"{p:016x}" for p in prints], brute_components([r[0] for r in rows], prints))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("distance,partitions", [(2, 2), (2, 3), (3, 4), (1, 2)])
def test_links_equal_brute_force_in_dense_and_skewed_sets(spark, distance, partitions):
    r = random.Random(distance * 10 + partitions)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):  # dense groups around centres, some sharing a half
        centre = r.getrandbits(64) if r.random() < 0.6 else r.getrandbits(32) | 0xABCDEF << 32
        for _ in range(25):
            x = centre
            for b in r.sample(range(64 if r.random() < 0.5 else 12), r.randint(0, 4)):
                x ^= 1 << b
            prints.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    df = spark.createDataFrame([(x,) for x in signed], "print long")
    found = {tuple(x) for x in simhash.near_links(df, distance, partitions).distinct().collect()}
    want = {(a, b) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= distance}
    assert found == want


def test_thresholds_are_the_cheapest_of_all():
    r = np.random.default_rng(1)
    for parts, distance in ((2, 2), (3, 2), (4, 3)):
        counts = r.integers(1, 1000, size=(50, parts)).astype(float)
        balls = np.array([[1, 20, 200, 1500][: distance + 1]] * parts, dtype=float)
        chosen, cost = simhash.thresholds(counts, balls, distance)
        for row in range(50):
            options = [t for t in itertools.product(range(-1, distance + 1), repeat=parts) if sum(t) == distance - parts + 1]
            costs = [sum(0 if t < 0 else balls[i, t] * counts[row, i] for i, t in enumerate(o)) for o in options]
            assert cost[row] == min(costs)
            assert sum(chosen[row]) == distance - parts + 1


def test_correlated_bits_share_a_group():
    r = np.random.default_rng(2)
    x = r.random((500, 64)) < 0.5
    x[:, 40:50] = x[:, [3]]
    x = x.astype(float)
    groups = simhash.correlated_groups(500, (x.T @ x).astype(int), 2)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert any({3, *range(40, 50)} <= set(g) for g in groups)


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (201, 200)]
    random.Random(3).shuffle(links)
    found = connected(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(found) == len({r.node for r in found})
    assert {(r.node, r.root) for r in found} == {
        *((i, 0) for i in range(41)), *((i, 100) for i in range(100, 140)), *((i, 200) for i in (200, 201, 202))
    }
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_keep_one_of_each(docs, rows, no_docs):
    kept = simhash.keep_one_of_each(docs).collect()
    prints = [brute_fingerprint(r[1]) for r in rows]
    groups = {}
    for r, p in zip(rows, prints):
        groups.setdefault(p, []).append(r)
    assert kept[0].__fields__ == docs.columns
    assert len(kept) <= len(groups) and len({k.doc_id for k in kept}) == len(kept)
    parts = brute_components(range(len(rows)), prints)
    assert len(kept) == len(set(parts))
    assert simhash.keep_one_of_each(no_docs).collect() == []
