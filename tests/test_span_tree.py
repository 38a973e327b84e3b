"""Trees against a plain walk; chains, hubs, orphans, cycles, repeated spans."""

import random

import pytest
from helpers import BASE_NS, spans_df

from vigil.operators import span_tree


def walk(rows):
    """(root, depth, subtree spans, subtree ns, on the critical path) of every span by plain recursion; None in cycles."""
    by_id = {(r["trace_id"], r["span_id"]): r for r in rows}
    parent = {k: (k[0], r.get("parent_span_id")) if (k[0], r.get("parent_span_id")) in by_id else None for k, r in by_id.items()}
    end = {k: r["start_ns"] + r.get("duration_ms", 0) * 1_000_000 for k, r in by_id.items()}
    children = {}
    for k, p in parent.items():
        children.setdefault(p, []).append(k)
    out = {k: (None,) * 5 for k in by_id}
    for root in children.get(None, []):
        order, stack = [], [(root, 0, True)]
        while stack:
            k, depth, critical = stack.pop()
            order.append(k)
            below = children.get(k, [])
            last = max(below, key=lambda c: (end[c], c[1]), default=None)
            out[k] = [root[1], depth, 1, by_id[k].get("duration_ms", 0) * 1_000_000, critical]
            stack += [(c, depth + 1, critical and c == last) for c in below]
        for k in reversed(order):
            if parent[k] is not None:
                out[parent[k]][2] += out[k][2]
                out[parent[k]][3] += out[k][3]
    return {k: tuple(v) for k, v in out.items()}


def check(spark, rows):
    found = {(r.trace_id, r.span_id): r for r in span_tree.whole_tree(spans_df(spark, rows).repartition(4)).collect()}
    want = walk(rows)
    assert found.keys() == want.keys()
    for k, w in want.items():
        r = found[k]
        assert (r.root_span_id, r.depth, r.subtree_spans, r.subtree_ns, r.on_critical_path) == w, k
        assert r.in_cycle == (w[0] is None)
    return found


def test_random_forests(spark):
    r = random.Random(2)
    rows = []
    for t in range(25):
        n = r.randint(1, 40)
        for i in range(n):
            parent = None if i == 0 or r.random() < 0.05 else f"s{r.randrange(i)}" if r.random() < 0.9 else "missing"
            rows.append(dict(trace_id=f"t{t}", span_id=f"s{i}", parent_span_id=parent, start_ns=BASE_NS + r.randrange(50), duration_ms=r.randrange(9)))
    for t, cycle in (("c1", ["a"]), ("c2", ["a", "b", "c"])):  # spans in and below cycles, beside a tree
        rows += [dict(trace_id=t, span_id=x, parent_span_id=cycle[i - 1], start_ns=BASE_NS) for i, x in enumerate(cycle)]
        rows += [dict(trace_id=t, span_id="below", parent_span_id="a", start_ns=BASE_NS), dict(trace_id=t, span_id="root", start_ns=BASE_NS, duration_ms=1)]
    check(spark, rows)


def test_a_chain_of_ten_thousand_spans(spark):
    n = 10_000
    rows = [dict(trace_id="t", span_id=f"{i}", parent_span_id=f"{i - 1}" if i else None, start_ns=BASE_NS + i, duration_ms=1) for i in range(n)]
    found = span_tree.whole_tree(spans_df(spark, rows).repartition(4)).collect()
    assert all((r.depth, r.subtree_spans, r.root_span_id) == (int(r.span_id), n - int(r.span_id), "0") for r in found) and len(found) == n


@pytest.mark.parametrize("chunks", [span_tree.CHUNKS, 3])
def test_a_hub_with_many_children(spark, chunks, monkeypatch):
    monkeypatch.setattr(span_tree, "CHUNKS", chunks)
    rows = [dict(trace_id="t", span_id="hub", start_ns=BASE_NS, duration_ms=5)]
    rows += [dict(trace_id="t", span_id=f"c{i}", parent_span_id="hub", start_ns=BASE_NS + i % 7, duration_ms=i % 11) for i in range(900)]
    rows += [dict(trace_id="t", span_id=f"g{i}", parent_span_id=f"c{i}", start_ns=BASE_NS, duration_ms=1) for i in range(0, 900, 9)]
    check(spark, rows)


def test_repeated_spans_and_empty_tables(spark):
    row = dict(trace_id="t", span_id="a", start_ns=BASE_NS, duration_ms=2)
    assert span_tree.whole_tree(spans_df(spark, [row, row])).count() == 1
    assert span_tree.whole_tree(spans_df(spark, [row]).limit(0)).collect() == []
