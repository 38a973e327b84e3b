"""Differential test: compiled predicates vs a pure-Python evaluator of the
reference's rules (with decision D20) on random rows and random trees."""

import json
import random

import pytest

from helpers import BASE_NS, logs_df
from vigil.functions.model import LEVELS
from vigil.operators.predicates import OPS, And, Cond, Or, compile_predicate, parse_rfc3339_ns

EPS = 2.220446049250313e-16
TEXT = ("=", "!=", "contains", "starts_with", "ends_with")
ORDER = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
         "=": lambda a, b: a == b, "!=": lambda a, b: a != b}


def text_op(value, op, lit):
    a, b = value.lower(), lit.lower()
    if op == "=":
        return a == b
    if op == "!=":
        return a != b
    if op == "contains":
        return b in a
    if op == "starts_with":
        return a.startswith(b)
    if op == "ends_with":
        return a.endswith(b)
    return ORDER[op](value, lit)


def is_int(v):
    return isinstance(v, int) and not isinstance(v, bool)


def evaluate(p, row):
    if isinstance(p, And):
        return evaluate(p.left, row) and evaluate(p.right, row)
    if isinstance(p, Or):
        return evaluate(p.left, row) or evaluate(p.right, row)
    field, op, v = p.field.lower(), p.op, p.value
    if field == "level":
        if not isinstance(v, str):
            return False
        if op in TEXT:
            return text_op(row["level"], op, v.lower())
        if v.lower() not in LEVELS:
            return False
        return ORDER[op](LEVELS.index(row["level"]), LEVELS.index(v.lower()))
    if field in ("service", "message"):
        return isinstance(v, str) and text_op(row[field], op, v)
    if field in ("trace_id", "span_id"):
        if row[field] is None:
            return (isinstance(v, str) and v == "") or op == "!="
        return isinstance(v, str) and text_op(row[field], op, v)
    if field == "timestamp":
        if op not in ORDER:
            return False
        if is_int(v):
            lit = v * 1_000_000_000
        elif isinstance(v, str):
            lit = parse_rfc3339_ns(v)
            if lit is None:
                return False
        else:
            return False
        return ORDER[op](row["ts_ns"], lit)
    attrs = row["attrs"]
    if p.field not in attrs:
        return op == "!="
    a = attrs[p.field]
    if isinstance(v, bool):
        return isinstance(a, bool) and op in ("=", "!=") and ORDER[op](a, v)
    if is_int(v):
        return is_int(a) and op in ORDER and ORDER[op](a, v)
    if isinstance(v, float):
        if isinstance(a, bool) or not isinstance(a, (int, float)) or op not in ORDER:
            return False
        if op == "=":
            return abs(a - v) < EPS
        if op == "!=":
            return abs(a - v) >= EPS
        return ORDER[op](float(a), v)
    if isinstance(v, str):
        return isinstance(a, str) and text_op(a, op, v)
    return False


WORDS = ["Error", "error", "Disk", "full", "User", "login", "OK", "ms", "timeout"]
ATTR_VALUES = [0, 1, 5, 42, -3, 0.5, 2.0, 1.25, -0.75, "abc", "ABC", "Zeta", "", True, False]
LITERALS = {
    "text": ["error", "ERROR", "disk", "ms", "", "user login", "Zeta", "abc", "svc-1", "t-1", "a"],
    "num": [0, 1, 5, 42, -3, 0.5, 2.0, 1.25, 100],
    "bool": [True, False],
    "ts": ["2023-11-14T22:13:25Z", "2023-11-14T22:13:40.5+00:00", "bad", BASE_NS // 10**9 + 7, 1.5],
    "level": list(LEVELS) + ["WARN", "Error", "verbose"],
}
FIELDS = ["level", "LEVEL", "service", "message", "trace_id", "span_id", "timestamp", "a", "b", "c", "missing"]


def random_rows(rnd, n=40):
    rows = []
    for i in range(n):
        attrs = {k: rnd.choice(ATTR_VALUES) for k in ("a", "b", "c") if rnd.random() < 0.7}
        rows.append(dict(
            level=rnd.choice(LEVELS), message=" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 4))),
            service=rnd.choice(["svc-1", "SVC-2", "api", "Zeta"]), attributes=attrs,
            trace_id=rnd.choice([None, "t-1", "T-2", ""]), span_id=rnd.choice([None, "s1", "a"]),
            ts_ns=BASE_NS + rnd.randint(0, 30) * 1_000_000_000,
        ))
    return rows


def random_cond(rnd):
    field = rnd.choice(FIELDS)
    if field.lower() == "level":
        pool = LITERALS["level"] + LITERALS["num"][:2]
    elif field == "timestamp":
        pool = LITERALS["ts"]
    else:
        pool = LITERALS["text"] + LITERALS["num"] + LITERALS["bool"]
    return Cond(field, rnd.choice(OPS), rnd.choice(pool))


def random_tree(rnd, depth=0):
    if depth >= 2 or rnd.random() < 0.5:
        return random_cond(rnd)
    node = And if rnd.random() < 0.5 else Or
    return node(random_tree(rnd, depth + 1), random_tree(rnd, depth + 1))


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_random_predicates_match_reference_rules(spark, seed):
    rnd = random.Random(seed)
    rows = random_rows(rnd)
    df = logs_df(spark, rows)
    preds = [random_tree(rnd) for _ in range(400)]
    got = df.select("log_id", *[compile_predicate(p).alias(f"p{i}") for i, p in enumerate(preds)]).collect()
    by_id = {r.log_id: r for r in got}
    for i, row in enumerate(rows):
        row = dict(row, attrs=json.loads(json.dumps(row["attributes"])))
        for j, p in enumerate(preds):
            assert by_id[i][f"p{j}"] == evaluate(p, row), (p, row)
