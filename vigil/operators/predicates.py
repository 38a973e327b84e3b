"""Structured log predicates compiled to one Catalyst ``Column``.

There is no text parser: callers build ``Cond`` / ``And`` / ``Or`` values
(or write Spark SQL against the registered views). The compiled expression
follows the reference's two-valued semantics:

* string fields (service, message, trace_id, span_id): ``= != contains
  starts_with ends_with`` are case-insensitive; ``< <= > >=`` are
  case-sensitive code-point order (D19);
* level: names compare as text, ``< <= > >=`` by severity; unknown name FALSE;
* timestamp: RFC 3339 text or integer epoch seconds; other ops FALSE;
* any other field name is an attribute key (case-sensitive, dots allowed):
  typed compare by the attribute's JSON type (D21/D22); string ordering ops
  use real ordering (D20);
* a missing field is TRUE for ``!=`` and FALSE otherwise (D18); a missing
  trace_id/span_id also matches any operator when the literal is ``''``;
* a literal of the wrong type is FALSE, even for ``!=``.

There is no NOT, so a NULL leaf acts as FALSE wherever the tree filters rows:
:func:`where_` uses bare comparisons, which the scan can take, and adds the
``dt`` bounds that follow from a timestamp condition. :func:`compile_predicate`
gives the same condition as a value that is never NULL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.model import LEVELS
from vigil.functions.timefn import RFC3339

OPS = ("=", "!=", "<", "<=", ">", ">=", "contains", "starts_with", "ends_with")
_TEXT_OPS = ("=", "!=", "contains", "starts_with", "ends_with")
_ORDER_OPS = ("<", "<=", ">", ">=")
FLOAT_EPSILON = 2.220446049250313e-16  # f64::EPSILON
_RFC3339 = re.compile(RFC3339, re.ASCII)
_LEAST_NS, _MOST_NS = -(1 << 63), (1 << 63) - 1
# FIXED VALUES: the first and last epoch second of the reference's date type; a literal beyond is no time
LEAST_SECOND, MOST_SECOND = -8334601228800, 8210266876799
_INT_TYPES = ("BIGINT", "INT", "SMALLINT", "TINYINT")


@dataclass(frozen=True)
class Cond:
    field: str
    op: str
    value: str | int | float | bool

    def __post_init__(self) -> None:
        if self.op not in OPS:
            raise ValueError(f"unknown operator {self.op!r}; expected one of {OPS}")

    def __and__(self, other: Pred) -> And:
        return And(self, other)

    def __or__(self, other: Pred) -> Or:
        return Or(self, other)


@dataclass(frozen=True)
class And:
    left: Pred
    right: Pred

    def __and__(self, other: Pred) -> And:
        return And(self, other)

    def __or__(self, other: Pred) -> Or:
        return Or(self, other)


@dataclass(frozen=True)
class Or:
    left: Pred
    right: Pred

    def __and__(self, other: Pred) -> And:
        return And(self, other)

    def __or__(self, other: Pred) -> Or:
        return Or(self, other)


Pred = Cond | And | Or


def _false() -> Column:
    return F.lit(False)


def _is_str(v: object) -> bool:
    return isinstance(v, str)


def _is_int(v: object) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


def _is_float(v: object) -> bool:
    return isinstance(v, float)


def _text_compare(col: Column, op: str, value: str) -> Column:
    """F1–F5 on a non-null string column."""
    low, lit_low = F.lower(col), F.lower(F.lit(value))
    if op == "=":
        return low == lit_low
    if op == "!=":
        return low != lit_low
    if op == "contains":
        return low.contains(lit_low)
    if op == "starts_with":
        return low.startswith(lit_low)
    if op == "ends_with":
        return low.endswith(lit_low)
    return _ordered(col, op, F.lit(value))


def _ordered(col: Column, op: str, lit: Column) -> Column:
    return {"<": col < lit, "<=": col <= lit, ">": col > lit, ">=": col >= lit, "=": col == lit, "!=": col != lit}[op]


def _string_field(col: Column, cond: Cond, nullable: bool) -> Column:
    # A present value needs a string literal; the missing-id rule below does not.
    test = _text_compare(col, cond.op, cond.value) if _is_str(cond.value) else _false()
    when_missing = nullable and (cond.value == "" or cond.op == "!=")
    return col.isNull() | test if when_missing else test


def _level(cond: Cond) -> Column:
    """F6/F7. Stored levels are canonical lower case, so ``=`` and the severity order are plain value tests."""
    if not _is_str(cond.value):
        return _false()
    wanted, level = cond.value.lower(), F.col("level")
    if cond.op == "=":
        return level == F.lit(wanted)
    if cond.op == "!=":
        return level != F.lit(wanted)
    if cond.op in _TEXT_OPS:
        return _text_compare(level, cond.op, wanted)
    if wanted not in LEVELS:
        return _false()
    rank = LEVELS.index(wanted)
    within = {"<": LEVELS[:rank], "<=": LEVELS[: rank + 1], ">": LEVELS[rank + 1 :], ">=": LEVELS[rank:]}[cond.op]
    return level.isin(*within) if within else _false()


def parse_rfc3339_ns(text: str) -> int | None:
    """RFC 3339 text -> epoch nanoseconds; None when it does not parse."""
    if not _RFC3339.match(text):
        return None
    head, frac_ns = text, 0
    m = re.search(r"\.(\d+)", text)
    if m:
        digits = m.group(1)
        frac_ns = int((digits + "000000000")[:9])
        head = text[: m.start()] + text[m.end():]
    head = head.replace("z", "Z").replace("t", "T").replace(" ", "T")
    if head.endswith("Z"):
        head = head[:-1] + "+00:00"
    try:
        dt = datetime.fromisoformat(head)
    except ValueError:
        return None
    return int(dt.timestamp()) * 1_000_000_000 + frac_ns


def _timestamp(cond: Cond, date_col: str | None) -> Column:
    """F8/F9 — compared at nanosecond precision on ``timestamp_ns``; ``date_col`` gets the day bound that follows."""
    if cond.op not in ("=", "!=", *_ORDER_OPS):
        return _false()
    if _is_str(cond.value):
        ns = parse_rfc3339_ns(cond.value)
    elif _is_int(cond.value) and LEAST_SECOND <= cond.value <= MOST_SECOND:
        ns = cond.value * 1_000_000_000
    else:
        ns = None
    if ns is None:
        return _false()
    if not _LEAST_NS <= ns <= _MOST_NS:
        # before or after every time that a row can have
        holds = cond.op in (("!=", "<", "<=") if ns > 0 else ("!=", ">", ">="))
        return F.col("timestamp_ns").isNotNull() if holds else _false()
    test = _ordered(F.col("timestamp_ns"), cond.op, F.lit(ns))
    if date_col is None or cond.op == "!=":
        return test
    day_op = {"<": "<=", ">": ">="}.get(cond.op, cond.op)
    return test & _ordered(F.col(date_col), day_op, F.to_date(F.timestamp_micros(F.lit(ns // 1000))))


def _attribute(cond: Cond) -> Column:
    """F10–F14 on ``attributes[field]`` (a VARIANT)."""
    attr = F.col("attributes")[cond.field]
    kind = F.schema_of_variant(attr)
    v, op = cond.value, cond.op
    if isinstance(v, bool):
        if op not in ("=", "!="):
            return _guard_missing(attr, op, _false())
        test = (kind == "BOOLEAN") & _ordered(F.try_variant_get(attr, "$", "boolean"), op, F.lit(v))
    elif _is_int(v):
        if op not in ("=", "!=", *_ORDER_OPS):
            return _guard_missing(attr, op, _false())
        test = kind.isin(*_INT_TYPES) & _ordered(F.try_variant_get(attr, "$", "bigint"), op, F.lit(v))
    elif _is_float(v):
        if op not in ("=", "!=", *_ORDER_OPS):
            return _guard_missing(attr, op, _false())
        num = F.try_variant_get(attr, "$", "double")
        is_number = kind.isin(*_INT_TYPES, "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        if op == "=":
            cmp = F.abs(num - F.lit(v)) < F.lit(FLOAT_EPSILON)
        elif op == "!=":
            cmp = F.abs(num - F.lit(v)) >= F.lit(FLOAT_EPSILON)
        else:
            cmp = _ordered(num, op, F.lit(v))
        test = is_number & cmp
    elif _is_str(v):
        text = F.try_variant_get(attr, "$", "string")
        test = (kind == "STRING") & _text_compare(text, op, v)
    else:
        test = _false()
    return _guard_missing(attr, op, F.coalesce(test, _false()))


def _guard_missing(attr: Column, op: str, present: Column) -> Column:
    return F.when(attr.isNull(), F.lit(op == "!=")).otherwise(present)


def compile_predicate(pred: Pred) -> Column:
    """Compile a predicate tree to one boolean Column (never NULL)."""
    return F.coalesce(_condition(pred, None), _false())


def _condition(pred: Pred, date_col: str | None) -> Column:
    """The tree as a filter condition: NULL where a field is missing, which a filter takes as FALSE."""
    if isinstance(pred, And):
        return _condition(pred.left, date_col) & _condition(pred.right, date_col)
    if isinstance(pred, Or):
        return _condition(pred.left, date_col) | _condition(pred.right, date_col)
    field = pred.field.lower()
    if field == "level":
        return _level(pred)
    if field in ("service", "message"):
        return _string_field(F.col(field), pred, nullable=False)
    if field in ("trace_id", "span_id"):
        return _string_field(F.col(field), pred, nullable=True)
    if field == "timestamp":
        return _timestamp(pred, date_col)
    return _attribute(pred)


def all_of(*preds: Pred) -> Pred:
    return reduce(And, preds)


def any_of(*preds: Pred) -> Pred:
    return reduce(Or, preds)


def where_(df: DataFrame, pred: Pred | None) -> DataFrame:
    """Filter a logs frame by a predicate tree (F15: AND binds tighter — build it so)."""
    if pred is None:
        return df
    return df.where(_condition(pred, "dt" if "dt" in df.columns else None))
