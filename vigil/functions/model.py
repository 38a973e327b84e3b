"""Enumerations of the data model and their column helpers."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES — the reference's enumerations, in their declared order.
# ---------------------------------------------------------------------------
LEVELS = ("trace", "debug", "info", "warn", "error", "fatal")  # severity 0..5
DEFAULT_LEVEL = "info"
SPAN_KINDS = ("internal", "server", "client", "producer", "consumer")
DEFAULT_KIND = "internal"
SPAN_STATUSES = ("ok", "error", "cancelled")
DEFAULT_STATUS = "ok"
METRIC_TYPES = ("counter", "gauge", "histogram")
DEFAULT_METRIC_TYPE = "gauge"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def level_order(level: Column | str) -> Column:
    """Severity rank 0..5 of a lower-case level name; NULL when unknown."""
    table = F.create_map(*chain.from_iterable((F.lit(n), F.lit(i)) for i, n in enumerate(LEVELS)))
    return table[F.lower(_c(level))]


def decode_enum(col: Column | str, allowed: tuple[str, ...], default: str) -> Column:
    """Lower-case the value; anything outside ``allowed`` becomes ``default``."""
    low = F.lower(_c(col))
    return F.when(low.isin(*allowed), low).otherwise(F.lit(default))


def empty_to_null(col: Column | str) -> Column:
    """The stored ``''`` id means absent."""
    return F.nullif(_c(col), F.lit(""))


def labels_key(labels: Column | str) -> Column:
    """Canonical text of a label map — sorted ``k=v`` joined by ``,``.

    A backslash, comma or equals sign inside a key or value is written after a
    backslash, so different label sets never share a key.
    """
    def plain(c: Column) -> Column:
        return F.regexp_replace(c, r"([\\,=])", r"\\$1")

    entries = F.transform(F.map_entries(_c(labels)), lambda e: F.concat(plain(e["key"]), F.lit("="), plain(e["value"])))
    return F.array_join(F.array_sort(entries), ",")


def labels_hash(key: Column | str) -> Column:
    """N10 stand-in: a stable hash of the canonical label text."""
    return F.md5(_c(key))


def is_error_status(status: Column | str) -> Column:
    """Anything other than ``ok`` counts as an error."""
    return _c(status) != F.lit(DEFAULT_STATUS)


def is_root(parent_span_id: Column | str) -> Column:
    """A span without a parent is a root."""
    return _c(parent_span_id).isNull()


def attributes_as_text(attributes: Column | str) -> Column:
    """MAP<STRING, VARIANT> -> MAP<STRING, STRING> of compact JSON text (for export)."""
    return F.transform_values(_c(attributes), lambda _k, v: F.to_json(v))
