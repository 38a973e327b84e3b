"""Scalar column functions."""

from vigil.functions.normalize import normalize_message, register_normalize_function
from vigil.functions.timefn import bucket_start, ns_to_ts, ts_to_ns

__all__ = ["bucket_start", "normalize_message", "ns_to_ts", "register_normalize_function", "ts_to_ns"]
