"""N1 — log-message normalisation into a pattern.

The rewrite is an ordered fold of ``regexp_replace`` over the message, so it
stays a native Catalyst expression inside whole-stage codegen (no Python UDF).
It runs in the projection under the partial aggregate, i.e. map-side, before
any shuffle keyed by the pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the reference's normalisation rules exactly.
# (step, placeholder name, RE2-syntax pattern, replacement), applied in order.
# ---------------------------------------------------------------------------
NORMALIZATION_RULES: tuple[tuple[str, str, str], ...] = (
    ("TIMESTAMP", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{3,9})?(?:Z|[+-]\d{2}:\d{2})?", "<TIMESTAMP>"),
    ("UUID", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    ("IPV4", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>"),
    ("IPV6", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", "<IPv6>"),
    ("HEX", r"\b0x[0-9a-fA-F]+\b", "<HEX>"),
    ("URL", r"https?://[\w./?=&-]+", "<URL>"),
    ("EMAIL", r"\b[\w.-]+@[\w.-]+\.\w{2,}\b", "<EMAIL>"),
    ("PATH", r"(?:^|\s)(\./|/)[\w./-]+", " <PATH>"),
    ("FLOAT", r"\b-?\d+\.\d+", "<NUM>"),
    ("INT", r"\b-?\d+", "<NUM>"),
)

# The rules above are RE2 patterns, where ``\b`` is an ASCII word boundary.
# On JDK 17 ``\b`` also treats non-ASCII letters as word characters ("é5"
# would keep its digit), so Spark (java.util.regex) runs the equivalent forms
# below. Each ``\b`` sits next to an atom of known class, so it reduces to one
# test on the neighbouring character: a rule starts by matching its first
# character and then checks the character before it with a fixed-length
# lookbehind (cheap to reject at most positions); a trailing ``\b`` after a
# word character becomes ``(?!W)``; ``\s`` is spelled as RE2's set (no
# vertical tab). ``[\w.-]*+`` before ``@`` is possessive:
# its class cannot match ``@``, so giving characters back never helps.
# Equivalence is checked against DuckDB (RE2) on the golden cases and on every
# document of the test tables (tests/test_normalize.py, q_normalize_documents).
_W = "[A-Za-z0-9_]"
_END = f"(?!{_W})"
_SIGNED_DIGIT = f"(?:-(?<={_W}-)\\d|\\d(?<!{_W}\\d))"  # \b-?\d as "first digit" form
JAVA_PATTERNS: dict[str, str] = {
    "TIMESTAMP": NORMALIZATION_RULES[0][1],
    "UUID": f"[0-9a-fA-F](?<!{_W}[0-9a-fA-F])[0-9a-fA-F]{{7}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}{_END}",
    "IPV4": f"\\d(?<!{_W}\\d)\\d{{0,2}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}{_END}",
    "IPV6": f"[0-9a-fA-F](?<!{_W}[0-9a-fA-F])[0-9a-fA-F]{{0,3}}:(?:[0-9a-fA-F]{{1,4}}:){{6}}[0-9a-fA-F]{{1,4}}{_END}",
    "HEX": f"0(?<!{_W}0)x[0-9a-fA-F]+{_END}",
    "URL": NORMALIZATION_RULES[5][1],
    "EMAIL": f"(?:{_W}(?<!{_W}{_W})|[.-](?<={_W}[.-]))[\\w.-]*+@[\\w.-]+\\.\\w{{2,}}{_END}",
    "PATH": "(?:^|[\\t\\n\\f\\r ])(\\./|/)[\\w./-]+",  # RE2's \\s has no \\x0B
    "FLOAT": f"{_SIGNED_DIGIT}\\d*\\.\\d+",
    "INT": f"{_SIGNED_DIGIT}\\d*",
}

JAVA_RULES: tuple[tuple[str, str, str], ...] = tuple(
    (name, JAVA_PATTERNS[name], repl) for name, _, repl in NORMALIZATION_RULES
)


# A match of each of these rules must contain the given literal, and no
# replacement text contains any of them — so if the original message has none
# of the literals, those seven rules are the identity at every step and only
# the IPV4 / FLOAT / INT rules need to run — and those only if there is a
# digit. (Most prose has none of them.)
RULE_LITERALS = {"TIMESTAMP": ":", "UUID": "-", "IPV6": ":", "HEX": "0x", "URL": ":", "EMAIL": "@", "PATH": "/"}


def _fold(col: Column, rules) -> Column:
    for _, pattern, repl in rules:
        col = F.regexp_replace(col, F.lit(pattern), F.lit(repl))
    return col


def normalize_message(message: Column | str) -> Column:
    """Column expression: the normalised pattern of ``message``."""
    col = F.col(message) if isinstance(message, str) else message
    short = [r for r in JAVA_RULES if r[0] not in RULE_LITERALS]
    needs_all = None
    for literal in sorted(set(RULE_LITERALS.values())):
        has = F.instr(col, literal) > 0
        needs_all = has if needs_all is None else needs_all | has
    # The remaining rules (IPV4, FLOAT, INT) each need a digit: without one the
    # message is already its own pattern.
    return (
        F.when(needs_all, _fold(col, JAVA_RULES))
        .when(col.rlike("[0-9]"), _fold(col, short))
        .otherwise(col)
    )


def normalize_sql(arg: str = "msg") -> str:
    """The same expression as Spark SQL text over ``arg``."""

    def fold(rules) -> str:
        expr = arg
        for _, pattern, repl in rules:
            quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
            expr = f"regexp_replace({expr}, '{quoted}', '{repl}')"
        return expr

    short = [r for r in JAVA_RULES if r[0] not in RULE_LITERALS]
    cond = " or ".join(f"instr({arg}, '{lit}') > 0" for lit in sorted(set(RULE_LITERALS.values())))
    return f"case when {cond} then {fold(JAVA_RULES)} when {arg} rlike '[0-9]' then {fold(short)} else {arg} end"


def register_normalize_function(spark: SparkSession, name: str = "normalize_log_message") -> str:
    """Register N1 as a session SQL function so SQL users can call it.

    Uses a SQL-bodied temporary function, which Catalyst inlines: the call
    compiles to the same ``regexp_replace`` chain as :func:`normalize_message`.
    """
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(msg STRING) RETURNS STRING "
        f"RETURN {normalize_sql('msg')}"
    )
    return name


def duckdb_normalize_sql(arg: str) -> str:
    """DuckDB (RE2) form of the fold, used by the SQL oracle."""
    expr = arg
    for _, pattern, repl in NORMALIZATION_RULES:
        quoted = pattern.replace("'", "''")
        expr = f"regexp_replace({expr}, '{quoted}', '{repl}', 'g')"
    return expr
