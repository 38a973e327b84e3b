"""Corpus-wide ownership frequency: which credential-like strings belong to one owner only.

Four kinds of spans are found by regular expressions. For every candidate value the job
counts, over the whole corpus, how many owners and repositories hold it. A value that many
owners hold is a copied example (documentation keys, fixtures); a value that few owners hold
and that looks like a key is live. Base kinds are always reported; of the open kind
``generic`` only live values are, or values that occur as a base value elsewhere.

All work is built-in functions. Values travel as SHA-256 hashes; the texts of documents with
candidates are stored once, with a row key, and never shuffled by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.llm.common import DOCUMENT_COLUMNS, materialize, whole_text

KINDS = ("assign", "access", "hex", "generic")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"  # the runs of [0-9a-f]+ that have 16 characters or more
GENERIC = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}+"
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, GENERIC)))
LEAST = {"assign": 12, "access": 18, "hex": 16, "generic": 20}
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your|test|xxxx|0000|1234|abcd"

MAX_OWNERS = 2  # a value held by more owners is a copied example
MIN_DISTINCT = 10  # different characters of a live-looking value
MASK = "[SECRET]"


def has_candidate(text: Column) -> Column:
    found = F.lit(False)
    for pattern in PATTERNS.values():
        found = found | text.rlike(pattern)
    return found


def _matches(text: Column, kind: str) -> Column:
    """Array of (kind, nr, gap, matched, value): the text before each match has ``gap`` code points."""
    pattern = F.lit(PATTERNS[kind])
    matched = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(2)) if kind == "assign" else matched
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), F.length)
    rows = F.transform(
        F.arrays_zip(matched.alias("matched"), value.alias("value"), gaps.alias("gap")),
        lambda x, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), i.alias("nr"), x["gap"].alias("gap"),
            F.length(x["matched"]).alias("n"), x["value"].alias("value"),
        ),
    )
    # the text after the last match is a gap without a match
    return F.when(text.rlike(PATTERNS[kind]), F.filter(rows, lambda x: x["n"].isNotNull())).otherwise(F.slice(rows, 1, 0))


def candidate_documents(docs: DataFrame) -> DataFrame:
    """The documents with a candidate of any kind and all columns, stored with ``_row``."""
    return materialize(docs.filter(has_candidate(whole_text())).withColumn("_row", F.monotonically_increasing_id()), "secret-docs")


def candidates(stored: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row for each candidate span: _row, kind, start, end, hash, live-looking flag, owner, repository."""
    text = whole_text()
    rows = stored.select(
        "_row",
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository]).alias("repository"),
        F.inline(F.concat(*[_matches(text, kind) for kind in KINDS])),
    )
    # the matches of one kind in one document: bounded by the document
    until = Window.partitionBy("_row", "kind").orderBy("nr").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(until).cast("long"))
    least = F.element_at(F.array(*[F.lit(LEAST[k]) for k in KINDS]), F.col("kind") + 1)
    value = F.col("value")
    live = (
        (F.size(F.array_distinct(F.split(value, ""))) >= MIN_DISTINCT)
        & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER)
    )
    return rows.filter(F.length(value) >= least).select(
        "_row", "owner", "repository", "kind", (F.col("end") - F.col("n")).alias("start"), "end",
        F.sha2(value, 256).alias("hash"), live.alias("looks_live"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """Per value: owners and repositories that hold it, and whether a base kind found it.

    Distinct (value, owner, repository) first, by a map-side aggregate, so a value that
    stands in a third of all documents costs a row for each owner and repository, not for
    each document.
    """
    pairs = found.groupBy("hash", "owner", "repository").agg(
        F.max(F.col("kind") < KINDS.index("generic")).alias("base"), F.max("looks_live").alias("looks_live")
    )
    owners = pairs.groupBy("hash", "owner").agg(
        F.count(F.lit(1)).alias("repositories"), F.max("base").alias("base"), F.max("looks_live").alias("looks_live")
    )
    return owners.groupBy("hash").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"),
        F.max("base").alias("base"), F.max("looks_live").alias("looks_live"),
    )


def decided_spans(stored: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """The reported spans (_row, kind, start, end, live, owners, repositories).

    Base spans always; a generic span if its value is live (looks like a key and has at
    most ``max_owners`` owners) or is a base value somewhere in the corpus, and if no base
    span of its document covers it.
    """
    found = materialize(candidates(stored), "secret-spans")
    spans = found.join(ownership(found).withColumnRenamed("looks_live", "_looks"), "hash", "left").drop("_looks")
    spans = spans.withColumn("live", F.col("looks_live") & (F.col("owners") <= max_owners))
    generic = KINDS.index("generic")
    # the spans of one document by start: the furthest end of a base span so far covers what lies inside
    before = Window.partitionBy("_row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    covered = F.coalesce(F.max(F.when(F.col("kind") < generic, F.col("end"))).over(before), F.lit(-1)) >= F.col("end")
    spans = spans.withColumn("covered", covered)
    keep = (F.col("kind") < generic) | ((F.col("live") | F.col("base")) & ~F.col("covered"))
    return spans.filter(keep).select("_row", "kind", "start", "end", "live", "owners", "repositories")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def scan_secrets(docs: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied.

    Spans count code points, end exclusive. A null or empty text has no spans: zero counts,
    the hash of the empty text, an empty list. Repeated rows are reported each; a null owner
    or repository counts as one of its own. ``n_live`` counts spans whose value has at most
    ``max_owners`` owners and looks like a key, ``n_copied`` spans whose value more own.
    """
    stored = candidate_documents(docs.select("doc_id", "text", "lang", "source"))
    spans = decided_spans(stored, max_owners)
    generic = KINDS.index("generic")
    per_row = spans.groupBy("_row").agg(
        *[F.sum((F.col("kind") == KINDS.index(k)).cast("long")).alias(f"n_{k}") for k in KINDS[:generic]],
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((F.col("owners") > max_owners).cast("long")).alias("n_copied"),
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("_spans"),
    )
    columns = [
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(_joined(F.filter("_spans", lambda s: s["kind"] < generic)), 256).alias("base_sha256"),
        _joined(F.col("_spans")).alias("spans"), "n_live", "n_copied",
    ]
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    counts = ("n_assign", "n_access", "n_hex", "n_live", "n_copied")
    zero = {c: F.lit(0).cast("long") for c in counts}
    with_spans = stored.select("_row", "doc_id").join(per_row, "_row", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in counts} | {"_spans": F.coalesce("_spans", empty)}
    )
    without = docs.filter(~has_candidate(whole_text())).select("doc_id").withColumns(zero | {"_spans": empty})
    return with_spans.select(*columns).unionByName(without.select(*columns))


def redact_secrets(docs: DataFrame, max_owners: int = MAX_OWNERS, mask: str = MASK) -> DataFrame:
    """``docs`` with every reported span replaced by ``mask`` (overlapping spans by one).

    Keeps every row, repeated ones too, and the columns of documents; ``n_chars`` follows
    the new text. Rows without spans are unchanged: null and empty texts, very long texts
    without a secret, rows without doc_id. Spans that touch the same characters are cut
    once, from the first start to the last end. An empty table stays empty; columns other
    than those of documents are dropped.
    """
    docs = docs.select(*DOCUMENT_COLUMNS)
    stored = candidate_documents(docs)
    spans = decided_spans(stored, max_owners).groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans")
    )
    text = F.col("text")

    def cut(acc: Column, span: Column) -> Column:
        start, end, at = span["start"].cast("int"), span["end"].cast("int"), acc["at"]
        fresh = F.concat(
            acc["parts"], F.array(F.substring(text, at + 1, F.greatest(start - at, F.lit(0))), F.lit(mask))
        )
        return F.struct(
            F.greatest(at, end).alias("at"),
            # a span that begins before the last one ended only prolongs it
            F.when(start >= at, fresh).otherwise(acc["parts"]).alias("parts"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    new_text = F.aggregate(
        "_spans", begin, cut,
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
    joined = stored.join(spans, "_row", "left")
    masked = joined.withColumn("_new", F.when(F.col("_spans").isNull(), text).otherwise(new_text)).select(
        "doc_id", F.col("_new").alias("text"), "lang", "source",
        F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("_new").cast("long")).alias("n_chars"),
    )
    return masked.unionByName(docs.filter(~has_candidate(whole_text())))
