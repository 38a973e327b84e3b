"""The whole span tree of every trace — depth, root, subtree sizes and times, critical path, cycles.

Trees are walked without recursion, by list ranking over their Euler tours. A span is two
entries of its tree's tour, one on the way down and one on the way up; the entry that
follows another is known from parents and siblings alone. Doubling the pointers
(each entry takes over the sums and the pointer of the one it points at) reaches the end of
a tour of n entries after log2(n) rounds, so a chain of 10,000 spans takes 15 rounds and a
trace of a third of all rows is spread by span, not by trace. Sums along the tour from an
entry to its end give everything: what lies between a span's two entries is its subtree, and
what is still open at its first entry are its ancestors.

Tours of spans in or below a cycle never end; such spans come out with ``in_cycle``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.session import checkpoint_dir

CHUNKS = 512  # siblings are put in order in so many parts, so no parent's children are one task's
DOWN, UP = 0, 1
SUMS = ("spans", "self_ns", "level", "off_path")
TREE = ["trace_id", "span_id", "parent_span_id", "root_span_id", "depth", "subtree_spans", "subtree_ns", "on_critical_path", "in_cycle"]


def _tours(spans: DataFrame) -> DataFrame:
    """The tour entries: key (trace_id, span_id, side), the entry that follows (null at the end of a tour), and the sums' start."""
    ids = ["trace_id", "span_id"]
    one = spans.groupBy(*ids).agg(  # a span sent twice is one node
        F.min("parent_span_id").alias("parent"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"),
        F.max("duration_ns").alias("duration_ns"),
    )
    known = one.select("trace_id", F.col("span_id").alias("parent"), F.lit(True).alias("_known"))
    nodes = one.join(known, ["trace_id", "parent"], "left").withColumn("parent", F.when(F.col("_known"), F.col("parent"))).drop("_known")
    nodes = nodes.checkpoint()
    # siblings in order: by start within a part, the parts one after the other
    children = nodes.where(F.col("parent").isNotNull()).withColumn("_part", F.pmod(F.xxhash64("span_id"), F.lit(CHUNKS)))
    in_part = Window.partitionBy("trace_id", "parent", "_part").orderBy("start_ns", "span_id")
    placed = children.select("trace_id", "span_id", "parent", "_part", F.lead("span_id").over(in_part).alias("_next"))
    parts = children.groupBy("trace_id", "parent", "_part").agg(F.min_by("span_id", F.struct("start_ns", "span_id")).alias("_first"))
    over = Window.partitionBy("trace_id", "parent").orderBy("_part")  # at most CHUNKS rows
    parts = parts.select("trace_id", "parent", "_part", F.lead("_first").over(over).alias("_after"))
    sibling = placed.join(parts, ["trace_id", "parent", "_part"]).select(*ids, F.coalesce("_next", "_after").alias("sibling"))
    families = children.groupBy("trace_id", "parent").agg(
        F.min_by("span_id", F.struct("_part", "start_ns", "span_id")).alias("first_child"),
        F.max_by("span_id", F.struct("end_ns", "span_id")).alias("last_to_end"),
    )
    linked = (
        nodes.join(sibling, ids, "left")
        .join(families.select("trace_id", F.col("parent").alias("span_id"), "first_child"), ids, "left")
        .join(families.select("trace_id", "parent", "last_to_end"), ["trace_id", "parent"], "left")
        .withColumn("aside", F.when(F.col("parent").isNotNull() & (F.col("last_to_end") != F.col("span_id")), 1).otherwise(0))
    )
    sums = lambda sign: [
        F.lit(1 if sign > 0 else 0).cast("long").alias("spans"), (F.col("duration_ns") if sign > 0 else F.lit(0)).cast("long").alias("self_ns"),
        F.lit(sign).cast("long").alias("level"), (sign * F.col("aside")).cast("long").alias("off_path"),
    ]
    down = linked.select(
        *ids, F.lit(DOWN).alias("side"), F.coalesce("first_child", "span_id").alias("to"),
        F.when(F.col("first_child").isNotNull(), DOWN).otherwise(UP).alias("to_side"), *sums(1), F.lit(None).cast("string").alias("last"),
    )
    up = linked.select(
        *ids, F.lit(UP).alias("side"), F.coalesce("sibling", "parent").alias("to"),
        F.when(F.col("sibling").isNotNull(), DOWN).otherwise(UP).alias("to_side"), *sums(-1),
        F.when(F.coalesce("sibling", "parent").isNull(), F.col("span_id")).alias("last"),
    )
    return down.unionByName(up)


def _doubled(entries: DataFrame) -> DataFrame:
    """One round: every entry that has not reached the end takes over what the entry it points at knows."""
    ahead = entries.select(
        "trace_id", F.col("span_id").alias("to"), F.col("side").alias("to_side"), F.col("to").alias("_to"), F.col("to_side").alias("_side"),
        F.col("last").alias("_last"), *[F.col(s).alias(f"_{s}") for s in SUMS],
    )
    going = entries.where(F.col("to").isNotNull()).join(ahead, ["trace_id", "to", "to_side"])
    moved = going.select(
        "trace_id", "span_id", "side", F.col("_to").alias("to"), F.col("_side").alias("to_side"),
        *[(F.col(s) + F.col(f"_{s}")).alias(s) for s in SUMS], F.col("_last").alias("last"),
    )
    return entries.where(F.col("to").isNull()).unionByName(moved)


def whole_tree(spans: DataFrame) -> DataFrame:
    """Per span: root, depth (0 at the root), spans and summed durations of its subtree (itself included), critical path, cycle.

    A span whose parent is not in its trace is a root. The critical path follows, from each
    span on it, the child that ends last (ties: the greater span_id). Spans in or below a
    cycle of parents have no root, depth, subtree or path.
    """
    checkpoint_dir(spans.sparkSession)
    entries = _tours(spans).checkpoint()
    largest = entries.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 1
    for _ in range(math.ceil(math.log2(largest)) + 1):
        if entries.where(F.col("to").isNotNull()).isEmpty():
            break
        entries = _doubled(entries).checkpoint()
    side = lambda n: [F.max(F.when(F.col("side") == n, F.col(c))).alias(f"{c}_{n}") for c in (*SUMS, "last", "to")]
    spanned = entries.groupBy("trace_id", "span_id").agg(*side(DOWN), *side(UP))
    ends = F.col(f"to_{DOWN}").isNull()  # what points on after all rounds is in a cycle
    between = lambda c: F.when(ends, F.col(f"{c}_{DOWN}") - F.col(f"{c}_{UP}"))
    tree = spanned.select(
        "trace_id", "span_id", F.when(ends, F.col(f"last_{DOWN}")).alias("root_span_id"),
        F.when(ends, -F.col(f"level_{DOWN}")).cast("int").alias("depth"), between("spans").alias("subtree_spans"),
        between("self_ns").alias("subtree_ns"),
        # the sum from its second entry on has the span and all its ancestors: none of them is aside
        F.when(ends, F.col(f"off_path_{UP}") == 0).alias("on_critical_path"), (~ends).alias("in_cycle"),
    )
    parents = spans.groupBy("trace_id", "span_id").agg(F.min("parent_span_id").alias("parent_span_id"))
    return tree.join(parents, ["trace_id", "span_id"]).select(TREE)
