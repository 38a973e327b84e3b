"""Hilbert-curve ordering: shards whose rows are near each other in several metadata dimensions.

Every dimension is quantised to ``bits`` bits, the row gets its index on the Hilbert curve
through that grid, rows are sorted by the index and the order is cut into equal runs. A run
covers a compact region of the grid, so the min/max statistics of the files of one shard
prune on each dimension alone and on several together.

All work is built-in column functions: one range shuffle of the narrow metadata rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.llm.common import ranked, whole_text

BITS = 8


def curve_table(n: int) -> list[int]:
    """Transitions of the n-dimensional curve, ``next_state << n | digit`` at ``state << n | cell``.

    A state is (entry corner e, direction d) as ``e * n + d``; the rule is the Gray-code
    construction: rotate the cell into the state's frame, take the inverse Gray code as the
    digit, and move the frame to the entry corner of the sub-cube with that digit.
    """
    mask = (1 << n) - 1

    def left(x: int, k: int) -> int:
        k %= n
        return ((x << k) | (x >> (n - k))) & mask

    def trailing_ones(x: int) -> int:
        return (~x & (x + 1)).bit_length() - 1

    table = []
    for state in range((1 << n) * n):
        e, d = divmod(state, n)
        for cell in range(1 << n):
            gray = left(cell ^ e, n - (d + 1) % n)
            digit = 0
            while gray:
                digit ^= gray
                gray >>= 1
            corner = 0 if digit == 0 else (lambda x: x ^ (x >> 1))(2 * ((digit - 1) // 2))
            turn = 0 if digit == 0 else trailing_ones(digit - 1 if digit % 2 == 0 else digit)
            table.append(((e ^ left(corner, d + 1)) * n + (d + turn + 1) % n) << n | digit)
    return table


def curve_index(dims: list[Column], bits: int = BITS) -> Column:
    """Hilbert index (long) of non-negative integer columns below ``2**bits``."""
    n = len(dims)
    if not 2 <= n <= 5 or n * bits > 62:
        raise ValueError("2 to 5 dimensions, 62 bits in all")
    rule = F.lit(curve_table(n))
    coords = [d.cast("long") for d in dims]
    cells = F.array(*[
        sum(((F.shiftright(c, b).bitwiseAND(F.lit(1))) * (1 << j) for j, c in enumerate(coords)), F.lit(0)).cast("long")
        for b in reversed(range(bits))
    ])

    def step(acc: Column, cell: Column) -> Column:
        move = F.get(rule, (acc["state"] * (1 << n) + cell).cast("int")).cast("long")
        return F.struct(
            (acc["index"] * (1 << n) + move.bitwiseAND(F.lit((1 << n) - 1))).alias("index"),
            F.shiftright(move, n).alias("state"),
        )

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).cast("long").alias("state"))
    return F.aggregate(cells, start, step, lambda acc: acc["index"])


def quantile_edges(rows: DataFrame, column: str, bits: int = BITS) -> list:
    """The values that part a numeric column into ``2**bits`` steps of nearly equal counts, a fixed number of them."""
    steps = 1 << bits
    found = rows.agg(F.percentile_approx(column, [i / steps for i in range(1, steps)], 100 * steps).alias("edges")).first()["edges"]
    return sorted(set(found or []))


def quantile_step(column: Column, edges: list) -> Column:
    """A number's place among the edges: outlying values move no others (null: 0)."""
    if not edges:
        return F.lit(0).cast("long")
    return F.coalesce(F.size(F.filter(F.lit(edges), lambda e: column > e)), F.lit(0)).cast("long")


def log_scaled(column: Column, bits: int = BITS) -> Column:
    """A positive size on a base-two logarithmic scale, eight steps to a doubling."""
    return F.least(F.lit((1 << bits) - 1), F.floor(F.log2(F.greatest(column, F.lit(1))) * 8)).cast("long")


def category(column: Column, bits: int = BITS) -> Column:
    """A category as a hash bucket (null is a category of its own)."""
    return F.pmod(F.xxhash64(column), F.lit(1 << bits))


def shard_documents(docs: DataFrame, shards: int = 16, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, curve, law (``rows``), shard, slot, grown_shard for every row.

    ``size`` is the UTF-8 length of the text (null: none) plus one. The dimensions are size
    (logarithmic), lang, source and doc_id (by quantiles, so one outlying id does not put all
    others into a single step). Equal texts follow each other within their cell of the curve.
    The counts of the shards differ by one at most (law ``rows``), whatever repeats; ties are
    in the order of text_crc32, size and doc_id; very long texts count by their size alone;
    an empty table gives no rows, a null in any dimension is its lowest step or a category
    of its own, and other columns are ignored.
    """
    edges = quantile_edges(docs, "doc_id", bits)
    text = whole_text()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        category(F.col("lang"), bits).alias("lang_cell"),
        category(F.col("source"), bits).alias("source_cell"),
    )
    rows = rows.select(
        "doc_id", "size", "text_crc32",
        curve_index(
            [log_scaled(F.col("size"), bits), F.col("lang_cell"), F.col("source_cell"),
             quantile_step(F.col("doc_id"), edges)],
            bits,
        ).alias("curve"),
    )
    rows = ranked(rows, [F.col(c) for c in ("curve", "text_crc32", "size", "doc_id")], "hilbert")
    # shard i takes the ranks from i * total div shards on
    shard = F.expr(f"((_rank + 1) * {shards} - 1) div _total")
    return rows.withColumn("_shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"),
        (F.col("_rank") - F.expr(f"(_shard * _total) div {shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write the rows of ``docs`` as one folder for each shard, in curve order.

    Rows are matched to their place by (doc_id, size, text_crc32); rows equal in all three
    hold equal places in the order, so they may swap slots but never get lost or doubled.
    Columns of ``docs`` named shard or slot are replaced.
    """
    keys = ["_id", "_size", "_crc"]
    text = whole_text()
    copy = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    plan = shard_documents(docs, shards).select(
        F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), "shard", "slot"
    ).withColumn("_copy", copy)
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = docs.select(
        F.struct(*own).alias("row"), F.col("doc_id").alias("_id"), (F.octet_length(text) + 1).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
    ).withColumn("_copy", copy)
    on = [rows[k].eqNullSafe(plan[k]) for k in [*keys, "_copy"]]
    joined = rows.join(plan, on).select("row.*", "shard", "slot")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
