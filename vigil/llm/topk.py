"""Exact top-k inner products over norm-sorted blocks with SVD-rotated partial sums.

Vectors are ranked by descending length and cut into blocks. All vectors are rotated by the
singular vectors of the whole table, so a prefix of the rotated components holds most of a
product. For a block of queries and a block of candidates, lengths rule queries out first
(|q| |c| bounds every product of the block), then the prefix product plus the
Cauchy-Schwarz bound on the rest rules pairs out, and what is left is computed exactly in
integers. The longest vectors go first: their k-th score is the bar for all other blocks.

Queries and candidates meet block by block in the cluster; each pair of blocks gives at most
k rows for each query. Pairs of blocks that the lengths alone rule out are never shipped:
after the first block a query needs candidates down to the length (its bar / its own
length) only, so queries are ranked by that length and cut into blocks of like needs, and a
block of candidates goes to the query blocks that reach down to it, which are the first
ones. What reaches the driver is the dimension-squared sums of products and at most
``STEPS`` lengths and counts, whatever the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import materialize, ranked
from vigil.llm.vectors import best, first_k, matrix, packed_vectors

SCALE = 1024
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 1024
ENERGY = 0.75  # share of the squared lengths that the prefix of the rotated components holds
LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1
STEPS = 4096  # lengths that tell how far down a query must look
FOUND = "query_row long, query_id long, vec_id long, score long"


def to_integers(x: np.ndarray) -> np.ndarray:
    """floor(1024 x), as whole doubles (beyond the doubles the largest)."""
    big = np.finfo(np.float64).max
    return np.clip(np.floor(np.clip(x, -big / SCALE, big / SCALE) * SCALE), -big, big)


def rotation(rows: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """Right singular vectors of the table (largest first), and how many hold ``ENERGY``."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = matrix(batch.slice(at, 4096).column("vec"), dim)
                x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)  # long vectors don't drown others
                total += np.nan_to_num(x.T @ x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim, dtype=np.int32)), pa.array(total.ravel())],
                                         names=["cell", "v"])

    sums = rows.select("vec").mapInArrow(gram, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(dim * dim)
    for r in sums:
        total[r["cell"]] = r["v"]
    values, columns = np.linalg.eigh(total.reshape(dim, dim))
    values, columns = np.maximum(values[::-1], 0), columns[:, ::-1]
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    return np.ascontiguousarray(columns), int(min(dim, np.searchsorted(share, ENERGY) + 1))


def exact_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of paired rows; beyond a long the nearest long."""
    bound = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1]
    if bound < 2.0**53:  # every partial sum is a whole double
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    out = np.empty(len(q), dtype=np.int64)
    for i, (a, b) in enumerate(zip(q, c)):
        out[i] = max(LEAST_LONG, min(MOST_LONG, sum(int(x) * int(y) for x, y in zip(a, b))))
    return out


def block_top(q_rows, q, bars, c_rows, c_ids, c, k: int, basis: np.ndarray, prefix: int):
    """(place of the query, vec_ids, scores) of up to k best pairs for each query of the block that can pass its bar."""
    length_q, length_c = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    slack = 1e-9 * length_q * length_c.max(initial=0) + 1e-6  # of the rounding of the bounds
    live = np.flatnonzero(length_q * length_c.max(initial=0) + slack >= bars)
    rotated_c = c @ basis
    rest_c = np.sqrt((rotated_c[:, prefix:] ** 2).sum(1))
    for at in range(0, len(live), 128):
        some = live[at : at + 128]
        rotated = q[some] @ basis
        bound = rotated[:, :prefix] @ rotated_c[:, :prefix].T
        bound += np.sqrt((rotated[:, prefix:] ** 2).sum(1))[:, None] * rest_c[None, :]
        for j, i in enumerate(some):
            able = np.flatnonzero((bound[j] + slack[i] >= bars[i]) & (c_rows != q_rows[i]))
            bar = bars[i]
            kept: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64)]
            able = able[np.argsort(-bound[j][able], kind="stable")] if len(able) > 4 * k else able
            for lot in range(0, len(able), 512):  # the likeliest first: the bar rises
                part = able[lot : lot + 512]
                part = part[bound[j][part] + slack[i] >= bar]
                if not len(part):
                    break
                scores = exact_products(np.broadcast_to(q[i], (len(part), q.shape[1])), c[part])
                scores, ids = np.concatenate([kept[0], scores]), np.concatenate([kept[1], c_ids[part]])
                top = first_k(scores, ids, k)
                kept = [scores[top], ids[top]]
                if len(top) == k:
                    bar = max(bar, float(kept[0][-1]))
            if len(kept[0]):
                yield i, kept[1], kept[0]


def top_products(embeddings: DataFrame, every: int = 100, k: int = 10,
                 candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer products of every row whose vec_id ``every`` divides.

    Components are floor(1024 x). Vectors null, empty or holding null or non-finite
    components take no part, and rows without vec_id don't. Every row is a candidate and, if
    its id is asked for, a query: rows that share a vec_id, or repeat a row, each have their
    own k. A query meets the candidates of its own dimension, not its own row; if they are
    fewer than k, all are returned. Ties go to the smaller vec_id; a score beyond a long is
    the nearest long. An empty table gives no rows; other columns are ignored.
    """
    stored = materialize(packed_vectors(embeddings, to_integers), "topk-vectors")
    parts = None
    for dim in [r["dim"] for r in stored.select("dim").distinct().collect()]:  # in a sane table there is one
        found = _one_dimension(stored.filter(F.col("dim") == dim), dim, every, k, candidate_block, query_block)
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        parts = stored.sparkSession.createDataFrame([], FOUND)
    return best(parts, k)


def _one_dimension(rows: DataFrame, dim: int, every: int, k: int, candidate_block: int, query_block: int) -> DataFrame:
    basis, prefix = rotation(rows, dim)
    # the last column tells repeated rows apart, so none of them pile up in a task
    numbered = rows.select("vec_id", "norm", "vec", F.monotonically_increasing_id().alias("_at"))
    ordered = ranked(numbered, [F.desc("norm"), F.col("vec_id"), F.col("_at")], "topk-norms").drop("_at")
    # block 0: the longest vectors
    candidates = ordered.select(F.col("_rank").alias("row"), "vec_id", "vec", F.expr(f"_rank div {candidate_block}").alias("cb"))
    asked = ordered.filter(F.col("vec_id") % every == 0).select(
        F.col("_rank").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("vec").alias("query"), "norm",
    )
    kind = T.StructType.fromDDL(FOUND)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            bars = np.array([-np.inf if b is None else float(b) for b in left.column("bar").to_pylist()])
            q_rows, q_ids = left.column("query_row").to_numpy(), left.column("query_id").to_numpy()
            for i, ids, scores in block_top(
                q_rows, matrix(left.column("query"), dim), bars, right.column("row").to_numpy(),
                right.column("vec_id").to_numpy(), matrix(right.column("vec"), dim), k, basis, prefix,
            ):
                for column, values in zip(out, ([q_rows[i]] * len(ids), [q_ids[i]] * len(ids), ids, scores)):
                    column.extend(values)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=kind.names)

    def joined(queries: DataFrame, some: DataFrame) -> DataFrame:
        queries = queries.select("query_row", "query_id", "query", "bar", "qb", "cb")
        return queries.groupBy("qb", "cb").cogroup(some.groupBy("qb", "cb")).applyInArrow(meet, kind)

    blocks = max(1, -(-asked.count() // query_block))
    first = asked.withColumns({
        "cb": F.lit(0).cast("long"), "bar": F.lit(None).cast("long"), "qb": F.pmod(F.xxhash64("query_row"), F.lit(blocks)),
    })
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    longest = materialize(joined(first, candidates.filter("cb = 0").withColumn("qb", every_block)), "topk-first")
    later, spread = surviving(ordered, asked, candidates, longest, k, candidate_block, query_block)
    return longest if later is None else longest.unionByName(joined(later, spread))


def surviving(ordered: DataFrame, asked: DataFrame, candidates: DataFrame, longest: DataFrame, k: int,
              candidate_block: int, query_block: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Queries (with ``qb``, ``cb`` and ``bar``) and candidates (with ``qb``, ``cb``) of the block pairs beyond block 0 that lengths allow."""
    total = ordered.count()
    last_block = (total - 1) // candidate_block
    if last_block < 1:
        return None, None
    # the squared length that begins each step of so many blocks, the longest first
    step = -(-last_block // STEPS)
    begins = ordered.filter((F.col("_rank") >= candidate_block) & ((F.col("_rank") - candidate_block) % (step * candidate_block) == 0))
    heads = sorted((r["norm"] for r in begins.select("norm").collect()), reverse=True)
    bars = longest.groupBy("query_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bar"))
    known = asked.join(bars, "query_row", "left")
    bar = F.col("bar").cast("double")
    # a candidate shorter than this cannot reach the bar; all lengths can where there is no bar above zero
    need = F.when(bar > 0, bar * bar / F.col("norm") * (1 - 1e-9) - 1e-3).otherwise(F.lit(-1.0))
    steps = F.size(F.filter(F.lit(heads), lambda head: head >= need)).cast("long")
    known = known.withColumn("steps", steps).filter("steps > 0")
    placed = ranked(
        known.select("query_row", "query_id", "query", "bar", "steps"), [F.desc("steps"), F.col("query_row")], "topk-needs"
    ).withColumn("qb", F.expr(f"_rank div {query_block}"))
    # queries that look at least so many steps down come first: their number gives a step's query blocks
    reach = {r["steps"]: r["n"] for r in placed.groupBy("steps").agg(F.count(F.lit(1)).alias("n")).collect()}
    needing = [sum(n for s, n in reach.items() if s > at) for at in range(len(heads))]
    last_qb = F.lit([(n - 1) // query_block if n else -1 for n in needing])
    at = F.expr(f"(cb - 1) div {step}")
    spread = candidates.filter("cb > 0").withColumn("_last", F.get(last_qb, at.cast("int"))).filter("_last >= 0").withColumn(
        "qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last").cast("long")))
    ).drop("_last")
    deepest = F.least(F.lit(last_block).cast("long"), F.col("steps") * step)
    later = placed.withColumn("cb", F.explode(F.sequence(F.lit(1).cast("long"), deepest)))
    return later.select("query_row", "query_id", "query", "bar", "qb", "cb"), spread
