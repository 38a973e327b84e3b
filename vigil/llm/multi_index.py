"""Approximate nearest neighbours by an inverted multi-index.

Vectors get one more component that makes all lengths equal, so the nearest by distance are
the largest inner products. Both halves are quantised by their own k-means; a cell is a pair
of centroids. A query visits cells in order of the summed distance of its halves to the pair,
drawn from a heap over the two sorted lists, until the cells hold the wanted share of all
rows; their entries are reranked by exact inner products.

The centroids, whose number grows with the table, and the share that reaches ``RECALL`` on
trial queries are fitted on a bounded sample (``SAMPLE`` rows, taken by hash); the trial rows
are no part of the centroids' fit, but in samples of a few hundred rows. Every row is indexed.
Rows of a cell's first half meet the queries in blocks of bounded size, so a cell that holds
a third of all rows is many blocks. Queries are blocked by the first half that they lie in, and
rows are sent to the query blocks that visit their first half only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import materialize
from vigil.llm.labels import least_hashes
from vigil.llm.vectors import best, first_k, matrix, packed_vectors

CENTROIDS = 16  # of each half at least: 256 cells; the fourth root of the rows if that is more
SAMPLE = 20_000  # rows for fitting
TRIALS = 200  # sampled queries that set the share of rows to visit
RECALL = 0.97  # wanted on them
ROUNDS = 12
ROW_BLOCK = 8192
QUERY_BLOCK = 2048
FOUND = "query_row long, query_id long, vec_id long, score double"


def halves(x: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the vectors, lengthened to the squared length ``longest`` by one more component."""
    extra = np.sqrt(np.maximum(longest - (x * x).sum(1, keepdims=True), 0))
    middle = (x.shape[1] + 1) // 2
    return x[:, :middle], np.hstack([x[:, middle:], extra])


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, but for a term that is the same for all centroids of a row."""
    return (centroids * centroids).sum(1)[None, :] - 2 * x @ centroids.T


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    random = np.random.default_rng(seed)
    centroids = x[random.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = distances(x, centroids).argmin(1)
        for j in range(k):
            own = x[near == j]
            centroids[j] = own.mean(0) if len(own) else x[random.integers(len(x))]
    return centroids


class MultiIndex:
    """Centroids of both halves and the cells' sizes."""

    def __init__(self, first: np.ndarray, second: np.ndarray, longest: float):
        self.first, self.second, self.longest = first, second, longest
        self.sizes = np.zeros((len(first), len(second)), dtype=np.int64)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = halves(x, self.longest)
        return distances(a, self.first).argmin(1), distances(b, self.second).argmin(1)

    def traverse(self, x: np.ndarray, wanted: float) -> Iterator[list[tuple[int, int]]]:
        """For each query (its own extra component is 0) the cells to visit, the nearest pair first."""
        middle = (x.shape[1] + 1) // 2
        to_first = distances(x[:, :middle], self.first)
        to_second = distances(np.hstack([x[:, middle:], np.zeros((len(x), 1))]), self.second)
        for u, v in zip(to_first, to_second):
            order_u, order_v = np.argsort(u, kind="stable"), np.argsort(v, kind="stable")
            heap, pushed, visited, rows = [(u[order_u[0]] + v[order_v[0]], 0, 0)], {(0, 0)}, [], 0
            while heap and rows < wanted:
                _, i, j = heapq.heappop(heap)
                cell = (int(order_u[i]), int(order_v[j]))
                if self.sizes[cell]:
                    visited.append(cell)
                    rows += int(self.sizes[cell])
                for n in ((i + 1, j), (i, j + 1)):
                    if n[0] < len(u) and n[1] < len(v) and n not in pushed:
                        pushed.add(n)
                        heapq.heappush(heap, (u[order_u[n[0]]] + v[order_v[n[1]]], *n))
            yield visited


def fit(sample: np.ndarray, longest: float, k: int, centroids: int = CENTROIDS) -> tuple[MultiIndex, float]:
    """The index of a sample, and the share of rows to visit for ``RECALL`` on trial queries from it."""
    held = np.zeros(len(sample), dtype=bool)
    held[:: max(1, len(sample) // TRIALS)] = True
    trials = sample[held][:TRIALS]
    a, b = halves(sample[~held] if len(sample) > 4 * TRIALS else sample, longest)
    index = MultiIndex(k_means(a, centroids), k_means(b, centroids, seed=1), longest)
    u, v = index.cells(sample)
    np.add.at(index.sizes, (u, v), 1)
    needed = []
    for row, order in zip(trials, index.traverse(trials, np.inf)):
        at = {cell: i for i, cell in enumerate(order)}
        rows = np.cumsum([index.sizes[c] for c in order])
        scores = sample @ row
        for j in np.argsort(-scores, kind="stable")[1 : k + 1]:
            needed.append(rows[at[int(u[j]), int(v[j])]] / len(sample))
    share = float(np.quantile(needed, RECALL)) if needed else 1.0
    return index, min(1.0, share + 0.02)


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, centroids: int | None = None, sample: int = SAMPLE,
            row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: k near rows of every row whose vec_id ``every`` divides.

    Vectors null, empty, zero or holding null or non-finite components take no part, and
    rows without vec_id don't. Every row is a candidate and, if its id is asked for, a query:
    rows that share a vec_id, or repeat a row, each have their own k. A query meets
    candidates of its own dimension, not its own row; ties go to the smaller vec_id; fewer
    candidates than k are all returned. An empty table gives no rows; other columns are ignored.
    """
    stored = materialize(packed_vectors(embeddings, drop_zero=True), "ann-vectors")
    parts = None
    for dim in [r["dim"] for r in stored.select("dim").distinct().collect()]:  # in a sane table there is one
        found = _one_dimension(stored.filter(F.col("dim") == dim), dim, every, k, centroids, sample, row_block, query_block)
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        parts = stored.sparkSession.createDataFrame([], FOUND)
    return best(parts, k)


def _one_dimension(rows: DataFrame, dim: int, every: int, k: int, centroids: int | None, sample: int,
                   row_block: int, query_block: int) -> DataFrame:
    total, longest = rows.agg(F.count(F.lit(1)), F.max("norm")).first()
    centroids = centroids or max(CENTROIDS, round(total**0.25))
    # the sample: the rows with the smallest hashes, a bounded number whatever the table
    drawn = least_hashes(rows, sample, "vec_id").select("vec").collect()
    index, share = fit(np.frombuffer(b"".join(bytes(r["vec"]) for r in drawn), dtype="<f8").reshape(-1, dim), longest, k, centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = index.cells(matrix(batch.column("vec"), dim)) if batch.num_rows else (np.empty(0, int),) * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("vec_id"), batch.column("vec"), pa.array(u.astype(np.int32)),
                 pa.array(v.astype(np.int32))], names=["row", "vec_id", "vec", "u", "v"],
            )

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec")
    indexed = materialize(numbered.mapInArrow(place, "row long, vec_id long, vec binary, u int, v int"), "ann-index")
    # one row for each cell
    index.sizes = np.zeros_like(index.sizes)
    for r in indexed.groupBy("u", "v").count().collect():
        index.sizes[r["u"], r["v"]] = r["count"]
    wanted = max(share * total, min(total, 4 * k))
    blocks = [max(1, -(-int(n) // row_block)) for n in index.sizes.sum(1)]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys = [part.column(c).to_pylist() for c in ("row", "vec_id", "vec", "qb")]
                out: list[list] = [[], [], [], [], [], []]
                for row, vec_id, vec, qb, cells in zip(*keys, index.traverse(matrix(part.column("vec"), dim), wanted)):
                    by_first: dict[int, list[int]] = {}
                    for u, v in cells:
                        by_first.setdefault(u, []).append(v)
                    for u, seconds in by_first.items():
                        for column, value in zip(out, (row, vec_id, vec, qb, u, seconds)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), kind))],
                    names=["query_row", "query_id", "query", "qb", "u", "seconds"],
                )

    asked = indexed.filter(F.col("vec_id") % every == 0)
    # queries in the order of their first halves, cut into blocks: those of a block visit much the same rows
    held = {r["u"]: r["count"] for r in asked.groupBy("u").count().collect()}  # one row for each centroid
    sizes = np.array([held.get(u, 0) for u in range(centroids)])
    first = F.element_at(F.lit((np.cumsum(sizes) - sizes).tolist()), F.col("u") + 1)
    place = first + F.pmod(F.xxhash64("row"), F.element_at(F.lit(np.maximum(sizes, 1).tolist()), F.col("u") + 1))
    asked = asked.select("row", "vec_id", "vec", F.call_function("div", place.cast("long"), F.lit(query_block)).alias("qb"))
    visits = materialize(asked.mapInArrow(
        visit, "query_row long, query_id long, query binary, qb long, u int, seconds array<int>"), "ann-visits")
    # the list of blocks has an entry for each first centroid
    count = F.element_at(F.lit(blocks), F.col("u") + 1)
    needed = visits.select(F.col("u").alias("_u"), F.col("qb").alias("_qb")).distinct()
    entries = indexed.withColumn("rb", F.pmod(F.xxhash64("row"), count).cast("int")).join(needed, F.col("u") == F.col("_u"))
    entries = entries.select("row", "vec_id", "vec", "u", "v", "rb", F.col("_qb").alias("qb"))
    visits = visits.withColumn("rb", F.explode(F.sequence(F.lit(0), count - 1)))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            rows, ids, v, x = *(right.column(c).to_numpy() for c in ("row", "vec_id", "v")), matrix(right.column("vec"), dim)
            q = matrix(left.column("query"), dim)
            asking = list(zip(*(left.column(c).to_pylist() for c in ("query_row", "query_id", "seconds"))))
            for at in range(0, len(q), 256):
                scores = q[at : at + 256] @ x.T
                for row, (query_row, query_id, visited) in zip(scores, asking[at : at + 256]):
                    open_cells = np.zeros(centroids, dtype=bool)
                    open_cells[visited] = True
                    able = np.flatnonzero(open_cells[v] & (rows != query_row))
                    top = able[first_k(row[able], ids[able], k)]
                    for column, values in zip(out, ([query_row] * len(top), [query_id] * len(top), ids[top], row[top])):
                        column.extend(values)
        return pa.table([pa.array(c, pa.float64() if i == 3 else pa.int64()) for i, c in enumerate(out)],
                        names=["query_row", "query_id", "vec_id", "score"])

    keys = ("u", "rb", "qb")
    return visits.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInArrow(rerank, FOUND)
