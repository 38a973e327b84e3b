"""Embedding columns as packed vectors, and the merge of partial top-k lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def packed_vectors(embeddings: DataFrame, change: Callable[[np.ndarray], np.ndarray] | None = None,
                   drop_zero: bool = False) -> DataFrame:
    """vec_id, dim, norm (squared length) and vec (little-endian doubles) of every usable row.

    Rows without vec_id, without a vector or components, or with null or non-finite
    components take no part, nor zero vectors if ``drop_zero``. Rows that share a vec_id, or
    all of their content, are rows of their own.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                values = vector.values
                if vec_id is None or values is None or not len(values) or values.null_count:
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all() or (drop_zero and not x.any()):
                    continue
                x = change(x) if change else x
                rows.append((vec_id, len(x), float(x @ x), x.astype("<f8").tobytes()))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.float64(), pa.binary()))],
                names=["vec_id", "dim", "norm", "vec"],
            )

    return embeddings.select("vec_id", "embedding").mapInArrow(pack, "vec_id long, dim int, norm double, vec binary")


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, dim)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k first rows of each query row (``query_row``) by score, ties to the smaller vec_id, with their rank from 1.

    Each query has at most k rows from each block, so no query's rows pile up in a task.
    """
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def first_k(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]
