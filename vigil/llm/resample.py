"""Target-distribution importance resampling over hashed n-gram features, in Arrow kernels.

A document's features are its runs of 1 to ``order`` words, hashed into buckets. A bucket's
gain is the log ratio of its smoothed share among the target's features to its share in the
documents; a document weighs the mean gain of its features. Gumbel noise from the hash of
its id makes the highest scores a draw without replacement in proportion to the weights.

Words come from ``ascii_lower`` and ``split_pattern_regex``; the flat words of a batch are
dictionary-encoded once. Shifting the dictionary indices against themselves gives the
n-grams, one order after the other: a run is the run before it and one more word, so only
distinct pairs (run, word) are hashed, by continuing the run's CRC. Gains are taken by
distinct run and summed by segments of equal rows.

The bucket counts of all documents are the only thing that tasks send (``buckets`` numbers
each, whatever the input); the draw is one range sort of four numbers for each document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import materialize, ranked, text_slices

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between words, after A-Z are lower-cased
ORDER = 1
BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = (10, 100)  # drawn share of the documents with words enough
SEED = 2024

WEIGHT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType()),
])


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in one flat array, and the row of each."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=BETWEEN)
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(flat), 0)  # a text may begin or end between words
    return flat.filter(some), parents.filter(some).to_numpy()


def runs(texts: pa.Array, order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For 1 to ``order`` words: the CRC of each distinct run, the runs as indices into those, and their rows."""
    flat, parents = words(texts)
    encoded = flat.dictionary_encode()
    said = [b" " + w for w in encoded.dictionary.cast(pa.binary()).to_pylist()]
    single = encoded.indices.to_numpy()
    crcs = np.array([zlib.crc32(w[1:]) for w in said], dtype=np.int64)
    index, rows = single, parents
    yield crcs, index, rows
    for n in range(2, order + 1):
        # a run goes on with the word after it if that stands in the same row
        goes_on = rows[: max(0, len(parents) - n + 1)] == parents[n - 1 :]
        where = np.flatnonzero(goes_on)
        pairs = index[where].astype(np.int64) * max(1, len(said)) + single[where + n - 1]
        distinct, found = np.unique(pairs, return_inverse=True)
        left, word = distinct // max(1, len(said)), distinct % max(1, len(said))
        crcs = np.array([zlib.crc32(said[w], int(crcs[i])) for i, w in zip(left, word)], dtype=np.int64)
        yield crcs, found, parents[where]
        # runs that could not go on keep their place, so that the next shift still lines up
        index = np.zeros(len(goes_on), dtype=np.int64)
        index[where] = found
        rows = np.where(goes_on, parents[: len(goes_on)], -1)


def bucket_counts(table: DataFrame, order: int, buckets: int, column: str = "text") -> np.ndarray:
    """Features of all texts by bucket: one row for each bucket and task, then one number for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, texts in text_slices(batch, column):
                for crcs, index, _ in runs(texts, order):
                    times = np.bincount(index, minlength=len(crcs))
                    np.add.at(total, crcs % buckets, times)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    found = np.zeros(buckets, dtype=np.int64)
    sums = table.select(column).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # at most as many as there are buckets
        found[r["bucket"]] = r["n"]
    return found


def bucket_gains(ours: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed share in the target to that in our texts, floored."""
    size = len(ours)
    more, less = float(ours.sum() + size), float(target.sum() + size)
    ratios = ((t + 1.0) * more / ((s + 1.0) * less) for s, t in zip(ours.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], dtype=np.int64)


def weights(docs: DataFrame, gains: np.ndarray, order: int) -> DataFrame:
    """doc_id, n_words, n_features and weight (floored mean gain of the features; none: 0) of every row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                sums, counts, first = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), None
                for crcs, index, rows in runs(texts, order):
                    if len(rows):
                        each = pc.take(pa.array(gains[crcs % len(gains)]), pa.array(index)).to_numpy()
                        begins = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1])
                        sums[rows[begins]] += np.add.reduceat(each, begins)
                        counts += np.bincount(rows, minlength=len(texts))
                    first = counts.copy() if first is None else first
                weight = np.floor_divide(sums, np.maximum(counts, 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(first), pa.array(counts), pa.array(weight)],
                    names=WEIGHT_SCHEMA.names,
                )

    return docs.select("doc_id", "text").mapInArrow(weigh, WEIGHT_SCHEMA)


def resample(
    docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, share: tuple[int, int] = SHARE,
    least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """Per row: doc_id, n_words, n_features, weight, score, rank (1, 2, 3 ... of the drawn rows, else null).

    Drawn are the highest scores among rows of ``least_words`` words or more, ``share`` of
    their number, floored; ties go to the smaller doc_id, rows without one come last among
    equals, and rows equal in both are drawn in the order they are stored in. Null and empty
    texts have no words and are never drawn; repeated rows count and come out each; texts
    are read whole; empty tables (documents or target) give no rows, or gains from the
    smoothing alone; other columns are ignored.
    """
    gains = bucket_gains(bucket_counts(docs, order, buckets), bucket_counts(target, order, buckets))
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = materialize(
        weights(docs, gains, order).withColumn("score", F.col("weight") + noise)
        .withColumn("fit", F.col("n_words") >= least_words), "resample-scores",
    )
    drawn = scored.filter("fit").count() * share[0] // share[1]
    # the last column tells rows apart that are equal in all the others: no frequent id lands in one task
    order_by = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_at")]
    placed = ranked(scored.withColumn("_at", F.monotonically_increasing_id()), order_by, "resample-order")
    rank = F.when(F.col("_rank") < drawn, F.col("_rank") + 1)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
