"""SimHash near-duplicates by the generalised pigeonhole principle.

Texts become 64-bit fingerprints. The bits are grouped into partitions so that correlated
bits share one. Two fingerprints within ``distance`` bits agree, for any thresholds that sum
to ``distance - partitions + 1``, within the threshold of at least one partition (-1: the
partition is not probed). Each fingerprint chooses its own thresholds by dynamic programming
on the candidates it must expect, from counts over the whole corpus: a partition whose value
is frequent gets a low threshold, the others make up for it. Where every choice is dear, the
fingerprint probes all fingerprints within the distance by whole value instead, a fixed
number; so work grows with the number of fingerprints, however dense a group is. Candidates
are verified in the join.

Only distinct fingerprints are linked, copies follow their fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vigil.llm.common import materialize
from vigil.llm.components import connected

BITS = 64
SHINGLE = 3
SEED = 42
DISTANCE = 2
PARTITIONS = 2


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text; zero if it has no words."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(size)))))
    hashes = np.fromiter(map(partial(xxh64_intdigest, seed=SEED), shingles), dtype="<u8", count=len(shingles))
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), size: int = SHINGLE) -> DataFrame:
    """``keys`` and ``print`` (the fingerprint as a signed long) of every row; a null text has no words."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (fingerprint(t.as_py() or "", size) for t in batch.column("text")), dtype=np.uint64, count=batch.num_rows
            )
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keys], pa.array(found.view(np.int64))], names=[*keys, "print"]
            )

    rows = docs.select(*keys, "text")
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("print", T.LongType())])
    return rows.mapInArrow(compute, schema)


def co_occurrence(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and for each pair of bits the rows that have both: 64 x 64 sums over all fingerprints."""
    schema = "cell int, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1), dtype=np.int64)
        for batch in batches:
            values = batch.column("print").to_numpy().astype("<i8")
            for at in range(0, len(values), 65536):
                part = values[at : at + 65536].view(np.uint8).reshape(-1, 8)
                x = np.unpackbits(part, axis=1, bitorder="little").astype(np.float32)
                x = np.hstack([x, np.ones((len(x), 1), np.float32)])  # the last row and column count rows and bits
                total += np.rint(x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())],
                                         names=["cell", "n"])

    cells = prints.select("print").mapInArrow(count, schema).groupBy("cell").agg(F.sum("n").alias("n")).collect()
    total = np.zeros((BITS + 1) ** 2, dtype=np.int64)
    for r in cells:
        total[r["cell"]] = r["n"]
    total = total.reshape(BITS + 1, BITS + 1)
    return int(total[BITS, BITS]), total[:BITS, :BITS]


def correlated_groups(rows: int, both: np.ndarray, partitions: int) -> list[list[int]]:
    """Bits in ``partitions`` groups of nearly equal size, grown from the most correlated bit by mean |phi|."""
    n = max(rows, 1)
    p = np.diag(both) / n
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    phi = np.abs(np.divide(both / n - np.outer(p, p), spread, out=np.zeros_like(spread), where=spread > 0))
    np.fill_diagonal(phi, 0)
    free, groups = list(range(BITS)), []
    for g in range(partitions):
        size = (BITS + g) // partitions
        group = [max(free, key=lambda b: (phi[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (phi[b, group].mean(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def near_masks(width: int, distance: int) -> np.ndarray:
    """All values of ``width`` bits with at most ``distance`` ones, the fewest first."""
    found = [sum((1 << b for b in ones), 0) for k in range(distance + 1) for ones in combinations(range(width), k)]
    return np.array(found, dtype=np.uint64)


def part_value(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint, side by side."""
    found = np.zeros(len(values), dtype=np.uint64)
    for place, bit in enumerate(bits):
        found |= ((values >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place)
    return found


def thresholds(counts: np.ndarray, balls: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest thresholds of each row, and their cost.

    ``counts[r, i]`` rows share the value of partition i with row r, ``balls[i, t]`` values lie
    within t bits there; a probe of a value near a frequent one is taken to find as many.
    Threshold t costs ``balls[i, t] * counts[r, i]``, -1 nothing. Dynamic programming over
    the partitions, the state being the thresholds' sum so far (plus one for each partition).
    """
    rows, parts = counts.shape
    budget = distance + 1  # sum of (threshold + 1)
    best = np.full((rows, budget + 1), np.inf)
    best[:, 0] = 0
    chosen = np.zeros((parts, rows, budget + 1), dtype=np.int8)
    for i in range(parts):
        nxt = np.full_like(best, np.inf)
        for t in range(-1, distance + 1):
            cost = 0 if t < 0 else balls[i, t] * counts[:, i]
            for spent in range(budget + 1 - (t + 1)):
                total = best[:, spent] + cost
                to = spent + t + 1
                better = total < nxt[:, to]
                nxt[better, to] = total[better]
                chosen[i, better, to] = t
        best = nxt
    out = np.zeros((rows, parts), dtype=np.int8)
    at = np.full(rows, budget)
    for i in reversed(range(parts)):
        out[:, i] = chosen[i, np.arange(rows), at]
        at = at - (out[:, i] + 1)
    return out, best[:, budget]


def near_links(prints: DataFrame, distance: int = DISTANCE, partitions: int = PARTITIONS) -> DataFrame:
    """All pairs (a, b), a < b, of distinct fingerprints (column ``print``) within ``distance`` bits."""
    groups = correlated_groups(*co_occurrence(prints), partitions)
    widest = max(map(len, groups))
    balls = np.array([[len(near_masks(len(g), t)) for t in range(distance + 1)] for g in groups], dtype=float)
    whole = len(near_masks(BITS, distance))
    names = [f"v{i}" for i in range(partitions)]
    if widest > 62:
        raise ValueError("a partition must have fewer than 63 bits")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("print").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("print"), *[pa.array(part_value(values, g).view(np.int64)) for g in groups]],
                names=["print", *names],
            )

    parts = materialize(prints.select("print").mapInArrow(split, "print long, " + ", ".join(f"{v} long" for v in names)),
                        "simhash-parts")
    # what each value of each partition holds: counted over all fingerprints
    counted = parts
    for v in names:
        held = parts.groupBy(v).agg(F.count(F.lit(1)).alias(f"n_{v}"))
        counted = counted.join(held, v)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [[near_masks(len(g), t) for t in range(distance + 1)] for g in groups]
        every = near_masks(BITS, distance)

        def rows(part: int, values: np.ndarray, around: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            keys = (values[:, None] ^ around[None, :]).ravel()
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), part, np.int32)), pa.array(keys.view(np.int64)),
                 pa.array(np.repeat(prints, len(around)))],
                names=["part", "value", "a"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                prints = piece.column("print").to_numpy()
                values = [piece.column(v).to_numpy().view(np.uint64) for v in names]
                counts = np.stack([piece.column(f"n_{v}").to_numpy() for v in names], axis=1).astype(float)
                chosen, cost = thresholds(counts, balls, distance)
                dear = cost > whole
                for i in range(partitions):
                    for t in range(distance + 1):
                        pick = (chosen[:, i] == t) & ~dear
                        if pick.any():
                            yield rows(i, values[i][pick], masks[i][t], prints[pick])
                for lot in np.array_split(np.flatnonzero(dear), max(1, int(dear.sum()) // 256)):
                    if len(lot):
                        yield rows(partitions, prints[lot].view(np.uint64), every, prints[lot])

    probes = counted.select("print", *names, *[f"n_{v}" for v in names]).mapInArrow(probe, "part int, value long, a long")
    index = parts.select(
        F.col("print").alias("b"),
        F.inline(F.array(*[
            F.struct(F.lit(i).alias("part"), F.col(c).alias("value")) for i, c in enumerate([*names, "print"])
        ])),
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    p, x = probes.alias("p"), index.alias("x")
    on = (F.col("p.part") == F.col("x.part")) & (F.col("p.value") == F.col("x.value")) & (F.col("a") < F.col("b")) & near
    return p.join(x, on).select("a", "b")


def _rooted(classes: DataFrame, distance: int, partitions: int) -> DataFrame:
    """``classes`` (one row for each fingerprint) with ``root``, the least fingerprint of its component."""
    found = connected(near_links(classes.select("print"), distance, partitions))
    joined = classes.join(found.withColumnRenamed("node", "print"), "print", "left")
    return joined.withColumn("root", F.coalesce("root", "print"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE, partitions: int = PARTITIONS) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable by links).

    A null or empty text, or one of white space only, has fingerprint zero and links like any
    other. Repeated rows come out each; rows without a doc_id take part and count for the
    component, whose id is null only if no row of it has one. An empty table gives no rows;
    other columns are ignored.
    """
    rows = materialize(fingerprints(docs.withColumn("doc_id", F.col("doc_id").cast("long")), size=size), "simhash-prints")
    classes = rows.groupBy("print").agg(F.min("doc_id").alias("first"))
    rooted = _rooted(classes, distance, partitions)
    heads = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = rooted.join(heads, "root").select(F.col("print").alias("_print"), "component_id")
    return rows.join(ids, F.col("print") == F.col("_print")).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE, partitions: int = PARTITIONS) -> DataFrame:
    """One row of ``docs`` for each near-duplicate component, unchanged: the least doc_id, then the least text hash.

    Only fingerprints are grouped, by grouped minima; the kept rows are found again by
    (doc_id, hash of the text), and of rows equal in both one stays. Rows without doc_id
    come last in their component.
    """
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"), "doc_id", "text", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"),
    )
    rows = materialize(fingerprints(keyed, ("doc_id", "_id", "_hash"), size), "simhash-prints")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_id", "_hash"))
    rooted = _rooted(rows.groupBy("print").agg(head.alias("head")), distance, partitions)
    kept = rooted.groupBy("root").agg(F.min("head").alias("head")).select("head._id", "head._hash").distinct()
    found = keyed.select("row", "_id", "_hash").join(kept, ["_id", "_hash"], "left_semi")
    once = Window.partitionBy("_id", "_hash").orderBy("_id")
    return found.withColumn("_copy", F.row_number().over(once)).filter("_copy = 1").select("row.*")
