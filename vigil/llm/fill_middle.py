"""Fill-in-middle transformation as a pipeline of Arrow kernels.

Each text is cut into units (white space and the word after it; white space at the end is a
unit of its own). The units of a batch are one flat array with the row each came from; a
unit's ordinal in its row and the row's two cuts give its role: prefix, middle or suffix.
The units of each role are filtered, rebuilt into one list for each row and joined, and the
joined pieces with the sentinels between make the output. The cuts and the form follow from
the hash of the document's id, so a repeated task writes the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import text_slices

UNIT = rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
BORDER = b"\xff"  # a byte that no UTF-8 text holds
SENTINELS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
SEED = 42
RATE = 50  # in a hundred documents, those not left plain
SPM_SHARE = 80  # in a hundred of those, the ones with the suffix first

FIM_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
])


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers from the id's hash; a missing id is the empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All units of the texts in one flat array, and the row of each."""
    marked = pc.replace_substring_regex(texts.cast(pa.binary()), pattern=UNIT, replacement=b"\\0" + BORDER)
    lists = pc.split_pattern(marked, pattern=BORDER)
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(flat), 0)  # what stands after the last border is empty
    return flat.filter(some), parents.filter(some).to_numpy()


def joined(flat: pa.Array, parents: np.ndarray, mask: np.ndarray, rows: int) -> pa.Array:
    """For each row the units under ``mask``, joined."""
    sizes = np.bincount(parents[mask], minlength=rows)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), flat.filter(pa.array(mask)))
    return pc.binary_join(lists, b"")


def transformed(texts: pa.Array, ids: list[int | None], sentinels: tuple[str, str, str], rate: int, spm_share: int, seed: int):
    """Units, form, prefix and middle characters and output of each text."""
    rows = len(texts)
    flat, parents = units(texts)
    n = np.bincount(parents, minlength=rows)
    h = np.array([draws(i, seed) for i in ids], dtype=np.int64).reshape(rows, 4)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    ordinals = np.arange(len(parents)) - (np.cumsum(n) - n)[parents]
    role = (ordinals[:, None] >= cuts[parents]).sum(axis=1)
    prefix, middle, suffix = (joined(flat, parents, role == r, rows) for r in range(3))
    plain = (n == 0) | (h[:, 2] % 100 >= rate)
    for s in sentinels:
        plain |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    before, between, last = (pa.scalar(s.encode(), pa.binary()) for s in sentinels)
    psm = pc.binary_join_element_wise(before, prefix, between, suffix, last, middle, b"")
    spm = pc.binary_join_element_wise(between, suffix, before, prefix, last, middle, b"")
    first = h[:, 3] % 100 < spm_share
    output = pc.if_else(pa.array(plain), texts.cast(pa.binary()), pc.if_else(pa.array(first), spm, psm)).cast(pa.string())
    form = pa.array(np.where(plain, "plain", np.where(first, "spm", "psm")).tolist(), pa.string())

    def characters(pieces: pa.Array) -> pa.Array:
        counts = pc.utf8_length(pieces.cast(pa.string())).cast(pa.int64())
        return pc.if_else(pa.array(plain), pa.scalar(None, pa.int64()), counts)

    return pa.array(n, pa.int64()), form, characters(prefix), characters(middle), output


def rebuilt(outputs: pa.Array, forms: pa.Array, sentinels: tuple[str, str, str] = SENTINELS) -> pa.Array:
    """The texts that the outputs were made of, from outputs and forms alone."""

    def halves(values: pa.Array, sentinel: str) -> tuple[pa.Array, pa.Array]:
        lists = pc.split_pattern(values, pattern=sentinel, max_splits=1)
        return pc.list_element(lists, 0), pc.list_element(lists, 1)

    before, between, last = sentinels
    names = forms.to_numpy(zero_copy_only=False)
    at = {f: np.flatnonzero(names == f) for f in ("plain", "psm", "spm")}
    prefix, rest = halves(halves(outputs.take(pa.array(at["psm"])), before)[1], between)
    suffix, middle = halves(rest, last)
    psm = pc.binary_join_element_wise(prefix, middle, suffix, "")
    suffix, rest = halves(halves(outputs.take(pa.array(at["spm"])), between)[1], before)
    prefix, middle = halves(rest, last)
    spm = pc.binary_join_element_wise(prefix, middle, suffix, "")
    parts = pa.concat_arrays([outputs.take(pa.array(at["plain"])), psm, spm])
    order = np.argsort(np.concatenate([at["plain"], at["psm"], at["spm"]]), kind="stable")
    return parts.take(pa.array(order))


def fill_in_middle(
    docs: DataFrame, sentinels: tuple[str, str, str] = SENTINELS, rate: int = RATE, spm_share: int = SPM_SHARE, seed: int = SEED
) -> DataFrame:
    """Per row: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    A null text is an empty one; empty texts and those that hold a sentinel stay plain, and so
    do 100 - ``rate`` in a hundred others. White space alone is one unit. Rows without doc_id
    share the draws of the empty id, repeated rows come out each, very long texts are whole
    and cut by themselves, an empty table gives no rows, other columns are ignored. Each row
    follows from its id and text alone: nothing is shuffled.
    """
    if any(not s or s[0] in "".join(t[1:] for t in sentinels) for s in sentinels) or len(set(sentinels)) < 3:
        raise ValueError("sentinels must differ, and begin with a character that stands nowhere later in them")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                ids = part.column("doc_id").cast(pa.int64())
                found = transformed(texts, ids.to_pylist(), sentinels, rate, spm_share, seed)
                yield pa.RecordBatch.from_arrays([ids, *found], names=FIM_SCHEMA.names)

    return docs.select("doc_id", "text").mapInArrow(compute, FIM_SCHEMA)


def restore(outputs: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``outputs`` of :func:`fill_in_middle` with ``restored``, the text rebuilt from ``output`` and ``form``."""
    schema = T.StructType([*outputs.schema.fields, T.StructField("restored", T.StringType())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "output"):
                found = rebuilt(texts, part.column("form"), sentinels)
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=schema.names)

    return outputs.mapInArrow(compute, schema)


def fill_in_middle_digests(docs: DataFrame) -> DataFrame:
    """The transformation with digests in place of the texts: of the output and of the text rebuilt from it."""
    return restore(fill_in_middle(docs)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )
