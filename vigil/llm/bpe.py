"""Byte-level BPE encoding and decoding over Arrow batches.

A rank file (token bytes and rank) becomes a byte-level BPE model of the ``tokenizers``
library: bytes are mapped to printable characters, every split of a token into two known
tokens is a merge with the token's rank, and a match of the pattern that is a token by
itself is taken whole. Offsets come back in characters of the text; a character whose bytes
several tokens share lies in the span of each. Decoding reverses the byte table; a stream
decoder holds back the bytes of a character until its last one has come.

Words repeat, so each Python worker keeps a bounded cache of encoded chunks. A chunk is one
space and what follows up to the next space; the pattern never joins what a space separates,
unless white space touches that space on both sides: such texts are one chunk. The library
splits and encodes each chunk that the cache lacks.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CACHE_CHUNKS = 500_000  # per cache of a worker process; it starts afresh beyond
LONG_CHUNK = 256  # longer chunks are encoded each time
# letters under any version of Unicode, then ASCII signs to the end: one match of the pattern each
WORD_AND_SIGNS = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)").fullmatch
# a chunk after its space: a word, signs, and perhaps a line's end with a word and signs after it. The
# pattern ends a match between any two of these parts.
PARTS = re.compile(
    r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)"
    r"(?:\n([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*))?"
).fullmatch
# a space inside white space: what follows may belong to the match before it
INNER_SPACE = re.compile(r"\s (?:\s|$)")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    """Encoder and decoder of one byte-level vocabulary."""

    def __init__(self, tokenizer, token_bytes: list[bytes]):
        self.tokenizer = tokenizer
        self.token_bytes = token_bytes
        self.shown = byte_characters()
        self.model_tokens = tokenizer.model.tokenize

    @classmethod
    def from_ranks(cls, path: str, pattern: str) -> ByteBpe:
        """A vocabulary given as ranks, split by ``pattern``."""
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        shown = byte_characters()
        name = {token: "".join(shown[b] for b in token) for token in ranks}
        merges = [
            (name[token[:i]], name[token[i:]])
            for token, _ in sorted(ranks.items(), key=lambda x: x[1])
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        model = models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        tokenizer = Tokenizer(model)
        tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        token_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            token_bytes[rank] = token
        return cls(tokenizer, token_bytes)

    @classmethod
    def from_json(cls, path: str) -> ByteBpe:
        """A vocabulary in the library's own format; special tokens in a text are ordinary text."""
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        back = {c: b for b, c in enumerate(byte_characters())}
        vocab = tokenizer.get_vocab(with_added_tokens=False)
        added = tokenizer.get_added_tokens_decoder()
        token_bytes = [b""] * (max([*vocab.values(), *added]) + 1)
        for token, i in vocab.items():
            token_bytes[i] = token.encode() if i in added else bytes(back[c] for c in token)
        return cls(tokenizer, token_bytes)

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode_with_offsets(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids, and for each the characters [start, end) of the text that its bytes touch."""
        encoding = self.tokenizer.encode(text, add_special_tokens=False)
        return encoding.ids, encoding.offsets

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.token_bytes[i] for i in ids])

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text that each token completes; bytes of an unfinished character wait for the next."""
        decoder = codecs.getincrementaldecoder("utf-8")(errors="replace")
        for i in ids:
            yield decoder.decode(self.token_bytes[i])
        yield decoder.decode(b"", final=True)

    def encode_chunk(self, chunk: str) -> list[int]:
        """The ids of a chunk: the library's model on each match of the library's pattern."""
        simple = WORD_AND_SIGNS(chunk)
        if not simple:
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        word, signs = simple.groups()
        found = self.encode_spaced(word[1:]) if word[0] == " " else [t.id for t in self.model_tokens(self.named(word))]
        return found + [t.id for t in self.model_tokens(signs)] if signs else found

    def named(self, word: str) -> str:
        """A word with its bytes shown as the model knows them; ASCII letters are shown as they are."""
        return word if word.isascii() else "".join([self.shown[b] for b in word.encode()])

    def encode_spaced(self, word: str) -> list[int]:
        """The ids of letters, known to be nothing else, behind a space."""
        return [t.id for t in self.model_tokens(self.shown[32] + self.named(word))]


class ChunkCache(dict):
    """What ``make(ids)`` gives for each chunk after the first of a text, by the chunk without its space.

    A word with signs or a line's end behind it is joined (``join``) from its parts, so the
    library encodes each word once, not once for each way it is punctuated.
    """

    def __init__(self, bpe: ByteBpe, make: Callable[[list[int]], object], join: Callable[[object, object], object]):
        super().__init__()
        self.bpe, self.make, self.join = bpe, make, join
        self.bare: dict[str, object] = {}  # parts that no space precedes

    def part(self, text: str):
        found = self.bare.get(text)
        if found is None:
            if len(self.bare) >= CACHE_CHUNKS // 4:
                self.bare.clear()
            found = self.bare[text] = self.make(self.bpe.encode_chunk(text))
        return found

    def __missing__(self, rest: str):
        parts = PARTS(rest)
        if parts is None:
            found = self.make(self.bpe.encode_chunk(" " + rest))
        else:
            word, signs, next_word, next_signs = parts.groups()
            if len(word) == len(rest):
                found = self.make(self.bpe.encode_spaced(word))
            else:
                found = self[word]
                if signs:
                    found = self.join(found, self.part(signs))
                if next_word:
                    found = self.join(self.join(found, self.part("\n")), self.part(next_word))
                    if next_signs:
                        found = self.join(found, self.part(next_signs))
        if len(rest) < LONG_CHUNK:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
            self[rest] = found
        return found

    def of(self, text: str) -> list:
        """The entries of the chunks of ``text``, in order."""
        if not text:
            return []
        if INNER_SPACE.search(text):
            return [self.make(self.bpe.encode_chunk(text))]
        first, *rest = text.split(" ")
        found = [self[x] for x in rest]
        return [self.make(self.bpe.encode_chunk(first)), *found] if first else found


_LOADED: dict[tuple[str, str | None], ByteBpe] = {}


_CACHES: dict[tuple, ChunkCache] = {}


def cache(bpe: ByteBpe, name: str, make: Callable[[list[int]], object], join: Callable[[object, object], object]) -> ChunkCache:
    """The process's cache of this vocabulary for one use (``name``)."""
    return _CACHES.setdefault((id(bpe), name), ChunkCache(bpe, make, join))


def load(path: str, pattern: str | None = None) -> ByteBpe:
    """The vocabulary at ``path`` (ranks need a pattern), loaded once for each process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = (path, pattern)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe.from_ranks(path, pattern) if pattern else ByteBpe.from_json(path)
    return _LOADED[key]


def text_groups(column: pa.Array, limit_chars: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) runs of a string column with a bounded number of characters each; null is empty."""
    start, texts, size = 0, [], 0
    for i, scalar in enumerate(column):
        text = scalar.as_py() or ""
        if texts and size + len(text) > limit_chars:
            yield start, texts
            start, texts, size = i, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield start, texts


DIGEST_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    T.StructField("n_bytes", T.LongType()),
])


def encode_digests(docs: DataFrame, path: str, pattern: str | None) -> DataFrame:
    """Encode and decode every text; per row doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes.

    A null or empty text has no ids: zero tokens and the hash of nothing. Repeated rows come
    out each, an empty table gives no rows, other columns are ignored.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        entries = cache(
            bpe, "digest", lambda ids: (",".join(map(str, ids)), bpe.decode_bytes(ids)),
            lambda a, b: (f"{a[0]},{b[0]}", a[1] + b[1]),
        )
        for batch in batches:
            rows: list[tuple] = []
            for scalar in batch.column("text"):
                found = entries.of(scalar.as_py() or "")
                listed, decoded = ",".join([x[0] for x in found]), b"".join([x[1] for x in found])
                rows.append((
                    listed.count(",") + 1 if listed else 0,
                    hashlib.sha256(listed.encode()).hexdigest(),
                    hashlib.sha256(decoded).hexdigest(),
                    len(decoded),
                ))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()),
                 pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())],
                names=DIGEST_SCHEMA.names,
            )

    return docs.select("doc_id", "text").mapInArrow(digest, DIGEST_SCHEMA)


ENCODED_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())),
])


def encode_documents(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id, ids, starts, ends: the ids of every text and the characters each id covers.

    Null and empty texts give empty arrays; repeated rows come out each.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        kind = pa.list_(pa.int32())
        for batch in batches:
            for start, group in text_groups(batch.column("text"), 1_000_000):
                found = [bpe.encode_with_offsets(t) for t in group]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, len(group)).cast(pa.int64()),
                     pa.array([f[0] for f in found], kind),
                     pa.array([[a for a, _ in f[1]] for f in found], kind),
                     pa.array([[b for _, b in f[1]] for f in found], kind)],
                    names=ENCODED_SCHEMA.names,
                )

    return docs.select("doc_id", "text").mapInArrow(encode, ENCODED_SCHEMA)


DECODED_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def decode_documents(encoded: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); bytes that are no UTF-8 become U+FFFD, null ids null."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            texts = [None if not x.is_valid else bpe.decode_bytes(x.as_py()).decode("utf-8", "replace")
                     for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=DECODED_SCHEMA.names
            )

    return encoded.select("doc_id", "ids").mapInArrow(decode, DECODED_SCHEMA)
