"""Toxicity by noisy-channel deobfuscation: decode what hides a word, then score the restored text.

A token that has look-alike signs, doubles or stretches letters, or spells a word in single
letters is a noisy reading of words. Its lattice holds, for every run of equal characters,
what the writer may have meant (a sign's letters, one or two of a stretched letter, nothing
or the end of a word for a separator or a gap, any letter for an asterisk) with the cost of
that noise; Viterbi search finds the likeliest words under a character trigram model counted
over the whole corpus. The plain reading is kept beside it. Other tokens of plain letters have
a single path and are taken as they are, numbers are numbers. Each part of a token counts;
only alternative readings of one part are merged.

The restored words are scored: words and word beginnings weigh the log odds of the class in
labelled rows, a logistic curve over the strongest weights of a document gives the score.
Weights and curve come from disjoint parts of a bounded sample of labelled rows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import fold, materialize
from vigil.llm.labels import least_hashes, logistic, sigmoid, training_labels

FOLDS, HELD = 3, 1
TOXIC = 0.7  # least score of a toxic document
SAMPLE_ROWS = 20_000  # labelled rows for fitting, drawn by hash, one for each doc_id
MAX_WEIGHTS = 5_000  # strongest features kept
LEAST_ROWS = 4  # toxic rows that must show a feature
LEAST_ODDS = 1.5  # least log odds of a feature
STEMS = (4, 5, 6, 7, 8)  # word beginnings that are features
LEAST_LETTERS = 2  # decoded words are longer
SUMMARY = 5  # numbers that describe a document
CACHED = 300_000  # tokens per worker process; the cache starts afresh beyond

# FIXED VALUES: letters that a look-alike sign may stand for
LOOK_ALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "і": "i", "у": "y",
}
SEPARATORS = "._-*~'’`^/\\,:; ​‌‍­"

LETTERS = "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = 28  # word end, a to z, anything else
END, OTHER = 0, 27
SLACK = 4.0  # log probability that a word's own ends among spelled letters may lack
SIGN_COST, SEPARATOR_COST, DOUBLE_COST, STRETCH_COST, ANY_COST = 0.7, 0.4, 3.0, 0.3, 2.0

WORD = re.compile(r"[^\W\d_]+")
DOUBLED = re.compile(r"(.)\1")
SAME = re.compile(r"(.)\1+")
SPELLED = re.compile(r"(?<![^\s(\[{<«\"'])[^\s.,;:/*_\-](?:[\s.,;:/*_\-]+[^\s.,;:/*_\-]){2,}(?!\w)")
GAP = re.compile(r"[\s.,;:/*_\-]+")
EDGE = ".,;:!?\"'’»«)(…[]{}&%#*~^=<>/\\"
STRICT = re.compile(r"\*|([^\w\s]|\d)\1")
LOOKS = re.compile("[" + "".join(map(re.escape, (c for c in LOOK_ALIKE if c > "z"))) + "]")
PLAIN_EDGE = "".join(c for c in EDGE if c not in LOOK_ALIKE and c != "*")
BETWEEN = re.compile(rf"[^{re.escape(SEPARATORS.replace('*', ''))}]+")
BYTE_SYMBOL = bytes(b - 96 if 97 <= b <= 122 else OTHER if b >= 128 else END for b in range(256))


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else END if c == " " else OTHER


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities [a, b, c] of symbol c after a and b, counted over every text of the corpus."""
    size = SYMBOLS**3

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for scalar in batch.column("text"):
                text = scalar.as_py()
                if text:
                    s = (b"  " + text.encode("utf-8", "replace").lower() + b" ").translate(BYTE_SYMBOL)
                    x = np.frombuffer(s, dtype=np.uint8).astype(np.int32)
                    total += np.bincount((x[:-2] * SYMBOLS + x[1:-1]) * SYMBOLS + x[2:], minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["cell", "n"])

    counts = np.zeros(size)
    sums = docs.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # as many as there are trigrams of symbols
        counts[r["cell"]] = r["n"]
    return trigram_model(counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS))


def trigram_model(counts: np.ndarray) -> np.ndarray:
    """Trigrams smoothed by bigrams, those by single symbols."""
    single = (counts.sum((0, 1)) + 1) / (counts.sum() + SYMBOLS)
    pairs = counts.sum(0)
    double = (pairs + 5 * single) / (pairs.sum(1, keepdims=True) + 5)
    return np.log((counts + 5 * double[None]) / (counts.sum(2, keepdims=True) + 5))


def runs(token: str) -> list[tuple[str, int]]:
    found: list[tuple[str, int]] = []
    stars = "***" not in token
    for c in token:
        if found and found[-1][0] == c and not (c == "*" and stars):  # two asterisks are two letters
            found[-1] = (c, found[-1][1] + 1)
        else:
            found.append((c, 1))
    return found


def readings(c: str, n: int, strict: bool = False) -> list[tuple[str, float]]:
    """What a run of ``n`` characters ``c`` may stand for, with the cost of the noise.

    Strictly, two equal signs are two letters, and an asterisk is a letter.
    """
    if "a" <= c <= "z" or (c.isalpha() and c not in LOOK_ALIKE):
        if n == 1:
            return [(c, 0.0)]
        return [(c, DOUBLE_COST if n == 2 else STRETCH_COST), (c * 2, 0.0 if n == 2 else STRETCH_COST + 0.5)]
    found = []
    for letter in LOOK_ALIKE.get(c, ""):
        if not (strict and n == 2):
            found.append((letter, SIGN_COST + (0.0, DOUBLE_COST, STRETCH_COST)[min(n, 3) - 1]))
        if n > 1:
            found.append((letter * 2, SIGN_COST))
    if c == " ":  # a gap between spelled letters
        return [("", 0.0), (" ", 0.0)]
    if (c in SEPARATORS or not found) and not (strict and c == "*" and n == 1):
        found.append(("", SEPARATOR_COST))
        if c != "*":
            found.append((" ", 0.0))
    if c == "*" and n == 1:  # a letter struck out
        found += [(x, ANY_COST) for x in LETTERS]
    return found


def decoded(token: str, model: np.ndarray, strict: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, word) of the likeliest words that the lower-case token is a noisy reading of."""
    # paths are linked backwards, so long runs are not copied: (path before, letters, start of the run)
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(END, END): (0.0, None)}
    at = 0
    for c, n in runs(token):
        following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        options = readings(c, n, strict)
        for (a, b), (score, path) in states.items():
            for letters, cost in options:
                if letters == " " and b == END:
                    letters = ""  # no word to end
                x, y, total = a, b, score - cost
                for letter in letters:
                    s = symbol(letter)
                    total += model[x, y, s]
                    x, y = y, s
                if (x, y) not in following or following[x, y][0] < total:
                    following[x, y] = (total, (path, letters, at))
        states = following
        at += n
    path = max(((score + model[a, b, END], path) for (a, b), (score, path) in states.items()), key=lambda x: x[0])[1]
    found, letters, end = [], [], len(token)
    while path:
        path, part, start = path
        if part == " ":
            found.append((start, end, "".join(reversed(letters))))
            letters, end = [], start
        else:
            letters.append(part)
    found.append((0, end, "".join(reversed(letters))))
    return [x for x in reversed(found) if x[2]]


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest reading of the lower-case token, words parted by spaces."""
    return " ".join(w for _, _, w in decoded(token, model))


def likelihood(words: str, model: np.ndarray) -> float:
    """Log probability of words parted by spaces."""
    s = [END, END, *map(symbol, words), END]
    return float(sum(model[a, b, c] for a, b, c in zip(s, s[1:], s[2:])))


def folded(word: str) -> str:
    """The word without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def noisy(core: str) -> bool:
    """Whether the characters may stand for others: the lattice has more than one path that matters."""
    if core.isalpha():
        return bool(len(core) > 2 and DOUBLED.search(core)) or any(c in LOOK_ALIKE for c in core if c > "z")
    return len(core) > 2 and any(c.isalpha() or (c in LOOK_ALIKE and not c.isdigit()) for c in core)


def plain_word(token: str) -> str:
    """The token without signs at its edges if that is a word with a single reading, else empty."""
    core = token.strip(EDGE)
    single = core.isascii() and core.isalpha() and not DOUBLED.search(core) and core == token.strip(PLAIN_EDGE)
    return core if single else ""


def plain_paths(token: str) -> list[list[tuple[int, int, str]]]:
    """The undecoded readings: the words as they are, and those with accents without them."""
    plain = [m.span() + (m[0],) for m in WORD.finditer(token)]
    if token.isascii():
        return [plain]
    return [plain, [(a, b, f) for a, b, w in plain if (f := folded(w)) != w]]


def noisy_spans(token: str) -> list[tuple[int, int]]:
    """What is decoded: the whole without and with look-alike signs at its edges, and what stands between separators."""
    left, right = len(token) - len(token.lstrip(EDGE)), len(token.rstrip(EDGE))
    far_left, far_right = len(token) - len(token.lstrip(PLAIN_EDGE)), len(token.rstrip(PLAIN_EDGE))
    spans = {(i, j): None for i in (left, far_left) for j in (right, far_right) if i < j}
    spans.update((m.span(), None) for m in BETWEEN.finditer(token))
    return [(i, j) for i, j in spans if noisy(token[i:j])]


def token_parts(token: str, model: np.ndarray) -> list[list[list[str]]]:
    """The parts of a lower-case token without white space, in order; of each its alternative readings, as words.

    The first reading is the plain one. Readings whose words overlap belong to one part.
    """
    if word := plain_word(token):
        return [[[word]]]
    paths = plain_paths(token)
    for i, j in noisy_spans(token):
        for strict in (False, True) if STRICT.search(token, i, j) else (False,):
            paths.append([(i + a, i + b, w) for a, b, w in decoded(token[i:j], model, strict) if len(w) > LEAST_LETTERS])
    parts: list[list[list[str]]] = []
    until = -1
    for a, b, path, word in sorted((a, b, k, w) for k, words in enumerate(paths) for a, b, w in words):
        if a >= until:
            parts.append([[] for _ in paths])
        until = max(until, b)
        parts[-1][path].append(word)
    return [[r for k, r in enumerate(p) if k == 0 or (r and r not in p[:k])] for p in parts]


def restored_words(token: str, model: np.ndarray) -> list[str]:
    """The words of a lower-case token without white space: itself, its parts, its decoded readings."""
    parts = token_parts(token, model)
    return list(dict.fromkeys([w for p in parts for w in p[0]] + [w for p in parts for r in p[1:] for w in r]))


def spelled_readings(text: str, model: np.ndarray, wanted: Spellings | None = None) -> list[list[list[str]]]:
    """Words spelled in single characters with white space or signs between: for each run its alternative readings.

    With ``wanted``, only of runs that may hold one of its words, wherever they begin.
    """
    found = []
    for m in SPELLED.findall(text):
        if not m.isalnum() and any(map(str.isspace, m)):  # others are single tokens
            apart, close = GAP.sub(" ", m), GAP.sub("", m)
            if wanted is None or wanted.reach(apart, anywhere=True) or wanted.reach(close, anywhere=True):
                found.append([decode(apart, model).split(), decode(close, model).split()])
    return found


def spelled_words(text: str, model: np.ndarray) -> list[str]:
    """The words of all readings of spelled runs."""
    return [w for readings in spelled_readings(text, model) for w in dict.fromkeys(w for r in readings for w in r)]


def restore(text: str, model: np.ndarray) -> str:
    """The text in lower case with every obfuscated token replaced by its reading."""
    text = SPELLED.sub(lambda m: decode(GAP.sub(" ", m[0]), model), text.lower())
    return " ".join(" ".join(w for p in token_parts(t, model) for w in p[-1]) or t for t in text.split())


def features(word: str) -> list[str]:
    return ["=" + word, *[word[:k] for k in STEMS if len(word) > k]]


def document_words(text: str, model: np.ndarray) -> set[str]:
    text = text.lower()
    words = {w for t in set(text.split()) for w in restored_words(t, model)}
    words.update(spelled_words(text, model))
    return words


@lru_cache(maxsize=100_000)
def letters_of(c: str, n: int) -> tuple[str, ...]:
    return tuple(dict.fromkeys(letters for letters, _ in readings(c, n)))


class Spellings:
    """The weighted words and word beginnings as a trie, walked by all paths of a token's lattice at once.

    A lattice without a path into a weighted word or beginning cannot decode to one, so its
    likeliest path need not be searched for: an unweighted reading adds nothing.
    """

    OFF = -1  # inside a word that no weighted one begins like

    def __init__(self, features: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.word, self.stem = [0], [False]  # length of the weighted word that ends here, or 0; a weighted beginning ends here
        for f in features:
            at = 0
            for c in f.removeprefix("="):
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.word.append(0)
                    self.stem.append(False)
                at = self.next[at][c]
            if f[0] == "=":
                self.word[at] = len(f) - 1
            else:
                self.stem[at] = True

    def reach(self, noisy: str, least: int = 0, anywhere: bool = False) -> bool:
        """Whether some path of the lattice has a weighted word of more than ``least`` letters, or a word with a weighted beginning.

        ``anywhere``: words may begin and end inside others. Costs are not looked at, and the
        strict lattice has no path beside these.
        """
        nodes, word, stem = self.next, self.word, self.stem
        states = {0}
        for c, n in runs(noisy):
            following = set()
            for letters in letters_of(c, min(n, 3)):
                if letters == " ":
                    if any(word[s] > least for s in states if s > 0):
                        return True
                    following.add(0)
                elif not letters:
                    following |= states
                else:
                    for s in states:
                        for letter in letters:
                            if s == self.OFF:
                                break
                            if stem[s]:
                                return True
                            s = nodes[s].get(letter, self.OFF)
                            if anywhere and s > 0 and word[s]:
                                return True
                        following.add(s)
            if anywhere:
                following.add(0)
            states = following
        return any(word[s] > least for s in states if s > 0)


HEAD = 4  # letters by which most words are told from all weighted ones


def squeezed(word: str) -> str:
    """The word with every run of equal letters as one."""
    return SAME.sub(r"\1", word)


_TOKENS: list = [b"", {}]  # of a worker process: which weights, and the weights of the tokens met so far


class Weights:
    """Weights of words, and a document's summary of the strongest."""

    def __init__(self, weights: dict[str, float], model: np.ndarray):
        self.weights, self.model = weights, model
        self.key = hashlib.sha256(repr(sorted(weights.items())).encode() + model.tobytes()).digest()
        self.spellings = Spellings(weights)
        bare = [f.removeprefix("=") for f in weights]
        self.heads = {f[:HEAD] for f in bare}
        self.squeezed_heads = {squeezed(f)[:HEAD] for f in bare}
        self.ways: dict[str, bool] = {}
        self.whole = {f[1:] for f in weights if f[0] == "=" and len(f) > 4}
        self.beginnings = {w[:k] for w in self.whole for k in range(1, len(w))}

    @property
    def tokens(self) -> dict[str, tuple[float, ...]]:
        """Known tokens; tasks of one worker process share them."""
        if _TOKENS[0] != self.key:
            _TOKENS[:] = [self.key, {}]
        return _TOKENS[1]

    def word(self, word: str) -> float:
        if word[:HEAD] not in self.heads:
            return 0.0
        return max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)

    def merged(self, readings: list[list[str]]) -> list[float]:
        """Weights above zero of one part: the strongest of its alternative readings, then the second strongest, and so on."""
        ranked = (sorted(map(self.word, words), reverse=True) for words in readings)
        return [w for w in map(max, zip_longest(*ranked, fillvalue=0.0)) if w > 0]

    def joined(self, tokens: list[str]) -> list[float]:
        """Weights of words that stand in several bits with white space between ('stu pid').

        The bits together are a weighted word that none of them outweighs, and the lattice
        takes them as one word rather than as several. Single letters are spelled runs.
        """
        found = {}
        for i, first in enumerate(tokens):
            if first not in self.beginnings:
                if first[0] not in EDGE:
                    continue
                first = first.lstrip(EDGE)
                if first not in self.beginnings:
                    continue
            if i + 1 == len(tokens):
                break
            pair = first + tokens[i + 1]
            if pair not in self.beginnings and pair.rstrip(EDGE) not in self.whole:
                continue
            bits, j = [first], i + 1
            while j < len(tokens):  # ends with the longest weighted word
                bits.append(tokens[j])
                j += 1
                whole = "".join(bits)
                end = whole.rstrip(EDGE)
                if end in self.whole and end not in found and any(len(b.strip(EDGE)) > 1 for b in bits):
                    weight = self.word(end)
                    spaced = " ".join(bits).rstrip(EDGE)
                    if weight > max(map(self.word, spaced.split())) and decode(spaced, self.model) == end:
                        found[end] = weight
                if whole not in self.beginnings:
                    break
        return list(found.values())

    def inside(self, letters: str) -> list[str]:
        """Weighted words among spelled letters where their own ends are not much less likely than the likeliest ones."""
        found, i = [], 0
        while i < len(letters):
            k, longest = i + 1, i
            while k <= len(letters) and (letters[i:k] in self.beginnings or letters[i:k] in self.whole):
                longest = k if letters[i:k] in self.whole else longest
                k += 1
            if longest > i:
                around = [" ".join(x) for x in (letters[max(0, i - 8) : i], letters[i:longest], letters[longest : longest + 8])]
                before, after = decode(around[0], self.model), decode(around[2], self.model)
                own = likelihood(" ".join(filter(None, (before, letters[i:longest], after))), self.model)
                if own >= likelihood(decode(" ".join(filter(None, around)), self.model), self.model) - SLACK:
                    found.append(letters[i:longest])
                    i = longest
                    continue
            i += 1
        return found

    def struck(self, token: str) -> list[str]:
        """Weighted words that the token is with one or two letters struck out by asterisks."""
        core = token.strip(PLAIN_EDGE)
        if not 1 <= core.count("*") <= 2 or not core.replace("*", "").isalpha():
            return []
        found = [""]
        for c in core:
            found = [w + x for w in found for x in (LETTERS if c == "*" else c)]
            found = [w for w in found if w in self.beginnings or w in self.whole]
        return [w for w in found if w in self.whole]

    def token(self, token: str) -> tuple[float, ...]:
        """The weights above zero of all parts of the token."""
        known = self.tokens
        if len(known) >= CACHED:
            known.clear()
        found = self.undecoded(token)
        if found is None:
            parts = token_parts(token, self.model)
            if "*" in token and (struck := self.struck(token)):
                parts = [[*(r for p in parts for r in p), *([w] for w in struck)]]  # without separators, one part
            found = tuple(w for p in parts for w in self.merged(p))
        known[token] = found
        return found

    def no_way(self, token: str) -> bool:
        """Whether the token is a word whose first letters alone tell it from all weighted ones.

        It has letters only, none of them a look-alike, so only doubled letters and accents
        have other readings: all begin alike once runs of equal letters are one.
        """
        core = token
        if not core.isalpha():
            core = token.strip(EDGE)
            if not core.isalpha() or core != token.strip(PLAIN_EDGE):
                return False
        if not core.isascii() and LOOKS.search(core):
            return False
        head = core[: HEAD + 1]
        way = self.ways.get(head)
        if way is None:
            if len(self.ways) >= CACHED:
                self.ways.clear()
            way = self.ways[head] = self._begins(head, len(core) > len(head))
        return not way

    def _begins(self, head: str, more: bool) -> bool:
        """Whether a word with these first letters may begin like a weighted one; ``more`` letters follow."""
        for way in {head, folded(head)}:
            short = squeezed(way)
            if more and len(short) < HEAD:
                return True  # told by later letters
            if any(short[:k] in self.squeezed_heads for k in range(1, HEAD + 1)):
                return True
        return False

    def undecoded(self, token: str) -> tuple[float, ...] | None:
        """The token's weights where decoding it can add none, or None.

        Several weighted words of the plain readings are left to the parts that decoding makes.
        """
        if word := plain_word(token):
            return (w,) if (w := self.word(word)) > 0 else ()
        found = tuple(w for path in plain_paths(token) for _, _, x in path if (w := self.word(x)) > 0)
        if len(found) > 1 or ("*" in token and self.struck(token)):
            return None
        if any(self.spellings.reach(token[i:j], LEAST_LETTERS) for i, j in noisy_spans(token)):
            return None
        return found

    def summary(self, text: str) -> list[float]:
        """Strongest weight, sum and number of weighted words, their share, and the distinct words."""
        text = text.lower()
        known, ways, found = self.tokens, self.ways, []
        tokens = text.split()
        distinct = set(tokens)
        for t in distinct:
            if ways.get(t[: HEAD + 1]) is False and t.isascii() and t.isalpha():
                continue  # as no_way finds, for most tokens
            key = t.strip(PLAIN_EDGE)  # signs that stand for nothing else
            w = known.get(key)
            if w is None:
                if self.no_way(key):
                    continue
                w = self.token(key)
            if w:
                found.extend(w)
        for readings in spelled_readings(text, self.model, self.spellings):
            found += self.merged([*readings, self.inside("".join(readings[0])), self.inside("".join(readings[1]))])
        found += self.joined(tokens)
        n = max(1, len(distinct))
        return [max(found, default=0.0) / 5, float(np.log1p(sum(found))), float(np.log1p(len(found))),
                float(np.log1p(100 * len(found) / n)), float(np.log(n)) / 5]


def feature_weights(sample: DataFrame, model: np.ndarray) -> dict[str, float]:
    """Log odds of the features of the sampled rows (text, y), counted by rows that show them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = (Counter(), Counter())
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist()):
                words = document_words(text.as_py() or "", model)
                both[y].update({f for w in words for f in features(w)})
                both[y][""] += 1
            names = list(both[0].keys() | both[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([both[0][f] for f in names], pa.int64()),
                 pa.array([both[1][f] for f in names], pa.int64())], names=["feature", "clean", "toxic"],
            )

    counted = sample.select("text", "y").mapInArrow(count, "feature string, clean long, toxic long")
    counted = counted.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = materialize(counted.filter(F.col("toxic") >= LEAST_ROWS), "toxicity-features")
    rows = counted.filter("feature = ''").first()
    if rows is None:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (rows["toxic"] + 1)) - F.log((F.col("clean") + 0.5) / (rows["clean"] + 1))
    strong = counted.filter("feature <> ''").withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
    kept = strong.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "feature").limit(MAX_WEIGHTS).collect()
    return {r["feature"]: r["odds"] for r in kept}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> tuple[Weights, np.ndarray]:
    """Weights and curve from at most ``sample`` labelled rows outside the held-out fold."""
    model = character_model(docs)
    # the ids are bounded by the sample, so they may be broadcast
    drawn = least_hashes(training_labels(labels, "toxic", FOLDS, HELD), sample, "doc_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    # of rows that repeat a doc_id one counts, so the sample is as many rows as ids
    first = F.min(F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "text")).alias("first")
    rows = rows.groupBy("doc_id").agg(first, F.min("y").alias("y")).select("doc_id", "first.text", "y")
    rows = materialize(rows, "toxicity-sample")
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(10))
    weights = Weights(feature_weights(rows.filter(part < 7), model), model)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [weights.summary(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("y")], names=["x", "y"])

    rest = rows.filter(part >= 7).select("text", "y").mapInArrow(summarise, "x array<double>, y int").collect()
    if len({r["y"] for r in rest}) < 2:
        return weights, np.array([0.0] * SUMMARY + [-2.0])
    return weights, logistic(np.array([r["x"] for r in rest]), np.array([r["y"] for r in rest], dtype=float), ridge=0.02)


def _probability(weights: Weights, curve: np.ndarray, texts) -> np.ndarray:
    x = np.array([weights.summary(t.as_py() or "") for t in texts]).reshape(-1, SUMMARY)
    return sigmoid(x @ curve[:-1] + curve[-1])


SCORE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()),
    T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
])


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = TOXIC) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher: more toxic), predicted (1: ``threshold`` or more).

    Labels are used of rows outside the held-out fold only. Null and empty texts are scored
    as texts without words, very long ones whole; repeated rows come out each, with one score;
    of several labels of a doc_id the largest counts; an empty table gives no rows, other
    columns are ignored. Without labels of both classes all scores are equal and low.
    """
    weights, curve = fit(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _probability(weights, curve, batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([fold(i, FOLDS) == HELD for i in ids], pa.bool_()),
                 pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=SCORE_SCHEMA.names,
            )

    return docs.select("doc_id", "text").mapInArrow(score, SCORE_SCHEMA)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = TOXIC) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged; no text is shuffled but the sample's.

    A score equal to the threshold goes. Null and empty texts are judged as texts without
    words, rows without doc_id or other values like any row, repeated rows alike; all
    columns are kept, whatever their names; an empty table stays empty.
    """
    weights, curve = fit(docs, labels)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_probability(weights, curve, batch.column("text")) < threshold))

    return docs.mapInArrow(chosen, docs.schema)
