"""Template residue, filler, error pages and script notices in place of content (problem 10).

Character 4-gram models of filler, of error notices and of natural text give each position of a text a likelihood ratio; its
sums over windows (lines, and sentences of long lines) localise residue, and a text is excluded where residue covers more
than a passing mention would. Unfilled placeholders are localised alike: models of the shapes of fields and of missing values against those of natural
text give ratios whose cumulative sum rises over a placeholder and falls elsewhere; each rise that is high enough is a window. In
it the placeholder's form is checked exactly, and the text around it is judged: in a sentence the natural model knows, the
placeholder stands where a value belongs; in a sentence that speaks of placeholders it doesn't.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet.llm.residue_seeds import ERROR_SEEDS, FIELD_SEEDS, FILLER_SEEDS, MISSING_SEEDS, SPEAKING_SEEDS
from driftnet.runtime import materialize, spread

BITS = 18
GRAM = 4
#: Counts are added up in blocks of so many 4-grams.
BLOCK = 4096
#: Natural texts stay below 0.05 and residue above 0.2 on the test tables.
COVERAGE = 0.15
CONTEXT = 28
#: How far a sum of log ratios must rise over a placeholder.
RISE = 6.0
#: Characters taken at once.
CHUNK = 1 << 19
_WINDOW = re.compile(r"[^\n]+?(?:[.!?]+(?=\s+[^\Wa-zà-ÿ\d_]|\s+[¡¿«“\"'(\[{<$])|\n|\Z)", re.S)
PLACEHOLDER = re.compile(
    r"(?=[{$\[<%@_«*#NXT]|[Uu]ndef|UNDEF|null)(?:"  # what every form starts with, tried first: most characters end here
    r"\{\{[^{}\n]{1,60}\}\}|\$\{[^{}\n]{1,60}\}|\[\[[^\[\]\n]{1,60}\]\]|<%[^%\n]{1,60}%>|\{%[^%\n]{1,60}%\}|<<[^<>\n]{1,60}>>|@@\w{1,60}@@"
    r"|%[^\W\d_]\w{1,40}%|(?<!_)__[^\W\d_]\w{0,38}?__(?!_)|«[^\W\d_]\w{1,40}»|\*\|\w{1,40}\|\*|%\(\w{1,40}\)s|#[A-Z_]{2,40}#"
    r"|\{[^\W_]\w{0,40}\}|\[[^\W\d_][^\[\]\n\d]{1,60}\]|<[^\W\d_][^<>@\n/=]{0,40} [^<>@\n/=]{1,40}>"
    r"|\b(?:[Uu]ndefined|UNDEFINED|NaN|X{4,}|TBD|TODO|null)\b|(?<!\w)_{3,20}(?=\s\w))"
)


@lru_cache(maxsize=1)
def _shape_table() -> np.ndarray:
    """Capitals, small letters and digits alike; everything else is itself."""
    n = 0x110000
    kind = (65 if (c := chr(i)).isupper() else 97 if c.isalpha() else 48 if c.isdigit() else i for i in range(n))
    return np.fromiter(kind, dtype=np.uint32, count=n)


def _hashed(a: np.ndarray) -> np.ndarray:
    """Hashes of the 4-grams of code points; the i-th starts at place i."""
    if len(a) < GRAM:
        return np.zeros(0, np.int64)
    h = np.zeros(len(a) - GRAM + 1, np.uint32)
    for k in range(GRAM):
        h *= np.uint32(0x01000193)
        h += a[k : len(a) - GRAM + 1 + k]
        h ^= h >> np.uint32(13)
    h *= np.uint32(0x9E3779B1)
    h >>= np.uint32(32 - BITS)
    return h.astype(np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def _grams(text: str) -> np.ndarray:
    """Hashes of the 4-grams of the lower-cased text, digits alike."""
    a = _points(text.lower())
    return _hashed(np.where((a >= 48) & (a <= 57), np.uint32(48), a))


def _shapes(text: str) -> np.ndarray:
    """Hashes of the 4-grams of a text's shape."""
    return _hashed(_shape_table()[_points(text)])


def _padded(text: str) -> str:
    return f"\n{text}\n"


class Chunk:
    """Some texts with the 4-grams of all of them, padded, in one array; ``at``: where each text's grams start, ``n``: how many it has."""

    def __init__(self, texts: list[str], grams=_grams):
        padded = [_padded(t.lower() if grams is _grams else t) for t in texts]
        sizes = np.array([len(t) for t in padded], np.int64)
        self.texts, self.n = texts, np.maximum(0, sizes - GRAM + 1)
        self.at = np.cumsum(sizes) - sizes
        self.grams = grams("".join(padded))
        #: Grams that reach over the end of a text.
        self.over = (np.cumsum(sizes)[:, None] - np.arange(1, GRAM)).ravel() if len(texts) else np.zeros(0, np.int64)
        self.over = self.over[(self.over >= 0) & (self.over < len(self.grams))]

    def sums(self, ratios: np.ndarray) -> np.ndarray:
        """Sums of the ratios before each gram and at the end."""
        return np.append(0.0, np.cumsum(ratios[self.grams], dtype=np.float64))

    def rises(self, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of the windows over which the sum of ratios rises by at least ``RISE``, in characters of the text."""
        r = ratios[self.grams].astype(np.float64)
        r[self.over] = -1e6  # a sum never goes on from one text to the next
        s = np.cumsum(r)
        if not len(s):
            return (np.zeros(0, np.int64),) * 3
        low = np.minimum.accumulate(np.append(0.0, s[:-1]))  # the sum's least value before each place
        hit = np.flatnonzero(s - low >= RISE)
        since = np.maximum.accumulate(np.where(np.append(True, low[1:] < low[:-1]), np.arange(len(s)), 0))[hit]
        first = np.flatnonzero(np.append(True, (np.diff(hit) > 1) | (since[1:] > since[:-1]))[: len(hit)])
        last = np.append(first[1:], len(hit))[: len(first)] - 1
        text = np.searchsorted(self.at, since[first], side="right") - 1
        return text, np.maximum(0, since[first] - self.at[text] - 1 - GRAM), hit[last] - self.at[text] + GRAM + 1


def _chunks(texts: Iterable[str]) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def count(texts: Iterable[str], grams=_grams) -> np.ndarray:
    """How often each 4-gram occurs in the texts."""
    counts = np.zeros(1 << BITS, np.int64)
    for held in _chunks(texts):
        c = Chunk(held, grams)
        keep = np.ones(len(c.grams), bool)
        keep[c.over] = False
        counts += np.bincount(c.grams[keep], minlength=1 << BITS)
    return counts


def fit(counts: np.ndarray, alpha: float) -> np.ndarray:
    """Log probabilities of the 4-grams of a class."""
    return np.log((counts + alpha) / (counts.sum() + alpha * len(counts))).astype(np.float32)


class Models:
    """Log-likelihood ratios by 4-gram: of filler and of error notices against natural text, of speaking against prose, and of
    fields (by shape) and missing values against natural text."""

    def __init__(self, counts: np.ndarray, shapes: np.ndarray):
        """Of the 4-grams of natural texts, and of those of their shapes."""
        unknown = np.full(1 << BITS, -BITS * np.log(2), np.float32)
        speaking = fit(count(SPEAKING_SEEDS), 0.01)
        natural = fit(counts, 0.05) if counts.any() else unknown
        both = np.maximum(natural, speaking - 1.0)
        self.residue = [fit(count(s), 0.01) - both for s in (ERROR_SEEDS, FILLER_SEEDS)]
        self.speaking = speaking - natural
        self.fields = fit(count(FIELD_SEEDS, _shapes), 0.01) - (fit(shapes, 0.05) if shapes.any() else unknown)
        self.missing = fit(count(MISSING_SEEDS), 0.01) - natural

    def coverages(self, chunk: Chunk) -> list[float]:
        """Of each text the part of its letters and signs that lies in windows where the likelier residue class is likelier than
        natural text."""
        sums = [chunk.sums(r) for r in self.residue]
        out = []
        for text, at, n in zip(chunk.texts, chunk.at.tolist(), chunk.n.tolist(), strict=True):
            spans = [m.span() for m in _WINDOW.finditer(text)]
            a = np.array(spans, np.int64).reshape(-1, 2)
            lo, hi = a[:, 0], np.minimum(a[:, 1] + 1, n)  # the padding shifts by one: grams that touch the window
            wide = hi > lo
            hi = np.maximum(hi, lo)
            above = wide & (np.maximum(*(s[at + hi] - s[at + lo] for s in sums)) > 0)
            sizes = np.array([len(text[x:y].strip()) for x, y in spans], np.int64)
            total = int(sizes[wide].sum())
            out.append(float(sizes[above].sum()) / total if total else 0.0)
        return out

    def coverage(self, text: str) -> float:
        return self.coverages(Chunk([text]))[0]

    def holes(self, chunk: Chunk) -> list[int]:
        """Of each text the placeholders that stand where a value belongs: in windows where the sum of the ratios of missing values or
        of fields rises, the form is checked and what stands around it."""
        found: list[set[int]] = [set() for _ in chunk.texts]
        for ratios, c in ((self.missing, chunk), (self.fields, Chunk(chunk.texts, _shapes))):
            for k, begin, end in zip(*(x.tolist() for x in c.rises(ratios)), strict=True):
                text = chunk.texts[k]
                for m in PLACEHOLDER.finditer(text, begin):
                    if m.start() >= end:
                        break
                    if m.start() not in found[k] and self.unfilled(text, m):
                        found[k].add(m.start())
        return [len(f) for f in found]

    def unfilled(self, text: str, m: re.Match) -> bool:
        """Whether a placeholder stands in prose rather than in words that speak of it."""
        lo = max(text.rfind("\n", 0, m.start()) + 1, m.start() - CONTEXT)
        line = text.find("\n", m.end())
        hi = min(len(text) if line < 0 else line, m.end() + CONTEXT)
        left, right = PLACEHOLDER.sub(" ", text[lo : m.start()]), PLACEHOLDER.sub(" ", text[m.end() : hi])
        around = np.concatenate([_grams(" " + left), _grams(right + " ")])
        return (self.speaking[around].sum() if len(around) else 0.0) <= 0

    def judge(self, texts: Iterable[str]) -> Iterator[tuple[float, int, bool]]:
        """(coverage, unfilled placeholders, whether the text is residue) of each text; blank texts are none."""
        for held in _chunks(texts):
            chunk = Chunk(held)
            for text, cover, holes in zip(held, self.coverages(chunk), self.holes(chunk), strict=True):
                yield (cover, holes, cover >= COVERAGE or holes > 0) if text.strip() else (0.0, 0, False)


def _gram_counts(texts: DataFrame, models=None) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the 4-grams of all texts (column t) and of their shapes, or of those that the broadcast models take for residue."""

    def looks(ts: list[str]) -> list[str]:
        return [t for held in _chunks(ts) for t, c in zip(held, models.value.coverages(Chunk(held)), strict=True) if c >= 0.3]

    def tally(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, 1 << BITS), np.int64)
        for pdf in batches:
            ts = pdf["t"].tolist() if models is None else looks(pdf["t"].tolist())
            counts += [count(ts), count(ts, _shapes)]
        blocks = counts.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        if len(used):
            yield pd.DataFrame({"block": used.astype(np.int32), "n": list(blocks[used])})

    def add_up(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for block, n in zip(pdf["block"], pdf["n"], strict=True):
                sums[block] = sums[block] + n if block in sums else n
        if sums:
            yield pd.DataFrame({"block": list(sums), "n": list(sums.values())})

    schema = "block int, n array<long>"
    out = np.zeros(((2 << BITS) // BLOCK, BLOCK), np.int64)
    for row in spread(texts).mapInPandas(tally, schema).repartition("block").mapInPandas(add_up, schema).collect():
        out[row.block] = row.n
    words, shapes = out.reshape(2, -1)
    return words, shapes


def judged(df: DataFrame, key: str, text: str) -> DataFrame:
    """Columns key, coverage, placeholders, residue for every row, whole texts; equal texts are judged alike.

    The natural model is fitted on all texts, whole, each distinct text once. They hold residue too: it is fitted, texts that
    look like residue are left out, and it is fitted again. Null keys are kept. An empty table gives no rows.
    """
    spark = df.sparkSession
    k, t = F.col(key), F.col(text).cast("string")
    texts = materialize(df.select(t.alias("t")).where(F.length("t") > 0).distinct(), "texts")
    counts = _gram_counts(texts)
    first = spark.sparkContext.broadcast(Models(*counts))  # five tables of 2 ** BITS numbers
    less = _gram_counts(texts, first)
    sent = spark.sparkContext.broadcast(Models(*(a - b for a, b in zip(counts, less, strict=True))))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = sent.value
        for pdf in batches:
            rows = list(models.judge("" if v is None else v for v in pdf["t"]))
            yield pd.DataFrame({"key": pdf["key"], "coverage": [r[0] for r in rows], "placeholders": [int(r[1]) for r in rows], "residue": [bool(r[2]) for r in rows]})

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(k.alias("key"), t.alias("t"))).mapInPandas(run, f"key {kind}, coverage double, placeholders int, residue boolean")
