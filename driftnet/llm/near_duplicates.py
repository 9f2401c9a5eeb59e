"""Near-duplicate texts through R-trees of count vectors (problem 1).

A text is the set of its runs of three words. The runs are hashed into groups; the group counts are a point. For two sets A, B the
shared runs are at most the sum over groups of the smaller count, so a pair can only reach similarity t where that sum is at
least t / (1 + t) * (|A| + |B|). Groups come in two grains of one hash: ``FINE`` bits for the upper level of the tree and, folded
together, ``GROUPS`` coordinates for the boxes below.

The upper level cuts space by single fine coordinates, so that each part can be searched on its own machine. All groups stand
in one order, rarest first. A partner of A shares at least t * |A| of A's counts, so the rarest group that two such texts share lies
among the first groups of either that leave less than that behind: a text is filed under those groups of its own, and every pair that
the bound allows meets in the part of its rarest shared group, and in as many more as their sizes ask for (see :func:`meetings`). Nothing
is sampled and no pair is missed. The order comes from counts of all texts in a table of fixed size; an unsure order only makes
parts larger.

The points of a part are packed by size into boxes and boxes of boxes. A box's corner of largest counts bounds all pairs below
it; pairs of boxes are followed down only while their summed minima allow a pair. What survives is verified on the whole sets.
A part that the counts say is large is cut into blocks of rows, joined block by block, so that no task holds it.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet.runtime import materialize, spread

WORDS = 3
LEAST_WORDS = 40
THRESHOLD = 0.6
#: Bits of a fine group; of these the first SLOT choose its place in the table of counts.
FINE, SLOT = 32, 22
#: Coordinates of a point in the boxes.
GROUPS = 128
#: Shared counts that two filings are asked for where their sizes allow.
MEET = 6
#: Children of a box.
FAN = 8
#: Rows of a block of a large part.
BLOCK = 8192
#: Bits of the table that marks texts to be read again.
MARK = 26
#: Copies of a text in a block.
COPIES = 1024
#: Characters taken at once.
CHUNK = 1 << 20
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _STEP
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether a code point is a letter or digit, its code, codes of places in a word)."""
    n = 0x110000
    letter = np.fromiter((chr(c).isalnum() for c in range(n)), dtype=bool, count=n)
    with np.errstate(over="ignore"):
        code = _mixed(np.arange(1, n + 1, dtype=np.uint64) * _MIX)
        place = _mixed(np.arange(1, 1025, dtype=np.uint64) * _STEP) | np.uint64(1)
    return letter, code, place


def _chunk_sets(texts: list[str], words: int, least: int) -> list[np.ndarray | None]:
    letter, code, place = _tables()
    lowered = [t.lower() for t in texts]
    a = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(letter[a])
    bounds = np.cumsum([len(t) + 1 for t in lowered])
    if not len(at):
        return [None] * len(texts)
    first = np.flatnonzero(np.append(True, np.diff(at) > 1))
    inside = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    with np.errstate(over="ignore"):
        h = _mixed(np.add.reduceat(code[a[at]] * place[inside & 1023], first))
        run = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for k in range(words):
            run = (run ^ h[k : len(h) - words + 1 + k]) * _MIX
            run ^= run >> np.uint64(29)
    ends = np.searchsorted(at[first], bounds)
    out: list[np.ndarray | None] = []
    lo = 0
    for hi in ends.tolist():
        if hi - lo >= max(least, words):
            own = np.sort(run[lo : hi - words + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        else:
            out.append(None)
        lo = hi
    return out


def sets_of(texts: Iterable[str], words: int = WORDS, least: int = LEAST_WORDS) -> Iterator[np.ndarray | None]:
    """Of each text the sorted distinct 64-bit hashes of the runs of ``words`` words of its lower-cased form, None below
    ``least`` words. A word is a longest run of letters and digits."""
    held: list[str] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= CHUNK:
            yield from _chunk_sets(held, words, least)
            held, size = [], 0
    if held:
        yield from _chunk_sets(held, words, least)


def shingles(text: str, words: int = WORDS, least: int = LEAST_WORDS) -> np.ndarray | None:
    """The set of one text, see :func:`sets_of`."""
    return next(sets_of([text], words, least))


def point(sh: np.ndarray) -> np.ndarray:
    """Counts of a set's runs by coarse group."""
    return np.bincount(((sh >> np.uint64(64 - FINE)) % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS).astype(np.uint32)


def packed(counts: np.ndarray) -> bytes:
    """A point in a byte a count, or in four where a count needs more."""
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def unpacked(points: Iterable[bytes]) -> np.ndarray:
    rows = [np.frombuffer(p, np.uint8 if len(p) == GROUPS else np.uint32) for p in points]
    return np.stack(rows).astype(np.int32 if max(map(len, points)) > GROUPS else np.int16) if rows else np.zeros((0, GROUPS), np.int16)


def name_of(sh: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    import xxhash

    return tuple(np.frombuffer(xxhash.xxh3_128_digest(sh.tobytes()), np.int64).tolist())


def needed(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Shared runs that two set sizes need for the threshold."""
    return threshold / (1 + threshold) * (a + b) - 1e-6


def filed_under(sh: np.ndarray, table: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fine groups of a set under which it is filed, counts in those before each, own counts): its rarest groups, until what is
    left can't hold a partner's share."""
    groups = sh >> np.uint64(64 - FINE)
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    groups, counts = groups[starts], np.diff(np.append(starts, len(sh)))
    order = np.argsort(table[(groups >> np.uint64(FINE - SLOT)).astype(np.int64)], kind="stable")  # ties by group
    upto = np.cumsum(counts[order])
    take = int(np.searchsorted(upto, len(sh) - least_shared(len(sh), threshold) + 1)) + 1
    order, upto = order[:take], upto[:take]
    return groups[order], upto - counts[order], counts[order]


def least_shared(size, threshold: float):
    """What a set shares with any partner."""
    return np.ceil(threshold * size - 1e-6).astype(np.int64)


def meetings(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(counts that sets of two sizes must share, counts of these that must be shared under their filings). If they share T, less
    than T of a set's counts lie behind its first size - T + L, so at least L of those they share are among the first of both."""
    whole = np.ceil(needed(a, b, threshold)).astype(np.int64)
    return whole, np.minimum(MEET, whole - np.maximum(least_shared(a, threshold), least_shared(b, threshold)) + 1)


def reach(size: np.ndarray, before: np.ndarray, threshold: float) -> np.ndarray:
    """The largest partner for which a filing with so many counts before it can be among the first that matter."""
    return np.floor((size - before + MEET - 1) * (1 + threshold) / threshold - size + 1e-6).astype(np.int64)


def filings(filed: list[tuple[np.ndarray, ...]], reps: list[int], table: np.ndarray, usual: float, block: int) -> list[np.ndarray]:
    """For each set the parts it is filed under, in a number each: ``FINE`` bits that name the part, 24 bits of the counts before (at most all
    ones), 7 bits of its own count. A group that many texts have is cut into blocks, and a pair of blocks is a part."""
    if not filed:
        return []
    groups, before, counts = (np.concatenate(x) for x in zip(*filed, strict=True))
    ends = np.cumsum([len(x[0]) for x in filed])
    above = (np.minimum(before, (1 << 24) - 1) | np.minimum(counts, 127) << 24).astype(np.uint64) << np.uint64(FINE)
    out = np.split((groups | above).view(np.int64), ends[:-1])
    blocks = np.maximum(1, np.ceil((table[(groups >> np.uint64(FINE - SLOT)).astype(np.int64)] - usual) / block)).astype(np.int64)
    for k in np.unique(np.searchsorted(ends, np.flatnonzero(blocks > 1), side="right")).tolist():
        rows = slice(ends[k] - len(filed[k][0]), ends[k])
        n, made = blocks[rows], [out[k][blocks[rows] == 1]]
        for g, a, b in zip(groups[rows][n > 1], above[rows][n > 1], n[n > 1].tolist(), strict=True):
            own = _mixed(np.array([reps[k]], np.int64).view(np.uint64) ^ g) % np.uint64(b)
            others = np.arange(b, dtype=np.uint64)
            left, right = np.minimum(others, own), np.maximum(others, own)
            name = _mixed(_mixed(_mixed(g * _MIX + left + np.uint64(1)) + right + np.uint64(1)) + np.uint64(b)) >> np.uint64(64 - FINE)
            made.append((name | a).view(np.int64))
        out[k] = np.concatenate(made)
    return out


class Forest:
    """Packed R-trees of count vectors, one a part: rows of a part in order of size, ``FAN`` to a box, boxes likewise."""

    def __init__(self, parts: np.ndarray, ids: np.ndarray, points: np.ndarray):
        size = points.sum(1, dtype=np.int64)
        order = np.lexsort((size, parts))
        parts, self.ids = parts[order], ids[order]
        #: (largest counts, smallest and largest size, first child of each box and the end), points first
        self.levels = [(points[order], size[order], size[order], None)]
        owner = np.cumsum(np.append(True, parts[1:] != parts[:-1])) - 1 if len(parts) else np.zeros(0, np.int64)
        trees = owner[-1] + 1 if len(owner) else 0
        while len(owner) and (len(owner) > trees or len(self.levels) == 1):
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            starts = np.flatnonzero((np.arange(len(owner)) - begin[owner]) % FAN == 0)
            top, least, most, _ = self.levels[-1]
            self.levels.append((np.maximum.reduceat(top, starts), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts), np.append(starts, len(owner))))
            owner = owner[starts]

    def boxes(self) -> int:
        return sum(len(level[1]) for level in self.levels[1:])

    def pairs(self, threshold: float, at_once: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of ids of a part whose points can reach the threshold, each once."""
        last = len(self.levels) - 1
        roots = np.arange(len(self.levels[-1][1])) if last else np.zeros(0, np.int64)
        todo = [(last, roots, roots)]
        while todo:
            level, i, j = todo.pop()
            if not len(i):
                continue
            if level and len(i) > at_once // FAN**2:
                half = len(i) // 2
                todo += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
                continue
            if level == 0:
                yield self.ids[i], self.ids[j]
                continue
            ends = self.levels[level][3]
            wide, high = ends[i + 1] - ends[i], ends[j + 1] - ends[j]
            n = wide * high
            of = np.repeat(np.arange(len(i)), n)
            step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            a, b = ends[i][of] + step // high[of], ends[j][of] + step % high[of]
            keep = (i[of] != j[of]) | (a < b) | ((a == b) & (level > 1))
            top, least, most, _ = self.levels[level - 1]
            keep &= (most[b] >= threshold * least[a]) & (most[a] >= threshold * least[b])
            a, b = a[keep], b[keep]
            ok = np.minimum(top[a], top[b]).sum(1, dtype=np.int64) >= needed(least[a], least[b], threshold)
            todo.append((level - 1, a[ok], b[ok]))


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    t = F.col(text).cast("string")
    return df.where(F.col(key).isNotNull() & (F.length(t) > 0)).select(F.col(key).cast("string").alias("id"), t.alias("text"))


def rarity(texts: DataFrame) -> np.ndarray:
    """How many texts have a group of each slot, over all texts (column text): a table of fixed size, added up block by block."""
    width = 1 << SLOT - 9

    def tally(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << SLOT, np.int64)
        for pdf in batches:
            for s in sets_of(pdf["text"]):
                if s is not None:
                    np.add.at(counts, (s >> np.uint64(64 - SLOT)).astype(np.int64), 1)
        blocks = counts.reshape(-1, width)
        used = np.flatnonzero(blocks.any(axis=1))
        if len(used):
            yield pd.DataFrame({"block": used.astype(np.int32), "n": [zlib.compress(b.astype(np.uint8 if b.max() < 256 else np.int64).tobytes(), 1) for b in blocks[used]]})

    def add_up(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for block, n in zip(pdf["block"], pdf["n"], strict=True):
                n = zlib.decompress(n)
                n = np.frombuffer(n, np.uint8 if len(n) == width else np.int64).astype(np.int64)
                sums[block] = sums[block] + n if block in sums else n
        if sums:
            yield pd.DataFrame({"block": list(sums), "n": [np.minimum(n, (1 << 31) - 1).astype(np.int32).tobytes() for n in sums.values()]})

    schema = "block int, n binary"
    out = np.zeros((1 << 9, width), np.int32)
    for row in spread(texts.select("text")).mapInPandas(tally, schema).repartition("block").mapInPandas(add_up, schema).collect():
        out[row.block] = np.frombuffer(row.n, np.int32)
    return out.reshape(-1)


def features(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """Columns id, rep and check (128 bits of each text's set), size, point, and the parts it is filed under (see
    :func:`filings`); of equal sets that one task meets, only the first is filed."""
    rows = _texts(df, key, text)
    table = rarity(rows)
    usual = float(np.median(table))
    sent = df.sparkSession.sparkContext.broadcast(table)  # 4 << SLOT bytes at every size
    block, none = BLOCK, (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches:
            out, filed = [], []
            for k, s in zip(pdf["id"], sets_of(pdf["text"]), strict=True):
                if s is None:
                    continue
                rep, check = name_of(s)
                filed.append(filed_under(s, sent.value, threshold) if rep not in seen else none)
                seen.add(rep)
                out.append((k, rep, check, len(s), packed(point(s))))
            rows = pd.DataFrame(out, columns=["id", "rep", "check", "size", "point"])
            rows["filed"] = filings(filed, rows["rep"].tolist(), sent.value, usual, block)
            yield rows

    return spread(rows).mapInPandas(run, "id string, rep long, check long, size int, point binary, filed array<long>")


def _whole(batches: Iterable[pd.DataFrame], name: Callable[[pd.DataFrame], np.ndarray]) -> Iterator[pd.DataFrame]:
    """Frames sorted by ``name``, put together so that no name goes on in the next."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        names = name(pdf)
        other = np.flatnonzero(names != names[-1])
        if len(other):
            yield pd.concat([*held, pdf.iloc[: other[-1] + 1]], ignore_index=True)
            held = [pdf.iloc[other[-1] + 1 :]]
        elif held and name(held[-1].iloc[-1:])[0] != names[0]:
            yield pd.concat(held, ignore_index=True)
            held = [pdf]
        else:
            held.append(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def _of_others(values: np.ndarray, starts: np.ndarray, n: np.ndarray, pick: np.ufunc, none: int) -> np.ndarray:
    """For each row the smallest or largest value (as ``pick`` says) of the other rows of its part."""
    best = np.repeat(pick.reduceat(values, starts), n)
    at = np.flatnonzero(values == best)
    part = np.repeat(np.arange(len(n)), n)
    first = at[np.append(True, part[at][1:] != part[at][:-1])]
    rest = values.copy()
    rest[first] = none
    best[first] = pick.reduceat(rest, starts)
    return best


def in_reach(size: np.ndarray, far: np.ndarray, starts: np.ndarray, n: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows have another row of their part that they can be similar to, as sizes and reach tell. Of parts of more than 256
    rows some without are kept."""
    keep = (_of_others(size, starts, n, np.minimum, 1 << 40) <= far) & (_of_others(far, starts, n, np.maximum, -1) >= size) & (_of_others(size, starts, n, np.maximum, -1) >= threshold * size)
    for k in np.unique(n[(n > 2) & (n <= 256)]).tolist():
        at = starts[n == k][:, None] + np.arange(k)
        for rows in np.array_split(at, max(1, at.size * k // 2_000_000)):
            s, f = size[rows], far[rows]
            ok = (s[:, None, :] <= f[:, :, None]) & (s[:, None, :] >= threshold * s[:, :, None])
            ok &= ok.transpose(0, 2, 1)
            ok[:, np.arange(k), np.arange(k)] = False
            keep[rows] = ok.any(2)
    return keep


_MASK = (1 << FINE) - 1
#: Filings handled at once.
ROWS = 1 << 20


def _large(frames: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    for pdf in frames:
        held.append(pdf)
        if sum(map(len, held)) >= least:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def _trees(batches: Iterable[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Of filings sorted by part and rep, those that can meet another, gathered by tree and set. A part goes into the tree of its
    smallest set, so that parts with the same smallest set make one tree."""
    for pdf in _large(_whole(batches, lambda x: x["filed"].to_numpy() & _MASK), ROWS):
        filed, rep, size = pdf["filed"].to_numpy(), pdf["rep"].to_numpy(), pdf["size"].to_numpy().astype(np.int64)
        part = filed & _MASK
        keep = np.append(True, (part[1:] != part[:-1]) | (rep[1:] != rep[:-1]))
        for last in (False, False, True):
            filed, rep, size = filed[keep], rep[keep], size[keep]
            part = filed & _MASK
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
            n = np.diff(np.append(starts, len(part)))
            if last or not len(part):
                break
            keep = np.repeat(n, n) > 1
            keep &= in_reach(size, reach(size, filed >> FINE & (1 << 24) - 1, threshold), starts, n, threshold)
        many = np.repeat(n, n) > 1
        tree, rep, filed = np.repeat(rep[starts], n)[many], rep[many], filed[many]
        if len(rep):
            order = np.lexsort((rep, tree))
            tree, rep, filed = tree[order], rep[order], filed[order]
            first = np.flatnonzero(np.append(True, (tree[1:] != tree[:-1]) | (rep[1:] != rep[:-1])))
            yield pd.DataFrame({"tree": tree[first], "rep": rep[first], "filed": [x.tobytes() for x in np.split(filed, first[1:])]})


def met(filed: list[np.ndarray], size: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """The summed minima of pairs of sets over the filings that they share among the first of both that matter."""
    whole, asked = meetings(size[x], size[y], threshold)
    n = np.array([len(f) for f in filed])

    def keyed(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.concatenate([filed[k] for k in of.tolist()])
        pair = np.repeat(np.arange(len(of)), n[of])
        ok = (own >> FINE & (1 << 24) - 1) < (size[of] - whole + asked)[pair]
        key = pair[ok] << FINE | own[ok] & _MASK
        order = np.argsort(key)
        return key[order], (own[ok] >> FINE + 24)[order]

    (kx, cx), (ky, cy) = keyed(x), keyed(y)
    at = np.minimum(np.searchsorted(ky, kx), max(0, len(ky) - 1))
    same = ky[at] == kx if len(ky) else np.zeros(len(kx), bool)
    return np.bincount((kx[same] >> FINE).astype(np.int64), np.minimum(cx[same], cy[at[same]]), minlength=len(x)).astype(np.int64)


def _join_trees(batches: Iterable[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    for pdf in _whole(batches, lambda x: x["tree"].to_numpy()):
        pdf = pdf.sort_values(["tree", "rep"], kind="stable")
        tree, rep = pdf["tree"].to_numpy(), pdf["rep"].to_numpy()
        first = np.flatnonzero(np.append(True, (tree[1:] != tree[:-1]) | (rep[1:] != rep[:-1])))
        pieces = pdf["filed"].tolist()
        # tasks may have met the same part only where a hash of the part sent it, so that nothing comes twice
        filed = [np.frombuffer(b"".join(pieces[lo:hi]), np.int64) for lo, hi in zip(first, [*first[1:], len(pieces)], strict=True)]
        points = unpacked(pdf["point"].iloc[first])
        rep, size = rep[first], points.sum(1, dtype=np.int64)
        for x, y in Forest(tree[first], np.arange(len(first)), points).pairs(threshold):
            for lo in range(0, len(x), 4096):
                p, q = x[lo : lo + 4096], y[lo : lo + 4096]
                swap = (size[p] > size[q]) | (size[p] == size[q]) & (rep[p] > rep[q])
                p, q = np.where(swap, q, p), np.where(swap, p, q)
                n = met(filed, size, p, q, threshold)
                yield pd.DataFrame({"a": rep[p], "b": rep[q], "asked": meetings(size[p], size[q], threshold)[1], "met": n})[n > 0]


def candidates(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Columns a, b: pairs of sets (by rep, the smaller set first) that meet in a tree, whose boxes and points can reach the
    threshold, and whose summed minima over the fine groups under which both are filed can, added up over all trees."""
    part = F.col("filed").bitwiseAND(F.lit(_MASK))
    filed = members.select("rep", "size", F.explode("filed").alias("filed")).repartition(part).sortWithinPartitions(part, "rep")
    trees = filed.mapInPandas(lambda batches: _trees(batches, threshold), "tree long, rep long, filed binary")
    points = members.groupBy("rep").agg(F.min(F.struct("id", "point")).alias("m")).select("rep", "m.point")
    ordered = trees.join(points, "rep").repartition("tree").sortWithinPartitions("tree")
    pairs = ordered.mapInPandas(lambda batches: _join_trees(batches, threshold), "a long, b long, asked long, met long")
    return pairs.groupBy("a", "b").agg(F.sum("met").alias("met"), F.first("asked").alias("asked")).where("met >= asked").select("a", "b")


def shortened(sh: np.ndarray) -> bytes:
    """A set as it is sent for verification: the leading 40 bits of each run's hash. Two texts of a thousand runs have one false
    match among a million pairs."""
    return (sh >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _longer(sent: bytes) -> np.ndarray:
    out = np.zeros((len(sent) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(sent, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view(np.uint64)


def _verify(batches: Iterable[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep, sim = [], []
        for a, b in zip(pdf["sa"], pdf["sb"], strict=True):
            x, y = _longer(a), _longer(b)
            both = len(np.intersect1d(x, y))
            s = both / (len(x) + len(y) - both)
            keep.append(s >= threshold)
            sim.append(s)
        out = pdf[["a", "b"]].assign(similarity=sim)
        yield out[np.array(keep, dtype=bool)]


def _mark(key: str):
    return F.pmod(F.xxhash64(key), F.lit(1 << MARK)).alias("mark")


def marked(ids: DataFrame) -> np.ndarray:
    """A table of bits, of fixed size, with those of the ids set; it tells which texts are worth reading again."""
    width = 1 << 10

    def union(frames: Iterable[tuple[int, bytes]]) -> pd.DataFrame:
        out: dict[int, np.ndarray] = {}
        for block, bits in frames:
            new = np.frombuffer(zlib.decompress(bits), np.uint8)
            out[block] = out[block] | new if block in out else new
        return pd.DataFrame({"block": list(out), "bits": [zlib.compress(b.tobytes(), 1) for b in out.values()]}).astype({"block": "int32"})

    def tally(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(1 << MARK - 3, np.uint8)
        for pdf in batches:
            mark = pdf["mark"].to_numpy()
            np.bitwise_or.at(bits, mark >> 3, (1 << (mark & 7)).astype(np.uint8))
        blocks = bits.reshape(-1, width)
        used = np.flatnonzero(blocks.any(axis=1))
        if len(used):
            yield pd.DataFrame({"block": used.astype(np.int32), "bits": [zlib.compress(b.tobytes(), 1) for b in blocks[used]]})

    schema = "block int, bits binary"
    found = ids.select(_mark("id")).mapInPandas(tally, schema).repartition("block")
    out = np.zeros((1 << MARK - 3) // width * width, np.uint8).reshape(-1, width)
    for row in found.mapInPandas(lambda batches: iter([union((b, x) for pdf in batches for b, x in zip(pdf["block"], pdf["bits"], strict=True))]), schema).collect():
        out[row.block] = np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return out.reshape(-1)


def similar_sets(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(pairs of sets a, b, similarity; membership id, rep of the texts). Texts with equal sets share one rep."""
    members = materialize(features(df, key, text, threshold), "points")
    pairs = materialize(candidates(members, threshold), "candidates")
    clash = F.raise_error(F.lit("two sets share a 64-bit hash"))
    named = members.groupBy("rep").agg(F.when(F.min("check") == F.max("check"), F.min("id")).otherwise(clash).alias("id"))
    marks = marked(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(named, "rep"))
    sent = df.sparkSession.sparkContext.broadcast(marks)  # 1 << MARK bits at every size

    def again(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The sets of the texts whose mark is set: of all that are needed and some more. No text is moved."""
        seen: set[int] = set()
        for pdf in batches:
            mark = pdf["mark"].to_numpy()
            own = np.flatnonzero(sent.value[mark >> 3] >> (mark & 7) & 1)
            rows = []
            for sh in sets_of(pdf["text"].iloc[own]):
                if sh is not None and (rep := name_of(sh)[0]) not in seen:
                    seen.add(rep)
                    rows.append((rep, shortened(sh)))
            yield pd.DataFrame(rows, columns=["rep", "s"])

    texts = spread(_texts(df, key, text).select(_mark("id"), "text"))
    sets = materialize(texts.mapInPandas(again, "rep long, s binary"), "runs")
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
    good = both.mapInPandas(lambda batches: _verify(batches, threshold), "a long, b long, similarity double")
    good = good.dropDuplicates(["a", "b"])  # a row that comes twice has brought its set twice
    return materialize(good, "verified"), members.select("id", "rep")


def similar_pairs(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """Columns content_hash_a < content_hash_b, similarity: all pairs of keys whose sets reach the threshold.

    Texts below ``LEAST_WORDS`` words, null and empty texts and null keys are in no pair; a key that comes twice is one text
    (with the texts it comes with); equal sets are pairs of similarity 1, expanded by joins on the set. An empty table gives no rows.
    """
    pairs, members = similar_sets(df, key, text, threshold)
    m = members.distinct()
    a, b = m.select(F.col("rep").alias("a"), F.col("id").alias("x")), m.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    apart = pairs.join(a, "a").join(b, "b").select("x", "y", "similarity")
    # texts of one set are dealt to blocks, and the blocks joined: no task holds all copies of a text
    copies = m.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / COPIES).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = m.join(copies, "rep").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("left"), F.greatest("own", k).alias("right")))
    dealt = dealt.select("rep", "id", "own", F.explode(tiles).alias("t")).select("rep", "id", "own", "t.*")
    met = dealt.alias("l").join(dealt.alias("r"), ["rep", "left", "right"]).where("l.id < r.id and (left = right or l.own <> r.own)")
    equal = met.select(F.col("l.id").alias("x"), F.col("r.id").alias("y"), F.lit(1.0).alias("similarity"))
    both = apart.unionByName(equal).where("x <> y")
    return both.select(F.least("x", "y").alias("content_hash_a"), F.greatest("x", "y").alias("content_hash_b"), "similarity").dropDuplicates(["content_hash_a", "content_hash_b"])


def classes(pairs: DataFrame, members: DataFrame, rounds: int | None = None) -> DataFrame:
    """Columns id, class_id, links: the connected class of every text (its smallest member's id) and its number of links to
    texts of other sets. Labels fall along links and jump over known labels, so that rounds grow with the log of a chain; each is
    written to the shared folder. They go on until no label changes; more than ``rounds`` of them, if given, are an error."""
    ends = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    ends = materialize(ends.distinct(), "links")
    first = members.groupBy("rep").agg(F.min("id").alias("label"))
    labels = materialize(first, "labels")
    for done in itertools.count(1):
        near = ends.join(labels.select(F.col("rep").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("u", "rep"), "rep", "left").select("rep", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        # a label is the id of a set's first text; take over what that set has found
        jump = lower.select(F.col("label").alias("was"), F.col("new").alias("to")).where("was <> to").groupBy("was").agg(F.min("to").alias("to"))
        new = materialize(lower.join(jump.withColumnRenamed("was", "new"), "new", "left").select("rep", "label", F.least("new", F.coalesce("to", "new")).alias("new")), "labels")
        changed = new.where("label <> new").limit(1).count()
        labels = new.select("rep", F.col("new").alias("label"))
        if not changed:
            break
        if done == rounds:
            raise RuntimeError(f"labels still change after {rounds} rounds")
    links = ends.groupBy("u").agg(F.count(F.lit(1)).alias("links"))
    out = members.distinct().join(labels, "rep").join(links.withColumnRenamed("u", "rep"), "rep", "left")
    return out.select("id", F.col("label").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
