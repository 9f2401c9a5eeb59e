"""Cutting oversized texts and files into pieces at natural boundaries (problem 5).

Texts and files are processed in byte ranges; a range is one row of work wherever it comes from, and no worker loads a whole
file. A worker reads its range with halos: before it what a boundary's left context can hold and the overlap, after it what one
piece can hold. It finds the boundaries and reduces them to an exit table: for every place in the range at which a piece can
end, where the chain of pieces that goes on from there leaves the range, and after how many pieces. Tables are stitched in order, one look-up a
range; prefix sums of the lengths make places absolute. Then each range, knowing where the chain enters it, emits the pieces
that follow on ends within it, by offset.

A piece starting at s ends at the last paragraph break in (s + limit // 2, s + limit], else the last line end, sentence end
or white space there, else at s + limit. The next piece starts ``overlap`` characters before that end.

Boundaries come after: a form feed, or a line feed that ends a blank line of at most ``BLANKS`` blanks (paragraph); a line
feed; white space after a full stop, question or exclamation mark with at most ``CLOSERS`` closing quotes, or an ideographic full stop
(sentence); white space. These bounds give the left halo, so that the ranges' boundaries are those of the whole text.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftnet.runtime import materialize, spread

#: Bytes of a range of a text column, and of a file.
RANGE, FILE_RANGE = 1 << 16, 4 << 20
BLANKS, CLOSERS = 256, 16
#: Bytes that a boundary's left context can hold: a closing quote has up to three, a blank one.
CONTEXT = max(BLANKS + 1, 3 * CLOSERS + 3)
#: A UTF-8 character has at most three bytes after its first.
TAIL = 3
END = -1
_TERMINAL, _CLOSING, _IDEOGRAPHIC = ".!?…", "\"'”»)", "。！？"
_WHITE = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)
PIECES = "id string, piece long, start long, end long, chars long, text string"


def _held(errors: list[int]) -> Callable:
    def handle(e: UnicodeDecodeError):
        errors.append(e.end - e.start)
        return "\udcff", e.end  # no valid UTF-8 decodes to it

    return handle


def decode(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(code points, first byte of each and the end). Each maximal run of bytes that isn't UTF-8 becomes one U+FFFD, as
    Python's "replace" does."""
    errors: list[int] = []
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        codecs.register_error("driftnet-span", _held(errors))
        text = raw.decode(errors="driftnet-span")
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    width = 1 + (a > 0x7F).astype(np.int64) + (a > 0x7FF) + (a > 0xFFFF)
    if errors:
        bad = a == 0xDCFF
        width[bad] = errors
        a[bad] = 0xFFFD
    return a, np.append(0, np.cumsum(width))


def _written(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le")


def fresh(raw: bytes, at: int) -> int:
    """The first place at or after byte ``at`` where decoding can begin: no byte within a character. Three continuation
    bytes before a place end whatever they belong to, so it is at most ``TAIL`` further."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80 and not (at >= 3 and all(raw[at - k] & 0xC0 == 0x80 for k in (1, 2, 3))):
        at += 1
    return min(at, len(raw))


def _last(flags: np.ndarray) -> np.ndarray:
    """For each place the last set place before it, or -1."""
    return np.append(-1, np.maximum.accumulate(np.where(flags, np.arange(len(flags)), -1))[:-1]) if len(flags) else np.zeros(0, np.int64)


def boundaries(a: np.ndarray) -> list[np.ndarray]:
    """Of code points the places after paragraph breaks, line ends, sentence ends and white space, each in order."""
    place = np.arange(len(a))
    line = a == 10
    white = np.isin(a, _WHITE)
    blank = (a == 32) | (a == 9) | (a == 13)
    before = _last(~blank)
    paragraph = line & (before >= 0) & (place - before - 1 <= BLANKS)
    paragraph &= line[np.maximum(before, 0)]
    closing, terminal, ideographic = (np.isin(a, [ord(c) for c in x]) for x in (_CLOSING, _TERMINAL, _IDEOGRAPHIC))
    said = _last(~closing)
    sentence = white & (said >= 0) & (place - said - 1 <= CLOSERS)
    sentence &= terminal[np.maximum(said, 0)]
    return [np.flatnonzero(x) + 1 for x in (paragraph | (a == 12), line, sentence | ideographic, white)]


class Range:
    """A range with what its halos show. Places are characters from the range's start; n: its own characters.

    raw: the bytes from ``lo - before`` on, up to the end of the file if ``eof``.
    """

    def __init__(self, raw: bytes, before: int, own: int, eof: bool, limit: int, overlap: int):
        if not 0 <= overlap < limit / 2:
            raise ValueError("the overlap must be below half of the limit")
        self.limit, self.overlap, self.eof = limit, overlap, eof
        first = fresh(raw, TAIL) if before >= _halos(limit, overlap)[0] else 0  # else raw begins where the text does
        lo, hi = fresh(raw, before), fresh(raw, before + own)
        self.points, self.bytes = decode(raw[first:])
        self.zero = int(np.searchsorted(self.bytes, lo - first))
        self.n = int(np.searchsorted(self.bytes, hi - first)) - self.zero
        self.known = len(self.points) - self.zero
        self.at = [x - self.zero for x in boundaries(self.points)]

    def after(self, start: int) -> int:
        """The end of the piece that starts at ``start``, END if it is the text's last."""
        if self.eof and self.known - start <= self.limit:
            return END
        lo, hi = start + self.limit // 2, start + self.limit
        for at in self.at:
            k = np.searchsorted(at, hi, side="right")
            if k and at[k - 1] > lo:
                return int(at[k - 1])
        return hi

    def exits(self) -> tuple[np.ndarray, np.ndarray]:
        """For an end at each of the first ``limit`` places: the chain's first end behind the range (END if none), and how
        many pieces start on ends before it."""
        last = []
        for at in self.at:
            seen = np.full(self.known + 1, -1, np.int32)
            own = at[at >= 0]
            seen[own] = own
            last.append(np.maximum.accumulate(seen))
        cur = np.arange(self.limit, dtype=np.int64)
        steps = np.zeros(self.limit, np.int32)
        inside = np.flatnonzero(cur < self.n)
        while len(inside):
            start = cur[inside] - self.overlap
            hi = np.minimum(start + self.limit, self.known)
            end = start + self.limit
            free = np.ones(len(inside), bool)
            for seen in last:
                best = seen[hi]
                ok = free & (best > start + self.limit // 2)
                end[ok] = best[ok]
                free &= ~ok
            if self.eof:
                end[self.known - start <= self.limit] = END
            cur[inside] = end
            steps[inside] += 1
            inside = inside[(end != END) & (end < self.n)]
        return np.where(cur == END, END, cur - self.n).astype(np.int32), steps

    def chain(self, end: int) -> tuple[int, int]:
        """The exit and number of pieces of one end."""
        n = 0
        while end != END and end < self.n:
            end, n = self.after(end - self.overlap), n + 1
        return (END if end == END else end - self.n), n

    def text(self, start: int, end: int) -> str:
        return _written(self.points[self.zero + start : self.zero + (self.known if end == END else end)])


TABLE = "id string, range_no long, chars long, first long, exits binary, steps binary"


def exit_table(key: str, no: int, r: Range) -> tuple:
    """A row of TABLE. first: of a text's first range the end of its first piece. The first range has one entry, the last
    one none that matters: it ends the text."""
    first, ends, steps = None, np.zeros(0, np.int32), np.zeros(0, np.int32)
    if no == 0:
        first = r.after(0)
        out, n = (END, 0) if first == END else r.chain(first)
        ends, steps = np.array([out], np.int32), np.array([n], np.int32)
    elif not (r.eof and r.known == r.n):
        ends, steps = r.exits()
    return key, no, r.n, first, ends.tobytes(), steps.tobytes()


def stitch(tables: DataFrame) -> DataFrame:
    """Columns id, range_no, base, entry, piece: characters before each range, the first end in it (from its start) and the
    number of the piece that goes on there; entry is null where no further piece starts. One look-up a range, in order."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, base, end, piece = None, 0, END, 0
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                ends, steps = np.frombuffer(row.exits, np.int32), np.frombuffer(row.steps, np.int32)
                if row.id != current:
                    current, base, piece, end = row.id, 0, 1, int(row.first)
                inside = end != END and end < row.chars
                out.append((current, row.range_no, base, end if inside else None, piece))
                base += row.chars
                if row.range_no == 0 and end != END:
                    end, piece = int(ends[0]), piece + int(steps[0])
                elif inside:
                    end, piece = (int(ends[end]), piece + int(steps[end])) if len(ends) else (END, piece)
                elif end != END:
                    end -= row.chars
            table = pd.DataFrame(out, columns=["id", "range_no", "base", "entry", "piece"])
            table["entry"] = table["entry"].astype("Int64")
            yield table

    ordered = tables.repartition("id").sortWithinPartitions("id", "range_no")
    return ordered.mapInPandas(run, "id string, range_no long, base long, entry long, piece long")


def _pieces(key: str, no: int, r: Range, base: int, entry, piece: int) -> Iterator[tuple]:
    """The text's first piece from its first range, and the pieces that start on the ends within the range."""
    if no == 0 and r.known:
        first = r.after(0)
        text = r.text(0, first)
        yield key, 0, base, base + len(text), len(text), text
    end = END if pd.isna(entry) else int(entry)
    while end != END and end < r.n:
        start = end - r.overlap
        end = r.after(start)
        text = r.text(start, end)
        yield key, piece, base + start, base + start + len(text), len(text), text
        piece += 1


def _halos(limit: int, overlap: int) -> tuple[int, int]:
    """Bytes before and after a range that its pieces and boundaries can need."""
    return max(CONTEXT, 4 * overlap) + TAIL, 4 * limit + TAIL


def text_ranges(df: DataFrame, key: str, text: str, limit: int, overlap: int, range_bytes: int = RANGE) -> DataFrame:
    """Columns id, range_no, raw, before, own, eof: byte ranges, with halos, of the texts of more than ``limit`` bytes; only
    these can have more characters than that. Null keys and texts have none."""
    left, right = _halos(limit, overlap)
    raw = F.col(text).cast("string").cast("binary")
    rows = df.where(F.col(key).isNotNull() & (F.octet_length(raw) > limit)).select(F.col(key).cast("string").alias("id"), raw.alias("_raw"))
    size = F.octet_length("_raw")
    rows = spread(rows).select("id", "_raw", F.explode(F.sequence(F.lit(0).cast("long"), ((size - 1) / range_bytes).cast("long"))).alias("range_no"))
    lo = F.col("range_no") * range_bytes
    since = F.greatest(lo - left, F.lit(0))
    upto = F.least(lo + range_bytes, size)
    return rows.select(
        "id", "range_no", F.substring("_raw", (since + 1).cast("int"), (upto + right - since).cast("int")).alias("raw"), (lo - since).alias("before"), (upto - lo).alias("own"), (upto + right >= size).alias("eof")
    )


def text_tables(ranges: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Exit tables (TABLE) of the ranges of texts."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [exit_table(x.id, x.range_no, Range(x.raw, x.before, x.own, x.eof, limit, overlap)) for x in pdf.itertuples(index=False)]
            table = pd.DataFrame(rows, columns=["id", "range_no", "chars", "first", "exits", "steps"])
            table["first"] = table["first"].astype("Int64")
            yield table

    return ranges.mapInPandas(run, TABLE)


def _unique(df: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """One text a key: of several the smallest. Only texts that can be too long are moved."""
    long = df.where(F.col(key).isNotNull() & (F.octet_length(F.col(text).cast("string")) > limit))
    return long.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("_text")).groupBy("id").agg(F.min("_text").alias("_text"))


def oversized(df: DataFrame, key: str, text: str, limit: int, overlap: int, range_bytes: int = RANGE) -> DataFrame:
    """Column id: keys with a text of more than ``limit`` code points, those in which a second piece starts."""
    tables = text_tables(text_ranges(df, key, text, limit, overlap, range_bytes), limit, overlap)
    # every row of a key that repeats is judged by itself: only the ranges of one text have to be in order
    return tables.where((F.col("range_no") == 0) & (F.col("first") != END)).select("id").distinct()


def split_texts(df: DataFrame, key: str, text: str, limit: int, overlap: int, range_bytes: int = RANGE) -> DataFrame:
    """Columns id, piece, start, end, chars, text: the pieces of every text longer than ``limit`` code points.

    Without the overlaps the pieces of a text make up exactly that text; each but the first starts with the last ``overlap``
    characters of the piece before. Texts within the limit, null texts and null keys give no rows. A key with several texts
    stands for the smallest of those longer than ``limit`` bytes. A text without any boundary is cut at the limit. An empty table gives no rows.
    """
    one = materialize(_unique(df, key, text, limit), "oversized")
    ranges = text_ranges(one, "id", "_text", limit, overlap, range_bytes)
    placed = materialize(stitch(text_tables(ranges, limit, overlap)), "entries")
    # ranges that no piece goes on in have nothing to emit; a text's first does if it has a second piece
    live = placed.where("entry is not null or range_no = 0 and base = 0")
    split = placed.where("entry is not null").select("id").distinct()
    work = ranges.join(live.join(split, "id", "left_semi"), ["id", "range_no"])

    def emit(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                r = Range(x.raw, x.before, x.own, x.eof, limit, overlap)
                yield pd.DataFrame(list(_pieces(x.id, x.range_no, r, x.base, x.entry, x.piece)), columns=["id", "piece", "start", "end", "chars", "text"])

    return work.mapInPandas(emit, PIECES)


def _source(path: str):
    """A file to seek in: of any file system that pyarrow knows if the path names one, else a local one."""
    if "://" not in path and not path.startswith("file:/"):
        return open(path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return system.open_input_file(inner)


def _size(path: str) -> int:
    with _source(path) as f:
        return f.seek(0, 2)


def split_files(spark: SparkSession, paths: list[str], limit: int, overlap: int, range_bytes: int = FILE_RANGE) -> DataFrame:
    """Columns id (the path), piece, start, end, chars, text for UTF-8 files that every executor can open.

    Both passes read byte ranges by seeking; ranges are dealt to all executors, those of one file too. Bytes that aren't UTF-8 become
    U+FFFD, one for each maximal run as in :func:`decode`. A file within the limit is one piece, an empty file gives none.
    """
    left, right = _halos(limit, overlap)
    sizes = [(p, _size(p)) for p in dict.fromkeys(paths)]
    files = spark.createDataFrame([s for s in sizes if s[1]], "id string, size long")
    ranges = files.select("id", "size", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("size") - 1) / range_bytes).cast("long"))).alias("range_no"))
    total = sum(-(-n // range_bytes) for _, n in sizes)
    ranges = ranges.repartition(max(1, min(total, 4096)), "id", "range_no")

    def read(path: str, size: int, no: int) -> Range:
        lo = no * range_bytes
        since, upto = max(0, lo - left), min(lo + range_bytes, size)
        with _source(path) as f:
            f.seek(since)
            raw = f.read(upto + right - since)
        return Range(raw, lo - since, upto - lo, upto + right >= size, limit, overlap)

    def detect(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                table = pd.DataFrame([exit_table(x.id, x.range_no, read(x.id, x.size, x.range_no))], columns=["id", "range_no", "chars", "first", "exits", "steps"])
                table["first"] = table["first"].astype("Int64")
                yield table

    placed = materialize(stitch(materialize(ranges.mapInPandas(detect, TABLE), "exits")), "entries")
    work = ranges.join(placed.where("entry is not null or range_no = 0"), ["id", "range_no"])
    work = work.repartition(max(1, min(total, 4096)), "id", "range_no")

    def emit(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                made = _pieces(x.id, x.range_no, read(x.id, x.size, x.range_no), x.base, x.entry, x.piece)
                yield pd.DataFrame(list(made), columns=["id", "piece", "start", "end", "chars", "text"])

    return work.mapInPandas(emit, PIECES)
