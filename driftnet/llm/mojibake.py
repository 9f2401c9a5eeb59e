"""Finding and repairing text decoded with a wrong character encoding, by round trips (problem 4).

Text is encoded again under each legacy encoding it could have been read with and decoded strictly as what it was written in;
the result is taken when a garbling cost falls by enough, and the step is repeated for nested layers. UTF-8 read as something
else is repaired run by run, so that a text may be garbled in part; one legacy encoding read as another is settled for the
lines of a value that look wrong, together. What was lost on the way (replacement characters, bytes that no longer decode)
can't be restored and is reported all the same.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet.runtime import spread

#: What UTF-8 may have been read as.
SINGLE = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "iso8859_2", "iso8859_15", "koi8_r", "cp866")
#: What a legacy text may have been written in.
WRITTEN = ("cp1252", "cp1251", "koi8_r", "cp850", "mac_roman", "cp932", "cp1250", "iso8859_2", "cp866", "euc_jp")
LAYERS = 4

#: Letters beyond ASCII that the languages of the collection use.
EXPECTED = set("äöüßÄÖÜẞéèêëàâæçùûüôîïœÿÉÈÊËÀÂÆÇÙÛÔÎÏŒáíóúñÁÍÓÚÑąćęłńóśźżĄĆĘŁŃŚŹŻ")
_POLISH = set("ąćęłńóśźżĄĆĘŁŃÓŚŹŻ")
_VOWELS = set("aeiouyäöüAEIOUYÄÖÜ")
_JOINERS = set("’ʼ‐‑\xad·​‌‍⁠")
_DASHES = set("–—…")
_RUN = re.compile(r"[^\x00-\x7f]+")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_LOST = re.compile("�|[\x80-\x84\x86-\x9f]|[ÃÂ](?= [a-zà-ÿ])")


def _bytes_of(encoding: str) -> dict[str, int]:
    """Character to byte for the upper half; bytes an encoding leaves open pass as control characters, as programs do."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    return table


_MAPS = {e: _bytes_of(e) for e in SINGLE}


def windows(text: str) -> list[str]:
    """The runs of non-ASCII characters, each with the character before and after."""
    return [text[max(0, m.start() - 1) : m.end() + 1] for m in _RUN.finditer(text)]


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x370 <= o < 0x400:
        return "greek"
    if 0x3040 <= o < 0xA000 or 0xF900 <= o < 0xFB00:
        return "cjk"
    return "other"


@lru_cache(maxsize=1 << 16)
def window_cost(w: str) -> float:
    """The garbling cost of a run of non-ASCII characters with one character around it."""
    cost, run = 0.0, 0
    n = len(w)
    for i, c in enumerate(w):
        o = ord(c)
        before, after = w[i - 1] if i else " ", w[i + 1] if i + 1 < n else " "
        if o < 0x80:
            run = 0
            if c.isalpha() and before.isalpha() and (t := _script(before)) in ("cyrillic", "greek", "cjk"):
                cost += 1 if t == "cjk" else 2
            continue
        if c == "�":
            cost += 4
            continue
        if 0x80 <= o < 0xA0:
            cost += 3
            continue
        if (c == "√" and ord(after) >= 0x80 and not after.isspace()) or (c == "‚" and after == "Ä"):
            cost += 0.8  # lead bytes of UTF-8 under mac_roman, wherever they stand
        kind = unicodedata.category(c)
        if kind[0] == "M":
            cost += 0 if before.isalpha() else 1
        elif kind[0] == "L" and c not in "ªº":
            s = _script(c)
            if before.isalpha() and "other" not in (s, t := _script(before)) and s != t:
                cost += 1 if "cjk" in (s, t) else 2
            if s == "latin":
                if c in "ãÃõÕ" and after in "oOeE":
                    cost += 0.5
                elif c not in EXPECTED and c != "µ":
                    cost += 1 if before.isalpha() or after.isalpha() else 0.5
                elif c == "ß" and before not in _VOWELS:
                    cost += 0.7 if not before.isspace() else 1
                if c.isupper() and before.isalpha() and before.islower() and (after.islower() or not after.isalpha()):
                    cost += 1  # a new word in camel case is possible, an upper-case end isn't
                run = run + 1 if before.isalpha() and ord(before) >= 0x80 else 1
                if run > 2 and c not in _POLISH:
                    cost += 1
            elif s == "cyrillic":
                if not ("А" <= c <= "я" or c in "Ёё"):
                    cost += 1
                if c.isupper() and before.isalpha() and before.islower() and _script(before) == s:
                    cost += 1
            elif s == "greek":
                cost += 1 if before.isalpha() or after.isalpha() else 0
            elif 0xFF61 <= o < 0xFFA0 or 0xE000 <= o < 0xF900:
                cost += 1
            elif s == "other" and 0xFB00 <= o < 0xFB07:
                cost += 0.5
            elif s == "other":
                cost += 1
        elif c in _DASHES or c in _JOINERS:
            if c in "’‐‑–—…" and ord(before) >= 0x80 and ord(after) >= 0x80 and not before.isspace() and not after.isspace():
                cost += 0.5
            elif c in _DASHES and before.isalpha() and after.isalpha():
                cost += 0.3
        else:
            odd = kind in ("So", "Sm", "No", "Sk")
            both = before.isalpha() and after.isalpha()
            if 0x2500 <= o < 0x25A0:
                cost += 2 if before.isalpha() or after.isalpha() else 0.3
            elif c == "\xa0" or 0x3000 <= o < 0x3040 or 0xFF00 <= o < 0xFF61 or c == "¬" and after.isspace():
                cost += 0
            elif both:
                cost += 2
            elif c in "¡¿":
                cost += 1.5 if before.isalpha() else 0
            elif before.isalpha() and ord(before) >= 0xC0 and kind in ("Sk", "So", "Sm", "Sc", "No", "Lo") or c in "ªº" and ord(before) >= 0xC0 and before.isalpha():
                cost += 1
            elif before.isalpha() and odd or odd and after.isalpha() and ord(after) >= 0xC0:
                cost += 0.7
            elif before.isalpha() and ord(after) > 0xA0 and not after.isspace() or after.isalpha() and ord(before) > 0xA0 and not before.isalnum() and not before.isspace():
                cost += 0.4
    return cost


def cost(text: str) -> float:
    """The garbling cost of a text: the sum over its non-ASCII runs."""
    return sum(map(window_cost, windows(text)))


def _utf8_readings(run: str) -> Iterator[str]:
    """What the run becomes when its well-formed UTF-8 parts under each encoding are read as such."""
    seen = set()
    for e in SINGLE:
        table = _MAPS[e]
        raw = bytes(table.get(c, 0x20) for c in run)
        out, at = [], 0
        for m in _UTF8.finditer(raw):
            try:
                good = m.group().decode("utf-8")
            except UnicodeDecodeError:
                continue
            out += [run[at : m.start()], good]
            at = m.end()
        if at and (fixed := "".join([*out, run[at:]])) not in seen:
            seen.add(fixed)
            yield fixed


@lru_cache(maxsize=1 << 16)
def fix_run(before: str, run: str, after: str) -> str:
    """A run of non-ASCII characters with its UTF-8 layers undone, as its neighbours show."""
    start = window_cost(before + run + after)
    if len(run) < 2 or not start:
        return run
    best, least = run, start
    level = [run]
    for _ in range(LAYERS):
        level = list(dict.fromkeys(fixed for r in level for fixed in _utf8_readings(r)))
        for fixed in level:
            now = window_cost(before + fixed + after)
            if run.isalpha() and any(_script(c) == "cjk" for c in fixed):
                now += 0.6
            if now < least:
                best, least = fixed, now
        if not least:
            break
    return best if least <= 0.34 * start else run


def _encode(text: str, encoding: str) -> bytes | None:
    table = _MAPS[encoding]
    try:
        return bytes(ord(c) if ord(c) < 0x80 else table[c] for c in text)
    except KeyError:
        return None


def _legacy_once(text: str) -> tuple[str, float] | None:
    """The best whole reading of ``text`` as another legacy encoding, with its cost."""
    best = None
    seen = set()
    for read in SINGLE:
        raw = _encode(text, read)
        if raw is None or raw in seen:
            continue
        seen.add(raw)
        for written in WRITTEN:
            if written == read:
                continue
            try:
                fixed = raw.decode(written)
            except UnicodeDecodeError:
                continue
            now = cost(fixed), WRITTEN.index(written) + SINGLE.index(read)
            if best is None or now < best[1]:
                best = fixed, now
    return (best[0], best[1][0]) if best else None


def _legacy_lines(lines: list[str]) -> list[str] | None:
    """The lines under the one legacy pair that suits them together, if any does."""
    joined = "\n".join(lines)
    got = _legacy_once(joined)
    if got is None or got[1] > 0.34 * cost(joined):
        return None
    out = got[0].split("\n")
    return out if len(out) == len(lines) else None


def repair(text: str) -> tuple[str, str]:
    """(text restored as far as possible, state): clean, restored, or lost where a part can't be restored.

    ASCII texts are clean. Rightly decoded characters stay, however unusual: a change needs a strict round trip and a fall of cost.
    """
    if text.isascii():
        return text, "clean"
    if not any(map(window_cost, set(windows(text)))) and not _LOST.search(text):
        return text, "clean"
    once = _RUN.sub(lambda m: fix_run(text[m.start() - 1 : m.start()], m.group(), text[m.end() : m.end() + 1]), text)
    lines, then = text.split("\n"), once.split("\n")
    wrong = [i for i, line in enumerate(lines) if not line.isascii() and any(window_cost(w) >= 1 for w in windows(line))]
    if len(then) == len(lines) and wrong:
        joined = _legacy_lines([lines[i] for i in wrong])
        for at, i in enumerate(wrong):
            was, left = cost(lines[i]), cost(then[i])
            plain = all(r.isalpha() for r in _RUN.findall(lines[i]))
            options = [(left, 1 if plain else 0, then[i])]
            for whole in (joined[at] if joined else None, None):
                if left and whole is None:  # its own history, or a legacy layer under the UTF-8 one
                    options += [(g[1], 2, g[0]) for line in {lines[i], then[i]} if (g := _legacy_once(line))]
                elif whole is not None:
                    options.append((cost(whole), 0 if plain else 1, whole))
            now, _, better = min(options)
            if was - now >= 1 and now <= 0.34 * was:
                then[i] = better
    fixed = "\n".join(then)
    if _LOST.search(fixed):
        return fixed, "lost"
    return fixed, "restored" if fixed != text else "clean"


def repair_path(path: str) -> tuple[str, str]:
    """A path repaired component by component, since each has its own history."""
    parts = [_component(p) for p in path.split("/")]
    state = "lost" if any(s == "lost" for _, s in parts) else "restored" if any(s == "restored" for _, s in parts) else "clean"
    return "/".join(p for p, _ in parts), state


@lru_cache(maxsize=1 << 16)
def _component(part: str) -> tuple[str, str]:
    return repair(part)


def garbled(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Columns field_name, record_key, original, restored, state of the values that are garbled.

    ``columns`` maps column names to "text" or "path". Null keys and values, empty and ASCII values give no rows, equal rows
    give one each. A value is handled whole, however long.
    """
    fields = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("value"), F.lit(kind).alias("kind")) for c, kind in columns.items()])
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("record_key"), F.explode(fields).alias("f")).select("record_key", "f.*")
    rows = rows.where(F.octet_length("value") > F.char_length("value"))

    def check(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r, v, f, k in zip(pdf["record_key"], pdf["value"], pdf["field_name"], pdf["kind"], strict=True):
                fixed, state = repair_path(v) if k == "path" else repair(v) if len(v) > 300 else _component(v)
                if state != "clean":
                    out.append((f, r, v, fixed, state))
            yield pd.DataFrame(out, columns=["field_name", "record_key", "original", "restored", "state"])

    return spread(rows).mapInPandas(check, "field_name string, record_key string, original string, restored string, state string")
