"""Repairing text of scanned pages: running headers and page numbers, words broken at line ends, misread characters (problem 6).

The lines of a page are labelled by a linear-chain conditional model (header, body, footer, break: body that ends inside a word) over
layout features, decoded by Viterbi; its weights are set by hand and listed below. What the model labels as break is then checked, and
misread characters are judged, against the words of the whole collection: counts over all texts, joined by word, never
brought to one place.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet.runtime import materialize, spread

HYPHENS = "-‐¬\xad"
#: Marks that are set only where a line ends inside a word.
BREAK_MARKS = "‐¬\xad"
LABEL = re.compile(r"\A\W{0,3}(?:text in image|Text im Bild|texte dans l'image|texto en la imagen)\s*:\s*", re.I)
_DIGIT = r"[\dOolISB]"
_NUMBER = rf"{_DIGIT}{{1,4}}"
_ROMAN = r"[ivxlcIVXLC1!]{1,7}"
_WORD_PAGE = r"(?:pages?|page|seite|p[áàa@]gina|p[aá@]g|s|p|feuille|blatt|hoja|folio)"
STRONG_NUMBER = re.compile(
    rf"\s*(?:{_WORD_PAGE}\.?\s*{_NUMBER}(?:\s*(?:of|von|de|sur|/|0f|o[ft])\s*{_NUMBER})?|[-–—]\s*{_NUMBER}\s*[-–—]|\[\s*{_NUMBER}\s*\]|\(\s*{_NUMBER}\s*\)"
    rf"|{_NUMBER}\s*/\s*{_NUMBER}|{_NUMBER}\s+(?:of|von|de|sur)\s+{_NUMBER}|[-–—]\s*{_ROMAN}\s*[-–—])\s*",
    re.I,
)
BARE_NUMBER = re.compile(rf"\s*{_NUMBER}\s*")
ROMAN_NUMBER = re.compile(r"\s*(?=[ivxl1!]*[ivx])[ivxl1!]{1,7}\s*")
TITLE_NUMBER = re.compile(rf"\s*(?:\S.*?\S\s{{2,}}{_NUMBER}|{_NUMBER}\s{{2,}}\S.*)\s*")
LIST_ROW = re.compile(r"\s*(?![A-ZÀ-Ý\d_])(?:[^\s.,;:!?]+\s+){1,6}\d{1,3}\s*")
ANY_ROW = re.compile(r"\s*(?!\d)(?:[^\s.,;:!?]+\s+){1,5}\d{1,3}\s*")
_CELLS = re.compile(r"[,;\t]\s?[-+£$€]?\d")
MAIL = re.compile(r"\A\s*(?:From|De|Von|Subject|Betreff|Objet|Asunto|To|An|À|Para)\s?:.*\n(?:.+\n)*?(?:To|An|À|A|Para|Subject|Betreff|Objet|Asunto|Date|Datum|Fecha)\s?:", re.I)

HEADER, BODY, FOOTER, BREAK = 0, 1, 2, 3
#: Labels of lines that belong to the text.
TEXT = (BODY, BREAK)
#: Log weights of the chain. Rows: from; columns: to. A text doesn't end in a break.
TURN = np.array([[-3.0, -0.1, -5.0, -0.1], [-5.0, -0.05, -2.5, -0.05], [-0.6, -1.2, -4.0, -1.2], [-5.0, -0.05, -2.5, -0.05]])
START = np.array([-0.7, -0.7, -5.0, -0.7])
END = np.array([-4.0, -0.7, 0.0, -9.0])

MIN_WIDTH, MAX_WIDTH = 30, 100


_FOLD = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("li", "h"))
_ALIKE = str.maketrans("01589@!|6éácf", "olsbgaiieeaet")


def _key(line: str) -> str:
    """A line's letters with what recognition confuses made alike, for finding titles that come again."""
    s = " ".join(w for w in line.casefold().split() if not w.strip("()[]-–—").isdigit())
    for seen, meant in _FOLD:
        s = s.replace(seen, meant)
    return re.sub(r"[\W\d_]+", "", s.translate(_ALIKE))


#: "Â¬" is what a wrong encoding makes of other signs, not a break.
_INSIDE_WORD = re.compile(rf"(?!Â)[^\W\d_]([{HYPHENS}])\s?\Z")
_GOES_ON = re.compile(r"\s*[^\W_]")


def emissions(lines: list[str], gaps: list[bool], feeds: list[bool], width: int) -> np.ndarray:
    """Weights of the four labels for each non-blank line, from its layout.

    gaps: a blank line before; feeds: a form feed before.
    """
    n = len(lines)
    keys = Counter(_key(x) for x in lines if len(x) < 0.95 * width)
    # pages of one text are numbered in one style: where there is another, a bare number is a cell of a list
    styled = any(STRONG_NUMBER.fullmatch(x.strip()) or ROMAN_NUMBER.fullmatch(x.strip()) for x in lines)
    cell = [len(x) < 45 and bool(ANY_ROW.fullmatch(x.strip()) or BARE_NUMBER.fullmatch(x)) for x in lines]
    out = np.zeros((n, 4))
    for i, line in enumerate(lines):
        s = line.strip()
        short = len(s) < 0.8 * width
        starts_page = feeds[i] or i == 0
        ends_page = i + 1 == n or feeds[i + 1]
        h = f = -3.0
        if STRONG_NUMBER.fullmatch(s):
            f, h = 5.0, 1.0
        elif ROMAN_NUMBER.fullmatch(s):
            f, h = 5.0, 0.0
        elif BARE_NUMBER.fullmatch(s):
            row = i > 0 and cell[i - 1] or i + 1 < n and cell[i + 1]
            turns = i + 1 < n and (keys[_key(lines[i + 1])] > 1 and len(_key(lines[i + 1])) > 3 or bool(TITLE_NUMBER.fullmatch(lines[i + 1])))
            inside = i > 0 and lines[i - 1].rstrip()[-1:] not in ".?!"
            f = -2.0 if styled else 3.0 if ends_page or turns else -1.0 if row else 5.0 if inside else 3.5
            h = 2.0 if starts_page and not styled else -2.0
        elif TITLE_NUMBER.fullmatch(s) and not _CELLS.search(s) and s[:1] not in "-•*" and s[:60].casefold() != s[:60]:
            h, f = 6.5, (6.0 if ends_page else 3.0)
        elif _CELLS.search(s):
            pass
        elif short and (s[:1].isupper() or s[:1].isdigit()) and s[-1:] not in ".,;:?!" + HYPHENS and not LIST_ROW.fullmatch(s):
            again = keys[_key(s)] > 1 and len(_key(s)) > 3
            upper = s.upper() == s and any(c.isalpha() for c in s)
            h = 1.0 + 4.5 * again + 1.5 * upper + 2.0 * (" — " in s) + (2.5 if starts_page else 0.0)
            if i and not feeds[i] and lines[i - 1].rstrip()[-1:] not in ".?!" and BARE_NUMBER.fullmatch(lines[i - 1]) is None and STRONG_NUMBER.fullmatch(lines[i - 1].strip()) is None and ROMAN_NUMBER.fullmatch(lines[i - 1].strip()) is None and not again:
                h -= 3.0
            f = -1.0 + 2.0 * again + (1.5 if ends_page else 0.0)
        if LIST_ROW.fullmatch(s) and not STRONG_NUMBER.fullmatch(s):
            h, f = h - 2.0, f - 2.0
        if feeds[i]:
            h += 1.5
        if ends_page and not feeds[i]:
            f += 0.5
        if h > -3.0 and i + 1 < n and gaps[i + 1]:
            h += 0.3  # a running title stands off
        if f > -3.0 and gaps[i]:
            f += 0.3
        out[i, HEADER], out[i, FOOTER] = h, f
        out[i, BREAK] = -9.0
        end = _INSIDE_WORD.search(line)
        if end and i + 1 < n:
            after = next((x.lstrip() for x in lines[i + 1 : i + 4] if _GOES_ON.match(x)), "")
            out[i, BREAK] = 0.6 + 1.5 * (end[1] in BREAK_MARKS) + 0.8 * after[:1].islower() + 0.4 * (not short) - 0.3 * gaps[i + 1]
    return out


def viterbi(emit: np.ndarray, feeds: list[bool]) -> list[int]:
    """The best label sequence. A form feed starts a page: only what may follow a page's end may follow it."""
    n = len(emit)
    score = START + emit[0]
    back = np.zeros((n, 4), np.int8)
    for i in range(1, n):
        turn = TURN.copy()
        if feeds[i]:
            turn[:, HEADER], turn[:, FOOTER] = -0.5, -6.0
            turn[:, BODY] = turn[:, BREAK] = -0.9
            turn[BREAK] += 9.0 - END[BODY]  # a word may go on over the page
            score = score + END
        step = score[:, None] + turn
        back[i] = step.argmax(0)
        score = step.max(0) + emit[i]
    labels = [int((score + END).argmax())]
    for i in range(n - 1, 0, -1):
        labels.append(int(back[i][labels[-1]]))
    return labels[::-1]


def scanned_lines(text: str) -> list[tuple[int, str, int]] | None:
    """(line number from 1, line without label, chain label) of the non-blank lines of a scanned text, else None; see
    :func:`layout`."""
    found = layout(text)
    return None if found is None else [x[:3] for x in found]


def layout(text: str) -> list[tuple[int, str, int, bool]] | None:
    """(line number from 1, line without label, chain label, blank line before) of the non-blank lines of a scanned text, else None.

    Scanned means: lines wrapped to one width, not an e-mail, and page furniture, form feeds or words broken at line ends.
    """
    if text.count("\n") < 2 or MAIL.match(text):
        return None
    raw = text.replace("\r", "").split("\n")
    first = next((i for i, line in enumerate(raw) if ":" in line and LABEL.match(line)), 0)
    raw[first] = LABEL.sub("", raw[first])
    lengths = [len(x.strip()) for x in raw[first:] if x.strip()]
    if len(lengths) < 3:
        return None
    # a few lines that are longer than a page is wide don't belong to its layout
    wide = sum(n > MAX_WIDTH for n in lengths)
    width = max(lengths) if wide > max(1, 0.05 * len(lengths)) else max((n for n in lengths if n <= MAX_WIDTH), default=0)
    full = sum(n > 0.72 * width for n in lengths)
    if not MIN_WIDTH <= width <= MAX_WIDTH or full < 2 or full < 0.25 * len(lengths):
        return None
    numbers, lines, gaps, feeds = [], [], [], []
    gap = feed = False
    for i, line in enumerate(raw[first:], first + 1):
        feed = feed or "\f" in line
        s = line.replace("\f", "")
        if not s.strip():
            gap = True
            continue
        numbers.append(i)
        lines.append(s)
        gaps.append(gap)
        feeds.append(feed)
        gap = feed = False
    labels = viterbi(emissions(lines, gaps, feeds, width), feeds)
    marks = sum(bool(re.search(r"(?!Â)[^\W\d_][‐¬\xad] ?\Z", s)) for s in lines)
    hyphens = sum(bool(re.search(r"[^\W\d_]- ?\Z", s)) for s in lines)
    furniture = sum(x not in TEXT for x in labels)
    firm = any(f not in TEXT and (STRONG_NUMBER.fullmatch(s.strip()) or TITLE_NUMBER.fullmatch(s)) for f, s in zip(labels, lines, strict=True))
    if not (any(feeds) or marks or firm or furniture and hyphens or first and furniture or hyphens > 1 or furniture > 1):
        return None
    return list(zip(numbers, lines, labels, gaps, strict=True))


#: What recognition takes a letter or pair for: seen, meant.
CONFUSED = (
    ("@", "a"), ("0", "o"), ("!", "i"), ("5", "s"), ("c", "e"), ("1", "l"), ("f", "t"), ("9", "g"), ("ii", "u"), ("cl", "d"), ("rn", "m"),
    ("li", "h"), ("vv", "w"), ("6", "é"), ("8", "b"), ("|", "i"), ("m", "rn"), ("d", "cl"), ("0", "ó"), ("@", "á"), ("1", "i"), ("!", "l"), ("|", "l"),
    ("e", "c"), ("t", "f"), ("h", "li"), ("u", "ii"), ("w", "vv"), ("6", "b"), ("$", "s"), ("€", "e"), ("fi", "ñ"),
)
_TOKEN = re.compile(r"[\w@!|$]+(?:['’][\w@!|$]+)*")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_SIGN = re.compile(r"[@|$\d!](?=[^\W\d_])|(?<=[^\W\d_])[@|$\d]|(?<=[^\W\d_])!(?=[^\W\d_])")
#: Signs and digits that can't stand in a word: misread whatever the word is.
_INSIDE = re.compile(r"(?<=[a-zà-ÿ])[@!|015689](?=[a-zà-ÿ])|(?<=[^\W\d_])[@!|](?=[^\W\d_])|(?<![\w@!|])[@|015689](?=[a-zà-ÿ]{4})|(?<![\w@!|])@(?=[a-zà-ÿ])|[aou]:(?=[a-zß])|(?<=[A-ZÀ-Ý])[@0158](?=[a-zà-ÿ]{3})")
_BAD_NUMBER = re.compile(r"(?<![\w/.-])(?=[\dOlIS.,]*\d)(?=[\dOlIS.,]*[OlIS])[\dOlIS]{2,}(?:[.,][\dOlIS]+)?(?![\w/])")


_BY_SIGN = {sign: [meant for seen, meant in CONFUSED if seen == sign] for sign in {seen for seen, _ in CONFUSED if len(seen) == 1 and not seen.isalpha()}}


def corrections(word: str, depth: int = 2) -> set[str]:
    """Words of letters that recognition may have turned into ``word`` by up to ``depth`` confusions. All signs and digits have to
    go, so a token that has more of them than ``depth`` has none, however long it is."""
    signs = [i for i, c in enumerate(word) if not c.isalpha() and c not in "'’"]
    if len(signs) > depth:
        return set()
    level = {word}
    for i in reversed(signs):
        level = {w[:i] + meant + w[i + 1 :] for w in level for meant in _BY_SIGN.get(word[i], ())}
    found = set(level)
    for _ in range(depth - len(signs)):
        new = set()
        for w in level:
            for seen, meant in CONFUSED:
                at = w.find(seen) if meant[0].isalpha() else -1
                while at >= 0:
                    new.add(w[:at] + meant + w[at + len(seen) :])
                    at = w.find(seen, at + 1)
        level = new - found
        found |= level
    return found - {word}


def tokens(line: str) -> list[str]:
    """Tokens of a line that could be misread words, lower-cased; codes of capitals and digits are left out."""
    out = []
    for t in _TOKEN.findall(line):
        t = t.rstrip("!") if not t.endswith("!!") else t.rstrip("!")
        letters = sum(c.isalpha() for c in t)
        if letters < 1 or len(t) < 2:
            continue
        if any(c.isdigit() for c in t) and not any(c.islower() for c in t):
            continue
        out.append(t.lower())
    return out


def _scan_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, text in zip(pdf["id"], pdf["text"], strict=True):
            lines = layout(text)
            if lines is None:
                continue
            for at, (no, line, label, gap) in enumerate(lines):
                joined = apart = None
                marked = misread = False
                if label in TEXT:
                    misread = bool(_INSIDE.search(line) or _BAD_NUMBER.search(line))
                    m = re.search(rf"([^\W_]+(?:['’-][^\W_]+)*)([{HYPHENS}])\s?\Z", line) if label == BREAK else None
                    after = next((x for _, x, lab, _ in lines[at + 1 :] if lab in TEXT), "") if m else ""
                    n = re.match(r"\s*([^\W_]+(?:-[^\W_]+)*)", after)
                    if m and n and m[1][-1].isalpha():
                        marked = m[2] in BREAK_MARKS
                        joined, apart = (m[1] + n[1]).lower(), (m[1] + "-" + n[1]).lower()
                rows.append((key, no, "body" if label in TEXT else "furniture", line, joined, apart, marked, misread, gap))
        yield pd.DataFrame(rows, columns=["id", "line_no", "label", "line", "joined", "apart", "marked", "misread", "gap"])


def _word_counts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        counts: Counter = Counter()
        for text in pdf["text"]:
            counts.update(_WORD.findall(text.lower()))
        yield pd.DataFrame({"word": list(counts.keys()), "n": list(counts.values())})


def _token_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, no, line, apart in zip(pdf["id"], pdf["line_no"], pdf["line"], pdf["apart"], strict=True):
            cut = line.rstrip()
            if cut[-1:] in tuple(HYPHENS) and apart:
                cut = cut[: max(cut.rfind(" "), 0)]
            rows += [(key, no, t) for t in set(tokens(cut))]
        yield pd.DataFrame(rows, columns=["id", "line_no", "token"])


def _candidate_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for t in pdf["token"]:
            signed = bool(_SIGN.search(t))
            rows.append((t, t, 0, signed))
            rows += [(t, c, 1, signed) for c in corrections(t, 3 if signed else 1 if len(t) > 3 else 0) if c.isalpha() or "'" in c or "’" in c]
        yield pd.DataFrame(rows, columns=["token", "word", "kind", "signed"])


def misread_tokens(line_tokens: DataFrame, words: DataFrame, ratio: int = 12, least: int = 4) -> DataFrame:
    """Columns token, fix: tokens whose best correction is ``ratio`` times as common in the collection as themselves, and at least
    ``least`` times there; a token with a sign or digit between letters needs a correction found at least twice."""
    cands = line_tokens.select("token").distinct().mapInPandas(_candidate_rows, "token string, word string, kind int, signed boolean")
    known = cands.join(words, "word", "left").groupBy("token", "signed").agg(
        F.max(F.when(F.col("kind") == 0, F.coalesce("n", F.lit(0)))).alias("own"), F.max(F.when(F.col("kind") == 1, F.coalesce("n", F.lit(0)))).alias("best"), F.max_by("word", F.when(F.col("kind") == 1, F.struct("n", "word"))).alias("fix"),
    )
    best, own = F.coalesce("best", F.lit(0)), F.coalesce("own", F.lit(0))
    return known.where(F.when(F.col("signed"), best >= 2).otherwise((best >= least) & (best >= ratio * own))).select("token", "fix")


def label_lines(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(lines of scanned texts with their labels, word counts over all texts)."""
    rows = df.where(F.col(key).isNotNull() & (F.length(F.col(text)) > 0)).select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    lines = spread(rows).mapInPandas(_scan_rows, "id string, line_no long, label string, line string, joined string, apart string, marked boolean, misread boolean, gap boolean")
    words = spread(rows.select("text")).mapInPandas(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(lines, "scan-lines"), materialize(words.where("n > 1"), "words")


def _broken(body: DataFrame, words: DataFrame) -> DataFrame:
    """Columns id, line_no: body lines that end inside a word, as the counts of the joined and the hyphenated form tell."""
    ends = body.where("joined is not null")
    forms = ends.select(F.explode(F.array("joined", "apart")).alias("word")).distinct().join(words, "word")
    seen = ends.join(forms.select(F.col("word").alias("joined"), F.col("n").alias("as_one")), "joined", "left")
    seen = seen.join(forms.select(F.col("word").alias("apart"), F.col("n").alias("as_two")), "apart", "left")
    one, two = F.coalesce("as_one", F.lit(0)), F.coalesce("as_two", F.lit(0))
    return seen.where(F.col("marked") | (two == 0) | (one > two)).select("id", "line_no")


def faults(lines: DataFrame, words: DataFrame) -> DataFrame:
    """Columns id, line_no, fault: furniture, broken or misread."""
    body = lines.where("label = 'body'")
    furniture = lines.where("label = 'furniture'").select("id", "line_no", F.lit("furniture").alias("fault"))
    broken = _broken(body, words).withColumn("fault", F.lit("broken"))
    toks = body.select("id", "line_no", "line", "apart").mapInPandas(_token_rows, "id string, line_no long, token string")
    bad = misread_tokens(toks, words)
    misread = toks.join(bad, "token", "left_semi").select("id", "line_no")
    numbers = body.where("misread").select("id", "line_no")
    misread = misread.unionByName(numbers).distinct().withColumn("fault", F.lit("misread"))
    return furniture.unionByName(broken).unionByName(misread)


def _mend(line: str, fixes: dict[str, str]) -> str:
    """A line with its misread tokens replaced, capitals kept; signs inside unknown words by what they are mostly taken for."""

    def one(m: re.Match) -> str:
        t = m.group()
        core = t.rstrip("!")
        fix = fixes.get(core.lower())
        if fix is None and _INSIDE.search(core) and any(c.islower() for c in core):
            fix = core.lower().translate(str.maketrans({"@": "a", "!": "i", "|": "l", "0": "o", "1": "l", "5": "s", "6": "b", "8": "b", "9": "g"}))
        if fix is None:
            return t
        capital = core[:1].isupper() or not core[:1].isalpha() and core[1:2].isupper()
        return (core.isupper() and fix.upper() or capital and fix[:1].upper() + fix[1:] or fix) + t[len(core) :]

    return _TOKEN.sub(one, line)


def assemble(rows: list[tuple[int, str, bool, bool, dict[str, str]]]) -> list[str]:
    """Paragraphs from body lines in order: (line number, line, blank line before, ends in a broken word, fixes).

    A blank line ends a paragraph unless the sentence goes on over it (a page turn); rows of lists stay lines of their own.
    """
    out: list[str] = []
    glue = None
    for _, line, gap, broken, fixes in rows:
        s = _mend(line.strip(), fixes)
        after_row = glue is None or out[-1][-1:] in ".?!:"
        own = bool(BARE_NUMBER.fullmatch(s) or len(s) < 45 and after_row and ANY_ROW.fullmatch(s))
        goes_on = bool(out) and glue is not None and (glue == "" or not gap or out[-1][-1:] not in ".?!:" and s[:1].islower()) and not own
        if goes_on:
            out[-1] += glue + s
        else:
            out.append(s)
        if broken and s[-1:] in HYPHENS:
            out[-1] = out[-1][:-1]
            glue = ""
        else:
            glue = None if own else "" if s[-1:] == "-" and s[-2:-1].isalpha() else " "
    return out


def paragraphs(lines: DataFrame, words: DataFrame) -> DataFrame:
    """Columns id, paragraph_no (from 1), text: the scanned texts without furniture, broken words joined, misread words mended."""
    body = lines.where("label = 'body'")
    broken = _broken(body, words).withColumn("broken", F.lit(True))
    toks = body.select("id", "line_no", "line", "apart").mapInPandas(_token_rows, "id string, line_no long, token string")
    fixes = toks.join(misread_tokens(toks, words), "token").groupBy("id", "line_no").agg(F.collect_list(F.struct("token", "fix")).alias("fixes"))  # of one line
    rows = body.select("id", "line_no", "line", "gap").join(broken, ["id", "line_no"], "left").join(fixes, ["id", "line_no"], "left")
    texts = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line", "gap", F.coalesce("broken", F.lit(False)).alias("broken"), "fixes"))).alias("rows"))  # of one text

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, own in zip(pdf["id"], pdf["rows"], strict=True):
                made = assemble([(r["line_no"], r["line"], r["gap"], r["broken"], {f["token"]: f["fix"] for f in r["fixes"]} if r["fixes"] is not None else {}) for r in own])
                out += [(key, i, t) for i, t in enumerate(made, 1)]
            yield pd.DataFrame(out, columns=["id", "paragraph_no", "text"])

    return texts.mapInPandas(run, "id string, paragraph_no int, text string")
