"""Reducing e-mails to what their sender newly wrote (problem 2).

A message is read as paragraphs, and each paragraph that its form doesn't mark as old is compressed alone and under two dictionaries made
for its message. The dictionary of ancestors holds what the message quotes and the sentences that earlier messages of the same
thread, by other senders, hold as their own (joined by thread and sentence). The dictionary of closings holds the sentences of notices, from the
whole collection, that share word runs with the message (joined by run). An abnormal gain flags a paragraph, an exact
overlap of word runs confirms it, and what isn't confirmed is kept. Closing formulas are learnt too: short lines that stand above the
sender's name in several messages. Header blocks, quote prefixes with the lines that introduce them, forwarded blocks,
signatures and device lines are told by their form and place. Nothing is gathered on the driver or broadcast.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet.runtime import materialize, spread

#: A zlib dictionary holds 32 KB: what is longer is divided among several.
DICTIONARY = 30_000
GAIN = 0.4
OVERLAP = 0.5
RUN = 3

_HEADER_NAME = (
    r"(?:From|To|Cc|Bcc|Subject|Date|Sent|Reply-To|Von|An|Betreff|Datum|Gesendet|De|À|A|Objet|Envoyé|Envoyé le|Date d'envoi|Para|CC|Asunto|Enviado|Enviado el|Fecha|Message-ID|Importance|Od|Do|DW|Temat|Data|Wysłano|От|Кому|Копия|Тема|Дата|Отправлено)"
)
HEADER = re.compile(rf"\*?{_HEADER_NAME}\s?:\*?(?:\s|\Z)", re.I)
PREFIX = re.compile(r"\s?(?:[A-Z]{1,3}>|>|\|)")
LOOSE_PREFIX = re.compile(r"\s?> ?[\d<>=]")
VERB = r"(?:wrote|writes|schrieb|schreibt|a écrit|écrit|écrivait|escribió|escribe|napisał(?:a|\(a\))?|pisze|пишет|написал(?:а|\(а\))?)"
ATTRIBUTION = re.compile(rf".*\b{VERB}\b.*:\s*\Z|.*\bschrieb\b.*:\s*\Z", re.I | re.S)
INTRODUCES = re.compile(rf"(?:\S+\s+){{0,6}}{VERB}\s?:\s*\Z|(?:on|am|le|el|w dniu|dnia|в)\s.*{VERB}.*:\s*\Z|.*<?\S+@\S+>?.*{VERB}.*:\s*\Z|.*{VERB}\s+(?:on|am|le|el|w dniu|dnia|в)\s.*\d{{4}}.*:\s*\Z", re.I | re.S)
#: The first line of an introduction that goes on.
FOLDED = re.compile(r"\s*(?:(?:on|am|le|el|w dniu|dnia|в)\s.*\d|(?:[^\W\d_]+\s){1,2}[^\W\d_]*\s*<?\S*@?\S*>?\s*\Z)", re.I)
SEPARATOR = re.compile(
    r"\s*-{2,}\s*(?:Original Message|Forwarded message|Original Nachricht|Ursprüngliche Nachricht|Weitergeleitete Nachricht|Message d'origine|Message original|Message transféré|"
    r"Mensaje original|Mensaje reenviado|Reenviado|Forwarded by.*|Urspr. Nachricht|[^\W\d_][^\d\n]{3,40})\s*-{2,}\s*"
    r"|\s*(?:Begin forwarded message|Anfang der weitergeleiteten (?:Nachricht|E-Mail|Mail)|Début du message (?:réexpédié|transféré)|Inicio del mensaje reenviado)\s?:\s*",
    re.I,
)
RULE = re.compile(r"\s*(?:_{8,}|={8,}|\*{8,}|-{12,}|#{8,}|~{8,}|(?:[-*_=] ?){20,})\s*")
DELIMITER = re.compile(r"\s*(?:--|---|—|__|___|\* \* \*|\*{3}|~{2,3}|-- )\s*")
#: Closing formulas to start from; those of the collection are added to them.
SEED_FORMULAS = frozenset((
    "best regards", "kind regards", "regards", "best wishes", "best", "all the best", "yours sincerely", "yours faithfully", "yours", "cheers", "thanks", "many thanks", "thank you", "take care", "love",
    "mit freundlichen grüßen", "freundliche grüße", "beste grüße", "viele grüße", "liebe grüße", "herzliche grüße", "schöne grüße", "gruß", "lg", "vg", "mfg", "vielen dank", "bis bald",
    "cordialement", "bien cordialement", "bien à vous", "bien à toi", "amicalement", "amitiés", "salutations distinguées", "merci", "à bientôt", "bises",
    "saludos", "un saludo", "saludos cordiales", "un abrazo", "atentamente", "cordialmente", "gracias", "muchas gracias", "hasta pronto",
    "pozdrawiam", "z poważaniem", "serdecznie pozdrawiam", "z wyrazami szacunku", "с уважением", "всего доброго", "с наилучшими пожеланиями", "до свидания",
))
DEVICE = re.compile(
    r"\s*(?:(?:sent|written|typed) (?:from|with|on|by) my\b[^.]{0,60}|sent (?:from|with|via) (?:the )?[^.]{0,40}(?:app|phone|mobile|tablet|mail)|get (?:the|our) [^.]{0,40}app\b.{0,40}|"
    r"(?:von|mit) (?:meinem|meiner|unterwegs)\b[^.]{0,50}\bgesendet\b.{0,50}|gesendet (?:von|mit)\b.{0,60}|"
    r"envoyé (?:de|depuis|avec|à partir de)\b.{0,70}|téléchargez\b.{0,60}|enviado (?:desde|con)\b.{0,70}|descargue?\b.{0,60}|hol(?:en)? (?:sie|dir)\b.{0,50}app.{0,30})[.!]?\s*",
    re.I,
)
POSTSCRIPT = re.compile(r"\s*(?:P\.? ?P?\.? ?S\.?|P\.? ?D\.?|N\.? ?B\.?|Nachtrag|Post ?scriptum|Posdata)\s?[:.]?(?:\s|\Z)", re.I)
CONTACT = re.compile(r"(?:tel\.?|phone|telefon|mobile?|mobil|fax|portable|tél\.?|teléfono|móvil)\s?\.?:|\+\d{2} \d|www\.|https?://|\s\|\s|\S+@\S+\.\S+", re.I)
_NAMES = re.compile(r"[^\W\d_]+")

#: Sentences of notices to start from; the collection's own are added to them.
SEED_NOTICES = (
    "This message and any files attached to it are confidential and meant only for the addressee named above. If it reached you by mistake, tell the sender at once and delete every copy. "
    "Please think of the trees before printing this mail. Diese Nachricht ist vertraulich und nur für die genannte Person bestimmt. Falls Sie sie irrtümlich erhalten haben, löschen Sie bitte alle Kopien. "
    "Bitte prüfen Sie, ob ein Ausdruck nötig ist. Ce message est confidentiel et réservé à son destinataire. Si vous l'avez reçu par erreur, prévenez l'expéditeur et détruisez-le. "
    "Este mensaje es confidencial y va dirigido solo a la persona indicada. Si lo ha recibido por error, avise al remitente y bórrelo. Antes de imprimir este correo, piense si es necesario. "
)


def _words(text: str) -> list[str]:
    return _NAMES.findall(text.casefold())


def plain(line: str) -> str:
    """A short line as closing formulas are compared."""
    return " ".join(line.casefold().split()).strip(" ,.!;:–—-")


class Closings:
    """What is known of closings for one message: sentences of notices, which make up its dictionaries and the word runs for
    the exact check, and closing formulas."""

    def __init__(self, sentences: Iterable[str] = (), formulas: Iterable[str] = ()):
        self.sentences = list(sentences)
        self.runs = _SEED_RUNS | runs("\n".join(self.sentences))
        self.formulas = SEED_FORMULAS | set(formulas)

    def flags(self, text: str) -> bool:
        """Whether the text gains abnormally under one of the dictionaries."""
        seeds = SEED_NOTICES.casefold()
        for n, shelf in enumerate(_shelves(self.sentences, len(seeds.encode()))):
            if gain(text, " ".join([*reversed(shelf), *([seeds] if n == 0 else [])]).encode()) >= GAIN:
                return True
        return False

    def closes(self, line: str) -> bool:
        return plain(line) in self.formulas


def _shelves(sentences: list[str], size: int = 0) -> Iterator[list[str]]:
    """The sentences in order, in lists that fit one dictionary each; ``size`` bytes of the first are taken. At least one."""
    kept: list[str] = []
    for s in sentences:
        n = len(s.encode()) + 1
        if size + n > DICTIONARY and (kept or size):
            yield kept
            kept, size = [], 0
        kept.append(s)
        size += n
    yield kept


def _stretches(old: bytes) -> Iterator[bytes]:
    """Dictionaries that cover a long text, the last part first; each shares half with the next."""
    end = len(old)
    while True:
        yield old[max(0, end - 32_000) : end]
        if end <= 32_000:
            return
        end -= 16_000


def runs(text: str) -> set[tuple[str, ...]]:
    w = _words(text)
    return {tuple(w[i : i + RUN]) for i in range(len(w) - RUN + 1)}


_SEED_RUNS = runs(SEED_NOTICES)


def gain(text: str, zdict: bytes) -> float:
    """How much shorter the text compresses under the dictionary than alone."""
    raw = text.encode()
    alone = zlib.compressobj(9, zlib.DEFLATED, -15)
    under = zlib.compressobj(9, zlib.DEFLATED, -15, zdict=zdict[-32_000:]) if zdict else zlib.compressobj(9, zlib.DEFLATED, -15)
    a, b = len(alone.compress(raw) + alone.flush()), len(under.compress(raw) + under.flush())
    return 1 - b / a


def overlap(text: str, known: set) -> float:
    """The part of the text's words inside word runs that the dictionary has exactly."""
    w = _words(text)
    covered = [False] * len(w)
    for i in range(len(w) - RUN + 1):
        if tuple(w[i : i + RUN]) in known:
            covered[i : i + RUN] = [True] * RUN
    return sum(covered) / len(w) if w else 0.0


def _sender(line: str) -> set[str]:
    """The sender's names as they may stand under a closing."""
    name = re.sub(r"<.*|\(.*", "", line.split(":", 1)[-1]).strip(' "')
    parts = _words(name)
    return {" ".join(parts), *parts} - {""}


def structure(lines: list[str]) -> tuple[list[str], set[str]]:
    """(mark of each line, sender's names). Marks: '' open, B blank, H header, Q old text, I introduces it, R rule."""
    n = len(lines)
    marks = ["B" if not x.strip() else "" for x in lines]
    names: set[str] = set()
    i = 0
    while i < n and marks[i] == "B":
        i += 1
    if i < n and HEADER.match(lines[i]):
        while i < n and marks[i] != "B":
            marks[i] = "H"
            if re.match(r"\*?(?:From|Von|De|Od|От)\s?:", lines[i], re.I) and not names:
                names = _sender(lines[i])
            i += 1
    # from a forwarded block on everything is old
    for j in range(i, n):
        if marks[j]:
            continue
        heads = 0
        if HEADER.match(lines[j]):
            k = j
            while k < n and not marks[k] and (HEADER.match(lines[k]) or heads and lines[k][:1] in " \t"):
                heads += bool(HEADER.match(lines[k]))
                k += 1
        nxt = next((k for k in range(j + 1, min(n, j + 4)) if marks[k] != "B"), None)
        if heads >= 3 or heads == 2 and (k >= n or marks[k] == "B") or SEPARATOR.fullmatch(lines[j]) and (nxt is None or HEADER.match(lines[nxt]) or PREFIX.match(lines[nxt]) or re.search(r"message|nachricht|mensaje|mail", lines[j], re.I)):
            back = j - 1
            while back >= 0 and marks[back] == "B":
                back -= 1
            if back >= 0 and RULE.fullmatch(lines[back]):
                marks[back] = "R"
            for k in range(j, n):
                if marks[k] != "B":
                    marks[k] = "Q"
            break
    # quote prefixes; a lone "> 4 bar" is a comparison
    quoted = [not m and bool(PREFIX.match(x)) for m, x in zip(marks, lines, strict=True)]
    for j in range(n):
        if quoted[j]:
            alone = (j == 0 or not quoted[j - 1]) and (j + 1 >= n or not quoted[j + 1])
            if alone and LOOSE_PREFIX.match(lines[j]) and not (j and marks[j - 1] == "I"):
                continue
            if lines[j].lstrip()[:1] == "|" and alone:
                continue
            marks[j] = "Q"
            if j and marks[j - 1] != "Q" or not j:  # the lines that introduce the quote
                k = j - 1
                while k >= 0 and marks[k] == "B" and j - k <= 2:
                    k -= 1
                stop = k
                while k >= 0 and marks[k] == "" and stop - k < 4:
                    if ATTRIBUTION.match(" ".join(x.strip() for x in lines[k : stop + 1])) and (k == 0 or marks[k - 1] != "" or INTRODUCES.match(" ".join(x.strip() for x in lines[k : stop + 1]))):
                        starts = k
                        for t in (stop - 1, stop - 2):  # an introduction folded over two or three lines
                            if t < 0 or marks[t] != "" or t >= k:
                                continue
                            if any(m != "" for m in marks[t : stop + 1]) or not FOLDED.match(lines[t]):
                                continue
                            starts = min(starts, t)
                        for t in range(starts, stop + 1):
                            marks[t] = "I"
                        break
                    k -= 1
    for j in range(n):
        if not marks[j] and RULE.fullmatch(lines[j]):
            marks[j] = "R"
    return marks, names


def paragraphs(marks: list[str]) -> Iterator[tuple[int, int]]:
    """[start, end) of the runs of open lines."""
    at = None
    for i, m in enumerate([*marks, "B"]):
        if m == "" and at is None:
            at = i
        elif m != "" and at is not None:
            yield at, i
            at = None


def _is_name(line: str, names: set[str]) -> bool:
    w = _words(line)
    return bool(w) and len(w) <= 4 and (" ".join(w) in names or all(x in names for x in w))


def classify(text: str, closings: Closings, ancestors_own: Iterable[str] = ()) -> list[str]:
    """The mark of each line: N newly written, C closing or signature, D device line, L notice, and those of structure.

    ancestors_own: sentences that earlier messages of the thread hold as their own."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    marks, names = structure(lines)
    quoted = [PREFIX.sub("", x) for x, m in zip(lines, marks, strict=True) if m == "Q"]
    old = "\n".join([*ancestors_own, *quoted])
    ancestors, ancestor_runs = old.encode(), runs(old)
    for lo, hi in list(paragraphs(marks)):
        body = "\n".join(lines[lo:hi])
        before = marks[lo - 1] if lo else "B"
        if before == "R":
            marks[lo:hi] = ["L"] * (hi - lo)
            continue
        if hi - lo == 1 and DEVICE.fullmatch(body):
            marks[lo] = "D"
            continue
        if POSTSCRIPT.match(body):
            marks[lo:hi] = ["N"] * (hi - lo)
            continue
        # closing formula or signature: from its first line to the end of the paragraph
        cut = hi
        for i in range(lo, hi):
            s = lines[i].strip()
            tail = lines[i + 1 : hi]
            named = bool(tail) and _is_name(tail[0], names)
            formula = closings.closes(s) or named and len(tail) <= 7 and len(_words(s)) <= 5 and len(s) < 40 and s[:1].isupper() and s[-1:] not in ".?!:" and (i == lo or lines[i - 1].rstrip()[-1:] in ".?!")
            if formula and (not tail or len(tail) <= 7 and (_is_name(tail[0], names) or CONTACT.search("\n".join(tail)) or len(_words(tail[0])) <= 4 and len(tail[0]) < 40)):
                cut = i
                break
            if DELIMITER.fullmatch(lines[i]) and hi - i <= 9:
                cut = i
                break
            if s.startswith("/") and _is_name(s[1:], names) or _is_name(s, names) and (not tail or CONTACT.search("\n".join(tail)) or i == lo and len(tail) <= 4 and max(map(len, tail)) < 50):
                cut = i
                break
        if cut < hi:
            marks[lo:cut] = ["N"] * (cut - lo)
            marks[cut:hi] = ["C"] * (hi - cut)
            if cut == lo:
                continue
            hi, body = cut, "\n".join(lines[lo:cut])
        first = lines[lo].strip()
        if len(_words(body)) >= 5 and overlap(body, closings.runs) >= OVERLAP and closings.flags(body.casefold()):
            marks[lo:hi] = ["L"] * (hi - lo)
        elif re.fullmatch(r"[^\W\d_][\w .'’-]{3,40}:", first) and hi - lo > 1 and overlap("\n".join(lines[lo + 1 : hi]), closings.runs) >= OVERLAP:
            marks[lo:hi] = ["L"] * (hi - lo)
        elif old and len(_words(body)) >= 8 and overlap(body, ancestor_runs) >= 0.9 and any(gain(body, a) >= 0.6 for a in _stretches(ancestors)):
            marks[lo:hi] = ["Q"] * (hi - lo)
        else:
            marks[lo:hi] = ["N"] * (hi - lo)
    # a heading of a notice stands alone above it
    for lo in range(len(lines)):
        if marks[lo] == "N" and re.fullmatch(r"\s*[^\W\d_][^\d.!?]{3,40}:?\s*", lines[lo]) and lo + 1 < len(lines) and marks[lo + 1] == "L":
            marks[lo] = "L"
    return marks


def notices(text: str) -> list[str]:
    """Sentences under rules and after the closing of a message, for the dictionary of closings; letters only count."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    marks, _ = structure(lines)
    out = []
    for lo, hi in paragraphs(marks):
        if lo and marks[lo - 1] == "R" and not HEADER.match(lines[lo]):
            joined = " ".join(x.strip() for x in lines[lo:hi])
            out += [" ".join(s.split()).casefold() for s in re.split(r"(?<=[.!?])\s+", joined)]
    return [re.sub(r"\d", "0", s) for s in out if len(s) >= 12]


def _key(*parts: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def _open_lines(text: str) -> tuple[list[str], list[str], set[str]]:
    """(lines, marks of structure, sender's names)"""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    return (lines, *structure(lines))


_REPLY = re.compile(r"(?:\s*(?:re|aw|antw|fwd?|wg|tr|rv|odp|pd|sv|ответ|пересл)\s*(?:\[\d+\])?\s*:)+\s*", re.I)


def envelope(text: str) -> tuple[str, str, str, float | None]:
    """(thread: the subject without reply marks, sender's name, recipients' names, time sent) of the header block."""
    subject = sender = recipients = ""
    sent = None
    for line in text.split("\n"):
        if not line.strip() and (subject or sender):
            break
        name, _, value = line.strip().strip("*").partition(":")
        name = name.strip().casefold()
        if name in ("subject", "betreff", "objet", "asunto", "temat", "тема") and not subject:
            subject = plain(_REPLY.sub("", value, count=1))
        elif name in ("from", "von", "de", "od", "от") and not sender:
            sender = max(_sender(line), key=len, default="")
        elif name in ("to", "cc", "an", "à", "a", "para", "do", "dw", "кому", "копия"):
            recipients += " " + " ".join(_words(value))
        elif name in ("date", "datum", "sent", "gesendet", "fecha", "data", "дата", "envoyé", "enviado") and sent is None:
            try:
                sent = parsedate_to_datetime(value.strip()).timestamp()
            except (ValueError, TypeError, OverflowError):
                sent = None
    return subject, sender, recipients + " ", sent


def sentences_of(lines: list[str], marks: list[str]) -> list[str]:
    """Sentences of at least eight words in the open paragraphs."""
    out = []
    for lo, hi in paragraphs(marks):
        joined = " ".join(x.strip() for x in lines[lo:hi])
        out += [s for s in re.split(r"(?<=[.!?…])\s+", joined) if len(_words(s)) >= 8]
    return out


#: What a closing formula can look like: up to six words, no digits, no full stop, question or colon.
_FORMULA = re.compile(r"\s*[^\W\d_]+(?:[ '’.-]+[^\W\d_]+){0,5}\s*[,!]?\s*")


def _taught(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each message teaches: kind n: a sentence of a notice; kind f: a short line, and whether it stands above the sender's name."""
    for pdf in batches:
        rows: set[tuple] = set()
        for no, text in enumerate(pdf["text"]):
            lines, marks, names = _open_lines(text)
            rows |= {(no, "n", s, True) for s in notices(text)}
            for i, x in enumerate(lines):
                if not marks[i] and _FORMULA.fullmatch(x) and (p := plain(x)):
                    rows.add((no, "f", p, i + 1 < len(lines) and not marks[i + 1] and _is_name(lines[i + 1], names)))
        yield pd.DataFrame([r[1:] for r in rows], columns=["kind", "s", "placed"])


def _keys_of_sentences(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(_key(*r), s, n) for s, n in zip(pdf["s"], pdf["n"], strict=True) for r in runs(s)]
        yield pd.DataFrame(rows, columns=["key", "s", "n"])


def closings_table(mails: DataFrame) -> DataFrame:
    """Columns key, kind, s: for every word run of a notice sentence of the collection the commonest sentence that has it, and
    the learnt closing formulas (above the sender's name in at least two messages and three tenths of those that have the line)."""
    seen = spread(mails.select("text")).mapInPandas(_taught, "kind string, s string, placed boolean")
    counts = seen.groupBy("kind", "s").agg(F.count_if("placed").alias("n"), F.count(F.lit(1)).alias("all"))
    counts = materialize(counts.where("n > 0 and (kind = 'n' or n >= 2 and n >= 0.3 * all)"), "closings")
    by_run = counts.where("kind = 'n'").mapInPandas(_keys_of_sentences, "key long, s string, n long")
    by_run = by_run.groupBy("key").agg(F.max(F.struct("n", "s")).alias("m")).select("key", F.lit("n").alias("kind"), F.col("m.s").alias("s"))
    formulas = counts.where("kind = 'f'").mapInPandas(lambda batches: (pd.DataFrame({"key": [_key("f", x) for x in pdf["s"]], "s": pdf["s"]}) for pdf in batches), "key long, s string")
    return by_run.unionByName(formulas.select("key", F.lit("f").alias("kind"), "s"))


def _asked(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The word runs and short lines of each message's open paragraphs, by key."""
    for pdf in batches:
        ids, keys = [], []
        for k, text in zip(pdf["id"], pdf["text"], strict=True):
            lines, marks, _ = _open_lines(text)
            own = {_key(*r) for lo, hi in paragraphs(marks) for r in runs("\n".join(lines[lo:hi]))}
            own |= {_key("f", plain(x)) for x, m in zip(lines, marks, strict=True) if not m and _FORMULA.fullmatch(x)}
            ids += [k] * len(own)
            keys += own
        yield pd.DataFrame({"id": pd.Series(ids, dtype=object), "key": pd.Series(keys, dtype="int64")})


def _written(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for k, text in zip(pdf["id"], pdf["text"], strict=True):
            thread, sender, recipients, sent = envelope(text)
            if thread and sender and sent is not None:
                lines, marks, _ = _open_lines(text)
                rows += [(k, _key(thread, " ".join(_words(s))), sender, recipients, sent, s) for s in sentences_of(lines, marks)]
        yield pd.DataFrame(rows, columns=["id", "key", "sender", "recipients", "sent", "s"])


def ancestors(mails: DataFrame) -> DataFrame:
    """Columns id, old: of each message the sentences that an earlier message of its thread, by one of its recipients, holds as its
    own. A thread is a subject; a message without subject, sender or date is in none.

    A sentence of a thread is one row with its first writer, so that no pairs of messages are made."""
    said = materialize(spread(mails).mapInPandas(_written, "id string, key long, sender string, recipients string, sent double, s string"), "sentences")
    first = said.groupBy("key").agg(F.min(F.struct("sent", "sender")).alias("first"))
    later = said.join(first, "key").where("first.sent < sent and first.sender <> sender and contains(recipients, concat(' ', first.sender, ' '))")
    return later.groupBy("id").agg(F.collect_set("s").alias("old"))  # sentences of the message itself


def dictionaries(mails: DataFrame) -> DataFrame:
    """Columns id, text, notices, formulas, old: the messages with what their dictionaries are made of."""
    asked = spread(mails).mapInPandas(_asked, "id string, key long").join(closings_table(mails), "key")
    known = asked.groupBy("id").agg(F.collect_set(F.when(F.col("kind") == "n", F.col("s"))).alias("notices"), F.collect_set(F.when(F.col("kind") == "f", F.col("s"))).alias("formulas"))  # of one message's runs
    return mails.join(known, "id", "left").join(ancestors(mails), "id", "left")


def marked_lines(mails: DataFrame) -> DataFrame:
    """Columns id, line_no (from 1), mark, line for all lines of the messages (columns id, text; see :func:`mail_contents`).

    The messages are read several times: materialize them where they are costly. An empty table gives no rows."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text, notices_, formulas, old in zip(pdf["id"], pdf["text"], pdf["notices"], pdf["formulas"], pdf["old"], strict=True):
                closings = Closings(*(sorted(x) if x is not None else [] for x in (notices_, formulas)))
                marks = classify(text, closings, sorted(old) if old is not None else [])
                rows += [(key, i, m, x) for i, (m, x) in enumerate(zip(marks, text.split("\n"), strict=True), 1)]
            yield pd.DataFrame(rows, columns=["id", "line_no", "mark", "line"])

    return dictionaries(mails).mapInPandas(run, "id string, line_no long, mark string, line string")


def mail_contents(texts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Columns id, text: contents that a catalog row of ext eml or msg (in any case) carries; one row a content.

    Null hashes match nothing; null and empty texts are left out: they have no lines.
    """
    mails = catalog.where(F.lower("ext").isin("eml", "msg") & F.col("content_hash").isNotNull()).select(F.col("content_hash").alias("id")).distinct()
    t = texts.where(F.length("extracted_text") > 0).select(F.col("content_hash").alias("id"), F.col("extracted_text").alias("text"))
    return t.join(mails, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
