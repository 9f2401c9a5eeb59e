"""Text out of files, on the executors. A bad file costs one row with a reason, never a task."""

from __future__ import annotations

import email
import email.policy
import hashlib
import os
import re
import shutil
import subprocess
import tempfile
import time
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from driftnet.config import Config, classify
from driftnet.functions.columns import EDGE, QUICK_HASH

# Which reader takes which extension, and the bounds on what is read.
PLAIN_EXT = {"txt", "md", "markdown", "csv", "tsv", "json", "xml", "yaml", "yml", "log", "tex", "org", "html", "htm"}
ZIPPED_EXT = {"docx", "pptx", "xlsx", "odt", "epub"}
BINARY_EXT = {"doc", "ppt", "xls", "rtf"}
MAIL_EXT = {"eml", "msg", "mbox"}
PLAIN_BYTES = 8 << 20
MEMBER_BYTES, ALL_MEMBER_BYTES, MEMBERS = 20 << 20, 50 << 20, 400
PDF_BYTES, PDF_PAGES, PDF_LEAST, OCR_PAGES = 200 << 20, 40, 50, 5
PDF_SECONDS, OCR_SECONDS = 120, 180
_TAG = re.compile(r"<[^>]+>")
_READABLE = re.compile(rb"[\x20-\x7e\t]{6,}")
#: Members of an archive that hold text.
_PARTS: dict[str, Callable[[str], bool]] = {
    "docx": lambda n: n == "word/document.xml",
    "xlsx": lambda n: n == "xl/sharedStrings.xml",
    "odt": lambda n: n == "content.xml",
    "pptx": lambda n: n.startswith("ppt/slides/slide") and n.endswith(".xml"),
    "epub": lambda n: n.endswith((".xhtml", ".html", ".htm")),
}


class Unreadable(Exception):
    """Why a file gave no text."""


def clean(text: str | None) -> str:
    return (text or "").encode("utf-8", "replace").decode("utf-8").replace("\x00", "")


def run_tool(command: list[str], seconds: int) -> str:
    """Output of an external program; Unreadable where it is missing, hangs, or fails without output."""
    if shutil.which(command[0]) is None:
        raise Unreadable(f"{command[0]} is not installed")
    try:
        done = subprocess.run(command, capture_output=True, timeout=seconds)
    except subprocess.TimeoutExpired:
        raise Unreadable(f"{command[0]} timed out after {seconds}s") from None
    out = done.stdout.decode("utf-8", "replace")
    if done.returncode and not out.strip():
        raise Unreadable(done.stderr.decode("utf-8", "replace")[-200:].strip() or f"{command[0]} failed")
    return out


def plain(path: str) -> str:
    with open(path, "rb") as f:
        return f.read(PLAIN_BYTES).decode("utf-8", "replace")


def zipped(path: str, ext: str) -> str:
    """Text of an archive's parts. Bytes are counted as they are unpacked; what the archive says of sizes isn't believed."""
    texts, total = [], 0
    with zipfile.ZipFile(path) as z:
        for name in [n for n in z.namelist() if _PARTS[ext](n)][:MEMBERS]:
            try:
                with z.open(name) as part:
                    raw = part.read(MEMBER_BYTES + 1)
            except Exception:  # a broken member, the others may be fine
                continue
            if len(raw) > MEMBER_BYTES:
                continue
            total += len(raw)
            if total > ALL_MEMBER_BYTES:
                break
            texts.append(raw.decode("utf-8", "replace"))
    if not texts:
        raise Unreadable(f"no readable parts in {ext}")
    return " ".join(_TAG.sub(" ", "\n".join(texts)).split())


def readable_bytes(path: str) -> str:
    """Runs of six or more printable bytes, for old binary formats."""
    with open(path, "rb") as f:
        return "\n".join(m.decode("ascii") for m in _READABLE.findall(f.read(PDF_BYTES)))


def mail(path: str) -> str:
    """Headers people remember first, then the first plain part, else the first HTML part without tags; attachments are left out."""
    with open(path, "rb") as f:
        message = email.message_from_binary_file(f, policy=email.policy.default)
    head = "\n".join(f"{h}: {message[h]}" for h in ("From", "To", "Cc", "Subject", "Date") if message[h])
    found: dict[str, str] = {}
    for part in message.walk():
        kind = part.get_content_type()
        if kind in ("text/plain", "text/html") and not part.get_filename() and kind not in found:
            try:
                found[kind] = part.get_content()
            except Exception:  # an unknown charset costs the part
                continue
    body = found.get("text/plain") or _TAG.sub(" ", found.get("text/html", ""))
    text = re.sub(r"[ \t]+", " ", f"{head}\n\n{body}").strip()
    if not text:
        raise Unreadable("email had no readable text")
    return text


def pdf(path: str, size: int, languages: str) -> str:
    pages = ["-f", "1", "-l", str(PDF_PAGES)] if size > PDF_BYTES else []
    problem, text = None, ""
    try:
        text = run_tool(["pdftotext", "-enc", "UTF-8", *pages, path, "-"], PDF_SECONDS)
    except Unreadable as why:
        problem = why
    if len(text.strip()) >= PDF_LEAST:
        return text
    try:
        with tempfile.TemporaryDirectory() as work:
            run_tool(["pdftoppm", "-r", "200", "-l", str(OCR_PAGES), "-png", path, f"{work}/p"], PDF_SECONDS)
            scanned = "\n".join(run_tool(["tesseract", f"{work}/{p}", "stdout", "-l", languages], OCR_SECONDS) for p in sorted(os.listdir(work)))
        if scanned.strip():
            return scanned
    except Unreadable as why:
        problem = problem or why
    if not text.strip():
        raise problem or Unreadable("no text layer and OCR found nothing")
    return text


def document(path: str, ext: str, size: int, languages: str = "eng") -> tuple[str, str]:
    """(text, reason): one of them is empty."""
    ext = (ext or "").lower().lstrip(".")
    try:
        if ext in PLAIN_EXT:
            return clean(plain(path)), ""
        if ext in MAIL_EXT:
            return clean(mail(path)), ""
        if ext == "pdf":
            return clean(pdf(path, size, languages)), ""
        if ext in BINARY_EXT:
            return clean(readable_bytes(path)), ""
        if ext in ZIPPED_EXT:
            try:
                return clean(zipped(path, ext)), ""
            except (zipfile.BadZipFile, OSError) as broken:  # an old binary file under a new name
                salvaged = readable_bytes(path)
                return (clean(salvaged), "") if salvaged.strip() else ("", f"bad {ext} container: {broken}")
        return "", f"no extractor for .{ext}"
    except Unreadable as why:
        return "", str(why)
    except Exception as problem:  # any other failure is this file's alone
        return "", f"{type(problem).__name__}: {problem}"


def file_hash(path: str, size: int) -> str:
    """SHA-256 of size and bytes; above 8 MiB of size, first and last MiB."""
    h = hashlib.sha256(str(size).encode())
    with open(path, "rb") as f:
        if size <= QUICK_HASH:
            while chunk := f.read(EDGE):
                h.update(chunk)
        else:
            h.update(f.read(EDGE))
            f.seek(-EDGE, os.SEEK_END)
            h.update(f.read(EDGE))
    return h.hexdigest()


def position(gps: dict) -> tuple[float, float] | None:
    """Decimal degrees of an image's GPS entries (1 to 4: hemisphere and degrees, minutes, seconds, of latitude and longitude)."""

    def degrees(parts, ref) -> float:
        whole = sum(float(x) / 60**k for k, x in enumerate(list(parts)[:3]))
        return -whole if str(ref or "")[:1].upper() in ("S", "W") else whole

    try:
        return degrees(gps[2], gps.get(1)), degrees(gps[4], gps.get(3))
    except (KeyError, TypeError, ValueError, ZeroDivisionError):
        return None


def describe_image(path: str, languages: str = "", place=None) -> str:
    """What is known of an image without a model: its folder and name; date, place, camera and size where Pillow can be
    imported; the text in it where tesseract is there. ``place`` names the place of a latitude and longitude, or None."""
    lines = ["file: " + os.path.join(os.path.basename(os.path.dirname(path)), os.path.basename(path))]
    try:
        from PIL import Image

        with Image.open(path) as im:
            size = f"size: {im.size[0]}x{im.size[1]}"
            exif = im.getexif()
            detail = exif.get_ifd(0x8769)
            taken = next((v for tag in (36867, 36868, 306) if (v := detail.get(tag) or exif.get(tag))), None)
            at = position(exif.get_ifd(0x8825))
            where = place(*at) if place and at else None
            lines += [f"taken: {taken}"] if taken else []
            lines += [f"place: {where}"] if where else []
            lines += [f"camera: {str(exif.get(272)).strip()}"] if exif.get(272) else []
            lines.append(size)
    except Exception:  # without Pillow, or not an image: the name stays
        pass
    if languages:
        try:
            seen = run_tool(["tesseract", path, "stdout", "-l", languages], OCR_SECONDS).strip()
            lines += [f"text in image: {seen}"] if seen else []
        except Exception:  # no tool, or it fails: what is known without it stays
            pass
    return clean("\n".join(lines))


def caption_files(files: DataFrame, cfg: Config) -> DataFrame:
    """For files (content_hash, path): content_hash, caption, error, seconds; the model is made once in a task and released at
    its end."""
    from driftnet.embed import backend

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = backend(cfg)
        try:
            for pdf_ in batches:
                rows = []
                for key, path in zip(pdf_["content_hash"], pdf_["path"], strict=True):
                    began = time.perf_counter()
                    try:
                        text, why = model.describe_image(path) if os.path.exists(path) else ("", "file is gone")
                    except Exception as problem:
                        text, why = "", f"caption failed: {problem}"
                    rows.append((key, clean(text), why or None, time.perf_counter() - began))
                yield pd.DataFrame(rows, columns=["content_hash", "caption", "error", "seconds"])
        finally:
            model.release()

    return files.mapInPandas(run, "content_hash string, caption string, error string, seconds double")


def hash_and_extract(files: DataFrame, cfg: Config) -> DataFrame:
    """For files (id, path, ext, size_bytes): content_hash, text, source_kind, outcome (null while open) and reason, with the
    seconds of hashing and of reading (null where a stage wasn't reached) and the size."""
    from driftnet.embed import backend
    from driftnet.operators.geo import place_finder

    def one(id_, path, ext, size, times):
        kind = classify(ext, cfg)
        if kind == "unsupported":
            return id_, None, None, None, "unsupported", None
        if not os.path.exists(path):
            return id_, None, None, None, "missing", None
        began = time.perf_counter()
        try:
            digest = file_hash(path, int(size or 0))
        except OSError as problem:
            return id_, None, None, None, "failed", f"read failed: {problem}"
        finally:
            times.append(time.perf_counter() - began)
        if kind == "document":
            text, why = document(path, ext, int(size or 0), cfg.ocr_languages)
        elif kind == "image":
            if (size or 0) < cfg.image_skip_below:
                return id_, digest, None, None, "skipped", "below image size threshold"
            text, why, kind = describe_image(path, cfg.ocr_languages, place_finder(cfg.cities_file) if cfg.cities_file else None), "", "image_meta"
        else:
            text, why = backend(cfg).transcribe(path)
            if not why and not text.strip():
                return id_, digest, None, kind, "skipped", "no speech detected"
        if why or not text.strip():
            return id_, digest, None, kind, "failed", why or "extractor produced no text"
        return id_, digest, text, kind, None, None

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf_ in batches:
            rows = []
            for id_, path, ext, size in pdf_[["id", "path", "ext", "size_bytes"]].itertuples(index=False):
                times: list[float] = []
                began = time.perf_counter()
                row = one(id_, path, ext, size, times)
                hashed = times[0] if times else None
                rows.append((*row, hashed, time.perf_counter() - began - hashed if times else None, None if pd.isna(size) else int(size)))
            table = pd.DataFrame(rows, columns=["id", "content_hash", "text", "source_kind", "outcome", "reason", "hash_seconds", "read_seconds", "bytes"])
            table["bytes"] = table["bytes"].astype("Int64")
            yield table

    return files.mapInPandas(run, "id long, content_hash string, text string, source_kind string, outcome string, reason string, hash_seconds double, read_seconds double, bytes long")
