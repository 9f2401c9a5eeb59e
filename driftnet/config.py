"""Settings: which files are worth what, budgets, model names. Read from TOML, written as TOML text."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

# The extensions of each kind, and what a walk leaves out.
DOCUMENT_EXT = {
    "pdf", "docx", "doc", "odt", "rtf", "txt", "md", "markdown", "epub", "pptx", "ppt", "xlsx", "xls", "csv", "tsv", "html", "htm",
    "tex", "org", "eml", "msg", "mbox",
}
IMAGE_EXT = {"jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "webp", "heic", "heif"}
AUDIO_EXT = {"mp3", "wav", "flac", "m4a", "aac", "ogg", "opus", "wma"}
VIDEO_EXT = {"mp4", "mkv", "avi", "mov", "wmv", "webm", "flv", "m4v", "mpg", "mpeg"}
EXCLUDED_DIRS = {
    "System Volume Information", "$RECYCLE.BIN", "$Recycle.Bin", "lost+found", ".Trash", ".Trash-1000", ".zfs", ".fseventsd", ".Spotlight-V100",
    "Windows", "Program Files", "Program Files (x86)", "ProgramData", "AppData", ".git", ".svn", ".hg", "__pycache__", ".mypy_cache", ".pytest_cache",
    ".ruff_cache", ".tox", ".ipynb_checkpoints", ".terraform", "node_modules", ".npm", ".bun", ".yarn", ".pnpm-store", ".deno", ".nvm",
    ".cargo", ".rustup", ".gradle", ".m2", ".nuget", ".gem", ".pub-cache", ".pyenv", ".rbenv", "site-packages", "dist-packages", "venv", ".venv",
    "virtualenvs", "anaconda3", "miniconda3", ".conda", ".cache", "Cache", "Caches", ".vscode-server", ".vscode", ".cursor-server", ".cursor", ".idea",
    ".jupyter", ".ipython", "snap", ".steam", ".wine", ".docker", ".ollama", ".local-cache",
}
EXCLUDED_DIR_SUFFIXES = (".dist-info", ".egg-info")
EXCLUDED_FILE_PREFIXES = ("._", "~$", ".~lock.")
EXCLUDED_FILES = {".DS_Store", "Thumbs.db", "desktop.ini", ".localized"}

# Names, limits and defaults that stored catalogues and their users rely on.
STATUSES = ("pending", "done", "failed", "unsupported", "skipped")
PHASES = ("document", "image_meta", "audio", "image_caption")
CHECK_SECONDS = 60
PURGE_SECONDS = 90 * 86_400
KEEP_TIMINGS = 20_000
RATE_ROWS = 2_000
STREAK_LIMIT = 25


@dataclass
class Config:
    # Fixed values, as above.
    folders: list[str] = field(default_factory=list)
    backend: str = "hashing"
    embed_model: str = "hashing-128"
    embed_dim: int = 128
    first_run_budget_seconds: int = 5 * 3600
    daily_budget_seconds: int = 20 * 60
    image_skip_below: int = 20 * 1024
    max_enrich_retries: int = 3
    min_size_bytes: int = 16
    transcribe_max_seconds: int = 600
    ocr_languages: str = "eng+spa"
    #: A GeoNames table that every executor can open, for the places of photos; none if empty.
    cities_file: str = ""
    doc_ext: set[str] = field(default_factory=lambda: set(DOCUMENT_EXT))
    image_ext: set[str] = field(default_factory=lambda: set(IMAGE_EXT))
    audio_ext: set[str] = field(default_factory=lambda: set(AUDIO_EXT))
    video_ext: set[str] = field(default_factory=lambda: set(VIDEO_EXT))
    exclude_dirs: set[str] = field(default_factory=lambda: set(EXCLUDED_DIRS))
    exclude_dir_suffixes: tuple[str, ...] = EXCLUDED_DIR_SUFFIXES
    exclude_file_prefixes: tuple[str, ...] = EXCLUDED_FILE_PREFIXES
    exclude_filenames: set[str] = field(default_factory=lambda: set(EXCLUDED_FILES))

    def kinds(self) -> list[tuple[str, set[str]]]:
        """Kinds in the order in which an extension is tried."""
        return [("document", self.doc_ext), ("image", self.image_ext), ("audio", self.audio_ext), ("video", self.video_ext)]

    def phase_ext(self, phase: str) -> set[str]:
        return {"document": self.doc_ext, "image_meta": self.image_ext, "image_caption": self.image_ext, "audio": self.audio_ext | self.video_ext}.get(phase, set())


def classify(ext: str | None, cfg: Config | None = None) -> str:
    """The kind of an extension; the first set that has it decides."""
    e = (ext or "").lower().lstrip(".")
    return next((kind for kind, own in (cfg or Config()).kinds() if e in own), "unsupported")


def load(path: str | Path) -> Config:
    """Settings from a TOML file; keys it doesn't know are left alone, a missing file gives the defaults."""
    cfg = Config()
    if not Path(path).exists():
        return cfg
    raw = tomllib.loads(Path(path).read_text())
    for f in fields(Config):
        if f.name in raw:
            kind = type(getattr(cfg, f.name))
            setattr(cfg, f.name, kind(raw[f.name]))
    return cfg


def save(cfg: Config, path: str | Path) -> None:
    def text(v) -> str:
        if isinstance(v, str):
            return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
        if isinstance(v, (set, list, tuple)):
            return "[" + ", ".join(text(x) for x in (sorted(v) if isinstance(v, set) else v)) + "]"
        return str(v)

    Path(path).write_text("".join(f"{f.name} = {text(getattr(cfg, f.name))}\n" for f in fields(cfg)))
