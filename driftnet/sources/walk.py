"""A Spark data source that walks folders: folders are listed breadth first until there are enough to deal out, then walked by
tasks; directories are pruned before they are entered."""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor, TimeoutError

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from driftnet.config import Config
from driftnet.schema import WALK

ROOT_TIMEOUT = 10.0


def reachable(root: str, timeout: float = ROOT_TIMEOUT) -> bool:
    """Whether a root can be read within the deadline; a hanging mount counts as unreachable."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(os.path.isdir, root).result(timeout)
    except (TimeoutError, OSError):
        return False
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def safe_name(path: str) -> tuple[str, bool]:
    """The path as a valid string (undecodable bytes become ?, NUL goes) and whether that changed it."""
    safe = path.encode("utf-8", "replace").decode("utf-8").replace("\x00", "")
    return safe, safe != path


def _wanted_dir(name: str, cfg: Config) -> bool:
    return name not in cfg.exclude_dirs and not name.endswith(tuple(cfg.exclude_dir_suffixes))


def _wanted_file(name: str, cfg: Config) -> bool:
    return name not in cfg.exclude_filenames and not name.startswith(tuple(cfg.exclude_file_prefixes))


def walk(top: str, cfg: Config, recurse: bool = True) -> Iterator[tuple[str, int, float, int]]:
    """(path, size, mtime, renamed) of the files below ``top``. Symbolic links aren't followed; what can't be read is passed over."""
    waiting = [top]
    while waiting:
        try:
            with os.scandir(waiting.pop()) as entries:
                for e in entries:
                    try:
                        if e.is_symlink():
                            continue
                        if e.is_dir(follow_symlinks=False):
                            if recurse and _wanted_dir(e.name, cfg):
                                waiting.append(e.path)
                        elif e.is_file(follow_symlinks=False) and _wanted_file(e.name, cfg):
                            s = e.stat(follow_symlinks=False)
                            if s.st_size >= cfg.min_size_bytes:
                                path, renamed = safe_name(e.path)
                                yield path, s.st_size, s.st_mtime, int(renamed)
                    except OSError:
                        continue
        except OSError:
            continue


#: Folders to walk that are worth dealing out, and how many are listed at most to find so many.
WANTED, LISTED = 1024, 2048
#: Folders already listed whose own files one task takes.
TOGETHER = 32


class _Part(InputPartition):
    def __init__(self, tops: list[str], recurse: bool):
        self.tops, self.recurse = tops, recurse


class _WalkReader(DataSourceReader):
    def __init__(self, roots: list[str], cfg: Config):
        self.roots, self.cfg = roots, cfg

    def partitions(self) -> list[_Part]:
        """A folder that holds nearly everything is split as far down as it takes."""
        open_, listed = deque(self.roots), []
        while open_ and len(open_) < WANTED and len(listed) < LISTED:
            top = open_.popleft()
            listed.append(top)
            try:
                with os.scandir(top) as entries:
                    open_.extend(e.path for e in entries if not e.is_symlink() and e.is_dir(follow_symlinks=False) and _wanted_dir(e.name, self.cfg))
            except OSError:
                continue
        return [_Part(listed[i : i + TOGETHER], False) for i in range(0, len(listed), TOGETHER)] + [_Part([top], True) for top in open_]

    def read(self, part: _Part) -> Iterator[tuple]:
        for top in part.tops:
            yield from walk(top, self.cfg, part.recurse)


class WalkSource(DataSource):
    """spark.read.format("driftnet-walk").option("roots", "a\\nb"): path, size_bytes, mtime, renamed."""

    @classmethod
    def name(cls) -> str:
        return "driftnet-walk"

    def schema(self):
        return WALK

    def reader(self, schema) -> DataSourceReader:
        from driftnet.config import load

        named = self.options.get("config")
        return _WalkReader([r for r in self.options.get("roots", "").split("\n") if r], load(named) if named else Config())


def walk_files(spark: SparkSession, roots: list[str], config: str | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """(files below the roots that can be reached, those roots, roots that can't be). Folders must be visible to the executors."""
    good = [r.rstrip("/") for r in roots if reachable(r)]
    spark.dataSource.register(WalkSource)
    reader = spark.read.format("driftnet-walk").option("roots", "\n".join(good))
    return (reader.option("config", config) if config else reader).load(), good, [r for r in roots if r.rstrip("/") not in good]
