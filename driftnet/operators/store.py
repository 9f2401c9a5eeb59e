"""Versioned tables: every change writes new parquet folders, and the manifest that names them is replaced last."""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from driftnet.schema import TABLES

VERSION = 1


class Store:
    """A folder of table versions. Readers keep the version they opened; a run that is killed leaves the old one in force.

    The folder must be one that every executor reaches. Meta values (model, dimension, budgets) live in the manifest.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)
        self.root.mkdir(mode=0o700, parents=True, exist_ok=True)
        os.chmod(self.root, 0o700)

    @property
    def _manifest(self) -> Path:
        return self.root / "manifest.json"

    def manifest(self) -> dict:
        if not self._manifest.exists():
            return {"schema_version": VERSION, "tables": {}, "meta": {}}
        return json.loads(self._manifest.read_text())

    def meta(self) -> dict[str, str]:
        return self.manifest()["meta"]

    def read(self, name: str) -> DataFrame:
        folder = self.manifest()["tables"].get(name)
        if folder is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(str(self.root / folder))

    def publish(self, tables: dict[str, DataFrame], meta: dict[str, str] | None = None) -> None:
        """Write new versions, then switch to all of them at once."""
        now = self.manifest()
        for name, df in tables.items():
            folder = f"{name}-{uuid.uuid4().hex}"
            df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in TABLES[name]]).write.parquet(str(self.root / folder))
            self._private(self.root / folder)
            now["tables"][name] = folder
        now["meta"] |= {k: str(v) for k, v in (meta or {}).items()}
        draft = self.root / f".manifest-{uuid.uuid4().hex}"
        draft.write_text(json.dumps(now, indent=1))
        os.chmod(draft, 0o600)
        os.replace(draft, self._manifest)

    @staticmethod
    def _private(folder: Path) -> None:
        """Only the owner may read what was written."""
        os.chmod(folder, 0o700)
        for f in folder.iterdir():
            os.chmod(f, 0o600)

    def vacuum(self, older_than: float = 3600.0) -> list[str]:
        """Remove table versions that the manifest doesn't name and that nobody has written to for so many seconds; a reader
        that opened one before has had that long to finish. Their names."""
        named = set(self.manifest()["tables"].values())
        old = [f for f in self.root.iterdir() if f.is_dir() and "-" in f.name and f.name.rsplit("-", 1)[0] in TABLES and f.name not in named and time.time() - f.stat().st_mtime >= older_than]
        for f in old:
            shutil.rmtree(f, ignore_errors=True)
        return sorted(f.name for f in old)

    @contextmanager
    def lock(self) -> Iterator[bool]:
        """Whether this is the only writer; the second one gets False and should leave."""
        with (self.root / ".lock").open("w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError:
                yield False
                return
            try:
                yield True
            finally:
                fcntl.flock(f, fcntl.LOCK_UN)
