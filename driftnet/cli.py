"""Command line: index, search, status, reindex, doctor over a store."""

from __future__ import annotations

import argparse
import importlib.util
import json
import shutil
import sys
import time
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from driftnet.config import load
from driftnet.embed import backend
from driftnet.functions import columns as C
from driftnet.operators import enrich, index, search, status
from driftnet.operators.store import Store
from driftnet.sources.walk import reachable


def _index(store: Store, cfg, a) -> int:
    with store.lock() as mine:
        if not mine:
            print("another run is indexing")
            return 0
        now, today = time.time(), datetime.now(UTC).date().isoformat()
        print("crawl:", index.crawl_store(store, cfg, now, a.folders or None))
        if a.catalog_only:
            return 0
        seconds = enrich.run_budget(store.meta(), today, cfg, a.scheduled)
        try:
            done = index.run(store, cfg, seconds, now, limit=a.limit) if seconds > 0 else {"processed": 0, "counts": {}, "seconds": 0.0}
        except (index.SystemicFailure, index.ModelMismatch) as problem:
            print("enrichment stopped:", problem)
            return 1
        print("enrichment:", done["processed"], "files", done["counts"])
        if a.scheduled:
            left = status.next_phase(status.pending_by_phase(store.read("file_catalog"), store.read("file_embedding"), cfg))
            store.publish({}, enrich.record_spend(store.meta(), today, cfg, done["seconds"], left is None))
            index.prune_store(store, now)
    return 0


def _search(store: Store, cfg, a) -> int:
    why: list[str] = []
    tables = [store.read(n) for n in ("file_catalog", "file_embedding", "vec_embedding")]
    model = backend(cfg)  # an unknown model is an error, one that fails only degrades the search
    hits = search.search(*tables, " ".join(a.words), a.mode, a.limit, embed=model.embed, degraded=why)
    rows = [r.asDict() for r in hits.withColumn("line", C.one_line(F.col("snippet"))).withColumn("human", C.human_size(F.col("size"))).collect()]  # at most a.limit
    if a.json:
        print(json.dumps([{k: v for k, v in r.items() if k in search.RESULT} for r in rows], ensure_ascii=False))
    else:
        for r in rows:
            print(f"{r['score']:.2f}  {r['human']:>6}  {r['path']}\n      {r['line']}")
    for w in why:
        print("by name only:", w, file=sys.stderr)
    return 0 if rows else 1


def _status(store: Store, cfg, a) -> int:
    cat, emb, tim = (store.read(n) for n in ("file_catalog", "file_embedding", "enrich_timing"))
    for r in status.status_counts(cat).collect():
        print(f"{r['status']:12} {r['n']}")
    for r in status.folder_share(cat, cfg.folders or ["/"]).collect():
        print(f"{r['folder']}: {r['n']} ({r['share']:.0f}%)" + ("  most of the index" if r["dominant"] else ""))
    phase = status.next_phase(status.pending_by_phase(cat, emb, cfg))
    captions = status.caption_queue_rows(cat, emb).select("content_hash").distinct().count()
    if captions:
        print(f"images without a caption: {captions}")
    if phase:
        row = status.backlog_estimate(cat, emb, tim, phase, cfg).first()
        print(f"next: {phase}, {row['n']} files" + (f", about {row['work_seconds']:.0f} s" if row["work_seconds"] else ""))
    return 0


def _reindex(store: Store, cfg, a) -> int:
    failed = index.reindex_store(store, cfg)
    print("texts that failed:", failed)
    return 1 if failed else 0


TOOLS = {"tesseract": "text in images and scans", "pdftotext": "text of PDF files", "pdftoppm": "pages of scanned PDF files", "ffmpeg": "sound of recordings"}


def _doctor(store: Store, cfg, a) -> int:
    """What works here: tools, the model, folders, the store. 1 if indexing can't work at all."""
    for tool, use in TOOLS.items():
        print(f"{'ok' if shutil.which(tool) else 'missing':8} {tool}: {use}")
    print(f"{'ok' if importlib.util.find_spec('PIL') else 'missing':8} Pillow: date, place and size of images")
    fine = True
    try:
        model = backend(cfg)
        got = len(model.embed(["a test"])[0])
        fine = got == cfg.embed_dim
        print(f"{'ok' if fine else 'wrong':8} model {model.model_id}: {got} values, {cfg.embed_dim} configured")
        model.release()
    except Exception as problem:
        fine = False
        print(f"{'failed':8} model {cfg.backend}: {problem}")
    for folder in cfg.folders:
        print(f"{'ok' if reachable(folder) else 'missing':8} folder {folder}")
    stamp = store.meta().get("embed_model")
    print(f"{'ok' if stamp else 'empty':8} store {store.root}" + (f", vectors of {stamp}" if stamp else ""))
    return 0 if fine else 1


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="driftnet")
    p.add_argument("--store", required=True)
    p.add_argument("--config", default="driftnet.toml")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index")
    i.add_argument("folders", nargs="*")
    i.add_argument("--scheduled", action="store_true")
    i.add_argument("--catalog-only", action="store_true")
    i.add_argument("--limit", type=int, default=0)
    s = sub.add_parser("search")
    s.add_argument("words", nargs="+")
    s.add_argument("-m", "--mode", choices=search.MODES, default="hybrid")
    s.add_argument("-n", "--limit", type=int, default=20)
    s.add_argument("--json", action="store_true")
    sub.add_parser("status")
    sub.add_parser("reindex").add_argument("--embeddings", action="store_true", help="embed stored texts again (what it always does)")
    sub.add_parser("doctor")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("driftnet").getOrCreate()
    run = {"index": _index, "search": _search, "status": _status, "reindex": _reindex, "doctor": _doctor}[a.command]
    return run(Store(spark, a.store), load(a.config), a)


if __name__ == "__main__":
    sys.exit(main())
