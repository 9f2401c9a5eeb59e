import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftnet import schema
from driftnet.config import Config
from driftnet.embed import BACKENDS, HashingBackend, backend, check_dim, embed_column
from driftnet.operators import crawl, enrich, geo, index, maintenance, search, status
from driftnet.operators.store import Store
from driftnet.sources import extract
from driftnet.sources.walk import reachable, safe_name, walk, walk_files

NOW = 1000.0


def cat(spark, *rows):
    """Catalogue rows from (id, path, changes)."""
    base = dict(filename=None, ext="txt", size_bytes=10, mtime=1.0, content_hash=None, status="pending", error_reason=None, retry_count=0, last_attempt=None, first_seen=1.0, last_seen=1.0, deleted_at=None)
    full = []
    for i, path, ch in rows:
        r = {"id": i, "path": path, **base, "filename": path.rsplit("/", 1)[-1], **ch}
        full.append(tuple(r[f.name] for f in schema.CATALOG))
    return spark.createDataFrame(full, schema.CATALOG)


def listing(spark, *rows):
    return spark.createDataFrame([(p, s, m, r) for p, s, m, r in rows], schema.WALK)


def test_crawl_actions(spark):
    c = cat(spark, (1, "/r/same", {"status": "done", "content_hash": "h"}), (2, "/r/changed", {"status": "done", "content_hash": "h", "retry_count": 2}), (3, "/r/gone", {}), (4, "/r/old", {"deleted_at": 5.0}),
            (5, "/other/x", {}), (6, "/r/failed", {"status": "failed", "retry_count": 1}), (7, "/r/givenup", {"status": "failed", "retry_count": 3}), (8, "/r2/y", {}), (9, "/r/back", {"deleted_at": 5.0, "status": "done", "content_hash": "k"}))
    w = listing(spark, ("/r/same", 10, 1.0, 0), ("/r/changed", 11, 1.0, 0), ("/r/failed", 10, 1.0, 0), ("/r/givenup", 10, 1.0, 0), ("/r/back", 10, 1.0, 0), ("/r/new.PDF", 99, 2.0, 0), ("/r/new.xyz", 99, 2.0, 0), ("/r/bad?.txt", 99, 2.0, 1), ("/r/bad?.txt", 99, 2.0, 1))
    d = crawl.diff(c, w, ["/r"], NOW)
    got = {r["path"]: r for r in d.collect()}
    assert {p: r["action"] for p, r in got.items()} == {
        "/r/same": "seen", "/r/changed": "changed", "/r/gone": "tombstoned", "/r/old": "gone", "/other/x": "outside", "/r/failed": "requeued", "/r/givenup": "seen", "/r2/y": "outside",
        "/r/back": "seen", "/r/new.PDF": "added", "/r/new.xyz": "added", "/r/bad?.txt": "added",
    }
    assert (got["/r/changed"]["content_hash"], got["/r/changed"]["retry_count"], got["/r/changed"]["status"]) == (None, 0, "unsupported")
    assert (got["/r/new.PDF"]["status"], got["/r/new.PDF"]["ext"], got["/r/new.xyz"]["status"], got["/r/bad?.txt"]["status"]) == ("pending", "pdf", "unsupported", "skipped")
    assert (got["/r/gone"]["deleted_at"], got["/r/back"]["deleted_at"], got["/r/old"]["deleted_at"], got["/r/failed"]["status"]) == (NOW, None, 5.0, "pending")
    assert crawl.stats(d).first().asDict() == {"seen": 8, "added": 3, "updated": 5, "tombstoned": 1}
    after = crawl.apply(c, w, ["/r"], NOW)
    assert sorted(r["id"] for r in after.collect()) == list(range(1, 13))
    again = crawl.diff(after, w, ["/r"], NOW + 1)  # the same walk again changes nothing more
    assert {r["action"] for r in again.collect()} == {"seen", "gone", "outside"}


def test_walk(spark, tmp_path):
    for name in ("keep.txt", "node_modules/dep.js", "pkg.dist-info/METADATA", "._fork.pdf", "~$lock.docx", "sub/.hidden.md", "sub/Thumbs.db"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * 20)
    (tmp_path / "tiny.txt").write_text("x")
    (tmp_path / "link.txt").symlink_to(tmp_path / "keep.txt")
    files, good, bad = walk_files(spark, [str(tmp_path), str(tmp_path / "missing")])
    got = {r["path"]: r for r in files.collect()}
    assert {p.removeprefix(str(tmp_path)) for p in got} == {"/keep.txt", "/sub/.hidden.md"} and bad == [str(tmp_path / "missing")] and good == [str(tmp_path)]
    assert got[str(tmp_path / "keep.txt")]["mtime"] == (tmp_path / "keep.txt").stat().st_mtime
    assert len(list(walk(str(tmp_path), Config()))) == 2 and not reachable(str(tmp_path / "keep.txt"))
    assert safe_name("a\udc80b\x00") == ("a?b", True)


def test_extractors(tmp_path):
    import zipfile

    def doc(name, data):
        p = tmp_path / name
        p.write_bytes(data)
        return extract.document(str(p), name.rsplit(".", 1)[-1], len(data))

    assert doc("a.txt", b"gr\xc3\xbcn \xff\x00x") == ("grün �x", "")
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", "<w><t>Hello</t><t>there</t></w>")
    assert extract.document(str(tmp_path / "b.docx"), "docx", 1) == ("Hello there", "")
    with zipfile.ZipFile(tmp_path / "c.docx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "a" * (extract.MEMBER_BYTES + 1))
    assert extract.document(str(tmp_path / "c.docx"), "docx", 1) == ("", "no readable parts in docx")
    assert doc("d.docx", b"\xd0\xcf\x11\xe0 salvaged words here \x00\x01")[0].strip() == "salvaged words here"
    text, why = doc("e.eml", b"From: a@b.example\nTo: c@d.example\nSubject: hello\n\nbody   text\n")
    assert why == "" and text.index("Subject: hello") < text.index("body text")
    html = b"From: a@b.example\nMIME-Version: 1.0\nContent-Type: text/html\n\n<p>only <b>html</b></p>"
    assert "only html" in doc("f.eml", html)[0].replace("  ", " ")
    assert doc("g.zzz", b"x") == ("", "no extractor for .zzz") and extract.document("/none.txt", "txt", 1)[1] != ""


def test_hash_and_extract_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_text("words")
    (tmp_path / "blank.txt").write_text(" " * 30)
    (tmp_path / "s.png").write_bytes(b"x" * 100)
    rows = [(1, str(tmp_path / "a.txt"), "txt", 5), (2, str(tmp_path / "blank.txt"), "txt", 30), (3, str(tmp_path / "s.png"), "png", 100), (4, str(tmp_path / "gone.txt"), "txt", 5), (5, "/x.zzz", "zzz", 5)]
    files = spark.createDataFrame(rows, "id long, path string, ext string, size_bytes long")
    got = {r["id"]: r for r in extract.hash_and_extract(files, Config()).collect()}
    assert (got[1]["text"], got[1]["outcome"]) == ("words", None)
    assert [got[i]["outcome"] for i in (2, 3, 4, 5)] == ["failed", "skipped", "missing", "unsupported"]


def test_finish_and_retries(spark):
    c = cat(spark, *[(i, f"/f{i}", {"retry_count": r, "content_hash": "old" if i == 1 else None}) for i, r in ((1, 1), (2, 0), (3, 2), (4, 0), (5, 1))])
    o = spark.createDataFrame([(1, "failed", None, "embed failed: x"), (2, "missing", None, None), (3, "missing", None, None), (4, "done", "h", None)], "id long, outcome string, new_hash string, reason string")
    got = {r["id"]: (r["status"], r["retry_count"], r["content_hash"], r["error_reason"]) for r in enrich.finish(c, o, NOW).collect()}
    assert got == {1: ("failed", 2, "old", "embed failed: x"), 2: ("pending", 1, None, "file unreadable at enrichment time"), 3: ("failed", 3, None, "file unreadable after repeated attempts"), 4: ("done", 0, "h", None), 5: ("pending", 1, None, None)}


def test_streak(spark):
    rng = random.Random(2)
    rows = [(i, rng.random() < 0.05, rng.random() < 0.7) for i in range(3000)]
    df = spark.createDataFrame(rows, "seq long, ok boolean, blames_model boolean").repartition(5)
    want, k = {}, 0
    for i, ok, blame in rows:
        k = 0 if ok else k + blame
        want[i] = k
    assert {r["seq"]: r["streak"] for r in enrich.failure_streaks(df, rows=100).collect()} == want
    assert enrich.systemic(enrich.failure_streaks(df, rows=100)) == (max(want.values()) >= 25)


def test_budgets():
    t = [0.0]
    b = enrich.Budget(10, lambda: t[0])
    t[0] = 4.0
    b.spend(3)
    assert b.remaining() == 3 and not b.exhausted()
    cfg, meta, given = Config(first_run_budget_seconds=100, daily_budget_seconds=20), {}, []
    for run in range(4):
        s = enrich.run_budget(meta, "d", cfg, True)
        given.append(s)
        meta = enrich.record_spend(meta, "d", cfg, min(40, s), run == 2)
    assert given == [100, 60, 20, 20]
    daily, given = {"first_pass_done": "1"}, []
    for _ in range(3):
        given.append(enrich.run_budget(daily, "d", Config(daily_budget_seconds=100), True))
        daily = enrich.record_spend(daily, "d", Config(), 40, False)
    assert given == [100, 60, 20] and enrich.run_budget(daily, "e", Config(daily_budget_seconds=100), True) == 100
    assert enrich.split_budget(100, [("document", 5), ("image_meta", 2), ("audio", 0)], 5) == {"document": 75, "image_meta": 25}
    assert enrich.split_budget(100, [("document", 4), ("image_meta", 2)], 5) == {"document": 100}


def test_rates_and_counts(spark):
    rows = [(i, "document", s, x, 1, 0.0) for i, (s, x) in enumerate([("hash", 0.1), ("extract", 0.2), ("embed", 0.2)] * 10)]
    t = spark.createDataFrame(rows, schema.TIMING)
    assert status.seconds_per_file(t, "document").first()["seconds"] == pytest.approx(0.5)
    assert status.seconds_per_file(t, "audio").first()["seconds"] is None
    c = cat(spark, *[(i, f"/h/Desktop/{i}", {}) for i in range(9)], (10, "/h/Pictures/x", {"ext": "jpg", "status": "done", "content_hash": "p"}), (11, "/h/gone", {"deleted_at": 1.0}))
    assert [(r["folder"], r["n"], r["share"], r["dominant"]) for r in status.folder_share(c, ["/h/Desktop", "/h/Pictures", "/h/Music"]).collect()] == [("/h/Desktop", 9, 90.0, True), ("/h/Pictures", 1, 10.0, False)]
    assert {r["status"]: r["n"] for r in status.status_counts(c).collect()} == {"pending": 9, "done": 1, "failed": 0, "unsupported": 0, "skipped": 0}
    e = spark.createDataFrame([("p", "t", "image_meta", "m", 1, 0.0)], schema.EMBEDDING)
    backlog = status.pending_by_phase(c, e)
    assert {r["phase"]: r["n"] for r in backlog.collect()} == {"document": 9, "image_meta": 0, "audio": 0, "image_caption": 1} and status.next_phase(backlog) == "document"


def test_prune(spark):
    old = 90 * 86400
    c = cat(spark, (1, "/a", {"deleted_at": NOW - old - 1, "content_hash": "x"}), (2, "/b", {"deleted_at": NOW - 5, "content_hash": "y"}), (3, "/c", {"content_hash": "z"}), (4, "/d", {}))
    e = spark.createDataFrame([(h, "t", "document", "m", 1, 0.0) for h in "xyz"], schema.EMBEDDING)
    v = spark.createDataFrame([(h, [1.0]) for h in "xyz"], schema.VECTOR)
    t = spark.createDataFrame([(i, "document", "hash", 1.0, 1, 0.0) for i in (1, 20_001, 20_002)], schema.TIMING)
    out = maintenance.prune(c, e, v, t, NOW)
    assert out["file_catalog"].count() == 3 and {r[0] for r in out["file_embedding"].collect()} == {"y", "z"} == {r[0] for r in out["vec_embedding"].collect()}
    assert {r["id"] for r in out["enrich_timing"].collect()} == {20_001, 20_002}
    assert maintenance.model_matches({}, "m", 3, e) and maintenance.model_matches({"embed_model": "m", "embed_dim": "3"}, "m", 3, e)
    assert not maintenance.model_matches({"embed_model": "m", "embed_dim": "3"}, "n", 3, e) and maintenance.model_matches({"embed_model": "m", "embed_dim": "3"}, "n", 3, e.limit(0))


def test_nearest_place(spark):
    cities = spark.createDataFrame([(43.77, 11.26, "Florence, IT"), (-17.7, 178.1, "Nadi, FJ"), (48.85, 2.35, "Paris, FR")], "lat double, lon double, name string")
    pts = spark.createDataFrame([(1, 43.7696, 11.2558), (2, 999.0, 999.0), (3, -17.7, 179.9), (4, -17.7, -179.9), (5, None, 1.0)], "id int, lat double, lon double")
    assert {r["id"]: r["place"] for r in geo.nearest_place(pts, cities).collect()} == {1: "Florence, IT", 2: None, 3: "Nadi, FJ", 4: "Nadi, FJ", 5: None}
    assert geo.nearest_place(pts, cities.limit(0)).where("place is not null").count() == 0


def _searchable(spark):
    c = cat(spark, (1, "/d/lease.txt", {"content_hash": "l"}), (2, "/d/copy/lease copy.txt", {"content_hash": "l"}), (3, "/d/recipe.txt", {"content_hash": "r"}), (4, "/d/dead.txt", {"content_hash": "d", "deleted_at": 1.0}), (5, "/lease/x.txt", {"content_hash": "q"}))
    e = spark.createDataFrame([(h, f"text of {h}", "document", "m", 1, 0.0) for h in "lrdq"], schema.EMBEDDING)
    v = spark.createDataFrame([("l", [1.0, 0.0]), ("r", [0.5, math.sqrt(3) / 2]), ("d", [1.0, 0.0]), ("q", [0.0, 1.0])], schema.VECTOR)
    return c, e, v


def test_search(spark):
    c, e, v = _searchable(spark)
    embed = lambda texts: [[1.0, 0.0]]
    lit = [(r["path"], r["score"]) for r in search.search(c, e, v, " Lease ", "literal").collect()]
    assert lit == [("/d/lease.txt", 0.9), ("/d/copy/lease copy.txt", 0.9), ("/lease/x.txt", 0.6)]
    sem = {r["path"]: r["score"] for r in search.search(c, e, v, "lease", "semantic", embed=embed).collect()}
    assert sem["/d/recipe.txt"] == pytest.approx(0.5, abs=1e-4) and "/d/dead.txt" not in sem and "/d/copy/lease copy.txt" not in sem
    hyb = search.search(c, e, v, "lease", "hybrid", embed=embed).collect()
    assert hyb[0]["path"] == "/d/lease.txt" and hyb[0]["score"] == 1.0 and hyb[0]["snippet"] == "text of l"
    assert {r["path"]: r["score"] for r in hyb}["/lease/x.txt"] == pytest.approx(0.75)
    why = []
    assert [r["path"] for r in search.search(c, e, v, "lease", embed=lambda t: 1 / 0, degraded=why).collect()] == [p for p, _ in lit] and "zero" in why[0]
    assert search.search(c, e, v, "lease", "semantic", embed=lambda t: 1 / 0).count() == 0 and search.search(c, e, v, "  ").count() == 0
    with pytest.raises(ValueError, match="mode"):
        search.search(c, e, v, "", "fuzzy")


def test_k_is_taken_before_liveness(spark):
    c = cat(spark, *[(i, f"/f{i}", {"content_hash": f"h{i}", "deleted_at": 1.0 if i < 8 else None}) for i in range(12)])
    e = spark.createDataFrame([(f"h{i}", "t", "document", "m", 1, 0.0) for i in range(12)], schema.EMBEDDING)
    v = spark.createDataFrame([(f"h{i}", [1.0, i / 100]) for i in range(12)], schema.VECTOR)
    assert [r["path"] for r in search.semantic(c, e, v, [1.0, 0.0], 1).collect()] == []  # 8 neighbours, all deleted
    assert len(search.semantic(c, e, v, [1.0, 0.0], 2).collect()) == 4
    x = np.random.default_rng(0).normal(size=(50, 4)).astype(np.float32)
    vv = spark.createDataFrame([(str(i), [float(a) for a in r]) for i, r in enumerate(x)], schema.VECTOR)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.argsort(((u - u[3]) ** 2).sum(1))[:7]
    assert [int(r["content_hash"]) for r in search.nearest(vv, x[3].tolist(), 7).collect()] == want.tolist()


def test_backends(spark):
    m = HashingBackend(16)
    assert m.embed(["a b", "a b"])[0] == m.embed(["a b"])[0] and m.embed([""])[0] == [0.0] * 16
    with pytest.raises(ValueError, match="unknown backend"):
        backend(Config(backend="nope"))
    with pytest.raises(ValueError, match="expected"):
        check_dim([[1.0]], 2, "m")
    df = spark.createDataFrame([("a",), (None,)], "t string").select(embed_column(Config(embed_dim=16))("t").alias("e")).collect()
    assert len(df[0]["e"]["embedding"]) == 16 and df[1]["e"]["embedding"] is None and df[1]["e"]["error"]
    assert "hashing" in BACKENDS


def test_store_upsert_and_captions(spark):
    e = spark.createDataFrame([("a", "old", "document", "m1", 3, 5.0), ("b", "pic", "image_meta", "m1", 3, 5.0), ("c", "pic2", "image_meta", "m1", 4, 5.0)], schema.EMBEDDING)
    new = spark.createDataFrame([("a", "newer", "document", "m2"), ("z", "zz", "document", "m2")], "content_hash string, extracted_text string, source_kind string, model string")
    got = {r["content_hash"]: (r["extracted_text"], r["model"], r["char_count"], r["created_at"]) for r in enrich.store(e, new, NOW).collect()}
    assert got["a"] == ("newer", "m1", 5, 5.0) and got["z"] == ("zz", "m2", 2, NOW) and got["b"][0] == "pic"
    caps = spark.createDataFrame([("b", "a cat", None), ("c", None, "caption failed")], "content_hash string, caption string, error string")
    got = {r["content_hash"]: (r["extracted_text"], r["source_kind"]) for r in enrich.captioned(e, caps).collect()}
    assert got == {"a": ("old", "document"), "b": ("a cat\n\npic", "image"), "c": ("pic2", "image")}


def test_index_search_delete(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "tenancy.txt").write_text("the tenancy lease of the flat in the town")
    (docs / "copy.txt").write_text("the tenancy lease of the flat in the town")
    (docs / "recipe.md").write_text("bread with salt and flour and water")
    (docs / "odd.xyz").write_text("nothing that can be read here")
    cfg = Config(folders=[str(docs)], embed_dim=32)
    store = Store(spark, str(tmp_path / "store"))
    with store.lock() as mine, Store(spark, str(tmp_path / "store")).lock() as second:
        assert mine and not second
    assert index.crawl_store(store, cfg, NOW)["added"] == 4
    done = index.run(store, cfg, 600, NOW)
    assert done["processed"] == 3 and store.read("file_embedding").count() == 2 and store.read("vec_embedding").count() == 2
    assert {r["filename"]: r["status"] for r in store.read("file_catalog").collect()} == {"tenancy.txt": "done", "copy.txt": "done", "recipe.md": "done", "odd.xyz": "unsupported"}
    tables = lambda: [store.read(n) for n in ("file_catalog", "file_embedding", "vec_embedding")]
    hits = search.search(*tables(), "tenancy lease", embed=backend(cfg).embed).collect()
    assert hits[0]["filename"] == "copy.txt" or hits[0]["filename"] == "tenancy.txt"
    assert index.run(store, cfg, 0, NOW)["processed"] == 0
    (docs / "tenancy.txt").unlink()
    (docs / "copy.txt").unlink()
    assert index.crawl_store(store, cfg, NOW + 10)["tombstoned"] == 2
    assert all("tenancy" not in r["filename"] for r in search.search(*tables(), "tenancy", embed=backend(cfg).embed).collect())
    index.prune_store(store, NOW + 91 * 86400)
    assert store.read("file_embedding").count() == 1
    with pytest.raises(index.ModelMismatch):
        index.run(store, Config(folders=[str(docs)], embed_dim=16), 600, NOW)
    assert index.reindex_store(store, Config(embed_dim=16)) == 0 and len(store.read("vec_embedding").first()["embedding"]) == 16


def test_listings_as_a_stream(spark, tmp_path):
    from driftnet.streaming.incremental import fold_listings

    store = Store(spark, str(tmp_path / "store"))
    folder = str(tmp_path / "in")
    listing(spark, ("/r/a.txt", 20, 1.0, 0), ("/r/b.txt", 20, 1.0, 0)).coalesce(1).write.parquet(folder)
    run = lambda now: fold_listings(spark, store, folder, ["/r"], now, str(tmp_path / "check")).awaitTermination()
    run(1.0)
    assert store.read("file_catalog").count() == 2
    listing(spark, ("/r/a.txt", 20, 1.0, 0)).coalesce(1).write.mode("append").parquet(folder)
    run(2.0)
    run(3.0)
    assert {r["path"]: r["deleted_at"] for r in store.read("file_catalog").collect()} == {"/r/a.txt": None, "/r/b.txt": 2.0}


def test_captions_and_transcripts(spark, tmp_path):
    for name in ("a.png", "dark.png", "talk.mp3", "silent.mp3"):
        (tmp_path / name).write_bytes(name.encode() * 5000)
    cfg = Config(folders=[str(tmp_path)], backend="tests.stub_backends:Seeing", embed_dim=16, image_skip_below=10)
    store = Store(spark, str(tmp_path / "snap"))
    index.crawl_store(store, cfg, NOW)
    done = index.run(store, cfg, 600, NOW)
    assert done["counts"] == {"done": 4, "skipped": 1, "failed": 1}  # two images, a talk, a caption; silence; a dark image
    kinds = {r["extracted_text"].split("\n")[0]: r["source_kind"] for r in store.read("file_embedding").collect()}
    assert kinds["a described image"] == "image" and kinds["a transcript"] == "audio" and set(kinds.values()) == {"image", "audio"}


def test_command_line(spark, tmp_path, capsys):
    import json

    from driftnet import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "lease.txt").write_text("the lease of the flat, in full")
    base = ["--store", str(tmp_path / "store"), "--config", str(tmp_path / "none.toml")]
    assert cli.main([*base, "index", str(tmp_path / "in"), "--scheduled"]) == 0
    capsys.readouterr()
    assert cli.main([*base, "search", "lease", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["filename"] == "lease.txt"
    assert cli.main([*base, "search", "nothing", "-m", "literal"]) == 1 and cli.main([*base, "status"]) == 0 and cli.main([*base, "reindex"]) == 0
