import os

import pytest

from driftnet import cli
from driftnet.config import STREAK_LIMIT, Config
from driftnet.operators import geo, index, status
from driftnet.operators.store import Store
from driftnet.sources import extract
from driftnet.sources import walk as walking

NOW = 1_800_000_000.0


def _crawled(spark, tmp_path, names, **settings):
    (tmp_path / "in").mkdir()
    for i, name in enumerate(names):
        (tmp_path / "in" / name).write_text(f"the text of file number {i}, in full " * 20)
    cfg = Config(folders=[str(tmp_path / "in")], embed_dim=16, image_skip_below=10, **settings)
    store = Store(spark, str(tmp_path / "store"))
    index.crawl_store(store, cfg, NOW)
    return store, cfg


def test_timings_are_of_files_and_stages(spark, tmp_path):
    store, cfg = _crawled(spark, tmp_path, [f"{i}.txt" for i in range(40)])
    done = index.run(store, cfg, 600, NOW)
    assert done["counts"] == {"done": 40}
    log = store.read("enrich_timing").toPandas()
    assert log.groupby("stage").size().to_dict() == {"hash": 40, "extract": 40, "embed": 40} and log["id"].is_unique and (log["seconds"] >= 0).all()
    each = status.seconds_per_file(store.read("enrich_timing"), "document").first()["seconds"]
    assert abs(each - log["seconds"].sum() / 40) < 1e-9
    folder = store.root / store.manifest()["tables"]["file_catalog"]
    assert oct(folder.stat().st_mode & 0o777) == "0o700" and {oct(f.stat().st_mode & 0o777) for f in folder.iterdir()} == {"0o600"}
    versions = [f for f in os.listdir(store.root) if f.startswith("file_catalog-")]
    assert len(versions) > 1 and set(store.vacuum(0)) >= set(versions) - {folder.name} and store.read("file_catalog").count() == 40


def test_a_batch_is_read_on_all_cores(spark, tmp_path):
    files = spark.range(100).selectExpr("id", "'x' path", "'txt' ext", "id size_bytes").orderBy("id").limit(90)
    assert index._dealt(files, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_failing_model_ends_the_run_and_leaves_the_rest(spark, tmp_path):
    store, cfg = _crawled(spark, tmp_path, [f"{i}.txt" for i in range(60)], backend="tests.stub_backends:Dead")
    with pytest.raises(index.SystemicFailure):
        index.run(store, cfg, 600, NOW)
    tried = store.read("file_catalog").where("retry_count > 0").count()
    assert tried == STREAK_LIMIT and store.read("file_catalog").where("status = 'pending' and retry_count = 0").count() == 60 - STREAK_LIMIT


def test_a_blind_model_demotes_no_image(spark, tmp_path):
    store, cfg = _crawled(spark, tmp_path, [f"{i}.png" for i in range(40)], backend="tests.stub_backends:Blind")
    with pytest.raises(index.SystemicFailure):
        index.run(store, cfg, 600, NOW)
    assert {r["source_kind"]: r["count"] for r in store.read("file_embedding").groupBy("source_kind").count().collect()} == {"image_meta": 40}
    few = Store(spark, str(tmp_path / "few"))
    cfg.folders = [str(tmp_path / "three")]
    (tmp_path / "three").mkdir()
    for i in range(3):
        (tmp_path / "three" / f"{i}.png").write_text(f"picture {i} " * 20)
    index.crawl_store(few, cfg, NOW)
    index.run(few, cfg, 600, NOW)  # below the limit: each is tried once
    assert {r["source_kind"] for r in few.read("file_embedding").collect()} == {"image"}
    assert few.read("enrich_timing").where("stage = 'caption'").count() == 3


def test_places_of_photos(spark, tmp_path):
    assert extract.position({1: "S", 2: (17, 42, 0), 3: "E", 4: (179, 54, 0)}) == (-17.7, 179.9)
    assert extract.position({2: (1, 2, 3)}) is None and extract.position({}) is None and extract.position({1: "N", 2: None, 4: None}) is None
    row = ["0"] * 19
    lines = []
    for name, code, lat, lon in (("Florence", "IT", "43.77", "11.25"), ("Suva", "FJ", "-18.14", "178.44"), ("Odd", "FJ", "", "")):
        row[1], row[8], row[4], row[5] = name, code, lat, lon
        lines.append("\t".join(row))
    (tmp_path / "cities.txt").write_text("\n".join(lines) + "\n")
    place = geo.place_finder(str(tmp_path / "cities.txt"))
    assert [place(43.7, 11.2), place(-17.7, 179.9), place(-17.7, -179.9), place(999, 999), place(float("nan"), 1)] == ["Florence, IT", "Suva, FJ", "Suva, FJ", None, None]
    cities = geo.read_geonames(spark, str(tmp_path / "cities.txt"))
    assert {r["name"] for r in cities.collect()} == {"Florence, IT", "Suva, FJ"}
    points = spark.createDataFrame([(1, 43.7, 11.2), (2, 91.0, 0.0), (3, None, 0.0), (4, 0.0, 181.0)], "id int, lat double, lon double")
    assert {r["id"]: r["place"] for r in geo.nearest_place(points, cities).collect()} == {1: "Florence, IT", 2: None, 3: None, 4: None}
    assert extract.describe_image(str(tmp_path / "cities.txt")).startswith("file: ")


def test_an_unknown_model_is_an_error_of_a_search(spark, tmp_path):
    (tmp_path / "c.toml").write_text('backend = "nonsense"\n')
    with pytest.raises(ValueError, match="nonsense"):
        cli.main(["--store", str(tmp_path / "s"), "--config", str(tmp_path / "c.toml"), "search", "lease"])


def test_a_deep_folder_is_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(walking, "WANTED", 6)
    monkeypatch.setattr(walking, "TOGETHER", 2)
    want = set()
    for k in range(9):
        folder = tmp_path / "one" / "two" / f"sub{k}" / "deep"
        folder.mkdir(parents=True)
        for f in (folder / "a.txt", folder.parent / "b.txt"):
            f.write_text("x" * 30)
            want.add(str(f))
    (tmp_path / "one" / "c.txt").write_text("x" * 30)
    reader = walking._WalkReader([str(tmp_path)], Config())
    parts = reader.partitions()
    assert sum(p.recurse for p in parts) == 9  # the nine below two listed folders
    assert sorted(row[0] for p in parts for row in reader.read(p)) == sorted({*want, str(tmp_path / "one" / "c.txt")})


def test_doctor(spark, tmp_path, capsys):
    (tmp_path / "c.toml").write_text(f'folders = ["{tmp_path}", "{tmp_path}/gone"]\n')
    base = ["--store", str(tmp_path / "s"), "--config", str(tmp_path / "c.toml")]
    assert cli.main([*base, "doctor"]) == 0
    out = capsys.readouterr().out
    assert f"ok       folder {tmp_path}\n" in out and f"missing  folder {tmp_path}/gone" in out and "ok       model hashing-128: 128 values" in out and "empty    store" in out
    (tmp_path / "c.toml").write_text('backend = "nonsense"\n')
    assert cli.main([*base, "doctor"]) == 1
