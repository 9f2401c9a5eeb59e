import hashlib
import os

import pytest
from pyspark.sql import functions as F

from driftnet import config
from driftnet.functions import columns as C
from driftnet.functions import vectors as V


def _one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_classify_and_config(tmp_path):
    assert [config.classify(e) for e in ("PDF", ".jpg", "mp3", "mkv", "json", "", None)] == ["document", "image", "audio", "video", "unsupported", "unsupported", "unsupported"]
    cfg = config.Config(doc_ext={"json"}, folders=["/a b", 'q"x'])
    config.save(cfg, tmp_path / "c.toml")
    assert config.load(tmp_path / "c.toml") == cfg and config.classify("json", cfg) == "document"
    (tmp_path / "d.toml").write_text('unknown = 1\nembed_dim = 7\n')
    assert config.load(tmp_path / "d.toml").embed_dim == 7 and config.load(tmp_path / "none") == config.Config()


def test_extension_equals_splitext(spark):
    names = ["a.txt", "a.tar.GZ", ".bashrc", "noext", "x.", "..a.txt", "a b.C", "ä.ö"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r["x"] for r in df.select(C.extension(F.col("n")).alias("x")).collect()]
    assert got == [os.path.splitext(n)[1][1:].lower() for n in names]


def test_kind_of_equals_classify(spark):
    ext = ["pdf", "PDF", ".jpg", "mp3", "mov", "json", "", None]
    df = spark.createDataFrame([(e,) for e in ext], "e string")
    assert [r["x"] for r in df.select(C.kind_of(F.col("e")).alias("x")).collect()] == [config.classify(e) for e in ext]


def test_text_functions(spark):
    assert _one(spark, C.strip_markup(F.lit("<p>a  b</p>\n<br/>c"))) == "a b c"
    assert _one(spark, C.snippet(F.lit("  \n abc  "))) == "abc"
    assert _one(spark, C.clean_text(F.lit(None).cast("string"))) == ""
    assert _one(spark, C.clean_text(F.lit("a\u0000b"))) == "ab"


@pytest.mark.parametrize(("name", "term", "hit"), [("My File.TXT", "file", True), ("CAFÉ", "café", False), ("a%b", "%", True), ("doc_1", "doc_1", True), ("docx1", "doc_1", True), ("a\\yb", "\\y", True), ("ab", "\\y", False)])
def test_like_folds_ascii_only(spark, name, term, hit):
    assert _one(spark, C.like_contains(F.lit(name), term)) is hit


def test_content_hash(spark):
    assert _one(spark, C.content_hash(F.lit("grün"))) == hashlib.sha256(b"5" + "grün".encode()).hexdigest()
    big = b"a" * (C.QUICK_HASH + 5) + b"z"
    df = spark.createDataFrame([(bytearray(big),)], "b binary")
    assert df.select(C.content_hash(F.col("b")).alias("x")).first()["x"] == hashlib.sha256(str(len(big)).encode() + big[: C.EDGE] + big[-C.EDGE :]).hexdigest()


def test_units(spark):
    sizes = {None: "?", 0: "?", 5: "5B", 1023: "1023B", 1024: "1K", 5 << 20: "5M", 3 << 40: "3T", 9 << 50: "9P"}
    df = spark.createDataFrame([(k,) for k in sizes], "n long")
    assert [r["x"] for r in df.select(C.human_size(F.col("n")).alias("x")).collect()] == list(sizes.values())
    spans = {10.0: "10s", 89.0: "89s", 90.0: "2 min", 5399.0: "90 min", 5400.0: "1.5 h", None: None}
    df = spark.createDataFrame([(k,) for k in spans], "n double")
    assert [r["x"] for r in df.select(C.human_duration(F.col("n")).alias("x")).collect()] == list(spans.values())
    assert _one(spark, C.dms_degrees(F.lit(10), F.lit(30), F.lit(None), F.lit("south"))) == -10.5


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [r["x"] for r in df.select(V.normalized(F.col("v")).alias("x")).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0.0, 0.0]
    q = F.array(F.lit(1.0), F.lit(0.0))
    sixty = F.array(F.lit(0.5), F.lit(3**0.5 / 2))
    assert _one(spark, V.similarity(V.squared_distance(q, sixty))) == pytest.approx(0.5, abs=1e-6)
    with pytest.raises(Exception, match="expected 3"):
        df.select(V.checked(F.col("v"), 3)).collect()


def test_image_description(spark):
    n = F.lit(None).cast("string")
    text = C.image_description(F.lit("d"), F.lit("p.jpg"), F.lit("2020"), n, F.lit(""), F.lit(3), F.lit(4), F.lit("words"))
    assert _one(spark, text) == "file: d/p.jpg\ntaken: 2020\nsize: 3x4\ntext in image: words"
