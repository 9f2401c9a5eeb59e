import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from driftnet.llm import mixing, packing, queries, tokens


def test_every_item_once_and_within_capacity(spark):
    rng = random.Random(1)
    rows = [(i, int(rng.lognormvariate(5, 1.2))) for i in range(3000)] + [(None, 5), (7, 5), (9_999, None), (10_000, 0), (10_001, 5_000)]
    df = spark.createDataFrame(rows, "doc_id long, size int").repartition(3)
    caps = {"small": 512, "large": 2048}
    got = packing.pack(df, "doc_id", F.col("size"), caps).collect()
    for name, cap in caps.items():
        own = [r for r in got if r["limit_name"] == name]
        fill = defaultdict(int)
        for r in own:
            if r["container_id"] is not None:
                fill[r["container_id"]] += r["size"]
        assert max(fill.values()) <= cap
        total = sum(n or 0 for _, n in rows)
        assert sum(r["size"] for r in own) == total
        assert Counter(r["item_id"] for r in own if r["piece"] == 0) == Counter(k for k, _ in rows)
        pieces = sorted((r["start"], r["size"]) for r in own if r["item_id"] == 10_001)
        assert [s for s, _ in pieces] == list(range(0, 5000, cap)) and sum(n for _, n in pieces) == 5000
        assert all(r["size"] <= cap for r in own) and total / (len(fill) * cap) > 0.93


def test_nothing_to_pack(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, size int"), "doc_id", F.col("size"), {"a": 10}).count() == 0


def test_packer_batches(spark):
    p = packing.Packer(100)
    boxes = defaultdict(int)
    rng = random.Random(2)
    sizes, done = {}, {}
    for b in range(4):
        items = [(rng.randint(1, 100), b * 500 + i) for i in range(500)] if b < 3 else []
        sizes |= {i: s for s, i in items}
        done |= p.add(items, b == 3)
    for i, box in done.items():
        boxes[box] += sizes[i]
    assert done.keys() == sizes.keys() and max(boxes.values()) <= 100 and sum(sizes.values()) / (100 * len(boxes)) > 0.93


def test_classes_are_filled_by_count_in_the_last_batch(monkeypatch):
    fitted = []
    first_fit = packing.Packer._first_fit
    monkeypatch.setattr(packing.Packer, "_first_fit", lambda self, items, out: fitted.extend(items) or first_fit(self, items, out))
    rng = random.Random(4)
    items = [(rng.randint(1, 60), i) for i in range(500)]
    p = packing.Packer(100)
    done = p.add(items, True)
    left = Counter(100 // s for s, _ in fitted)
    assert done.keys() == {i for _, i in items} and not p.waiting
    assert all(n < k for k, n in left.items() if k < packing.CLASSES)
    small = packing.Packer(100).add([(50, 0), (40, 1), (36, 2)], True)
    assert small[1] == small[2] != small[0]


def test_token_counts_equal_the_encoding():
    c = tokens.counter(tokens.VOCABULARY)
    for text in ("", "one two  three", " lead", "trail ", "a\n b", "Größe 12.50 €\nzwei", "x" * 3000, "it's we'll", "日本 語 x", "tab\tseparated words"):
        assert c.count(text) == len(c.encoding.encode_ordinary(text)), text


def test_mixture(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a"] * 6 + ["b"] * 3 + ["c"]), f"text {i}") for i in range(3000)] + [(5000, "a", "text 1"), (5001, "c", None), (5002, None, "x y"), (None, "a", "z"), (5003, "d", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("key", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.3, 2), ("c", 0.3, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    size = F.pmod(F.xxhash64("doc_id"), F.lit(200)) + 1
    texts = mixing.sized_texts(docs, targets, "doc_id", "source", "text", size)
    assert texts.where("key = 5000").count() == 0
    out = mixing.mix(texts, targets)
    shares = {r["source"]: r for r in mixing.reached_shares(out, texts, targets).collect()}
    for s, cap in (("a", 2), ("b", 2), ("c", 3)):
        assert abs(shares[s]["reached_share"] - 1 / 3) < 0.01 and shares[s]["most_repeats"] <= cap
    assert shares["gone"]["reached_share"] == 0
    assert {r["copies"] for r in out.where("source = 'c'").collect()} == {3}
    again = mixing.mix(texts, targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    assert mixing.mix(texts.limit(0), targets).count() == 0


def _p9_tables(spark, folder, docs, targets):
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(targets, "source string, target_share double, max_repeats int").write.parquet(f"{folder}/mix_targets.parquet")


def test_checked_names_targets_of_which_nothing_was_selected(spark, tmp_path):
    # b: each of ten equal texts is large and expected 0.1 times; c: only a copy of a's text; d: a target of nothing; e: no target
    docs = [(0, "a", "word"), *((i, "b", f"word {chr(96 + i)}") for i in range(1, 11)), (20, "c", "word"), (21, "d", "own"), (22, "e", "other"), (23, "f", "")]
    _p9_tables(spark, tmp_path, docs, [("a", 0.4, 1), ("b", 0.4, 1), ("c", 0.1, 1), ("d", 0.0, 1), ("f", 0.1, 1)])
    assert {r["source"] for r in queries.p9_selection(spark, str(tmp_path)).collect()} == {"a"}
    got = sorted(map(tuple, queries.p9_checked(spark, str(tmp_path)).collect()))
    assert got == [("a", 0, 0, 0), ("b", 0, 0, 0), ("c", 0, 0, 0)]


def test_checked_tells_every_fault_of_a_selection(spark, tmp_path, monkeypatch):
    docs = [(1, "a", "one"), (2, "a", "two"), (3, "a", "two"), (4, "b", "four"), (5, "e", "five"), (6, "a", "six"), (7, "c", "six"), (8, "c", "eight")]
    _p9_tables(spark, tmp_path, docs, [("a", 0.4, 2), ("b", 0.3, 2), ("c", 0.3, 2)])
    # over the cap; a text under two keys; a text of b; no such document; a source without a target; a text under two sources
    rows = [(1, "a", 1, 3), (2, "a", 1, 1), (3, "a", 1, 1), (4, "a", 1, 1), (99, "a", 1, 1), (5, "e", 1, 1), (6, "a", 1, 2), (7, "c", 1, 1), (8, "c", 1, 2)]
    monkeypatch.setattr(mixing, "mix", lambda *_: spark.createDataFrame(rows, "key long, source string, size long, copies int"))
    got = sorted(map(tuple, queries.p9_checked(spark, str(tmp_path)).collect()))
    assert got == [("a", 2, 2, 2), ("b", 0, 0, 0), ("c", 1, 1, 0), ("e", 1, 0, 0)]


def test_checked_counts_a_row_delivered_twice_once(spark, tmp_path):
    docs = [(i, "ab"[i % 2], f"word {i}") for i in range(40)]
    _p9_tables(spark, tmp_path, docs + docs[:3] + [(None, "a", "no id")] * 2, [("a", 0.5, 2), ("b", 0.5, 1)])
    keys = [r["doc_id"] for r in queries.p9_selection(spark, str(tmp_path)).collect()]
    assert len(set(keys)) == len(keys) > 30
    got = sorted(map(tuple, queries.p9_checked(spark, str(tmp_path)).collect()))
    assert got == [("a", 0, 0, 0), ("b", 0, 0, 0)]
