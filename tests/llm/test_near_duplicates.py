import itertools
import random
import re

import numpy as np
import pytest

from driftnet.llm import near_duplicates as N


def _texts(n=60, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    out = {}
    for i in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(45, 160))]
        out[f"a{i:03d}"] = " ".join(base)
        edited = list(base)
        for _ in range(max(1, len(base) // 30)):
            edited[rng.randrange(len(edited))] = rng.choice(words)
        out[f"b{i:03d}"] = " ".join(edited).upper()
        if i % 7 == 0:
            out[f"c{i:03d}"] = " ".join(base) + " !"
    return out


def _brute(texts, threshold=N.THRESHOLD):
    sets = {k: set(N.shingles(t).tolist()) for k, t in texts.items() if t and N.shingles(t) is not None}
    pairs = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both / (len(sets[a]) + len(sets[b]) - both) >= threshold:
            pairs.add((a, b))
    return pairs


def test_pairs_equal_brute_force(spark):
    texts = _texts()
    rows = [(k, t, "x") for k, t in texts.items()] + [("n1", None, "x"), ("n2", "", "x"), (None, "one two three", "x"), ("short", "too few words", "x")]
    df = spark.createDataFrame(rows, "content_hash string, extracted_text string, rep string")
    got = {tuple(r[:2]) for r in N.similar_pairs(df, "content_hash", "extracted_text").collect()}
    assert got == _brute(texts)


def test_hot_cells_are_joined_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 7)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(30):
        edited = list(base)
        edited[rng.randrange(120)] = f"x{i}"
        texts[f"k{i:02d}"] = " ".join(edited)
    df = spark.createDataFrame(list(texts.items()), "content_hash string, extracted_text string")
    got = {tuple(r[:2]) for r in N.similar_pairs(df, "content_hash", "extracted_text").collect()}
    assert got == _brute(texts) and len(got) == 30 * 29 // 2


def _bounded(pts, parts):
    size = pts.sum(1).astype(int)
    pairs = itertools.combinations(range(len(pts)), 2)
    return {(i, j) for i, j in pairs if parts[i] == parts[j] and np.minimum(pts[i], pts[j]).sum() >= N.needed(size[i], size[j], 0.6) and min(size[i], size[j]) >= 0.6 * max(size[i], size[j])}


def test_forest_gives_what_the_bound_allows_and_each_pair_once():
    rng = np.random.default_rng(1)
    pts = rng.poisson(2, (300, N.GROUPS)).astype(np.uint32) * rng.integers(1, 70_000, (300, 1)).astype(np.uint32)  # counts beyond 16 bits
    pts[75:150] = pts[:75]
    pts[75:150, 0] += 1
    parts = rng.integers(0, 3, 300)
    parts[75:150] = parts[:75]
    forest = N.Forest(parts, np.arange(300), pts)
    found = [tuple(sorted(p)) for x, y in forest.pairs(0.6, 1 << 8) for p in zip(x.tolist(), y.tolist(), strict=True)]
    assert len(found) == len(set(found)) and set(found) == _bounded(pts.astype(np.int64), parts) and {(i, i + 75) for i in range(75)} <= set(found)
    assert forest.boxes() > 300 // N.FAN and len(forest.levels) == 4  # points, leaves, boxes of leaves, roots
    assert not list(N.Forest(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, N.GROUPS), np.uint32)).pairs(0.6))


def test_pairs_at_the_threshold_meet_often_enough(monkeypatch):
    """Whatever the order of the groups, and whether groups hold several runs or one."""
    rng = np.random.default_rng(7)
    seen = 0
    for k in range(400):
        monkeypatch.setattr(N, "MEET", 1 + k % 9)
        table = rng.integers(1, 5, 1 << N.SLOT).astype(np.int32) if k % 40 == 0 else table
        n, m = int(rng.integers(10, 90)), int(rng.integers(10, 90))
        both = -(-3 * (n + m) // 8)  # similarity 0.6
        if both > min(n, m):
            continue
        shared, a, b = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (both, n - both, m - both))
        if k % 2:
            shared[1::2] = shared[::2][: len(shared[1::2])] + np.uint64(1)  # the same fine group
        sets = [np.unique(np.concatenate([shared, own])) for own in (a, b)]
        size = np.array([len(x) for x in sets])
        filed = N.filings([N.filed_under(x, table, 0.6) for x in sets], [1, 2], table, 1.0, N.BLOCK)
        x, y = np.array([0]), np.array([1])
        asked = N.meetings(size[x], size[y], 0.6)[1]
        assert asked[0] >= 1 and N.met(filed, size, x, y, 0.6)[0] >= asked[0]
        before = [dict(zip((f & N._MASK).tolist(), (f >> N.FINE & (1 << 24) - 1).tolist(), strict=True)) for f in filed]
        assert any(N.reach(size[0], before[0][g], 0.6) >= size[1] and N.reach(size[1], before[1][g], 0.6) >= size[0] for g in before[0].keys() & before[1].keys())
        seen += 1
    assert seen > 100


def test_words_are_runs_of_letters_and_digits():
    texts = [" ".join(f"w{i} x_{i}" for i in range(30)), "Größe 12-3 naïve 給湯器 " * 12, "a" * 3000 + " b c " * 20, "\ud800 lone", "", "ŞİŞ " * 50]
    ours = list(N.sets_of(texts))
    for text, got in zip(texts, ours, strict=True):
        words = re.findall(r"[^\W_]+", text.lower())
        want = {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 40 else None
        assert (got is None) == (want is None) and (got is None or len(got) == len(want))
        assert got is None or np.array_equal(got, N.shingles(text))


def test_copies_and_repeated_keys(spark, monkeypatch):
    monkeypatch.setattr(N, "COPIES", 3)
    one, two = _texts(1)["a000"], _texts(2, seed=9)["a001"]
    rows = [(f"k{i}", one) for i in range(11)] + [("twice", one), ("twice", two), ("z", two)]
    df = spark.createDataFrame(rows, "content_hash string, extracted_text string")
    got = [tuple(r[:2]) for r in N.similar_pairs(df, "content_hash", "extracted_text").collect()]
    names = sorted([f"k{i}" for i in range(11)] + ["twice"])
    assert sorted(got) == sorted([*itertools.combinations(names, 2), ("twice", "z")])


def test_empty_table_and_classes(spark):
    empty = spark.createDataFrame([], "content_hash string, extracted_text string")
    assert N.similar_pairs(empty, "content_hash", "extracted_text").count() == 0
    pairs = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (5, 6, 1.0)], "a long, b long, similarity double")
    members = spark.createDataFrame([("p", 1), ("q", 2), ("r", 3), ("r2", 3), ("s", 4), ("t", 5), ("u", 6)], "id string, rep long")
    got = {r["id"]: (r["class_id"], r["links"]) for r in N.classes(pairs, members).collect()}
    assert got == {"p": ("p", 1), "q": ("p", 2), "r": ("p", 1), "r2": ("p", 1), "s": ("s", 0), "t": ("t", 1), "u": ("t", 1)}


def test_unfinished_classes_are_an_error(spark):
    order = random.Random(5).sample(range(30), 30)
    pairs = spark.createDataFrame(list(itertools.pairwise(order)), "a long, b long")
    members = spark.createDataFrame([(f"k{i:02d}", i) for i in order], "id string, rep long")
    assert {r["class_id"] for r in N.classes(pairs, members).collect()} == {"k00"}
    with pytest.raises(RuntimeError):
        N.classes(pairs, members, rounds=1)
