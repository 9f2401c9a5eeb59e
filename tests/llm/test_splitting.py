import random

from hypothesis import given, settings
from hypothesis import strategies as st

from driftnet.llm import splitting as S


def _check(text, pieces, limit, overlap):
    assert pieces[0][1] == 0 and pieces[-1][2] == len(text)
    for (n1, _, e1), (n2, s2, e2) in zip(pieces, pieces[1:], strict=False):
        assert n2 == n1 + 1 and s2 == e1 - overlap and e2 > e1
    assert all(0 < e - s <= limit for _, s, e in pieces)


def _cut(raw, limit, overlap, step):
    """(pieces, their texts) by ranges of ``step`` bytes, as the two passes over ranges make them."""
    left, right = S._halos(limit, overlap)
    ranges, tables = [], []
    for no, lo in enumerate(range(0, len(raw), step)):
        since, upto = max(0, lo - left), min(lo + step, len(raw))
        ranges.append(S.Range(raw[since : upto + right], lo - since, upto - lo, upto + right >= len(raw), limit, overlap))
        tables.append(S.exit_table("k", no, ranges[-1]))
    out, base, piece, end = [], 0, 1, S.END
    for no, (r, (_, _, n, first, exits, steps)) in enumerate(zip(ranges, tables, strict=True)):
        ends, count = S.np.frombuffer(exits, S.np.int32), S.np.frombuffer(steps, S.np.int32)
        end = first if no == 0 else end
        inside = end != S.END and end < n
        out += list(S._pieces("k", no, r, base, end if inside else None, piece))
        base += n
        if no == 0 and end != S.END:
            end, piece = int(ends[0]), piece + int(count[0])
        elif inside:
            end, piece = (int(ends[end]), piece + int(count[end])) if len(ends) else (S.END, piece)
        elif end != S.END:
            end -= n
    return [x[1:4] for x in out], [x[5] for x in out]


def _plain(text, limit, overlap):
    """The same rule, walked over the whole text."""
    ats = S.boundaries(S.np.frombuffer(text.encode("utf-32-le"), S.np.uint32))
    out, start = [], 0
    while len(text) - start > limit:
        inside = next((x for at in ats if len(x := at[(at > start + limit // 2) & (at <= start + limit)])), [start + limit])
        out.append((len(out), start, int(inside[-1])))
        start = out[-1][2] - overlap
    return [*out, (len(out), start, len(text))]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n!é。👍\"\r", min_size=1, max_size=700), st.integers(20, 90), st.integers(0, 9), st.integers(8, 200))
def test_ranges_give_the_pieces_of_the_whole_text(text, limit, overlap, step):
    pieces, texts = _cut(text.encode(), limit, overlap, step)
    _check(text, pieces, limit, overlap)
    assert pieces == _plain(text, limit, overlap) and texts == [text[s:e] for _, s, e in pieces]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"ab ", "é".encode(), "👍".encode(), b"\x80", b"\xff", b"\xc3", b"\xe2\x82", b"\xf0\x9f\x91", b".\n", b"\xed\xa0\x80"]), min_size=1, max_size=200), st.integers(8, 60))
def test_bytes_that_are_not_utf8(parts, step):
    raw = b"".join(parts)
    text = raw.decode("utf-8", "replace")
    pieces, texts = _cut(raw, 40, 7, step)
    assert pieces == _plain(text, 40, 7) and texts == [text[s:e] for _, s, e in pieces]


def test_blank_lines_over_range_edges():
    text = "word " * 20 + "\n" + " " * 200 + "\n" + "next " * 40
    for step in (37, 64, 101, 230):
        assert _cut(text.encode(), 400, 20, step)[0] == _plain(text, 400, 20)
    assert _plain(text, 400, 20)[0][2] == text.index("next")
    long = "word " * 20 + "\n" + " " * 300 + "\n" + "next " * 40  # more than BLANKS: a line end, wherever the ranges fall
    assert all(_cut(long.encode(), 500, 20, step)[0] == _plain(long, 500, 20) for step in (37, 230, 5000))


def test_natural_boundaries_win():
    text = "word " * 30 + "End.\n\n" + "next " * 40
    assert _plain(text, 200, 20)[0][2] == text.index("\n\n") + 2
    assert _plain("x" * 500, 200, 20)[0][2] == 200
    # the last line end within the limit counts, though another follows soon behind it
    assert _plain("a" * 150 + "\n" + "b" * 55 + "\n" + "c" * 300, 200, 20)[0][2] == 151


def test_texts(spark):
    rng = random.Random(6)
    big = "".join(rng.choice(["word ", "Ende.\n", "\n\n", "日本。", "x"]) for _ in range(30_000))
    rows = [("a", big), ("a", big), ("b", "short"), ("c", None), (None, big), ("d", "y" * 8000), ("e", "y" * 8001), ("f", "é" * 8000)]
    df = spark.createDataFrame(rows, "content_hash string, extracted_text string").withColumn("piece", S.F.lit(3)).withColumn("raw", S.F.lit(3))
    got = S.split_texts(df, "content_hash", "extracted_text", 8000, 200, range_bytes=20_000).orderBy("id", "piece").collect()
    assert {r["id"] for r in got} == {"a", "e"} == {r["id"] for r in S.oversized(df, "content_hash", "extracted_text", 8000, 200).collect()}
    own = [r for r in got if r["id"] == "a"]
    _check(big, [(r["piece"], r["start"], r["end"]) for r in own], 8000, 200)
    assert all(r["text"] == big[r["start"] : r["end"]] and r["chars"] == len(r["text"]) for r in own)
    assert [(r["piece"], r["start"], r["end"]) for r in own] == _plain(big, 8000, 200)
    assert S.split_texts(df.limit(0), "content_hash", "extracted_text", 8000, 200).count() == 0


def test_files(spark, tmp_path):
    rng = random.Random(7)
    raw = b"".join(rng.choice(["wört ".encode(), b"End.\n", b"\n\n", "日本。".encode(), b"x", "👍".encode(), b"\xff\xfe", b"\xe2\x82"]) for _ in range(20_000))
    (tmp_path / "a.txt").write_bytes(raw)
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "c.txt").write_text("within")
    text = raw.decode("utf-8", "replace")
    paths = [str(tmp_path / "a.txt"), str(tmp_path / "b.txt"), "file://" + str(tmp_path / "c.txt")]
    got = S.split_files(spark, paths, 5000, 100, range_bytes=7001).orderBy("id", "piece").collect()
    own = [r for r in got if r["id"] == paths[0]]
    assert [(r["piece"], r["start"], r["end"]) for r in own] == _plain(text, 5000, 100)
    assert all(r["text"] == text[r["start"] : r["end"]] for r in own)
    assert [r["text"] for r in got if r["id"] != paths[0]] == ["within"]
    assert S.split_files(spark, [paths[1]], 5000, 100).count() == 0
