import random

import pytest

from tidemark.llm import splitting

SCHEMA = "doc_id long, text string, n int, pos string, chunk string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "clash", "x") for i, t in enumerate(texts)], SCHEMA)


def samples():
    r = random.Random(8)
    words = ["alpha", "beta,", "don't", "x1", "1234567", "ümlaut", "日本語。", "--", "🚀", "e", "\t", " "]
    prose = "".join(r.choice(words) + r.choice([" ", " ", " ", ". ", "\n", "\n\n", "  ", "", ", "]) for _ in range(4000))
    return ["", None, "short", "word " * 2500, "a" * 9000, "日本語の文章" * 900, " " * 6000, "x\n" * 2500, "|".join(str(i) for i in range(3000)), prose, "。" * 3000, "word " * 1024, "'s" * 3000, prose[:300] + "z" * 7000 + prose[300:900]]


@pytest.mark.parametrize("size", [700, 5000, splitting.RANGE])
def test_counts_are_those_of_whole_texts(spark, enc, size):
    t = samples()
    got = {r.doc_id: r.n_tokens for r in splitting.token_totals(frame(spark, t), size=size).collect()}
    want = {i: n for i, x in enumerate(t) if (n := len(enc.encode_ordinary(x or ""))) > splitting.LIMIT}
    assert got == want


@pytest.mark.parametrize("size", [700, 5000, splitting.RANGE])
def test_pieces_give_the_text_back(spark, enc, size):
    t = samples()
    by = {}
    for r in splitting.split(frame(spark, t), size=size).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {i for i, x in enumerate(t) if len(enc.encode_ordinary(x or "")) > splitting.LIMIT}
    for i, rows in by.items():
        rows.sort(key=lambda r: r.piece_no)
        assert [r.piece_no for r in rows] == list(range(len(rows))) and rows[0].start == 0 and rows[-1].end == len(t[i])
        for r in rows:
            assert r.text == t[i][r.start : r.end] and r.n_tokens == len(enc.encode_ordinary(r.text)) <= splitting.LIMIT
        for a, b in zip(rows, rows[1:]):
            assert a.start < b.start <= a.end < b.end
            assert len(enc.encode_ordinary(t[i][b.start : a.end])) <= 2 * splitting.OVERLAP


def test_cuts_prefer_natural_boundaries(spark, enc):
    text = "\n\n".join(" ".join(f"word{j}" for j in range(9)) + "." for _ in range(120))
    rows = splitting.split(frame(spark, [text])).collect()
    assert all(text[r.end : r.end + 2] == "\n\n" for r in rows if r.end < len(text))


@pytest.mark.parametrize("size", [700, 5000])
def test_files_by_byte_ranges(spark, enc, size, tmp_path):
    """The same from files that are read by offset; characters reach over the edges of ranges."""
    t = [x for x in samples() if x]
    for i, x in enumerate(t):
        (tmp_path / f"{i}.txt").write_bytes(x.encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    by = {}
    for r in splitting.split_files(spark, f"{tmp_path}/*.txt", size=size).collect():
        by.setdefault(int(r.doc_id.split("/")[-1][:-4]), []).append(r)
    assert set(by) == {i for i, x in enumerate(t) if len(enc.encode_ordinary(x)) > splitting.LIMIT}
    for i, rows in by.items():
        rows.sort(key=lambda r: r.piece_no)
        assert [r.piece_no for r in rows] == list(range(len(rows))) and rows[0].start == 0 and rows[-1].end == len(t[i])
        assert all(r.text == t[i][r.start : r.end] and r.n_tokens == len(enc.encode_ordinary(r.text)) <= splitting.LIMIT for r in rows)
        assert all(a.start < b.start <= a.end < b.end for a, b in zip(rows, rows[1:]))


def test_ranges_take_time_in_proportion_to_the_text(spark):
    import time

    took = []
    for n in (1, 1, 8):  # the first run warms up
        df = frame(spark, ["word " * 800_000 * n])
        at = time.perf_counter()
        assert splitting.text_ranges(df, 1024, "doc_id", "text", splitting.RANGE).count() == -(-4_000_000 * n // splitting.RANGE)
        took.append(time.perf_counter() - at)
    assert took[2] < 16 * took[1]


def test_empty(spark, enc):
    assert splitting.split(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        splitting.split(frame(spark, []), limit=100)
