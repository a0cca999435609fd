from hypothesis import given, settings
from hypothesis import strategies as st

from stratagraph.llm import splitting

TEXT = st.lists(st.sampled_from(["\n", "\n\n", "\r\n", " \t\n", "a", "bc ", "é🙂", "w" * 9, "xy z\n"]), max_size=120).map("".join)
C = "chunk_id string, text string, indexed_at timestamp_ntz, piece_no string"


def brute(text, limit, overlap):
    blocks, at, open_ = [], 0, None
    for i, line in enumerate(text.split("\n")):
        if not line.strip(" \t\r"):
            open_ = None
        elif open_ is None:
            open_ = [at, at + len(line.removesuffix("\r")), i + 1]
            blocks.append(open_)
        else:
            open_[1] = at + len(line.removesuffix("\r"))
        at += len(line) + 1
    size = lambda b: b[1] - b[0]
    return [b[2] for a, b in zip(blocks, blocks[1:], strict=False) if size(a) <= limit - overlap and size(b) <= limit - overlap and b[1] - a[0] > limit]


@given(TEXT, st.integers(8, 40), st.integers(0, 7))
@settings(max_examples=500, deadline=None)
def test_pieces(text, limit, overlap):
    pieces = splitting.split(text, limit, overlap)
    if not text:
        assert pieces == []
        return
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(0 < e - s <= limit for s, e in pieces)
    for (_, end), (start, later) in zip(pieces, pieces[1:], strict=False):
        assert end - overlap <= start <= end < later
    if len(text) > limit:
        assert splitting.unavoidable(text, pieces, limit, overlap) == brute(text, limit, overlap)


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.data())
@settings(max_examples=200, deadline=None)
def test_range_maximum(values, data):
    import numpy as np

    lo = data.draw(st.integers(0, len(values) - 1))
    hi = data.draw(st.integers(lo, len(values) - 1))
    part = values[lo : hi + 1]
    assert splitting.RangeMaximum(np.array(values), 60).best(lo, hi) == lo + max(i for i, v in enumerate(part) if v == max(part))
    assert splitting.RangeMaximum(np.array(values), 60, leftmost=True).best(lo, hi) == lo + part.index(max(part))


def test_tiles_change_nothing(monkeypatch):
    import random

    r = random.Random(1)
    text = "".join(r.choice(["\n", "\n\n", "word ", "x" * 40]) for _ in range(3000))
    whole = splitting.split(text, 200, 30)
    monkeypatch.setattr(splitting, "TILE", 50)
    assert splitting.split(text, 200, 30) == whole


def test_tables(spark):
    import datetime

    t = datetime.datetime(2024, 1, 1)
    long = "a" * 1000 + "\n\n" + "b" * 1000
    data = [("x", "short", t, "c"), ("x", long, t + datetime.timedelta(1), "c"), ("x", long, t + datetime.timedelta(1), "c"), ("y", long, t, "c"), ("y", "now short", t + datetime.timedelta(1), "c"), ("z", None, t, "c"), (None, long, t, "c"), ("e", "", t, "c"), ("n", long, None, "c"), ("v", "q" * 400_000, t, "c")]
    df = spark.createDataFrame(data, C)
    assert sorted(map(tuple, splitting.unavoidable_cuts(df).collect())) == [("n", 3), ("x", 3)]
    pieces = splitting.pieces(df).orderBy("chunk_id", "piece_no").collect()
    x = [p for p in pieces if p["chunk_id"] == "x"]
    assert [(p["start_line"], p["end_line"], len(p["text"])) for p in x] == [(1, 2, 1002), (3, 3, 1000)] or sum(len(p["text"]) for p in x) >= len(long)
    v = [p for p in pieces if p["chunk_id"] == "v"]
    assert v[-1]["end_char"] == 400_000 and all(len(p["text"]) <= 1500 for p in v)
    assert splitting.pieces(df.limit(0)).count() == 0
