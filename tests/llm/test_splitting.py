import re

from hypothesis import given, settings
from hypothesis import strategies as st

from evtide.llm import splitting as S

PART = st.sampled_from(["a", "bb", " ", ". ", "\n\n", " ", "x" * 40, "x" * 55, "x" * 59, "x" * 60, "x" * 61, "x" * 130])


@settings(max_examples=400, deadline=None)
@given(st.lists(PART, max_size=60).map("".join))
def test_pieces_cover_the_text(text):
    pieces = S.split(text, 60, 10, 3)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b, _ in pieces:
        assert b - a <= 60
    for (a, b, s), (c, d, _) in zip(pieces, pieces[1:]):
        assert a < c <= b < d and b - c <= 10
        assert s == S.NONE or text[b - 1].isspace() or text[b].isspace() or text[b - 1] in ".!?"
    assert any(s == S.NONE for *_, s in pieces) == bool(re.search(r"\S{61}", text))


@settings(max_examples=400, deadline=None)
@given(st.lists(PART, max_size=60).map("".join))
def test_overlap_is_kept(text):
    limit, overlap, slack = 60, 10, 3
    cut = S.strengths(text)
    pieces = S.split(text, limit, overlap, slack)
    for (a, b, _), (c, _, _) in zip(pieces, pieces[1:]):
        least = min(overlap - slack, b - a - 1)
        ahead = next((i for i in range(b + 1, len(text)) if cut[i] != S.NONE), len(text)) - b
        if cut[b] != S.NONE and ahead <= limit:  # a stretch that fits a piece goes before the overlap
            least = min(least, limit - ahead - slack)
        assert b - c >= least


def test_overlap_in_long_stretches():
    pieces = S.split("word " * 1000 + "x" * 20000)
    assert pieces[0][1] == 5000 and all(S.OVERLAP - S.SLACK <= b - c <= S.OVERLAP for (_, b, _), (c, _, _) in zip(pieces, pieces[1:]))
    fits = S.split("word " * 1000 + "x" * 5500 + " " + "word " * 1000)
    assert fits[0][1] == 5000 and 400 <= 5000 - fits[1][0] <= 500 and all(s != S.NONE for *_, s in fits)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=70), st.data())
def test_range_maximum(values, data):
    import numpy as np

    low = data.draw(st.integers(0, len(values) - 1))
    high = data.draw(st.integers(low + 1, len(values)))
    at, value = S.RightmostMax(np.array(values))(low, high)
    assert value == max(values[low:high]) and at == max(i for i in range(low, high) if values[i] == value)


def test_prefers_paragraphs_and_overlaps():
    text = "word " * 800 + "\n\n" + "word " * 2000
    pieces = S.split(text)
    assert pieces[0][1] == 4002 and pieces[0][2] == S.PARAGRAPH
    assert S.OVERLAP - S.SLACK <= pieces[0][1] - pieces[1][0] <= S.OVERLAP
    assert text[pieces[1][0] :].startswith("word")


def test_whole_table(spark):
    rows = [("a", "x" * 7000, 1), ("b", "y " * 3500, 2), ("c", "short", 3), ("d", None, 4), ("e", "", 5), ("b", "y " * 3500, 6), ("f", "z" * 6000, 7)]
    got = S.split_long(spark.createDataFrame(rows, "k string, body string, start int"), "k", "body").toPandas()
    assert set(got["id"]) == {"a", "b"}
    assert got[got["id"] == "a"]["strength"].min() == S.NONE and got[got["id"] == "b"]["strength"].min() > S.NONE
    assert (got["piece_text"].str.len() == got["stop"] - got["start"]).all()
    assert S.split_long(spark.createDataFrame([], "k string, body string"), "k", "body").count() == 0


def test_white_space_takes_linear_time():
    import time

    began = time.time()
    S.strengths("word" + " " * 400_000 + "\n" + " " * 400_000 + "word")
    assert time.time() - began < 5
    for text, want in (("a \n \t\n b", S.PARAGRAPH), ("a\n b", S.WORD), ("a\f b", S.PARAGRAPH), ("a. \u2029b", S.PARAGRAPH), ("a. b", S.SENTENCE)):
        assert S.strengths(text)[text.index("b")] == want
