"""Splitting: limits, overlaps, whole characters, boundaries, round trips."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from calibmill.llm import splitting as s

BUDGETS = "budget_id int, task string, max_tokens int, overlap_tokens int, text string"


def check(text, limit, overlap):
    data, pieces = text.encode(), s.split_text(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(data)
    whole = b""
    for i, (a, b, _) in enumerate(pieces):
        assert a < b <= a + limit
        data[a:b].decode()  # no cut inside a character
        if i:
            shared = pieces[i - 1][1] - a
            assert overlap <= shared <= overlap + 3 and b > pieces[i - 1][1]
            whole += data[pieces[i - 1][1] : b]
        else:
            whole = data[a:b]
    assert whole == data
    return pieces


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab .\n,é漢。👩́"), min_size=1, max_size=400), st.integers(16, 80), st.integers(0, 8))
def test_any_text(text, limit, overlap):
    if len(text.encode()) > limit:
        check(text, limit, overlap)


def test_cuts_at_the_strongest_boundary_nearby():
    text = ("word " * 30 + "end. ") * 3 + "\n\n" + ("word " * 30 + "end. ") * 3
    pieces = check(text, 600, 0)
    assert [x for *_, x in pieces][:-1] == [s.PARAGRAPH] and len(pieces) == 2
    pieces = check("One two three. " * 100, 200, 20)
    assert {x for *_, x in pieces[:-1]} == {s.SENTENCE}


def test_long_runs_without_boundaries():
    pieces = check("x" * 5000, 1024, 64)
    assert {x for *_, x in pieces[:-1]} == {s.CHARACTER} and len(pieces) == 1 + -(-(5000 - 1024) // (1024 - 64 - 3))
    check("漢字" * 2000, 1000, 100)
    # narrow room against wide characters: no limit on the pieces added
    assert len(check("👩" * 300, 9, 1)) > 150
    text = "ab " * 30 + "x" * 400 + " cd" * 30 + "y" * 90 + " ef" * 50
    layout = s.Layout(text)
    assert layout.unavoidable(100, 10) == 5 and sum(x == s.CHARACTER for *_, x in check(text, 100, 10)) == 5
    # a mark may be far from its letter
    assert check("e" + "\u0301" * 3000 + "f", 1024, 10)
    pieces = check("これは箱です。" * 200, 300, 30)
    assert {x for *_, x in pieces[:-1]} == {s.SENTENCE}
    check("a " + "y" * 900 + " b" * 500, 512, 32)


def test_balanced():
    lengths = [b - a for a, b, _ in check("wo rd " * 1000, 1024, 64)]
    assert max(lengths) - min(lengths) < 200


def test_parameters():
    assert s.split_text("short", 100, 10) == [(0, 5, s.PARAGRAPH)]
    for limit, overlap in ((100, 99), (4, 0), (100, -1)):
        with pytest.raises(ValueError):
            s.split_text("x" * 200, limit, overlap)


def test_documents(spark):
    budgets = spark.createDataFrame([(1, "pack", 50, 0, "c"), (3, "split", 100, 10, "c"), (4, "split", 300, None, "c"), (5, "split", None, 1, "c")], BUDGETS)
    rows = [(1, None, 7), (2, "", 7), (3, "   ", 7), (4, "word " * 20, 7), (5, "word " * 21, 7), (6, "é" * 200, 7), (7, "word " * 21, 7), (8, "a. " * 100_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, budget_id int")
    assert {tuple(r) for r in s.found_split(docs, budgets).collect()} == {(3, 5), (3, 6), (3, 7), (3, 8), (4, 6), (4, 8)}
    pieces = [r for r in s.split_documents(docs, budgets).collect() if r.doc_id == 8 and r.budget_id == 3]
    assert max(r.n_tokens for r in pieces) <= 100 and pieces[-1].end_byte == 300_000 and [r.piece for r in pieces] == list(range(pieces[0].pieces))
    assert s.found_split(docs.limit(0), budgets).count() == 0 and s.found_split(docs, budgets.limit(0)).count() == 0
