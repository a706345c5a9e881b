"""Packing: bounds against exact optima, best fit against a plain version, whole tables placed once."""

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from calibmill.llm import packing as p

BUDGETS = "budget_id int, task string, max_tokens int, overlap_tokens int, doc_id int"


def optimum(sizes, capacity):
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i] and rooms[k] not in rooms[:k]:
                place(i + 1, rooms[:k] + [rooms[k] - sizes[i]] + rooms[k + 1 :])
        place(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


def plain_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms[rooms.index(min(fits))] -= s
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_and_best_fit(sizes):
    best, bound = optimum(sizes, 20), p.lower_bound(np.array(sizes), 20)
    assert bound <= best
    bins = p.best_fit_decreasing(np.array(sizes), 20)
    filled = np.bincount(bins, weights=sizes)
    assert filled.max() <= 20 and best <= len(filled)
    assert sorted(20 - f for f in filled) == plain_best_fit(sizes, 20)


def test_bound_sees_more_than_the_sum():
    assert p.lower_bound(np.array([11] * 10), 20) == 10 and p.lower_bound(np.array([7] * 6), 20) == 3 and p.lower_bound(np.array([], dtype=int), 20) == 0


def test_cut_oversized():
    data = ("é漢x👩" * 50).encode()
    parts = p.cut_oversized(data, 64)
    assert b"".join(data[a:b] for a, b in parts) == data and all(0 < b - a <= 64 for a, b in parts)
    [data[a:b].decode() for a, b in parts]


def placed_once(rows, texts, capacity):
    per = defaultdict(list)
    for r in rows:
        per[r.container].append(r)
    for items in per.values():
        assert sum(r.size for r in items) <= capacity and sorted(r.place for r in items) == list(range(len(items)))
        at = 0
        for r in sorted(items, key=lambda r: r.place):
            assert r.offset == at
            at += r.size
    seen = defaultdict(list)
    for r in rows:
        seen[r.doc_id].append((r.start_byte, r.size))
    assert seen.keys() == texts.keys()
    for k, parts in seen.items():
        data = texts[k].encode()
        assert sorted(parts)[0][0] == 0 and sum(s for _, s in parts) == len(data)
        assert len(parts) == 1 if len(data) <= capacity else len(parts) > 1
    return len(per)


def test_documents(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "x" * int(n), 3) for i, n in enumerate(rng.integers(0, 120, 600))] + [(1000, None, 3), (1001, "", 3), (1002, "漢" * 100, 3), (1003, "y" * 5000, 3)]
    budgets = spark.createDataFrame([(1, "pack", 100, 0, 9), (2, "pack", 256, 0, 9), (3, "split", 10, 0, 9)], BUDGETS)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, budget_id int")
    texts = {k: t for k, t, _ in rows if t is not None}
    for group in (50_000, 40):
        got = p.pack(docs, budgets, group).collect()
        assert {r.budget_id for r in got} == {1, 2}
        for budget, capacity in ((1, 100), (2, 256)):
            used = placed_once([r for r in got if r.budget_id == budget], texts, capacity)
            total = sum(len(t.encode()) for t in texts.values())
            assert used <= 1.12 * total / capacity + 1 if group == 50_000 else used <= 1.2 * total / capacity + 2
    report = {r.budget_id: r for r in p.report(p.pack(docs, budgets), budgets).collect()}
    assert report[2].left_over < 0.02 and report[2].n_containers >= report[2].least_containers


def test_odd_tables(spark):
    budgets = spark.createDataFrame([(1, "pack", 100, 0, 9)], BUDGETS)
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert [(r.doc_id, r.size, r.place) for r in p.pack(docs, budgets).collect()] == [(2, 0, 0)]
    assert p.pack(docs.limit(0), budgets).count() == 0 and p.pack(docs, budgets.limit(0)).count() == 0


def test_small_capacities_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    with pytest.raises(ValueError, match="four bytes"):
        p.items(docs, spark.createDataFrame([(1, "pack", 3, None, 0)], BUDGETS))
    assert p.items(docs, spark.createDataFrame([(1, "pack", None, None, 0), (None, None, 3, None, 0)], BUDGETS)).count() == 0


def test_certificates(spark):
    docs = spark.createDataFrame([(i, "x" * (11 if i < 10 else 9)) for i in range(20)], "doc_id bigint, text string")
    budgets = spark.createDataFrame([(1, "pack", 20, None, 0), (2, "pack", 21, None, 0)], BUDGETS)
    packed = p.pack(docs, budgets)
    got = {r.budget_id: r for r in p.report(packed, budgets).collect()}
    assert (got[1].n_containers, got[1].bound, got[1].gap, got[1].left_over) == (10, 10, 0, 0.0) and got[2].gap == 0
    assert p.lower_bound(np.array([9, 11]), 20, np.array([10, 10])) == p.lower_bound(np.array([9, 11] * 10), 20) == 10
    audit = {r.budget_id: tuple(r)[1:] for r in p.audit(packed, docs, budgets).collect()}
    assert audit == {b: (20, 200, 0, 0, 0, 0) for b in (1, 2)}
    broken = packed.unionByName(packed.where("doc_id = 3 and budget_id = 1")).where("not (doc_id = 15 and budget_id = 2)")
    bad = {r.budget_id: r for r in p.audit(broken, docs, budgets).collect()}
    assert bad[1].twice == 1 and bad[1].over_capacity == 1 and bad[1].gaps == 1 and bad[2].documents == 19
