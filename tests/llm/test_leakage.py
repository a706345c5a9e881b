"""Leaks: planted passages, decoys, suffix arrays against sorting, matches against brute force."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from calibmill.llm import leakage as k

WORDS = [a + b + c for a in ("ka", "lo", "mi", "ru", "te") for b in ("ban", "dor", "fel", "gim", "hus") for c in ("a", "en", "ost", "ur")]


def item(seed, n=60):
    return random.Random(seed).sample(WORDS, n)


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, eval_id string")
    e = spark.createDataFrame(items, "eval_id bigint, text string, doc_id int")
    return k.leaks(d, e, **more)


def alter(words, every, how):
    out = []
    for i, w in enumerate(words):
        if i % every == every // 2:
            out += {"change": ["zzyx"], "drop": [], "add": ["zzyx", w]}[how]
        else:
            out.append(w)
    return out


def test_planted(spark):
    one, two = item(1), item(2)
    items = [(1, " ".join(one), 0), (2, " ".join(two), 0), (3, None, 0), (4, "too short", 0), (5, "", 0)]
    noise = " ".join(random.Random(9).choices(["some", "other", "thing", "here", "now"], k=300))
    t = " ".join
    docs = {
        1: noise + " " + t(one[10:25]) + " " + noise,
        2: t(alter(one, 9, "change")),
        3: t(alter(two[:40], 9, "drop")) + noise,
        4: noise + t(alter(two[:40], 9, "add")),
        5: t(one[5:30]).upper().replace(" ", "  ,\n"),
        6: t(one[5:30]).replace(" ", ""),
        7: "<p>" + t(f"<b>{w}</b>" if i % 3 else w for i, w in enumerate(one[:20])) + "</p>",
        8: "​".join(t(one[5:25])),
        9: t(one[5:25]).replace("a", "á").replace("e", "ｅ").replace("o", "о"),
        10: t(one[:16]) + " stop " + t(two[20:40]),
        11: t(alter(one[20:35], 15, "change")),
    }
    decoys = {20: noise, 21: t(one[:8]) + noise, 22: t(random.Random(4).sample(one, 60)), 23: t(alter(one, 4, "change")), 24: None, 25: "", 26: t(one[10:22]) + noise, 27: "x" * 200_000}
    rows = [(i, x, "c") for i, x in (docs | decoys).items()] + [(1, docs[1], "c")]
    want = {(1, 1), (1, 2), (2, 3), (2, 4), (1, 5), (1, 6), (1, 7), (1, 8), (1, 9), (1, 10), (2, 10), (1, 11)}
    for size in (4 << 20, 200):
        got = found(spark, rows, items, shard_bytes=size).collect()
        assert {(r.eval_id, r.doc_id) for r in got} == want
    assert {(r.eval_id, r.doc_id) for r in found(spark, rows, items, block_bytes=1).collect()} == want
    match = next(r for r in got if r.doc_id == 10 and r.eval_id == 1)
    assert (match.eval_word, match.doc_byte, match.match_bytes, match.words_held) == (0, 0, len("".join(one[:16])), 16)
    left = k.without_leaks(spark.createDataFrame(rows, "doc_id bigint, text string, eval_id string"), spark.createDataFrame([(1, 2)], "eval_id bigint, doc_id bigint"))
    assert {r.doc_id for r in left.collect()} == (docs | decoys).keys() - {2}


def test_odd_tables(spark):
    assert found(spark, [], [(1, " ".join(item(1)), 0)]).count() == 0
    assert found(spark, [(1, " ".join(item(1)), "c")], []).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text("ab", min_size=1, max_size=120), st.integers(0, 3))
def test_suffix_array_is_sorted(text, step):
    flat = text.encode() + b"\0" * 80
    data = np.frombuffer(flat, dtype=np.uint8)
    at = np.arange(0, len(text), step + 1)
    heads = k._heads(data)
    array = k.suffix_array(data, at, heads[at]).tolist()
    assert sorted(array) == at.tolist()
    assert [flat[i : i + 64] for i in array] == sorted(flat[i : i + 64] for i in at.tolist())


def test_longest_matches_against_brute_force(spark):
    rng = random.Random(5)
    one = item(7, 40)
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(5))) + " " + " ".join(one[a : a + rng.randrange(5, 30)]), "c") for i, a in enumerate(rng.choices(range(20), k=60))]
    got = {r.doc_id: r.match_bytes for r in found(spark, docs, [(1, " ".join(one), 0)]).collect()}
    for i, text, _ in docs:
        flat, best = k.reduce_text(text), 0
        for w in range(len(one) - 4):
            own = "".join(one[w:])
            n = len("".join(one[w : w + 5]))
            while n <= len(own) and own[:n] in flat:
                best, n = max(best, n), n + 1
        held = max((n for a in range(40) for n in range(14, 41 - a) if "".join(one[a : a + n]) in flat), default=0)
        # 14 verbatim words are 15 running ones with one altered
        assert (i in got) == (held >= 14) and (i not in got or got[i] == best)


def test_reduced():
    assert k.reduce_text("Ａ <b>Café</b>&nbsp;[x](http://y.z) ß­-​Q") == "acafexssq"
