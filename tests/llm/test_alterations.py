"""Alterations of running words are counted exactly, against the word edit distance."""

import random

from calibmill.llm import leakage as k
from tests.llm.test_leakage import item


def leaked(words, text):
    reduced = k.reduce_text(text).encode()
    flat = [w.encode() for w in words]
    seeds = [(w, at) for w in range(len(words) - 4) for at in range(len(reduced)) if reduced.startswith(b"".join(flat[w : w + 5]), at)]
    return any(k.held(flat, reduced, k.word_bounds(text), w, at) for w, at in seeds)


def least_edits(words, doc):
    """The fewest alterations that make ``words`` of any stretch of ``doc``."""
    row = [0] * (len(doc) + 1)
    for w in words:
        new = [row[0] + 1]
        for j, d in enumerate(doc):
            new.append(min(row[j] + (w != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_near_and_long_alterations():
    one, t = item(1), " ".join
    noise = "some other thing here now " * 8
    for a, b in ((6, 8), (5, 7), (7, 9), (6, 7)):
        words = list(one[:16])
        words[a], words[b] = "zzyx", "xyzz"
        assert leaked(one, noise + t(words) + " " + noise)
    long = [*one[:7], "z" * 30, *one[8:15]]
    assert leaked(one, noise + t(long) + " " + noise)
    assert not leaked(one, noise + t([*one[:7], "zz", "yy", *one[8:14]]) + " " + noise)
    assert not leaked(one, noise + t([*one[:7], "a", "b", *one[8:15]]) + " " + noise)  # two short words for one
    assert leaked(one, noise + "".join([*one[:7], "z" * 13, *one[8:15]]) + noise)  # glued
    assert leaked(one, noise + " ".join(t([*one[:7], "zzyxzzyx", *one[8:15]]).replace(" ", "")) + " " + noise)  # spaced out


def test_against_edit_distance():
    rng = random.Random(11)
    yes = 0
    for _ in range(150):
        one = item(rng.randrange(1000), 32)
        n = rng.randrange(13, 26)
        doc = list(one[3 : 3 + n])
        for _ in range(rng.randrange(4)):
            at = rng.randrange(2, len(doc) - 2)
            doc[at : at + rng.randrange(2)] = rng.choice(([], ["q" * rng.randrange(1, 30)]))
        doc = ["xx", "yy", *doc, "yy", "xx"]
        want = any(least_edits(one[a:b], doc) <= (b - a) // 8 for a in range(32) for b in range(a + 15, 33))
        assert leaked(one, " ".join(doc)) == want
        yes += want
    assert 30 < yes < 140
