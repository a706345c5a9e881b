"""Seeds shorter than a head and longer than 64 bytes are found wherever they stand."""

import random

from calibmill.llm import leakage as k


def occurrences(words, texts):
    """The rows of a search for one item in these texts as one shard."""
    return {row[1] for row in k._search(k.Queries([k.Test(1, " ".join(words))]), list(range(len(texts))), [k.reduce_text(t).encode() for t in texts], texts)}


def test_short_seeds():
    rng = random.Random(2)
    words = [rng.choice("abcdefgh") for _ in range(20)]
    texts = ["zz " + " ".join(words) + " zz zz zz zz", "zz zz", " ".join(words)]
    # altered at the ends, so that only seeds with other text behind them are left
    texts.append("q " + " ".join([*words[:14], "zzz", "zzzz", "zzzzz"]))
    assert occurrences(words, texts) == {0, 2, 3}
    few = k.Queries([k.Test(1, "a b c d e")])
    heads = k._heads(k.np.frombuffer(b"xxabcdeyyyyabcde" + b"\0" * 24, dtype=k.np.uint8))
    assert few.starting(heads).tolist() == [2, 11]


def test_long_seeds():
    rng = random.Random(4)
    head = ["w" * 40, "v" * 40]
    words = [*head, *("".join(rng.choices("abcd", k=20)) for _ in range(14))]
    # many suffixes that share 64 bytes and more with the seed and differ behind, in falling order
    texts = [" ".join([*head, *("".join(rng.choices("abcd", k=20)) for _ in range(14))]) for _ in range(40)]
    texts.insert(20, " ".join(words))
    queries = k.Queries([k.Test(1, " ".join(words))])
    assert queries.depth == 144
    flat = b"\0".join(t.replace(" ", "").encode() for t in texts) + b"\0" * (queries.depth + 16)
    data = k.np.frombuffer(flat, dtype=k.np.uint8)
    at = queries.starting(k._heads(data))
    array = k.suffix_array(data, at, k._heads(data)[at], queries.depth)
    assert [flat[i : i + 144] for i in array] == sorted(flat[i : i + 144] for i in at)
    low, high = k._bisect(flat, array, 0, len(array), queries.seeds[0])
    assert high - low == flat.count(queries.seeds[0]) == 1
    assert occurrences(words, texts) == {20}
