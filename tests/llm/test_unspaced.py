"""Scripts written without spaces: leaks are found by their characters, pieces end between them."""

import numpy as np

from calibmill.llm import leakage, splitting

ITEM = "量子处理器的校准数据每天都会变化因此需要保存完整的历史记录以便比较"


def search(item, *texts):
    queries = leakage.Queries([leakage.Test(1, item)])
    return {row[1]: row[5:] for row in leakage._search(queries, list(range(len(texts))), [leakage.reduce_text(t).encode() for t in texts], list(texts))}


def test_leaks_without_spaces():
    assert leakage.cut_words("x1 量子ab 保") == ["x1", "量", "子", "ab", "保"]
    altered = ITEM[:9] + "新" + ITEM[10:20]
    shuffled = "".join(np.random.default_rng(1).permutation(list(ITEM)))
    found = search(ITEM, f"开头。{ITEM[3:22]}！结尾", f"某人说：{altered}", ITEM[:8], shuffled, "ＡＢ" + ITEM, f"<b>{ITEM[:10]}</b> {ITEM[10:]}")
    assert set(found) == {0, 1, 4, 5} and found[0] == (19, 0) and found[1] == (20, 1)
    mixed = "the key is 量子处理器的校准数据 and never the value of it at all here"
    assert set(search(mixed, f"so {mixed}.", "量子处理器")) == {0}


def test_pieces_without_spaces():
    pieces = splitting.split_text(ITEM * 20, 300, 30)
    assert {s for *_, s in pieces[:-1]} == {splitting.UNSPACED} and all(b - a <= 300 for a, b, _ in pieces)
