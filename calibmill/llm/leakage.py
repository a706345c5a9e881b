"""Evaluation texts leaking into training text: suffix arrays over the training text.

Training texts are reduced to their letters and digits (case, accents and other character forms, punctuation, markup,
invisible characters and spacing don't count) and laid end to end in shards. Each shard's suffixes are sorted
(those starting with eight bytes that start no test suffix can match none and are left out), and every suffix of
every test item that starts a word is searched in it by bisection; all suffixes that share the item's next words
are one range of the array. Each occurrence is extended to its longest verbatim match, then on both sides by a banded edit
distance over words, which counts the running words and the fewest words altered, dropped or put in between.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that must run together, and one alteration is allowed in so many words.
RUNNING, ONE_IN = 15, 8
#: Words of a seed. Of 15 running words with one altered 7 run verbatim, of 16 with two 5, of more always 5 or more.
SEED_WORDS = 5
#: Bytes that a word put in or altered has at most where spacing doesn't tell the words of the document apart.
GLUED = 24
#: Bytes up to which spaced text is taken for one word, not for several that are glued.
USUAL = 12
#: Bytes of reduced text per shard, and of test text searched in one pass over the corpus.
SHARD_BYTES, BLOCK_BYTES = 4 << 20, 8 << 20

_TAGS = re.compile(r"<[^<>\n]{1,200}>|\]\([^()\s]{1,300}\)|https?://\S+")
_OTHER = re.compile(r"[\W_]+")
# Characters of scripts written without spaces (kana, ideographs); each is a word.
_UNSPACED = "\u3041-\u3096\u30a1-\u30fa\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORDS = re.compile(rf"[{_UNSPACED}]|[^\s{_UNSPACED}]+")
_HAS_UNSPACED = re.compile(f"[{_UNSPACED}]")
# Letters that look like Latin ones but don't decompose to them.
LOOKALIKES = str.maketrans("авекмнорстухіјѕԁԛԝɡıøłđαοντρυχικß", "abekmhopctyxijsdqwgioldaovtpuxikẞ")


_LOOKALIKE = re.compile("[" + "".join(map(chr, LOOKALIKES)) + "]")
# Whether each ASCII character is a letter or digit, and whether it is white space.
_LETTER = np.array([chr(i).isalnum() for i in range(128)])
_SPACE = np.array([chr(i).isspace() for i in range(128)])


def _plain(text: str) -> str:
    """A text with its letters and digits in their plainest form, and whatever is between them."""
    if "<" in text or "](" in text or "://" in text:
        text = _TAGS.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    return text.translate(LOOKALIKES) if _LOOKALIKE.search(text) else text


def reduce_text(text: str) -> str:
    """The letters and digits of a text in their plainest form."""
    return _OTHER.sub("", _plain(text)).replace("ẞ", "ss")


def cut_words(text: str) -> list[str]:
    """A text's words: what spacing sets apart, and within it each character of a script that is written without spaces."""
    return _WORDS.findall(text) if _HAS_UNSPACED.search(text) else text.split()


def word_bounds(text: str) -> list[int]:
    """The offsets in a text's reduced bytes where its words start, and the end."""
    plain = _plain(text)
    if plain.isascii():
        codes = np.frombuffer(plain.encode(), dtype=np.uint8)
        before = np.concatenate([[0], np.cumsum(_LETTER[codes])])
        spaces = np.flatnonzero(_SPACE[codes])
        return np.unique(np.concatenate([[0], before[spaces + 1], before[-1:]])).tolist()
    out, at = [], 0
    for word in cut_words(plain):
        n = len(_OTHER.sub("", word).replace("ẞ", "ss").encode())
        if n:
            out.append(at)
            at += n
    return [*out, at]


class Test:
    """A test item's words, reduced, and their offsets in its reduced text."""

    __slots__ = ("key", "words", "starts", "data")

    def __init__(self, key: int, text: str) -> None:
        self.key = key
        tagless = _TAGS.sub(" ", text)
        self.words = [w.encode() for w in (reduce_text(w) for w in cut_words(tagless)) if w]
        self.starts = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(int).tolist()
        self.data = b"".join(self.words)


def _heads(data: np.ndarray) -> np.ndarray:
    """The first eight bytes of every suffix as a number that sorts like them (data is padded by eight zeros)."""
    out = np.zeros(len(data) - 8, dtype=np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | data[k : k + len(out)].astype(np.uint64)
    return out


class Queries:
    """The suffixes of test items that start a word with ``SEED_WORDS`` words behind it."""

    def __init__(self, tests: list[Test]) -> None:
        self.tests = tests
        self.where = [(t, w) for t, test in enumerate(tests) for w in range(len(test.words) - SEED_WORDS + 1)]
        self.seeds = [tests[t].data[tests[t].starts[w] : tests[t].starts[w + SEED_WORDS]] for t, w in self.where]
        # a seed of under eight bytes starts all heads from its own to the one filled up with ones
        self.heads, self.last = (np.array([int.from_bytes(s[:8].ljust(8, fill), "big") for s in self.seeds], dtype=np.uint64) for fill in (b"\0", b"\xff"))
        self.known = np.zeros(1 << 20, dtype=bool)
        self.known[self.slot(self.heads)] = True
        short = sorted({(int(a), int(b)) for a, b in zip(self.heads, self.last) if a != b}, key=lambda x: (x[0], -x[1]))
        outer: list[tuple[int, int]] = []
        for x in short:  # they nest or lie apart
            if not outer or x[0] > outer[-1][1]:
                outer.append(x)
        self.low, self.high = (np.array([x[side] for x in outer], dtype=np.uint64) for side in (0, 1))
        self.depth = -(-max([8, *map(len, self.seeds)]) // 8) * 8

    def starting(self, heads: np.ndarray) -> np.ndarray:
        """The places of the heads that start a seed, or that a seed of under eight bytes starts."""
        at = np.flatnonzero(self.known[self.slot(heads)])
        at = at[np.isin(heads[at], self.heads)]
        if not len(self.low):
            return at
        of = np.searchsorted(self.low, heads, "right") - 1
        return np.union1d(at, np.flatnonzero((of >= 0) & (heads <= self.high[np.maximum(of, 0)])))

    @staticmethod
    def slot(heads: np.ndarray) -> np.ndarray:
        return ((heads * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def suffix_array(data: np.ndarray, at: np.ndarray, heads: np.ndarray, depth: int = 64) -> np.ndarray:
    """Positions ``at`` sorted by the suffixes that start there, to ``depth`` bytes, eight at a time.

    Only suffixes that are still equal to a neighbour are looked at further. data ends in ``depth`` + 8 zeros.
    """
    order = np.argsort(heads, kind="stable")
    at, rank = at[order], heads[order]
    new = np.concatenate([[True], rank[1:] != rank[:-1]]) if len(at) else np.empty(0, bool)
    for step in range(8, depth, 8):
        group = np.cumsum(new)
        tied = ~new | np.concatenate([~new[1:], [False]]) if len(new) else new
        live = np.flatnonzero(tied)
        if not len(live):
            break
        pos = at[live] + step
        key = np.zeros(len(live), dtype=np.uint64)
        for k in range(8):
            key = (key << np.uint64(8)) | data[np.minimum(pos + k, len(data) - 1)].astype(np.uint64)
        inner = np.lexsort((key, group[live]))
        at[live] = at[live][inner]
        key, of = key[inner], group[live]
        new[live[1:]] |= (key[1:] != key[:-1]) & (of[1:] == of[:-1])
    return at


def _bisect(data: bytes, array: np.ndarray, low: int, high: int, seed: bytes) -> tuple[int, int]:
    """The range of the sorted suffixes within [low, high) that start with the seed."""
    n, end = len(seed), high
    while low < high:
        mid = (low + high) // 2
        at = array[mid]
        if data[at : at + n] < seed:
            low = mid + 1
        else:
            high = mid
    first, high = low, end
    while low < high:
        mid = (low + high) // 2
        at = array[mid]
        if data[at : at + n] <= seed:
            low = mid + 1
        else:
            high = mid
    return first, low


def _next(bounds: list[int], at: int, end: int) -> Iterator[int]:
    """Where a word of the document that starts at this offset may end: at the next bound if its spacing tells the words
    apart, also behind the start of a word of usual length; within glued or spaced out text at any of the next ``GLUED`` bytes."""
    k = bisect_right(bounds, at)
    if k and k < len(bounds) and (bounds[k - 1] == at or bounds[k] - bounds[k - 1] <= USUAL):
        near = bisect_left(bounds, at + 40, 0, min(k + 40, len(bounds))) - bisect_left(bounds, at - 40, max(k - 80, 0), k)
        if near * 2 < min(at + 40, end) - max(at - 40, 0):
            yield bounds[k]
            return
    yield from range(at + 1, min(at + GLUED, end) + 1)


def _run(words: list[bytes], doc: bytes, word: int, at: int) -> int:
    """Equal words from here on."""
    first = word
    while word < len(words) and doc.startswith(words[word], at):
        at += len(words[word])
        word += 1
    return word - first


def _extend(words: list[bytes], doc: bytes, bounds: list[int], budget: int, single: bool) -> list[int]:
    """From the start of both rightwards: for each number of alterations up to the budget the most words covered with so many.

    States (word, byte offset) are reached by their fewest alterations: equal words are free; a word altered, dropped or
    put in costs one. A state with more than (words + 31) / 8 alterations is left: of a passage that goes on behind it, what
    lies before or behind those words is a passage itself, with two alterations less than it may have and a seed of its own.
    single: an equal word follows every alteration.
    A passage ends in two equal words (or the item's last): one word that is equal behind an alteration may be so by chance.
    """
    end, out = len(doc), []
    level, seen = {(0, 0)}, set()
    for edits in range(budget + 1):
        reached, most = set(), out[-1] if out else 0
        for word, at in level:
            run = 0 if edits else 2
            if single and edits and (word == len(words) or not doc.startswith(words[word], at)):
                continue
            while (word, at, run) not in seen:
                seen.add((word, at, run))
                if run == 2 or run and word == len(words):
                    most = max(most, word)
                if word == len(words) or not doc.startswith(words[word], at):
                    reached.add((word, at))
                    break
                to = at + len(words[word])
                if (k := bisect_left(bounds, to)) == len(bounds) or bounds[k] != to:
                    reached.add((word, at))  # the start of a longer word of the document may be equal by chance
                word, at, run = word + 1, to, min(run + 1, 2)
        out.append(most)
        if out[-1] == len(words):
            break
        level = set()
        for word, at in reached:
            if 8 * (edits + 1) > word + 1 + 31:
                continue
            if word < len(words):
                level.add((word + 1, at))
            for to in _next(bounds, at, end):
                level.add((word, to))
                if word < len(words):
                    level.add((word + 1, to))
        if not level:
            break
    return out


def held(words: list[bytes], doc: bytes, bounds: list[int], word: int, at: int) -> tuple[int, int] | None:
    """(running words, alterations) of the item around a verbatim seed at (word, byte offset), or None if too few.

    Words at the ends of a passage may be altered too, as long as the alterations stay one in eight. bounds: where words of
    the document start, and its end.
    """
    before = [w[::-1] for w in reversed(words[:word])]
    back = doc[:at][::-1]
    limit = len(words) // ONE_IN
    run = _run(words, doc, word, at) + _run(before, back, 0, 0)
    if run < 7:
        # n words with e altered leave 7e equal ones or more, and 14 at least, in e + 1 runs; the seed in the longest finds the
        # passage, and if that run has 5 or 6 words, no two alterations can be side by side
        limit = min(limit, run // (7 - run))
    k = bisect_left(bounds, at)
    right = _extend(words[word:], doc[at:], [b - at for b in bounds[k:]], limit, run < 7)
    left = _extend(before, back, [at - b for b in reversed(bounds[: bisect_right(bounds, at)])], limit, run < 7)
    best = None
    for le, l in enumerate(left):
        for re_, r in enumerate(right):
            n, edits = l + r, le + re_
            more = max(0, RUNNING - n)
            while more <= limit and n + more <= len(words) and edits + more > (n + more) // ONE_IN:
                more += 1
            if more > limit or n + more > len(words):
                continue
            if best is None or (n - edits, -edits) > (best[0] - best[1], -best[1]):
                best = n, edits
    return best


SCHEMA = pa.schema([("eval_id", pa.int64()), ("doc_id", pa.int64()), ("eval_word", pa.int32()), ("doc_byte", pa.int32()), ("match_bytes", pa.int32()), ("words_held", pa.int32()), ("alterations", pa.int32())])
DDL = "eval_id bigint, doc_id bigint, eval_word int, doc_byte int, match_bytes int, words_held int, alterations int"


def _search(queries: Queries, ids: list[int], texts: list[bytes], raw: list[str]) -> Iterator[tuple]:
    """Of one shard: for every test item and document with a passage, its longest verbatim match and what is held.

    texts: the reduced ones; raw: as they were.
    """
    flat = b"\0".join(texts) + b"\0" * (queries.depth + 16)
    data = np.frombuffer(flat, dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    heads = _heads(data)
    at = queries.starting(heads)
    if not len(at):
        return
    array = suffix_array(data, at, heads[at], queries.depth)
    sorted_heads = heads[array]
    lows, highs = np.searchsorted(sorted_heads, queries.heads, "left"), np.searchsorted(sorted_heads, queries.last, "right")
    hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for q in np.flatnonzero(lows < highs).tolist():
        low, high = _bisect(flat, array, int(lows[q]), int(highs[q]), queries.seeds[q])
        t, word = queries.where[q]
        for where in array[low:high].tolist():
            doc = int(np.searchsorted(starts, where, "right")) - 1
            hits.setdefault((t, doc), []).append((word, where - int(starts[doc])))
    bounds: dict[int, list[int]] = {}
    for (t, doc), seeds in hits.items():
        test, text = queries.tests[t], texts[doc]
        if doc not in bounds:
            bounds[doc] = word_bounds(raw[doc])
        best, longest, covered = None, (0, 0, 0), set()
        for word, where in sorted(seeds):
            diagonal = where - test.starts[word]
            if (diagonal, word) in covered:
                continue  # within the verbatim match of an earlier seed
            n, own = 0, test.data[test.starts[word] :]
            if text.startswith(own, where):
                n = len(own)
            else:
                low, high = 0, min(len(own), len(text) - where)
                while low < high:  # the longest common prefix, by bisection over slices
                    mid = (low + high + 1) // 2
                    low, high = (mid, high) if text[where : where + mid] == own[:mid] else (low, mid - 1)
                n = low
            end = test.starts[word] + n
            k = word
            while k < len(test.words) and test.starts[k] < end:
                covered.add((diagonal, k))
                k += 1
            longest = max(longest, (n, -word, where))
            found = held(test.words, text, bounds[doc], word, where)
            if found is not None and (best is None or found[0] - found[1] > best[0] - best[1]):
                best = found
        if best is not None:
            yield test.key, ids[doc], -longest[1], longest[2], longest[0], *best


def _shards(batches: Iterator[pa.RecordBatch], tests: list[tuple[int, str]], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    queries = Queries([Test(k, t) for k, t in tests])

    def out(ids: list[int], texts: list[bytes], raw: list[str]) -> Iterator[pa.RecordBatch]:
        rows = list(_search(queries, ids, texts, raw))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)

    ids: list[int] = []
    texts: list[bytes] = []
    raw: list[str] = []
    size = 0
    for batch in batches:
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            reduced = reduce_text(text).encode()
            ids.append(key)
            texts.append(reduced)
            raw.append(text)
            size += len(reduced)
            if size >= shard_bytes:
                yield from out(ids, texts, raw)
                ids, texts, raw, size = [], [], [], 0
    if ids:
        yield from out(ids, texts, raw)


def leaks(documents: DataFrame, items: DataFrame, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per (eval_id, doc_id) where the document's text holds a passage of the item: where its longest verbatim match lies
    (word of the item, byte of the reduced text, bytes), and how many running words are held with how many alterations.

    items: the stated set of test items, read in blocks of at most ``block_bytes``, each searched against all documents. The
    corpus is scanned, never shuffled; shards are cut from the scan. Items of fewer than ``RUNNING`` words, null and
    blank texts match nothing; equal texts under several ids each match.
    """
    least = documents.select("doc_id", "text").where(F.octet_length("text") >= RUNNING)
    found: DataFrame | None = None
    block: list[tuple[int, str]] = []
    size = 0

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        rows = least.mapInArrow(partial(_shards, tests=block, shard_bytes=shard_bytes), DDL)
        return rows if found is None else found.unionByName(rows)

    for row in items.where("text is not null").select("eval_id", "text").toLocalIterator():
        block.append((row["eval_id"], row["text"]))
        size += len(row["text"])
        if size >= block_bytes:
            found, block, size = scan(block), [], 0
    return scan(block) if block or found is None else found


def found_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(documents, items).select("eval_id", "doc_id")


def without_leaks(documents: DataFrame, leaked: DataFrame) -> DataFrame:
    """The documents that hold no passage of a test item."""
    return documents.join(leaked.select("doc_id").distinct(), "doc_id", "left_anti")
